"""Operator 3: language identification by multinomial naive Bayes over hashed character n-grams.

n-grams are of code points in (simple) lower case, so they mean the same in any script.
Training counts the n-grams of labelled texts per language into ``buckets`` hash buckets,
partition by partition; the smoothed log-probability matrix (languages x buckets) is
broadcast.  Prediction walks each Arrow batch as one array of code points: n-gram hashes of
all its texts at once, gathers from the matrix, one segmented sum per text.

The classifier is fitted on at most about ``max_train_docs`` labelled documents, picked by a
hash of the id, as many of each language as of any other where there are enough.  No language
is left out; the matrix takes 128 KB for each, and gathers are cut so that many languages need
no more memory than few.

``score`` is a posterior over the learned languages and says nothing of texts in none of them.
``fit`` does: how many deviations the text's mean log-likelihood per n-gram of letters lies from
that of labelled texts of the language, given how many there are.  Texts in a learned language lie
near 0, others far below; marks and digits do not count.

Defined results: null text, text without a letter, or nothing to learn from give ``und``,
score 0 and fit 0; ties go to the language first in alphabetical order; repeated rows and
extra columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import arrow_batches, unused, utf8_buffer

ORDERS = (1, 2, 3, 4)
#: Orders of the n-grams of letters that say whether a text fits.
FIT_ORDERS = (3, 4)
BUCKETS = 1 << 15
MAX_TRAIN_DOCS = 20_000
TRAIN_TASKS = 12
#: n-grams that count as evidence for the score; longer texts are no surer than this.
EVIDENCE = 50
#: Deviation of the mean log-likelihood between texts of one language, and how many n-grams vary together by overlap and repetition.
BETWEEN, CLUMPED = 0.4, 6.0
#: Bytes scored at once, and matrix entries gathered at once.
BLOCK = 1 << 20
GATHERED = 1 << 23

_PRIMES = np.array([2654435761, 2246822519, 3266489917, 668265263], dtype=np.uint32)


@cache
def _lower_table() -> np.ndarray:
    """Lower case of code points that have one of a single code point."""
    low = [chr(c).lower() for c in range(0x20000)]
    return np.array([ord(x) if len(x) == 1 else c for c, x in enumerate(low)], np.uint32)


@cache
def _letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x20000)])


def lettered(points: np.ndarray, order: int) -> np.ndarray:
    """Whether the n-gram that starts at each code point is all letters."""
    table = _letter_table()
    letter = (points >= len(table)) | table[np.minimum(points, len(table) - 1)]
    out = letter.copy()
    for k in range(1, order):
        out[: len(out) - k] &= letter[k:]
        out[max(0, len(out) - k) :] = False
    return out


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of UTF-8 bytes, and the texts' offsets in them."""
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    if len(points) != heads[-1]:  # not UTF-8: bytes that begin a character stand for it
        points = data[(data & 0xC0) != 0x80].astype(np.uint32)
    table = _lower_table()
    return np.where(points < len(table), table[np.minimum(points, len(table) - 1)], points), heads[offsets]


def ngram_buckets(points: np.ndarray, offsets: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each code point; ``buckets`` where a text ends before it does."""
    n = len(points)
    out = np.full(n, buckets, np.int32)
    if n >= order:
        h = np.full(n - order + 1, order, np.uint32)
        for k in range(order):
            h = (h ^ points[k : n - order + 1 + k]) * _PRIMES[k]
            h ^= h >> np.uint32(15)
        out[: n - order + 1] = h & np.uint32(buckets - 1)
        for k in range(1, order):
            ends = offsets[1:] - k
            out[ends[ends >= offsets[:-1]]] = buckets
    return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_prob: np.ndarray  # (buckets + 1, languages), the last row 0
    log_prior: np.ndarray
    usual: np.ndarray  # (languages, 2): mean and variance of the log-likelihood of n-grams of letters in labelled texts


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about BLOCK bytes: first row, one past the last, code points, offsets."""
    data, offsets = utf8_buffer(column)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
        yield first, last, *code_points(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", buckets: int = BUCKETS, max_train_docs: int = MAX_TRAIN_DOCS) -> Model | None:
    """Fit on rows with text and language; None when there are none."""
    spark = labelled.sparkSession
    arrow_batches(spark)
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())
    if not sizes:
        return None
    total, languages = sum(n for _, n in sizes), [x for x, _ in sizes]
    if total > max_train_docs:
        quota = _quota([n for _, n in sizes], max_train_docs)
        shares = spark.createDataFrame([(x, min(1_000_000, int(1_000_000 * quota / n) + 1)) for x, n in sizes], "lang string, share int")
        picked = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < F.col("share")
        rows = rows.join(F.broadcast(shares), "lang").where(picked).select("id", "text", "lang")
    code = {x: k for k, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, len(languages), buckets + 1), np.int64)
        for batch in batches:
            codes = np.array([code.get(x, -1) for x in batch.column(1).to_pylist()])
            for first, last, points, offsets in _blocks(batch.column(0)):
                owner = np.repeat(codes[first:last], np.diff(offsets))
                for order in ORDERS:
                    at = ngram_buckets(points, offsets, order, buckets)
                    for which, kept in ((0, owner >= 0), (1, (owner >= 0) & lettered(points, order))):
                        if which == 0 or order in FIT_ORDERS:
                            counts[which] += np.bincount(owner[kept] * (buckets + 1) + at[kept], minlength=counts[which].size).reshape(counts[which].shape)
        lang, bucket = np.nonzero(counts[0, :, :buckets])
        yield pa.record_batch([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), *(pa.array(c[lang, bucket]) for c in counts)], names=["l", "b", "n", "letters"])

    # The sample is bounded, so few tasks count it; what they send is bounded by languages x buckets each.
    sample = rows.select("text", "lang").repartition(TRAIN_TASKS)
    got = sample.mapInArrow(count, "l int, b int, n long, letters long").groupBy("l", "b").agg(F.sum("n").alias("n"), F.sum("letters").alias("letters")).toArrow()
    counts = np.zeros((2, len(languages), buckets))
    for which, name in enumerate(("n", "letters")):
        counts[which, got["l"].to_numpy(), got["b"].to_numpy()] = got[name].to_numpy()
    smooth = counts[0] + 0.5
    log = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    table = np.zeros((buckets + 1, len(languages)), np.float32)
    table[:buckets] = log.T
    # What n-grams of letters show in labelled texts of each language.
    share = counts[1] / np.maximum(1, counts[1].sum(axis=1, keepdims=True))
    mean = (share * log).sum(axis=1)
    spread = (share * (log - mean[:, None]) ** 2).sum(axis=1)
    return Model(languages, table, np.log(np.array([n for _, n in sizes]) / total), np.stack([mean, spread], axis=1))


def _quota(sizes: list[int], most: int) -> float:
    """The number of rows of each language at which min(size, quota) sums to most."""
    left, ordered = most, sorted(sizes)
    for k, n in enumerate(ordered):
        if n * (len(ordered) - k) > left:
            return left / (len(ordered) - k)
        left -= n
    return float(ordered[-1])


def score_texts(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the best language, its probability, and fit, for each text."""
    best, prob, fit = np.zeros(len(column), np.int64), np.zeros(len(column)), np.zeros(len(column))
    buckets, step = len(model.log_prob) - 1, max(1024, GATHERED // len(model.languages))
    for first, last, points, offsets in _blocks(column):
        size = np.diff(offsets)
        full = np.flatnonzero(size)
        likely, seen = np.zeros((last - first, len(model.languages))), np.zeros(last - first)
        if len(full):
            for order in ORDERS:
                at = ngram_buckets(points, offsets, order, buckets)
                for s in range(0, len(at), step):  # a text longer than a step is summed in parts
                    e = min(len(at), s + step)
                    rows = full[np.searchsorted(offsets[full + 1], s, "right") : np.searchsorted(offsets[full], e, "left")]
                    starts = np.maximum(offsets[rows], s) - s
                    likely[rows] += np.add.reduceat(model.log_prob[at[s:e]], starts, axis=0)
                seen += np.maximum(0, size - order + 1)
        scaled = likely * np.minimum(1, EVIDENCE / np.maximum(seen, 1))[:, None] + model.log_prior
        top = np.argmax(likely + model.log_prior, axis=1)
        odds = np.exp(scaled - scaled.max(axis=1, keepdims=True))
        own = np.arange(last - first)
        best[first:last], prob[first:last] = top, odds[own, top] / odds.sum(axis=1)
        mean, spread = model.usual[top].T
        total, count = np.zeros(last - first), np.zeros(last - first)
        owner = np.repeat(own, size)
        for order in FIT_ORDERS:
            at = ngram_buckets(points, offsets, order, buckets)
            kept = np.flatnonzero(lettered(points, order) & (at < buckets))
            total += np.bincount(owner[kept], model.log_prob[at[kept], top[owner[kept]]], last - first)
            count += np.bincount(owner[kept], minlength=last - first)
        count = np.maximum(count, 1)
        fit[first:last] = np.where(total < 0, (total / count - mean) / np.sqrt(BETWEEN**2 + CLUMPED * spread / count), 0.0)
    return best, prob, fit


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score", fit_col: str = "fit") -> DataFrame:
    """docs with the prediction, its score and fit added (replacing columns of those names, in any case)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    added = (lang_col, score_col, fit_col)
    kept = [c for c in docs.columns if c.lower() not in {x.lower() for x in added}]
    if model is None:
        return docs.select(*kept, F.lit("und").alias(lang_col), F.lit(0.0).alias(score_col), F.lit(0.0).alias(fit_col))
    shared = spark.sparkContext.broadcast(model)
    (letters_at,) = unused([*kept, *added], "letters")
    given = docs.select(*kept, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias(letters_at))
    schema = docs.select(*kept).schema.add(lang_col, "string").add(score_col, "double").add(fit_col, "double")
    text_at, n = kept.index(text_col), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        names = np.array(fitted.languages, dtype=object)
        for batch in batches:
            best, prob, fit = score_texts(batch.column(text_at), fitted)
            letters = batch.column(n).to_numpy(zero_copy_only=False).astype(bool)
            found = [pa.array(np.where(letters, names[best], "und"), pa.string()), pa.array(np.where(letters, prob, 0.0)), pa.array(np.where(letters, fit, 0.0))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *found], names=[*kept, *added])

    return given.mapInArrow(run, schema)
