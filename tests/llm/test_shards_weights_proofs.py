"""Substring dedup, importance resampling and Merkle manifests against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.llm import importance, induced, merkle, suffixes
from matchloom.llm.queries import queries
from matchloom.llm.sql import ORACLE

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, "   \n\t ", "en", None, 3), (4, "one", None, "s", 3), (5, "one", "en", "s", 3), (5, "one", "en", "s", 3),
    (6, "é ß 漢字 \U0001f600 é " * 40, "fr", "s", 1), (None, "no id here at all " * 9, "en", "s", 1), (7, "word " * 30_000, "en", "s", 1), (8, "!!! ... 123", "", "s", 1), (9, "line\nline\nline", "en", "s", 1),
]


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_suffix_array_dedup", "op12_importance_resampling", "op13_merkle_manifest"])
def test_query_matches_sql(spark, name):
    import os

    import duckdb

    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df, other = queries()[name](spark, SF), db.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(other.columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted((tuple(r) for r in other.select(*columns).fetchall()), key=str)


# Suffix arrays


@pytest.mark.parametrize("limit", [0, 400])
def test_suffix_arrays_and_prefixes_as_sorted(monkeypatch, limit):
    monkeypatch.setattr(induced, "SMALL_ALPHABET", limit)
    rng = np.random.default_rng(limit)
    for _ in range(400):
        text = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(0, 70)), 0).astype(np.int32)
        plain = text.tolist()
        expected = sorted(range(len(plain)), key=lambda i: plain[i:])
        order = induced.suffix_array(text)
        assert order.tolist() == expected
        shared = induced.common_prefixes(text, order, 1)
        for a, b in zip(expected, expected[1:], strict=False):
            k = 0
            while plain[a + k] == plain[b + k] > 1:
                k += 1
            assert shared[b] == k


def first_occurrences(rows: list[tuple], length: int) -> dict:
    """(id, text) to (removed spans, kept bytes), window by window."""
    seen, out = set(), {}
    for key, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        dead = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            window = raw[i : i + length]
            if window in seen:
                dead[i : i + length] = b"\1" * length
            seen.add(window)
        spans = [m.span() for m in re.finditer(rb"\x01+", bytes(dead))]
        out[key, text] = (len(raw), spans, bytes(c for c, d in zip(raw, dead, strict=True) if not d))
    return out


def substrings(df, length=100):
    got = {}
    for r in suffixes.dedup_substrings(df, length).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)))
    return got


def compare(spark, rows, length=100):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = defaultdict(list)
    plain = first_occurrences(rows, length)
    for r in rows:
        expected[r[0]].append(plain[r])
    assert substrings(df, length) == dict(expected)


def copies(rng: random.Random) -> list[tuple]:
    common, passage = words(rng, 9), words(rng, 60)
    rows = [(k, f"{words(rng, 20)} {common} {words(rng, 20)}") for k in range(80)]
    rows += [(100 + k, f"{words(rng, k)}{passage[k:]}{words(rng, 3)}") for k in range(40)]
    whole = words(rng, 80)
    rows += [(200 + k, whole) for k in range(30)]
    rows += [(300 + k, whole[:k] + "#" + whole[k:]) for k in range(0, 300, 17)]
    rows += [(400, "ab" * 300), (401, "ab" * 90), (402, "b" + "ab" * 90), (403, "é" * 120), (404, "x" * 99), (405, "x" * 100), (406, "x" * 101), (407, "y" * 99)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [2, 4096])
def test_repeated_strings_as_brute_force(spark, monkeypatch, hot):
    """Also where anchors are split: at a limit of two segments most are, in both steps."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    compare(spark, copies(random.Random(5)))


@pytest.mark.parametrize("length", [32, 50, 131])
def test_strings_of_other_lengths(spark, length):
    compare(spark, copies(random.Random(length))[:150], length)


def test_small_slices_and_arrays_change_nothing(spark, monkeypatch):
    """Borders of slices and of suffix arrays fall anywhere."""
    monkeypatch.setattr(suffixes, "SLICE", 300)
    monkeypatch.setattr(suffixes, "ARRAY_BYTES", 500)
    compare(spark, copies(random.Random(8)))


def test_substrings_of_odd_rows(spark):
    got = substrings(spark.createDataFrame(ODD, DOCS).withColumnsRenamed({"n_chars": "spans", "lang": "twin", "source": "data"}))
    assert got[1] == [(0, [], b"")] and got[2] == [(0, [], b"")]
    assert got[5] == [(3, [], b"one")] * 2
    assert got[7][0][1] == [(5, 150_000)] and got[7][0][2] == b"word "
    assert len(got[6][0][2]) < len(ODD[6][1].encode())
    # A repeated row is one document: neither is a copy of the other.
    text = words(random.Random(1), 40)
    again = substrings(spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (None, text)], "doc_id long, text string"))
    n = len(text.encode())
    assert again[1] == [(n, [], text.encode())] * 2 and again[2] == [(n, [(0, n)], b"")] and again[None] == [(n, [(0, n)], b"")] * 2
    assert substrings(spark.createDataFrame([], "doc_id long, text string")) == {}
    with pytest.raises(ValueError, match="at least"):
        suffixes.dedup_substrings(spark.createDataFrame([], "doc_id long, text string"), 10)


def test_ids_of_other_types(spark):
    text = words(random.Random(2), 40)
    got = substrings(spark.createDataFrame([("b", text), ("a", text)], "doc_id string, text string"))
    assert got["a"][0][1] == [] and got["b"][0][1] == [(0, len(text))]


# Importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def resampled(docs, target, percent, least, seed, most, buckets):
    def features(text):
        ws = WORD.findall((text or "").translate(LOW))
        return [zlib.crc32(" ".join(ws[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(ws) - n + 1)], len(ws)

    mine = [(key, *features(text)) for key, text in docs]
    s, t = Counter(b for _, fs, _ in mine for b in fs), Counter(b for text in target for b in features(text)[0])
    total, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets))))
    rows = []
    for key, fs, n in mine:
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, fs))
        rows.append([key, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    enough = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(enough[: percent * len(enough) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize(("most", "buckets"), [(1, 10_000), (3, 500)])
def test_drawn_documents_as_brute_force(spark, most, buckets):
    rng = random.Random(most)
    docs = [(k, words(rng, rng.randint(0, 60)) + rng.choice(["", " Ünïcode WORDS", " 12-34"])) for k in range(200)] + [(r[0], r[1]) for r in ODD]
    target = [words(rng, 30) for _ in range(20)] + [None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("rank", F.lit("x"))
    got = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), 30, 20, "7", most=most, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == resampled(docs, target, 30, 20, "7", most, buckets)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    assert {r.doc_id: (r.n_features, r.rank) for r in importance.resample(some, none, 100, 1).collect()} == {1: (3, 1), 2: (0, None)}


# Merkle manifests


def H(*parts):  # noqa: N802
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, arity):
    current, proofs, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(current) > 1:
        for k, i in enumerate(at):
            low = i // arity * arity
            proofs[k].append(("".join(current[low:i]), "".join(current[i + 1 : low + arity])))
            at[k] = i // arity
        current = [H(*current[k : k + arity]) for k in range(0, len(current), arity)]
    return current[0], proofs


def plain_manifest(rows, arity, claimed=lambda r: r):
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*(value(r[k]) for k in (0, 3, 2, 4, 1)))
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), leaf(claimed(r)), r[0]))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    built = {g: plain_tree([x[2] for x in sorted(groups[g])], arity) for g in langs}
    root, above = plain_tree([built[g][0] for g in langs], arity)
    out = []
    for g, up in zip(langs, above, strict=True):
        for (_, _, own, other, key), steps in zip(sorted(groups[g]), built[g][1], strict=True):
            folded = other
            for left, right in steps + up:
                folded = H(left, folded, right)
            out.append((key, own, built[g][0], root, H(*(a + b for a, b in steps + up)), folded, folded == root))
    return sorted(out, key=str)


def manifest(df, arity=2, claimed=None):
    out = merkle.manifest(df, arity=arity, claimed=claimed).withColumn("proof", merkle.proof_digest(F.col("proof")))
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize(("arity", "levels"), [(2, 9), (2, 2), (3, 1)])
def test_proofs_as_brute_force(spark, monkeypatch, arity, levels):
    """Also over several rounds of levels."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rng = random.Random(levels)
    rows = [(k, words(rng, 4), rng.choice(["en", "de", "é", "z", None]), rng.choice(["a", None]), k % 5 or None) for k in range(90)] + [(500, "alone", "zz", "s", 1)] + ODD
    wrong = lambda r: (*r[:4], None if r[4] is None else r[4] + (r[0] is not None and r[0] % 3 == 0))
    df = spark.createDataFrame(rows, DOCS).withColumn("place", F.lit("x")).withColumn("tree", F.lit(1))
    expr = {"n_chars": F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    got = manifest(df, arity, expr)
    assert got == plain_manifest(rows, arity, wrong)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "t", "en", "s", 1)], DOCS)
    [row] = manifest(one)
    assert row[1] == row[2] == row[3] == row[5] and row[4] == H() and row[6]
    assert manifest(spark.createDataFrame([], DOCS)) == []
    # A changed, lost or added row changes the root; another order of rows does not.
    rows = [(k, f"t{k}", "en", "s", k) for k in range(20)]
    root = lambda r: manifest(spark.createDataFrame(r, DOCS))[0][3]
    assert root(rows) == root(rows[::-1])
    assert len({root(rows), root(rows[1:]), root([*rows, rows[0]]), root([(0, "T0", "en", "s", 0), *rows[1:]])}) == 4
