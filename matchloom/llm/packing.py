"""Operator 5: concatenate-and-cut packing of tokenised documents.

Pass 1 tokenises each document once and writes its ids with the partition it was in and
its offset there; partition totals give every partition a global base by prefix sum.
Pass 2 is then row-wise: a document at global offset g with n ids touches the windows
g // size .. (g + n - 1) // size and leaves one boundary record for each.
Only the last window is shorter than ``size``.

Defined results: a null or empty text is the end id alone; repeated rows are packed as
often as they occur; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import arrow_batches, materialise, maybe_broadcast, utf8_buffer

#: Words whose ids a worker remembers; further words are encoded batch by batch.
CACHE_WORDS = 400_000

SPACED = np.arange(256, dtype=np.uint8)
SPACED[[9, 10, 13]] = 32
SPACED_LOWER = SPACED.copy()
SPACED_LOWER[65:91] += 32

_cache: dict[str, dict[str, bytes]] = {}


#: A word of letters that lower-casing maps one to one, and marks behind it: two pieces to the tokenizers below.
PLAIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
#: The piece pattern that PLAIN_WORD is right for.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """Whole-text ids, as the tokenizer gives them, by way of words.

    For lower-casing tokenizers that cut at white space and by PIECES, each distinct word
    is encoded once and remembered; plain words go to the merges without normalising.
    Other tokenizers get whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        raw = json.loads(self.tokenizer.to_str())
        steps = [raw["normalizer"], *((raw["normalizer"] or {}).get("normalizers") or [])]
        cuts = [c.get("pattern", {}).get("Regex") for c in (raw["pre_tokenizer"] or {}).get("pretokenizers") or []]
        self.by_word = any(n and n["type"] == "Lowercase" for n in steps) and cuts == [PIECES, None]
        if self.by_word:
            plain = raw | {"normalizer": None, "pre_tokenizer": raw["pre_tokenizer"]["pretokenizers"][1], "added_tokens": []}
            self.merges = Tokenizer.from_str(json.dumps(plain))
        self.known = _cache.setdefault(path, {})

    @staticmethod
    def _encode(tokenizer: object, words: list[str]) -> dict[str, bytes]:
        if not words:
            return {}
        done = tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids, owner = np.array(done.ids, dtype="<u4"), np.array(done.word_ids, dtype=np.int64)
        raw, cuts = ids.tobytes(), (4 * np.searchsorted(owner, np.arange(len(words) + 1))).tolist()
        return {w: raw[cuts[k] : cuts[k + 1]] for k, w in enumerate(words)}

    def _new(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that are not remembered yet."""
        match, known = PLAIN_WORD.fullmatch, self.known
        halves, other = {}, []
        for w in words:
            if m := match(w):
                halves[w] = m[1].lower(), m[2]
            else:
                other.append(w)
        pieces = {x for pair in halves.values() for x in pair}
        have = {x: known[x] for x in pieces if x in known}
        have |= self._encode(self.merges, [x for x in pieces if x and x not in have])
        have[""] = b""
        out = self._encode(self.tokenizer, other)
        for w, (a, b) in halves.items():
            out[w] = have[a] + have[b]
        if len(known) < CACHE_WORDS:
            known.update(have)
            known.update(out)
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the texts' offsets into them."""
        if not self.by_word:
            each = [np.array(x.ids, dtype=np.uint32) for x in self.tokenizer.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.cumsum([0, *map(len, each)])
        data, offsets = utf8_buffer(column)
        # Only these four blanks separate words here; any other stays inside a word and is the tokenizer's to cut.
        # A-Z are lowered at once, but not beside combining marks (first bytes CC and CD), which normalising may join to them.
        joined = (data == 0xCC).any() or (data == 0xCD).any()
        data = np.insert((SPACED if joined else SPACED_LOWER)[data], offsets[1:], 32)
        offsets = offsets + np.arange(len(offsets))
        cuts = np.concatenate([[0], np.flatnonzero(data == 32) + 1])
        words = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data)).dictionary_encode()
        # Every word ends with its only space.
        distinct = utf8_buffer(words.dictionary)[0].tobytes().decode().split(" ")[:-1]
        found = list(map(self.known.get, distinct))
        if gaps := [k for k, x in enumerate(found) if x is None]:
            new = self._new({distinct[k] for k in gaps})
            for k in gaps:
                found[k] = new[distinct[k]]
        pool = np.frombuffer(b"".join(found), dtype="<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.cumsum(size) - size
        which = words.indices.to_numpy()
        after = np.concatenate([[0], np.cumsum(size[which])])
        at = np.repeat((start[which] - after[:-1]).astype(np.int32), size[which])
        at += np.arange(len(at), dtype=np.int32)
        return pool[at], after[np.searchsorted(cuts, offsets)]


IDS = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("local_offset", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, part, local_offset, doc_tokens, ids as little-endian uint32), end id included."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, offset = WordEncoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, at = encoder.encode(batch.column(1))
            ids = np.insert(ids, at[1:], end_id).astype("<u4", copy=False)
            at = at + np.arange(len(at))
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(4 * at), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.record_batch([batch.column(0), pa.array(np.full(len(raw), part)), pa.array(offset + at[:-1]), pa.array(np.diff(at)), raw], schema=IDS)
            offset += int(at[-1])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, part long, local_offset long, doc_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (bytes), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    ids = materialise(tokenise(docs, tokenizer_path, end_id, id_col, text_col), "pack", "zstd")
    # One row per input partition: bounded by the number of input splits.
    totals = sorted((r.part, r.n) for r in ids.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect())
    base, rows = 0, []
    for part, n in totals:
        rows.append((part, base))
        base += n
    bases = spark.createDataFrame(rows, "part long, base long")
    at = F.col("base") + F.col("local_offset")
    placed = ids.join(maybe_broadcast(bases, len(rows), 16), "part").withColumn("g", at)
    first, last = F.floor(F.col("g") / size), F.floor((F.col("g") + F.col("doc_tokens") - 1) / size)

    def piece(k: Column) -> Column:
        begin, stop = F.greatest(k * size, F.col("g")), F.least((k + 1) * size, F.col("g") + F.col("doc_tokens"))
        start, length = begin - F.col("g"), stop - begin
        cut = F.substring("ids", (start * 4 + 1).cast("int"), (length * 4).cast("int"))
        return F.struct(start.alias("start"), length.alias("length"), cut.alias("ids"), k.alias("sequence_id"), (begin - k * size).alias("offset"))

    # Pieces are cut before they are rows, so that no row carries the whole document's ids.
    pieces = placed.select("doc_id", "doc_tokens", F.explode(F.transform(F.sequence(first, last), piece)).alias("piece"))
    return pieces.select("doc_id", "piece.start", "piece.length", "piece.ids", "doc_tokens", "piece.sequence_id", "piece.offset")
