"""Operator 11: removal of repeated byte strings by suffix arrays of content-chosen shards.

A string of ``length`` bytes (a window) that also starts earlier in the table loses all its bytes;
windows never cross texts.  Suffix arrays of shards can only meet what lies in one shard, so
shards are chosen by content: of the pieces of PIECE bytes in a window, the one with the smallest
hash is its anchor, and windows with one anchor go to one shard.  Consecutive windows mostly
have their anchor in common, so what travels is one segment for each run of them.

1. Anchors that occur more than once are counted out.  A window whose anchor occurs once repeats nothing.
2. Equal segments are put together; all but the first are repeated whole.
3. Of anchors with unlike segments, the first of each is cut from the texts and sent to the anchor's
   shard, where a suffix array is built by induced sorting (classified suffixes, recursively sorted
   leftmost-smaller substrings).  Neighbours in it that share ``length`` bytes or more by
   their permuted common prefixes are one window, and all but its earliest place are removed.
4. An anchor with more than HOT segments is split by more of what surrounds it: its windows are
   dealt by where the anchor lies in them, which lengthens what windows of a part have in common, up
   to the whole window.  Copies are put together before each split, so no part grows with the table.
5. What is removed of each text meets the text in one join.

Whole windows are compared in suffix arrays; copies of segments within one anchor are told by 64 bits of
another hash family, and texts of one id by a 64-bit hash.

Defined results: earlier is a smaller id, then a smaller hash of the text, then an earlier start; null
ids come last.  Rows that are equal in id and text are one document and get the same result.  A null
text is empty; texts shorter than ``length`` stay whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import arrow_batches, materialise, release, utf8_buffer
from matchloom.llm.induced import common_prefixes, suffix_array

LENGTH, PIECE = 100, 32
#: Segments of one anchor beyond which it is split.
HOT = 4096
#: Bytes that a suffix array is built over, at least where there are more, and bytes of a partition of shards.
ARRAY_BYTES, PART_BYTES = 1 << 19, 4 << 20
#: Window starts whose hashes are held at once.
SLICE = 1 << 19

_MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)
_PLACE = np.uint64((1 << 21) - 1)
SEPARATOR = 1


def _family(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)


ANCHORS, CONTENT = _family(11), _family(1111)


def piece_hashes(data: np.ndarray, family: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes (a power of two) from every place on, by doubling."""
    h, have = family[data], 1
    while have < size:
        x = h[:-have] * _MIX
        x ^= x >> _SHIFT
        x += h[have:]
        h, have = x, 2 * have
    return h


def _window_minima(v: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        v, have = np.minimum(v[:-have], v[have:]), 2 * have
    return np.minimum(v[: len(v) - (width - have)], v[width - have :]) if have < width else v


def segments(data: np.ndarray, ends: np.ndarray, row: np.ndarray, length: int, piece: int, content: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with one anchor: (row, start, length in bytes, anchor's place in it, anchor hash, content hash or None).

    data holds texts one behind the other, row the text of each byte and ends where each text ends.
    """
    width = length - piece + 1
    parts = -(-(length + width - 1) // piece)
    for low in range(0, len(data) - length + 1, SLICE):
        block = data[low : low + SLICE + length - 1]
        anchors = piece_hashes(block, ANCHORS, piece)
        places = np.arange(len(anchors), dtype=np.uint64)
        best = (_window_minima((anchors & ~_PLACE) | places, width) & _PLACE).astype(np.int64)
        own = row[low : low + len(best)]
        start = np.flatnonzero(ends[own] - low - np.arange(len(best)) >= length)
        if not len(start):
            continue
        at = best[start]
        cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        first, last = start[cut], start[np.append(cut[1:] - 1, len(start) - 1)]
        size, anchor = last - first + length, at[cut]
        told = None
        if content:
            pieces = piece_hashes(block, CONTENT, piece)
            told = size.astype(np.uint64)
            for k in range(parts):
                told = (told ^ (told >> _SHIFT)) * _MIX + pieces[first + np.minimum(k * piece, size - piece)]
        yield own[first], first + low, size, anchor - first, anchors[anchor], told


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = utf8_buffer(column)
    return data, offsets, np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchor_counts(texts: DataFrame, length: int, piece: int) -> DataFrame:
    """Anchors that occur more than once: anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, row = _buffers(batch.column(0))
            for *_, anchor, _told in segments(data, offsets[1:], row, length, piece, False):
                value, n = np.unique(anchor, return_counts=True)
                yield pa.record_batch([_signed(value), pa.array(n)], names=["anchor", "n"])

    counted = texts.select("text").mapInArrow(run, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))
    return counted.where("n > 1").select("anchor")


def placed_segments(texts: DataFrame, length: int, piece: int) -> DataFrame:
    """All segments: anchor, content, doc, twin, start, size, inner (the anchor's place in it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, row = _buffers(batch.column(2))
            for own, start, size, inner, anchor, told in segments(data, offsets[1:], row, length, piece, True):
                whose = pa.array(own)
                yield pa.record_batch(
                    [_signed(anchor), _signed(told), batch.column(0).take(whose), batch.column(1).take(whose), pa.array(start - offsets[own]), pa.array(size.astype(np.int32)), pa.array(inner.astype(np.int32))],
                    names=["anchor", "content", "doc", "twin", "start", "size", "inner"],
                )

    kind = texts.schema["doc"].dataType.simpleString()
    return texts.select("doc", "twin", "text").mapInArrow(run, f"anchor bigint, content bigint, doc {kind}, twin bigint, start bigint, size int, inner int")


def _place() -> Column:
    """Places in their order: unknown documents last."""
    return F.struct(F.col("doc").isNull().alias("unknown"), "doc", "twin", "start")


def once(rows: DataFrame, keys: list[str], carried: list[str], tag: str) -> tuple[DataFrame, DataFrame]:
    """The first of rows with equal keys (keys, carried, place), and (doc, twin, start, end) of all the others.  Carried columns follow from the keys."""
    first = rows.groupBy(*keys).agg(F.min(_place()).alias("place"), *[F.first(c).alias(c) for c in carried], F.count("*").alias("copies"))
    first = materialise(first, tag)
    more = first.where("copies > 1").select(*[F.col(k).alias(f"_{k}") for k in keys], "place")
    met = rows.join(more, [F.col(k) == F.col(f"_{k}") for k in keys]).where(_place() != F.col("place"))
    return first, met.select("doc", "twin", "start", (F.col("start") + F.col("size")).alias("end"))


def cut(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Segments' bytes: wanted (key, hot, inner, size, place) with data from the texts that hold them."""
    # What is listed for a text lies in it, so the list is bounded by the text itself.
    listed = wanted.groupBy(F.col("place.doc").alias("_doc"), F.col("place.twin").alias("_twin")).agg(F.collect_list(F.struct("key", "hot", F.col("place.start").alias("start"), "size", "inner")).alias("wanted"))
    joined = texts.join(listed, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("twin") == F.col("_twin"))).select("doc", "twin", F.col("text").cast("binary").alias("text"), "wanted")
    kind = texts.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = _buffers(batch.column(2))
            listed = batch.column(3)
            whose, flat = pc.list_parent_indices(listed), listed.flatten()
            start, size = flat.field("start").to_numpy(), flat.field("size").to_numpy()
            at = offsets[whose.to_numpy()] + start
            for low in range(0, len(at), 1 << 15):
                part = slice(low, low + (1 << 15))
                n = size[part].astype(np.int64)
                ends = np.cumsum(n)
                index = np.repeat(at[part] - (ends - n), n) + np.arange(ends[-1])
                bytes_ = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data[index])])
                own = whose.slice(low, len(n))
                kept = flat.slice(low, len(n))
                yield pa.record_batch([kept.field("key"), kept.field("hot"), batch.column(0).take(own), batch.column(1).take(own), kept.field("start"), kept.field("size"), kept.field("inner"), bytes_], names=["key", "hot", "doc", "twin", "start", "size", "inner", "data"])

    return joined.mapInArrow(run, f"key bigint, hot boolean, doc {kind}, twin bigint, start bigint, size int, inner int, data binary")


def split(rows: DataFrame, low: int, high: int, width: int, length: int) -> DataFrame:
    """Segments whose anchors lie ``low`` to ``high`` bytes into their windows, dealt by ``width`` of these places; key is of all that a part's windows share."""
    parts = -(-(high - low + 1) // width)
    dealt = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    least = F.lit(low) + F.col("_j") * width
    most = F.least(least + (width - 1), F.lit(high))
    begin, end = F.greatest(F.col("inner") - most, F.lit(0)), F.least(F.col("inner") - least, F.col("size") - length) + length
    dealt = dealt.withColumns({"_least": least, "_most": most, "_begin": begin, "_end": end}).where(F.col("_end") - F.col("_begin") >= length)
    shared = F.substring("data", F.col("inner") - F.col("_least") + 1, length - F.col("_most") + F.col("_least"))
    return dealt.select(
        F.xxhash64("key", "_j", shared).alias("key"), "doc", "twin", (F.col("start") + F.col("_begin")).alias("start"), (F.col("_end") - F.col("_begin")).alias("size"),
        (F.col("inner") - F.col("_begin")).alias("inner"), (F.col("_least")).alias("low"), F.substring("data", F.col("_begin") + 1, F.col("_end") - F.col("_begin")).alias("data"),
    )


def shard_repeats(data: np.ndarray, offsets: np.ndarray, length: int, order: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of segments that also start earlier: (segment, place in it).  order ranks the segments' documents, start is their place there."""
    sizes = np.diff(offsets)
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes + 1)
    text = np.zeros(len(data) + n + 1, np.int32)
    inside = np.concatenate([np.arange(len(data)) + np.repeat(np.arange(n), sizes)])
    text[inside] = data.astype(np.int32) + SEPARATOR + 1
    text[offsets[1:] + np.arange(n)] = SEPARATOR
    array = suffix_array(text)
    shared = common_prefixes(text, array, SEPARATOR)[array]
    place = np.arange(len(text) - 1) - (offsets[:-1] + np.arange(n))[owner]
    group = np.cumsum(shared < length)
    big = np.flatnonzero(np.bincount(group)[group] > 1)  # windows with a copy; shorter suffixes never share so much
    at, group = array[big], group[big]
    where = start[owner[at]] + place[at]
    by = np.lexsort((where, order[owner[at]], group))
    at, group = at[by], group[by]
    new = np.concatenate([[True], group[1:] != group[:-1]])[: len(at)]
    earliest = np.flatnonzero(new)[np.cumsum(new) - 1]
    # A row that occurs twice has one place twice.
    later = (where[by] != where[by][earliest]) | (order[owner[at]] != order[owner[at]][earliest])
    return owner[at[later]], place[at[later]]


def _repeats_of(rows: pa.Table, length: int) -> pa.RecordBatch:
    """Removed stretches of the segments of some shards."""
    data, offsets = utf8_buffer(rows.column("data"))
    rank = pc.rank(rows.column("doc").combine_chunks(), tiebreaker="dense", null_placement="at_end").to_numpy().astype(np.int64)
    order = np.unique(np.stack([rank, rows.column("twin").to_numpy()]), axis=1, return_inverse=True)[1].ravel()
    start = rows.column("start").to_numpy()
    own, place = shard_repeats(data, offsets, length, order, start)
    by = np.lexsort((place, own))
    own, place = own[by], place[by]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1)]) if len(own) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(own) - 1) if len(own) else first
    whose = pa.array(own[first])
    begin = start[own[first]] + place[first]
    return pa.record_batch([rows.column("doc").combine_chunks().take(whose), rows.column("twin").combine_chunks().take(whose), pa.array(begin), pa.array(start[own[last]] + place[last] + length)], names=["doc", "twin", "start", "end"])


def compare(shards: DataFrame, length: int) -> DataFrame:
    """Rows (key, doc, twin, start, data) to removed stretches (doc, twin, start, end): one suffix array for some whole keys."""
    spark = shards.sparkSession
    total = shards.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    # At least as many partitions as Spark is told to shuffle into, and more where they would be large.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    kind = shards.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            low, keys = 0, batch.column(0).to_numpy()
            borders = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
            weights = pc.binary_length(batch.column(4)).to_numpy().cumsum()
            if held and len(keys) and held[-1].column(0)[-1].as_py() != keys[0] and size >= ARRAY_BYTES:
                yield _repeats_of(pa.Table.from_batches(held), length)
                held, size = [], 0
            for border in borders[:-1].tolist():
                here = int(weights[border - 1] - (weights[low - 1] if low else 0))
                if size + here >= ARRAY_BYTES:
                    held.append(batch.slice(low, border - low))
                    yield _repeats_of(pa.Table.from_batches(held), length)
                    held, size, low = [], 0, border
            if low < len(keys):
                held.append(batch.slice(low))
                size += int(weights[-1] - (weights[low - 1] if low else 0))
        if held:
            yield _repeats_of(pa.Table.from_batches(held), length)

    rows = shards.select("key", "doc", "twin", "start", "data").repartition(parts, "key").sortWithinPartitions("key")
    return rows.mapInArrow(run, f"doc {kind}, twin bigint, start bigint, end bigint")


def repeated_spans(texts: DataFrame, length: int, piece: int) -> tuple[DataFrame, list[DataFrame]]:
    """Stretches (doc, twin, start, end) to remove from texts (doc, twin, text), which may overlap; and the tables written on the way."""
    anchors = materialise(anchor_counts(texts, length, piece), "suffix-anchors")
    rows = placed_segments(texts, length, piece).join(anchors.withColumnRenamed("anchor", "_anchor"), F.col("anchor") == F.col("_anchor")).drop("_anchor")
    rows = materialise(rows, "suffix-segments")
    release(anchors)
    first, spans = once(rows, ["anchor", "content"], ["size", "inner"], "suffix-first")
    unlike = first.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select(F.col("anchor").alias("key"), (F.col("n") > HOT).alias("hot"))
    wanted = first.join(unlike, F.col("anchor") == F.col("key")).select("key", "hot", "inner", "size", "place")
    shards = materialise(cut(texts, wanted), "suffix-shards")
    written = [rows, first, shards]
    ready, hot = shards.where("NOT hot").drop("hot", "inner", "size"), shards.where("hot")
    high = length - piece
    width = int(np.ceil(np.sqrt(high + 1)))
    for each in (width, 1):
        if hot.isEmpty():
            break
        parts = split(hot, 0, high, each, length) if each > 1 else split_parts(hot, width, length)
        kept, copies = once(parts, ["key", "data"], ["size", "inner", "low"], f"suffix-split-{each}")
        spans = spans.unionByName(copies)
        written.append(kept)
        if each == 1:
            break  # a part of one window holds no unlike segments
        counts = kept.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n")).where("n > 1")
        met = kept.join(counts, F.col("key") == F.col("_key")).select("key", "place.doc", "place.twin", "place.start", "size", "inner", "low", "data", (F.col("n") > HOT).alias("hot"))
        met = materialise(met, "suffix-parts")
        written.append(met)
        ready = ready.unionByName(met.where("NOT hot").select(*ready.columns))
        hot = met.where("hot")
    return spans.unionByName(compare(ready, length)), written


def split_parts(rows: DataFrame, width: int, length: int) -> DataFrame:
    """Parts of the first split, window by window."""
    moved = rows.withColumn("inner", F.col("inner") - F.col("low"))
    return split(moved, 0, width - 1, 1, length)


def _merged(text: pa.Array, listed: pa.Array) -> Iterator[tuple[list[dict[str, int]], bytes]]:
    """Each text's removed stretches, joined where they touch, and what is left of it."""
    for value, spans in zip(text, listed, strict=True):
        raw = value.as_buffer() if value.is_valid else pa.py_buffer(b"")
        out: list[dict[str, int]] = []
        for span in sorted((s["start"], s["end"]) for s in spans.as_py() or ()):
            if out and span[0] <= out[-1]["end"]:
                out[-1]["end"] = max(out[-1]["end"], span[1])
            else:
                out.append({"start": span[0], "end": span[1]})
        view, at, kept = memoryview(raw), 0, []
        for s in out:
            kept.append(view[at : s["start"]])
            at = s["end"]
        kept.append(view[at:])
        yield out, b"".join(kept)


def dedup_substrings(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_bytes, spans (removed stretches of bytes, in order, apart), kept (the bytes left).

    ``length`` must be at least PIECE.
    """
    if length < PIECE:
        raise ValueError(f"length must be at least {PIECE}")
    arrow_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(text).alias("twin"), text.alias("text"))
    spans, written = repeated_spans(texts, length, PIECE)
    listed = spans.groupBy(F.col("doc").alias("_doc"), F.col("twin").alias("_twin")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    listed = materialise(listed, "suffix-spans")
    for old in written:
        release(old)
    joined = texts.join(listed, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("twin") == F.col("_twin")), "left").select("doc", "text", "spans")
    kind = texts.schema["doc"].dataType.simpleString()
    shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            done = list(_merged(text, batch.column(2)))
            yield pa.record_batch([batch.column(0), pc.binary_length(text).cast(pa.int64()), pa.array([s for s, _ in done], shape), pa.array([k for _, k in done], pa.binary())], names=["doc", "n_bytes", "spans", "kept"])

    out = joined.mapInArrow(run, f"doc {kind}, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")
    return out.withColumnRenamed("doc", id_col)
