"""Operator 9: benchmark decontamination by the q-gram lemma.

Benchmark items, cut into overlapping segments, are the stated query set; every document is
scanned against all of them.  Segments are of two lengths, in bytes: WINDOW, so dense that
every part of an item of PASSAGE bytes holds a whole one, and SEGMENT, for longer passages
whose edits lie close together; an item shorter than WINDOW is one segment.  If a segment of
n bytes lies in a document with at most e edits, the two share at least n + 1 - q - q * e
q-grams whose diagonals (place in the document minus place in the segment) differ by at most
e.  So shared q-grams are counted in overlapping diagonal bands of width 2 * (e + 1), regions
below that count are dropped without loss for that segment, and the rest are verified by
banded alignment.  e is EDIT_RATE of the segment's length.  Items of fewer than Q bytes have
no q-gram: they are found exactly, by Aho-Corasick, where they stand as words of their own.

Both sides are read as bytes with A-Z lowered and every white-space byte as a space.
Equal segments are one.  Shared q-grams are counted in slices of about PAIRS of them, which
overlap by a segment, so that a text and an item of one repeated character need no more
memory than others.  A benchmark above BLOCK_BYTES is taken in several blocks, one after
another, so that driver and workers hold one block at a time.

Defined results: null, empty or blank texts and items match nothing; repeated items each
report; one row per document row and item with its first best region; an empty table on
either side gives no rows; extra columns are ignored by ``leaks`` and kept by ``clean``,
whatever their names; ``clean`` keeps rows with a null id and drops all rows of an id of
which one leaks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import BLANKED, arrow_batches, materialise, unused, utf8_buffer

Q = 10
EDIT_RATE = 0.08
SEGMENT, STRIDE = 128, 64
WINDOW, WINDOW_STRIDE = 56, 8
#: Every exact passage of an item that has so many bytes is found, and shorter items as a whole.
PASSAGE = WINDOW + WINDOW_STRIDE - 1
#: Benchmark bytes scanned for at once.
BLOCK_BYTES = 1 << 20
#: Document bytes hashed at once, shared q-grams counted at once, regions aligned at once.
CHUNK = 1 << 20
PAIRS = 1 << 18
REGIONS = 2048


def budget(length: int) -> int:
    """Edits allowed in a segment, few enough for the lemma to demand a shared q-gram."""
    return max(0, min(int(EDIT_RATE * length), (length - Q) // Q))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the q-gram at each place: its first eight bytes and its last two."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    head = np.ndarray((n,), "<u8", data, 0, (1,))
    tail = np.ndarray((n,), "<u2", data, Q - 2, (1,))
    h = head * np.uint64(0x9E3779B97F4A7C15)
    h ^= tail.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


class Index:
    """Distinct segments of a block of items and their q-grams, sorted by hash."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        owners: dict[bytes, list[int]] = {}
        self.tiny: dict[bytes, list[int]] = {}
        for item, text in items:
            raw = BLANKED[np.frombuffer((text or "").encode(), np.uint8)].tobytes().strip()
            if 0 < len(raw) < Q:
                self.tiny.setdefault(raw, []).append(item)
            elif raw:
                for segment in dict.fromkeys(cut_up(raw)):
                    owners.setdefault(segment, []).append(item)
        self.segments, self.items = list(owners), list(owners.values())
        self.length = np.array([len(s) for s in self.segments], np.int64)
        self.edits = np.array([budget(len(s)) for s in self.segments], np.int64)
        self.needed = np.maximum(1, self.length + 1 - Q - Q * self.edits)
        hashes = [gram_hashes(np.frombuffer(s, np.uint8)) for s in self.segments]
        size = [len(h) for h in hashes]
        h = np.concatenate([np.zeros(0, np.uint64), *hashes])
        order = np.argsort(h, kind="stable")
        self.owner = np.repeat(np.arange(len(size), dtype=np.int32), size)[order]
        self.place = np.concatenate([np.zeros(0, np.int32), *(np.arange(n, dtype=np.int32) for n in size)])[order]
        self.grams, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.bits = max(12, int(16 * max(1, len(h))).bit_length())
        self.present = np.zeros(1 << self.bits, bool)
        self.present[self.grams >> np.uint64(64 - self.bits)] = True
        self.words = None
        if self.tiny:
            import ahocorasick

            self.words = ahocorasick.Automaton()
            for raw in self.tiny:
                self.words.add_word(raw.decode("latin-1"), raw)
            self.words.make_automaton()

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in data of q-grams that some segment has, and which q-gram."""
        places, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in range(0, len(data) if len(self.grams) else 0, CHUNK):
            h = gram_hashes(data[s : s + CHUNK + Q - 1])
            at = np.flatnonzero(self.present[h >> np.uint64(64 - self.bits)])
            found = np.searchsorted(self.grams, h[at])
            real = self.grams[np.minimum(found, len(self.grams) - 1)] == h[at]
            places.append(at[real] + s)
            which.append(found[real])
        return np.concatenate(places), np.concatenate(which)


def cut_up(raw: bytes) -> Iterator[bytes]:
    """Segments of an item: windows, longer segments, and the last of each flush right."""
    if len(raw) < WINDOW:
        yield raw
        return
    for length, stride in ((WINDOW, WINDOW_STRIDE), (SEGMENT, STRIDE)):
        if len(raw) > length:
            for s in [*range(0, len(raw) - length, stride), len(raw) - length]:
                yield raw[s : s + length]
        elif length == WINDOW or len(raw) > WINDOW:
            yield raw


def regions(index: Index, row: np.ndarray, place: np.ndarray, gram: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, segment, band) of the diagonal bands that hold enough shared q-grams.

    row, place (in its row) and gram of each q-gram hit, in order of row and place.  A band's hits lie
    within a segment's length and two bands of each other, so slices that overlap by that see each
    band whole: a band counts in the slice in which its first possible place lies.
    """
    total = np.concatenate([[0], np.cumsum(index.count[gram])])
    reach = int(index.length.max() + 2 * (index.edits.max() + 1))
    order, s = row * (int(place.max()) + reach + 1) + place, 0
    while s < len(row):
        e = max(s + 1, int(np.searchsorted(total, total[s] + PAIRS, "right")) - 1)
        # Bands that begin before this hit's place are done, those that begin at it or later but before the next slice's are ours.
        begins = (row[s], place[s]) if s else (-1, -1)
        ends = (row[e], place[e]) if e < len(row) else (np.iinfo(np.int64).max, 0)
        last = int(np.searchsorted(order, order[e] + reach, "right")) if e < len(row) else e
        times = index.count[gram[s:last]]
        posting = np.repeat(index.first[gram[s:last]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        segment, r = index.owner[posting].astype(np.int64), np.repeat(row[s:last], times)
        diagonal = np.repeat(place[s:last], times) - index.place[posting]
        # Each diagonal is in two bands of two steps, so any e + 1 neighbouring diagonals share one.
        band = np.floor_divide(diagonal, index.edits[segment] + 1)
        r, segment, band = np.tile(r, 2), np.tile(segment, 2), np.concatenate([band, band - 1])
        head = band * (index.edits[segment] + 1)
        ours = ((r > begins[0]) | ((r == begins[0]) & (head >= begins[1]))) & ((r < ends[0]) | ((r == ends[0]) & (head < ends[1])))
        r, segment, band = r[ours], segment[ours], band[ours]
        if len(r):
            low, span = band.min(), band.max() - band.min() + 1
            keys, count = np.unique(((r - r[0]) * len(index.segments) + segment) * span + (band - low), return_counts=True)
            rest, band = keys // span, keys % span + low
            segment = rest % len(index.segments)
            keep = count >= index.needed[segment]
            yield (rest // len(index.segments) + r[0])[keep], segment[keep], band[keep]
        s = e


def banded_distances(segments: np.ndarray, texts: np.ndarray, inside: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits that turn each segment into a part of its text along the diagonals of a band, and the diagonal where that part ends.

    segments: (regions, n) bytes; texts: (regions, n + width) codes, 256 outside of the text, the
    first at the band's lowest diagonal; inside: (regions, width), whether an alignment may start on
    a diagonal.  More than ``limit`` edits count as limit + 1.
    """
    n, width = segments.shape[1], inside.shape[1]
    steps = np.arange(width, dtype=np.int16)
    row = np.where(inside, 0, limit + 1).astype(np.int16)
    alive = np.arange(len(segments))
    edits, diagonal = np.full(len(segments), limit + 1), np.zeros(len(segments), np.int64)
    for i in range(n):
        nearer = row + (texts[alive, i : i + width] != segments[alive, i : i + 1])  # along the diagonal
        nearer[:, :-1] = np.minimum(nearer[:, :-1], row[:, 1:] + 1)  # a byte of the segment left out
        row = (np.minimum.accumulate(nearer - steps, axis=1) + steps).astype(np.int16)  # bytes of the text left out
        if i % 8 == 7:
            good = row.min(axis=1) <= limit
            if not good.all():
                alive, row = alive[good], row[good]
    if len(alive):
        best = row.argmin(axis=1)
        edits[alive] = np.minimum(row[np.arange(len(alive)), best], limit + 1)
        diagonal[alive] = best
    return edits, diagonal


def find(column: pa.Array, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(row, item, first byte, last byte + 1, edits) for every row and item with a region in budget."""
    data, offsets = utf8_buffer(column)
    data = BLANKED[data]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}

    def found(row: int, items: list[int], got: tuple[int, int, int]) -> None:
        for item in items:
            if (row, item) not in best or got < best[row, item]:
                best[row, item] = got

    if index.words is not None:
        raw = data.tobytes()
        for end, word in index.words.iter(raw.decode("latin-1")):
            start, stop = end + 1 - len(word), end + 1
            row = int(np.searchsorted(offsets, start, "right")) - 1
            if stop <= offsets[row + 1] and not (start > offsets[row] and _joins(raw[start - 1], raw[start])) and not (stop < offsets[row + 1] and _joins(raw[stop - 1], raw[stop])):
                found(row, index.tiny[word], (0, start - int(offsets[row]), stop - int(offsets[row])))
    place, gram = index.hits(data)
    row = np.searchsorted(offsets, place, "right") - 1
    within = place + Q <= offsets[row + 1]
    row, gram, place = row[within], gram[within], (place - offsets[row])[within]
    for rows, segment, band in regions(index, row, place, gram) if len(row) else ():
        for n in np.unique(index.length[segment]).tolist():
            e = budget(n)
            here = np.flatnonzero(index.length[segment] == n)
            here = here[np.lexsort((band[here], rows[here]))]
            low, width = band[here] * (e + 1) - e, 4 * e + 2
            for c in range(0, len(here), REGIONS):
                some = here[c : c + REGIONS]
                # What can't be better than an exact region met before need not be aligned.
                open_ = np.array([any(best.get((r, i), (1,))[0] or best[r, i][1] > d for i in index.items[s]) for r, s, d in zip(rows[some].tolist(), segment[some].tolist(), low[c : c + REGIONS].tolist(), strict=True)], bool)
                some, first = some[open_], low[c : c + REGIONS][open_]
                base, size = offsets[rows[some]], offsets[rows[some] + 1] - offsets[rows[some]]
                at = first[:, None] + np.arange(n + width)
                texts = np.where((at >= 0) & (at < size[:, None]), data[np.clip(base[:, None] + at, 0, len(data) - 1)], 256).astype(np.int16)
                starts = first[:, None] + np.arange(width)
                wanted = np.frombuffer(b"".join(index.segments[s] for s in segment[some].tolist()), np.uint8).reshape(-1, n)
                edits, diagonal = banded_distances(wanted, texts, (starts >= 0) & (starts <= size[:, None]), e)
                for k in np.flatnonzero(edits <= e).tolist():
                    stop = int(min(first[k] + diagonal[k] + n, size[k]))
                    found(int(rows[some[k]]), index.items[segment[some[k]]], (int(edits[k]), max(0, stop - n), stop))
    return [(r, item, a, b, e) for (r, item), (e, a, b) in best.items()]


def _joins(a: int, b: int) -> bool:
    """Whether two neighbouring bytes are of one word."""
    return all(48 <= x < 58 or 97 <= x < 123 or x >= 128 for x in (a, b))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, first_byte, last_byte, edits."""
    spark = docs.sparkSession
    arrow_batches(spark)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    schema = "doc_id long, item_id long, first_byte long, last_byte long, edits int"

    def scanned(k: int) -> tuple[DataFrame, Broadcast]:
        # About BLOCK_BYTES of the query set; the documents are never collected.
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast(sorted(((r.item_id, r.text) for r in part), key=lambda x: (x[0] is None, x[0] or 0, x[1])))
        return narrow.mapInArrow(_scanner(shared, uuid.uuid4().hex), schema), shared

    if blocks == 1:
        return scanned(0)[0]
    out = None
    for k in range(blocks):
        found, shared = scanned(k)
        found = materialise(found, "leaks")
        shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


#: The index a worker has built last, by the name of its block.
_built: dict[str, Index] = {}


def _scanner(shared: Broadcast, name: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _built:
            _built.clear()
            _built[name] = Index(shared.value)
        index = _built[name]
        for batch in batches:
            found = find(batch.column(1), index)
            rows, items, starts, stops, edits = zip(*found, strict=True) if found else ((),) * 5
            yield pa.record_batch(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(items, pa.int64()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), pa.array(edits, pa.int32())],
                names=["doc_id", "item_id", "first_byte", "last_byte", "edits"],
            )

    return run


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that hold a benchmark item; rows with a null id stay."""
    (leaked,) = unused(docs.columns, "leaked")
    found = leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(leaked)).distinct()
    return docs.join(found, F.col(id_col).cast("long") == F.col(leaked), "left_anti")
