"""Operator 4: near-duplicate documents by MinHash bands and odd sketches.

1. Every text becomes the set of its word shingles (64-bit hashes).  Texts with equal sets
   form a class; only classes go on, by a hash of their set, so that what ids they have
   plays no part.
2. ``SAMPLES`` MinHash samples of a class give keys of several samples each (``banding``), and an odd
   sketch: every sample is hashed to one of SKETCH_BITS places and flips the bit there, so
   that the XOR of two sketches has a bit for each place hit an odd number of times by
   samples in which the two differ.  Its population count estimates high similarities
   sharply.  Classes that share a band key are candidates; those whose sketches differ in
   more than ``most_differing`` bits are dropped, and the rest are confirmed on full sets.
3. Not all pairs of a bucket are tried at once.  First every class is tried with the
   bucket's hub, the member with the most bucket mates over all bands.  Confirmed links
   are contracted to components.  Then classes outside their bucket's main component are
   tried with their closest mates (by sketch) of other components, a few first, then
   all that remain.  Pairs inside one component are never tried: they can't change it.
   Buckets above TILE members are split into tiles of pairs.

Bands take the most samples each with which a pair right at the similarity still shares a key
with probability REACHED (6 samples in 21 bands at 0.85, 5 in 25 at 0.80), and its sketches pass but
for what lies SIGMAS deviations out (about 1 in 200 of pairs right at the similarity).

Defined results: null, empty or wordless texts have an empty set and link with nothing;
a null id is its own row without a component, kept; repeated rows are one class; rows of one
id with different texts are grouped by their texts alone; an empty table gives no rows; extra
columns are ignored by ``near_duplicates`` and kept by ``deduplicate``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import arrow_batches, components, materialise, maybe_broadcast, release, unused
from matchloom.llm.shingles import mix, shingle_sets
from matchloom.llm.tiles import bounds, groups, tiled

SAMPLES, SKETCH_BITS = 128, 512
REACHED, SIGMAS = 0.9995, 2.6
#: Members of a bucket compared in one task; larger buckets are split.
TILE = 4096
#: Closest mates tried in each round; None: all that are left.
ROUNDS: tuple[int | None, ...] = (3, None)
_WORDS = SKETCH_BITS // 64


def banding(similarity: float) -> tuple[int, int]:
    """Bands and samples in each: as many as leave a pair of that similarity a shared band with probability REACHED."""
    fits = [r for r in range(1, SAMPLES + 1) if (1 - similarity**r) ** (SAMPLES // r) <= 1 - REACHED]
    rows = max(fits, default=1)
    return SAMPLES // rows, rows


def most_differing(similarity: float, sigmas: float = SIGMAS) -> int:
    """Bits in which the sketches of two sets of that similarity differ at most, but for rare cases."""
    miss = SAMPLES * (1 - similarity)
    high = 2 * (miss + sigmas * np.sqrt(miss * similarity))
    return int(np.ceil(SKETCH_BITS / 2 * (1 - np.exp(-2 * high / SKETCH_BITS))))


def signatures(hashes: np.ndarray, offsets: np.ndarray, n_bands: int, n_rows: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x n_bands, int64) and odd sketches (texts x words, uint64) of nonempty sets."""
    rng = np.random.default_rng(seed)
    factor = rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
    shift = rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(offsets) - 1, SAMPLES), np.uint64)
    for k in range(SAMPLES):
        least[:, k] = np.minimum.reduceat(x * factor[k] + shift[k], offsets[:-1])
    bands = np.empty((len(least), n_bands), np.uint64)
    for b in range(n_bands):
        h = np.full(len(least), b + 1, np.uint64)
        for k in range(b * n_rows, (b + 1) * n_rows):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + least[:, k])
        bands[:, b] = h
    place = mix(least * np.uint64(SAMPLES) + np.arange(SAMPLES, dtype=np.uint64)) >> np.uint64(64 - (SKETCH_BITS - 1).bit_length())
    bit = np.uint64(1) << (place & np.uint64(63))
    sketch = np.stack([np.bitwise_xor.reduce(np.where(place >> np.uint64(6) == w, bit, np.uint64(0)), axis=1) for w in range(_WORDS)], axis=1)
    return bands.view(np.int64), sketch


SIGNED = "doc_id long, row_a long, row_b long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary"


def row_hashes(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two hashes that name a row by its id and text."""
    given, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    return F.xxhash64(given, text), F.xxhash64(text, given)


def sign(docs: DataFrame, id_col: str, text_col: str, width: int, n_bands: int, n_rows: int) -> DataFrame:
    """One row per document: size and identity of its set, band keys and sketch (null for empty sets)."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, hashes, offsets in shingle_sets(batch.column(3), width):
                size = np.diff(offsets)
                n, full = len(size), np.flatnonzero(size)
                total = np.zeros((2, len(hashes) + 1), np.uint64)
                np.cumsum(hashes, out=total[0, 1:])
                np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), out=total[1, 1:])
                ids = (total[:, offsets[1:]] - total[:, offsets[:-1]]).view(np.int64)
                bands, sketch = signatures(hashes, np.append(offsets[full], len(hashes)), n_bands, n_rows) if len(full) else (np.zeros((0, n_bands), np.int64), np.zeros((0, _WORDS), np.uint64))
                has = size > 0
                list_at = np.concatenate([[0], np.cumsum(has * n_bands)]).astype(np.int32)
                raw_at = np.concatenate([[0], np.cumsum(has * _WORDS * 8)]).astype(np.int32)
                yield pa.record_batch(
                    [
                        *(batch.column(k).slice(first, n) for k in range(3)),
                        pa.array(size),
                        pa.array(ids[0]),
                        pa.array(ids[1]),
                        pa.ListArray.from_arrays(pa.array(list_at), pa.array(bands.reshape(-1))),
                        pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(raw_at), pa.py_buffer(np.ascontiguousarray(sketch))]),
                    ],
                    names=["doc_id", "row_a", "row_b", "n_shingles", "set_a", "set_b", "bands", "sketch"],
                )

    row_a, row_b = row_hashes(id_col, text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_a.alias("row_a"), row_b.alias("row_b"), F.col(text_col).alias("text")).mapInArrow(run, SIGNED)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Population counts of XORs: rows of a against rows of b."""
    out = np.zeros((len(a), len(b)), np.int32)
    for w in range(_WORDS):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def close_mates(members: DataFrame, most: int, k: int | None) -> DataFrame:
    """Candidate pairs (a, b) across components within tiles.

    members: key, tile_i, tile_j, side, rep, component, main, sketch, bands.  Pairs of
    classes in the main component are skipped, as are pairs of one component; of the others
    each class gets its k closest mates (all, where k is None).  A pair that shares several
    keys is returned under the first of its bands only.
    """
    keys = ["key", "tile_i", "tile_j"]

    def pairs(reps: np.ndarray, comp: np.ndarray, main: int, sk: np.ndarray, bands: np.ndarray, key: int, side: np.ndarray, own_tile: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left = np.arange(len(reps)) if own_tile else np.flatnonzero(side == 0)
        right = np.arange(len(reps)) if own_tile else np.flatnonzero(side == 1)
        for one, two in ((left, right),) if own_tile else ((left, right), (right, left)):
            outside = one[comp[one] != main]
            for s in range(0, len(outside), 128):
                rows = outside[s : s + 128]
                for c in range(0, len(two), 8192):
                    cols = two[c : c + 8192]
                    d = differing(sk[rows], sk[cols])
                    d[comp[rows][:, None] == comp[cols][None, :]] = SKETCH_BITS + 1
                    if k is not None and len(cols) > k:
                        nearest = np.argpartition(d, k - 1, axis=1)[:, :k]
                        r, n = np.nonzero(np.take_along_axis(d, nearest, 1) <= most)
                        r, n = rows[r], cols[nearest[r, n]]
                    else:
                        r, n = np.nonzero(d <= most)
                        r, n = rows[r], cols[n]
                    # Both of a pair may be outside the main component: it is taken once.
                    twice = (comp[r] != main) & (comp[n] != main) & (reps[r] > reps[n]) if k is None else np.zeros(len(r), bool)
                    equal = bands[r] == bands[n]
                    first = bands[r, equal.argmax(axis=1)] == key if len(r) else np.zeros(0, bool)
                    yield reps[r[first & ~twice]], reps[n[first & ~twice]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, keys):
            reps, comp, main, side = (table.column(c).to_numpy() for c in ("rep", "component", "main", "side"))
            i, j = table.column("tile_i").to_numpy(), table.column("tile_j").to_numpy()
            sk = np.frombuffer(b"".join(table.column("sketch").to_pylist()), "<u8").reshape(-1, _WORDS)
            bands = pa.concat_arrays(table.column("bands").chunks).flatten().to_numpy().reshape(len(reps), -1)
            key, at = table.column("key").to_numpy(), bounds(table, keys)
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                for a, b in pairs(reps[s:e], comp[s:e], main[s], sk[s:e], bands[s:e], key[s], side[s:e], i[s] == j[s]):
                    if len(a):
                        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                        yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    sorted_in = members.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_in.mapInArrow(run, "a long, b long").distinct()


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets meet 100 * intersection >= percent * union."""
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    arrow_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
            id_at = batch.column(name).to_numpy()
            _, first, back = np.unique(id_at, return_index=True, return_inverse=True)
            distinct = [h[o[k] : o[k + 1]] for _, h, o in shingle_sets(batch.column(f"text_{name}").take(pa.array(first)), width) for k in range(len(o) - 1)]
            return [distinct[k] for k in back]

        for batch in batches:
            if not batch.num_rows:
                continue
            good = []
            for k, (x, y) in enumerate(zip(sets(batch, "a"), sets(batch, "b"), strict=True)):
                if len(x) > len(y):
                    x, y = y, x
                if 100 * len(x) >= percent * len(y):
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    both = int((y[at] == x).sum()) if len(y) else 0
                    if both and 100 * both >= percent * (len(x) + len(y) - both):
                        good.append(k)
            yield pa.record_batch([batch.column(c).take(pa.array(good, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, percent: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: doc_id, row_a, row_b, n_shingles; and of its component (null without id or words) the first row and the number of rows.

    ``first`` is the smallest (doc_id, row_a, row_b).
    """
    most, (n_bands, n_rows) = most_differing(percent / 100), banding(percent / 100)
    signed = materialise(sign(docs, id_col, text_col, width, n_bands, n_rows), "nd-signed")
    classed = signed.where("n_shingles > 0 and doc_id is not null").withColumn("rep", F.xxhash64("n_shingles", "set_a", "set_b"))
    own = F.struct("doc_id", "row_a", "row_b")
    classes = materialise(classed.groupBy("rep").agg(F.min(own).alias("own"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nd-classes")
    banded = classes.select("rep", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("mates")).where("mates > 1")
    members = materialise(banded.join(shared, "key"), "nd-members")
    # The hub of a bucket: its member with the most bucket mates over all bands.
    reach = members.groupBy("rep").agg(F.sum("mates").alias("reach"))
    reached = materialise(members.join(reach, "rep"), "nd-reach")
    hubs = reached.groupBy("key").agg(F.max(F.struct("reach", F.bitwise_not("rep").alias("inverse"))).alias("h")).select("key", F.bitwise_not("h.inverse").alias("hub"))
    tried = materialise(
        reached.join(hubs, "key").where("rep != hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct(), "nd-hub-pairs"
    )
    # The text of one row of each class that shares a key.
    in_buckets = members.select("rep").distinct().join(classes.select("rep", "own.row_a", "own.row_b"), "rep")
    n = in_buckets.count()
    row_a, row_b = row_hashes(id_col, text_col)
    narrow = docs.select(row_a.alias("row_a"), row_b.alias("row_b"), F.col(text_col).alias("text"))
    texts = materialise(narrow.join(maybe_broadcast(in_buckets, n, 24), ["row_a", "row_b"]).select("rep", "text").dropDuplicates(["rep"]), "nd-texts")
    sketches = classes.select("rep", "sketch")
    near = tried.join(_sketched(sketches, "a"), "a").join(_sketched(sketches, "b"), "b").where(_xor_bits("sketch_a", "sketch_b") <= most).select("a", "b")
    links = materialise(confirm(near, texts, width, percent), "nd-links")
    comp = components(links, "nd-cc")
    for k in ROUNDS:
        placed = members.join(comp.withColumnRenamed("node", "rep").withColumnRenamed("component_id", "c"), "rep", "left").select("key", "mates", "rep", F.coalesce("c", "rep").alias("component"))
        placed = materialise(placed, "nd-placed")
        sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
        mains = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("m.component").alias("main"))
        open_members = placed.join(mains, "key").join(classes.select("rep", "sketch", "bands"), "rep")
        found = close_mates(tiled(open_members, F.col("mates"), F.xxhash64("rep"), TILE).select("key", "tile_i", "tile_j", "side", "rep", "component", "main", "sketch", "bands"), most, k)
        fresh = materialise(found.join(tried, ["a", "b"], "left_anti"), "nd-fresh")
        more = materialise(confirm(fresh, texts, width, percent), "nd-links")
        tried, links = tried.unionByName(fresh), links.unionByName(more)
        if not more.isEmpty():
            old = comp
            comp = components(links, "nd-cc")
            release(old)
        release(placed)
    placed = classes.select("rep", "own", "n").join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("group", F.coalesce("component_id", "rep"))
    placed = materialise(placed, "nd-grouped")
    of_group = placed.groupBy("group").agg(F.min("own").alias("first"), F.sum("n").alias("n"))
    of_class = placed.select("rep", "group").join(of_group, "group").select("rep", "first", "n")
    rows = signed.select("doc_id", "row_a", "row_b", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.xxhash64("n_shingles", "set_a", "set_b")).alias("rep"))
    out = rows.join(of_class, "rep", "left").drop("rep")
    for old in (members, reached, texts):
        release(old)
    return out


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    rows = grouped(docs, percent, width, id_col, text_col)
    out = rows.select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _sketched(sketches: DataFrame, name: str) -> DataFrame:
    return sketches.select(F.col("rep").alias(name), F.col("sketch").alias(f"sketch_{name}"))


def _xor_bits(a: str, b: str) -> Column:
    """Differing bits of two binary columns, a word at a time."""
    word = lambda c, w: F.conv(F.hex(F.substring(c, 8 * w + 1, 8)), 16, -10).cast("long")
    total = F.lit(0)
    for w in range(_WORDS):
        total = total + F.bit_count(word(a, w).bitwiseXOR(word(b, w)))
    return total


def deduplicate(docs: DataFrame, percent: int = 85, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of every group of near copies: that of the smallest id, and of its texts one.

    Rows that agree in id and text are copies too.  Rows with a null id or without words stay.
    """
    in_groups = materialise(grouped(docs, percent, width, id_col, text_col).where("n > 1").select("row_a", "row_b", "first"), "nd-rows")
    a, b, c, d = unused(docs.columns, "row_a", "row_b", "other_a", "other_b")
    is_first = (F.col("row_a") == F.col("first.row_a")) & (F.col("row_b") == F.col("first.row_b"))
    dropped = in_groups.where(~is_first).select(F.col("row_a").alias(c), F.col("row_b").alias(d)).distinct()
    again = materialise(in_groups.where(is_first).groupBy(F.col("row_a").alias(c), F.col("row_b").alias(d)).count().where("count > 1").select(c, d), "nd-again")
    row_a, row_b = row_hashes(id_col, text_col)
    same = (F.col(a) == F.col(c)) & (F.col(b) == F.col(d))
    kept = docs.withColumns({a: row_a, b: row_b}).join(dropped, same, "left_anti")
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(again, same, "left_semi").dropDuplicates([a, b])
    return kept.join(again, same, "left_anti").unionByName(once).select(*docs.columns)
