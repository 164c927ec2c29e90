"""Operator 2: near-duplicate embeddings by collision counting on one-dimensional projections.

Every unit vector is projected on many random lines.  Two vectors at cosine c lie
sqrt(2 - 2c) apart, and on a line their projections differ by a normal variable of that
deviation, so a window of half-width ``w`` around each query holds a true mate with a known
probability.  The pair's collisions are the lines on which it falls in the window; true
mates reach the count ``needed`` with probability RECALL or more, and only pairs that do are
verified by their cosine in double precision.

A window on one line alone holds about half of all vectors at 64 dimensions and cosine
0.9, which is quadratic.  So there are ``lists`` sorted lists, each sorted by a cell (signs
on ``bits`` lines of its own) and then by the projection, and windows run within cells.
``bits`` grows with the logarithm of the number of vectors, which keeps cells at
about CELL vectors; ``lists`` is chosen so that mates at the threshold meet in some list with
probability RECALL.

Links are counted where they are found: each tile of a cell returns, for each vector, the
number of links first met there and one representative of its local component, never
the pairs.  A pair that met in an earlier list is not counted again.  Cells above TILE vectors
are split into tiles of pairs.

Equal vectors are one vector with a multiplicity.  Defined results: vectors that are null,
empty, zero or hold null or non-finite components link with nothing; vectors of different
lengths never link; a null id is its own row; repeated rows count as other vectors but
share their id's component (ids are taken to name one vector each); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import acos, ceil, comb, erf, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import arrow_batches, components, materialise
from matchloom.llm.tiles import bounds, groups, tiled

RECALL = 0.99
#: Vectors expected in a cell, at least.
CELL = 32
TILE = 512
#: Half-width of windows in deviations of a true mate's projections.
WIDTH = 2.5


@dataclass(frozen=True)
class Setting:
    """What the number of vectors and the threshold decide."""

    cosine: float
    bits: int
    lists: int
    window: float
    needed: int

    @staticmethod
    def calibrated(n: int, cosine: float, recall: float = RECALL) -> Setting:
        deviation = sqrt(2 - 2 * cosine)
        window, hit = WIDTH * deviation, erf(WIDTH / sqrt(2))
        bits = max(1, min(62, ceil(log2(max(n, 2) / CELL))))
        together = (1 - acos(min(1.0, cosine)) / pi) ** bits * hit
        lists = max(8, ceil(log(1 - recall) / log(1 - together))) if together < 1 else 8
        # Largest count that a true mate reaches with probability 1 - (1 - recall) / 10.
        needed, below = 0, 0.0
        while needed < lists and below + (p := comb(lists, needed) * hit**needed * (1 - hit) ** (lists - needed)) <= (1 - recall) / 10:
            below += p
            needed += 1
        return Setting(cosine, bits, lists, window, needed)


@cache
def lines(dimensions: int, count: int, seed: int) -> np.ndarray:
    """Random directions, as columns."""
    return np.random.default_rng([seed, dimensions]).standard_normal((dimensions, count))


def unit_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal length as unit vectors in double precision, from a list column without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    v = flat.reshape(len(column), -1)
    # Scaled by the largest component first, so that no square leaves the range of doubles.
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cells_of(v: np.ndarray, s: Setting) -> np.ndarray:
    """Cell of each vector in each list."""
    signs = (v @ lines(v.shape[1], s.bits * s.lists, 11) > 0).reshape(len(v), s.lists, s.bits)
    return signs @ (np.int64(1) << np.arange(s.bits, dtype=np.int64))


def places_of(v: np.ndarray, s: Setting) -> np.ndarray:
    """Projection of each vector in each list."""
    return v @ lines(v.shape[1], s.lists, 13)


def spread(vectors: DataFrame, s: Setting) -> DataFrame:
    """Where each vector lies: list, cell, rep, size."""
    arrow_batches(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).to_numpy()
            for d in np.unique(size):
                rows = pa.array(np.flatnonzero(size == d))
                cells = cells_of(unit_vectors(batch.column(0).take(rows)), s)
                reps = batch.column(1).take(rows)
                for k in range(s.lists):
                    yield pa.record_batch([pa.array(np.full(len(rows), k, np.int32)), pa.array(cells[:, k]), reps, pa.array(np.full(len(rows), d, np.int32))], names=["list", "cell", "rep", "size"])

    return vectors.select("vector", "rep", "size").mapInArrow(run, "list int, cell long, rep long, size int")


def _local_components(linked: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Smallest label in each row's component of a symmetric link matrix."""
    none = np.iinfo(np.int64).max
    while True:
        new = np.minimum(labels, np.where(linked, labels[None, :], none).min(axis=1))
        if (new == labels).all():
            return labels
        labels = new


def tile_links(k: int, s: Setting, v: np.ndarray, rep: np.ndarray, times: np.ndarray, side: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For the linked vectors of a tile of list k: rep, links first met here, local component."""
    places = places_of(v, s)
    order = np.argsort(places[:, k], kind="stable")
    v, rep, times, places = v[order], rep[order], times[order], places[order]
    n = len(rep)
    # Query-centred windows on the sorted list, to the right of each query: a pair is met once.
    high = np.searchsorted(places[:, k], places[:, k] + s.window, "right")
    span = high - np.arange(n) - 1
    a = np.repeat(np.arange(n), span)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(span) - span, span)
    if side is not None:
        across = side[order][a] != side[order][b]
        a, b = a[across], b[across]
    passed = [np.zeros(0, bool)]
    for c in range(0, len(a), 1 << 15):
        one, two = a[c : c + (1 << 15)], b[c : c + (1 << 15)]
        passed.append((np.abs(places[one] - places[two]) <= s.window).sum(axis=1) >= s.needed)
    few = np.concatenate(passed)
    a, b = a[few], b[few]
    if not len(a):
        return
    near = (v @ v.T)[a, b] >= s.cosine
    a, b = a[near], b[near]
    if not len(a):
        return
    linked = np.zeros((n, n), bool)
    linked[a, b] = linked[b, a] = True
    component = _local_components(linked, rep)
    cells = cells_of(v, s)
    new = np.ones(len(a), bool)
    for line in range(k):
        new &= ~((cells[a, line] == cells[b, line]) & (np.abs(places[a, line] - places[b, line]) <= s.window))
    count = np.bincount(a[new], times[b[new]], n) + np.bincount(b[new], times[a[new]], n)
    some = linked.any(axis=1)
    yield rep[some], count[some].astype(np.int64), component[some]


def links(vectors: DataFrame, s: Setting) -> DataFrame:
    """Rows (rep, n, component), several for each linked vector."""
    keys = ["list", "cell", "size", "tile_i", "tile_j"]
    cells = materialise(spread(vectors, s), "cc-cells")
    sizes = cells.groupBy("list", "cell", "size").agg(F.count("*").alias("mates")).where("mates > 1")
    dealt = tiled(cells.join(sizes, ["list", "cell", "size"]), F.col("mates"), F.xxhash64("rep"), TILE)
    rows = dealt.select(*keys, "side", "rep").join(vectors.select("rep", "times", "vector"), "rep")
    sorted_in = rows.repartition(*keys).sortWithinPartitions(*keys)
    arrow_batches(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, keys):
            at = bounds(table, keys)
            number, i, j, side, rep, times = (table.column(c).to_numpy() for c in ("list", "tile_i", "tile_j", "side", "rep", "times"))
            vector = pa.concat_arrays(table.column("vector").chunks)
            out = []
            for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if e - b > 1:
                    out += tile_links(int(number[b]), s, unit_vectors(vector.slice(b, e - b)), rep[b:e], times[b:e], None if i[b] == j[b] else side[b:e])
            if out:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["rep", "n", "component"])

    return sorted_in.mapInArrow(run, "rep long, n long, component long")


def near_vectors(embeddings: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    given = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))
    sound = F.size("vector") > 0
    sound = sound & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    good = F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull()
    named = materialise(given.select("vec_id", F.when(good, F.col("vector")).alias("vector")), "cc-vectors")
    # -0.0 and 0.0 are one value.
    plain = named.where("vector is not null").select("vec_id", F.transform("vector", lambda x: x + 0.0).alias("vector"))
    keyed = plain.select("vec_id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit("second"), "vector").alias("h2"))
    classes = keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"), F.first("vector").alias("vector"))
    classes = materialise(classes.withColumn("size", F.size("vector")), "cc-classes")
    s = Setting.calibrated(classes.count(), cosine)
    found = materialise(links(classes, s), "cc-links")
    comp = components(found.select(F.col("rep").alias("a"), F.col("component").alias("b")), "cc-cc")
    count = found.groupBy("rep").agg(F.sum("n").alias("others"))
    joined = classes.join(count, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = joined.select("h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    linked = keyed.select("vec_id", "h1", "h2").join(of_class, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = named.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
