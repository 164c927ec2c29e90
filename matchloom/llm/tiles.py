"""Splitting hot groups into bounded tiles of pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiled(df: DataFrame, count: Column, by: Column, size: int) -> DataFrame:
    """Rows with tile_i <= tile_j and side added, such that any two rows of a group meet in one tile.

    A group of ``count`` rows is dealt by the hash ``by`` to ceil(count / size) chunks; a
    row of chunk c is sent to the tiles (c, j) as side 0 and (i, c) as side 1, once each.
    In a tile with tile_i = tile_j all rows are side 0.  A group of one chunk is not repeated.
    """
    chunks = F.ceil(count / size).cast("int")
    other = F.sequence(F.lit(0), chunks - 1)
    return (
        df.withColumn("_chunk", F.pmod(by, chunks).cast("int"))
        .withColumn("_other", F.explode(other))
        .withColumn("tile_i", F.least("_chunk", "_other"))
        .withColumn("tile_j", F.greatest("_chunk", "_other"))
        .withColumn("side", (F.col("_chunk") > F.col("_other")).cast("int"))
        .drop("_chunk", "_other")
    )


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of a stream that is sorted by keys: tables that each hold one or more full groups.

    What is held back is at most the last, still open group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            changed[1:] |= v[1:] != v[:-1]
        if held and any(held[-1].column(k)[held[-1].num_rows - 1].as_py() != batch.column(k)[0].as_py() for k in keys):
            changed[0] = True
        cut = np.flatnonzero(changed)
        if len(cut):
            last = int(cut[-1])
            done = [*held, batch.slice(0, last)]
            yield pa.Table.from_batches([b for b in done if b.num_rows]).combine_chunks()
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Starts of the groups of a table sorted by keys, and its length."""
    n = table.num_rows
    changed = np.ones(n + 1, bool)
    if n:
        changed[1:n] = False
    for k in keys:
        v = table.column(k).to_numpy()
        changed[1:n] |= v[1:] != v[:-1]
    return np.flatnonzero(changed)
