"""Batch-hard triplet loss over a labelled batch of vectors.

Every vector meets every other of its batch, in tiles of two chunks each.  Rows are dealt by a hash to chunks and sent to
the tile of their chunk with each chunk, once for each pair of chunks; a tile is a matrix product in numpy, block by block, which serves
the rows of both its chunks, and only each row's hardest distances leave it.  Batches from SPREAD * CHUNK_ROWS to SPREAD * MOST_ROWS vectors
have SPREAD chunks, so what is shuffled grows with the batch; beyond that chunks stay at MOST_ROWS, which bounds a tile's memory.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a chunk, about: of the smallest worth a tile of its own, and at most.
CHUNK_ROWS, MOST_ROWS = 1024, 32768
#: Chunks of batches between the two.
SPREAD = 8
#: Distances that a tile holds at once.
BLOCK = 1 << 22


def chunks_for(rows: int) -> int:
    return max(1, -(-rows // MOST_ROWS), min(SPREAD, -(-rows // CHUNK_ROWS)))


def tiles(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, chunks: int) -> DataFrame:
    """Rows (id, v, label, second, i, j): each row in the tiles i <= j of its chunk with every chunk, as second where its chunk is j and not i."""
    exact = vectors.schema[vector_col].dataType.simpleString() in ("array<float>", "array<double>")
    v = F.col(vector_col) if exact else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"), F.col(label_col).alias("label")).where("v is not null and label is not null")
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return dealt.select("id", "v", "label", (F.col("chunk") > F.col("other")).alias("second"), F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))


def hardest(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, chunks: int | None = None) -> DataFrame:
    """id, positive (largest distance to another of its label), negative (smallest to another label); null without any."""
    chunks = chunks or chunks_for(vectors.count())

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        label = pd.factorize(pdf["label"])[0]
        ids, second = pdf["id"].to_numpy(), pdf["second"].to_numpy()
        v = np.stack(pdf["v"].to_list()).astype(np.float64)
        alone = key[0] == key[1]
        q, m = (np.arange(len(pdf)),) * 2 if alone else (np.flatnonzero(~second), np.flatnonzero(second))
        # Squared distances until the end: roots keep their order.
        positive, negative = np.full(len(pdf), -np.inf), np.full(len(pdf), np.inf)
        b, squares = v[m], (v**2).sum(1)
        step = max(1, BLOCK // max(1, len(m)))
        for at in range(0, len(q) if len(m) else 0, step):
            rows = q[at : at + step]
            d = np.maximum((squares[rows, None] + squares[None, m]) - 2 * v[rows] @ b.T, 0)
            other = label[rows, None] != label[None, m]
            far = np.where(other, -np.inf, d)
            if alone:
                far[ids[rows, None] == ids[None, m]] = -np.inf
            near = np.where(other, d, np.inf)
            positive[rows], negative[rows] = far.max(axis=1), near.min(axis=1)
            if not alone:
                positive[m], negative[m] = np.maximum(positive[m], far.max(axis=0)), np.minimum(negative[m], near.min(axis=0))
        found = [pd.array(np.sqrt(np.where(np.isfinite(x), x, np.nan)), "Float64") for x in (positive, negative)]
        return pd.DataFrame({"id": ids, "positive": found[0], "negative": found[1]})

    found = tiles(vectors, id_col, vector_col, label_col, chunks).groupBy("i", "j").applyInPandas(run, "id long, positive double, negative double")
    return found.groupBy("id").agg(F.max("positive").alias("positive"), F.min("negative").alias("negative"))


def triplet_loss(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, margin: float = 0.2) -> DataFrame:
    """loss: mean of max(positive - negative + margin, 0) over rows that have both; null without any."""
    both = hardest(vectors, id_col, vector_col, label_col).where("positive is not null and negative is not null")
    return both.agg(F.avg(F.greatest(F.col("positive") - F.col("negative") + margin, F.lit(0.0))).alias("loss"), F.count("*").alias("n_rows"))


