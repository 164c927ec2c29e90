"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides estimated below this many bytes are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 8 << 20

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session has none and runs in one process (tests) a temporary folder is
    made, which goes when the process ends; a cluster without the setting is an error.
    """
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="matchloom-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return f"file://{_own_dir}"


#: Whether Spark deletes an action's shuffle files at its end instead of when the driver happens to collect garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    What was shuffled for it goes when it is written, so that the disk holds the shuffles of one step and not of all.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._matchloom_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete the files behind a materialised frame that nothing will read again."""
    path = getattr(df, "_matchloom_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint only when the counted size allows it; otherwise the join shuffles."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def measured_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast hint only when the measured size of df's rows, strings included, allows it; df is read once for that."""
    size = F.lit(32)
    for f in df.schema.fields:
        size = size + (F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.typeName() == "string" else F.lit(8))
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def unused(columns: Iterable[str], *stems: str) -> list[str]:
    """A name for each stem that no column has, in any case; the stems themselves where they are free."""
    taken, out = {c.lower() for c in columns}, []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def arrow_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that long texts do not add up in a worker.

    The bounds are the same for all operators and stay for the session: plans are lazy and read
    them when they run.  Bounds that the user has set below Spark's own defaults are kept.
    """
    for name, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 16 << 20)):
        name = f"spark.sql.execution.arrow.{name}"
        now = re.match(r"(-?\d+)\s*([kmg]?)", str(spark.conf.get(name)).lower())
        size = int(now[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[now[2]] if now else 0
        if not 0 < size <= most:
            spark.conf.set(name, str(most))


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the rows' offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bytes with A-Z in lower case, and with white space as one kind of blank.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANKED = LOWER.copy()
BLANKED[9:14] = 32


#: A root that more than one in so many nodes point to is looked up by broadcast; there are at most so many.
HOT_SHARE = 1000


def _looked_up(df: DataFrame, by: str, table: DataFrame, table_rows: int, rows: int) -> DataFrame:
    """df joined (left) with table (key m, value q; unique keys) on df.by = m; the counts bound table and df.

    Past the size of a broadcast, keys that very many rows of df hold are joined by a broadcast of
    their own and only the others are shuffled, so that no key's rows meet in one task.
    """
    if table_rows * 16 <= BROADCAST_BYTES:
        return df.join(F.broadcast(table), F.col(by) == F.col("m"), "left").drop("m")
    hot = df.groupBy(F.col(by).alias("h")).agg(F.count("*").alias("times")).where(F.col("times") * HOT_SHARE > rows)
    hot = [r.h for r in hot.select("h").collect()]  # at most HOT_SHARE x 2 of them
    if not hot:
        return df.join(table, F.col(by) == F.col("m"), "left").drop("m")
    few = F.broadcast(table.where(F.col("m").isin(hot)))
    usual = df.where(~F.col(by).isin(hot)).join(table.where(~F.col("m").isin(hot)), F.col(by) == F.col("m"), "left")
    return usual.unionByName(df.where(F.col(by).isin(hot)).join(few, F.col(by) == F.col("m"), "left")).drop("m")


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component_id), smallest member.

    Each round every node points to its smallest neighbour, pointers are followed to
    their roots by doubling, and the graph is contracted to the roots; rounds end when
    no edge between different roots is left.  All steps are joins and min-aggregates, and
    each round is written to the shared folder.  Null endpoints and loops add nothing.
    """
    current = materialise(
        edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{tag}-e"
    )
    mapping, mapped = None, 0
    while edges_left := current.count():
        # A round has at most two nodes for each edge left: that decides what may be broadcast.
        here = 2 * edges_left
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialise(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("n"), F.least("a", "p").alias("p")), f"{tag}-p")
        while True:
            up = parent.select(F.col("n").alias("m"), F.col("p").alias("q"))
            found = _looked_up(parent.select("n", "p"), "p", up, here, here)
            jumped = materialise(found.select("n", F.coalesce("q", "p").alias("p"), (F.coalesce("q", "p") != F.col("p")).alias("moved")), f"{tag}-j")
            release(parent)
            parent = jumped
            if parent.where("moved").isEmpty():
                break
        step = parent.select(F.col("n").alias("m"), F.col("p").alias("q"))
        if mapping is None:
            new_mapping = parent.select(F.col("n").alias("node"), F.col("p").alias("component_id"))
        else:
            new_mapping = _looked_up(mapping, "component_id", step, here, mapped).select("node", F.coalesce("q", "component_id").alias("component_id"))
        mapped = max(mapped, here)
        new_mapping = materialise(new_mapping, f"{tag}-m")
        ends = _looked_up(current, "a", step, here, here).withColumnRenamed("q", "pa")
        ends = _looked_up(ends, "b", step, here, here).withColumnRenamed("q", "pb")
        contracted = materialise(ends.where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"{tag}-e")
        for old in (current, parent, mapping):
            release(old)
        current, mapping = contracted, new_mapping
    if mapping is None:
        return current.select(F.col("a").alias("node"), F.col("a").alias("component_id"))
    release(current)
    return mapping
