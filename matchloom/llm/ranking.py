"""Places of rows in an order of all, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import materialise, measured_broadcast, unused


def looked_up(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """df with the other columns of table, whose rows differ in ``on``; null meets null.  The table is broadcast only where its measured size allows it."""
    names = unused([*df.columns, *table.columns], *[f"_{c}" for c in on])
    side = measured_broadcast(table.select(*[F.col(c).alias(n) for c, n in zip(on, names, strict=True)], *[c for c in table.columns if c not in on]))
    meets = F.lit(True)
    for c, n in zip(on, names, strict=True):
        meets = meets & F.col(c).eqNullSafe(F.col(n))
    return df.join(side, meets).drop(*names)


def ranked(df: DataFrame, by: list[str], order: list[Column], tag: str, place: str = "place", rows: str = "rows") -> DataFrame:
    """df with each row's place (from 0) in its group ``by`` under ``order``, and the rows of that group.

    Rows are dealt by ranges of (by, order), sorted where they are and written; what came before a
    partition is a prefix sum over one count for each group and partition that holds some of it.  A hot
    group is so spread over many partitions.  Null is a group of its own and comes first.
    """
    part, at, before = unused([*df.columns, place, rows], "_part", "_at", "_before")
    keys = [F.col(c).asc_nulls_first() for c in by] + order
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
    # The low 33 bits of this id number the rows of a partition.
    laid = materialise(dealt.select("*", F.spark_partition_id().alias(part), (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias(at)), tag)
    pieces = laid.groupBy(*by, part).agg(F.min(at).alias("_from"), F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    earlier = F.coalesce(F.sum("_n").over(group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select(*by, part, (earlier - F.col("_from")).alias(before), F.sum("_n").over(group).alias(rows))
    return looked_up(laid, pieces, [*by, part]).select(*df.columns, (F.col(at) + F.col(before)).alias(place), rows)
