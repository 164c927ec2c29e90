"""Latest earlier row of another table, by key and time.

Both sides are put in one stream per key and sorted by time, and a window carries the last value on:
a merge, not a range join.  A key's time is cut into slices, each a group of its own, so a
key with very many rows is spread over them; what a slice starts with is carried over from the
slices before it, of which only one row each is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], tie: str | None = None, slice_seconds: int = 86_400) -> DataFrame:
    """left with the ``values`` of right's latest row of its key at or before its time; null where there is none.

    Of right rows at one time the one with the largest ``tie`` counts.  A null key or time on either side meets nothing.
    Values keep their names, so left must not have them.
    """
    rest = [c for c in left.columns if c not in (key, left_time)]
    value = F.struct(*[F.col(v).alias(v) for v in values])
    # Ties and the rule "at or before" are in the order: right rows come before left ones of the same time.
    order = F.col(tie) if tie else F.lit(0)
    rights = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(F.col(key).alias("_key"), F.col(right_time).cast("timestamp").alias("_at"), F.lit(0).alias("_side"), order.alias("_tie"), value.alias("_value"))
    lefts = left.select(F.col(key).alias("_key"), F.col(left_time).cast("timestamp").alias("_at"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in [key, left_time, *rest]]).alias("_row"))
    both = rights.unionByName(lefts, allowMissingColumns=True).withColumn("_slice", F.floor(F.unix_micros("_at") / (slice_seconds * 1_000_000)))

    last = F.struct("_at", "_tie")
    ends = both.groupBy("_key", "_slice").agg(F.max_by("_value", F.when(F.col("_side") == 0, last)).alias("_last"))
    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("_key").alias("_k"), F.col("_slice").alias("_s"), F.last("_last", ignorenulls=True).over(before).alias("_before"))
    here = Window.partitionBy("_key", "_slice").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_value", F.last("_value", ignorenulls=True).over(here)).where("_side = 1")
    found = seen.join(carried, (F.col("_key") == F.col("_k")) & (F.col("_slice") == F.col("_s")), "left")
    known = F.coalesce("_value", "_before")
    return found.select("_row.*", *[known[v].alias(v) for v in values])


def value_age(requests: DataFrame, changes: DataFrame, key: str, request_time: str, change_time: str, values: list[str], tie: str | None = None) -> DataFrame:
    """requests with the values current at their time, changed_at and age_seconds (null where nothing was known yet)."""
    dated = changes.withColumn("changed_at", F.col(change_time).cast("timestamp"))
    met = asof(requests, dated, key, request_time, change_time, [*values, "changed_at"], tie)
    age = (F.unix_micros(F.col(request_time).cast("timestamp")) - F.unix_micros("changed_at")) / 1_000_000
    return met.withColumn("age_seconds", age)


def age_report(aged: DataFrame, time: str, bucket: str = "1 day", unit_seconds: float = 3600.0) -> DataFrame:
    """Per time bucket: requests, share that found a value, percentiles of its age."""
    age: Column = F.col("age_seconds") / unit_seconds
    start = F.window(F.col(time).cast("timestamp"), bucket).getField("start").alias("bucket")
    percentiles = [F.percentile(age, F.lit(q)).alias(f"p{int(q * 100)}_age") for q in (0.5, 0.95, 0.99)]
    return aged.groupBy(start).agg(F.count("*").alias("n"), F.avg(F.col("age_seconds").isNotNull().cast("double")).alias("known"), *percentiles)
