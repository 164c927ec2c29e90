"""Which numbers of a set a catalog holds: gaps and islands.

Numbers are letters and a whole number, such as TG5; each letter prefix counts by itself.  A set's
numbers are cut into slices: gaps inside a slice come from a window over it, gaps between slices from
the first and last number of each, so a set with very many numbers is no single group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of a slice.
SLICE = 10_000


def set_numbers(cards: DataFrame) -> DataFrame:
    """Distinct (set_name, prefix, number, total) of cards; total is the largest printed total of the set, null where none is a number.

    Cards whose number is not letters and digits, or has more than 18 digits, are left out.
    """
    parts = lambda k: F.regexp_extract(F.upper("collector_number"), r"^([A-Z]*)(\d{1,18})$", k)
    total = F.when(F.col("printed_total").rlike(r"^\d{1,18}$"), F.col("printed_total")).cast("long")
    shaped = cards.select("set_name", parts(1).alias("prefix"), F.nullif(parts(2), F.lit("")).cast("long").alias("number"), total.alias("total")).where("number IS NOT NULL AND set_name IS NOT NULL")
    return shaped.groupBy("set_name", "prefix", "number").agg(F.max("total").alias("total"))


def _sliced(numbers: DataFrame) -> DataFrame:
    return numbers.withColumn("_slice", F.expr(f"number div {SLICE}"))


def missing_ranges(numbers: DataFrame) -> DataFrame:
    """Rows (set_name, prefix, first, last): the longest runs of numbers that the set lacks, from 1 to its total or its largest number."""
    own = ["set_name", "prefix"]
    sliced = _sliced(numbers.select(*own, "number", "total"))
    within = Window.partitionBy(*own, "_slice").orderBy("number")
    inner = sliced.select(*own, (F.lag("number").over(within) + 1).alias("first"), (F.col("number") - 1).alias("last"))
    ends = sliced.groupBy(*own, "_slice").agg(F.min("number").alias("low"), F.max("number").alias("high"), F.max("total").alias("total"))
    along = Window.partitionBy(*own).orderBy("_slice")
    between = ends.select(*own, (F.coalesce(F.lag("high").over(along), F.lit(0)) + 1).alias("first"), (F.col("low") - 1).alias("last"))
    # Totals are of numbers without a prefix.
    whole = ends.groupBy(*own).agg(F.max("high").alias("high"), F.max("total").alias("total")).where("prefix = ''")
    behind = whole.select(*own, (F.col("high") + 1).alias("first"), F.col("total").alias("last"))
    return inner.unionByName(between).unionByName(behind).where("first <= last")


def coverage(numbers: DataFrame) -> DataFrame:
    """Per set and prefix: present and expected numbers, and the share covered.  0 is present but never expected, and so is what lies beyond the total."""
    own = ["set_name", "prefix"]
    counts = numbers.groupBy(*own).agg(F.max("number").alias("high"), F.max("total").alias("total"))
    expected = F.when((F.col("prefix") == "") & F.col("total").isNotNull(), F.greatest("total", "high")).otherwise(F.col("high"))
    present = numbers.where("number > 0").groupBy(*own).agg(F.count("*").alias("present"))
    joined = counts.join(present, own, "left").select(*own, F.coalesce("present", F.lit(0).cast("long")).alias("present"), expected.alias("expected"))
    return joined.withColumn("share", F.try_divide(F.col("present").cast("double"), F.col("expected").cast("double")))
