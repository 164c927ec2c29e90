"""Benchmark metrics, promotion gates and operating figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Gates.
MAX_FALSE_CONFIDENT, MIN_TOP1, MIN_REJECTION, MAX_P95_MS, MAX_SLICE_DEFICIT = 0.002, 0.97, 0.95, 1000.0, 0.05


def accuracy(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """results: expected (null for a negative), status, top_card_id, top3, and slice columns.

    top1: of positives that are recognised, those with the expected card first; top3_recall:
    of ambiguous positives, those with it among three; false_confident: of all results,
    wrong matches; rejection: of negatives, those unrecognised.  Null without a denominator.
    """
    return results.groupBy(*(by or [])).agg(*_accuracy_metrics())


def _accuracy_metrics() -> list[Column]:
    positive, negative = F.col("expected").isNotNull(), F.col("expected").isNull()
    right = F.coalesce(F.col("top_card_id") == F.col("expected"), F.lit(False))
    mean = lambda x, where: F.avg(F.when(where, x.cast("double")))
    return [
        F.count("*").alias("n"),
        mean(right, positive & (F.col("status") != "unrecognized")).alias("top1"),
        mean(F.coalesce(F.array_contains("top3", F.col("expected")), F.lit(False)), positive & (F.col("status") == "ambiguous")).alias("top3_recall"),
        F.avg(((F.col("status") == "matched") & ~right).cast("double")).alias("false_confident"),
        mean(F.col("status") == "unrecognized", negative).alias("rejection"),
    ]


def slice_report(results: DataFrame, dimensions: list[str], crossed: list[tuple[str, ...]] | None = None) -> DataFrame:
    """Metrics of all results, of every value of every dimension and of every combination in ``crossed``, in one pass.

    Rows: grouping_id, dimension (names, + between; null for all), the dimensions' values as strings, the metrics
    of ``accuracy``, deficit (top1 of all less that of the slice) and slice_ok (at most MAX_SLICE_DEFICIT).
    A slice without recognised positives has no top1 and passes; a null value of a dimension is a slice of its own.
    """
    named = results.select(*[c for c in results.columns if c not in dimensions], *[F.col(d).cast("string").alias(d) for d in dimensions])
    sets = [[], *[[F.col(d)] for d in dimensions], *[[F.col(d) for d in ds] for ds in crossed or ()]]
    grouped = named.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(F.grouping_id().alias("grouping_id"), *[F.grouping(d).alias(f"_{d}") for d in dimensions], *_accuracy_metrics())
    dimension = F.concat_ws("+", *[F.when(F.col(f"_{d}") == 0, F.lit(d)) for d in dimensions])
    # One row for each slice: a few, whatever the number of results.
    overall = F.max(F.when(F.col("grouping_id") == (1 << len(dimensions)) - 1, F.col("top1"))).over(Window.partitionBy())
    out = grouped.withColumns({"dimension": F.nullif(dimension, F.lit("")), "deficit": overall - F.col("top1")}).drop(*[f"_{d}" for d in dimensions])
    return out.withColumn("slice_ok", F.coalesce(F.col("deficit") <= MAX_SLICE_DEFICIT, F.lit(True)))


STATUSES = ("matched", "ambiguous", "unrecognized")


def confusion_matrix(results: DataFrame) -> DataFrame:
    """Truth by status with totals (O10): rows positive_right, positive_wrong (no or another first card), negative and total."""
    right = F.coalesce(F.col("top_card_id") == F.col("expected"), F.lit(False))
    truth = F.when(F.col("expected").isNull(), "negative").when(right, "positive_right").otherwise("positive_wrong")
    counted = results.select(truth.alias("truth"), "status").groupBy("truth").pivot("status", list(STATUSES)).agg(F.count(F.lit(1))).na.fill(0)
    summed = counted.withColumn("total", sum((F.col(s) for s in STATUSES), F.lit(0).cast("long")))
    totals = summed.agg(F.lit("total").alias("truth"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*STATUSES, "total")])
    return summed.unionByName(totals)


def latency(log: DataFrame, by: list[str], ms: str = "ms") -> DataFrame:
    """Exact p50, p95 and p99 of each group."""
    return log.groupBy(*by).agg(*[F.percentile(ms, F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)], F.count("*").alias("n"))


def latency_estimate(log: DataFrame, by: list[str], ms: str = "ms", accuracy: int = 10_000) -> DataFrame:
    """The same within 1 / accuracy of a rank, from mergeable sketches: for groups too large to sort values of."""
    return log.groupBy(*by).agg(*[F.percentile_approx(ms, q, accuracy).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)], F.count("*").alias("n"))


def gates(overall: DataFrame, slices: DataFrame, p95: DataFrame) -> DataFrame:
    """One row of booleans from the one-row overall metrics and p95, and the slices' metrics."""
    worst = slices.agg(F.min("top1").alias("worst_top1"))
    row = overall.join(p95, how="cross").join(worst, how="cross")  # three one-row sides
    return row.select(
        (F.col("false_confident") <= MAX_FALSE_CONFIDENT).alias("false_confident_ok"),
        (F.col("top1") >= MIN_TOP1).alias("top1_ok"),
        (F.col("rejection") >= MIN_REJECTION).alias("rejection_ok"),
        (F.col("p95") <= MAX_P95_MS).alias("p95_ok"),
        (F.col("top1") - F.col("worst_top1") <= MAX_SLICE_DEFICIT).alias("slices_ok"),
    )


def confusion(results: DataFrame) -> DataFrame:
    """Counts of (expected, status, whether the first card is right)."""
    right = F.coalesce(F.col("top_card_id") == F.col("expected"), F.lit(False))
    return results.groupBy(F.col("expected").isNotNull().alias("positive"), "status", right.alias("top1_right")).agg(F.count("*").alias("n"))


def exact_rates(readings: DataFrame, by: list[str]) -> DataFrame:
    """Share of exact names and numbers."""
    same = lambda a, b: F.avg(F.col(a).eqNullSafe(F.col(b)).cast("double"))
    return readings.groupBy(*by).agg(same("read_name", "true_name").alias("name_exact"), same("read_number", "true_number").alias("number_exact"), F.count("*").alias("n"))


def localization(found: DataFrame, by: list[str]) -> DataFrame:
    """Success rate and mean corner distance of found quads (O5); corners are arrays of struct<x, y>."""
    apart = F.zip_with("corners", "true_corners", lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])))
    error = F.try_divide(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x), F.size("true_corners"))
    return found.groupBy(*by).agg(F.avg(F.col("corners").isNotNull().cast("double")).alias("success"), F.avg(error).alias("corner_error"), F.count("*").alias("n"))


def operating_mix(log: DataFrame, bucket: str = "1 day") -> DataFrame:
    """Per time bucket: requests, server errors, rejected uploads, refused requests."""
    t = F.window("ts", bucket).getField("start").alias("bucket")
    share = lambda c: F.avg(c.cast("double"))
    return log.groupBy(t).agg(F.count("*").alias("n"), share(F.col("http_status") >= 500).alias("error_rate"), share(F.col("http_status") == 422).alias("rejected_rate"), F.count_if(F.col("http_status") == 429).alias("refused"))


def stage_timings(log: DataFrame) -> DataFrame:
    """Per stage: total, mean and largest time."""
    return log.groupBy("stage").agg(F.count("*").alias("n"), F.sum("ms").alias("total_ms"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms"))


def wrong_confident(feedback: DataFrame, results: DataFrame) -> DataFrame:
    """Matches that users called wrong, with the card they named."""
    said = feedback.where("NOT is_correct").select("recognition_id", "correct_card_id")
    return results.where("status = 'matched'").join(said, "recognition_id")


def split_by_group(rows: DataFrame, group: str, held_out_percent: int = 20) -> DataFrame:
    """rows with held_out, the same for all rows of a group."""
    return rows.withColumn("held_out", F.pmod(F.crc32(F.col(group).cast("string")), F.lit(100)) < held_out_percent)


def leaked_groups(rows: DataFrame, group: str) -> DataFrame:
    """Groups on both sides of a split: must be empty."""
    held, rest = rows.where("held_out").select(group).distinct(), rows.where("NOT held_out").select(group).distinct()
    return held.join(rest, group, "left_semi")
