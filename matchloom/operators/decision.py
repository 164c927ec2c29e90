"""Ranking and the margin-based decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.plans.options import Thresholds

# Messages and codes that results depend on.
MESSAGES = {
    "ambiguous": "We found close matches, but the evidence is not strong enough to choose safely.",
    "unrecognized": "We could not identify this card confidently. Try even light and keep every edge visible.",
}
ERROR_STATUS = 422
ERROR_CODES = ("recognition_failed", "invalid_image", "image_too_large", "image_too_blurry", "card_not_found", "multiple_cards", "recognition_unavailable")


def rank(evidence: DataFrame) -> DataFrame:
    """rank by confidence, ties in retrieval order; runner_up is the next confidence, 0 if there is none."""
    order = Window.partitionBy("scan_id").orderBy(F.desc("confidence"), "retrieval_rank")
    return evidence.withColumn("rank", F.row_number().over(order)).withColumn("runner_up", F.lead("confidence", 1, 0.0).over(order))


def status(top: Column, runner_up: Column, t: Thresholds) -> Column:
    unrecognized = top.isNull() | (top < t.ambiguous)
    matched = (top >= t.matched) & (top - runner_up >= t.minimum_margin)
    return F.when(unrecognized, "unrecognized").when(matched, "matched").otherwise("ambiguous")


def message(decided: Column) -> Column:
    """What the user is told; null for a match."""
    out = F.lit(None).cast("string")
    for k, text in MESSAGES.items():
        out = F.when(decided == k, text).otherwise(out)
    return out


def decide(scans: DataFrame, ranked: DataFrame, thresholds: Thresholds | None = None) -> DataFrame:
    """One row per scan, also for scans without candidates: status, confidence, card_id if matched, message."""
    t = thresholds or Thresholds()
    top = ranked.where("rank = 1").select("scan_id", F.col("card_id").alias("top_card_id"), "confidence", "runner_up")
    joined = scans.select("scan_id").join(top, "scan_id", "left").withColumn("status", status(F.col("confidence"), F.col("runner_up"), t))
    return joined.select(
        "scan_id",
        "status",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.when(F.col("status") == "matched", F.col("top_card_id")).alias("card_id"),
        "top_card_id",
        message(F.col("status")).alias("message"),
    )


def error_rows(results: DataFrame, code: str = "code", detail: str = "detail") -> DataFrame:
    """Failures as rows: http_status, code (unknown ones as the general one), detail."""
    known = F.when(F.col(code).isin(*ERROR_CODES), F.col(code)).otherwise(ERROR_CODES[0])
    return results.where(F.col(code).isNotNull()).select("*", F.lit(ERROR_STATUS).alias("http_status")).withColumn("code", known).withColumn("detail", F.col(detail))
