"""Evidence and scores of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import clamp, collector_similarity, name_similarity
from matchloom.functions.vectors import cosine_score, doubles, norm
from matchloom.plans.options import Weights


def ocr_quality(name_confidence: Column, number_confidence: Column) -> Column:
    return clamp((name_confidence + number_confidence) / 2)


def score(number: Column, name: Column, artwork: Column, quality: Column, w: Weights) -> Column:
    """Bounded score, rounded to four digits before any comparison."""
    text = F.lit(w.number) * number + F.lit(w.name) * name
    return F.round(clamp((F.lit(w.text) * text + F.lit(w.artwork) * artwork) * (F.lit(w.base) + F.lit(w.ocr) * quality)), 4)


def gather(candidates: DataFrame, scans: DataFrame, catalog: DataFrame, weights: Weights | None = None) -> DataFrame:
    """One row per candidate with its four scores and confidence.

    Vectors are joined after blocking, so only bounded candidates carry them.
    """
    vector = doubles(F.col("embedding"))
    # Lengths are made once for each vector and not for each pair.
    seen = scans.select("scan_id", "obs_name", "obs_number", "ocr_quality", vector.alias("scan_vec"), norm(vector).alias("scan_norm"))
    cards = catalog.select("card_id", "normalized_name", "collector_number", vector.alias("card_vec"), norm(vector).alias("card_norm"))
    joined = candidates.join(seen, "scan_id").join(cards, "card_id")
    scored = joined.select(
        "scan_id",
        "card_id",
        "retrieval_rank",
        collector_similarity(F.col("obs_number"), F.col("collector_number")).alias("number_score"),
        name_similarity(F.col("obs_name"), F.col("normalized_name")).alias("name_score"),
        cosine_score(F.col("scan_vec"), F.col("card_vec"), F.col("scan_norm") * F.col("card_norm")).alias("artwork_score"),
        "ocr_quality",
    )
    return scored.withColumn("confidence", score(F.col("number_score"), F.col("name_score"), F.col("artwork_score"), F.col("ocr_quality"), weights or Weights()))
