"""Upload checks in order, card-shape checks, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.plans.options import Options

# Accepted types and formats.
MIME_TYPES = ("image/jpeg", "image/png", "image/webp", "image/heic", "image/heif")
FORMATS = ("JPEG", "PNG", "WEBP", "HEIC", "HEIF")


def sniffed_format(head: Column) -> Column:
    """Format by the first bytes of a file; null for none of FORMATS."""
    h = F.hex(F.substring(head, 1, 12))
    brand = F.substring(head, 9, 4).cast("string")
    is_box = F.substring(head, 5, 4).cast("string") == "ftyp"
    return (
        F.when(h.startswith("FFD8FF"), "JPEG")
        .when(h.startswith("89504E470D0A1A0A"), "PNG")
        .when(h.startswith("52494646") & h.endswith("57454250"), "WEBP")
        .when(is_box & brand.isin("heic", "heix", "hevc"), "HEIC")
        .when(is_box & brand.isin("mif1", "msf1"), "HEIF")
    )


def upload_code(mime: Column, size: Column, fmt: Column, width: Column, height: Column, readable: Column, o: Options) -> Column:
    """Error code of the first failing check; null for a good upload."""
    return (
        F.when((F.coalesce(size, F.lit(0)) == 0) | ~F.coalesce(F.lower(mime).isin(*MIME_TYPES), F.lit(False)), "invalid_image")
        .when(size > o.max_upload_bytes, "image_too_large")
        .when(~F.coalesce(fmt.isin(*FORMATS), F.lit(False)), "invalid_image")
        .when((width < o.min_image_side) | (height < o.min_image_side), "invalid_image")
        .when(width.cast("long") * height > o.max_image_pixels, "image_too_large")
        .when(~F.coalesce(readable, F.lit(False)), "invalid_image")
    )


def client_code(mime: Column, size: Column, o: Options) -> Column:
    """The two checks made before sending."""
    return F.when(~F.coalesce(mime.startswith("image/"), F.lit(False)), "invalid_image").when(size > o.max_upload_bytes, "image_too_large")


def location_code(n_plausible: Column, whole_image: Column, blur_variance: Column, o: Options) -> Column:
    """Error code of locating one sharp card: several, none, or too blurry; null if found."""
    return (
        F.when(n_plausible > 1, "multiple_cards")
        .when((n_plausible == 0) & ~whole_image, "card_not_found")
        .when(blur_variance < o.min_blur_variance, "image_too_blurry")
    )


def feedback_valid(df: DataFrame) -> DataFrame:
    """df with valid: recognition_id of 36 characters, ids of at most 64, a given answer."""
    ids = [F.coalesce(F.length(c), F.lit(0)) <= 64 for c in ("predicted_card_id", "correct_card_id")]
    good = (F.length("recognition_id") == 36) & ids[0] & ids[1] & F.col("is_correct").isNotNull()
    return df.withColumn("valid", F.coalesce(good, F.lit(False)))


def result_in_range(confidence: Column, processing_ms: Column, decided: Column) -> Column:
    """Whether a result keeps its contract."""
    good = confidence.between(0, 1) & (processing_ms >= 0) & decided.isin("matched", "ambiguous", "unrecognized")
    return F.coalesce(good, F.lit(False))


def readiness(checks: DataFrame, database_ready: bool) -> DataFrame:
    """checks (artifact, present) to one row: status, database, models."""
    models = F.when(F.coalesce(F.bool_and("present"), F.lit(False)), "ready").otherwise("artifacts_required")
    return checks.agg(F.lit("ready" if database_ready else "degraded").alias("status"), F.lit("ready" if database_ready else "unavailable").alias("database"), models.alias("models"))
