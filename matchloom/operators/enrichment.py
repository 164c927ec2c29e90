"""Prices and response shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.display import name_uuid

CARD_FIELDS = ("card_id", "name", "set_name", "collector_number", "printed_total", "rarity", "language", "image_url", "marketplace_url")


def unexpired(updated_at: Column, as_of: Column, ttl_days: int | None) -> Column:
    """Whether a cached price still counts; without a time to live every price does."""
    return F.lit(True) if ttl_days is None else updated_at >= as_of - F.make_dt_interval(F.lit(ttl_days))


def with_prices(cards: DataFrame, prices: DataFrame, ttl_days: int | None = None, as_of: Column | None = None) -> DataFrame:
    """Rows with card_id left-joined to their price: amount (null on a miss), currency, source, updated_at."""
    p = prices.select(F.col("card_id"), "amount", F.col("currency").alias("_currency"), "source", "updated_at")
    if ttl_days is not None:
        p = p.where(unexpired(F.col("updated_at"), as_of if as_of is not None else F.current_timestamp(), ttl_days))
    return cards.join(p, "card_id", "left").withColumn("currency", F.coalesce("_currency", F.lit("USD"))).drop("_currency")


def price_struct() -> Column:
    return F.struct("amount", "currency", "source", "updated_at")


def card_struct() -> Column:
    """A card as callers see it, with its price and without inner keys."""
    return F.struct(*CARD_FIELDS, price_struct().alias("price"))


def lookup(catalog: DataFrame, prices: DataFrame, card_id: str) -> DataFrame:
    """One card with its price; no row where there is no such card."""
    return with_prices(catalog.where(F.col("card_id") == card_id).limit(1), prices)


def top_priced(ranked: DataFrame, prices: DataFrame, limit: int = 3) -> DataFrame:
    """The best candidates of each scan with prices: one join for all."""
    return with_prices(ranked.where(F.col("rank") <= limit), prices)


def responses(decisions: DataFrame, ranked: DataFrame, catalog: DataFrame, prices: DataFrame, limit: int = 3) -> DataFrame:
    """Nested results: scan_id, status, confidence, card, candidates (best first, for every status), message."""
    described = with_prices(ranked.where(F.col("rank") <= limit).select("scan_id", "card_id", "rank", "confidence").join(catalog, "card_id"), prices)
    each = described.select("scan_id", "rank", F.struct(card_struct().alias("card"), F.col("confidence")).alias("candidate"))
    listed = each.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate"))).alias("r"))
    found = decisions.join(listed, "scan_id", "left")
    candidates = F.coalesce(F.transform("r", lambda x: x["candidate"]), F.array())
    return found.select("scan_id", "status", "confidence", F.when(F.col("status") == "matched", F.get(candidates, F.lit(0))["card"]).alias("card"), candidates.alias("candidates"), "message")


def identified(results: DataFrame, timings: DataFrame, created_at: Column) -> DataFrame:
    """results (scan_id, others) with recognition_id, processing_ms and created_at.

    The id follows from the scan and the time of its run, so that running the same scans again makes the same ids.
    processing_ms is the sum of the scan's stages in timings (scan_id, stage, ms), rounded to two digits; 0 without any.
    """
    spent = timings.groupBy("scan_id").agg(F.round(F.sum("ms"), 2).alias("processing_ms"))
    dated = results.join(spent, "scan_id", "left").withColumn("processing_ms", F.coalesce("processing_ms", F.lit(0.0)))
    return dated.withColumns({"created_at": created_at, "recognition_id": name_uuid(F.col("scan_id"), F.unix_micros(created_at))})


def wire(identified_responses: DataFrame) -> DataFrame:
    """Responses with their identity as (scan_id, response): JSON text with every field, null ones too, times in ISO form."""
    fields = ["recognition_id", "status", "card", "confidence", "candidates", "processing_ms", "message"]
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX", "timeZone": "UTC"}
    return identified_responses.select("scan_id", F.to_json(F.struct(*fields), options).alias("response"))
