"""What each endpoint of the service answers, for many callers at once.

Every function takes the ids or rows of all requests as a DataFrame and returns one row for each that has an answer;
a request without one (an unknown card) has no row, as the service answers 404.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from matchloom.operators import enrichment, uploads
from matchloom.plans.engine import Engine
from matchloom.sources import writers


def recognitions(engine: Engine, scans: DataFrame, catalog: DataFrame, prices: DataFrame, timings: DataFrame, at: Column) -> DataFrame:
    """POST /recognitions: responses with identity and the time their stages took."""
    return enrichment.identified(engine.responses(scans, catalog, prices), timings, at)


def cards(requests: DataFrame, catalog: DataFrame, prices: DataFrame) -> DataFrame:
    """GET /cards/{id}: requests (request_id, card_id) with the card and its price."""
    known = enrichment.with_prices(requests.join(catalog, "card_id"), prices)
    return known.select("request_id", enrichment.card_struct().alias("card"))


def prices_of(requests: DataFrame, catalog: DataFrame, prices: DataFrame) -> DataFrame:
    """GET /prices/{id}: requests (request_id, card_id) with the price of a known card, its amount null where none is cached."""
    known = requests.join(catalog.select("card_id"), "card_id", "left_semi")
    return enrichment.with_prices(known, prices).select("request_id", "card_id", enrichment.price_struct().alias("price"))


def feedback(rows: DataFrame, path: str, at: Column | None = None) -> DataFrame:
    """POST /feedback: valid rows are stored; the refused ones come back."""
    return writers.append_feedback(rows, path, at)


def health(artifacts: DataFrame) -> DataFrame:
    """GET /health: whether the database answers and every artifact (artifact, present) is there."""
    return uploads.readiness(artifacts, artifacts.sparkSession.sql("SELECT 1").first()[0] == 1)
