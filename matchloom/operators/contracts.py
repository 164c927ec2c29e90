"""Contracts of JSON input: parse, fill in defaults, and set aside what breaks a rule."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CORRUPT = "_corrupt"
URL = r"^https?://[^\s/?#]+\S*$"
STATUSES = ("matched", "ambiguous", "unrecognized")


@dataclass(frozen=True)
class Contract:
    """Fields of a JSON object, values for absent or null ones, and rules in the order in which they are tried.

    A rule is (name, condition of the fields); it is broken where its condition is false or null.  Text that is
    no JSON object, or holds a value of another type than its field, breaks ``unreadable``.
    """

    fields: str
    required: tuple[str, ...] = ()
    defaults: Mapping[str, Callable[[], Column]] = field(default_factory=dict)
    rules: tuple[tuple[str, Callable[[], Column]], ...] = ()

    def shape(self) -> StructType:
        return StructType.fromDDL(self.fields)


def parsed(df: DataFrame, text: str, contract: Contract) -> DataFrame:
    """df with the contract's fields and ``broken``: the first broken rule, null where all hold."""
    shape = contract.shape()
    read = F.from_json(F.col(text), f"{contract.fields}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    held = df.withColumn("_read", read)
    fields = {n: F.coalesce(F.col(f"_read.{n}"), contract.defaults[n]()) if n in contract.defaults else F.col(f"_read.{n}") for n in shape.names}
    unreadable = F.col("_read").isNull() | F.col(f"_read.{CORRUPT}").isNotNull() | ~F.coalesce(F.col(text), F.lit("")).rlike(r"^\s*\{")
    out = held.withColumns(fields).withColumn("_unreadable", unreadable)
    broken = F.when(F.col("_unreadable"), "unreadable")
    for name in contract.required:
        broken = broken.when(F.col(name).isNull(), f"missing_{name}")
    for name, holds in contract.rules:
        broken = broken.when(~F.coalesce(holds(), F.lit(False)), name)
    return out.withColumn("broken", broken).drop("_read", "_unreadable")


def quarantined(df: DataFrame, text: str, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """What keeps the contract, with its fields, and what does not: the input's columns and ``broken``."""
    read = parsed(df, text, contract)
    return read.where("broken IS NULL").drop("broken", text), read.where("broken IS NOT NULL").select(*df.columns, "broken")


#: Lines of the request log.
REQUEST_LINE = Contract(
    "request_id string, method string, path string, status int, total_ms double",
    required=("request_id", "method", "path", "status", "total_ms"),
    rules=(
        ("long_request_id", lambda: F.length("request_id") <= 80),
        ("bad_status", lambda: F.col("status").between(100, 599)),
        ("bad_total_ms", lambda: F.col("total_ms") >= 0),
    ),
)

_PRICE = "price: struct<amount: double, currency: string, source: string, updated_at: string>"
_CARD = f"struct<id: string, name: string, set_name: string, collector_number: string, printed_total: string, rarity: string, language: string, image_url: string, marketplace_url: string, {_PRICE}>"
_CARD_NEEDS = ("id", "name", "set_name", "collector_number", "language", "image_url", "marketplace_url", "price")


def _card_holds(card: Column) -> Column:
    good = F.lit(True)
    for name in _CARD_NEEDS:
        good = good & card[name].isNotNull()
    return good & card["image_url"].rlike(URL) & card["marketplace_url"].rlike(URL)


#: Recognition responses as callers get them.
RESPONSE = Contract(
    f"recognition_id string, status string, card {_CARD}, confidence double, candidates array<struct<card: {_CARD}, confidence: double>>, processing_ms double, message string",
    required=("recognition_id", "status", "confidence", "processing_ms"),
    defaults={"candidates": F.array},
    rules=(
        ("bad_status", lambda: F.col("status").isin(*STATUSES)),
        ("bad_confidence", lambda: F.col("confidence").between(0, 1)),
        ("bad_processing_ms", lambda: F.col("processing_ms") >= 0),
        ("bad_card", lambda: F.col("card").isNull() | _card_holds(F.col("card"))),
        ("bad_candidate", lambda: F.forall("candidates", lambda c: c["confidence"].between(0, 1) & _card_holds(c["card"]))),
    ),
)


def currency_filled(card: Column) -> Column:
    """A card whose price has a currency, the default where the input had none."""
    price = card["price"].withField("currency", F.coalesce(card["price"]["currency"], F.lit("USD")))
    return F.when(card.isNotNull(), card.withField("price", price))
