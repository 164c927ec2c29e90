"""Output: DDL, all-or-nothing imports, results and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators.catalog import require_valid, upsert_cards, upsert_prices
from matchloom.operators.uploads import feedback_valid
from matchloom.sources import schemas, versions
from matchloom.sources.readers import catalog_rows

#: Tables that are appended to as they are; all others change by commits.
APPENDED = ("recognition_feedback", "request_log")


def create_tables(spark: SparkSession, path: str) -> None:
    """Empty tables where there are none: one commit for all versioned ones."""
    for name in APPENDED:
        spark.createDataFrame([], schemas.TABLES[name]).write.mode("ignore").parquet(f"{path}/{name}")
    base = versions.snapshot(spark, path)
    missing = [t for t in schemas.TABLES if t not in APPENDED and t not in base.tables]
    if missing:
        versions.commit(spark, path, base, {t: versions.write(spark.createDataFrame([], schemas.TABLES[t]), path, t) for t in missing})


def import_catalog(records: DataFrame, path: str, as_of: Column, dimensions: int | None = None) -> versions.Snapshot:
    """Validate records, then upsert cards and prices in one commit; nothing changes if any rule is broken or any step fails.

    Both tables are read at one state; a writer that commits meanwhile makes this one fail with CommitConflictError.
    """
    require_valid(records, dimensions)
    spark, rows = records.sparkSession, catalog_rows(records)
    base = versions.snapshot(spark, path)
    cards = upsert_cards(versions.read(spark, path, "cards", base), rows.drop("price"))
    prices = upsert_prices(versions.read(spark, path, "card_prices", base), rows, as_of)
    changed = {"card_prices": _rewritten(prices, path, "card_prices", base), "cards": _rewritten(cards, path, "cards", base)}
    return versions.commit(spark, path, base, changed)


def _rewritten(df: DataFrame, path: str, table: str, base: versions.Snapshot) -> dict[str, str]:
    """A whole table written anew, in buckets where it has them."""
    if table in base.buckets:
        return versions.write_buckets(df, path, table, schemas.KEYS[table], base.buckets[table], base.buckets[table])
    return versions.write(df, path, table)


def append_once(rows: DataFrame, path: str, table: str) -> versions.Snapshot:
    """Add rows whose key the table does not hold yet, of equal keys one; adding the same rows again changes nothing."""
    spark, key = rows.sparkSession, schemas.KEYS[table]
    base = versions.snapshot(spark, path)
    new = rows.dropDuplicates([key]).join(versions.read(spark, path, table, base).select(key), key, "left_anti")
    held = base.tables.get(table, {})
    part = versions.write(new.select(*spark.createDataFrame([], schemas.TABLES[table]).columns), path, table)
    return versions.commit(spark, path, base, {table: {**held, f"{base.number + 1:012}": part[versions.WHOLE]}})


def append_feedback(feedback: DataFrame, path: str, created_at: Column | None = None) -> DataFrame:
    """Append valid rows; returns the invalid ones."""
    checked = feedback_valid(feedback)
    stamped = checked.where("valid").drop("valid").withColumn("created_at", created_at if created_at is not None else F.current_timestamp())
    stamped.write.mode("append").parquet(f"{path}/recognition_feedback")
    return checked.where("NOT valid").drop("valid")
