"""The whole plan from scans to decisions, with replaceable stages (K1, K4)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import geometry
from matchloom.functions.text import all_ascii, normalize_name, normalize_number
from matchloom.operators import blocking, decision, enrichment, evidence, uploads
from matchloom.plans.options import Options
from matchloom.sources import writers
from matchloom.sources.scratch import scratch


class Validator(Protocol):
    """Uploads (mime, size, fmt, width, height, readable) to the code of the first check that fails; null where none does."""

    def __call__(self, options: Options) -> Column: ...


class Locator(Protocol):
    """Uploads (plausible, width, height, blur) to the code of why no single sharp card is found in them; null where one is."""

    def __call__(self, options: Options) -> Column: ...


class FeedbackSink(Protocol):
    """Stores valid feedback under a path; returns the rest."""

    def __call__(self, feedback: DataFrame, path: str, created_at: Column | None = None) -> DataFrame: ...


class Reader(Protocol):
    """Raw scans to scans with obs_name, obs_number and ocr_quality."""

    def __call__(self, scans: DataFrame) -> DataFrame: ...


class Blocker(Protocol):
    """Scans and catalog to bounded candidates."""

    def __call__(self, scans: DataFrame, catalog: DataFrame, limit: int) -> DataFrame: ...


class Scorer(Protocol):
    """Candidates, scans and catalog to evidence with confidence."""

    def __call__(self, candidates: DataFrame, scans: DataFrame, catalog: DataFrame) -> DataFrame: ...


class Pricer(Protocol):
    """Rows with card_id to rows with price columns."""

    def __call__(self, rows: DataFrame, prices: DataFrame) -> DataFrame: ...


def read_keys(scans: DataFrame) -> DataFrame:
    """Comparable keys from observed texts; Python takes part only where some text is beyond ASCII."""
    plain = all_ascii(scans, "raw_name", "raw_number")
    return scans.withColumn("obs_name", normalize_name(F.col("raw_name"), plain)).withColumn("obs_number", normalize_number(F.col("raw_number"), plain))


def checked(options: Options) -> Column:
    return uploads.upload_code(*[F.col(c) for c in ("mime", "size", "fmt", "width", "height", "readable")], options)


def located(options: Options) -> Column:
    return uploads.location_code(F.col("plausible"), geometry.whole_image_is_card(F.col("width"), F.col("height")), F.col("blur"), options)


def written(df: DataFrame) -> DataFrame:
    """df, made once however often it is used: written to the shared folder and read from there.

    Nothing stays in the session's cache, and what executors hold may be lost.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "kept")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Engine:
    """Stages of a recognition; any may be replaced.

    ``keep`` holds on to the two frames that a plan reads several times: scans with their keys, whose
    Unicode forms come from Python, and ranked candidates.  It may be the identity, which makes them anew each time.
    """

    options: Options = field(default_factory=Options)
    validator: Validator = checked
    locator: Locator = located
    reader: Reader = read_keys
    blocker: Blocker = blocking.block
    scorer: Scorer = evidence.gather
    pricer: Pricer = enrichment.with_prices
    feedback: FeedbackSink = writers.append_feedback
    keep: Callable[[DataFrame], DataFrame] = written

    def intake(self, received: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Uploads that may be read, and error rows (http_status, code, detail) of the others.

        Validation comes first; what fails it is not located.  One bad upload costs its row and not the batch.
        """
        code = F.coalesce(self.validator(self.options), self.locator(self.options))
        judged = received.withColumn("code", code)
        refused = decision.error_rows(judged.withColumn("detail", F.col("code")))
        return judged.where("code IS NULL").drop("code"), refused

    def read(self, scans: DataFrame) -> DataFrame:
        """Raw scans with their keys."""
        return self.reader(scans)

    def ranked(self, scans: DataFrame, catalog: DataFrame) -> DataFrame:
        """Candidates of raw scans with scores, rank and runner_up."""
        read = self.keep(self.read(scans))
        candidates = self.blocker(read, catalog, self.options.candidate_limit)
        return self.keep(decision.rank(self.scorer(candidates, read, catalog)))

    def recognize(self, scans: DataFrame, catalog: DataFrame, prices: DataFrame) -> DataFrame:
        """One row per scan: status, confidence, card_id and its price where matched, message."""
        decided = decision.decide(scans, self.ranked(scans, catalog), self.options.thresholds)
        return self.pricer(decided, prices)

    def responses(self, scans: DataFrame, catalog: DataFrame, prices: DataFrame) -> DataFrame:
        """Nested results with the first candidates of every scan."""
        ranked = self.ranked(scans, catalog)
        return enrichment.responses(decision.decide(scans, ranked, self.options.thresholds), ranked, catalog, prices, self.options.priced_limit)
