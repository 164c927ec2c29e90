"""Text keys and their similarities as Column expressions.

NFKC and case folding have no built-in; an Arrow UDF does them, and only for strings with
a character outside ASCII: all others reach it as null and keep their built-in form.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns, replacements and scores that results depend on.
NUMBER_PATTERN = r"([A-Z]*\d+[A-Z]*)\s*(?:[/|I]\s*(\d+))?"
NAME_SUFFIXES = ((r"\bV\s*MAX\b", "VMAX"), (r"\bV\s*STAR\b", "VSTAR"), (r"\bG\s*X\b", "GX"), (r"\bE\s*X\b", "ex"))
NAME_NOISE = r"[^\w\s.'-]"
PARTIAL_NUMBER_SCORE = 0.72


@F.pandas_udf(StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


@F.pandas_udf(StringType())
def _casefold(x: pd.Series) -> pd.Series:
    return x.map(str.casefold, na_action="ignore")


def _beyond_ascii(x: Column) -> Column:
    return F.when(x.rlike(r"[^\x00-\x7F]"), x)


def all_ascii(df: DataFrame, *columns: str) -> bool:
    """Whether no value of the columns has a character beyond ASCII: a look at these columns alone, which ends at the first that has."""
    odd = F.lit(False)
    for c in columns:
        odd = odd | F.coalesce(F.col(c).rlike(r"[^\x00-\x7F]"), F.lit(False))
    return df.select(*columns).where(odd).isEmpty()


def nfkc(x: Column) -> Column:
    """Unicode NFKC form."""
    return F.coalesce(_nfkc(_beyond_ascii(x)), x)


def casefold(x: Column) -> Column:
    """Full case folding."""
    return F.coalesce(_casefold(_beyond_ascii(x)), F.lower(x))


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalize_name(raw: Column, ascii_only: bool = False) -> Column:
    """Comparable form of an observed name (I8); null where nothing is left.

    ``ascii_only`` promises that no name is beyond ASCII, where lower case is all that the Unicode forms do.
    """
    x = F.translate(strip(raw if ascii_only else nfkc(raw)), "0", "O")
    x = F.regexp_replace(x, "(?U)" + NAME_NOISE, " ")
    for pattern, replacement in NAME_SUFFIXES:
        x = F.regexp_replace(x, "(?iU)" + pattern, replacement)
    x = strip(F.regexp_replace(x, r"(?U)\s+", " "))
    return F.nullif(F.lower(x) if ascii_only else casefold(x), F.lit(""))


def _without_zeros(x: Column) -> Column:
    return F.ltrim(x, F.lit("0"))


def normalize_number(raw: Column, ascii_only: bool = False) -> Column:
    """Comparable form of a collector number (I9): the first number's own part, no leading zeros; null without one."""
    found = F.nullif(F.regexp_extract(F.upper(raw if ascii_only else nfkc(raw)), NUMBER_PATTERN, 1), F.lit(""))
    return F.when(found.isNotNull(), F.coalesce(F.nullif(_without_zeros(found), F.lit("")), F.lit("0")))


def collector_similarity(observed: Column, expected: Column) -> Column:
    """1 for equal numbers, PARTIAL_NUMBER_SCORE where one holds the other, else 0."""
    a, b = _without_zeros(F.lower(observed)), _without_zeros(F.lower(expected))
    partial = (a != "") & (b != "") & (a.contains(b) | b.contains(a))
    score = F.when(a == b, 1.0).when(partial, PARTIAL_NUMBER_SCORE).otherwise(0.0)
    return F.when(F.coalesce(observed, F.lit("")) == "", 0.0).otherwise(score)


def tokens(x: Column) -> Column:
    """Distinct words (H1)."""
    return F.array_distinct(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != ""))


def name_similarity(observed: Column, expected: Column) -> Column:
    """Share of the larger word set that both names have."""
    a, b = tokens(observed), tokens(expected)
    most = F.greatest(F.size(a), F.size(b))
    overlap = F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / most)
    return F.when(F.coalesce(observed, F.lit("")) == "", 0.0).when(observed == expected, 1.0).otherwise(overlap)


def clamp(x: Column) -> Column:
    """Into 0 to 1 (I13); null stays null, which greatest and least would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
