"""Text keys, similarities, vectors and display formats, one row for each fact."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.functions import display, geometry, text, vectors
from matchloom.operators import decision, evidence
from matchloom.plans.options import Options, Thresholds, Weights


def one(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_names(spark):
    given_rows = [("  Falcon V MAX ",), ("Otter E X",), ("ﬁne 0ak",), ("a%b_c",), ("STRASSE ß",), ("  ",), (None,), ("É clair!?",), ("Heron V  star",), ("Z G x",)]
    assert one(spark, text.normalize_name(F.col("x")), given_rows, "x string") == ["falcon vmax", "otter ex", "fine oak", "a b_c", "strasse ss", None, None, "é clair", "heron vstar", "z gx"]


def test_numbers(spark):
    rows = [(" 006 / 165 ",), ("SV107|SV122",), ("not a number",), ("57I182",), ("57 I 182",), ("TG05/TG30",), ("A 12",), ("000",), (None,), ("",), ("x0y",)]
    assert one(spark, text.normalize_number(F.col("x")), rows, "x string") == ["6", "SV107", None, "57I", "57", "TG05", "12", "0", None, None, "X0Y"]


def test_similarities(spark):
    rows = [("6", "006"), ("6", "60"), ("6", "151"), (None, "1"), ("", "1"), ("sv1", "SV1"), ("0", "5")]
    assert one(spark, text.collector_similarity(F.col("a"), F.col("b")), rows, "a string, b string") == [1.0, 0.72, 0.0, 0.0, 0.0, 1.0, 0.0]
    rows = [("dragon ex", "dragon ex"), ("dragon", "dragon ex"), (None, "x"), ("", "x"), ("a a b", "a b"), ("a", "")]
    assert one(spark, text.name_similarity(F.col("a"), F.col("b")), rows, "a string, b string") == [1.0, 0.5, 0.0, 0.0, 1.0, 0.0]


def test_score_and_margin(spark):
    s = evidence.score(F.col("n"), F.col("m"), F.col("a"), F.col("q"), Weights())
    low, high, edge, under = one(spark, s, [(1.0, 1.0, 0.0, 1.0), (1.0, 1.0, 0.95, 1.0), (1.0, 1.0, 0.5262, 1.0), (1.0, 1.0, 0.526, 1.0)], "n double, m double, a double, q double")
    assert low < 0.82 <= high and edge >= 0.82 > under
    t = Thresholds(0.8, 0.55, 0.08)
    rows = [(0.9, 0.86), (0.9, 0.7), (0.4, 0.0), (None, None), (0.98, 0.9)]
    assert one(spark, decision.status(F.col("a"), F.col("b"), t), rows, "a double, b double") == ["ambiguous", "matched", "unrecognized", "unrecognized", "ambiguous"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(*[st.floats(0, 1)] * 4), min_size=5, max_size=20))
def test_score_is_bounded_and_grows(spark, rows):
    s = evidence.score(F.col("n"), F.col("m"), F.col("a"), F.col("q"), Weights())
    more = evidence.score(F.least(F.col("n") + 0.1, F.lit(1.0)), F.col("m"), F.col("a"), F.col("q"), Weights())
    for r in spark.createDataFrame(rows, "n double, m double, a double, q double").select(s.alias("s"), more.alias("t")).collect():
        assert 0 <= r.s <= r.t <= 1


def test_cosine_guards(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), (None, [1.0]), ([1.0], None), ([1.0], [1.0, 2.0]), ([0.0], [1.0])]
    assert one(spark, vectors.cosine_score(F.col("a"), F.col("b")), rows, "a array<double>, b array<double>") == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_vector_codec(spark):
    df = spark.createDataFrame([([1.5, -2.0],), ([],), (None,)], "v array<double>").select(vectors.encode_floats(vectors.as_floats(F.col("v"))).alias("b"))
    got = df.select("b", vectors.decode_floats("b").alias("v")).collect()
    assert bytes(got[0].b).hex() == "0000c03f000000c0" and got[0].v == [1.5, -2.0]
    assert got[1].b is None and got[2].v is None


def test_softmax_and_argmax(spark):
    row = spark.createDataFrame([([1.0, 3.0, 3.0],)], "v array<double>").select(vectors.argmax(F.col("v")).alias("i"), vectors.softmax(F.col("v")).alias("p")).first()
    assert row.i == 1 and sum(row.p) == pytest.approx(1) and row.p[1] == row.p[2]


def test_formats(spark):
    assert one(spark, display.format_usd(F.col("x")), [(1234.5,), (-0.125,), (None,), (0.0,), (2.675,)], "x double") == ["$1,234.50", "-$0.13", "Price unavailable", "$0.00", "$2.68"]
    assert one(spark, display.format_number(F.col("a"), F.col("b")), [("6", "165"), ("6", None), ("6", "")], "a string, b string") == ["6/165", "6", "6"]
    assert one(spark, display.percent(F.col("x")), [(0.825,), (0.005,), (1.0,)], "x double") == [83, 1, 100]
    assert one(spark, display.percent_decode(F.col("x")), [("a%20b+c",), ("%zz",), (None,)], "x string") == ["a b+c", None, None]
    assert one(spark, display.percent_encode(F.col("x")), [("a b+c",)], "x string") == ["a%20b%2Bc"]
    paths = [("/a?b=c#d",), ("//evil",), ("http://x",), (None,), ("/signin",), ("",)]
    assert one(spark, display.safe_path(F.col("x"), ("/signin",)), paths, "x string") == ["/a?b=c#d", "/", "/", "/", "/", "/"]
    names = [("A%20B", True, "e@x"), ("A%20B", False, "e@x"), ("%zz", True, "e@x"), ("A", False, None)]
    assert one(spark, display.display_name(F.col("n"), F.col("e"), F.col("m")), names, "n string, e boolean, m string") == ["A B", "A%20B", "e@x", None]


def test_corners(spark):
    row = [([(9.0, 1.0), (1.0, 1.0), (1.0, 11.0), (9.0, 11.0)],)]
    df = spark.createDataFrame(row, "p array<struct<x: double, y: double>>")
    got = df.select(geometry.ordered_corners(F.col("p")).alias("c"), geometry.area(F.col("p")).alias("a"), geometry.is_convex(F.col("p")).alias("v"), geometry.side_ratio(geometry.ordered_corners(F.col("p"))).alias("r"), geometry.plausible(F.col("p"), F.lit(100.0)).alias("ok"), geometry.plausible(F.col("p"), F.lit(1000.0)).alias("small")).first()
    assert [(c.x, c.y) for c in got.c] == [(1, 1), (9, 1), (9, 11), (1, 11)]
    assert (got.a, got.v, got.ok, got.small) == (80.0, True, True, False) and got.r == pytest.approx(0.8)


def test_options_from_environment():
    assert Options.from_env("X_", {"X_RATE_LIMIT": "5", "X_OTHER": "1"}).rate_limit == 5
    assert Options.from_env("X_", {}) == Options()
