"""Versioned tables, refreshes, as-of joins, coverage, outages, contracts and contours against plain versions."""

from __future__ import annotations

import json
import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.functions import display, geometry
from matchloom.operators import admission, asof, contracts, coverage, enrichment, quality
from matchloom.operators.catalog import InvalidCatalogError
from matchloom.plans import endpoints
from matchloom.plans.engine import Engine
from matchloom.sources import readers, schemas, versions, writers
from matchloom.streaming import refresh
from matchloom.streaming.admission import admit_stream
from matchloom.streaming.refresh import apply_prices, bucket_prices, refresh_prices

AS_OF = datetime(2024, 5, 1)
PRICE = "card_id string, amount double, currency string, source string, updated_at timestamp"


def as_of():
    return F.lit("2024-05-01 00:00:00").cast("timestamp")


def record(k, **more):
    return {"id": k, "name": k, "normalized_name": k, "collector_number": "1", "set_name": "s", "reference_image_url": "https://x.invalid/a", "marketplace_id": f"m{k}", "marketplace_url": "https://x.invalid/b", **more}


def records(spark, tmp_path, *rows):
    path = tmp_path / f"{random.random()}.json"
    path.write_text(json.dumps(list(rows)))
    return readers.catalog_json(spark, str(path))


def held(spark, path):
    cards = {r.card_id: r.name for r in readers.stored(spark, path, "cards").collect()}
    prices = {r.card_id: r.amount for r in readers.stored(spark, path, "card_prices").collect()}
    return cards, prices


# Commits


@pytest.mark.parametrize("step", ["first table", "second table", "pointer", "after"])
def test_a_crash_leaves_the_old_pair_or_the_new_one(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "db")
    writers.create_tables(spark, path)
    writers.import_catalog(records(spark, tmp_path, record("a", name="old", price={"amount": 1.0})), path, as_of())
    old, new = ({"a": "old"}, {"a": 1.0}), ({"a": "new", "b": "b"}, {"a": 2.0, "b": 3.0})
    changed = records(spark, tmp_path, record("a", name="new", price={"amount": 2.0}), record("b", price={"amount": 3.0}))
    write, publish, done = versions.write, versions.publish, []

    def dying_write(df, where, table):
        done.append(table)
        if step == ("first table" if len(done) == 1 else "second table"):
            raise OSError(step)
        return write(df, where, table)

    def dying_publish(*args):
        if step == "pointer":
            raise OSError(step)
        publish(*args)
        if step == "after":
            raise OSError(step)

    monkeypatch.setattr(versions, "write", dying_write)
    monkeypatch.setattr(versions, "publish", dying_publish)
    with pytest.raises(OSError, match=step):
        writers.import_catalog(changed, path, as_of())
    monkeypatch.undo()
    assert held(spark, path) == (new if step == "after" else old)
    # What died left no harm: the same import succeeds afterwards.
    writers.import_catalog(changed, path, as_of())
    assert held(spark, path) == new


def test_a_second_writer_is_refused(spark, tmp_path):
    path = str(tmp_path / "db")
    writers.create_tables(spark, path)
    base = versions.snapshot(spark, path)
    writers.import_catalog(records(spark, tmp_path, record("a")), path, as_of())
    other = versions.write(readers.stored(spark, path, "cards").limit(0), path, "cards")
    with pytest.raises(versions.CommitConflictError):
        versions.commit(spark, path, base, {"cards": other})
    assert held(spark, path)[0] == {"a": "a"}
    # A reader that holds a state keeps reading it.
    before = versions.read(spark, path, "cards", base)
    assert before.count() == 0 and versions.snapshot(spark, path, base.number) == base
    for name in ("b", "c"):
        writers.import_catalog(records(spark, tmp_path, record(name)), path, as_of())
    assert versions.vacuum(spark, path, keep=1) > 0
    assert set(held(spark, path)[0]) == {"a", "b", "c"} and versions.vacuum(spark, path, keep=1) == 0


def test_records_tell_absent_from_null(spark, tmp_path):
    rows = records(spark, tmp_path, record("a"), record("b", language="German", price={}), record("c", price={"amount": 1, "currency": None}), record("d", language=None), record("e", price=None, visual_embedding=[1, 2.5]), record("f", price={"amount": None, "updated_at": "2024-01-02T03:04:05+02:00"}))
    got = {r.id: r for r in rows.collect()}
    assert [got[k].language for k in "abcdef"] == ["English", "German", "English", None, "English", "English"]
    assert got["a"].price is got["b"].price is got["e"].price is None and got["c"].price.currency is None
    assert got["f"].price.currency == "USD" and got["f"].price.amount is None and got["f"].price.updated_at == datetime(2024, 1, 2, 1, 4, 5)
    assert got["e"].visual_embedding == [1.0, 2.5] and [got[k].ordinal for k in "abcdef"] == sorted(got[k].ordinal for k in "abcdef")
    path = str(tmp_path / "db")
    writers.create_tables(spark, path)
    for bad, rule in ((record("x", language=None), "null_language: 1"), (record("x", price={"amount": 1, "currency": None}), "null_currency: 1"), ({k: v for k, v in record("x").items() if k != "name"}, "missing_name: 1")):
        with pytest.raises(InvalidCatalogError, match=rule):
            writers.import_catalog(records(spark, tmp_path, bad), path, as_of())
    with pytest.raises(Exception, match="(?i)cast|malformed"):
        records(spark, tmp_path, record("x", price={"amount": "much"})).collect()


def test_results_are_added_once(spark, tmp_path):
    path = str(tmp_path / "db")
    writers.create_tables(spark, path)
    results = spark.createDataFrame([("s1", "matched", 0.9), ("s2", "ambiguous", 0.6)], "scan_id string, status string, confidence double").withColumn("card_id", F.lit("c"))
    times = spark.createDataFrame([("s1", "read", 1.234), ("s1", "match", 2.0)], "scan_id string, stage string, ms double")
    rows = enrichment.identified(results, times, as_of())
    for _ in range(2):
        writers.append_once(rows, path, "recognition_results")
    writers.append_once(rows.unionByName(enrichment.identified(results, times, F.lit("2024-05-02 00:00:00").cast("timestamp"))), path, "recognition_results")
    got = readers.stored(spark, path, "recognition_results").collect()
    assert len(got) == 4 and len({r.recognition_id for r in got}) == 4
    assert {(r.scan_id, r.processing_ms) for r in got} == {("s1", 3.23), ("s2", 0.0)}
    import uuid

    assert all(uuid.UUID(r.recognition_id).version == 8 and uuid.UUID(r.recognition_id).variant == uuid.RFC_4122 for r in got)
    pairs = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "c"), ("-", "c")], "a string, b string").select(display.name_uuid(F.col("a"), F.col("b")).alias("u"))
    assert pairs.distinct().count() == 4


# Refresh


def files(spark, path):
    return {f for p in versions.snapshot(spark, path).tables["card_prices"].values() for f in spark.read.parquet(f"{path}/{p}").inputFiles()}


def test_refresh_rewrites_touched_buckets_only(spark, tmp_path):
    path, day = str(tmp_path / "db"), datetime(2024, 1, 1)
    writers.create_tables(spark, path)
    bucket_prices(spark, path, 8)
    apply_prices(spark.createDataFrame([(f"c{k}", 1.0, "USD", "w", day) for k in range(200)], PRICE), path, "feed", 0)
    before = versions.snapshot(spark, path)
    names = files(spark, path)
    assert len(before.tables["card_prices"]) == 8
    update = spark.createDataFrame([("c7", 2.0, None, "w", day + timedelta(1))], PRICE)
    assert apply_prices(update, path, "feed", 1)
    after = versions.snapshot(spark, path)
    moved = {b for b in before.tables["card_prices"] if before.tables["card_prices"][b] != after.tables["card_prices"][b]}
    assert len(moved) == 1 and len(names & files(spark, path)) == len(names) - 1
    # A replay is passed over, also with other rows; another feed has a ledger of its own.
    assert not apply_prices(spark.createDataFrame([("c7", 9.0, None, "w", day + timedelta(2))], PRICE), path, "feed", 1)
    assert versions.snapshot(spark, path) == after
    assert apply_prices(update.limit(0), path, "other", 1) and apply_prices(update, path, "feed", 2)
    # Imports keep the buckets.
    writers.import_catalog(records(spark, tmp_path, record("c7", price={"amount": 5.0}), record("new", price={"amount": 6.0})), path, as_of())
    got = {r.card_id: r.amount for r in readers.stored(spark, path, "card_prices").collect()}
    assert got["c7"] == 5.0 and got["new"] == 6.0 and len(got) == 201
    assert apply_prices(spark.createDataFrame([("new", 7.0, None, "w", AS_OF + timedelta(9))], PRICE), path, "feed", 3)
    assert {r.card_id: r.amount for r in readers.stored(spark, path, "card_prices").collect()}["new"] == 7.0


def test_a_crash_within_an_epoch_changes_nothing(spark, tmp_path, monkeypatch):
    path, source, state, day = str(tmp_path / "db"), str(tmp_path / "in"), str(tmp_path / "state"), datetime(2024, 1, 1)
    writers.create_tables(spark, path)
    spark.createDataFrame([("a", 1.0, None, "w", day)], PRICE).write.parquet(source)
    run = lambda: refresh_prices(spark.readStream.schema(PRICE).parquet(source), path, state, buckets=4).awaitTermination()
    run()
    spark.createDataFrame([("a", 2.0, None, "w", day + timedelta(1)), ("b", 3.0, None, "w", day)], PRICE).write.mode("append").parquet(source)
    publish = versions.publish

    def dying(*args):
        raise OSError("gone")

    monkeypatch.setattr(versions, "publish", dying)
    with pytest.raises(Exception, match="gone"):
        run()
    monkeypatch.setattr(versions, "publish", publish)
    assert held(spark, path)[1] == {"a": 1.0}
    run()
    assert held(spark, path)[1] == {"a": 2.0, "b": 3.0}


# As-of joins


def test_refresh_sorts_only_the_newest_of_each_card(spark):
    """Newest by time, then ordinal; older than stored is passed over, equally old replaces.  Updates are not sorted as a whole."""
    shape = schemas.TABLES["card_prices"]
    day = lambda n: datetime(2024, 1, n)
    old = spark.createDataFrame([("a", 1.0, "EUR", "s", day(5)), ("b", 1.0, "EUR", "s", day(5)), ("c", 1.0, "EUR", "s", day(5)), ("d", 1.0, "EUR", "s", day(5))], shape)
    rows = [("a", 2.0, None, "f", day(4), 1), ("b", 3.0, None, "f", day(5), 1), ("c", 4.0, "EUR", "f", day(6), 1), ("c", 5.0, None, "f", day(6), 2), ("c", 6.0, None, "f", day(2), 3), ("e", 7.0, None, "f", day(1), 1)]
    got = refresh.merged(old, spark.createDataFrame(rows, "card_id string, amount double, currency string, source string, updated_at timestamp, ordinal long"), "card_id")
    assert sorted((r.card_id, r.amount, r.currency, r.source) for r in got.collect()) == [("a", 1.0, "EUR", "s"), ("b", 3.0, "USD", "f"), ("c", 5.0, "USD", "f"), ("d", 1.0, "EUR", "s"), ("e", 7.0, "USD", "f")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "HashAggregate" in plan and got.columns == old.columns


def test_log_lines_with_a_time_of_zero(spark, tmp_path):
    """Where the sign of a time is turned, 0 breaks no rule: the query and its SQL agree."""
    import duckdb

    from matchloom.registry import SQL
    from matchloom.store_queries import log_contract

    events = [(k, 7, "view", v, '{"k": 3}') for k, v in enumerate([0.0, 1.5] * 13)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = sorted(tuple(r) for r in log_contract(spark, str(tmp_path)).select("event_id", "broken", "path", "total_ms").collect())
    assert got == sorted(duck.execute(SQL["log_contract"]).fetchall()) and (2, None, "/cards/3", 0.0) in got


def test_stream_shares_state_of_many_clients(spark, tmp_path):
    """Clients of one group keep windows of their own over restarts, in far fewer calls of the fold than there are clients."""
    rng = random.Random(3)
    events = [(k, f"c{rng.randrange(40)}", datetime(2024, 1, 1) + timedelta(seconds=5 * k + rng.random()), rng.random() < 0.4) for k in range(600)]
    shape = "request_id long, client string, ts timestamp, down boolean"
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for part in range(3):
        spark.createDataFrame(events[200 * part : 200 * part + 200], shape).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(shape).parquet(source)
        admit_stream(stream, 2, 300, "failover", "2 minutes", groups=3).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.request_id, r.client): r.allowed for r in spark.read.schema("request_id long, client string, allowed boolean").parquet(out).collect()}
    want = {(r.request_id, r.client): r.allowed for r in admission.admit(spark.createDataFrame(events, shape), 2, 300, "failover").collect()}
    assert got == want and len(set(got.values())) == 2


def test_asof_as_brute_force(spark):
    rng, day = random.Random(3), datetime(2024, 1, 1)
    moment = lambda: day + timedelta(hours=rng.randint(0, 240))
    left = [(k, rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.choice([moment(), moment(), None])) for k in range(300)]
    right = [(k, rng.choice(["a", "hot", "hot", None, "z"]), rng.choice([moment(), moment(), moment(), None]), rng.choice([1.0 * k, None])) for k in range(200)]
    ldf = spark.createDataFrame(left, "id int, key string, ts timestamp")
    rdf = spark.createDataFrame(right, "tie int, key string, at timestamp, v double")
    for width in (3600, 86_400, 10**9):
        got = {r.id: (r.v, r.tie) for r in asof.asof(ldf, rdf, "key", "ts", "at", ["v", "tie"], "tie", width).collect()}
        assert len(got) == len(left)
        for k, key, ts in left:
            found = [(at, tie, v) for tie, other, at, v in right if key is not None and other == key and at is not None and ts is not None and at <= ts]
            best = max(found, key=lambda x: x[:2], default=None)
            assert got[k] == ((best[2], best[1]) if best else (None, None)), (k, width)


def test_age_report(spark):
    day = datetime(2024, 1, 1)
    requests = spark.createDataFrame([("a", day + timedelta(hours=h)) for h in (1, 3, 30)] + [("b", day)], "card string, ts timestamp")
    changes = spark.createDataFrame([("a", day, 5.0)], "card string, at timestamp, amount double")
    report = {r.bucket: r for r in asof.age_report(asof.value_age(requests, changes, "card", "ts", "at", ["amount"]), "ts").collect()}
    assert (report[day].n, round(report[day].known, 3), report[day].p50_age) == (3, 0.667, 2.0) and report[day + timedelta(1)].p99_age == 30.0


# Coverage


@pytest.mark.parametrize("width", [3, 10_000])
def test_gaps_as_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr(coverage, "SLICE", width)
    rng = random.Random(width)
    rows = [(f"s{rng.randint(0, 3)}", rng.choice(["", "TG", "tg0", "0"]) + str(rng.randint(0, 40)), rng.choice(["45", None, "x"])) for _ in range(120)] + [("s9", "7a", "3"), (None, "1", "3"), ("empty", "0", "2")]
    numbers = coverage.set_numbers(spark.createDataFrame(rows, "set_name string, collector_number string, printed_total string"))
    have, totals = defaultdict(set), {}
    for name, number, total in rows:
        digits = number.upper().lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        if name is None or not digits.isdigit():
            continue
        key = (name, number.upper()[: -len(digits)])
        have[key].add(int(digits))
        if total and total.isdigit():
            totals[key] = max(totals.get(key, 0), int(total))
    expected, shares = set(), {}
    for key, found in have.items():
        end = max(max(found), totals.get(key, 0) if key[1] == "" else 0)
        missing = [n for n in range(1, end + 1) if n not in found]
        for n in missing:
            if n - 1 not in missing:
                stop = n
                while stop + 1 in missing:
                    stop += 1
                expected.add((*key, n, stop))
        shares[key] = (len(found - {0}), end)
    assert {tuple(r) for r in coverage.missing_ranges(numbers).collect()} == expected
    got = {(r.set_name, r.prefix): r for r in coverage.coverage(numbers).collect()}
    assert {k: (r.present, r.expected) for k, r in got.items()} == shares
    assert all(r.share is None if r.expected == 0 else r.share == pytest.approx(r.present / r.expected) for r in got.values())


# Outages


def through_outages(events, downs, limit, window):
    state, out = {}, {}
    for k, who, t in sorted(events, key=lambda e: (e[2], e[0])):
        gate = state.setdefault(who, {"opened": None, "n": 0, "log": []})
        if any(a <= t < b for a, b in downs):
            gate["log"] = [x for x in gate["log"] if t - x < window]
            out[k] = len(gate["log"]) < limit
            if out[k]:
                gate["log"].append(t)
        else:
            if gate["opened"] is None or t - gate["opened"] >= window:
                gate["opened"], gate["n"] = t, 0
            gate["n"] += 1
            out[k] = gate["n"] <= limit
    return out


def test_admission_through_outages_batch_and_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    at = lambda s: start + timedelta(seconds=s)
    rows = [(k, None if k % 11 == 0 else f"c{0 if k % 3 == 0 else k % 5}", at(7 * k + (k * k) % 5)) for k in range(200)]
    downs = [(at(100), at(180)), (at(150), at(210)), (at(400), at(400)), (at(300), at(330)), (at(330), at(340)), (at(900), at(5000))]
    requests = spark.createDataFrame(rows, "request_id long, client string, ts timestamp")
    outages = spark.createDataFrame(downs, "began timestamp, ended timestamp")
    expected = through_outages([(k, w or "unknown", t) for k, w, t in rows], downs, 3, timedelta(seconds=60))
    marked = admission.mark_outages(requests, outages)
    assert {r.request_id: r.down for r in marked.collect()} == {k: any(a <= t < b for a, b in downs) for k, _, t in rows}
    for width in (10, 10**9):
        assert admission.mark_outages(requests, outages, width).where("down").count() == marked.where("down").count()
    assert not admission.mark_outages(requests, outages.limit(0)).where("down").count()
    assert {r.request_id: r.allowed for r in admission.admit(marked, 3, 60, "failover").collect()} == expected
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(4):
        marked.where(f"request_id div 50 = {part}").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(marked.schema).parquet(source)
        admit_stream(stream, 3, 60, "failover").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert {r.request_id: r.allowed for r in spark.read.parquet(out).collect()} == expected


# Contracts


def test_contract_rules_in_order(spark):
    good = {"request_id": "r", "method": "GET", "path": "/", "status": 200, "total_ms": 1.5, "more": [1]}
    lines = [
        (json.dumps(good), None), (json.dumps(good)[:-3], "unreadable"), ("", "unreadable"), (None, "unreadable"), ("[]", "unreadable"), ("7", "unreadable"), (json.dumps([good]), "unreadable"), (json.dumps(good | {"status": "x"}), "unreadable"), (json.dumps({}), "missing_request_id"),
        (json.dumps(good | {"method": None, "status": 7}), "missing_method"), (json.dumps(good | {"request_id": "r" * 81, "status": 7}), "long_request_id"), (json.dumps(good | {"status": 99}), "bad_status"), (json.dumps(good | {"total_ms": -0.1}), "bad_total_ms"),
    ]
    df = spark.createDataFrame([(k, line) for k, (line, _) in enumerate(lines)], "k int, line string")
    kept, refused = contracts.quarantined(df, "line", contracts.REQUEST_LINE)
    assert {r.k: r.broken for r in refused.collect()} == {k: rule for k, (_, rule) in enumerate(lines) if rule}
    assert refused.columns == ["k", "line", "broken"] and [r.total_ms for r in kept.collect()] == [1.5]


def test_response_contract(spark):
    card = {"id": "a", "name": "A", "set_name": "s", "collector_number": "1", "rarity": None, "language": "English", "image_url": "https://x.invalid/i", "marketplace_url": "https://x.invalid/m", "price": {"amount": None, "source": None, "updated_at": None}}
    good = {"recognition_id": "r", "status": "matched", "card": card, "confidence": 1, "processing_ms": 0, "message": None}
    rows = [
        (good, None), (good | {"card": None, "candidates": None}, None), (good | {"candidates": [{"card": card, "confidence": 0.5}]}, None), (good | {"status": "sure"}, "bad_status"), (good | {"confidence": 1.1}, "bad_confidence"), (good | {"processing_ms": -1}, "bad_processing_ms"),
        (good | {"card": card | {"image_url": "not a url"}}, "bad_card"), (good | {"card": {k: v for k, v in card.items() if k != "price"}}, "bad_card"), (good | {"candidates": [{"card": card, "confidence": 2}]}, "bad_candidate"), (good | {"candidates": [{"card": None, "confidence": 1}]}, "bad_candidate"),
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, (r, _) in enumerate(rows)], "k int, line string")
    read = contracts.parsed(df, "line", contracts.RESPONSE).withColumn("card", contracts.currency_filled(F.col("card")))
    got = {r.k: r for r in read.collect()}
    assert {k: r.broken for k, r in got.items()} == {k: rule for k, (_, rule) in enumerate(rows)}
    assert got[0].candidates == got[1].candidates == [] and got[0].card.price.currency == "USD" and got[1].card is None


# Slices


def test_slices_in_one_pass(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(400):
        truth = rng.choice(["a", "b", None])
        top = rng.choice(["a", "b"])
        rows.append((truth, rng.choice(["matched", "ambiguous", "unrecognized"]), top, [top], rng.choice(["dim", "warm", None]), rng.randint(0, 2)))
    df = spark.createDataFrame(rows, "expected string, status string, top_card_id string, top3 array<string>, light string, layout int")
    got = {(r.dimension, r.light, r.layout): r for r in quality.slice_report(df, ["light", "layout"], [("light", "layout")]).collect()}
    whole = quality.accuracy(df).first()
    assert got[None, None, None].top1 == pytest.approx(whole.top1) and got[None, None, None].grouping_id == 3 and got[None, None, None].deficit == 0
    for by, key in ((["light"], "light"), (["layout"], "layout"), (["light", "layout"], "light+layout")):
        slices = quality.accuracy(df, by).collect()
        assert len(slices) == sum(k[0] == key for k in got)
        for s in slices:
            r = got[key, s.light if "light" in by else None, str(s.layout) if "layout" in by else None]
            assert (r.n, r.top1, r.rejection) == (s.n, pytest.approx(s.top1), pytest.approx(s.rejection)) and r.slice_ok == (whole.top1 - s.top1 <= 0.05)
    matrix = {r.truth: r for r in quality.confusion_matrix(df).collect()}
    assert matrix["total"].total == 400 and matrix["negative"].total == sum(r[0] is None for r in rows)
    assert matrix["positive_right"].matched == sum(r[0] == r[2] and r[1] == "matched" for r in rows)
    assert [tuple(r) for r in quality.confusion_matrix(df.limit(0)).collect()] == [("total", 0, 0, 0, 0)]


# Intake, endpoints, times


def test_times_with_and_without_offset(spark):
    rows = [("2024-01-02T03:04:05+02:00",), ("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05.5",), ("2024-07-02T03:04:05",), ("2024-01-02",), ("soon",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    try:
        for session in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", session)
            got = [r[0] for r in df.select(F.unix_micros(display.iso_instant(F.col("t"), "Europe/Paris"))).collect()]
            micros = lambda *a: int((datetime(*a) - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
            assert got == [micros(2024, 1, 2, 1, 4, 5), micros(2024, 1, 2, 3, 4, 5), micros(2024, 1, 2, 2, 4, 5, 500_000), micros(2024, 7, 2, 1, 4, 5), micros(2024, 1, 1, 23, 0, 0), None, None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_intake_and_replaced_ports(spark):
    shape = "upload_id int, mime string, size long, fmt string, width int, height int, readable boolean, plausible int, blur double"
    rows = [(1, "image/png", 5, "PNG", 500, 700, True, 1, 90.0), (2, "text/plain", 5, "PNG", 500, 700, True, 1, 90.0), (3, "image/png", 5, "PNG", 500, 700, True, 2, 1.0), (4, "image/png", 5, "PNG", 500, 700, True, 0, 1.0), (5, "image/png", 5, "PNG", 500, 5000, True, 0, 90.0), (6, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, shape)
    good, refused = Engine().intake(df)
    assert [r.upload_id for r in good.collect()] == [1]
    assert {r.upload_id: (r.code, r.http_status) for r in refused.collect()} == {2: ("invalid_image", 422), 3: ("multiple_cards", 422), 4: ("image_too_blurry", 422), 5: ("card_not_found", 422), 6: ("invalid_image", 422)}
    good, refused = Engine(validator=lambda o: F.when(F.col("upload_id") > 3, "invalid_image"), locator=lambda o: F.lit(None).cast("string")).intake(df)
    assert good.count() == 3 and refused.count() == 3


def test_endpoints(spark, tmp_path):
    path = str(tmp_path / "db")
    writers.create_tables(spark, path)
    writers.import_catalog(records(spark, tmp_path, record("a", price={"amount": 2.5, "currency": "EUR"}), record("b")), path, as_of())
    catalog, prices = readers.stored(spark, path, "cards"), readers.stored(spark, path, "card_prices")
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "none"), (4, "a"), (5, None)], "request_id int, card_id string")
    cards = {r.request_id: r.card for r in endpoints.cards(asked, catalog, prices).collect()}
    assert set(cards) == {1, 2, 4} and cards[1].price.amount == 2.5 and cards[2].price.amount is None and cards[2].price.currency == "USD"
    assert {r.request_id: r.price.amount for r in endpoints.prices_of(asked, catalog, prices).collect()} == {1: 2.5, 2: None, 4: 2.5}
    bad = endpoints.feedback(spark.createDataFrame([("r" * 36, "a", None, False), ("x", "a", None, False)], "recognition_id string, predicted_card_id string, correct_card_id string, is_correct boolean"), path, as_of())
    assert bad.count() == 1 and readers.stored(spark, path, "recognition_feedback").count() == 1
    assert endpoints.health(spark.createDataFrame([("m", True), ("n", False)], "artifact string, present boolean")).first().models == "artifacts_required"


def test_safe_paths(spark):
    cases = {"/a/b?q=1#f": "/a/b?q=1#f", "//x": "/", "/\\x": "/", "/a/../../b": "/b", "/a/..": "/", "/a/b/.": "/a/b/", "/%2e%2E/callback": "/", "/callback": "/", "/callback/": "/callback/", "x": "/", "https://x.invalid/a": "/", "/\t/x": "/", "/a\\b": "/a/b", "/": "/", "": "/", None: "/"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r.p: r.s for r in df.select("p", display.safe_path(F.col("p"), ("/callback",)).alias("s")).collect()}
    assert got == cases


# Contours


def plain_simplified(points, share):
    """Recursive form: open the contour at two far points, then split each chain at its farthest point."""
    n = len(points)
    if n == 0:
        return []
    limit = share * sum(math.dist(points[k], points[(k + 1) % n]) for k in range(n))
    far = lambda i: max(range(n), key=lambda j: (math.dist(points[i], points[j]), -j))
    one = far(0)
    two = far(one)

    def apart(p, a, b):
        d = (b[0] - a[0], b[1] - a[1])
        along = d[0] ** 2 + d[1] ** 2
        t = max(0, min(1, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / along)) if along else 0
        return math.hypot(p[0] - a[0] - t * d[0], p[1] - a[1] - t * d[1])

    def chain(i, j):
        inner = [k % n for k in range(i + 1, j if j > i else j + n)]
        if not inner:
            return []
        distances = [apart(points[k], points[i], points[j]) for k in inner]
        best = max(range(len(inner)), key=lambda k: (distances[k], -k))
        if distances[best] <= limit:
            return []
        middle = inner[best]
        return [*chain(i, middle), middle, *chain(middle, j)]

    if one == two:
        return sorted({one, *chain(one, one)})
    return sorted({one, two, *chain(one, two), *chain(two, one)})


def contour(rng, n):
    return [(rng.uniform(3, 9) * math.cos(2 * math.pi * k / n), rng.uniform(3, 9) * math.sin(2 * math.pi * k / n)) for k in range(n)]


SHAPE = "id int, points array<struct<x: double, y: double>>"


def test_contours_as_brute_force(spark):
    rng = random.Random(6)
    shapes = [contour(rng, rng.randint(1, 40)) for _ in range(150)] + [[], [(1.0, 1.0)], [(1.0, 1.0)] * 4, [(0.0, 0.0), (2.0, 0.0)], [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (2.0, 2.0), (1.0, 2.0), (0.0, 2.0)], contour(rng, 3000)]
    df = spark.createDataFrame([*enumerate(shapes), (999, None)], SHAPE)
    got = {r.id: r for r in df.select("id", geometry.simplify(F.col("points")).alias("c"), geometry.area(F.col("points")).alias("area"), geometry.perimeter(F.col("points")).alias("length")).collect()}
    assert got[999].c is None and got[999].area is None
    for k, points in enumerate(shapes):
        assert [tuple(p) for p in got[k].c] == [points[i] for i in plain_simplified(points, 0.025)], k
        shoelace = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True))) / 2
        assert got[k].area == pytest.approx(shoelace) and got[k].length == pytest.approx(sum(math.dist(a, b) for a, b in zip(points, points[1:] + points[:1], strict=True)))


def test_largest_of_contours_of_any_size(spark):
    octagon, square = [(math.cos(math.pi * k / 4) * 3, math.sin(math.pi * k / 4) * 3) for k in range(8)], [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    df = spark.createDataFrame([([square, octagon, square[:3]],)], "c array<array<struct<x: double, y: double>>>")
    kept = df.select(geometry.largest_contours(F.col("c")).alias("k")).first().k
    assert [len(c) for c in kept] == [8, 4]


def test_homography_takes_corners_to_the_rectangle_and_back(spark):
    rng = random.Random(7)
    quads = [[(rng.uniform(-50, 0), rng.uniform(-50, 0)), (rng.uniform(60, 300), rng.uniform(-50, 0)), (rng.uniform(60, 300), rng.uniform(60, 300)), (rng.uniform(-50, 0), rng.uniform(60, 300))] for _ in range(100)] + [[(0.0, 0.0), (743.0, 0.0), (743.0, 1038.0), (0.0, 1038.0)]]
    df = geometry.with_homography(spark.createDataFrame(list(enumerate(quads)), SHAPE), "points", 743.0, 1038.0, "m").withColumn("back", geometry.inverse(F.col("m")))
    target = [(0.0, 0.0), (743.0, 0.0), (743.0, 1038.0), (0.0, 1038.0)]
    there = F.transform("points", lambda p: geometry.mapped(F.col("m"), p["x"], p["y"]))
    again = F.transform(there, lambda p: geometry.mapped(F.col("back"), p["x"], p["y"]))
    for r in df.select("id", "m", there.alias("there"), again.alias("again")).collect():
        assert np.allclose(r.there, target, atol=1e-9 * 1038) and np.allclose(r.again, quads[r.id], atol=1e-9 * 300) and r.m[8] == 1
        # The same map by solving the eight equations.
        a, b = [], []
        for (x, y), (u, v) in zip(quads[r.id], target, strict=True):
            a += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
            b += [u, v]
        assert np.allclose(r.m[:8], np.linalg.solve(np.array(a), np.array(b)), rtol=1e-6, atol=1e-9)
    flat = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (0.0, 1.0)])], SHAPE)
    assert geometry.with_homography(flat, "points", 1.0, 1.0).first().homography is None
