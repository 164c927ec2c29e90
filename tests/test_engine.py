"""Stages, sources, sinks and streams on small tables."""

from __future__ import annotations

import json
from collections import defaultdict, deque
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import admission, blocking, catalog, ctc, decision, metric, quality, uploads
from matchloom.plans.engine import Engine
from matchloom.plans.options import Options
from matchloom.sources import readers, writers
from matchloom.streaming.admission import admit_stream
from matchloom.streaming.refresh import refresh_prices

CARD = "card_id string, name string, normalized_name string, collector_number string, printed_total string, set_name string, rarity string, language string, image_url string, marketplace_id string, marketplace_url string, embedding array<float>"


def card(k, name, number, vector=None):
    return (k, name, name.lower(), number, None, "Test Set", None, "English", "https://x.invalid/i", f"m{k}", "https://x.invalid/m", vector)


def test_end_to_end_match(spark):
    cards = spark.createDataFrame([card("card-057", "Falcon ex", "57", [0.1, 0.2]), card("b", "Badger", "58", [0.2, -0.1])], CARD)
    scans = spark.createDataFrame([("s", "Falcon ex", "057/182", 0.985, [0.1, 0.2]), ("none", None, None, 0.9, None)], "scan_id string, raw_name string, raw_number string, ocr_quality double, embedding array<double>")
    prices = spark.createDataFrame([("card-057", 42.5, "USD", "fixture", None)], "card_id string, amount double, currency string, source string, updated_at timestamp")
    got = {r.scan_id: r for r in Engine().recognize(scans, cards, prices).collect()}
    assert got["s"].status == "matched" and got["s"].card_id == "card-057" and got["s"].amount == 42.5 and got["s"].confidence >= 0.82
    assert got["none"].status == "unrecognized" and got["none"].confidence == 0.0 and got["none"].message
    nested = {r.scan_id: r for r in Engine().responses(scans, cards, prices).collect()}
    assert nested["s"].card.name == "Falcon ex" and nested["s"].candidates[0].card.price.amount == 42.5
    assert nested["none"].candidates == [] and nested["none"].card is None


def test_blocking_as_brute_force(spark):
    cards = [(f"{k:03}", ["red fox", "red_fox", "big red fox", "ox", "redfox"][k % 5], str(k % 7)) for k in range(80)]
    observed = [("a", "red fox", "3"), ("b", None, "3"), ("c", "ox", None), ("d", None, None), ("e", "red_fox", "9"), ("f", "nothing", "100"), ("g", "x", "1")]
    df = spark.createDataFrame(cards, "card_id string, normalized_name string, collector_number string")
    scans = spark.createDataFrame(observed, "scan_id string, obs_name string, obs_number string")
    got = defaultdict(list)
    for r in blocking.block(scans, df, 8).orderBy("scan_id", "retrieval_rank").collect():
        got[r.scan_id].append(r.card_id)

    def like(name, pattern):
        import re

        return re.search("".join("." if c == "_" else re.escape(c) for c in pattern), name) is not None

    for scan, name, number in observed:
        hits = []
        for k, n, c in cards:
            by_name, by_number = name is not None and like(n, name), number is not None and c == number
            if by_name or by_number:
                hits.append((0 if by_name and by_number else 1 if by_number else 2, k))
        assert got[scan] == [k for _, k in sorted(hits)[:8]], scan


def sliding(events, limit, window):
    kept, out = defaultdict(deque), {}
    for k, who, t in sorted(events, key=lambda e: (e[2], e[0])):
        w = kept[who]
        while w and t - w[0] >= timedelta(seconds=window):
            w.popleft()
        out[k] = len(w) < limit
        if out[k]:
            w.append(t)
    return out


def fixed(events, limit, window):
    state, out = {}, {}
    for k, who, t in sorted(events, key=lambda e: (e[2], e[0])):
        opened, n = state.get(who, (t, 0))
        if t - opened >= timedelta(seconds=window):
            opened, n = t, 0
        state[who] = opened, n + 1
        out[k] = n + 1 <= limit
    return out


def requests(n=300):
    start = datetime(2024, 1, 1)
    return [(k, None if k % 11 == 0 else f"c{0 if k % 3 == 0 else k % 5}", start + timedelta(seconds=7 * k + (k * k) % 5)) for k in range(n)]


@pytest.mark.parametrize(("mode", "plain"), [("sliding", sliding), ("fixed", fixed)])
def test_admission(spark, mode, plain):
    rows = requests()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    got = {r.request_id: r.allowed for r in admission.admit(spark.createDataFrame(rows, "request_id long, client string, ts timestamp"), 3, 60, mode).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert got == plain([(k, w or "unknown", t) for k, w, t in rows], 3, 60)


@pytest.mark.parametrize(("mode", "plain"), [("sliding", sliding), ("fixed", fixed)])
def test_admission_stream_over_batches_and_restart(spark, tmp_path, mode, plain):
    rows = requests(90)
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def drain():
        stream = spark.readStream.schema("request_id long, client string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(source))
        job = admit_stream(stream, 3, 60, mode).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        job.awaitTermination()

    for part in range(3):
        spark.createDataFrame(rows[30 * part : 30 * part + 30], "request_id long, client string, ts timestamp").coalesce(1).write.mode("append").parquet(str(source))
        if part:
            drain()
    got = {r.request_id: r.allowed for r in spark.read.parquet(out).collect()}
    assert got == plain([(k, w or "unknown", t) for k, w, t in rows], 3, 60)


def test_ctc(spark):
    def step(i, n=5):
        return [4.0 if k == i else 0.0 for k in range(n)]

    rows = [(1, [step(1), step(1), step(0), step(1), step(4)]), (2, [step(0)]), (3, []), (4, [step(3), step(4), step(3)])]
    got = {r.seq_id: r for r in ctc.decode(spark.createDataFrame(rows, "seq_id int, logits array<array<double>>"), " abc").collect()}
    assert (got[1].text, got[2].text, got[3].text, got[4].text) == ("aa", "", "", "cc")
    assert got[2].confidence == got[3].confidence == 0.0 and 0.9 < got[1].confidence < 1


def test_hardest_as_brute_force_and_rows_shuffled(spark):
    """All pairs in tiles of two chunks; a vector goes to as many tiles as there are chunks, which do not follow the batch."""
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=8).tolist(), int(rng.integers(5))) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<float>, label int")
    v = np.array([r[1] for r in rows], np.float32).astype(float)
    label, d = np.array([r[2] for r in rows]), np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    for chunks in (1, 4):
        assert metric.tiles(df, "id", "v", "label", chunks).count() == 300 * chunks
        for r in metric.hardest(df, "id", "v", "label", chunks).collect():
            mine = label == label[r.id]
            assert r.negative == pytest.approx(d[r.id][~mine].min()) and r.positive == pytest.approx(d[r.id][mine].max())
    assert [metric.chunks_for(n) for n in (0, 5000, 10_000, 200_000, 1_000_000)] == [1, 5, 8, 8, 31]


def test_triplet_loss(spark):
    rows = [(1, [0.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 0.5], 1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    got = metric.triplet_loss(df, "id", "v", "label").first()
    assert got.n_rows == 2 and got.loss == pytest.approx(((1 - 0.5 + 0.2) + max(0, 1 - 1.25**0.5 + 0.2)) / 2)
    assert metric.triplet_loss(df.where("id = 3"), "id", "v", "label").first().loss is None


def record(k, **more):
    return {"id": k, "name": k, "normalized_name": k, "collector_number": "1", "set_name": "s", "reference_image_url": "https://x.invalid/a", "marketplace_id": f"m{k}", "marketplace_url": "https://x.invalid/b", **more}


def test_catalog_import(spark, tmp_path):
    path, as_of = str(tmp_path / "db"), F.lit("2024-05-01 00:00:00").cast("timestamp")
    writers.create_tables(spark, path)
    first = [record("a", price={"amount": 1.0}), record("b", visual_embedding=[1.0, 2.0]), record("a", name="again")]
    (tmp_path / "one.json").write_text(json.dumps(first))
    writers.import_catalog(readers.catalog_json(spark, str(tmp_path / "one.json")), path, as_of)
    cards = {r.card_id: r for r in readers.stored(spark, path, "cards").collect()}
    prices = {r.card_id: r for r in readers.stored(spark, path, "card_prices").collect()}
    assert cards["a"].name == "again" and cards["a"].language == "English" and cards["b"].embedding == [1.0, 2.0] and cards["a"].embedding is None
    assert prices["a"].amount == 1.0 and prices["a"].currency == "USD" and "b" not in prices
    (tmp_path / "two.json").write_text(json.dumps([record("c"), record("d", marketplace_id="mc"), record("e", marketplace_url="nope")]))
    with pytest.raises(catalog.InvalidCatalogError, match="repeated_marketplace_id"):
        writers.import_catalog(readers.catalog_json(spark, str(tmp_path / "two.json")), path, as_of)
    assert readers.stored(spark, path, "cards").count() == 2


def test_feedback(spark, tmp_path):
    path = str(tmp_path / "db")
    writers.create_tables(spark, path)
    rows = [("r" * 36, "a", None, True), ("short", "a", None, True), ("r" * 36, "a" * 65, None, False), ("r" * 36, None, "b", None)]
    bad = writers.append_feedback(spark.createDataFrame(rows, "recognition_id string, predicted_card_id string, correct_card_id string, is_correct boolean"), path)
    assert bad.count() == 3 and readers.stored(spark, path, "recognition_feedback").count() == 1


def test_price_refresh_stream(spark, tmp_path):
    path, updates = str(tmp_path / "db"), str(tmp_path / "updates")
    writers.create_tables(spark, path)
    shape = "card_id string, amount double, currency string, source string, updated_at timestamp"
    t = datetime(2024, 1, 1)
    for rows in ([("a", 1.0, None, "w", t), ("a", 2.0, "EUR", "w", t + timedelta(1))], [("b", 3.0, None, "w", t), ("a", 0.5, None, "w", t)]):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(updates)
        refresh_prices(spark.readStream.schema(shape).parquet(updates), path, str(tmp_path / "state")).awaitTermination()
    got = {r.card_id: r for r in readers.stored(spark, path, "card_prices").collect()}
    assert got["a"].amount == 2.0 and got["a"].currency == "EUR" and got["b"].amount == 3.0 and got["b"].currency == "USD"


def test_upload_codes_in_order(spark):
    o, c = Options(), F.col
    shape = "mime string, size long, fmt string, width int, height int, readable boolean"
    rows = [("image/jpeg", 1, "JPEG", 320, 320, True), ("IMAGE/PNG", 0, "JPEG", 320, 320, True), ("x", 99_999_999, "GIF", 1, 1, False), ("image/png", 99_999_999, "GIF", 1, 1, False), ("image/png", 1, "GIF", 1, 1, False), ("image/png", 1, "PNG", 319, 400, False), ("image/png", 1, "PNG", 6000, 6000, False), ("image/png", 1, "PNG", 600, 600, False), (None, 1, "PNG", 600, 600, True)]
    code = uploads.upload_code(c("mime"), c("size"), c("fmt"), c("width"), c("height"), c("readable"), o)
    assert [r[0] for r in spark.createDataFrame(rows, shape).select(code).collect()] == [None, "invalid_image", "invalid_image", "image_too_large", "invalid_image", "invalid_image", "image_too_large", "invalid_image", "invalid_image"]


def test_formats_by_first_bytes(spark):
    heads = [bytes.fromhex("FFD8FFE000"), bytes.fromhex("89504E470D0A1A0A00"), b"RIFF\x00\x00\x00\x00WEBP", b"\x00\x00\x00\x18ftypheic", b"GIF89a"]
    got = [r[0] for r in spark.createDataFrame([(h,) for h in heads], "b binary").select(uploads.sniffed_format(F.col("b"))).collect()]
    assert got == ["JPEG", "PNG", "WEBP", "HEIC", None]


def test_quality(spark):
    rows = [("a", "matched", "a", ["a"]), ("b", "matched", "x", ["x"]), ("c", "ambiguous", "y", ["y", "c"]), (None, "unrecognized", None, None), (None, "matched", "z", ["z"])]
    m = quality.accuracy(spark.createDataFrame(rows, "expected string, status string, top_card_id string, top3 array<string>")).first()
    assert (m.n, m.top1, m.top3_recall, m.false_confident, m.rejection) == (5, pytest.approx(1 / 3), 1.0, 0.4, 0.5)
    split = quality.split_by_group(spark.range(500).withColumn("g", F.col("id") % 50), "g")
    assert quality.leaked_groups(split, "g").count() == 0 and 0 < split.where("held_out").count() < 500


def test_localization(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    rows = [("s", square, [(x + 3.0, y + 4.0) for x, y in square]), ("s", None, square)]
    got = quality.localization(spark.createDataFrame(rows, "slice string, corners array<struct<x: double, y: double>>, true_corners array<struct<x: double, y: double>>"), ["slice"]).first()
    assert (got.success, got.corner_error, got.n) == (0.5, 5.0, 2)


def test_errors_as_rows(spark):
    got = decision.error_rows(spark.createDataFrame([(1, "invalid_image", "d"), (2, "odd", "d"), (3, None, None)], "id int, code string, detail string")).collect()
    assert [(r.id, r.code, r.http_status) for r in got] == [(1, "invalid_image", 422), (2, "recognition_failed", 422)]


def test_bounded_upload_source(spark, tmp_path):
    (tmp_path / "small.bin").write_bytes(b"x" * 10)
    (tmp_path / "large.bin").write_bytes(b"x" * 1000)
    assert [r.size for r in readers.uploads(spark, str(tmp_path), 100).collect()] == [10]


def test_contained_names_as_brute_force(spark):
    """Short names, wildcards alone and common pieces included."""
    import random
    import re

    from matchloom.operators.blocking import contained_names

    rng = random.Random(1)
    known = sorted({"".join(rng.choice("abc_ ") for _ in range(rng.randint(1, 8))) for _ in range(120)})
    seen = sorted({"".join(rng.choice("abc_") for _ in range(rng.randint(1, 5))) for _ in range(120)} | {"_", "__", "zzzz"})
    got = contained_names(spark.createDataFrame([(x,) for x in seen], "obs_name string"), spark.createDataFrame([(x,) for x in known], "card_name string")).collect()
    assert {(r.obs_name, r.card_name) for r in got} == {(o, k) for o in seen for k in known if re.search(re.escape(o).replace("_", "."), k)}
