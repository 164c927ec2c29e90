"""Registered queries of stored tables, contracts, coverage, outages and contours, with their DuckDB statements."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import display
from matchloom.operators import admission, asof, contracts, coverage, decision, enrichment, evidence, quality
from matchloom.operators.catalog import InvalidCatalogError
from matchloom.plans import endpoints
from matchloom.plans import fixtures as fx
from matchloom.plans.engine import Engine
from matchloom.registry import SQL, query
from matchloom.sources import readers, writers
from matchloom.sources.scratch import scratch
from matchloom.streaming.admission import admit_stream
from matchloom.streaming.refresh import apply_prices, bucket_prices, refresh_prices

AS_OF = "2024-02-01 00:00:00"
_AS_OF_COLUMN = lambda: F.lit(AS_OF).cast("timestamp")


# All-or-nothing import


def _import_records(spark: SparkSession, sf_dir: str, second: bool) -> DataFrame:
    part, key = fx.tables(spark, sf_dir, "part")[0], F.col("p_partkey")
    part = part.where("p_size > 25") if second else part
    amount = F.when(key % (2 if second else 5) == 0, F.col("p_retailprice") * (3 if second else 1))
    price = F.struct(amount.alias("amount"), F.lit("USD").alias("currency"), F.lit("second" if second else "first").alias("source"), F.lit(None).cast("timestamp").alias("updated_at"))
    return part.select(
        key.cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_name").alias("normalized_name"), F.col("p_size").cast("string").alias("collector_number"), F.lit(None).cast("string").alias("printed_total"),
        (F.lit("second") if second else F.col("p_brand")).alias("set_name"), F.lit(None).cast("string").alias("rarity"), F.lit("English").alias("language"), F.lit("https://x.invalid/a").alias("reference_image_url"),
        F.concat(F.lit("m"), key.cast("string")).alias("marketplace_id"), F.lit("https://x.invalid/b").alias("marketplace_url"), F.lit(None).cast("array<float>").alias("visual_embedding"), F.when(amount.isNotNull(), price).alias("price"), key.alias("ordinal"),
    )


@query("""SELECT CAST(p_partkey AS VARCHAR) AS card_id, CASE WHEN p_size > 25 THEN 'second' ELSE p_brand END AS set_name,
  CASE WHEN p_size > 25 AND p_partkey % 2 = 0 THEN p_retailprice * 3 WHEN p_partkey % 5 = 0 THEN p_retailprice END AS amount,
  CASE WHEN p_size > 25 AND p_partkey % 2 = 0 THEN 'second' WHEN p_partkey % 5 = 0 THEN 'first' END AS source FROM part""")
def import_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two imports, each one commit over cards and prices, and a third that breaks a rule and changes nothing."""
    path = scratch(spark, "catalog")
    writers.create_tables(spark, path)
    writers.import_catalog(_import_records(spark, sf_dir, False), path, _AS_OF_COLUMN())
    writers.import_catalog(_import_records(spark, sf_dir, True), path, _AS_OF_COLUMN())
    with contextlib.suppress(InvalidCatalogError):
        writers.import_catalog(_import_records(spark, sf_dir, True).withColumns({"marketplace_id": F.lit("one"), "set_name": F.lit("third")}), path, _AS_OF_COLUMN())
    cards, prices = readers.stored(spark, path, "cards"), readers.stored(spark, path, "card_prices")
    return cards.select("card_id", "set_name").join(prices.select("card_id", "amount", "source"), "card_id", "left")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS card_id, CASE p_partkey % 3 WHEN 0 THEN 'English' WHEN 2 THEN 'German' END AS language, p_partkey % 4 = 1 AS priced,
  CASE WHEN p_partkey % 4 = 1 THEN CASE WHEN p_partkey % 8 = 1 THEN 'USD' ELSE 'EUR' END END AS currency, CAST(CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 0 END AS INTEGER) AS dimensions FROM part""")
def import_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records given as JSON text: absent, null and given languages, prices that are absent, empty or lack a currency."""
    key = F.col("p_partkey")
    language = F.when(key % 3 == 0, "").when(key % 3 == 1, ', "language": null').otherwise(', "language": "German"')
    price = F.when(key % 8 == 1, ', "price": {"amount": 1.5}').when(key % 8 == 5, ', "price": {"amount": 2, "currency": "EUR"}').when(key % 4 == 2, ', "price": {}').when(key % 4 == 3, ', "price": null').otherwise("")
    vector = F.when(key % 5 == 0, ', "visual_embedding": [0.5, 1]').otherwise("")
    text = F.concat(F.lit('{"id": "'), key.cast("string"), F.lit('", "name": "'), F.col("p_name"), F.lit('"'), language, price, vector, F.lit("}"))
    rows = readers.import_records(fx.tables(spark, sf_dir, "part")[0].select(F.parse_json(text).alias("record")), "record")
    return rows.select(F.col("id").alias("card_id"), "language", F.col("price").isNotNull().alias("priced"), F.col("price.currency").alias("currency"), F.coalesce(F.array_size("visual_embedding"), F.lit(0)).alias("dimensions"))


# Prices in time

_CHANGES_SQL = """
changes AS (
  SELECT l_partkey AS card, TIMESTAMP '2023-12-20' + to_minutes(30 * date_diff('day', DATE '1995-01-01', l_shipdate::DATE)) AS changed_at, l_extendedprice AS amount, l_orderkey * 8 + l_linenumber AS ordinal FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY card, changed_at ORDER BY ordinal DESC, amount DESC) = 1),
aged AS (
  SELECT e.event_id, e.ts, c.amount, (epoch_us(e.ts) - epoch_us(c.changed_at))::DOUBLE / 1000000 AS age_seconds
  FROM events e ASOF LEFT JOIN changes c ON c.card = e.user_id AND c.changed_at <= e.ts)
"""


def _aged(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, lines = fx.tables(spark, sf_dir, "events", "lineitem")
    days = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    changed = F.lit("2023-12-20").cast("timestamp") + F.make_dt_interval(mins=days * 30)
    changes = lines.select(F.col("l_partkey").alias("card"), changed.alias("at"), F.col("l_extendedprice").alias("amount"), F.struct((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), F.col("l_extendedprice").alias("price")).alias("ordinal"))
    return asof.value_age(events.select("event_id", F.col("user_id").alias("card"), "ts"), changes, "card", "ts", "at", ["amount"], "ordinal")


@query(f"WITH {_CHANGES_SQL} SELECT event_id, amount, round(age_seconds, 6) AS age_seconds FROM aged")
def price_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request with the price that was current then, of changes made of the order lines."""
    return _aged(spark, sf_dir).select("event_id", "amount", F.round("age_seconds", 6).alias("age_seconds"))


@query(f"""WITH {_CHANGES_SQL} SELECT time_bucket(INTERVAL 1 DAY, ts) AS bucket, count(*) AS n, round(avg((age_seconds IS NOT NULL)::INTEGER::DOUBLE), 6) AS known,
  round(quantile_cont(age_seconds / 3600, 0.5), 6) AS p50_age, round(quantile_cont(age_seconds / 3600, 0.95), 6) AS p95_age, round(quantile_cont(age_seconds / 3600, 0.99), 6) AS p99_age FROM aged GROUP BY 1""")
def price_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of the prices shown, by day."""
    out = asof.age_report(_aged(spark, sf_dir), "ts")
    return out.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "n", *[F.round(c, 6).alias(c) for c in ("known", "p50_age", "p95_age", "p99_age")])


@query(f"""WITH {fx.CATALOG_SQL},
updates AS (SELECT CAST(l_partkey AS VARCHAR) AS card_id, l_extendedprice AS amount, 'feed' AS source, l_shipdate + INTERVAL 25 YEAR + to_milliseconds(l_orderkey * 8 + l_linenumber) + to_microseconds(CAST(round(l_extendedprice * 100) AS BIGINT)) AS updated_at FROM lineitem),
both_ AS (SELECT card_id, amount, source, updated_at FROM prices UNION ALL SELECT * FROM updates)
SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY updated_at DESC) = 1""")
def price_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached prices after a feed of four micro-batches, some of it older than what is cached, and a replay of the last."""
    f, path, feed = fx.cards(spark, sf_dir), scratch(spark, "prices"), scratch(spark, "feed")
    writers.create_tables(spark, path)
    bucket_prices(spark, path, 8)
    apply_prices(f.prices, path, "cache", 0)
    at = F.col("l_shipdate").cast("timestamp") + F.make_ym_interval(F.lit(25)) + F.make_dt_interval(secs=(((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000 + F.round(F.col("l_extendedprice") * 100).cast("long")) / 1_000_000).cast("decimal(18,6)"))
    updates = fx.tables(spark, sf_dir, "lineitem")[0].select(F.col("l_partkey").cast("string").alias("card_id"), F.col("l_extendedprice").alias("amount"), F.lit(None).cast("string").alias("currency"), F.lit("feed").alias("source"), at.alias("updated_at"))
    for part in range(4):
        updates.where(F.pmod(F.xxhash64("amount"), F.lit(4)) == part).write.mode("append").parquet(feed)
        refresh_prices(spark.readStream.schema(updates.schema).parquet(feed), path, f"{path}-state", buckets=8).awaitTermination()
    apply_prices(updates.limit(0), path, "prices", 0)  # an epoch of before: passed over
    return readers.stored(spark, path, "card_prices").select("card_id", "amount", "source", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


# Coverage of sets

_NUMBERS_SQL = """
n AS (SELECT DISTINCT p_brand AS set_name, CASE WHEN p_partkey % 10 = 0 THEN 'TG' ELSE '' END AS prefix, CASE WHEN p_partkey % 10 = 0 THEN p_partkey // 10 % 40 ELSE p_partkey % 700 END AS number FROM part)
"""


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    number = F.when(key % 10 == 0, F.concat(F.lit("tg0"), F.expr("p_partkey div 10 % 40").cast("string"))).when(key % 7 == 1, F.concat(F.lit("0"), (key % 700).cast("string"))).otherwise((key % 700).cast("string"))
    return coverage.set_numbers(fx.tables(spark, sf_dir, "part")[0].select(F.col("p_brand").alias("set_name"), number.alias("collector_number"), F.lit("720").alias("printed_total")))


@query(f"""WITH {_NUMBERS_SQL}, marks AS (SELECT * FROM n UNION SELECT DISTINCT set_name, prefix, 0 FROM n UNION SELECT DISTINCT set_name, prefix, 721 FROM n WHERE prefix = ''),
g AS (SELECT set_name, prefix, number + 1 AS first, lead(number) OVER (PARTITION BY set_name, prefix ORDER BY number) - 1 AS last FROM marks)
SELECT set_name, prefix, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last FROM g WHERE first <= last""")
def set_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that each set lacks, as ranges."""
    return coverage.missing_ranges(_numbers(spark, sf_dir))


@query(f"""WITH {_NUMBERS_SQL}, c AS (SELECT set_name, prefix, count(*) FILTER (number > 0) AS present, CASE WHEN prefix = '' THEN greatest(720, max(number)) ELSE max(number) END AS expected FROM n GROUP BY set_name, prefix)
SELECT set_name, prefix, present, CAST(expected AS BIGINT) AS expected, CASE WHEN expected > 0 THEN round(present::DOUBLE / expected, 6) END AS share FROM c""")
def set_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.coverage(_numbers(spark, sf_dir)).withColumn("share", F.round("share", 6))


# Outages

DAY_US = 86_400_000_000
_OUTAGES_SQL = "SELECT ts AS began, ts + INTERVAL 6 HOUR AS ended FROM events WHERE event_type = 'error' AND event_id % 20 = 0"
_LOCAL = f"list_filter(f.kept, lambda x: o.t - x < {DAY_US})"


def _requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = fx.tables(spark, sf_dir, "events")[0]
    outages = events.where("event_type = 'error' AND event_id % 20 = 0").select(F.col("ts").alias("began"), (F.col("ts") + F.expr("INTERVAL '6' HOUR")).alias("ended"))
    return events.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts")), outages


@query(f"""WITH RECURSIVE outages AS ({_OUTAGES_SQL}),
o AS (SELECT event_id, CAST(user_id AS VARCHAR) AS client, epoch_us(ts) AS t, EXISTS (SELECT 1 FROM outages WHERE began <= ts AND ts < ended) AS down, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (
  SELECT event_id, client, t, rn, true AS allowed, CASE WHEN NOT down THEN t END AS opened, CASE WHEN down THEN 0 ELSE 1 END AS n, CASE WHEN down THEN [t] ELSE []::BIGINT[] END AS kept FROM o WHERE rn = 1
  UNION ALL SELECT o.event_id, o.client, o.t, o.rn,
    CASE WHEN o.down THEN len({_LOCAL}) < 2 ELSE CASE WHEN f.opened IS NULL OR o.t - f.opened >= {DAY_US} THEN 1 ELSE f.n + 1 END <= 2 END,
    CASE WHEN o.down OR o.t - f.opened < {DAY_US} THEN f.opened ELSE o.t END,
    CASE WHEN o.down THEN f.n WHEN f.opened IS NULL OR o.t - f.opened >= {DAY_US} THEN 1 ELSE f.n + 1 END,
    CASE WHEN NOT o.down THEN f.kept WHEN len({_LOCAL}) < 2 THEN list_append({_LOCAL}, o.t) ELSE {_LOCAL} END
  FROM f JOIN o ON o.client = f.client AND o.rn = f.rn + 1)
SELECT event_id AS request_id, client, allowed FROM f""")
def admission_failover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission through outages of the shared counter, one after some of the errors."""
    requests, outages = _requests(spark, sf_dir)
    return admission.admit(admission.mark_outages(requests, outages), 2, 86_400, "failover")


@query(SQL["admission_failover"])
def admission_failover_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream of requests that say whether the counter was down."""
    requests, outages = _requests(spark, sf_dir)
    marked = admission.mark_outages(requests, outages)
    month, source, out = scratch(spark, "month"), scratch(spark, "requests"), scratch(spark, "admitted")
    marked.withColumn("_third", F.least(F.floor((F.day("ts") - 1) / 10), F.lit(2)).cast("int")).write.partitionBy("_third").parquet(month)
    thirds = spark.read.schema(f"{marked.schema.toDDL()}, _third int").parquet(month)
    for part in range(3):
        # A third of the month arrives, then the stream takes it and stops: state goes on from where it was.
        thirds.where(F.col("_third") == part).drop("_third").write.mode("append").parquet(source)
        stream = spark.readStream.schema(marked.schema).parquet(source)
        job = admit_stream(stream, 2, 86_400, "failover", "60 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start()
        job.awaitTermination()
    return spark.read.schema("request_id long, client string, allowed boolean").parquet(out)


# Contracts

# The sign of a time is turned where k = 2, which breaks the rule on times only if it is above 0.
_LINES_SQL = """
l AS (SELECT event_id, event_id % 13 AS k, '/cards/' || json_extract_string(props, '$.k') AS path, CASE WHEN event_id % 13 = 2 THEN -value ELSE value END AS total_ms FROM events),
b AS (SELECT *, CASE WHEN k IN (0, 3, 6, 7) THEN 'unreadable' WHEN k = 1 THEN 'missing_method' WHEN k = 8 OR path IS NULL THEN 'missing_path' WHEN total_ms IS NULL THEN 'missing_total_ms'
  WHEN k = 5 THEN 'long_request_id' WHEN k = 4 THEN 'bad_status' WHEN total_ms < 0 THEN 'bad_total_ms' END AS broken FROM l)
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of the events, some of them damaged in ways that the id decides."""
    k, quoted = F.col("event_id") % 13, lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    parts = [
        F.concat(F.lit('"request_id": '), quoted(F.when(k == 5, F.repeat(F.lit("r"), F.lit(100))).otherwise(F.concat(F.lit("r"), F.col("event_id").cast("string"))))),
        F.when(k != 1, F.lit('"method": "GET"')), F.when(k != 8, F.concat(F.lit('"path": "/cards/'), F.get_json_object("props", "$.k"), F.lit('"'))).otherwise('"path": null'),
        F.concat(F.lit('"status": '), F.when(k == 3, '"fine"').when(k == 4, "700").otherwise("200")), F.concat(F.lit('"total_ms": '), F.when(k == 2, -F.col("value")).otherwise(F.col("value")).cast("string")), F.lit('"event": "request_completed"'),
    ]
    whole = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    line = F.when(k == 0, F.substring(whole, 1, 20)).when(k == 7, F.concat(F.lit("["), whole, F.lit("]"))).when(k != 6, whole)
    return fx.tables(spark, sf_dir, "events")[0].select("event_id", line.alias("line"))


@query(f"WITH {_LINES_SQL} SELECT event_id, broken, CASE WHEN broken IS NULL THEN path END AS path, CASE WHEN broken IS NULL THEN total_ms END AS total_ms FROM b")
def log_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log lines that keep their contract, and the first rule that the others break."""
    good, bad = contracts.quarantined(_lines(spark, sf_dir), "line", contracts.REQUEST_LINE)
    return good.select("event_id", F.lit(None).cast("string").alias("broken"), "path", "total_ms").unionByName(bad.select("event_id", "broken"), allowMissingColumns=True)


# Identity of results

_STAGES_SQL = "spent AS (SELECT CAST(l_partkey AS VARCHAR) AS scan_id, round(sum(l_quantity + l_discount), 2) AS processing_ms FROM lineitem GROUP BY 1)"
_HEX = f"sha256(octet_length(encode(a.scan_id)) || ':' || a.scan_id || octet_length(encode(epoch_us(TIMESTAMP '{AS_OF}')::VARCHAR)) || ':' || epoch_us(TIMESTAMP '{AS_OF}'))"
_UUID_SQL = f"(SELECT concat_ws('-', h[1:8], h[9:12], '8' || h[14:16], substr('89ab', CAST((instr('0123456789abcdef', h[17]) - 1) % 4 + 1 AS INTEGER), 1) || h[18:20], h[21:32]) FROM (SELECT {_HEX} AS h))"


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, engine = fx.cards(spark, sf_dir), Engine()
    stages = fx.tables(spark, sf_dir, "lineitem")[0].select(F.col("l_partkey").cast("string").alias("scan_id"), F.col("l_linenumber").cast("string").alias("stage"), (F.col("l_quantity") + F.col("l_discount")).alias("ms"))
    return enrichment.identified(engine.responses(f.scans, f.catalog, f.prices), stages, _AS_OF_COLUMN())


_CARD_JSON = """{{'card_id': c.card_id, 'name': c.name, 'set_name': c.set_name, 'collector_number': c.collector_number, 'printed_total': c.printed_total, 'rarity': c.rarity, 'language': c.language, 'image_url': c.image_url, 'marketplace_url': c.marketplace_url,
  'price': {{'amount': p.amount, 'currency': coalesce(p.currency, 'USD'), 'source': p.source, 'updated_at': strftime(p.updated_at, '%Y-%m-%dT%H:%M:%SZ')}}}}""".replace("{{", "{").replace("}}", "}")


@query(f"""WITH {fx.SCORE_SQL}, {_STAGES_SQL},
cards AS (SELECT c.card_id, {_CARD_JSON} AS card FROM catalog c LEFT JOIN prices p USING (card_id)),
listed AS (SELECT r.scan_id, list({{'card': card, 'confidence': r.confidence}} ORDER BY r.rank) AS candidates FROM ranked r JOIN cards USING (card_id) WHERE r.rank <= 3 GROUP BY 1)
SELECT a.scan_id, CAST(to_json({{'recognition_id': {_UUID_SQL}, 'status': a.status, 'card': c.card, 'confidence': a.confidence, 'candidates': coalesce(l.candidates, []), 'processing_ms': coalesce(s.processing_ms, 0::DOUBLE),
  'message': CASE a.status WHEN 'ambiguous' THEN '{decision.MESSAGES["ambiguous"]}' WHEN 'unrecognized' THEN '{decision.MESSAGES["unrecognized"]}' END}}) AS VARCHAR) AS response
FROM answers a LEFT JOIN cards c ON c.card_id = a.card_id LEFT JOIN listed l ON l.scan_id = a.scan_id LEFT JOIN spent s ON s.scan_id = a.scan_id""")
def response_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole responses as callers get them: JSON text with identity, stage times summed, and the candidates."""
    return enrichment.wire(_responses(spark, sf_dir))


@query(f"""WITH {fx.SCORE_SQL}, {_STAGES_SQL} SELECT {_UUID_SQL} AS recognition_id, a.scan_id, a.status, a.card_id, coalesce(s.processing_ms, 0::DOUBLE) AS processing_ms FROM answers a LEFT JOIN spent s USING (scan_id)""")
def results_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the table of results holds after the same run was added twice."""
    path = scratch(spark, "results")
    writers.create_tables(spark, path)
    rows = _responses(spark, sf_dir).select("recognition_id", "scan_id", "status", "confidence", F.col("card.card_id").alias("card_id"), "processing_ms", "created_at")
    for _ in range(2):
        writers.append_once(rows, path, "recognition_results")
    return readers.stored(spark, path, "recognition_results").select("recognition_id", "scan_id", "status", "card_id", "processing_ms")


@query(f"""WITH {fx.SCORE_SQL} SELECT a.scan_id, a.card_id, a.confidence, CASE WHEN CAST(a.scan_id AS BIGINT) % 3 = 1 THEN 'other' END AS correct_card_id FROM answers a WHERE a.status = 'matched' AND CAST(a.scan_id AS BIGINT) % 3 > 0""")
def wrong_confident_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored matches joined with what users said about them by the results' own ids."""
    path = scratch(spark, "results")
    writers.create_tables(spark, path)
    writers.append_once(_responses(spark, sf_dir).select("recognition_id", "scan_id", "status", "confidence", F.col("card.card_id").alias("card_id"), "processing_ms", "created_at"), path, "recognition_results")
    results, key = readers.stored(spark, path, "recognition_results"), F.col("scan_id").cast("long") % 3
    said = results.select("recognition_id", F.col("card_id").alias("predicted_card_id"), F.when(key == 1, "other").alias("correct_card_id"), (key == 0).alias("is_correct"))
    writers.append_feedback(said, path, _AS_OF_COLUMN())
    return quality.wrong_confident(readers.stored(spark, path, "recognition_feedback"), results).select("scan_id", "card_id", "confidence", "correct_card_id")


# Intake, endpoints and readers

_INTAKE_SQL = """
u AS (SELECT o_orderkey AS upload_id, CASE o_orderkey % 5 WHEN 0 THEN 'IMAGE/JPEG' WHEN 1 THEN 'image/png' WHEN 2 THEN 'text/plain' ELSE 'image/webp' END AS mime,
  CAST(o_orderkey % 6000 + 100 AS INTEGER) AS width, CAST(o_custkey % 6000 + 200 AS INTEGER) AS height, o_orderkey % 3 AS plausible, (o_orderkey % 70)::DOUBLE AS blur FROM orders),
c AS (SELECT upload_id, CASE WHEN mime = 'text/plain' OR least(width, height) < 320 THEN 'invalid_image' WHEN width::BIGINT * height > 24000000 THEN 'image_too_large' WHEN plausible > 1 THEN 'multiple_cards'
  WHEN plausible = 0 AND NOT least(width, height)::DOUBLE / greatest(width, height) BETWEEN 0.62 AND 0.78 THEN 'card_not_found' WHEN blur < 34 THEN 'image_too_blurry' END AS code FROM u)
"""


@query(f"WITH {_INTAKE_SQL} SELECT upload_id, code, CASE WHEN code IS NULL THEN 200 ELSE 422 END AS http_status FROM c")
def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads through validation and location: what may be read, and why the rest may not."""
    k = F.col("o_orderkey")
    mime = F.when(k % 5 == 0, "IMAGE/JPEG").when(k % 5 == 1, "image/png").when(k % 5 == 2, "text/plain").otherwise("image/webp")
    received = fx.tables(spark, sf_dir, "orders")[0].select(
        k.alias("upload_id"), mime.alias("mime"), F.lit(1000).cast("long").alias("size"), F.lit("JPEG").alias("fmt"), (k % 6000 + 100).cast("int").alias("width"), (F.col("o_custkey") % 6000 + 200).cast("int").alias("height"),
        F.lit(True).alias("readable"), (k % 3).alias("plausible"), (k % 70).cast("double").alias("blur"),
    )
    good, refused = Engine().intake(received)
    return good.select("upload_id", F.lit(None).cast("string").alias("code"), F.lit(200).alias("http_status")).unionByName(refused.select("upload_id", "code", "http_status"))


@query("SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, (l_quantity / 40 + l_discount * 10) / 2)), 6) AS quality FROM lineitem")
def reading_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of a reading from the confidences of its name and number, some of them beyond their range."""
    quality_ = evidence.ocr_quality(F.col("l_quantity") / 40, F.col("l_discount") * 10)
    return fx.tables(spark, sf_dir, "lineitem")[0].select("l_orderkey", "l_linenumber", F.round(quality_, 6).alias("quality"))


@query(f"WITH {fx.CATALOG_SQL} SELECT e.event_id AS request_id, c.name, p.amount, coalesce(p.currency, 'USD') AS currency FROM events e JOIN catalog c ON c.card_id = CAST(e.event_id % 300 AS VARCHAR) LEFT JOIN prices p ON p.card_id = c.card_id WHERE e.event_type = 'view'")
def card_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for cards by id, some for unknown ones."""
    f, events = fx.cards(spark, sf_dir), fx.tables(spark, sf_dir, "events")[0]
    asked = events.where("event_type = 'view'").select(F.col("event_id").alias("request_id"), (F.col("event_id") % 300).cast("string").alias("card_id"))
    return endpoints.cards(asked, f.catalog, f.prices).select("request_id", "card.name", "card.price.amount", "card.price.currency")


@query(f"WITH {fx.CATALOG_SQL} SELECT e.event_id AS request_id, c.card_id, p.amount, p.source FROM events e JOIN catalog c ON c.card_id = CAST(e.event_id % 300 AS VARCHAR) LEFT JOIN prices p ON p.card_id = c.card_id WHERE e.event_type = 'click'")
def price_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for prices by card."""
    f, events = fx.cards(spark, sf_dir), fx.tables(spark, sf_dir, "events")[0]
    asked = events.where("event_type = 'click'").select(F.col("event_id").alias("request_id"), (F.col("event_id") % 300).cast("string").alias("card_id"))
    return endpoints.prices_of(asked, f.catalog, f.prices).select("request_id", "card_id", "price.amount", "price.source")


@query("""WITH m AS (SELECT CAST(p_partkey AS VARCHAR) AS card, unnest(CASE WHEN p_partkey % 6 = 0 THEN ['dim', 'glare'] WHEN p_partkey % 6 < 3 THEN ['dim'] ELSE ['sleeve'] END) AS condition, p_partkey % 4 <> 0 AS consented FROM part)
SELECT condition, count(*) AS photos, count(DISTINCT card) AS cards, count(*) FILTER (consented) AS consented FROM m GROUP BY 1""")
def manifest_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos of a benchmark manifest by capture condition; the manifest is written as JSON lines and read by its shape."""
    key, path = F.col("p_partkey"), scratch(spark, "manifest")
    conditions = F.when(key % 6 == 0, F.array(F.lit("dim"), F.lit("glare"))).when(key % 6 < 3, F.array(F.lit("dim"))).otherwise(F.array(F.lit("sleeve")))
    part = fx.tables(spark, sf_dir, "part")[0]
    part.select(F.concat(F.lit("photos/"), key.cast("string")).alias("path"), key.cast("string").alias("expected_card_id"), conditions.alias("conditions"), F.when(key % 4 != 0, "signed").alias("consent"), F.lit(1).alias("unknown")).write.json(path)
    rows = readers.manifest(spark, path).select("expected_card_id", "consent", F.explode("conditions").alias("condition"))
    return rows.groupBy("condition").agg(F.count("*").alias("photos"), F.count_distinct("expected_card_id").alias("cards"), F.count("consent").alias("consented"))


@query("SELECT event_type AS path, count(*) AS n, round(quantile_cont(value, 0.95), 6) AS p95, count(*) FILTER (event_id % 10 = 0) AS failed FROM events GROUP BY 1")
def request_log_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log as stored JSON lines: latency and failures by path."""
    path = scratch(spark, "log")
    events = fx.tables(spark, sf_dir, "events")[0]
    events.select(F.col("event_id").cast("string").alias("request_id"), F.lit("GET").alias("method"), F.col("event_type").alias("path"), F.when(F.col("event_id") % 10 == 0, 500).otherwise(200).alias("http_status"), F.col("value").alias("ms"), F.col("ts").cast("timestamp").alias("ts")).write.json(path)
    log = readers.request_log(spark, path)
    return log.groupBy("path").agg(F.count("*").alias("n"), F.round(F.percentile("ms", F.lit(0.95)), 6).alias("p95"), F.count_if(F.col("http_status") >= 500).alias("failed"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate - INTERVAL 2 HOUR WHEN 1 THEN o_orderdate WHEN 2 THEN o_orderdate + INTERVAL 5 HOUR END AS at FROM orders""")
def import_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO times with an offset, in UTC, as local clocks five hours behind show them, and texts that are none."""
    day, k = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(day, F.lit("+02:00"))).when(k == 1, F.concat(day, F.lit("Z"))).when(k == 2, day).otherwise("no time")
    return fx.tables(spark, sf_dir, "orders")[0].select("o_orderkey", display.iso_instant(text, "-05:00").cast("timestamp_ntz").alias("at"))
