"""Registered queries with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import display, geometry, text, vectors
from matchloom.operators import admission, blocking, catalog, ctc, decision, enrichment, evidence, metric, quality, uploads
from matchloom.plans import fixtures as fx
from matchloom.plans.engine import Engine, written
from matchloom.plans.options import Options
from matchloom.registry import QUERIES, SQL, query
from matchloom.sources.scratch import scratch

AS_OF = "2024-02-01 00:00:00"


def _read(spark: SparkSession, sf_dir: str) -> tuple[fx.Fixture, DataFrame]:
    f = fx.cards(spark, sf_dir)
    return f, Engine().read(f.scans)


# Text keys


@query(f"WITH {fx.READ_SQL} SELECT scan_id, obs_name FROM read")
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir)[1].select("scan_id", "obs_name")


@query(f"WITH {fx.READ_SQL} SELECT scan_id, obs_number FROM read")
def normalize_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir)[1].select("scan_id", "obs_number")


@query(r"SELECT doc_id, md5(replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss')) AS folded_md5 FROM documents")
def folded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NFKC, white space and case folding over whole documents."""
    x = text.casefold(text.strip(F.regexp_replace(text.nfkc(F.col("text")), r"(?U)\s+", " ")))
    return fx.tables(spark, sf_dir, "documents")[0].select("doc_id", F.md5(x).alias("folded_md5"))


_PAIRS = "SELECT p_partkey, p_size, p_name, lead(p_size, 1, 1) OVER (ORDER BY p_partkey) AS next_size, lead(p_name, 1, '') OVER (ORDER BY p_partkey) AS next_name FROM part"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fx.tables(spark, sf_dir, "part")[0].select("p_partkey", "p_size", "p_name")
    following = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_size").alias("next_size"), F.col("p_name").alias("next_name"))
    return part.join(following, "p_partkey", "left").select("p_partkey", "p_size", "p_name", F.coalesce("next_size", F.lit(1)).alias("next_size"), F.coalesce("next_name", F.lit("")).alias("next_name"))


@query(f"""SELECT p_partkey, CASE WHEN a = b THEN 1::DOUBLE WHEN contains(a, b) OR contains(b, a) THEN 0.72::DOUBLE ELSE 0::DOUBLE END AS similarity
FROM (SELECT p_partkey, CAST(p_size AS VARCHAR) AS a, CAST(next_size AS VARCHAR) AS b FROM ({_PAIRS}))""")
def collector_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.lpad(F.col("next_size").cast("string"), 4, "0")
    return _pairs(spark, sf_dir).select("p_partkey", text.collector_similarity(F.col("p_size").cast("string"), padded).alias("similarity"))


@query(f"""SELECT p_partkey, CASE WHEN p_name = next_name THEN 1::DOUBLE WHEN next_name = '' THEN 0::DOUBLE
  ELSE len(list_intersect(string_split(p_name, ' '), string_split(next_name, ' ')))::DOUBLE / 2 END AS similarity FROM ({_PAIRS})""")
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("p_partkey", text.name_similarity(F.col("p_name"), F.col("next_name")).alias("similarity"))


# Recognition


@query(f"WITH {fx.BLOCK_SQL} SELECT scan_id, card_id, CAST(retrieval_rank AS INTEGER) AS retrieval_rank FROM blocked")
def block_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, read = _read(spark, sf_dir)
    return blocking.block(written(read.drop("embedding")), f.catalog, Options().candidate_limit)


_EVIDENCE = "scan_id, card_id, number_score, round(name_score, 6) AS name_score, round(artwork_score, 6) AS artwork_score, confidence"


@query(f"WITH {fx.SCORE_SQL} SELECT {_EVIDENCE} FROM scored")
def score_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, read = _read(spark, sf_dir)
    read = written(read)
    scored = evidence.gather(blocking.block(read, f.catalog), read, f.catalog)
    return scored.select("scan_id", "card_id", "number_score", F.round("name_score", 6).alias("name_score"), F.round("artwork_score", 6).alias("artwork_score"), "confidence")


@query(f"WITH {fx.SCORE_SQL} SELECT scan_id, card_id, CAST(rank AS INTEGER) AS rank, confidence, round(confidence - runner_up, 6) AS margin FROM ranked")
def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.cards(spark, sf_dir)
    return Engine().ranked(f.scans, f.catalog).select("scan_id", "card_id", "rank", "confidence", F.round(F.col("confidence") - F.col("runner_up"), 6).alias("margin"))


@query(f"WITH {fx.SCORE_SQL} SELECT scan_id, status, confidence, top_card_id FROM decided")
def classify_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.cards(spark, sf_dir)
    return decision.decide(f.scans, Engine().ranked(f.scans, f.catalog)).select("scan_id", "status", "confidence", "top_card_id")


@query(f"WITH {fx.SCORE_SQL} SELECT a.scan_id, a.status, a.confidence, a.card_id, p.amount, CASE a.status WHEN 'ambiguous' THEN '{decision.MESSAGES['ambiguous']}' WHEN 'unrecognized' THEN '{decision.MESSAGES['unrecognized']}' END AS message FROM answers a LEFT JOIN prices p USING (card_id)")
def recognize_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: scans to decisions with prices."""
    f = fx.cards(spark, sf_dir)
    return Engine().recognize(f.scans, f.catalog, f.prices).select("scan_id", "status", "confidence", "card_id", "amount", "message")


@query(f"WITH {fx.SCORE_SQL} SELECT r.scan_id, CAST(r.rank AS INTEGER) AS rank, r.card_id, r.confidence, p.amount, coalesce(p.currency, 'USD') AS currency FROM ranked r LEFT JOIN prices p USING (card_id) WHERE r.rank <= 3")
def top3_priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.cards(spark, sf_dir)
    return enrichment.top_priced(Engine().ranked(f.scans, f.catalog), f.prices).select("scan_id", "rank", "card_id", "confidence", "amount", "currency")


@query(f"""WITH {fx.SCORE_SQL} SELECT a.scan_id, a.status, c.name AS card_name, p.amount AS card_amount, CAST(coalesce(len(a.top3), 0) AS INTEGER) AS n_candidates,
  coalesce(array_to_string(a.top3, ','), '') AS candidate_ids FROM answers a LEFT JOIN catalog c ON c.card_id = a.card_id LEFT JOIN prices p ON p.card_id = a.card_id""")
def response_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested response, flattened again."""
    ids = F.array_join(F.transform("candidates", lambda c: c["card"]["card_id"]), ",")
    f = fx.cards(spark, sf_dir)
    nested = Engine().responses(f.scans, f.catalog, f.prices)
    return nested.select("scan_id", "status", F.col("card.name").alias("card_name"), F.col("card.price.amount").alias("card_amount"), F.size("candidates").alias("n_candidates"), ids.alias("candidate_ids"))


@query(f"WITH {fx.CATALOG_SQL} SELECT c.card_id, c.name, c.set_name, c.collector_number, c.rarity, p.amount, coalesce(p.currency, 'USD') AS currency FROM catalog c LEFT JOIN prices p USING (card_id)")
def card_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every card with its price, as looked up one by one."""
    f = fx.cards(spark, sf_dir)
    return enrichment.with_prices(f.catalog, f.prices).select("card_id", "name", "set_name", "collector_number", "rarity", "amount", "currency")


@query(f"WITH {fx.CATALOG_SQL} SELECT c.card_id, p.amount, coalesce(p.currency, 'USD') AS currency, p.source, p.updated_at FROM catalog c LEFT JOIN prices p USING (card_id)")
def price_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.cards(spark, sf_dir)
    return enrichment.with_prices(f.catalog.select("card_id"), f.prices).select("card_id", "amount", "currency", "source", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query(f"WITH {fx.CATALOG_SQL} SELECT c.card_id, CASE WHEN p.updated_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY THEN p.amount END AS amount FROM catalog c LEFT JOIN prices p USING (card_id)")
def price_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.cards(spark, sf_dir)
    return enrichment.with_prices(f.catalog.select("card_id"), f.prices, 30, F.lit(AS_OF).cast("timestamp")).select("card_id", "amount")


# Catalog import

_RECORDS_SQL = """
records AS (
  SELECT p_partkey + 1 AS key, 0 AS ordinal, 'first' AS set_name, p_retailprice * 2 AS price, p_partkey % 3 = 0 AS has_price FROM part
  UNION ALL SELECT p_partkey + 1, 1, 'second', p_retailprice * 3, p_partkey % 2 = 0 FROM part WHERE p_size > 25),
latest AS (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY key ORDER BY ordinal DESC) = 1),
latest_priced AS (SELECT * FROM records WHERE has_price QUALIFY row_number() OVER (PARTITION BY key ORDER BY ordinal DESC) = 1)
"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fx.tables(spark, sf_dir, "part")[0]
    one = part.select((F.col("p_partkey") + 1).cast("string").alias("card_id"), F.lit(0).alias("ordinal"), F.lit("first").alias("set_name"), (F.col("p_retailprice") * 2).alias("amount"), (F.col("p_partkey") % 3 == 0).alias("has"))
    two = part.where("p_size > 25").select((F.col("p_partkey") + 1).cast("string").alias("card_id"), F.lit(1).alias("ordinal"), F.lit("second").alias("set_name"), (F.col("p_retailprice") * 3).alias("amount"), (F.col("p_partkey") % 2 == 0).alias("has"))
    price = F.when(F.col("has"), F.struct("amount", F.lit(None).cast("string").alias("currency"), F.lit("file").alias("source"), F.lit(None).cast("timestamp").alias("updated_at")))
    return one.unionByName(two).select("card_id", "ordinal", "set_name", price.alias("price"))


@query(f"""WITH {_RECORDS_SQL}, old AS (SELECT p_partkey AS key, p_brand AS set_name FROM part)
SELECT CAST(key AS VARCHAR) AS card_id, set_name FROM old WHERE key NOT IN (SELECT key FROM latest) UNION ALL SELECT CAST(key AS VARCHAR), set_name FROM latest""")
def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = fx.tables(spark, sf_dir, "part")[0].select(F.col("p_partkey").cast("string").alias("card_id"), F.col("p_brand").alias("set_name"))
    return catalog.upsert_cards(old, _records(spark, sf_dir).drop("price"))


@query(f"""WITH {fx.CATALOG_SQL}, {_RECORDS_SQL}
SELECT card_id, amount, currency, source, updated_at FROM prices WHERE card_id NOT IN (SELECT CAST(key AS VARCHAR) FROM latest_priced)
UNION ALL SELECT CAST(key AS VARCHAR), price, 'USD', 'file', TIMESTAMP '{AS_OF}' FROM latest_priced""")
def price_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.cards(spark, sf_dir)
    out = catalog.upsert_prices(f.prices, _records(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))
    return out.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query("""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name END AS name, 'm' || (p_partkey // 2) AS marketplace_id,
  CASE WHEN p_partkey % 7 = 0 THEN 'ftp://x' ELSE 'https://x.invalid/a' END AS url FROM part)
SELECT * FROM (SELECT 'missing_name' AS rule, count(*) AS n FROM r WHERE name IS NULL
UNION ALL SELECT 'bad_reference_image_url', count(*) FROM r WHERE url LIKE 'ftp%'
UNION ALL SELECT 'repeated_marketplace_id', count(*) FROM (SELECT marketplace_id FROM r GROUP BY 1 HAVING count(*) > 1)) WHERE n > 0""")
def catalog_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fx.tables(spark, sf_dir, "part")[0]
    key = F.col("p_partkey")
    records = part.select(
        key.cast("string").alias("id"), F.when(key % 11 == 0, None).otherwise(F.col("p_name")).alias("name"), F.col("p_name").alias("normalized_name"), F.col("p_size").cast("string").alias("collector_number"),
        F.col("p_brand").alias("set_name"), F.when(key % 7 == 0, "ftp://x").otherwise("https://x.invalid/a").alias("reference_image_url"), F.concat(F.lit("m"), F.floor(key / 2).cast("string")).alias("marketplace_id"),
        F.lit("https://x.invalid/b").alias("marketplace_url"), F.array(F.lit(1.0).cast("float")).alias("visual_embedding"),
    )
    return catalog.broken_rules(records, dimensions=1)


@query("SELECT vec_id, CAST(len(embedding) * 4 AS INTEGER) AS n_bytes, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def embedding_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors to bytes and back."""
    stored = fx.tables(spark, sf_dir, "embeddings")[0].select("vec_id", vectors.encode_floats(vectors.as_floats(F.col("embedding"))).alias("b"))
    back = stored.select("vec_id", F.octet_length("b").alias("n_bytes"), vectors.decode_floats("b").alias("v"))
    return back.select("vec_id", "n_bytes", F.round(F.aggregate(vectors.doubles(F.col("v")), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


# Feedback, requests, admission

_FEEDBACK_SQL = """
feedback AS (
  SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'short' ELSE rpad(CAST(event_id AS VARCHAR), 36, '-') END AS recognition_id,
    CASE WHEN event_id % 17 = 0 THEN repeat('9', 65) ELSE CAST(user_id AS VARCHAR) END AS predicted_card_id,
    CASE WHEN event_id % 19 = 0 THEN NULL ELSE event_id % 2 = 0 END AS is_correct
  FROM events WHERE event_type IN ('signup', 'error'))
"""


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = fx.tables(spark, sf_dir, "events")[0].where(F.col("event_type").isin("signup", "error")), F.col("event_id")
    return e.select(
        i,
        F.when(i % 13 == 0, "short").otherwise(F.rpad(i.cast("string"), 36, "-")).alias("recognition_id"),
        F.when(i % 17 == 0, F.repeat(F.lit("9"), F.lit(65))).otherwise(F.col("user_id").cast("string")).alias("predicted_card_id"),
        F.lit(None).cast("string").alias("correct_card_id"),
        F.when(i % 19 == 0, None).otherwise(i % 2 == 0).alias("is_correct"),
    )


@query(f"WITH {_FEEDBACK_SQL} SELECT event_id, coalesce(length(recognition_id) = 36 AND length(predicted_card_id) <= 64 AND is_correct IS NOT NULL, false) AS valid FROM feedback")
def feedback_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads.feedback_valid(_feedback(spark, sf_dir)).select("event_id", "valid")


@query(f"WITH {_FEEDBACK_SQL} SELECT recognition_id, predicted_card_id, is_correct FROM feedback WHERE length(recognition_id) = 36 AND length(predicted_card_id) <= 64 AND is_correct IS NOT NULL")
def feedback_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a feedback table holds after an append."""
    from matchloom.sources import readers, writers

    path = scratch(spark, "feedback")
    writers.create_tables(spark, path)
    writers.append_feedback(_feedback(spark, sf_dir).drop("event_id"), path, F.lit(AS_OF).cast("timestamp"))
    return readers.stored(spark, path, "recognition_feedback").select("recognition_id", "predicted_card_id", "is_correct")


DAY_US = 86_400_000_000
_ORDERED = "SELECT event_id, CAST(user_id AS VARCHAR) AS client, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.tables(spark, sf_dir, "events")[0].select(F.col("event_id").alias("request_id"), F.col("user_id").alias("client"), "ts")


@query(f"""WITH RECURSIVE o AS ({_ORDERED}), f AS (
  SELECT event_id, client, t, rn, true AS allowed, [t] AS kept FROM o WHERE rn = 1
  UNION ALL SELECT o.event_id, o.client, o.t, o.rn, len(list_filter(f.kept, lambda x: o.t - x < {DAY_US})) < 2,
    CASE WHEN len(list_filter(f.kept, lambda x: o.t - x < {DAY_US})) < 2 THEN list_append(list_filter(f.kept, lambda x: o.t - x < {DAY_US}), o.t) ELSE list_filter(f.kept, lambda x: o.t - x < {DAY_US}) END
  FROM f JOIN o ON o.client = f.client AND o.rn = f.rn + 1)
SELECT event_id AS request_id, client, allowed FROM f""")
def admission_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.admit(_requests(spark, sf_dir), 2, 86_400, "sliding")


@query(f"""WITH RECURSIVE o AS ({_ORDERED}), f AS (
  SELECT event_id, client, t, rn, t AS opened, 1 AS n FROM o WHERE rn = 1
  UNION ALL SELECT o.event_id, o.client, o.t, o.rn, CASE WHEN o.t - f.opened >= {DAY_US} THEN o.t ELSE f.opened END, CASE WHEN o.t - f.opened >= {DAY_US} THEN 1 ELSE f.n + 1 END
  FROM f JOIN o ON o.client = f.client AND o.rn = f.rn + 1)
SELECT event_id AS request_id, client, n <= 2 AS allowed FROM f""")
def admission_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.admit(_requests(spark, sf_dir), 2, 86_400, "fixed")


@query(SQL["admission_sliding"])
def admission_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sliding log as a stream over the events, run until all are taken."""
    from matchloom.streaming.admission import admit_stream

    events = fx.tables(spark, sf_dir, "events")[0]
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    requests = stream.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    out = scratch(spark, "admitted")
    job = admit_stream(requests, 2, 86_400, "sliding").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema("request_id long, client string, allowed boolean").parquet(out)


# Sequences and vectors

_CHARS = ctc.NUMBER_CHARSET
_STEPS_SQL = """
steps AS (SELECT vec_id, t, list_slice(embedding::DOUBLE[], 8 * t + 1, 8 * t + 8) AS v FROM embeddings, range(8) r(t)),
best AS (SELECT vec_id, t, list_position(v, list_max(v)) - 1 AS i, 1 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))) AS p FROM steps)
"""


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors.doubles(F.col("embedding"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice(v, t * 8 + 1, F.lit(8)))
    return fx.tables(spark, sf_dir, "embeddings")[0].select(F.col("vec_id").alias("seq_id"), rows.alias("logits"))


@query(f"""WITH {_STEPS_SQL}, prev AS (SELECT *, lag(i, 1, -1) OVER (PARTITION BY vec_id ORDER BY t) AS b FROM best)
SELECT vec_id AS seq_id, coalesce(string_agg(substr('{_CHARS}', CAST(i + 1 AS INTEGER), 1), '' ORDER BY t) FILTER (i <> 0 AND i <> b), '') AS text,
  round(coalesce(avg(p) FILTER (i <> 0 AND i <> b), 0), 6) AS confidence FROM prev GROUP BY vec_id""")
def ctc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctc.decode(_logits(spark, sf_dir), _CHARS).withColumn("confidence", F.round("confidence", 6))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS top, round(1 / list_sum(list_transform(embedding::DOUBLE[], lambda x: exp(x - list_max(embedding::DOUBLE[])))), 6) AS top_share FROM embeddings")
def softmax_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors.doubles(F.col("embedding"))
    return fx.tables(spark, sf_dir, "embeddings")[0].select("vec_id", vectors.argmax(v).alias("top"), F.round(F.array_max(vectors.softmax(v)), 6).alias("top_share"))


@query(f"WITH {fx.SCORE_SQL} SELECT scan_id, card_id, round(artwork_score, 6) AS artwork_score FROM parts")
def cosine_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_evidence(spark, sf_dir).select("scan_id", "card_id", "artwork_score")


@query("SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS length, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first_part FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS e FROM embeddings)")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    tripled = fx.tables(spark, sf_dir, "embeddings")[0].select("vec_id", F.transform(vectors.doubles(F.col("embedding")), lambda x: x * 3).alias("e"))
    return tripled.select("vec_id", F.round(vectors.norm(F.col("e")), 6).alias("length"), F.round(F.get(vectors.l2_normalized(F.col("e")), F.lit(0)), 6).alias("first_part"))


@query("""WITH p AS (SELECT a.vec_id, max(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) FILTER (a.label = b.label AND a.vec_id <> b.vec_id) AS positive,
  min(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) FILTER (a.label <> b.label) AS negative FROM embeddings a CROSS JOIN embeddings b GROUP BY a.vec_id)
SELECT round(avg(greatest(positive - negative + 0.2::DOUBLE, 0)), 6) AS loss, count(*) AS n_rows FROM p WHERE positive IS NOT NULL AND negative IS NOT NULL""")
def triplet_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric.triplet_loss(fx.tables(spark, sf_dir, "embeddings")[0], "vec_id", "embedding", "label").withColumn("loss", F.round("loss", 6))


# Metrics


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with the expected card (none for scans without keys), three candidates and a slice."""
    f = fx.cards(spark, sf_dir)
    ranked = Engine().ranked(f.scans, f.catalog)
    top3 = ranked.where("rank <= 3").groupBy("scan_id").agg(F.collect_list("card_id").alias("top3"))
    answers = decision.decide(f.scans, ranked).join(top3, "scan_id", "left").join(f.scans.select("scan_id", "expected", "k"), "scan_id")
    return answers.select("scan_id", "status", "top_card_id", "confidence", "top3", F.when(F.col("k") != 30, F.col("expected")).alias("expected"), (F.col("k") % 4).alias("slice"), "k")


_RESULTS_SQL = fx.SCORE_SQL + ", results AS (SELECT *, CASE WHEN k <> 30 THEN expected END AS truth, k % 4 AS slice, coalesce(top_card_id = CASE WHEN k <> 30 THEN expected END, false) AS good FROM answers)"
_METRICS = """count(*) AS n, round(avg(CASE WHEN truth IS NOT NULL AND status <> 'unrecognized' THEN good::INTEGER::DOUBLE END), 6) AS top1,
  round(avg(CASE WHEN truth IS NOT NULL AND status = 'ambiguous' THEN coalesce(list_contains(top3, truth), false)::INTEGER::DOUBLE END), 6) AS top3_recall,
  round(avg((status = 'matched' AND NOT good)::INTEGER::DOUBLE), 6) AS false_confident, round(avg(CASE WHEN truth IS NULL THEN (status = 'unrecognized')::INTEGER::DOUBLE END), 6) AS rejection"""


@query(f"WITH {_RESULTS_SQL} SELECT slice, {_METRICS} FROM results GROUP BY slice")
def accuracy_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = quality.accuracy(_results(spark, sf_dir), ["slice"])
    return m.select("slice", "n", *[F.round(c, 6).alias(c) for c in ("top1", "top3_recall", "false_confident", "rejection")])


_DIMENSIONS_SQL = _RESULTS_SQL + ", conditions AS (SELECT *, CAST(k % 4 AS VARCHAR) AS layout, CAST(k % 3 AS VARCHAR) AS light, CAST(k % 5 AS VARCHAR) AS sleeve FROM results)"


@query(f"""WITH {_DIMENSIONS_SQL}, g AS (SELECT CAST(GROUPING_ID(layout, light, sleeve) AS BIGINT) AS grouping_id, layout, light, sleeve, {_METRICS} FROM conditions GROUP BY GROUPING SETS ((), (layout), (light), (sleeve), (layout, light)))
SELECT grouping_id, CASE grouping_id WHEN 3 THEN 'layout' WHEN 5 THEN 'light' WHEN 6 THEN 'sleeve' WHEN 1 THEN 'layout+light' END AS dimension, layout, light, sleeve, n, top1, top3_recall, false_confident, rejection,
  coalesce((SELECT top1 FROM g WHERE grouping_id = 7) - top1 <= 0.05::DOUBLE, true) AS slice_ok FROM g""")
def accuracy_all_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and the gate for every slice of three capture conditions, and of two of them together."""
    conditions = _results(spark, sf_dir).withColumns({"layout": F.col("k") % 4, "light": F.col("k") % 3, "sleeve": F.col("k") % 5})
    m = quality.slice_report(conditions, ["layout", "light", "sleeve"], [("layout", "light")])
    return m.select("grouping_id", "dimension", "layout", "light", "sleeve", "n", *[F.round(c, 6).alias(c) for c in ("top1", "top3_recall", "false_confident", "rejection")], "slice_ok")


@query(f"""WITH {_RESULTS_SQL}, t AS (SELECT CASE WHEN truth IS NULL THEN 'negative' WHEN good THEN 'positive_right' ELSE 'positive_wrong' END AS truth, status FROM results)
SELECT coalesce(truth, 'total') AS truth, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'unrecognized') AS unrecognized, count(*) AS total
FROM t GROUP BY GROUPING SETS ((), (truth))""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.confusion_matrix(_results(spark, sf_dir))


@query(f"WITH {_RESULTS_SQL} SELECT truth IS NOT NULL AS positive, status, good AS top1_right, count(*) AS n FROM results GROUP BY ALL")
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.confusion(_results(spark, sf_dir))


@query(f"""WITH {_RESULTS_SQL}, o AS (SELECT {_METRICS} FROM results), s AS (SELECT slice, {_METRICS} FROM results GROUP BY slice)
SELECT false_confident <= 0.002 AS false_confident_ok, top1 >= 0.97 AS top1_ok, rejection >= 0.95 AS rejection_ok, (SELECT quantile_cont(value, 0.95) FROM events) <= 1000 AS p95_ok,
  top1 - (SELECT min(top1) FROM s) <= 0.05 AS slices_ok FROM o""")
def promotion_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _results(spark, sf_dir)
    p95 = fx.tables(spark, sf_dir, "events")[0].agg(F.percentile("value", F.lit(0.95)).alias("p95"))
    return quality.gates(quality.accuracy(results), quality.accuracy(results, ["slice"]), p95)


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, count(*) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.latency(fx.tables(spark, sf_dir, "events")[0], ["event_type"], "value")
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")], "n")


_STATUS_SQL = "CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 500 WHEN event_type = 'error' THEN 422 WHEN event_type = 'signup' THEN 429 ELSE 200 END"


@query(f"""SELECT time_bucket(INTERVAL 1 DAY, ts) AS bucket, count(*) AS n, round(avg((s >= 500)::INTEGER::DOUBLE), 6) AS error_rate, round(avg((s = 422)::INTEGER::DOUBLE), 6) AS rejected_rate, count(*) FILTER (s = 429) AS refused
FROM (SELECT ts, {_STATUS_SQL} AS s FROM events) GROUP BY 1""")
def ops_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.tables(spark, sf_dir, "events")[0].withColumn("http_status", F.expr(_STATUS_SQL))
    out = quality.operating_mix(events)
    return out.select("bucket", "n", F.round("error_rate", 6).alias("error_rate"), F.round("rejected_rate", 6).alias("rejected_rate"), "refused")


@query("SELECT event_type AS stage, count(*) AS n, round(sum(value), 4) AS total_ms, round(avg(value), 6) AS mean_ms, max(value) AS max_ms FROM events GROUP BY 1")
def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.stage_timings(fx.tables(spark, sf_dir, "events")[0].select(F.col("event_type").alias("stage"), F.col("value").alias("ms")))
    return out.select("stage", "n", F.round("total_ms", 4).alias("total_ms"), F.round("mean_ms", 6).alias("mean_ms"), "max_ms")


@query(f"WITH {fx.READ_SQL} SELECT read.k % 4 AS slice, round(avg((obs_name IS NOT DISTINCT FROM c.normalized_name)::INTEGER::DOUBLE), 6) AS name_exact, round(avg((obs_number IS NOT DISTINCT FROM c.collector_number)::INTEGER::DOUBLE), 6) AS number_exact, count(*) AS n FROM read JOIN catalog c ON c.card_id = read.expected GROUP BY 1")
def ocr_exact_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, read = _read(spark, sf_dir)
    truth = f.catalog.select(F.col("card_id").alias("expected"), F.col("normalized_name").alias("true_name"), F.col("collector_number").alias("true_number"))
    out = quality.exact_rates(read.join(truth, "expected").select((F.col("k") % 4).alias("slice"), F.col("obs_name").alias("read_name"), F.col("obs_number").alias("read_number"), "true_name", "true_number"), ["slice"])
    return out.select("slice", F.round("name_exact", 6).alias("name_exact"), F.round("number_exact", 6).alias("number_exact"), "n")


@query(f"WITH {fx.SCORE_SQL} SELECT scan_id, card_id, confidence FROM answers WHERE status = 'matched' AND CAST(scan_id AS BIGINT) % 2 = 1")
def wrong_confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches joined with feedback that calls odd scans wrong."""
    f = fx.cards(spark, sf_dir)
    results = decision.decide(f.scans, Engine().ranked(f.scans, f.catalog)).withColumn("recognition_id", F.col("scan_id"))
    said = f.scans.select(F.col("scan_id").alias("recognition_id"), F.lit(None).cast("string").alias("correct_card_id"), (F.col("scan_id").cast("long") % 2 == 0).alias("is_correct"))
    return quality.wrong_confident(said, results).select("scan_id", "card_id", "confidence")


@query("SELECT p_name AS card, count(*) AS photos, 0::BIGINT AS leaked FROM part GROUP BY 1")
def leakage_free_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos per card, and whether the split puts a card on both sides."""
    split = quality.split_by_group(fx.tables(spark, sf_dir, "part")[0], "p_name")
    return split.groupBy(F.col("p_name").alias("card")).agg(F.count("*").alias("photos"), (F.count_distinct("held_out") - 1).alias("leaked"))


# Uploads and geometry

_UPLOADS_SQL = """
u AS (SELECT o_orderkey AS upload_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'IMAGE/JPEG' WHEN 1 THEN 'image/png' WHEN 2 THEN 'text/plain' WHEN 3 THEN NULL ELSE 'image/webp' END AS mime,
  CAST(o_totalprice * 60 AS BIGINT) AS size, CASE o_orderkey % 7 WHEN 0 THEN 'GIF' ELSE 'JPEG' END AS fmt,
  CAST(o_orderkey % 6000 + 100 AS INTEGER) AS width, CAST(o_custkey % 6000 + 200 AS INTEGER) AS height, o_orderkey % 9 <> 0 AS readable FROM orders)
"""


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    mime = F.when(k % 5 == 0, "IMAGE/JPEG").when(k % 5 == 1, "image/png").when(k % 5 == 2, "text/plain").when(k % 5 == 4, "image/webp")
    return fx.tables(spark, sf_dir, "orders")[0].select(
        k.alias("upload_id"), mime.alias("mime"), F.round(F.col("o_totalprice") * 60).cast("long").alias("size"), F.when(k % 7 == 0, "GIF").otherwise("JPEG").alias("fmt"),
        (k % 6000 + 100).cast("int").alias("width"), (F.col("o_custkey") % 6000 + 200).cast("int").alias("height"), (k % 9 != 0).alias("readable"),
    )


@query(f"""WITH {_UPLOADS_SQL.replace("CAST(o_totalprice * 60 AS BIGINT)", "CAST(round(o_totalprice * 60) AS BIGINT)")} SELECT upload_id, CASE WHEN size = 0 OR NOT coalesce(lower(mime) IN ('image/jpeg', 'image/png', 'image/webp', 'image/heic', 'image/heif'), false) THEN 'invalid_image'
  WHEN size > 12582912 THEN 'image_too_large' WHEN fmt NOT IN ('JPEG', 'PNG', 'WEBP', 'HEIC', 'HEIF') THEN 'invalid_image' WHEN width < 320 OR height < 320 THEN 'invalid_image'
  WHEN width::BIGINT * height > 24000000 THEN 'image_too_large' WHEN NOT readable THEN 'invalid_image' END AS code,
  CASE WHEN NOT coalesce(starts_with(mime, 'image/'), false) THEN 'invalid_image' WHEN size > 12582912 THEN 'image_too_large' END AS client_code FROM u""")
def upload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = Options(), F.col
    code = uploads.upload_code(c("mime"), c("size"), c("fmt"), c("width"), c("height"), c("readable"), o)
    return _uploads(spark, sf_dir).select("upload_id", code.alias("code"), uploads.client_code(c("mime"), c("size"), o).alias("client_code"))


_QUAD = "l_linenumber AS x0, l_quantity AS y0, l_linenumber + l_quantity * 2 AS x1, l_quantity + l_discount * 10 AS y1, l_linenumber + l_quantity * 2 + l_tax * 10 AS x2, l_quantity * 4 AS y2, l_linenumber - l_tax * 10 AS x3, l_quantity * 4 + l_discount * 10 AS y3"


def _quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = fx.tables(spark, sf_dir, "lineitem")[0].selectExpr("l_orderkey", "l_linenumber", *[x.strip() for x in _QUAD.split(",")])
    point = lambda k: F.struct(F.col(f"x{k}").cast("double").alias("x"), F.col(f"y{k}").cast("double").alias("y"))
    # Given out of order: the corners have to be found.
    return base.select("l_orderkey", "l_linenumber", F.array(point(2), point(3), point(0), point(1)).alias("points"))


_CORNERS_SQL = f"""
q AS (SELECT l_orderkey, l_linenumber, {_QUAD} FROM lineitem),
l AS (SELECT l_orderkey, l_linenumber, [{{'x': x2::DOUBLE, 'y': y2::DOUBLE}}, {{'x': x3::DOUBLE, 'y': y3::DOUBLE}}, {{'x': x0::DOUBLE, 'y': y0::DOUBLE}}, {{'x': x1::DOUBLE, 'y': y1::DOUBLE}}] AS p FROM q),
c AS (SELECT l_orderkey, l_linenumber, p,
  list_sort(list_transform(p, lambda a, i: {{'k': a.x + a.y, 'i': i, 'p': a}}))[1].p AS tl, list_sort(list_transform(p, lambda a, i: {{'k': a.y - a.x, 'i': i, 'p': a}}))[1].p AS tr,
  list_sort(list_transform(p, lambda a, i: {{'k': -(a.x + a.y), 'i': i, 'p': a}}))[1].p AS br, list_sort(list_transform(p, lambda a, i: {{'k': -(a.y - a.x), 'i': i, 'p': a}}))[1].p AS bl FROM l)
"""


@query(f"WITH {_CORNERS_SQL} SELECT l_orderkey, l_linenumber, round(tl.x, 4) AS tl_x, round(tl.y, 4) AS tl_y, round(br.x, 4) AS br_x, round(br.y, 4) AS br_y, round(tr.x, 4) AS tr_x, round(bl.y, 4) AS bl_y FROM c")
def order_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _quads(spark, sf_dir).select("l_orderkey", "l_linenumber", geometry.ordered_corners(F.col("points")).alias("c"))
    at = lambda k, axis, name: F.round(F.get("c", F.lit(k))[axis], 4).alias(name)
    return c.select("l_orderkey", "l_linenumber", at(0, "x", "tl_x"), at(0, "y", "tl_y"), at(2, "x", "br_x"), at(2, "y", "br_y"), at(1, "x", "tr_x"), at(3, "y", "bl_y"))


@query(f"""WITH {_CORNERS_SQL}, d AS (SELECT *, (sqrt((tl.x-tr.x)**2 + (tl.y-tr.y)**2) + sqrt((bl.x-br.x)**2 + (bl.y-br.y)**2)) / 2 AS w, (sqrt((tl.x-bl.x)**2 + (tl.y-bl.y)**2) + sqrt((tr.x-br.x)**2 + (tr.y-br.y)**2)) / 2 AS h FROM c)
SELECT l_orderkey, l_linenumber, round(least(w, h) / greatest(w, h), 6) AS ratio, round(least(w, h) / greatest(w, h), 6) BETWEEN 0.58 AND 0.82 AS card_sides FROM d""")
def quad_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.round(geometry.side_ratio(geometry.ordered_corners(F.col("points"))), 6)
    return _quads(spark, sf_dir).select("l_orderkey", "l_linenumber", ratio.alias("ratio")).withColumn("card_sides", F.col("ratio").between(*geometry.SIDE_RATIO))


_AREA_SQL = "abs(x2*y3 - x3*y2 + x3*y0 - x0*y3 + x0*y1 - x1*y0 + x1*y2 - x2*y1) / 2"


@query(f"""WITH q AS (SELECT l_orderkey, l_linenumber, {_QUAD} FROM lineitem), a AS (SELECT l_orderkey, l_linenumber, {_AREA_SQL} AS area FROM q),
r AS (SELECT l_orderkey, area, row_number() OVER (PARTITION BY l_orderkey ORDER BY area DESC) AS place FROM a)
SELECT l_orderkey, place, round(area, 3) AS area FROM r WHERE place <= 2""")
def largest_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two largest of each order's quads."""
    listed = _quads(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list("points").alias("quads"))  # an order has few lines
    kept = listed.select("l_orderkey", F.posexplode(geometry.largest_contours(F.col("quads"))).alias("at", "points"))
    return kept.select("l_orderkey", (F.col("at") + 1).cast("long").alias("place"), F.round(geometry.area(F.col("points")), 3).alias("area"))


_CROSS = ["(x3-x2)*(y0-y3) - (y3-y2)*(x0-x3)", "(x0-x3)*(y1-y0) - (y0-y3)*(x1-x0)", "(x1-x0)*(y2-y1) - (y1-y0)*(x2-x1)", "(x2-x1)*(y3-y2) - (y2-y1)*(x3-x2)"]


@query(f"""WITH q AS (SELECT l_orderkey, l_linenumber, {_QUAD} FROM lineitem)
SELECT l_orderkey, l_linenumber, round({_AREA_SQL}, 3) AS area, least({", ".join(_CROSS)}) >= 0 OR greatest({", ".join(_CROSS)}) <= 0 AS convex FROM q""")
def contour_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.col("points")
    return _quads(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(geometry.area(points), 3).alias("area"), geometry.is_convex(points).alias("convex"))


@query(f"""WITH {_CORNERS_SQL}, d AS (SELECT *, (sqrt((tl.x-tr.x)**2 + (tl.y-tr.y)**2) + sqrt((bl.x-br.x)**2 + (bl.y-br.y)**2)) / 2 AS w, (sqrt((tl.x-bl.x)**2 + (tl.y-bl.y)**2) + sqrt((tr.x-br.x)**2 + (tr.y-br.y)**2)) / 2 AS h FROM c),
t AS (SELECT *, list_transform(range(1, 5), lambda k: (p[k % 4 + 1].x - p[k].x) * (p[(k + 1) % 4 + 1].y - p[k % 4 + 1].y) - (p[k % 4 + 1].y - p[k].y) * (p[(k + 1) % 4 + 1].x - p[k % 4 + 1].x)) AS turns, abs(list_sum(list_transform(range(1, 5), lambda k: p[k].x * p[k % 4 + 1].y - p[k % 4 + 1].x * p[k].y))) / 2 AS area FROM d)
SELECT l_orderkey, l_linenumber, (list_min(turns) >= 0 OR list_max(turns) <= 0) AND area >= 300 * 0.14::DOUBLE AND coalesce(least(w, h) / nullif(greatest(w, h), 0) BETWEEN 0.58::DOUBLE AND 0.82::DOUBLE, false) AS plausible FROM t""")
def plausible_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads that may be cards in pictures of 300 square units."""
    quads = _quads(spark, sf_dir).withColumn("c", geometry.ordered_corners(F.col("points")))
    return quads.select("l_orderkey", "l_linenumber", geometry.plausible(F.col("points"), F.lit(300.0), F.col("c")).alias("plausible"))


# Closed contours of twelve points: the quads with two points on each side, put off it by little or much.
_SIDES = [(k, (k + 1) % 4) for k in range(4)]
_OFF = "(l_discount - 0.05) * 40"
_ALONG = [(f"x{a} + (x{b} - x{a}) * {t}", f"y{a} + (y{b} - y{a}) * {t} {sign} {_OFF}" if t != "0.0" else f"y{a}") for a, b in _SIDES for t, sign in (("0.0", "+"), ("0.25", "+"), ("0.625", "-"))]
_CONTOURS_SQL = f"""
q AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS id, l_orderkey, l_linenumber, l_discount, {_QUAD} FROM lineitem),
p AS (SELECT id, {", ".join(f"({x})::DOUBLE AS px{k}, ({y})::DOUBLE AS py{k}" for k, (x, y) in enumerate(_ALONG))} FROM q),
pts AS ({" UNION ALL ".join(f"SELECT id, {k} AS i, px{k} AS x, py{k} AS y FROM p" for k in range(12))}),
sides AS (SELECT id, 0.025::DOUBLE * sum(sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2)) AS eps FROM pts a JOIN pts b USING (id) WHERE b.i = (a.i + 1) % 12 GROUP BY id),
one AS (SELECT id, arg_min(b.i, (-sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2), b.i)) AS i FROM pts a JOIN pts b USING (id) WHERE a.i = 0 GROUP BY id),
two AS (SELECT id, arg_min(b.i, (-sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2), b.i)) AS i FROM one JOIN pts a USING (id, i) JOIN pts b USING (id) GROUP BY id),
r AS (
  SELECT id, list_sort(list_distinct([one.i, two.i])) AS kept, 0 AS step FROM one JOIN two USING (id)
  UNION ALL
  SELECT id, list_sort(list_concat(any_value(kept), list(i))) AS kept, any_value(step) + 1 FROM (
    SELECT id, kept, step, before, arg_min(i, (-apart, (i - before + 12) % 12)) AS i FROM (
      SELECT id, kept, step, before, i, sqrt((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2) AS apart FROM (
        SELECT id, kept, step, before, i, x, y, ax, ay, dx, dy, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0, least(1, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) ELSE 0 END AS t FROM (
          SELECT g.id, g.kept, g.step, g.before, g.i, g.x, g.y, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy FROM (
            SELECT r.id, r.kept, r.step, pts.i, pts.x, pts.y, coalesce(list_max(list_filter(r.kept, lambda k: k < pts.i)), list_max(r.kept)) AS before, coalesce(list_min(list_filter(r.kept, lambda k: k > pts.i)), list_min(r.kept)) AS behind
            FROM r JOIN pts USING (id) WHERE NOT list_contains(r.kept, pts.i)) g JOIN pts a ON a.id = g.id AND a.i = g.before JOIN pts b ON b.id = g.id AND b.i = g.behind)))
    JOIN sides USING (id) WHERE apart > eps GROUP BY id, kept, step, before) GROUP BY id)
"""


def _contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = fx.tables(spark, sf_dir, "lineitem")[0].selectExpr("l_orderkey", "l_linenumber", "l_discount", *[x.strip() for x in _QUAD.split(",")])
    point = lambda x, y: F.struct(F.expr(x.replace("0.25", "0.25D").replace("0.625", "0.625D").replace("0.0", "0D")).cast("double").alias("x"), F.expr(y.replace("0.05", "0.05D").replace("0.25", "0.25D").replace("0.625", "0.625D")).cast("double").alias("y"))
    return base.select("l_orderkey", "l_linenumber", F.array(*[point(x, y) for x, y in _ALONG]).alias("points"))


@query(f"""WITH RECURSIVE {_CONTOURS_SQL} SELECT l_orderkey, l_linenumber, CAST(len(kept) AS INTEGER) AS corners, array_to_string(list_transform(kept, lambda k: CAST(k AS VARCHAR)), ',') AS kept FROM q JOIN (SELECT id, arg_max(kept, step) AS kept FROM r GROUP BY id) USING (id)""")
def simplified_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners that closed contours keep, as places in them."""
    found = _contours(spark, sf_dir).withColumn("corners", geometry.simplify(F.col("points")))
    places = F.array_join(F.transform("corners", lambda c: (F.array_position("points", c) - 1).cast("string")), ",")
    return found.select("l_orderkey", "l_linenumber", F.size("corners").alias("corners"), places.alias("kept"))


@query(f"""WITH {_CORNERS_SQL}, e AS (SELECT l_orderkey, l_linenumber, tl, tr, br, bl, tr.x - br.x AS ux, bl.x - br.x AS vx, tl.x - tr.x + br.x - bl.x AS wx, tr.y - br.y AS uy, bl.y - br.y AS vy, tl.y - tr.y + br.y - bl.y AS wy FROM c),
h AS (SELECT *, (wx * vy - vx * wy) / nullif(ux * vy - vx * uy, 0) AS g, (ux * wy - wx * uy) / nullif(ux * vy - vx * uy, 0) AS h FROM e),
m AS (SELECT *, tr.x - tl.x + g * tr.x AS a, bl.x - tl.x + h * bl.x AS b, tl.x AS c, tr.y - tl.y + g * tr.y AS d, bl.y - tl.y + h * bl.y AS e, tl.y AS f, (tl.x + tr.x + br.x + bl.x) / 4 AS px, (tl.y + tr.y + br.y + bl.y) / 4 AS py FROM h),
s AS (SELECT *, a * e - b * d + (d * h - e * g) * px + (b * g - a * h) * py AS w FROM m)
SELECT l_orderkey, l_linenumber, round(743 * ((e - f * h) * px + (c * h - b) * py + b * f - c * e) / nullif(w, 0) + 1.3e-6::DOUBLE, 4) AS x, round(1038 * ((f * g - d) * px + (a - c * g) * py + c * d - a * f) / nullif(w, 0) + 1.3e-6::DOUBLE, 4) AS y FROM s""")
def rectified_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the middle of each quad's corners lies once the quad is made a rectangle of 744 by 1039 points."""
    c = geometry.with_homography(_quads(spark, sf_dir).withColumn("c", geometry.ordered_corners(F.col("points"))), "c", 743.0, 1038.0, "m")
    middle = lambda axis: (F.get("c", F.lit(0))[axis] + F.get("c", F.lit(1))[axis] + F.get("c", F.lit(2))[axis] + F.get("c", F.lit(3))[axis]) / 4
    to = c.select("l_orderkey", "l_linenumber", geometry.mapped(F.col("m"), middle("x"), middle("y")).alias("to"))
    # Whole parts of two are frequent here; a little is added so that none lies halfway between two roundings.
    return to.select("l_orderkey", "l_linenumber", F.round(F.col("to.x") + 1.3e-6, 4).alias("x"), F.round(F.col("to.y") + 1.3e-6, 4).alias("y"))


@query("""WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 127.5)) AS v FROM embeddings),
p AS (SELECT vec_id, v, unnest(range(0, 64)) AS i FROM g),
l AS (SELECT vec_id, v[CASE WHEN i % 8 = 0 THEN i + 1 ELSE i - 1 END + 1] + v[CASE WHEN i % 8 = 7 THEN i - 1 ELSE i + 1 END + 1]
  + v[CASE WHEN i < 8 THEN i + 8 ELSE i - 8 END + 1] + v[CASE WHEN i >= 56 THEN i - 8 ELSE i + 8 END + 1] - 4 * v[i + 1] AS r FROM p)
SELECT vec_id, avg(r * r) - avg(r) * avg(r) AS variance FROM l GROUP BY vec_id""")
def blur_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpness of grey images of 8 by 8, made of the vectors; whole numbers keep both sides exact."""
    grey = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("double"))
    images = fx.tables(spark, sf_dir, "embeddings")[0].select("vec_id", grey.alias("pixels"))
    return images.select("vec_id", geometry.laplacian_variance(F.col("pixels"), 8).alias("variance"))


@query(f"""WITH {_CORNERS_SQL}, e AS (SELECT l_linenumber, l_orderkey % 5 != 0 AS hit, (sqrt((tl.x-p[1].x)**2 + (tl.y-p[1].y)**2) + sqrt((tr.x-p[2].x)**2 + (tr.y-p[2].y)**2)
  + sqrt((br.x-p[3].x)**2 + (br.y-p[3].y)**2) + sqrt((bl.x-p[4].x)**2 + (bl.y-p[4].y)**2)) / 4 AS apart FROM c)
SELECT l_linenumber, round(avg(hit::INT), 6) AS success, round(avg(CASE WHEN hit THEN apart END), 6) AS corner_error, count(*) AS n FROM e GROUP BY l_linenumber""")
def localization_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found corners, lost in every fifth order, against the given ones."""
    corners = F.when(F.col("l_orderkey") % 5 != 0, geometry.ordered_corners(F.col("points")))
    found = quality.localization(_quads(spark, sf_dir).withColumns({"corners": corners, "true_corners": F.col("points")}), ["l_linenumber"])
    return found.select("l_linenumber", F.round("success", 6).alias("success"), F.round("corner_error", 6).alias("corner_error"), "n")


@query(f"""WITH {_UPLOADS_SQL}, w AS (SELECT upload_id, coalesce(least(width, height)::DOUBLE / greatest(width, height) BETWEEN 0.62 AND 0.78, false) AS whole, upload_id % 3 AS n, (upload_id % 70)::DOUBLE AS blur FROM u)
SELECT upload_id, whole, CASE WHEN n > 1 THEN 'multiple_cards' WHEN n = 0 AND NOT whole THEN 'card_not_found' WHEN blur < 34 THEN 'image_too_blurry' END AS code FROM w""")
def locate_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _uploads(spark, sf_dir).select("upload_id", geometry.whole_image_is_card(F.col("width"), F.col("height")).alias("whole"))
    code = uploads.location_code(F.col("upload_id") % 3, F.col("whole"), (F.col("upload_id") % 70).cast("double"), Options())
    return seen.select("upload_id", "whole", code.alias("code"))


@query(f"""WITH {_UPLOADS_SQL} SELECT upload_id, 422 AS http_status, CASE WHEN fmt = 'GIF' THEN 'invalid_image' ELSE 'recognition_failed' END AS code FROM u WHERE fmt = 'GIF' OR NOT readable""")
def domain_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("fmt") == "GIF", "invalid_image").when(~F.col("readable"), "no_such_code")
    rows = _uploads(spark, sf_dir).select("upload_id", code.alias("code"), F.lit("not readable").alias("detail"))
    return decision.error_rows(rows).select("upload_id", "http_status", "code")


@query(f"WITH {fx.SCORE_SQL} SELECT scan_id, confidence BETWEEN 0 AND 1 AS in_range FROM answers")
def result_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_margin(spark, sf_dir).select("scan_id", uploads.result_in_range(F.col("confidence"), F.lit(0.0), F.col("status")).alias("in_range"))


@query("SELECT 'ready' AS status, 'ready' AS database, CASE WHEN bool_and(r_regionkey >= 0) THEN 'ready' ELSE 'artifacts_required' END AS models FROM region")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    alive = spark.sql("SELECT 1").first()[0] == 1
    return uploads.readiness(fx.tables(spark, sf_dir, "region")[0].select(F.col("r_name").alias("artifact"), (F.col("r_regionkey") >= 0).alias("present")), alive)


# Display


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'Price unavailable' ELSE CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || '$' || format('{:,.2f}', abs(c_acctbal)) END AS shown FROM customer")
def format_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal"))
    return fx.tables(spark, sf_dir, "customer")[0].select("c_custkey", display.format_usd(amount).alias("shown"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_size || '/50' END AS shown, CASE WHEN p_type = 'SMALL' THEN 'Unknown' ELSE p_type END AS rarity FROM part")
def format_number_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.when(F.col("p_partkey") % 3 == 0, "").otherwise("50")
    rarity = F.when(F.col("p_type") != "SMALL", F.col("p_type"))
    return fx.tables(spark, sf_dir, "part")[0].select("p_partkey", display.format_number(F.col("p_size").cast("string"), total).alias("shown"), display.rarity(rarity).alias("rarity"))


@query("SELECT l_orderkey, l_linenumber, CAST(floor(l_discount * 100 + 0.5::DOUBLE) AS INTEGER) AS percent, strftime(l_shipdate, '%-m/%-d/%Y') AS shipped FROM lineitem")
def percent_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.tables(spark, sf_dir, "lineitem")[0].select("l_orderkey", "l_linenumber", display.percent(F.col("l_discount")).alias("percent"), display.short_date(F.col("l_shipdate")).alias("shipped"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '/' WHEN page_id % 4 = 1 THEN '/' ELSE regexp_replace(url, '^https?://[^/]+', '') END AS path, regexp_replace(url, '/$', '') AS base FROM pages""")
def safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return paths taken from page addresses: some absolute, some protocol-relative, the rest local."""
    local = F.regexp_replace("url", "^https?://[^/]+", "")
    given = F.when(F.col("page_id") % 4 == 0, F.col("url")).when(F.col("page_id") % 4 == 1, F.concat(F.lit("/"), local)).otherwise(local)
    return fx.tables(spark, sf_dir, "pages")[0].select("page_id", display.safe_path(given).alias("path"), display.without_slash(F.col("url")).alias("base"))


_LOCAL_SQL = "regexp_replace(url, '^https?://[^/]+', '')"


@query(f"""SELECT page_id, CASE page_id % 6 WHEN 0 THEN {_LOCAL_SQL} WHEN 1 THEN '/' WHEN 2 THEN '/' WHEN 3 THEN {_LOCAL_SQL} || '?q=/../x#..' WHEN 4 THEN '/dir/' ELSE '/' END AS path FROM pages""")
def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return paths with dot segments, backslashes and a reserved path, some of them hidden."""
    k, local = F.col("page_id") % 6, F.regexp_replace("url", "^https?://[^/]+", "")
    given = (
        F.when(k == 0, F.concat(F.lit("/x/.."), local)).when(k == 1, F.concat(F.lit("/\\host.invalid"), local)).when(k == 2, F.lit("/a/%2E%2e/./callback"))
        .when(k == 3, F.concat(F.lit("/a/./b/../.%2e"), local, F.lit("?q=/../x#.."))).when(k == 4, F.lit("/../dir/sub/..")).otherwise(F.concat(F.lit("/\t"), local))
    )
    return fx.tables(spark, sf_dir, "pages")[0].select("page_id", display.safe_path(given, ("/callback",)).alias("path"))


@query("SELECT n_nationkey, url_encode(n_name || ' & co') AS encoded, n_name || ' & co' AS decoded, CASE WHEN n_nationkey % 5 = 0 THEN NULL WHEN n_nationkey % 5 = 1 THEN 'a@x.invalid' ELSE n_name || ' & co' END AS shown, rpad(n_name, 80, '-') AS request_id FROM nation")
def percent_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 5
    n = fx.tables(spark, sf_dir, "nation")[0].withColumn("plain", F.concat("n_name", F.lit(" & co")))
    e = n.withColumn("encoded", display.percent_encode(F.col("plain")))
    shown = display.display_name(F.when(k != 1, F.col("encoded")), F.lit(True), F.when(k != 0, "a@x.invalid"))
    return e.select("n_nationkey", "encoded", display.percent_decode(F.col("encoded")).alias("decoded"), shown.alias("shown"), display.request_id(F.rpad("n_name", 200, "-"), F.lit("none")).alias("request_id"))


@query("SELECT event_id, event_type = 'view' AND event_id % 2 = 0 AS cacheable FROM events")
def cache_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.when(F.col("event_type") == "view", "GET").otherwise("POST")
    path = F.when(F.col("event_id") % 2 == 0, "/cards").otherwise("/api/v1/cards")
    return fx.tables(spark, sf_dir, "events")[0].select("event_id", display.cacheable(method, path).alias("cacheable"))


from matchloom import store_queries  # noqa: E402, F401  registers its own
