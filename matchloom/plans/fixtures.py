"""Catalog, prices, scans and logs as views over the star-schema tables, in Spark and in SQL.

The star schema holds no cards, so parts stand in: every part is a card and is scanned
once, with noise that depends on its key.  SQL holds the same views for DuckDB.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRICED_AT = "2024-01-01 00:00:00"

CATALOG_SQL = """
vectors AS (SELECT vec_id, embedding, label, count(*) OVER () AS n_vectors FROM embeddings),
catalog AS (
  SELECT CAST(p_partkey AS VARCHAR) AS card_id, p_partkey, p_name AS name, p_name AS normalized_name, CAST(p_size AS VARCHAR) AS collector_number,
         '50' AS printed_total, p_brand AS set_name, p_type AS rarity, 'English' AS language,
         'https://cards.invalid/' || p_partkey || '.jpg' AS image_url, 'm' || p_partkey AS marketplace_id,
         'https://market.invalid/' || p_partkey AS marketplace_url, embedding
  FROM part JOIN vectors ON vec_id = p_partkey % n_vectors),
prices AS (
  SELECT CAST(p_partkey AS VARCHAR) AS card_id, p_retailprice AS amount, 'USD' AS currency, 'cache' AS source, TIMESTAMP '2024-01-01 00:00:00' AS updated_at
  FROM part WHERE p_partkey % 5 <> 0)
"""
SCANS_SQL = (
    CATALOG_SQL
    + """,
observed AS (
  SELECT CAST(p_partkey AS VARCHAR) AS scan_id, CAST(p_partkey AS VARCHAR) AS expected, p_partkey % 40 AS k, p_partkey,
    CASE WHEN p_partkey % 40 = 30 THEN NULL WHEN p_partkey % 40 = 20 THEN split_part(p_name, ' ', 2) ELSE p_name END AS plain_name,
    CASE WHEN p_partkey % 40 = 30 THEN NULL WHEN p_partkey % 40 = 20 THEN '999' ELSE CAST(p_size AS VARCHAR) END AS plain_number,
    0.80::DOUBLE + (p_partkey % 20)::DOUBLE / 100::DOUBLE AS ocr_quality
  FROM part),
scans AS (
  SELECT scan_id, expected, k, ocr_quality,
    CASE p_partkey % 4 WHEN 0 THEN upper(plain_name) WHEN 1 THEN '  ' || plain_name || ' ' WHEN 2 THEN replace(plain_name, ' ', '   ') ELSE plain_name || '!' END AS raw_name,
    CASE p_partkey % 3 WHEN 0 THEN '00' || plain_number || ' / 165' WHEN 1 THEN plain_number || '/50' ELSE ' ' || plain_number || ' ' END AS raw_number,
    embedding
  FROM observed JOIN vectors ON vec_id = CASE WHEN k = 0 THEN p_partkey % n_vectors ELSE (7 * p_partkey + 1) % n_vectors END)
"""
)
READ_SQL = (
    SCANS_SQL
    + r""",
named AS (
  SELECT *, nullif(trim(regexp_replace(regexp_replace(replace(trim(raw_name), '0', 'O'), '[^\p{L}\p{N}_\s.''-]', ' ', 'g'), '\s+', ' ', 'g')), '') AS cleaned,
         nullif(regexp_extract(upper(raw_number), '([A-Z]*\d+[A-Z]*)\s*(?:[/|I]\s*(\d+))?', 1), '') AS found_number FROM scans),
read AS (
  SELECT scan_id, expected, k, ocr_quality, embedding, raw_name, raw_number,
    lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(cleaned, '\bV\s*MAX\b', 'VMAX', 'gi'), '\bV\s*STAR\b', 'VSTAR', 'gi'), '\bG\s*X\b', 'GX', 'gi'), '\bE\s*X\b', 'ex', 'gi')) AS obs_name,
    CASE WHEN found_number IS NOT NULL THEN coalesce(nullif(ltrim(found_number, '0'), ''), '0') END AS obs_number
  FROM named)
"""
)
BLOCK_SQL = (
    READ_SQL
    + """,
keys AS (SELECT DISTINCT obs_name, obs_number FROM read),
names AS (SELECT DISTINCT normalized_name FROM catalog),
like_names AS (SELECT obs_name, normalized_name FROM (SELECT DISTINCT obs_name FROM keys WHERE obs_name IS NOT NULL) JOIN names ON normalized_name LIKE '%' || obs_name || '%'),
key_hits AS (
  SELECT obs_name, obs_number, card_id, CASE WHEN hit_name AND hit_number THEN 0 WHEN hit_number THEN 1 ELSE 2 END AS kind FROM (
    SELECT k.obs_name, k.obs_number, c.card_id, coalesce(c.collector_number = k.obs_number, false) AS hit_number,
           coalesce(c.normalized_name IN (SELECT normalized_name FROM like_names l WHERE l.obs_name = k.obs_name), false) AS hit_name
    FROM keys k JOIN catalog c ON c.collector_number = k.obs_number OR c.normalized_name LIKE '%' || k.obs_name || '%')),
key_ranked AS (SELECT *, row_number() OVER (PARTITION BY obs_name, obs_number ORDER BY kind, card_id) AS retrieval_rank FROM key_hits),
blocked AS (
  SELECT r.scan_id, h.card_id, h.retrieval_rank FROM read r JOIN key_ranked h ON r.obs_name IS NOT DISTINCT FROM h.obs_name AND r.obs_number IS NOT DISTINCT FROM h.obs_number
  WHERE h.retrieval_rank <= 8)
"""
)
SCORE_SQL = (
    BLOCK_SQL
    + """,
parts AS (
  SELECT b.scan_id, b.card_id, b.retrieval_rank, r.ocr_quality,
    CASE WHEN coalesce(r.obs_number, '') = '' THEN 0::DOUBLE
         WHEN ltrim(lower(r.obs_number), '0') = ltrim(lower(c.collector_number), '0') THEN 1::DOUBLE
         WHEN ltrim(r.obs_number, '0') <> '' AND ltrim(c.collector_number, '0') <> '' AND (contains(ltrim(lower(r.obs_number), '0'), ltrim(lower(c.collector_number), '0')) OR contains(ltrim(lower(c.collector_number), '0'), ltrim(lower(r.obs_number), '0'))) THEN 0.72::DOUBLE
         ELSE 0::DOUBLE END AS number_score,
    CASE WHEN coalesce(r.obs_name, '') = '' THEN 0::DOUBLE WHEN r.obs_name = c.normalized_name THEN 1::DOUBLE
         ELSE len(list_intersect(list_distinct(string_split(r.obs_name, ' ')), list_distinct(string_split(c.normalized_name, ' '))))::DOUBLE
              / greatest(len(list_distinct(string_split(r.obs_name, ' '))), len(list_distinct(string_split(c.normalized_name, ' ')))) END AS name_score,
    greatest(0::DOUBLE, least(1::DOUBLE, (list_dot_product(r.embedding::DOUBLE[], c.embedding::DOUBLE[])
      / (sqrt(list_dot_product(r.embedding::DOUBLE[], r.embedding::DOUBLE[])) * sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]))) + 1) / 2)) AS artwork_score
  FROM blocked b JOIN read r USING (scan_id) JOIN catalog c USING (card_id)),
scored AS (
  SELECT *, round(greatest(0::DOUBLE, least(1::DOUBLE, (0.62::DOUBLE * (0.58::DOUBLE * number_score + 0.42::DOUBLE * name_score) + 0.38::DOUBLE * artwork_score) * (0.85::DOUBLE + 0.15::DOUBLE * ocr_quality))), 4) AS confidence
  FROM parts),
ranked AS (
  SELECT *, row_number() OVER w AS rank, lead(confidence, 1, 0::DOUBLE) OVER w AS runner_up FROM scored WINDOW w AS (PARTITION BY scan_id ORDER BY confidence DESC, retrieval_rank)),
decided AS (
  SELECT s.scan_id, s.expected, s.k, t.card_id AS top_card_id, t.confidence AS top,
    CASE WHEN t.confidence IS NULL OR t.confidence < 0.56::DOUBLE THEN 'unrecognized'
         WHEN t.confidence >= 0.82::DOUBLE AND t.confidence - t.runner_up >= 0.08::DOUBLE THEN 'matched' ELSE 'ambiguous' END AS status,
    coalesce(t.confidence, 0::DOUBLE) AS confidence
  FROM scans s LEFT JOIN ranked t ON t.scan_id = s.scan_id AND t.rank = 1),
answers AS (
  SELECT d.*, CASE WHEN status = 'matched' THEN top_card_id END AS card_id,
    (SELECT list(r.card_id ORDER BY r.rank) FROM ranked r WHERE r.scan_id = d.scan_id AND r.rank <= 3) AS top3
  FROM decided d)
"""
)


@dataclass(frozen=True)
class Fixture:
    catalog: DataFrame
    prices: DataFrame
    scans: DataFrame


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def cards(spark: SparkSession, sf_dir: str) -> Fixture:
    """The views of SCANS_SQL."""
    part, embeddings = tables(spark, sf_dir, "part", "embeddings")
    n = embeddings.count()
    key, k = F.col("p_partkey"), F.col("p_partkey") % 40
    vectors = embeddings.select(F.col("vec_id"), "embedding")
    cid = key.cast("string")
    catalog = part.join(vectors, vectors.vec_id == key % n).select(
        cid.alias("card_id"), F.col("p_name").alias("name"), F.col("p_name").alias("normalized_name"), F.col("p_size").cast("string").alias("collector_number"),
        F.lit("50").alias("printed_total"), F.col("p_brand").alias("set_name"), F.col("p_type").alias("rarity"), F.lit("English").alias("language"),
        F.concat(F.lit("https://cards.invalid/"), cid, F.lit(".jpg")).alias("image_url"), F.concat(F.lit("m"), cid).alias("marketplace_id"),
        F.concat(F.lit("https://market.invalid/"), cid).alias("marketplace_url"), "embedding",
    )
    prices = part.where(key % 5 != 0).select(cid.alias("card_id"), F.col("p_retailprice").alias("amount"), F.lit("USD").alias("currency"), F.lit("cache").alias("source"), F.lit(PRICED_AT).cast("timestamp").alias("updated_at"))
    name = F.when(k == 30, None).when(k == 20, F.split_part("p_name", F.lit(" "), F.lit(2))).otherwise(F.col("p_name"))
    number = F.when(k == 30, None).when(k == 20, "999").otherwise(F.col("p_size").cast("string"))
    raw_name = F.when(key % 4 == 0, F.upper(name)).when(key % 4 == 1, F.concat(F.lit("  "), name, F.lit(" "))).when(key % 4 == 2, F.replace(name, F.lit(" "), F.lit("   "))).otherwise(F.concat(name, F.lit("!")))
    raw_number = F.when(key % 3 == 0, F.concat(F.lit("00"), number, F.lit(" / 165"))).when(key % 3 == 1, F.concat(number, F.lit("/50"))).otherwise(F.concat(F.lit(" "), number, F.lit(" ")))
    seen = part.select(
        cid.alias("scan_id"), cid.alias("expected"), k.alias("k"), (F.lit(0.80) + (key % 20).cast("double") / F.lit(100.0)).alias("ocr_quality"),
        raw_name.alias("raw_name"), raw_number.alias("raw_number"), F.when(k == 0, key % n).otherwise((7 * key + 1) % n).alias("_vec"),
    )
    scans = seen.join(vectors, F.col("_vec") == vectors.vec_id).drop("_vec", "vec_id")
    return Fixture(catalog, prices, scans)
