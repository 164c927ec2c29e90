"""Operator 12: importance resampling towards a target collection.

In every task a DuckDB connection takes batches of texts: SQL unnests the words, windows make the
n-grams, a registered function hashes them (zlib's CRC-32) into buckets, and what each text
has in each bucket is counted.  The counts are spilled to Parquet in the shared folder; Spark sums
them into one row per bucket for the table and for the target, and scores the texts with them: the
log of the ratio of smoothed bucket shares, summed over a text's n-grams, plus Gumbel noise
from a hash of the id.  The highest scores are drawn, which is sampling without replacement
in proportion to the likelihood ratio.

Only the ``buckets`` gains, whose number is a parameter, reach all tasks.  Ranks come from ranges of
scores and counts before them, not from one sorted task.

Defined results: a null or empty text, or one without words, has no n-grams and weight 0; a null id
is hashed as an empty one; equal scores go by id (null last) and then as rows are stored; repeated
rows are counted, scored and drawn each; extra columns are ignored; an empty table gives no rows, an
empty target one in which nothing is likelier than anything else but by its own counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import arrow_batches, materialise, release, unused
from matchloom.llm.ranking import ranked

BUCKETS = 10_000
#: ASCII but for digits and lower-case letters (of lower-cased text), at which words end.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Memory that the database of a task may use for a batch of at most 16 MB of texts.
TASK_MB = 400

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _statement(most: int, buckets: int) -> str:
    """SQL from texts (r, text) to (r, n_words, bucket list, count list)."""
    grams = ["SELECT r, word AS gram FROM words"]
    for n in range(2, most + 1):
        following = " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER (PARTITION BY r ORDER BY place)" for k in range(1, n))])
        grams.append(f"SELECT r, {following} AS gram FROM words")
    return f"""
    WITH split AS (SELECT r, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{WORD}') AS ws FROM texts),
    words AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS place FROM split),
    grams AS ({" UNION ALL ".join(grams)}),
    counted AS (SELECT r, gram, count(*) AS n FROM grams WHERE gram IS NOT NULL GROUP BY ALL),
    hashed AS (SELECT gram, crc32_of(gram) % {buckets} AS bucket FROM (SELECT DISTINCT gram FROM counted)),
    summed AS (SELECT r, bucket, CAST(sum(n) AS BIGINT) AS n FROM counted JOIN hashed USING (gram) GROUP BY ALL),
    listed AS (SELECT r, list(CAST(bucket AS INTEGER) ORDER BY bucket) AS b, list(n ORDER BY bucket) AS c FROM summed GROUP BY r)
    SELECT split.r, CAST(coalesce(len(ws), 0) AS BIGINT) AS n_words, coalesce(b, []) AS buckets, coalesce(c, []) AS counts
    FROM split LEFT JOIN listed USING (r) ORDER BY split.r
    """


def _crc(grams: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(g) for g in grams.cast(pa.binary()).to_pylist()], pa.int64())


def bucket_counts(docs: DataFrame, id_col: str, text_col: str, most: int, buckets: int, tag: str) -> DataFrame:
    """Rows (id, n_words, buckets, counts), one for each row of docs, written to the shared folder."""
    arrow_batches(docs.sparkSession)
    sql = _statement(most, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        from duckdb.sqltypes import BIGINT, VARCHAR

        with duckdb.connect(config={"threads": 1, "memory_limit": f"{TASK_MB}MB"}) as db:
            db.execute("SET temp_directory = ''")
            db.create_function("crc32_of", _crc, [VARCHAR], BIGINT, type="arrow")
            for batch in batches:
                db.register("texts", pa.table({"r": pa.array(range(batch.num_rows), pa.int64()), "text": batch.column(1)}))
                found = db.sql(sql).to_arrow_table().combine_chunks()
                db.unregister("texts")
                if found.num_rows:
                    rest = [found.column(c).combine_chunks() for c in ("n_words", "buckets", "counts")]
                    yield pa.record_batch([batch.column(0), *rest], names=["id", "n_words", "buckets", "counts"])

    shaped = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = shaped.schema["id"].dataType.simpleString()
    return materialise(shaped.mapInArrow(run, f"id {kind}, n_words bigint, buckets array<int>, counts array<bigint>"), tag)


def totals(counts: DataFrame) -> DataFrame:
    """(bucket, n): n-grams of all rows in each bucket that has any."""
    pairs = counts.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return pairs.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n"))


def gains(table: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """One row with the gains of all buckets as an array: thousandths of the log of the ratio of smoothed shares."""
    spark = table.sparkSession
    one = lambda df, n: df.select("bucket", F.col("n").alias(n))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(F.broadcast(one(table, "s")), "bucket", "left").join(F.broadcast(one(target, "t")), "bucket", "left").na.fill(0)
    sums = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1) * (F.col("all_s") + buckets) / ((s + 1) * (F.col("all_t") + buckets))
    gain = F.floor(1000 * F.log(ratio)).cast("long")
    listed = both.crossJoin(F.broadcast(sums)).select(F.struct("bucket", gain.alias("gain")).alias("x"))  # a side of one row
    return listed.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["gain"]).alias("gains"))


def noise(id_col: Column, seed: str) -> Column:
    """Thousandths of a Gumbel number that the id and the seed decide."""
    first = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(first, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: str = "0", id_col: str = "doc_id", text_col: str = "text", most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of docs: id_col, n_features, weight, score, rank (from 1; null where not drawn).

    Of the documents with ``least_words`` words or more, ``percent`` of a hundred are drawn.  Features
    are the runs of 1 to ``most`` words.  ``target`` needs a column named ``text_col`` only.
    """
    spark = docs.sparkSession
    mine = bucket_counts(docs, id_col, text_col, most, buckets, "importance-counts")
    theirs = bucket_counts(target.select(F.lit(0).alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text", most, buckets, "importance-target")
    gained = materialise(gains(totals(mine), totals(theirs), buckets), "importance-gains")
    release(theirs)
    known = gained.first().gains  # as many numbers as there are buckets
    side = F.broadcast(spark.createDataFrame([(known,)], "gains array<bigint>"))
    each = F.zip_with("buckets", "counts", lambda b, c: F.get("gains", b) * c)
    scored = mine.crossJoin(side).select(  # a side of one row
        F.col("id").alias(id_col), "n_words", F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c).alias("n_features"), F.aggregate(each, F.lit(0).cast("long"), lambda a, c: a + c).alias("weight"),
    ).withColumn("score", F.col("weight") + noise(F.col(id_col), seed))
    enough = F.col("n_words") >= least_words
    place, rows = unused(scored.columns, "place", "rows")
    placed = ranked(scored.where(enough), [], [F.col("score").desc(), F.col(id_col).asc_nulls_last()], "importance-ranks", place, rows)
    rank = F.when((F.col(place) + 1) * 100 <= F.col(rows) * percent, F.col(place) + 1)
    shape = [id_col, "n_features", "weight", "score"]
    return placed.select(*shape, rank.alias("rank")).unionByName(scored.where(~enough).select(*shape, F.lit(None).cast("long").alias("rank")))
