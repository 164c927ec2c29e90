"""The registered queries: one thin function per operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import collisions, decontamination, htmltext, importance, langid, licences, linededup, merkle, neardup, packing, pii, sharding, suffixes
from matchloom.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_min_cost_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents on 32 full but uneven shards (the lesser of two hashes), moved to 40 shards of near equal bytes."""
    row = "concat_ws('/', source, doc_id)"
    old = f"least(pmod(crc32({row}), 32), pmod(crc32(concat({row}, '+')), 32))"
    out, _ = sharding.reshard(table(spark, sf_dir, "documents"), old, 32, 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings at a cosine of 0.9."""
    return collisions.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those with crc32(doc_id) mod 4 other than 2; a null id is not held out."""
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    model = langid.train(docs.where((fold != 2) | fold.isNull()))
    out = langid.identify(docs.select("doc_id", "text", F.coalesce(fold == 2, F.lit(False)).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op4_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents at a shingle similarity of 0.85."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 4096 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), 4096, 2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op7_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, and the terms near it that give it away."""
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", pii.of_rank(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS[:4])]
    n_base = F.size("base").cast("long").alias("n_base")
    return found.select("doc_id", *counts, n_base, F.sha2(pii.digest(F.col("base")), 256).alias("base_sha256"), pii.digest(F.array_sort(F.concat("base", "terms"))).alias("spans"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and tags of every document."""
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, with the region that holds each."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat, exactly or nearly, a line met before."""
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 100-byte strings that start earlier in the table too."""
    out = suffixes.dedup_substrings(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of at least 20 words, drawn by their likeness to the benchmark."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, least_words=20, seed="2024")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its Merkle proof, and whether it holds for a table in which one row in seven has a wrong length."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    out = merkle.manifest(docs, claimed={"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_min_cost_reshard, op2_collision_counting, op3_language_id, op4_minhash_odd_sketch, op5_packing, op6_html_main_text, op7_pii_disclosure, op8_license_scan, op9_decontamination, op10_fuzzy_line_dedup, op11_suffix_array_dedup, op12_importance_resampling, op13_merkle_manifest)
    return {f.__name__: f for f in named}
