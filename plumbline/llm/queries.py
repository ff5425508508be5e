"""Registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from plumbline.llm import (bit_slices, hard_negatives, katz, language, merkle, mixture, near_dup, perplexity, pieces, set_join,
                           subword, token_files, toxicity, training)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Rows of an Arrow batch.  Texts are long, and a Python worker holds a batch several times over.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``BATCH_ROWS`` where it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page; the text model learns from all documents and their declared languages."""
    model = language.fit_text(_table(spark, sf_dir, "documents"))
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return language.identify_pages(pages, model).select("page_id", *language.RESULT)


def op2_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link(_table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = token_files.shared_folder(spark, "tokens")
    manifest = token_files.write(docs, folder, tokenizer_path("byte_bpe_50k.json"))
    return token_files.read(manifest, folder)


def op4_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = training.held_out("doc_id", 10, 0)
    train = held == F.lit(False)
    return katz.score(docs, train & F.col("doc_id").isNotNull()).withColumn("held_out", held)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.classify(docs, _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixture.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op7_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return perplexity.judge(docs).select("doc_id", *perplexity.COUNTS, "base_failed", "kept")


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    checked = docs.select("doc_id", pieces.check_udf(tokenizer_path("piece_bpe_32k.model"))("text").alias("c"))
    return checked.select("doc_id", "c.n_tokens", "c.ids_crc32", "c.round_trip")


def op9_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_slices.top_k(_table(spark, sf_dir, "embeddings"))


def op10_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = subword.classify(docs, _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    made = merkle.manifest(
        docs, tampered=F.crc32(F.col("doc_id").cast("string")) % 5 == 0, instead=F.translate("text", merkle.UPPER, merkle.LOWER), proofs=False)
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with noise: every seventh id counts as the next class."""
    rows = _table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long")))
    mined = hard_negatives.mine(rows, rows.where("vec_id % 50 = 0"))
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_pages": op1_language_pages,
    "op2_minhash_near_dup": op2_minhash_near_dup,
    "op3_token_files": op3_token_files,
    "op4_katz_scores": op4_katz_scores,
    "op5_toxicity": op5_toxicity,
    "op6_mix_sources": op6_mix_sources,
    "op7_perplexity_rules": op7_perplexity_rules,
    "op8_sentence_pieces": op8_sentence_pieces,
    "op9_bit_sliced_top_k": op9_bit_sliced_top_k,
    "op10_subword_quality": op10_subword_quality,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_set_join": op12_set_join,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES: dict[str, str] = {
    "op2_minhash_near_dup": near_dup.ORACLE,
    "op6_mix_sources": mixture.ORACLE,
    "op9_bit_sliced_top_k": bit_slices.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_set_join": set_join.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
