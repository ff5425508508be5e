"""From raw documents to token ids: quality, language, near-duplicates, mixing, encoding.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; all but the last return the columns of
``documents``.  ``run`` writes each stage's result as Parquet into the folder that ``spark.checkpoint.dir`` names and rereads it, so a lost
executor or a failed stage never repeats the stages before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import language, mixture, near_dup, pieces, subword
from plumbline.llm.queries import small_batches, tokenizer_path
from plumbline.llm.token_files import shared_folder
from plumbline.operators.joins import small_side


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    small_batches(spark)
    scored = subword.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 1").select(*docs.columns)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified surely enough."""
    small_batches(spark)
    found = language.identify_documents(docs, language.fit_text(docs))
    return found.where("accepted").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one of the smallest id.  Documents without an id stay; of rows that
    repeat an id the smallest stays."""
    small_batches(spark)
    dropped = near_dup.link(docs, width=5).where("NOT kept").select("doc_id").distinct()
    single = docs.join(small_side(dropped), "doc_id", "left_anti")
    repeated = small_side(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    others = [c for c in docs.columns if c != "doc_id"]
    once = single.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*others)).alias("row"))
    return single.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(
        once.select("doc_id", "row.*").select(*docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers that bring each source to its target; a source's last document may be cut."""
    small_batches(spark)
    return mixture.expand(mixture.mix(docs), docs.columns, length="n_chars" if "n_chars" in docs.columns else None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids``.  Ids are decoded where they are made; the job stops at ids that do not give the text as the
    model normalises it."""
    small_batches(spark)
    coded = docs.select("doc_id", "source", pieces.coded_udf(tokenizer_path("piece_bpe_32k.model"))("text").alias("c"))
    ids = F.when(F.coalesce("c.round_trip", F.lit(True)), F.col("c.ids")).otherwise(F.raise_error(F.concat(
        F.lit("ids do not decode to the text of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("without id")))))
    return coded.select("doc_id", "source", ids.alias("ids")).select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality),
    ("language ID", languages),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]

#: The trained and probabilistic stages have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
