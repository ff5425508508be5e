"""Reading study tables, texts and rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import fixed_text as ft

#: Encodings tried in order.
ENCODINGS = ("utf-8", "gbk", "gb18030")
_REPLACEMENT = "\ufffd"


def read_csv(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None,
    encodings: Sequence[str] = ENCODINGS, multi_line: bool = False,
) -> DataFrame:
    """Read CSV in the first encoding that decodes without replacement characters.

    Each encoding is tried by a text scan that stops at the first undecodable line.  A byte-order mark
    is dropped from the first header name.
    """
    if "utf-8" not in [e.lower() for e in encodings[:1]]:
        raise ValueError("utf-8 is tried first")
    for encoding in encodings:
        if not _decodes(spark, path, encoding):
            continue
        reader = spark.read.option("header", True).option("multiLine", multi_line)
        if encoding.lower() != "utf-8":
            _allow_java_charsets(spark)
            reader = reader.option("encoding", encoding)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        df = reader.csv(path)
        return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})
    raise ValueError(f"none of {list(encodings)} decodes the file")


def _allow_java_charsets(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def _decodes(spark: SparkSession, path: str | Sequence[str], encoding: str) -> bool:
    """Whether all bytes decode; the check runs where the data is and returns one row at most."""
    paths = [path] if isinstance(path, str) else list(path)
    if encoding.lower() == "utf-8":
        bad = spark.read.text(paths).where(~F.is_valid_utf8("value"))
    else:
        _allow_java_charsets(spark)
        raw = spark.read.option("header", False).option("encoding", encoding).option(
            "sep", "\u0001").schema("value string").csv(paths)
        bad = raw.where(F.col("value").contains(_REPLACEMENT))
    return bad.limit(1).count() == 0


def read_texts(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per file: ``(path, text)`` with Unix line ends."""
    frame = spark.read.text(path, wholetext=True)
    return frame.select(F.col("_metadata.file_path").alias("path"),
                        unix_lines(F.col("value")).alias("text"))


def spread(texts: DataFrame) -> DataFrame:
    """Spread texts over the cores when a scan yields fewer partitions than there are cores.

    Text checks are heavy per byte, and one small file is one task.  A scan that is already wide is
    left alone, so large inputs are never shuffled for this.
    """
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartition(cores) if texts.rdd.getNumPartitions() < cores else texts


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def is_front_matter(
    text: Column, markers: Sequence[str] = ft.FRONT_MATTER_MARKERS,
    short: int = ft.FRONT_MATTER_MAX, long: int = ft.FRONT_MATTER_MAX_STRICT,
) -> Column:
    """A cover or copyright page: few characters and several marker words, blanks ignored."""
    def judged(plain: Column) -> Column:
        hits = F.size(F.filter(F.array(*map(F.lit, markers)), lambda m: plain.contains(m)))
        size = F.length(plain)
        return F.when(size >= F.lit(max(short, long)), False).when(
            size.isNotNull(), ((hits >= 2) & (size < short)) | ((hits >= 3) & (size < long)))

    # bound by a lambda, so that the blanks of a text are taken out once and not at every use
    return F.transform(F.array(F.regexp_replace(text, r"\s+", "")), judged)[0]


def drop_front_matter(pages: DataFrame, text: str = "text", **kw) -> DataFrame:
    return pages.where(~is_front_matter(F.col(text), **kw))


RULE_SCHEMA = ("name string, match array<string>, min double, max double, integer boolean, "
               "note string")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """User rules from JSON: a list of rules, or an object with a ``rules`` list."""
    frame = spark.read.option("multiLine", True).schema(
        f"rules array<struct<{RULE_SCHEMA.replace(' string', ':string').replace(' array<', ':array<').replace(' double', ':double').replace(' boolean', ':boolean')}>>, "
        + RULE_SCHEMA).json(path)
    nested = frame.where("rules is not null").select(F.inline("rules"))
    plain = frame.where("rules is null").drop("rules")
    return nested.unionByName(plain).where("size(match) > 0")
