"""Registry of queries and their oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.readers import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Tables of texts: heavy per byte, so a scan of few files is spread over the cores.
TEXT_TABLES = ("documents", "pages", "conversations")

AREAS = ("quality", "tests", "matrix", "reported", "tables", "corpus", "evaluation", "events")


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``tables('orders')`` reads one table."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


class Tables:
    """Reader for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __call__(self, name: str) -> DataFrame:
        frame = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(frame) if name in TEXT_TABLES else frame


def load() -> None:
    for area in AREAS:
        importlib.import_module(f"plumbline.plans.{area}")


def rounded(df: DataFrame, digits: int = 6, /, **special: int) -> DataFrame:
    """Round every double so that two engines agree on the last digits; counts become long."""
    out: list[Column] = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(c.cast("double"), special.get(field.name, digits)).alias(field.name))
        elif isinstance(field.dataType, T.IntegralType):
            out.append(c.cast("long").alias(field.name))
        elif isinstance(field.dataType, T.BooleanType):
            out.append(c.cast("long").alias(field.name))
        else:
            out.append(c)
    return df.select(*out)


def flat_issues(df: DataFrame) -> DataFrame:
    """Issue rows with their column list as text."""
    return df.select(
        "check", "level", F.concat_ws(",", "columns").alias("columns"), "n_bad", "n_total")
