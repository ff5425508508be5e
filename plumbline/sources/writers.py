"""Writing cleaned copies, issue runs and the ledger; an input is never overwritten."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _plain(path: str) -> str:
    parsed = urlparse(path)
    return (parsed.path or path).rstrip("/")


def write_copy(
    df: DataFrame, path: str, sources: list[str] | None = None, fmt: str = "parquet"
) -> None:
    """Write a cleaned copy; refuses a path that is, holds or lies inside one of the inputs."""
    inputs = sources if sources is not None else df.inputFiles()
    target = _plain(path)
    for source in map(_plain, inputs):
        if source == target or source.startswith(target + "/") or target.startswith(source + "/"):
            raise ValueError("the target of a cleaned copy must differ from its source")
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def append_issues(issues: DataFrame, path: str, run: str) -> None:
    """Append one run of issues; a repeated run replaces only its own partition."""
    issues.withColumn("run", F.lit(run)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)
