"""Ledger of findings: how often each was seen, what people said about it, and what follows.

The state of a finding is a small mergeable aggregate, so a batch, a stream of micro-batches and a late
file all lead to the same status.  Events: ``key, ts, action`` with action ``seen``, ``false_positive``
or ``useful``; optional ``source`` and ``sample``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: thresholds ---------------------------------------------------------------------
CONFIRM_SEEN = 3
USEFUL_SEEN = 2
REJECT_FALSE_POSITIVES = 2
#: Samples kept of each issue; its sources are all kept.
KEEP_SAMPLES = 5
TOP_ENTRIES = 5


def issue_key(issues: DataFrame) -> Column:
    """Key of an issue: its category and the first column it names, numbering stripped."""
    column = F.coalesce(F.try_element_at("columns", F.lit(1)), F.lit(""))
    return F.concat_ws("|", F.col("category"), F.lower(F.regexp_replace(column, r"[_\-\s]*\d+$", "")))


def _smallest(rows: DataFrame, value: str, k: int, out: str) -> DataFrame:
    """The k smallest values per key; ranking below k is pruned on the map side."""
    order = Window.partitionBy("key").orderBy(value)
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).groupBy("key").agg(
        F.array_sort(F.collect_list(value)).alias(out))


def aggregate_events(events: DataFrame, keep_samples: int = KEEP_SAMPLES) -> DataFrame:
    """One row per key with counts, the three earliest sightings, all sources, a few samples, and the context (value
    range ``low``, ``high``, where the events carry one) of the latest sighting."""
    seen = F.col("action") == "seen"
    ranged = {"low", "high"} <= set(events.columns)
    low, high = (F.col(c).cast("double") if ranged else F.lit(None).cast("double") for c in ("low", "high"))
    counts = events.groupBy("key").agg(
        F.count_if(seen).alias("seen"), F.count_if(F.col("action") == "false_positive").alias("false_pos"),
        F.count_if(F.col("action") == "useful").alias("useful"),
        F.min(F.when(seen, F.col("ts"))).alias("first_seen"),
        F.max(F.when(seen, F.col("ts"))).alias("last_seen"),
        F.min(F.when(F.col("action") == "false_positive", F.col("ts"))).alias("first_false"),
        F.max(F.when(F.col("action") == "useful", F.col("ts"))).alias("last_useful"),
        F.max(F.when(seen, F.struct("ts", low.alias("low"), high.alias("high")))).alias("context"))
    early = _smallest(events.where(seen), "ts", CONFIRM_SEEN, "sightings")
    out = counts.join(early, "key", "left")
    for column, name in (("sample", "samples"), ("source", "sources")):
        if column in events.columns:
            distinct = events.where(seen & F.col(column).isNotNull()).select("key", column).distinct()
            kept = _smallest(distinct, column, keep_samples, name) if column == "sample" else distinct.groupBy("key").agg(
                F.array_sort(F.collect_list(column)).alias(name))
            out = out.join(kept, "key", "left")
        else:
            out = out.withColumn(name, F.array().cast("array<string>"))
    empty = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>"))
    return out.withColumns({
        "sightings": empty(F.col("sightings"), "timestamp"),
        "samples": empty(F.col("samples"), "string"), "sources": empty(F.col("sources"), "string")})


def merge(a: DataFrame, b: DataFrame, keep_samples: int = KEEP_SAMPLES) -> DataFrame:
    """Merge two aggregates of the same keys; each key has at most one row on either side.  Of two contexts the later stays."""
    both = a.unionByName(b)
    joined = lambda c: F.flatten(F.collect_list(c))
    return both.groupBy("key").agg(
        *[F.sum(c).alias(c) for c in ("seen", "false_pos", "useful")],
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.min("first_false").alias("first_false"), F.max("last_useful").alias("last_useful"),
        F.slice(F.array_sort(joined("sightings")), 1, CONFIRM_SEEN).alias("sightings"),
        F.slice(F.array_sort(F.array_distinct(joined("samples"))), 1, keep_samples).alias("samples"),
        F.array_sort(F.array_distinct(joined("sources"))).alias("sources"), F.max("context").alias("context"))


def with_status(ledger: DataFrame) -> DataFrame:
    """Status of each key.

    Two false positives reject it for good.  Otherwise it is confirmed by the third sighting before any
    false positive, or by a useful mark after the second sighting.
    """
    third = F.try_element_at("sightings", F.lit(CONFIRM_SEEN))
    second = F.try_element_at("sightings", F.lit(USEFUL_SEEN))
    by_count = third.isNotNull() & F.coalesce(third < F.col("first_false"), F.lit(True))
    by_mark = second.isNotNull() & (F.col("last_useful") > second)
    return ledger.withColumn(
        "status",
        F.when(F.col("false_pos") >= REJECT_FALSE_POSITIVES, "rejected")
        .when(F.coalesce(by_count | by_mark, F.lit(False)), "confirmed").otherwise("candidate"))


def statistics(ledger: DataFrame) -> DataFrame:
    return with_status(ledger).agg(
        F.count(F.lit(1)).alias("entries"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("confirmed", "rejected", "candidate")])


def top(ledger: DataFrame, k: int = TOP_ENTRIES) -> DataFrame:
    """The ``k`` keys seen most, ties by key."""
    return ledger.select("key", "seen").orderBy(F.desc("seen"), "key").limit(k)


def annotate(issues: DataFrame, ledger: DataFrame) -> DataFrame:
    """Issues with what the ledger knows; rejected ones are marked muted, none are dropped."""
    known = with_status(ledger).select(
        F.col("key").alias("ledger_key"), F.col("seen").alias("times_seen"), "status",
        F.col("context.low").alias("known_low"), F.col("context.high").alias("known_high"))
    out = issues.withColumn("ledger_key", issue_key(issues)).join(known, "ledger_key", "left")
    return out.withColumns({
        "muted": F.coalesce(F.col("status") == "rejected", F.lit(False)),
        "times_seen": F.coalesce("times_seen", F.lit(0))})


def update(path: str):
    """A ``foreachBatch`` function that merges each micro-batch into versioned ledger files.

    A batch writes version ``v=<id>`` from the newest older version, so a repeated batch rewrites the
    same version instead of counting twice.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = aggregate_events(batch)
        old = read(spark, path, before=batch_id)
        merged = fresh if old is None else merge(old, fresh)
        merged.write.mode("overwrite").parquet(f"{path}/v={batch_id:012d}")

    return run


def read(spark, path: str, before: int | None = None) -> DataFrame | None:
    """The newest ledger version, optionally the newest before a batch."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    versions = sorted(
        int(s.getPath().getName()[2:]) for s in fs.listStatus(hadoop)
        if s.getPath().getName().startswith("v=")
        and fs.exists(jvm(s.getPath(), "_SUCCESS")))
    if before is not None:
        versions = [v for v in versions if v < before]
    return spark.read.parquet(f"{path}/v={versions[-1]:012d}") if versions else None
