"""Mixing sources to target weights.

Every document gets a hash-random key; documents of a source are ordered by it.  The running word count
in that order comes from prefix sums in two levels: inside ranges of the key, and over the totals of the
ranges.  A source of any size is thus spread over all ranges.  Whole epochs come first, then the first
documents in key order until the source's budget is met exactly: the document at the cut gives its first
words.

Cases: a null source is a source of its own, last in order; a null or empty text has size 0 and nothing
is taken of it; repeated rows are separate documents; rows that agree in id, source, size and text are
interchangeable; an empty table gives an empty result.  Columns other than ``id``, ``source`` and ``text`` pass
through unless they carry the name of an added column, which replaces them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Hexadecimal digits of the key that name a range: 4096 ranges in each source.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_EPOCHS, source: str = "source"
) -> DataFrame:
    """``(source, source_size, target)``, one row per source.

    Weights repeat along the sources in code-point order, nulls last.  A target is ``level * weight`` but at
    most ``most`` times the source's size, with one level for all, such that the targets add up to all
    sizes: what resharing an excess by weight ends in.  The windows see one row per source.
    """
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    sums = sized.groupBy(source).agg(F.sum("size").alias("source_size"))
    weighted = sums.withColumn(
        "_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    ).withColumn("_most", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("_most") / F.col("_w"), F.col(source).asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_most").over(before), F.lit(0))) / F.sum("_w").over(after)
    placed = weighted.withColumn("_level", level)
    open_ = F.when(F.col("_level") * F.col("_w") <= F.col("_most"), F.col("_level"))
    return placed.withColumn("_open", F.max(open_).over(every)).select(
        source, "source_size",
        F.least(F.col("_most").cast("double"), F.col("_open") * F.col("_w")).alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = "mix",
    id: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """All rows and columns of ``docs`` with ``size, source_size, target, epochs, part, taken``.

    ``taken = epochs * size + part``: whole repeats, and words of the last, partial epoch.
    """
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "epochs", "part", "taken")]
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id).cast("string"), F.lit("null"))))
    sized = docs.select(*kept, word_count(F.col(text)).alias("size")).withColumn("_key", key).withColumn(
        "_range", F.substring("_key", 1, RANGE_DIGITS)).withColumn("_text", F.xxhash64(text))
    totals = sized.groupBy(source, "_range").agg(F.sum("size").alias("_in_range"))
    ranges = Window.partitionBy(source).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_in_range").over(ranges), F.lit(0)))
    targets = source_targets(totals.withColumnRenamed("_in_range", "size"), weights, most, source)
    o, t = offsets.alias("o"), targets.alias("t")
    bases = o.join(t, F.col(f"o.{source}").eqNullSafe(F.col(f"t.{source}"))).select(
        F.col(f"o.{source}").alias("_source"), F.col("_range").alias("_r"), "_offset", "source_size", "target")
    inside = Window.partitionBy(source, "_range").orderBy("_key", id, "size", "_text").rowsBetween(
        Window.unboundedPreceding, -1)
    ordered = sized.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = ordered.join(
        bases, (F.col("_range") == F.col("_r")) & F.col(source).eqNullSafe(F.col("_source")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = F.col("_budget") - F.col("epochs") * F.col("source_size") - F.col("_offset") - F.col("_inside")
    return (
        joined.withColumn("_budget", budget).withColumn("epochs", epochs)
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
        .select(*kept, "size", "source_size", "target", "epochs", "part", "taken")
    )


def expand(mixed: DataFrame, columns: Sequence[str], text: str = "text", length: str | None = None) -> DataFrame:
    """The mix itself: ``columns`` of each document once per epoch, and its part of the last epoch.

    The document at the cut keeps its first words and the space between them; ``length`` names a column of character
    counts to renew there.
    """
    pieces = F.split(F.col(text), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each ends with a word
    cut = F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.col("part"), F.lit(1)).cast("int")), "")
    copies = F.concat(
        F.array_repeat(F.lit(True), F.col("epochs").cast("int")),
        F.array_repeat(F.lit(False), (F.col("part") > 0).cast("int")))
    out = mixed.select("*", F.explode(copies).alias("_epoch")).withColumn(
        "_whole", F.col("_epoch") | (F.col("part") == F.col("size"))).withColumn(
        text, F.when(F.col("_whole"), F.col(text)).otherwise(cut))
    if length is not None:
        out = out.withColumn(length, F.when(F.col("_whole"), F.col(length)).otherwise(F.length(text)))
    return out.select(*columns)

ORACLE = r"""
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM g),
l AS (SELECT *, 3 * source_size AS most, sum(source_size) OVER () AS total,
  coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
  sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_after FROM w),
v AS (SELECT *, (total - full_before)::DOUBLE / w_after AS level FROM l),
t AS (SELECT source, source_size, least(most::DOUBLE, w * (SELECT max(level) FROM v WHERE level * w <= most)) AS target FROM v),
b AS (SELECT s.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
  coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('mix:' || coalesce(s.doc_id::VARCHAR, 'null')), s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM e
"""
