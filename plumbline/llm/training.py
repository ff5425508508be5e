"""The bounded, documented sample of labelled rows that the classifiers learn from.

Cases: rows with a null id or label, or a label other than 0 and 1, teach nothing; an id labelled both ways counts as 1; of rows
that repeat an id the smallest text is taken, a null one only where there is no other; empty tables give an empty sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, bound: int) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``bound`` labelled documents outside the held-out fold.

    The fold of a row is crc32 of its id as text, modulo ``folds``; fold ``held`` is never learned from.  The
    sample is the ``bound`` smallest hashes of the ids, so reruns agree and no order of the table matters.
    """
    rows = labels.where(
        F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)
        & (F.crc32(F.col("doc_id").cast("string")) % folds != held))
    chosen = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(bound)
    # at most ``bound`` small rows
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.min("label").alias("label"))


def held_out(id: str, folds: int, held: int):
    return F.coalesce(F.crc32(F.col(id).cast("string")) % folds == held, F.lit(False))
