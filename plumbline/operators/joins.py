"""Join helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import BROADCAST_ROWS


def eq_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Null-safe equality join on ``keys``; without keys the right side must be a single row."""
    if not keys:
        return left.crossJoin(right)
    marked = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"`{k}`").eqNullSafe(F.col(f"`__r_{k}`"))
    joined = left.join(marked, condition, how)
    return joined.drop(*[c for c in joined.columns if c.startswith("__r_")])


def small_side(side: DataFrame) -> DataFrame:
    """Broadcast hint for an already materialised side, only when its rows were counted small."""
    return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side


def unfold(frame: DataFrame, keep: Sequence[str], array: str, present: str) -> DataFrame:
    """Rows of an array-of-structs column; ``present`` names a field that is never null.

    ``inline`` on a plain column makes the optimizer infer a size filter and push it below, where it
    would compute the array a second time.  The outer form has no such filter.
    """
    return frame.select(*keep, F.inline_outer(array)).where(F.col(present).isNotNull())
