"""All detectors as one report, with the list of checks that ran, abstained or failed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import profile as prof
from plumbline.operators import quality as q

STATUS_SCHEMA = "check string, state string, detail string"


def quality_report(
    df: DataFrame,
    rules: Sequence[dict] = (),
    groups: dict[str, list[str]] | None = None,
    claimed: DataFrame | None = None,
    extra: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
    isolate: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Run every detector; returns ``(issues, status)``.

    Column detectors share one scan.  With ``isolate`` each detector is evaluated on its own, so that
    one failing at run time leaves the others standing; a failed check is listed and never clean.
    """
    status: list[tuple[str, str, str]] = []
    frames: list[tuple[str, DataFrame]] = []
    shared: list[q.Plan] = []

    def attempt(label: str, build):
        try:
            return build()
        except Exception as error:  # noqa: BLE001 - a failing check must not hide the others
            status.append((label, "failed", f"{type(error).__name__}: {error}"[:200]))
            return None

    if groups is None:
        groups = attempt("scale_groups", lambda: prof.scale_groups(df)) or {}
    planned = {
        "column_sum": lambda: q.plan_column_sum(df),
        "value_range": lambda: q.plan_value_range(df),
        "scale_range": lambda: q.plan_scale_range(groups),
        "integer_decimals": lambda: q.plan_integer_decimals(df),
        "low_variance": lambda: q.plan_low_variance(df),
        "reverse_scoring": lambda: q.plan_reverse_scoring(groups),
        "straightlining": lambda: q.plan_straightlining(groups),
        "missing_pattern": lambda: q.plan_missing_pattern(df),
        "rules": lambda: q.plan_rules(df, rules),
    }
    for label, build in planned.items():
        plans = attempt(label, build)
        if plans is None:
            continue
        status.append((label, "ran" if plans else "abstained", ""))
        if isolate and plans:
            frames.append((label, q.run_plans(df, plans)))
        else:
            shared += plans
    if shared:
        frames.append(("shared", q.run_plans(df, shared)))
    separate: dict[str, Callable[[DataFrame], DataFrame]] = {
        "duplicate_rows": q.check_duplicate_rows,
        "diff_regularity": q.check_diff_regularity,
        "response_duration": q.check_response_duration,
        "benford": q.check_benford,
        "terminal_digits": q.check_terminal_digits,
        **(extra or {}),
    }
    if claimed is not None:
        separate["declared_design"] = lambda frame: q.check_declared_design(frame, claimed)
    for label, check in separate.items():
        frame = attempt(label, lambda check=check: check(df))
        if frame is not None:
            status.append((label, "ran", ""))
            frames.append((label, frame))
    if isolate:
        kept = []
        for label, frame in frames:
            # issue rows number at most a few per column of the table
            rows = attempt(label, lambda frame=frame: frame.collect())
            if rows is None:
                status = [s for s in status if s[0] != label or s[1] == "failed"]
            else:
                kept.append(df.sparkSession.createDataFrame(rows, q.ISSUE_SCHEMA))
        issues = prof.union_all(kept) if kept else q.no_issues(df)
    else:
        issues = prof.union_all([f for _, f in frames]) if frames else q.no_issues(df)
    return issues, df.sparkSession.createDataFrame(status, STATUS_SCHEMA)


def sorted_issues(issues: DataFrame) -> DataFrame:
    rank = F.expr("case level when 'high' then 0 when 'mid' then 1 when 'low' then 2 else 9 end")
    return issues.orderBy(rank, "category", "check", "columns")


def verdict(issues: DataFrame, status: DataFrame) -> DataFrame:
    """Counts per level and a verdict that never calls an incomplete report clean."""
    counts = issues.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("level") == lv).alias(lv) for lv in ("high", "mid", "low")],
    )
    state = status.agg(
        F.count(F.lit(1)).alias("checks_total"),
        F.count_if(F.col("state") == "failed").alias("checks_failed"),
    )
    failed = F.col("checks_failed") > 0
    base = (
        F.when(F.col("high") > 0, "contradictions")
        .when(F.col("mid") > 0, "suspicious")
        .when(failed, "incomplete")
        .otherwise("nothing_found")
    )
    return counts.crossJoin(state).withColumn("verdict", base).withColumn(
        "complete", (F.col("checks_total") > 0) & ~failed)
