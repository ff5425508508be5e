"""Data-quality detectors.

Column detectors are planned as aggregates plus issue structs, so that any number of them shares one
scan: ``run_plans`` builds a single wide aggregate and unfolds it into issue rows.  Each ``check_*``
has a matching ``violations_*`` where single rows can be named.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fv
from plumbline.functions import names
from plumbline.functions import numbers as num
from plumbline.operators import profile as prof
from plumbline.operators.joins import eq_join
from plumbline.operators.ordering import quantiles

ISSUE_SCHEMA = (
    "check string, level string, category string, columns array<string>, n_bad bigint, "
    "n_total bigint, metric map<string,double>"
)


@dataclass
class Plan:
    """Aggregates over the table and the issue struct they lead to (null when silent)."""

    aggs: list[Column]
    issue: Column
    label: str = ""
    tags: dict = field(default_factory=dict)


def issue(
    check: str, level: Column | str, category: str, columns: Sequence[str], n_bad: Column,
    n_total: Column, metric: dict[str, Column] | None = None, when: Column | None = None,
) -> Column:
    pairs = [x for k, v in (metric or {}).items() for x in (F.lit(k), v.cast("double"))]
    metrics = F.create_map(*pairs) if pairs else F.lit(None)
    struct = F.struct(
        F.lit(check).alias("check"),
        (level if isinstance(level, Column) else F.lit(level)).alias("level"),
        F.lit(category).alias("category"),
        F.array(*[F.lit(c) for c in columns]).cast("array<string>").alias("columns"),
        n_bad.cast("bigint").alias("n_bad"),
        n_total.cast("bigint").alias("n_total"),
        metrics.cast("map<string,double>").alias("metric"),
    )
    return F.when(when, struct) if when is not None else struct


def no_issues(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], ISSUE_SCHEMA)


def run_plans(df: DataFrame, plans: Sequence[Plan], batch: int = 60) -> DataFrame:
    """All plans over one scan per batch of plans."""
    if not plans:
        return no_issues(df)
    parts = []
    for i in range(0, len(plans), batch):
        chunk = plans[i:i + batch]
        row = df.agg(*[a for plan in chunk for a in plan.aggs])
        parts.append(prof.stacked(row, [plan.issue for plan in chunk]))
    return prof.union_all(parts)


def _numeric(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return list(columns) if columns is not None else names.numeric_columns(df)


def _x(column: str) -> Column:
    return F.col(f"`{column}`").cast("double")


# ---- range and integrality by column name ---------------------------------------------------

def _median_inside(prefix: str, lo: float, hi: float | None) -> Column:
    """Whether the exact median lies in [lo, hi], from counts and the values next to the bounds."""
    n, below = F.col(f"{prefix}n"), F.col(f"{prefix}below")
    above = F.col(f"{prefix}above")
    low_mid = (F.col(f"{prefix}max_below") + F.col(f"{prefix}min_from_lo")) / 2
    ok_low = F.when(2 * below < n, True).when(2 * below > n, False).otherwise(low_mid >= lo)
    if hi is None:
        return ok_low
    high_mid = (F.col(f"{prefix}max_to_hi") + F.col(f"{prefix}min_above")) / 2
    ok_high = F.when(2 * above < n, True).when(2 * above > n, False).otherwise(high_mid <= hi)
    return ok_low & ok_high


def plan_value_range(
    df: DataFrame, rules=fv.RANGE_RULES, columns: dict[str, tuple] | None = None
) -> list[Plan]:
    """Values outside the range that the column name implies.

    ``columns`` maps a column to its (low, high) and overrides the name rules.
    """
    chosen: list[tuple[str, float, float | None]] = []
    if columns is not None:
        chosen = [(c, lo, hi) for c, (lo, hi) in columns.items()]
    else:
        for c in names.numeric_columns(df):
            rule = next((r for r in rules if names.has_token(c, r[0])), None)
            if rule:
                chosen.append((c, rule[1], rule[2]))
    plans = []
    for i, (c, lo, hi) in enumerate(chosen):
        p, x = f"_range{i}_", _x(c)
        over = (x > hi) if hi is not None else F.lit(False)
        aggs = [
            F.count(x).alias(p + "n"), F.count_if(x < lo).alias(p + "below"),
            F.count_if(over).alias(p + "above"), F.min(x).alias(p + "min"),
            F.max(x).alias(p + "max"), F.max(F.when(x < lo, x)).alias(p + "max_below"),
            F.min(F.when(x >= lo, x)).alias(p + "min_from_lo"),
        ]
        if hi is not None:
            aggs += [F.max(F.when(x <= hi, x)).alias(p + "max_to_hi"),
                     F.min(F.when(x > hi, x)).alias(p + "min_above")]
        n = F.col(p + "n")
        bad = F.col(p + "below") + F.col(p + "above")
        inside = _median_inside(p, lo, hi)
        level = F.when(inside, "high").when(bad >= 0.9 * n, "mid")
        plans.append(Plan(aggs, issue(
            "value_range", level, "consistency", [c], bad, n,
            {"low": F.lit(lo), "high": F.lit(hi).cast("double"), "min": F.col(p + "min"),
             "max": F.col(p + "max")},
            when=(n >= 5) & (F.col(p + "min") < F.col(p + "max")) & (bad > 0) & level.isNotNull(),
        )))
    return plans


def plan_scale_range(groups: dict[str, list[str]]) -> list[Plan]:
    """Scale items with values outside 1..7 while at least 80 % lie inside."""
    plans = []
    for i, c in enumerate(c for members in groups.values() for c in members):
        p, x = f"_scale{i}_", _x(c)
        n, bad = F.col(p + "n"), F.col(p + "bad")
        plans.append(Plan(
            [F.count(x).alias(p + "n"),
             F.count_if(~x.between(fv.SCALE_LOW, fv.SCALE_HIGH)).alias(p + "bad")],
            issue("scale_range", "high", "consistency", [c], bad, n,
                  when=(n >= 5) & (bad > 0) & (bad <= 0.2 * n)),
        ))
    return plans


def plan_integer_decimals(
    df: DataFrame, tokens: Sequence[str] = fv.COUNT_TOKENS, columns: Sequence[str] | None = None
) -> list[Plan]:
    chosen = columns if columns is not None else [
        c for c in names.numeric_columns(df) if names.has_token(c, tokens)]
    plans = []
    for i, c in enumerate(chosen):
        p, x = f"_frac{i}_", _x(c)
        n, bad = F.col(p + "n"), F.col(p + "bad")
        plans.append(Plan(
            [F.count(x).alias(p + "n"), F.count_if(x != F.floor(x)).alias(p + "bad")],
            issue("integer_decimals", "high", "consistency", [c], bad, n,
                  when=(n >= 5) & (bad > 0) & (bad <= 0.2 * n)),
        ))
    return plans


def plan_low_variance(df: DataFrame, columns: Sequence[str] | None = None) -> list[Plan]:
    plans = []
    for i, c in enumerate(_numeric(df, columns)):
        p, x = f"_const{i}_", _x(c)
        n = F.col(p + "n")
        plans.append(Plan(
            [F.count(x).alias(p + "n"), F.min(x).alias(p + "a"), F.max(x).alias(p + "b")],
            issue("low_variance", "mid", "regularity", [c], n, n, {"value": F.col(p + "a")},
                  when=(n >= 5) & (F.col(p + "a") == F.col(p + "b"))),
        ))
    return plans


# ---- totals ----------------------------------------------------------------------------------

#: Most columns that are tried as one sum without a common prefix.
MOST_PARTS = 15


def _sum_candidates(total: str, numeric: Sequence[str]) -> list[list[str]]:
    others = [c for c in numeric if c != total]
    if len(others) < 2:
        return []
    groups = [g for g in names.prefix_groups(others).values() if len(g) >= 2]
    # with many columns "all of them" is no plausible sum, but the named groups still are
    whole = [others] if len(others) <= MOST_PARTS else []
    unique: list[list[str]] = []
    for candidate in [*whole, *groups]:
        if sorted(candidate) not in [sorted(u) for u in unique]:
            unique.append(candidate)
    return unique


def _sum_matches(total: str, parts: Sequence[str]) -> Column:
    """True / false where total and all parts are present, null elsewhere."""
    value = _x(total)
    added = sum((_x(c) for c in parts[1:]), _x(parts[0]))
    return F.abs(added - value) <= 0.015 + 1e-6 * F.abs(value)


def plan_column_sum(
    df: DataFrame, tokens: Sequence[str] = fv.TOTAL_TOKENS,
    totals: dict[str, list[list[str]]] | None = None,
) -> list[Plan]:
    """Total differs from the sum of its parts on some rows while it agrees on at least 60 %."""
    numeric = names.numeric_columns(df)
    if totals is None:
        totals = {t: _sum_candidates(t, numeric) for t in numeric if names.has_token(t, tokens)}
    plans = []
    for i, (total, candidates) in enumerate(totals.items()):
        if not candidates:
            continue
        aggs, scored = [], []
        for j, parts in enumerate(candidates):
            p = f"_sum{i}_{j}_"
            ok = _sum_matches(total, parts)
            aggs += [F.count(ok).alias(p + "n"), F.count_if(ok).alias(p + "ok")]
            n = F.col(p + "n")
            share = F.when(n >= 5, F.col(p + "ok") / n).otherwise(F.lit(0.0))
            bad = F.when(n >= 5, n - F.col(p + "ok")).otherwise(F.lit(0))
            scored.append(F.struct(
                share.alias("share"), F.lit(-j).alias("first"), bad.alias("bad"), n.alias("n"),
                F.array(*[F.lit(c) for c in [total, *parts]]).alias("columns"),
            ))
        best = F.array_max(F.array(*scored))
        struct = F.struct(
            F.lit("column_sum").alias("check"), F.lit("high").alias("level"),
            F.lit("consistency").alias("category"), best["columns"].alias("columns"),
            best["bad"].cast("bigint").alias("n_bad"), best["n"].cast("bigint").alias("n_total"),
            F.create_map(F.lit("match_share"), best["share"]).alias("metric"),
        )
        plans.append(Plan(aggs, F.when((best["share"] >= 0.6) & (best["bad"] > 0), struct)))
    return plans


def violations_column_sum(df: DataFrame, total: str, parts: Sequence[str]) -> DataFrame:
    return df.where(~_sum_matches(total, parts))


# ---- pre/post regularity ---------------------------------------------------------------------

def plan_diff_regularity(
    df: DataFrame, pairs: Sequence[tuple[str, str]] | None = None
) -> list[Plan]:
    """Constant change from pre to post although both sides take more than five values."""
    pairs = names.pre_post_pairs(names.numeric_columns(df)) if pairs is None else pairs
    plans = []
    for i, (pre, post) in enumerate(pairs):
        p = f"_diff{i}_"
        both = _x(pre).isNotNull() & _x(post).isNotNull()
        change = F.round(_x(post) - _x(pre), 6)
        n = F.col(p + "n")
        plans.append(Plan(
            [F.count_if(both).alias(p + "n"), F.min(change).alias(p + "a"),
             F.max(change).alias(p + "b"),
             F.count_distinct(F.when(both, _x(pre))).alias(p + "u1"),
             F.count_distinct(F.when(both, _x(post))).alias(p + "u2")],
            issue("diff_regularity", "mid", "regularity", [pre, post], n, n,
                  {"difference": F.col(p + "a")},
                  when=(n >= 8) & (F.col(p + "u1") > 5) & (F.col(p + "u2") > 5)
                  & (F.col(p + "a") == F.col(p + "b"))),
        ))
    return plans


# ---- scale answers ---------------------------------------------------------------------------

def _complete(items: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in items:
        out = out & _x(c).isNotNull()
    return out


def item_rest_aggs(items: Sequence[str], prefix: str) -> dict[str, Column]:
    """Correlation of every item with the sum of the other items, over complete rows."""
    full = _complete(items)
    total = sum((_x(c) for c in items[1:]), _x(items[0]))
    return {
        c: num.safe_corr(F.when(full, _x(c)), F.when(full, total - _x(c))).alias(f"{prefix}r{j}")
        for j, c in enumerate(items)
    }


def plan_reverse_scoring(groups: dict[str, list[str]]) -> list[Plan]:
    """Items that run against the rest of their scale (item-rest correlation <= -0.2)."""
    plans = []
    for i, (name, items) in enumerate(groups.items()):
        if len(items) < 3:
            continue
        p = f"_rev{i}_"
        aggs = [F.count_if(_complete(items)).alias(p + "n")]
        aggs += list(item_rest_aggs(items, p).values())
        against = F.array_compact(F.array(*[
            F.when(F.col(f"{p}r{j}") <= -0.2, F.lit(c)) for j, c in enumerate(items)]))
        metric = F.create_map(*[
            x for j, c in enumerate(items) for x in (F.lit(c), F.col(f"{p}r{j}"))])
        struct = F.struct(
            F.lit("reverse_scoring").alias("check"), F.lit("mid").alias("level"),
            F.lit("scale").alias("category"), against.alias("columns"),
            F.size(against).cast("bigint").alias("n_bad"), F.col(p + "n").alias("n_total"),
            metric.alias("metric"),
        )
        plans.append(Plan(aggs, F.when((F.col(p + "n") >= 8) & (F.size(against) > 0), struct)))
    return plans


def _flat(items: Sequence[str]) -> Column:
    return F.size(F.array_distinct(F.array(*[_x(c) for c in items]))) == 1


def plan_straightlining(groups: dict[str, list[str]]) -> list[Plan]:
    """Rows that give one answer to every item of a scale."""
    plans = []
    for i, (name, items) in enumerate(groups.items()):
        if len(items) < 3:
            continue
        p = f"_flat{i}_"
        n, bad = F.col(p + "n"), F.col(p + "bad")
        level = F.when(bad >= 0.5 * n, "high").otherwise("mid")
        plans.append(Plan(
            [F.count_if(_complete(items)).alias(p + "n"),
             F.count_if(_complete(items) & _flat(items)).alias(p + "bad")],
            issue("straightlining", level, "scale", items, bad, n, {"share": bad / n},
                  when=(n >= 10) & (bad > 0) & (bad >= 0.2 * n)),
        ))
    return plans


def violations_straightlining(df: DataFrame, items: Sequence[str]) -> DataFrame:
    return df.where(_complete(items) & _flat(items))


# ---- missing values --------------------------------------------------------------------------

def plan_missing_pattern(df: DataFrame, columns: Sequence[str] | None = None) -> list[Plan]:
    """Empty columns, columns with 30 % or more missing, and rows that are at least half empty."""
    columns = list(columns or df.columns)
    plans = []
    for i, c in enumerate(columns):
        p = f"_miss{i}_"
        n, bad = F.col(p + "n"), F.col(p + "bad")
        level = F.when(bad == n, "high").when(bad >= 0.3 * n, "mid")
        plans.append(Plan(
            [F.count(F.lit(1)).alias(p + "n"), F.count_if(F.col(f"`{c}`").isNull()).alias(p + "bad")],
            issue("missing_column", level, "missing", [c], bad, n, {"share": bad / n},
                  when=(n >= 5) & level.isNotNull()),
        ))
    if len(columns) >= 4:
        n, bad = F.col("_missrow_n"), F.col("_missrow_bad")
        plans.append(Plan(
            [F.count(F.lit(1)).alias("_missrow_n"),
             F.count_if(_half_empty(columns)).alias("_missrow_bad")],
            issue("missing_rows", "mid", "missing", [], bad, n, {"share": bad / n},
                  when=(n >= 5) & (bad > 0)),
        ))
    return plans


def _half_empty(columns: Sequence[str]) -> Column:
    empty = sum((F.col(f"`{c}`").isNull().cast("int") for c in columns), F.lit(0))
    return empty * 2 >= len(columns)


def violations_missing_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.where(_half_empty(list(columns or df.columns)))


# ---- user rules ------------------------------------------------------------------------------

def plan_rules(df: DataFrame, rules: Sequence[dict]) -> list[Plan]:
    """User rules ``{match, min, max, integer, name}``; silent when more than half break the rule."""
    plans = []
    for c in df.columns:
        for r, rule in enumerate(rules):
            if not any(str(k).lower() in c.lower() for k in rule.get("match") or []):
                continue
            p = f"_rule{r}_{len(plans)}_"
            x = F.col(f"`{c}`").try_cast("double")
            n, bad = F.col(p + "n"), F.col(p + "bad")
            lo, hi = rule.get("min"), rule.get("max")
            if lo is not None and hi is not None:
                plans.append(Plan(
                    [F.count(x).alias(p + "n"),
                     F.count_if((x < float(lo)) | (x > float(hi))).alias(p + "bad")],
                    issue("rule_range", "mid", "rule", [c], bad, n,
                          {"min": F.lit(float(lo)), "max": F.lit(float(hi))},
                          when=(bad > 0) & (2 * bad <= n)),
                ))
            if rule.get("integer"):
                q = p + "i"
                n2, bad2 = F.col(q + "n"), F.col(q + "bad")
                plans.append(Plan(
                    [F.count(x).alias(q + "n"), F.count_if(x != F.rint(x)).alias(q + "bad")],
                    issue("rule_integer", "low", "rule", [c], bad2, n2, {},
                          when=(bad2 > 0) & (2 * bad2 <= n2)),
                ))
    return plans


def rules_as_dicts(rules: DataFrame) -> list[dict]:
    """A rule table as plain rules; it must be small because it becomes part of the plan."""
    rows = rules.limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("a rule table holds at most 1000 rules")
    return [r.asDict(recursive=True) for r in rows]


# ---- public single checks --------------------------------------------------------------------

def check_value_range(df: DataFrame, **kw) -> DataFrame:
    return run_plans(df, plan_value_range(df, **kw))


def check_scale_range(df: DataFrame, groups: dict[str, list[str]] | None = None) -> DataFrame:
    return run_plans(df, plan_scale_range(prof.scale_groups(df) if groups is None else groups))


def check_integer_decimals(df: DataFrame, **kw) -> DataFrame:
    return run_plans(df, plan_integer_decimals(df, **kw))


def check_low_variance(df: DataFrame, **kw) -> DataFrame:
    return run_plans(df, plan_low_variance(df, **kw))


def check_column_sum(df: DataFrame, **kw) -> DataFrame:
    return run_plans(df, plan_column_sum(df, **kw))


def check_diff_regularity(df: DataFrame, **kw) -> DataFrame:
    return run_plans(df, plan_diff_regularity(df, **kw))


def check_reverse_scoring(df: DataFrame, groups: dict[str, list[str]] | None = None) -> DataFrame:
    return run_plans(df, plan_reverse_scoring(prof.scale_groups(df) if groups is None else groups))


def check_straightlining(df: DataFrame, groups: dict[str, list[str]] | None = None) -> DataFrame:
    return run_plans(df, plan_straightlining(prof.scale_groups(df) if groups is None else groups))


def check_missing_pattern(df: DataFrame, **kw) -> DataFrame:
    return run_plans(df, plan_missing_pattern(df, **kw))


def check_rules(df: DataFrame, rules: Sequence[dict]) -> DataFrame:
    return run_plans(df, plan_rules(df, rules))


def violations_range(df: DataFrame, column: str, lo: float, hi: float | None) -> DataFrame:
    bad = _x(column) < lo
    return df.where(bad | (_x(column) > hi) if hi is not None else bad)


# ---- duplicates ------------------------------------------------------------------------------

def duplicate_groups(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Value combinations that occur more than once, with their row count."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


#: Kinds of fingerprints beside those of single columns, which are numbered from 0.
WHOLE, BODY = -1, -2


def _fingerprint(kind: int, columns: Sequence[str], ok: Column, when: Column | None = None) -> Column:
    """128 bits of the values of ``columns``; a null is told from any value and from a null in another column."""
    values = [x for c in columns for x in (F.col(c), F.isnull(c))]
    out = F.struct(F.lit(kind).alias("kind"), F.xxhash64(F.lit(1), *values).alias("h1"),
                   F.xxhash64(F.lit(2), *values).alias("h2"), ok.alias("ok"))
    return out if when is None else F.when(when, out)


def fingerprint_counts(df: DataFrame, body: Sequence[str] = ()) -> DataFrame:
    """``kind, n_rows, n_unique, n_unique_ok, n_repeated``: rows, distinct fingerprints, those that a row with a complete body has, and
    rows that share theirs, of whole rows (``WHOLE``), complete bodies (``BODY``) and the values of each column.

    One scan and one exchange of fingerprints serve all kinds; counts are combined before it.  Among 10^12 different rows two share a
    fingerprint with a probability below 10^-14.
    """
    types, complete = dict(df.dtypes), F.lit(bool(body))
    for c in body:
        complete = complete & F.col(c).isNotNull()
        if types[c] in ("double", "float"):
            complete = complete & ~F.isnan(c)
    whole = [_fingerprint(WHOLE, df.columns, F.lit(True))]
    bodies = [_fingerprint(BODY, body, F.lit(True), complete)] if body else []
    single = [_fingerprint(k, [c], complete, F.col(c).isNotNull()) for k, c in enumerate(df.columns)]
    # a fingerprint left out is a row of nulls; an array function that takes it out before would keep the scan from being compiled
    spread = df.select(F.inline(F.array(*whole, *bodies, *single))).where(F.col("kind").isNotNull())
    # without a body the flag says no more than the kind
    ok, flags = (F.col("ok"), [F.max("ok").alias("ok")]) if body else (F.col("kind") == WHOLE, [])
    counted = spread.groupBy("kind", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), *flags)
    return counted.groupBy("kind").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_unique"), F.count_if(ok).alias("n_unique_ok"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("n_repeated"),
        F.count_if(F.col("n") > 1).alias("n_groups"))


def check_duplicate_rows(
    df: DataFrame, id_tokens: Sequence[str] = fv.ROW_ID_TOKENS,
    id_columns: Sequence[str] | None = None,
) -> DataFrame:
    """Exact duplicates, and duplicates once id columns are set aside.

    Exact ones are reported only when less than one chance pair is expected from the number of
    levels; the others only when a body column is nearly unique, which makes chance impossible.
    Both come from one table of fingerprints.
    """
    columns = df.columns
    ids = list(id_columns) if id_columns is not None else [
        c for c in columns if names.has_token(c, id_tokens)]
    body = [c for c in columns if c not in ids]
    by_body = bool(ids) and len(body) >= 3
    kind = F.col("kind")

    def of(which: int, value: str) -> Column:
        return F.coalesce(F.max(F.when(kind == which, F.col(value))), F.lit(0))

    row = fingerprint_counts(df, body if by_body else ()).agg(
        of(WHOLE, "n_rows").alias("n"), of(WHOLE, "n_repeated").alias("bad_exact"),
        of(BODY, "n_rows").alias("n_body"), of(BODY, "n_repeated").alias("bad_body"),
        of(BODY, "n_groups").alias("groups_body"),
        F.sum(F.when(kind >= 0, F.ln(F.greatest(F.lit(2), F.col("n_unique")).cast("double")))).alias("ln_combos"),
        F.max(F.when(kind.isin([k for k, c in enumerate(columns) if c in body]), F.col("n_unique_ok"))).alias("most_unique"))
    n, m = F.col("n"), F.col("n_body")
    expected = F.exp(F.ln(n * (n - 1) / 2) - F.col("ln_combos"))
    issues = [issue("duplicate_rows", "mid", "duplicate", columns, F.col("bad_exact"), n,
                    {"expected_pairs": expected},
                    when=(n >= 2) & (F.col("bad_exact") > 0) & (expected < 1.0))]
    if by_body:
        unique = (m >= 5) & (F.col("most_unique") >= F.greatest(F.lit(2.0), F.ceil(m * 0.95)))
        issues.append(issue("duplicate_body", "mid", "duplicate", body, F.col("bad_body"), m,
                            {"groups": F.col("groups_body")},
                            when=(F.col("bad_body") > 0) & unique))
    return prof.stacked(row, issues)


def violations_duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose ``columns`` occur more than once."""
    return eq_join(df, duplicate_groups(df, columns).drop("n"), columns, "left_semi")


# ---- too-fast answers ------------------------------------------------------------------------

def duration_columns(df: DataFrame) -> list[str]:
    return [
        c for c in names.numeric_columns(df)
        if names.has_token(c, fv.DURATION_TOKENS) and not names.has_token(c, fv.REACTION_TOKENS)
    ]


def check_response_duration(
    df: DataFrame, columns: Sequence[str] | None = None, fraction: float = 0.30
) -> DataFrame:
    """Durations below 30 % of the median, unless half or more of the rows would be flagged."""
    columns = duration_columns(df) if columns is None else list(columns)
    if not columns:
        return no_issues(df)
    parts = []
    for c in columns:
        frame = df.select(_x(c).alias("v")).where("v is not null")
        middle = quantiles(frame, [], "v", {"median": 0.5})
        row = frame.crossJoin(F.broadcast(middle)).agg(
            F.count(F.lit(1)).alias("n_rows"), F.max("median").alias("med"),
            F.count_if(F.col("v") < F.col("median") * fraction).alias("bad"))
        n, bad = F.col("n_rows"), F.col("bad")
        parts.append(prof.stacked(row, [issue(
            "response_duration", "mid", "scale", [c], bad, n,
            {"median": F.col("med"), "threshold": F.col("med") * fraction},
            when=(n >= 10) & (F.col("med") > 5) & (bad > 0) & (2 * bad < n))]))
    return prof.union_all(parts)


# ---- digits ----------------------------------------------------------------------------------

def _finite_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Finite values of numeric columns, long: ``(name, value)``."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), _x(c).alias("value")) for c in columns])))
    return long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def _digit_counts(
    df: DataFrame, columns: Sequence[str], digit: Callable[[Column], Column], digits: Sequence[int], exact: bool,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Counters of each column in one aggregate that shuffles one row per column and task.

    ``n_unique`` only feeds gates; it is an estimate (2 %) where that decides them surely.  The distinct values of the others
    are shuffled and counted: columns of few values, and those of ``keys`` whose values may be all different; with
    ``exact``, all columns.
    """
    if not columns:
        counters = ", ".join(f"{c} bigint" for c in ("n_values", "n_unique", "n", *[f"d{d}" for d in digits]))
        return df.sparkSession.createDataFrame([], f"name string, min double, max double, {counters}")
    long = _finite_values(df, columns)
    d = F.col("_digit")
    counts = long.withColumn("_digit", digit(F.col("value"))).groupBy("name").agg(
        F.count(F.lit(1)).alias("n_values"), F.approx_count_distinct("value", 0.02).alias("n_unique"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.count_if(d.isNotNull()).alias("n"),
        *[F.count_if(d == k).alias(f"d{k}") for k in digits])
    if exact:
        unique = long.distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n_unique"))
        return counts.drop("n_unique").join(unique, "name")
    # five errors of the estimate beside the gates at 5, 50 and "all different"
    unsure = F.col("n_unique") <= 60
    if keys:
        unsure |= F.col("name").isin(*keys) & (F.col("n_unique") >= 0.9 * F.col("n_values"))
    chosen = F.broadcast(counts.where(unsure).select("name"))  # a row per column of the table
    unique = long.join(chosen, "name", "left_semi").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("_counted"))
    return counts.join(F.broadcast(unique), "name", "left").withColumn(
        "n_unique", F.coalesce("_counted", "n_unique")).drop("_counted")


def benford_table(
    df: DataFrame, columns: Sequence[str] | None = None,
    skip: Sequence[str] = fv.BENFORD_SKIP_TOKENS, exact: bool = False,
) -> DataFrame:
    """First-digit shares against the logarithmic law: one row per column, with its status.

    Giving ``columns`` skips the gate on column names; the other gates stay.
    """
    chosen = list(columns) if columns is not None else [
        c for c in names.numeric_columns(df) if not names.has_token(c, skip)]
    counts = _digit_counts(df, chosen, num.first_digit, range(1, 10), exact)
    n = F.col("n")
    law = {d: F.log10(F.lit(1.0) + F.lit(1.0) / d) for d in range(1, 10)}
    gaps = [F.abs(F.col(f"d{d}") / n - law[d]) for d in range(1, 10)]
    mad = sum(gaps[1:], gaps[0]) / 9
    terms = [F.pow(F.col(f"d{d}") - law[d] * n, 2) / (law[d] * n) for d in range(1, 10)]
    worst = F.array_max(F.array(*[
        F.struct(g.alias("gap"), F.lit(-d).alias("digit")) for d, g in enumerate(gaps, 1)]))
    eligible = (
        (F.col("n_values") >= 100) & (F.col("min") > 0) & (F.col("n_unique") >= 50)
        & (F.col("max") / F.col("min") >= 100) & (n >= 100)
    )
    band = F.lit("off")
    for limit, label in reversed(fv.BENFORD_BANDS):
        band = F.when(F.col("mad") < limit, label).otherwise(band)
    return counts.where(n > 0).select(
        "name", "n", "n_unique", "min", "max", *[f"d{d}" for d in range(1, 10)],
        mad.alias("mad"), sum(terms[1:], terms[0]).alias("chi2"),
        (-worst["digit"]).cast("long").alias("worst_digit"), eligible.alias("eligible"),
    ).withColumn("band", band).withColumn(
        "status",
        F.when(~F.col("eligible"), "abstained")
        .when(F.col("mad") > fv.BENFORD_MAD_LIMIT, "flagged").otherwise("clear"),
    )


def terminal_table(
    df: DataFrame, columns: Sequence[str] | None = None,
    skip: Sequence[str] = fv.TERMINAL_SKIP_TOKENS, scale: int | None = None, exact: bool = False,
) -> DataFrame:
    """Last-digit shares against uniformity: one row per column, with its status.

    ``scale`` fixes the number of decimals that count as recorded (2 for prices in cents).  Integer columns whose values are
    all different look like keys and abstain.
    """
    chosen = list(columns) if columns is not None else [
        c for c in names.numeric_columns(df) if not names.has_token(c, skip)]
    integral = [f.name for f in df.schema.fields if f.dataType.typeName() in
                ("byte", "short", "integer", "long")]
    counts = _digit_counts(df, chosen, lambda v: num.terminal_digit(v, scale), range(10), exact, integral)
    n = F.col("n")
    terms = [F.pow(F.col(f"d{d}") - n / 10, 2) / (n / 10) for d in range(10)]
    top = F.array_max(F.array(*[
        F.struct(F.col(f"d{d}").alias("c"), F.lit(-d).alias("digit")) for d in range(10)]))
    key_like = F.col("name").isin(*integral) & (F.col("n_unique") >= F.col("n_values")) \
        if integral else F.lit(False)
    eligible = (
        (F.col("n_values") >= 50) & (F.col("n_unique") >= 5)
        & (F.col("max") - F.col("min") >= 10) & ~key_like & (n >= 50)
    )
    return counts.where(n > 0).select(
        "name", "n", "n_unique", *[f"d{d}" for d in range(10)],
        sum(terms[1:], terms[0]).alias("chi2"), (top["c"] / n).alias("top_share"),
        (-top["digit"]).cast("long").alias("top_digit"), eligible.alias("eligible"),
    ).withColumn(
        "status",
        F.when(~F.col("eligible"), "abstained")
        .when((F.col("chi2") > fv.CHI2_9_P001)
              & (F.col("top_share") >= fv.TERMINAL_SHARE_LIMIT), "flagged")
        .otherwise("clear"),
    )


def _table_issues(table: DataFrame, check: str, category: str, metrics: Sequence[str]) -> DataFrame:
    pairs = [x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))]
    return table.where("status = 'flagged'").select(
        F.lit(check).alias("check"), F.lit("mid").alias("level"),
        F.lit(category).alias("category"), F.array("name").alias("columns"),
        F.col("n").alias("n_bad"), F.col("n").alias("n_total"),
        F.create_map(*pairs).alias("metric"),
    )


def check_benford(df: DataFrame, **kw) -> DataFrame:
    return _table_issues(benford_table(df, **kw), "benford", "first_digit",
                         ["mad", "chi2", "worst_digit"])


def check_terminal_digits(df: DataFrame, **kw) -> DataFrame:
    return _table_issues(terminal_table(df, **kw), "terminal_digits", "last_digit",
                         ["chi2", "top_share", "top_digit"])


# ---- declared design -------------------------------------------------------------------------

def check_declared_design(df: DataFrame, claimed: DataFrame) -> DataFrame:
    """Methods claimed for the table (column ``method``) against what its columns allow."""
    paired = names.pre_post_pairs(df.columns)
    methods = claimed.select("method").distinct().agg(
        F.count_if(F.col("method").isin(*fv.PAIRED_METHODS)).alias("n_paired"),
        F.count_if(F.col("method").isin(*fv.GROUP_METHODS)).alias("n_group"),
    )
    groups = prof.group_candidates(df).agg(F.count(F.lit(1)).alias("n_candidates"))
    row = methods.crossJoin(groups)
    return prof.stacked(row, [
        issue("declared_paired", "mid", "design", df.columns, F.col("n_paired"), F.col("n_paired"),
              when=(F.col("n_paired") > 0) & F.lit(not paired)),
        issue("declared_groups", "mid", "design", df.columns, F.col("n_group"), F.col("n_group"),
              when=(F.col("n_group") > 0) & (F.col("n_candidates") == 0)),
    ])
