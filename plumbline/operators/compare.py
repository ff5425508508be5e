"""Joining claims with recomputed values, and texts with themselves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import fixed_text as ft
from plumbline.functions import numbers as num
from plumbline.operators.joins import eq_join

# --- fixed values: tolerances (agreeing below, minor below) ------------------------------------
TOLERANCES = {"r2": (0.05, 0.1), "pseudo_r2": (0.05, 0.1), "alpha": (0.05, 0.1), "p": (0.05, 0.1),
              "beta": (0.5, 1.0), "or": (0.5, 1.0)}
DEFAULT_TOLERANCE = (0.5, 1.0)
P_FLOOR, P_FLOOR_READS_AS = 0.0005, 0.001


def _banded(diff: Column, bands: tuple[float, float]) -> Column:
    return F.when(diff < bands[0], "ok").when(diff < bands[1], "minor_diff").otherwise("mismatch")


def compare_status(kind: Column, op: Column, claimed: Column, real: Column) -> Column:
    """Agreement of one claimed value with one recomputed value of the same kind.

    n must be equal.  A p given as a bound only has to lie on the right side of it; a p written as
    zero reads as below .001.
    """
    diff = F.abs(real - claimed)
    floor = F.lit(P_FLOOR_READS_AS + 1e-9)
    p_status = (
        F.when(F.coalesce(op, F.lit("lt")) == "lt",
               F.when(real <= claimed + 1e-4, "ok").otherwise("mismatch"))
        .when(op == "gt", F.when(real >= claimed - 1e-4, "ok").otherwise("mismatch"))
        .when(claimed < P_FLOOR, F.when(real < floor, "ok").otherwise("mismatch"))
        .when(real < P_FLOOR, F.when(claimed < floor, "ok").otherwise("mismatch"))
        .otherwise(_banded(diff, TOLERANCES["p"])))
    status = F.when(kind == "n", F.when(diff < 1e-9, "ok").otherwise("mismatch")).when(
        kind == "p", p_status)
    for name, bands in TOLERANCES.items():
        if name != "p":
            status = status.when(kind == name, _banded(diff, bands))
    return F.when(claimed.isNull() | real.isNull(), "unknown").otherwise(
        status.otherwise(_banded(diff, DEFAULT_TOLERANCE)))


def compare_claims(claims: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Claims (keys, kind, value, op) joined with results (keys, kind, value) and judged.

    Claims without a result stay with status ``unknown``.
    """
    real = results.select(*keys, "kind", F.col("value").alias("real"))
    out = eq_join(claims, real, [*keys, "kind"], "left")
    out = out.withColumn(
        "status", compare_status(F.col("kind"), F.col("op"), F.col("value"), F.col("real")))
    return out.withColumn(
        "diff", F.when(F.col("status") != "unknown", F.abs(F.col("value") - F.col("real"))))


def summarize_comparisons(comparisons: DataFrame) -> DataFrame:
    """Verdict field per comparison."""
    verdict = (
        F.when(F.col("status") == "ok", "agrees")
        .when(F.col("status") == "minor_diff", "check_rounding")
        .when(F.col("status") == "mismatch", "check_source_data")
        .when(F.col("status") == "no_real", "recompute_failed").otherwise("not_comparable"))
    return comparisons.withColumn("verdict", verdict)


def fold_table_mismatches(comparisons: DataFrame, table_mismatches: DataFrame) -> DataFrame:
    """Text-table mismatches as further comparison rows, their kind prefixed with ``table_``."""
    rows = table_mismatches.withColumn("kind", F.concat(F.lit("table_"), F.col("kind")))
    return comparisons.unionByName(rows, allowMissingColumns=True)


def filter_claims(
    claims: DataFrame, kinds: Sequence[str] | None = None, p_below: float | None = None,
    methods: Sequence[str] | None = None, variables: Sequence[str] | None = None,
) -> DataFrame:
    """Keep the kinds, methods or variables asked for; ``p_below`` keeps p-values under a bound."""
    out = claims
    if kinds is not None:
        out = out.where(F.col("kind").isin(*kinds))
    if p_below is not None:
        out = out.where((F.col("kind") != "p") | (F.col("value") < p_below))
    if methods is not None:
        out = out.where(F.col("method").isin(*methods))
    if variables is not None:
        hit = F.lit(False)
        for v in variables:
            hit = hit | F.lower("variable").contains(v.lower())
        out = out.where(hit)
    return out


# ---- abstract against body -------------------------------------------------------------------

def abstract_against_body(
    abstract: DataFrame, body: DataFrame, keys: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Best agreement of each abstract claim with the body claims of its kind.

    Returns ``(judged, missing)``; a kind that the body never reports is missing, not wrong.  Nearest
    body values are looked up in one ordered window per text and kind, so no pairs are formed.
    """
    a = abstract.select(*keys, "kind", "value", "op", "raw", "context", F.lit(1).alias("_a"))
    b = body.select(*keys, "kind", "value", F.lit(None).cast("string").alias("op"), "raw", "context",
                    F.lit(0).alias("_a")).where("value is not null")
    both = a.unionByName(b)
    value = F.when(F.col("_a") == 0, F.col("value"))
    firm = F.when((F.col("kind") != "p") | (value >= P_FLOOR), value)
    group = Window.partitionBy(*keys, "kind")
    up = group.orderBy("value", "_a").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = group.orderBy(F.desc("value"), "_a").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumns({
        "n_body": F.count(value).over(group), "min_body": F.min(value).over(group),
        "max_body": F.max(value).over(group),
        "below": F.last(firm, ignorenulls=True).over(up),
        "above": F.last(firm, ignorenulls=True).over(down)})
    claims = seen.where("_a = 1")
    v = F.col("value")
    gap = F.least(F.abs(v - F.col("below")), F.abs(F.col("above") - v))
    floor = F.lit(P_FLOOR_READS_AS + 1e-9)
    p_best = (
        F.when(F.coalesce("op", F.lit("lt")) == "lt",
               F.when(F.col("min_body") <= v + 1e-4, "ok").otherwise("mismatch"))
        .when(F.col("op") == "gt", F.when(F.col("max_body") >= v - 1e-4, "ok").otherwise("mismatch"))
        .when(v < P_FLOOR, F.when(F.col("min_body") < floor, "ok").otherwise("mismatch"))
        .when((F.col("min_body") < P_FLOOR) & (v < floor), "ok")
        .when(gap.isNull(), "mismatch").otherwise(_banded(gap, TOLERANCES["p"])))
    best = F.when(F.col("kind") == "n", F.when(gap < 1e-9, "ok").otherwise("mismatch")).when(
        F.col("kind") == "p", p_best)
    for name, bands in TOLERANCES.items():
        if name != "p":
            best = best.when(F.col("kind") == name, _banded(gap, bands))
    best = best.otherwise(_banded(gap, DEFAULT_TOLERANCE))
    judged = claims.where("n_body > 0").select(
        *keys, "kind", "value", "op", "raw", "context", "n_body", best.alias("status"),
        F.when(F.coalesce(F.abs(v - F.col("below")) <= F.abs(F.col("above") - v),
                          F.col("below").isNotNull()), F.col("below"))
        .otherwise(F.col("above")).alias("nearest"))
    return judged, claims.where("n_body = 0").select(*keys, "kind", "value", "raw", "context")


def soft_match_n(
    mismatched: DataFrame, body: DataFrame, keys: Sequence[str],
) -> DataFrame:
    """Explain sample sizes in an abstract that the body does not repeat.

    ``item_quantifier``: it counts items.  ``group_sum``: two to six body sizes add up to it.
    ``recruit_chain``: recruited, and more than half of them remain.  ``multi_study``: a sample of at
    least three times the size belongs to another study.
    """
    sizes = body.where("kind = 'n' and value = floor(value) and value > 0")
    # a list is built only where the number of sizes allows subset sums (2 to 6 of them)
    stats = sizes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_sizes"), F.max("value").alias("largest"),
        F.max_by("raw", "value").alias("largest_raw"))
    few = eq_join(sizes, stats.where("n_sizes between 2 and 6").select(*keys), keys)
    lists = few.groupBy(*keys).agg(F.collect_list(F.col("value").cast("long")).alias("sizes"))
    claims = mismatched.where("kind = 'n'")
    out = eq_join(eq_join(claims, stats, keys, "left"), lists, keys, "left")
    # the nearest smaller body size decides the recruitment chain
    smaller = claims.select(*keys, "value", F.lit(1).alias("_c")).distinct().unionByName(
        sizes.select(*keys, "value", F.lit(0).alias("_c")))
    upto = Window.partitionBy(*keys).orderBy("value", F.desc("_c")).rowsBetween(
        Window.unboundedPreceding, -1)
    below = smaller.withColumn(
        "below_n", F.last(F.when(F.col("_c") == 0, F.col("value")), True).over(upto)
    ).where("_c = 1").select(*keys, "value", "below_n")
    out = eq_join(out, below, [*keys, "value"], "left")
    x = F.col("value")
    k = F.size("sizes")
    subset = lambda mask: F.aggregate(
        F.transform("sizes", lambda v, i: F.when(
            F.expr("1").cast("long") * F.floor(mask / F.pow(F.lit(2.0), i)) % 2 == 1, v)
            .otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda s, v: s + v)
    bits = lambda mask: F.bit_count(mask)
    masks = F.sequence(F.lit(1), (F.pow(F.lit(2.0), k) - 1).cast("int"))
    sums = F.col("sizes").isNotNull() & F.exists(
        masks, lambda m: (bits(m) >= 2) & (subset(m) == x.cast("long")))
    words = F.concat_ws(" ", "context", "raw")
    big = F.col("largest")
    style = (
        F.when(words.rlike(ft.ITEM_QUANTIFIER), "item_quantifier")
        .when(sums, "group_sum")
        .when(words.rlike(ft.RECRUITED) & (F.col("below_n") > 0.5 * x), "recruit_chain")
        .when(((big >= 3 * x) | (x >= 3 * big)) & F.col("largest_raw").rlike(ft.LARGE_SAMPLE_WORDS)
              & F.col("context").rlike(ft.STUDY_WORDS), "multi_study"))
    return out.select(*keys, "value", "raw", "n_sizes", style.alias("style"))


# ---- declared sample size --------------------------------------------------------------------

def declared_n(
    claims: DataFrame, row_counts: DataFrame, keys: Sequence[str],
    table_n: DataFrame | None = None,
) -> DataFrame:
    """The sample size a text states most often against its table's rows.

    It passes when a printed table repeats it, or when any stated size equals the number of rows.
    """
    stated = claims.where("kind = 'n'").groupBy(*keys, F.col("value").cast("long").alias("value")).agg(
        F.sum(F.coalesce("count", F.lit(1)) if "count" in claims.columns else F.lit(1)).alias("c"))
    with_rows = eq_join(stated, row_counts.select(*keys, F.col("n").alias("rows")), keys, "left")
    if table_n is not None:
        printed = table_n.select(*keys, F.col("n").cast("long").alias("value"),
                                 F.lit(True).alias("in_table")).distinct()
        with_rows = eq_join(with_rows, printed, [*keys, "value"], "left")
    else:
        with_rows = with_rows.withColumn("in_table", F.lit(None).cast("boolean"))
    out = with_rows.groupBy(*keys).agg(
        F.max_by("value", F.struct("c", "value")).alias("declared"),
        F.coalesce(F.max_by("in_table", F.struct("c", "value")), F.lit(False)).alias("in_table"),
        F.bool_or(F.coalesce(F.col("value") == F.col("rows"), F.lit(False))).alias("any_equal"),
        F.max("rows").alias("rows"), F.count(F.lit(1)).alias("n_stated"))
    status = (
        F.when(F.coalesce("rows", F.lit(0)) == 0, "abstain")
        .when(F.col("in_table") | F.col("any_equal"), "ok").otherwise("mismatch"))
    return out.withColumns({
        "status": status,
        "diff": F.when(status == "mismatch", F.col("declared") - F.col("rows"))})


# ---- contracts of results --------------------------------------------------------------------

def contract_violations(
    results: DataFrame, keys: Sequence[str], p: Sequence[str] = (), df: Sequence[str] = (),
    n: Sequence[str] = (), finite: Sequence[str] = (),
) -> DataFrame:
    """Result rows that cannot be right: p outside [0, 1], df not positive, n below 2, not finite."""
    found = []
    for c in p:
        found.append(F.when(~F.col(c).between(0, 1) | F.isnan(c), F.lit(f"{c} outside 0..1")))
    for c in df:
        found.append(F.when(~(F.col(c) > 0), F.lit(f"{c} not positive")))
    for c in n:
        found.append(F.when(F.col(c) < 2, F.lit(f"{c} below 2")))
    for c in finite:
        value = F.col(c).cast("double")
        found.append(F.when(
            value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.lit(f"{c} not finite")))
    return results.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("violation"))


# ---- printed tables against data -------------------------------------------------------------

def _header_is(names: Sequence[str]) -> Column:
    plain = F.lower(F.regexp_replace("header", r"[\s*_]+", ""))
    return plain.isin(*names)


def table_statistics(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells under a mean, sd or n header: ``(keys, table_no, row_no, label, kind, raw, claimed)``.

    Tables with a literature-type header are skipped.
    """
    skip = F.max(F.col("header").rlike("|".join(ft.SKIP_HEADERS)).cast("int")).over(
        Window.partitionBy(*keys, "table_no"))
    label = F.max(F.when(F.col("col_no") == 0, F.trim("raw"))).over(
        Window.partitionBy(*keys, "table_no", "row_no"))
    kind = (
        F.when(_header_is(ft.MEAN_HEADERS), "mean").when(_header_is(ft.SD_HEADERS), "sd")
        .when(_header_is(ft.N_HEADERS), "n"))
    rows = cells.withColumns({"_skip": skip, "label": label, "kind": kind}).where(
        "_skip = 0 and kind is not null and col_no > 0")
    text = F.regexp_replace("raw", r"\s+", "")
    merged = F.when(F.col("kind") == "sd", F.regexp_extract(text, ft.MERGED_CELL, 2)).otherwise(
        F.regexp_extract(text, ft.MERGED_CELL, 1))
    plain = F.regexp_replace(F.regexp_replace(text, "%$", ""), ",", "").try_cast("double")
    value = F.when(text.rlike(ft.NUMBER_CELL), F.when(text.endswith("%"), plain / 100).otherwise(plain))
    return rows.select(
        *keys, "table_no", "row_no", "label", "kind", F.trim("raw").alias("raw"),
        F.coalesce(value, merged.try_cast("double")).alias("claimed")).where("claimed is not null")


def table_against_columns(
    statistics: DataFrame, column_stats: DataFrame, matches: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Printed mean and sd per row label against the matched column; tolerance is half a unit of the
    digits printed.

    ``column_stats``: keys, name, n, mean, sd.  ``matches``: keys, label, name.
    """
    rows = eq_join(statistics.where("kind <> 'n'"), matches.select(*keys, "label", "name"),
                   [*keys, "label"], "left")
    full = eq_join(rows, column_stats.select(*keys, "name", "n", "mean", "sd"), [*keys, "name"], "left")
    real = F.when(F.col("kind") == "mean", F.col("mean")).otherwise(F.col("sd"))
    digits = F.regexp_replace("raw", r"[%,]", "")
    tol = F.greatest(F.lit(1e-9), F.lit(0.5) * F.pow(F.lit(10.0), -num.decimals_of(digits)))
    diff = F.abs(real - F.col("claimed"))
    status = F.when(F.coalesce(F.col("n") < 2, F.lit(True)) | real.isNull(), "abstain").when(
        diff > tol, "mismatch").otherwise("ok")
    return full.select(
        *keys, "table_no", "row_no", "label", "kind", "raw", "claimed", "name", "n",
        real.alias("real"), diff.alias("diff"), tol.alias("tol"), status.alias("status"))


def group_rows(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows ``label | n | M | SD`` (any of n, M, SD, or ``M±SD``) of printed tables.

    A whole number under a header for sizes is a size however large; without one it is taken for a size up to 1000.
    """
    per = cells.where(F.trim("raw") != "").groupBy(*keys, "table_no", "row_no").agg(
        F.array_sort(F.collect_list(F.struct(
            "col_no", F.trim("raw").alias("t"), F.coalesce(_header_is(ft.N_HEADERS), F.lit(False)).alias("size")))).alias("_c"))
    texts = F.transform("_c", lambda c: c["t"])
    merged = r"^(-?\d+(?:\.\d+)?)\s*±\s*(\d+(?:\.\d+)?)$"
    number = r"^-?\d+(?:\.\d+)?$"
    numbers = F.flatten(F.transform(texts, lambda t: F.when(
        t.rlike(merged), F.array(F.regexp_extract(t, merged, 1), F.regexp_extract(t, merged, 2)))
        .when(t.rlike(number), F.array(t)).otherwise(F.array().cast("array<string>"))))
    labels = F.filter(texts, lambda t: ~t.rlike(merged) & ~t.rlike(number) & (F.length(t) <= 20)
                      & ~t.rlike("^(?:表|Table|注)"))
    v = lambda i: F.try_element_at("_n", F.lit(i)).try_cast("double")
    first = F.try_element_at("_n", F.lit(1))
    is_n = ~first.contains(".") & (v(1).between(1, 1000) | (F.col("_sized") & (v(1) >= 1)))
    sized = F.try_element_at(F.filter("_c", lambda c: c["t"].rlike(merged) | c["t"].rlike(number)), F.lit(1))["size"]
    out = per.withColumns({"_n": numbers, "_sized": F.coalesce(sized, F.lit(False)),
                           "label": F.try_element_at(labels, F.lit(1))}).where(
        "label is not null and size(_n) >= 2")
    only_two = (F.size("_n") == 2) & ~is_n
    return out.select(
        *keys, "table_no", "row_no", "label",
        F.when(~only_two & is_n, v(1).cast("long")).alias("n"),
        F.when(only_two | ~is_n, v(1)).otherwise(v(2)).alias("mean"),
        F.when(only_two | ~is_n, v(2)).otherwise(v(3)).alias("sd"))


def groups_against_data(
    printed: DataFrame, data: DataFrame, group: str, value: str, keys: Sequence[str]
) -> DataFrame:
    """Printed group rows against grouped data: n exactly, mean and sd within max(0.011, 0.5 %)."""
    real = data.where(F.col(group).isNotNull()).groupBy(
        *keys, F.trim(F.col(group).cast("string")).alias("label")).agg(
        F.count(F.lit(1)).alias("real_n"), F.count(value).alias("n_value"),
        F.avg(F.col(value).cast("double")).alias("real_mean"),
        F.stddev_samp(F.col(value).cast("double")).alias("real_sd"))
    rows = eq_join(printed, real, [*keys, "label"])
    near = lambda a, b: F.abs(a - b) <= F.greatest(F.lit(0.011), F.abs(b) * 0.005)
    judge = lambda ok, usable: F.when(
        ~F.coalesce(usable, F.lit(False)), "abstain").when(ok, "ok").otherwise("mismatch")
    checks = [
        ("n", F.col("n").cast("double"), F.col("real_n").cast("double"),
         judge(F.col("n") == F.col("real_n"), F.col("n").isNotNull())),
        ("mean", F.col("mean"), F.col("real_mean"),
         judge(near(F.col("real_mean"), F.col("mean")),
               F.col("mean").isNotNull() & (F.col("n_value") > 0))),
        ("sd", F.col("sd"), F.col("real_sd"),
         judge(near(F.col("real_sd"), F.col("sd")), F.col("sd").isNotNull() & (F.col("n_value") > 1))),
    ]
    return rows.select(*keys, "table_no", "row_no", "label", F.inline(F.array(*[
        F.struct(F.lit(k).alias("kind"), c.alias("claimed"), r.alias("real"), s.alias("status"))
        for k, c, r, s in checks])))
