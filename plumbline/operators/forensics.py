"""Digit and arithmetic checks on printed tables, given as one row per cell.

Input ``cells``: key columns, ``table_no``, ``row_no`` (order of the printed rows), ``col_no``,
``header``, ``raw``.  Every family returns findings in one shape and can tell which tables it could
judge at all; the rest count as abstained.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import dist
from plumbline.functions import fixed_text as ft
from plumbline.operators.consistency import grim_verdict
from plumbline.operators.joins import eq_join, small_side
from plumbline.operators.profile import union_all
from plumbline.session import pin

# --- fixed values: gates ------------------------------------------------------------------------
MIN_COLUMN_VALUES = 3
MIN_COLUMN_DECIMALS = 20
MIN_TAIL = 3
TAIL_P = 1e-4
MIN_RELATION_ROWS = 8
#: The narrower rule set looks at tables of at most 12 numeric columns; the default has no limit.
NARROW_RELATION_COLUMNS = 12
MIN_RUN = 5
MIN_PERCENT_ROWS = 3
PERCENT_TOLERANCE = 0.6
NUMBER = r"-?\d+(?:\.\d+)?"


def _table(keys: Sequence[str]) -> list[str]:
    return [*keys, "table_no"]


def _column(keys: Sequence[str]) -> list[str]:
    return [*keys, "table_no", "col_no"]


def _parsed(cells: DataFrame) -> DataFrame:
    """Add ``_n`` (numbers in the cell) and, where it is one, its ``text``, ``value`` and ``decimals``."""
    if "_n" in cells.columns:
        return cells
    # the numbers are found once, as an array
    found = cells.withColumn("_found", F.regexp_extract_all("raw", F.lit(f"({NUMBER})"), F.lit(1)))
    text = F.when(F.size("_found") == 1, F.col("_found")[0])
    return found.select(
        *cells.columns, F.coalesce(F.size("_found"), F.lit(0)).alias("_n"), text.alias("text"), text.try_cast("double").alias("value"),
        F.when(text.contains("."), F.length(F.substring_index(text, ".", -1))).otherwise(
            F.when(text.isNotNull(), 0)).alias("decimals"))


def numeric_columns(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns whose cells hold exactly one number each, at least three of them, with features.

    ``coarse``: all on a 0.5 grid.  ``int_col``: whole numbers with five or more distinct values.
    """
    value, decimals = F.col("value"), F.col("decimals")
    on_grid = F.abs(value * 2 - F.rint(value * 2)) < 1e-9
    per = _parsed(cells).groupBy(*_column(keys)).agg(
        F.max("header").alias("header"), F.count_if(F.col("_n") > 1).alias("_bad"),
        F.count_if(F.col("_n") == 1).alias("n"), F.count_if(decimals > 0).alias("n_decimals"),
        F.bool_and(on_grid).alias("_grid"), F.max(decimals).alias("max_decimals"),
        # asked of columns without decimals only
        F.count_distinct(F.when(decimals == 0, value)).alias("n_distinct"))
    return per.where((F.col("_bad") == 0) & (F.col("n") >= MIN_COLUMN_VALUES)).select(
        *_column(keys), "header", "n", "n_decimals",
        ((F.col("n") >= 5) & F.col("_grid")).alias("coarse"),
        ((F.col("max_decimals") == 0) & (F.col("n_distinct") >= 5)).alias("int_col"),
        F.col("header").rlike(ft.DESIGN_HEADER).alias("design"))


def numeric_cells(cells: DataFrame, columns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Single-number cells of the given columns, with value, text and decimals."""
    base = _parsed(cells).where("_n = 1").select(*_column(keys), "row_no", "text", "value", "decimals")
    # few long columns would be few tasks of a shuffle, so their list goes to the cells where it is short
    return eq_join(base, small_side(pin(columns)), _column(keys))


def finding(
    df: DataFrame, keys: Sequence[str], family: str, group: str, level: str,
    columns: Column, metric: dict[str, Column],
) -> DataFrame:
    pairs = [x for k, v in metric.items() for x in (F.lit(k), v.cast("double"))]
    return df.select(
        *_table(keys), F.lit(family).alias("family"), F.lit(group).alias("group"),
        F.lit(level).alias("level"), columns.cast("array<string>").alias("columns"),
        F.create_map(*pairs).alias("metric"))


def digit_tables(cells: DataFrame, keys: Sequence[str], columns: DataFrame | None = None) -> DataFrame:
    """F1 statistics per eligible column: last-decimal chi-square and corrected top share."""
    cols = (numeric_columns(cells, keys) if columns is None else columns).where(
        (~F.col("coarse")) & (F.col("n_decimals") >= MIN_COLUMN_DECIMALS))
    base = numeric_cells(cells, cols.select(*_column(keys), "header"), keys).where("decimals > 0")
    digit = F.right("text", F.lit(1)).cast("int")
    per = base.groupBy(*_column(keys), "header").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(digit == d).alias(f"d{d}") for d in range(10)])
    n = F.col("n")
    terms = [F.pow(F.col(f"d{d}") - n / 10, F.lit(2)) / (n / 10) for d in range(10)]
    top = F.array_max(F.array(*[
        F.struct(F.col(f"d{d}").alias("c"), F.lit(-d).alias("d")) for d in range(10)]))
    chi2 = sum(terms[1:], terms[0])
    out = per.select(*_column(keys), "header", "n", chi2.alias("chi2"), top["c"].alias("top_count"),
                     (-top["d"]).alias("top_digit"))
    p_share = F.least(F.lit(1.0), dist.p_binom(F.col("top_count"), F.col("n"), 0.1) * 10)
    return out.withColumn("p", F.least(dist.p_chi2(F.col("chi2"), 9), p_share))


def check_last_digits(cells: DataFrame, keys: Sequence[str], columns: DataFrame | None = None) -> DataFrame:
    found = digit_tables(cells, keys, columns).where("p < 1e-3")
    return finding(found, keys, "F1", "digit", "mid", F.array("header"),
                   {"n": F.col("n"), "chi2": F.col("chi2"), "top_digit": F.col("top_digit"),
                    "p": F.col("p")})


def tail_tables(cells: DataFrame, keys: Sequence[str], columns: DataFrame | None = None) -> DataFrame:
    """F2 statistics: the most frequent two-digit tail against a Poisson expectation."""
    cols = (numeric_columns(cells, keys) if columns is None else columns).where(
        (~F.col("coarse")) & (F.col("n_decimals") >= MIN_COLUMN_DECIMALS))
    base = numeric_cells(cells, cols.select(*_column(keys), "header"), keys).where("decimals > 0")
    size = F.abs("value")
    tail = (F.bround((size - F.floor(size)) * 100, 0) % 100).cast("int")
    counted = base.groupBy(*_column(keys), "header", tail.alias("tail")).agg(
        F.count(F.lit(1)).alias("c"))
    per = counted.groupBy(*_column(keys), "header").agg(
        F.sum("c").alias("n"), F.max(F.struct("c", (-F.col("tail")).alias("t"))).alias("top"))
    out = per.select(*_column(keys), "header", "n", F.col("top.c").alias("top_count"),
                     (-F.col("top.t")).alias("tail"))
    return out.withColumn("p", F.least(F.lit(1.0), dist.p_poisson(
        F.col("top_count"), F.col("n") * 0.01) * 100))


def check_tails(cells: DataFrame, keys: Sequence[str], columns: DataFrame | None = None) -> DataFrame:
    found = tail_tables(cells, keys, columns).where((F.col("p") < TAIL_P) & (F.col("top_count") >= MIN_TAIL))
    return finding(found, keys, "F2", "tail", "mid", F.array("header"),
                   {"n": F.col("n"), "tail": F.col("tail"), "count": F.col("top_count"),
                    "p": F.col("p")})


def check_mixed_precision(cells: DataFrame, keys: Sequence[str], columns: DataFrame | None = None) -> DataFrame:
    """nearly all values of a column share their decimals and a few do not."""
    cols = (numeric_columns(cells, keys) if columns is None else columns).where("not coarse and not int_col and n >= 10")
    base = numeric_cells(cells, cols.select(*_column(keys), "header"), keys)
    counted = base.groupBy(*_column(keys), "header", "decimals").agg(F.count(F.lit(1)).alias("c"))
    per = counted.groupBy(*_column(keys), "header").agg(
        F.sum("c").alias("n"), F.max("c").alias("modal"), F.max_by("decimals", "c").alias("decimals"))
    minority = F.col("n") - F.col("modal")
    found = per.where((F.col("modal") >= 0.9 * F.col("n")) & (minority > 0)
                      & (minority < 0.1 * F.col("n")))
    return finding(found, keys, "F3", "precision", "low", F.array("header"),
                   {"n": F.col("n"), "decimals": F.col("decimals"), "odd": minority})


#: Rows of a printed column that one task orders at a time.
RUN_CHUNK = 4096


def _in_chunks(cells: DataFrame, by: Sequence[str], size: int) -> DataFrame:
    """Number the values of each column: add ``chunk``, ``i`` (from 1), ``edge`` (last number of the chunk), ``prev`` and ``prev2``.

    Values are ordered inside chunks of ``size`` row numbers; a chunk then hears from a summary how many values precede it and which two.
    """
    inside = Window.partitionBy(*by, "chunk").orderBy("row_no")
    local = cells.withColumn("chunk", F.floor(F.col("row_no") / size)).withColumns({
        "k": F.row_number().over(inside), "p1": F.lag("value").over(inside), "p2": F.lag("value", 2).over(inside)})
    ends = local.groupBy(*by, "chunk").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("row_no", "value", "p1")).alias("end"))
    chunks = Window.partitionBy(*by).orderBy("chunk")
    tails = F.flatten(F.collect_list(F.array_compact(F.array("end.p1", "end.value"))).over(chunks.rowsBetween(-2, -1)))
    heard = ends.withColumns({
        "ahead": F.coalesce(F.sum("n").over(chunks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "tails": tails})
    heard = heard.select(*by, "chunk", "ahead", (F.col("ahead") + F.col("n")).alias("edge"),
                         F.try_element_at("tails", F.lit(-1)).alias("c1"), F.try_element_at("tails", F.lit(-2)).alias("c2"))
    k = F.col("k")
    return eq_join(local, heard, [*by, "chunk"]).withColumns({
        "i": F.col("ahead") + k, "prev": F.when(k == 1, F.col("c1")).otherwise(F.col("p1")),
        "prev2": F.when(k == 1, F.col("c2")).when(k == 2, F.col("c1")).otherwise(F.col("p2"))}).drop("k", "p1", "p2", "c1", "c2", "ahead")


def progression_runs(cells: DataFrame, keys: Sequence[str], chunk: int = RUN_CHUNK, columns: DataFrame | None = None) -> DataFrame:
    """runs of five or more values with constant step or constant ratio, in printed order; the longest of each column.

    Runs are found inside chunks of ``chunk`` rows.  Of a chunk only its long runs and those at its borders go on; where a chunk begins
    inside a run, the parts are joined, so a column of any length needs no single task.
    """
    by = _column(keys)
    cols = (numeric_columns(cells, keys) if columns is None else columns).where("not design and not int_col")
    base = _in_chunks(numeric_cells(cells, cols.select(*by, "header"), keys), by, chunk).where("prev is not null")

    def step(x: str, before: str) -> Column:
        return F.when(F.col(x) != F.col(before), F.col(x) - F.col(before))

    def ratio(x: str, before: str) -> Column:
        quotient = F.when(F.col(before) != 0, F.col(x) / F.col(before))
        return F.when(F.abs(quotient - 1) >= 1e-9, quotient)

    def change(kind: str, of, tolerance: float) -> Column:
        now, last = of("value", "prev"), of("prev", "prev2")
        same = F.abs(now - last) <= tolerance * F.greatest(F.abs(now), F.lit(1.0))
        return F.struct(F.lit(kind).alias("kind"), now.alias("change"), (~F.coalesce(same, F.lit(False))).cast("int").alias("new"))

    marked = base.select(*by, "header", "chunk", "i", "edge", F.inline(F.array(
        change("arithmetic", step, 1e-9), change("geometric", ratio, 1e-6))))
    part = F.sum("new").over(Window.partitionBy(*by, "chunk", "kind").orderBy("i"))
    parts = marked.withColumn("part", part).where("change is not null").groupBy(*by, "header", "kind", "chunk", "part").agg(
        F.min("i").alias("first"), F.max("i").alias("last"), F.min_by("change", "i").alias("constant"),
        F.max("new").alias("new"), F.max("edge").alias("edge"))
    kept = parts.where((F.col("last") - F.col("first") + 2 >= MIN_RUN) | (F.col("last") == F.col("edge")) | (F.col("new") == 0))
    run = F.sum("new").over(Window.partitionBy(*by, "kind").orderBy("first"))
    both = kept.withColumn("run", run).groupBy(*by, "header", "kind", "run").agg(
        (F.min("first") - 1).alias("first"), F.max("last").alias("last"), F.min_by("constant", "first").alias("constant")).where(
        F.col("last") - F.col("first") + 1 >= MIN_RUN).drop("run")
    longest = Window.partitionBy(*by).orderBy(F.desc(F.col("last") - F.col("first")), "kind", "first")
    return both.withColumn("_r", F.row_number().over(longest)).where("_r = 1").drop("_r")


def check_progression(cells: DataFrame, keys: Sequence[str], columns: DataFrame | None = None) -> DataFrame:
    return finding(progression_runs(cells, keys, columns=columns), keys, "F4", "progression", "low",
                   F.array("header"),
                   {"first": F.col("first"), "last": F.col("last"), "constant": F.col("constant")})


def column_relations(cells: DataFrame, keys: Sequence[str], most_columns: int | None = None,
                     columns: DataFrame | None = None) -> DataFrame:
    """two columns of a table that differ by a constant, or keep a constant ratio.

    Tables with two or more numeric columns take part; ``most_columns`` leaves out wider ones, as a row forms one pair
    for every two columns.
    """
    cols = (numeric_columns(cells, keys) if columns is None else columns).where("not design")
    eligible = cols.groupBy(*_table(keys)).agg(F.count(F.lit(1)).alias("k")).where(
        (F.col("k") >= 2) & (F.lit(most_columns is None) | (F.col("k") <= (most_columns or 0))))
    kept = eq_join(cols, eligible.select(*_table(keys)), _table(keys), "left_semi")
    base = numeric_cells(cells, kept.select(*_column(keys), "header"), keys)
    rows = base.groupBy(*_table(keys), "row_no").agg(F.array_sort(F.collect_list(
        F.struct("col_no", "header", "value", "decimals"))).alias("v"))
    pairs = F.flatten(F.transform("v", lambda a, i: F.transform(
        F.filter("v", lambda b: (b["col_no"] > a["col_no"]) & (b["decimals"] == a["decimals"])),
        lambda b: F.struct(
            a["col_no"].alias("col_a"), b["col_no"].alias("col_b"), a["header"].alias("a"),
            b["header"].alias("b"), a["value"].alias("x"), b["value"].alias("y")))))
    long = rows.select(*_table(keys), F.inline(pairs))
    pair = [*_table(keys), "col_a", "col_b", "a", "b"]
    ratio = F.when(F.col("x") != 0, F.col("y") / F.col("x"))
    middle = long.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("n"), F.count(ratio).alias("n_ratio"),
        F.greatest(F.max(F.abs("x")), F.max(F.abs("y")), F.lit(1e-12)).alias("scale"),
        F.percentile_approx(F.col("y") - F.col("x"), 0.5, 10000).alias("offset"),
        F.percentile_approx(ratio, 0.5, 10000).alias("ratio"),
    ).where(F.col("n") >= MIN_RELATION_ROWS)
    judged = eq_join(long, middle, pair).groupBy(*pair).agg(
        *[F.max(c).alias(c) for c in ("n", "n_ratio", "scale", "offset", "ratio")],
        F.avg((F.abs(F.col("y") - F.col("x") - F.col("offset")) <= 0.01 * F.col("scale") + 1e-12)
              .cast("double")).alias("offset_share"),
        F.avg((F.abs(ratio - F.col("ratio")) <= 0.01 * F.abs("ratio") + 1e-9).cast("double"))
        .alias("ratio_share"))
    by_offset = (F.col("offset_share") >= 0.95) & (
        F.abs("offset") > 0.01 * F.col("scale") + 1e-12)
    by_ratio = (F.col("n_ratio") >= MIN_RELATION_ROWS) & (F.col("ratio_share") >= 0.95) & (
        F.abs(F.col("ratio") - 1) > 1e-6)
    kind = F.when(by_offset, "offset").when(by_ratio, "ratio")
    return judged.withColumn("kind", kind).where("kind is not null").select(
        *_table(keys), "a", "b", "kind", "n",
        F.when(by_offset, F.col("offset")).otherwise(F.col("ratio")).alias("constant"),
        F.when(by_offset, F.col("offset_share")).otherwise(F.col("ratio_share")).alias("share"))


def check_relations(cells: DataFrame, keys: Sequence[str], columns: DataFrame | None = None) -> DataFrame:
    found = column_relations(cells, keys, columns=columns)
    return finding(found, keys, "F5", "relation", "low", F.array("a", "b"),
                   {"n": F.col("n"), "constant": F.col("constant"), "share": F.col("share")})


def total_mismatches(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """F6a: a total inside a row, or a last row of totals, that its parts do not add up to."""
    numbers = F.transform(F.regexp_extract_all("raw", F.lit(f"({NUMBER})"), F.lit(1)),
                          lambda x: x.try_cast("double"))
    marked = cells.withColumns({"_v": numbers, "_total": F.col("raw").rlike(ft.TOTAL_LABEL)})
    added = F.aggregate("_v", F.lit(0.0), lambda s, x: s + x)
    single = F.when(F.size("_v") == 1, F.col("_v")[0])
    tolerance = lambda s: F.greatest(F.lit(0.05), 5e-3 * F.greatest(F.abs(s), F.lit(1.0)))
    per_row = marked.groupBy(*_table(keys), "row_no").agg(
        F.sum(added).alias("_sum"), F.sum(F.size("_v")).alias("_n"),
        F.count_if(F.col("_total") & (F.size("_v") == 1)).alias("_totals"),
        F.max(F.when(F.col("_total") & (F.size("_v") == 1), F.col("_v")[0])).alias("written"),
        F.max(F.when(F.col("_total"), F.col("raw"))).alias("label"))
    rest = F.col("_sum") - F.col("written")
    in_row = per_row.where((F.col("_totals") == 1) & (F.col("_n") - 1 >= 2)).select(
        *_table(keys), F.lit("row").alias("direction"), F.col("label").alias("name"),
        rest.alias("parts"), "written", (F.abs(rest - F.col("written")) > tolerance(rest)).alias("bad"))
    ends = marked.groupBy(*_table(keys)).agg(F.max("row_no").alias("last"))
    last = eq_join(marked, ends, _table(keys)).withColumn("_is_last", F.col("row_no") == F.col("last"))
    labelled = last.where("_is_last and col_no < 2").groupBy(*_table(keys)).agg(
        F.bool_or("_total").alias("_ok")).where("_ok")
    per_col = eq_join(last, labelled.select(*_table(keys)), _table(keys), "left_semi").where(
        "col_no >= 1").groupBy(*_column(keys)).agg(
        F.max("header").alias("name"),
        F.sum(F.when(~F.col("_is_last"), single)).alias("parts"),
        F.count(F.when(~F.col("_is_last"), single)).alias("_n"),
        F.max(F.when(F.col("_is_last"), single)).alias("written"))
    in_col = per_col.where("written is not null and _n >= 2").select(
        *_table(keys), F.lit("column").alias("direction"), "name", "parts", "written",
        (F.abs(F.col("parts") - F.col("written")) > tolerance(F.col("parts"))).alias("bad"))
    return in_row.unionByName(in_col)


def check_totals(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    found = total_mismatches(cells, keys).where("bad")
    out = finding(found, keys, "F6", "", "mid", F.array("name"),
                  {"parts": F.col("parts"), "written": F.col("written"),
                   "by_column": (F.col("direction") == "column").cast("int")})
    level = F.when(F.col("metric")["by_column"] == 1, "low").otherwise("mid")
    return out.withColumn("level", level)


def percent_rows(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """F6b rows: count, percent and the percent expected from the table's total.

    The total row's count is the base where there is one, else the sum of the counts.  A table where
    most rows disagree has another base and abstains as a whole (column ``status``).
    """
    table = _table(keys)
    heads = cells.groupBy(*table).agg(
        F.min(F.when(F.col("header").rlike(ft.PERCENT_HEADER), F.col("col_no"))).alias("pct_col"))
    with_pct = eq_join(cells, heads.where("pct_col is not null"), table)
    counts = with_pct.where("col_no <> pct_col").groupBy(*table).agg(
        F.min(F.when(F.col("header").rlike(ft.COUNT_HEADER), F.col("col_no"))).alias("cnt_col"))
    both = eq_join(with_pct, counts.where("cnt_col is not null"), table)
    n_numbers = F.regexp_count("raw", F.lit(NUMBER))
    number = F.when(n_numbers == 1, F.regexp_extract("raw", f"({NUMBER})", 1).try_cast("double"))
    is_cnt, is_pct = F.col("col_no") == F.col("cnt_col"), F.col("col_no") == F.col("pct_col")
    rows = both.groupBy(*table, "row_no").agg(
        F.max(F.when(F.col("col_no") == 0, F.trim("raw"))).alias("label"),
        F.max(F.when(is_cnt, number)).alias("count"), F.max(F.when(is_pct, number)).alias("percent"),
        F.count_if((is_cnt | is_pct) & (n_numbers > 1)).alias("_odd"))
    total = F.col("label").rlike(ft.TOTAL_LABEL) & F.col("percent").isNotNull()
    rows = rows.withColumn("is_total", F.coalesce(total, F.lit(False)))
    item = ~F.col("is_total") & F.col("percent").isNotNull()
    base = rows.groupBy(*table).agg(
        F.count_if(item).alias("_items"), F.sum("_odd").alias("_odds"),
        F.count_if((F.col("count") < 0) | (F.col("count") != F.floor("count"))).alias("_no_count"),
        F.max(F.when(F.col("is_total"), F.col("count"))).alias("_total"),
        F.sum(F.when(item, F.col("count"))).alias("_sum"))
    usable = (F.col("_items") >= MIN_PERCENT_ROWS) & (F.col("_odds") == 0) & (F.col("_no_count") == 0)
    base = base.where(usable).select(*table, F.coalesce("_total", "_sum").alias("base")).where("base > 0")
    items = eq_join(rows.where(item & F.col("count").isNotNull()), base, table)
    items = items.withColumn("expected", F.col("count") / F.col("base") * 100).withColumn(
        "bad", F.abs(F.col("expected") - F.col("percent")) > PERCENT_TOLERANCE)
    share = items.groupBy(*table).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("bad").alias("n_bad")).where(
        F.col("n_rows") >= MIN_PERCENT_ROWS)
    status = F.when(2 * F.col("n_bad") > F.col("n_rows"), "abstain").when(
        F.col("bad"), "mismatch").otherwise("ok")
    return eq_join(items, share, table).withColumn("status", status).select(
        *table, "row_no", "label", "count", "percent", "base", "expected", "n_rows", "n_bad", "status")


def check_percentages(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    found = percent_rows(cells, keys).where("status = 'mismatch'")
    return finding(found, keys, "F6", "", "mid", F.array("label"),
                   {"count": F.col("count"), "percent": F.col("percent"),
                    "expected": F.col("expected"), "base": F.col("base")})


#: Beyond these the GRIM test of a printed row abstains.
GRIM_LARGEST_N, GRIM_MOST_DECIMALS = 100_000, 3


def grim_rows(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """verdict for every row that prints both a sample size and a mean."""
    text = F.trim("raw")
    own = F.regexp_extract_all("raw", F.lit(f"({NUMBER})"), F.lit(1))
    header_n = F.col("header").rlike(ft.N_CELL)
    n_value = (
        F.when(text.rlike(r"^[nN]\s*[=：:]\s*\d+"), F.regexp_extract(text, r"[=：:]\s*(\d+)", 1))
        .when(header_n & (F.size(own) == 1), own[0]))
    merged = F.regexp_extract("raw", ft.MEAN_SD_CELL, 1)
    mean_text = (
        F.when(merged != "", merged)
        .when((F.col("col_no") > 0) & F.col("header").rlike(ft.MEAN_CELL_HEADER)
              & (F.size(own) == 1) & own[0].contains("."), own[0]))
    per = cells.groupBy(*_table(keys), "row_no").agg(
        F.min_by(n_value.try_cast("double"), F.when(n_value.isNotNull(), F.col("col_no"))).alias("n"),
        F.min_by(mean_text, F.when(mean_text.isNotNull(), F.col("col_no"))).alias("mean_text"))
    decimals = F.length(F.regexp_extract("mean_text", r"\.(\d+)", 1))
    rows = per.where((F.col("n") >= 3) & F.col("mean_text").isNotNull()).withColumns({
        "mean": F.col("mean_text").try_cast("double"), "decimals": decimals})
    verdict = grim_verdict(F.col("mean"), F.col("n"), F.col("decimals"))
    # a size or a precision beyond the test's reach stays in the table and says so
    beyond = (F.col("n") > GRIM_LARGEST_N) | (F.col("decimals") > GRIM_MOST_DECIMALS)
    return rows.withColumn("verdict", F.when(beyond, "abstain").otherwise(verdict))


def check_grim(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    found = grim_rows(cells, keys).where("verdict = 'impossible'")
    return finding(found, keys, "F7", "grim", "mid", F.array("mean_text"),
                   {"n": F.col("n"), "mean": F.col("mean"), "row_no": F.col("row_no")})


COLUMN_CHECKS = (check_last_digits, check_tails, check_mixed_precision, check_progression, check_relations)
CHECKS = (*COLUMN_CHECKS, check_totals, check_percentages, check_grim)
VOTING = ("digit", "tail", "precision", "progression", "relation")


def fuse_votes(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lower statistical findings of a text to ``low`` when only one independent kind speaks.

    Last digits and tails look at the same digits and count once; so do progression and relation when
    both speak.  Arithmetic contradictions keep their level.
    """
    vote = F.when(F.col("group").isin("digit", "tail"), "digits").otherwise(F.col("group"))
    per = findings.where(F.col("group").isin(*VOTING)).groupBy(*keys).agg(
        F.count_distinct(vote).alias("_kinds"),
        F.bool_or(F.col("group") == "progression").alias("_p"),
        F.bool_or(F.col("group") == "relation").alias("_r"))
    votes = per.select(*keys, (
        F.col("_kinds") - (F.col("_p") & F.col("_r")).cast("int")).cast("long").alias("votes"))
    out = eq_join(findings, votes, keys, "left") if keys else findings.crossJoin(votes)
    alone = F.col("group").isin(*VOTING) & (F.col("votes") == 1)
    return out.withColumn("level", F.when(alone, "low").otherwise(F.col("level")))


def audit_tables(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All families over all tables, with the votes fused per text.

    Cells are parsed and columns judged once for all families; the findings are read for the votes and again with them.
    """
    cells = pin(_parsed(cells))
    columns = pin(numeric_columns(cells, keys))
    found = [check(cells, keys, columns) if check in COLUMN_CHECKS else check(cells, keys) for check in CHECKS]
    return fuse_votes(pin(union_all(found)), keys)


def participation(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per text and family: ``applicable`` with how much could be judged, or ``abstained``."""
    cols = numeric_columns(cells, keys)
    per_table = cols.where("not design").groupBy(*_table(keys)).agg(
        F.count(F.lit(1)).alias("k"), F.max("n").alias("rows"))
    counted = [
        ("F1", cols.where((~F.col("coarse")) & (F.col("n_decimals") >= MIN_COLUMN_DECIMALS))),
        ("F2", cols.where((~F.col("coarse")) & (F.col("n_decimals") >= MIN_COLUMN_DECIMALS))),
        ("F3", cols.where("not coarse and not int_col and n >= 10")),
        ("F4", cols.where("not design and not int_col")),
        ("F5", per_table.where((F.col("k") >= 2) & (F.col("rows") >= MIN_RELATION_ROWS))),
        ("F6", total_mismatches(cells, keys).select(*keys).unionByName(
            percent_rows(cells, keys).where("status <> 'abstain'").select(*keys))),
        ("F7", grim_rows(cells, keys).where(f"n <= {GRIM_LARGEST_N} and decimals <= {GRIM_MOST_DECIMALS}")),
    ]
    parts = [frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("judged")).withColumn(
        "family", F.lit(family)) for family, frame in counted]
    judged = union_all(parts)
    families = F.explode(F.array(*[F.lit(f) for f, _ in counted])).alias("family")
    grid = cells.select(*keys).distinct().select(*keys, families)
    out = eq_join(grid, judged, [*keys, "family"], "left")
    return out.select(
        *keys, "family", F.coalesce("judged", F.lit(0)).alias("judged"),
        F.when(F.coalesce("judged", F.lit(0)) > 0, "applicable").otherwise("abstained")
        .alias("state"))
