"""Matching names in texts and printed tables with the columns of data tables.

Column-name tables are metadata (one row per column), so containment joins against them are small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import fixed_text as ft
from plumbline.functions import fixed_values as fv
from plumbline.functions import names

#: A column catalogue wider than this is not broadcast.
MAX_CATALOGUE = 50_000


def column_catalogue(df: DataFrame) -> DataFrame:
    """One row per column: ``(name, position, is_numeric)``."""
    numeric = set(names.numeric_columns(df))
    rows = [(c, i, c in numeric) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, "name string, position int, is_numeric boolean")


def _small(catalogue: DataFrame) -> DataFrame:
    rows = catalogue.limit(MAX_CATALOGUE + 1).count()
    return F.broadcast(catalogue) if rows <= MAX_CATALOGUE else catalogue


def _contains_each_other(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def _best(pairs: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    order = Window.partitionBy(*keys, label).orderBy("stage", "position")
    return pairs.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(
        *keys, label, "name", "stage")


def match_variables(
    variables: DataFrame, catalogue: DataFrame, keys: Sequence[str] = (), label: str = "variable",
    synonyms: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Named variables to columns: exact, then ignoring case, then containment, then synonyms.

    The earliest stage wins, and within a stage the first column of the table.
    """
    table = ft.VARIABLE_SYNONYMS if synonyms is None else synonyms
    distinct = variables.select(*keys, label).where(F.trim(label) != "").distinct()
    low_label, low_name = F.lower(F.trim(label)), F.lower("name")
    pairs = [x for k, vs in table.items() for x in (F.lit(k), F.array(*[F.lit(v.lower()) for v in vs]))]
    lookup = F.create_map(*pairs) if pairs else None
    words = (F.concat(F.coalesce(lookup[F.col(label)], F.array().cast("array<string>")),
                      F.coalesce(lookup[low_label], F.array().cast("array<string>")))
             if lookup is not None else F.array().cast("array<string>"))
    expanded = distinct.withColumn("_words", words)
    stage = (
        F.when(F.col(label) == F.col("name"), 1).when(low_label == low_name, 2)
        .when(_contains_each_other(low_label, low_name), 3)
        .when(F.exists("_words", lambda w: _contains_each_other(w, low_name)), 4))
    joined = expanded.join(_small(catalogue), stage.isNotNull()).withColumn("stage", stage)
    return _best(joined, keys, label)


def match_labels(
    labels: DataFrame, catalogue: DataFrame, keys: Sequence[str] = (), label: str = "label"
) -> DataFrame:
    """Row labels of a printed table to columns: exact, normalised, containment."""
    def plain(c: Column) -> Column:
        return F.regexp_replace(c, r"[\s_\-（）()：:、]+", "")

    a, b = plain(F.col(label)), plain(F.col("name"))
    stage = (
        F.when(F.trim(label) == F.col("name"), 1).when(a == b, 2)
        .when((F.length(b) >= 2) & _contains_each_other(a, b), 3))
    distinct = labels.select(*keys, label).where(F.trim(label) != "").distinct()
    joined = distinct.join(_small(catalogue), stage.isNotNull()).withColumn("stage", stage)
    return _best(joined, keys, label)


def level_sets(df: DataFrame, columns: Sequence[str] | None = None, limit: int = 10) -> DataFrame:
    """Distinct values of columns with at most ``limit`` of them: ``(name, position, levels)``.

    ``HAVING`` on the distinct count comes before the list is built, so no long list ever forms.
    """
    from plumbline.operators.profile import column_frequency
    columns = list(columns or df.columns)
    freq = column_frequency(df, columns)
    narrow = freq.groupBy("name").agg(F.count(F.lit(1)).alias("n_unique")).where(
        F.col("n_unique") <= limit)
    levels = freq.join(F.broadcast(narrow.select("name")), "name").groupBy("name").agg(
        F.array_sort(F.collect_set(F.trim("value"))).alias("levels"))
    position = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("name")) - 1
    return levels.withColumn("position", position.cast("int"))


def find_group_column(labels: DataFrame, levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The column whose set of values equals the labels of a printed table, only if it is unique."""
    wanted = labels.select(*keys, F.trim("label").alias("label")).distinct()
    sizes = wanted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")).where("_k between 1 and 10")
    sets = wanted.join(sizes, list(keys)).groupBy(*keys).agg(
        F.array_sort(F.collect_set("label")).alias("levels"))
    hits = sets.join(F.broadcast(levels.select("name", "levels")), "levels")
    only = Window.partitionBy(*keys)
    return hits.withColumn("_n", F.count(F.lit(1)).over(only)).where("_n = 1").select(*keys, "name")


def header_value_column(
    headers: DataFrame, catalogue: DataFrame, keys: Sequence[str], header: str = "header"
) -> DataFrame:
    """The numeric column named in a table header; the longest name wins and must be the only one."""
    numeric = _small(catalogue.where("is_numeric and length(name) >= 2").select("name"))
    hits = headers.select(*keys, header).join(
        numeric, F.col(header).contains(F.col("name"))).drop(header).distinct()
    longer = hits.withColumnRenamed("name", "other")
    condition = [F.col("h.name") != F.col("o.other"), F.col("o.other").contains(F.col("h.name"))]
    condition += [F.col(f"h.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    whole = condition[0]
    for c in condition[1:]:
        whole = whole & c
    kept = hits.alias("h").join(longer.alias("o"), whole, "left_anti")
    only = Window.partitionBy(*keys)
    return kept.withColumn("_n", F.count(F.lit(1)).over(only)).where("_n = 1").select(*keys, "name")


def pick_columns(
    method: str, profiled: DataFrame, matched: Sequence[str] = (), order: Sequence[str] = (),
    id_tokens: Sequence[str] = fv.ID_TOKENS,
) -> dict[str, list[str]]:
    """Columns to run a claimed method on, from a profile (one row per column, read once).

    Matched columns come first; id-like ones never take part.
    """
    rows = profiled.collect()
    place = {c: i for i, c in enumerate(order)}
    rows = sorted((r for r in rows if not names.is_id_like(r["name"], id_tokens)),
                  key=lambda r: (place.get(r["name"], len(place)), r["name"]))
    cont = [r["name"] for r in rows if r["type"] == "continuous"]
    cats = [r for r in rows if r["type"] == "categorical"]
    cat = [r["name"] for r in cats]
    numeric = [r["name"] for r in rows if r["is_numeric"]]
    front = lambda cols: [c for c in cols if c in matched] + [c for c in cols if c not in matched]
    by_levels = [r["name"] for r in sorted(cats, key=lambda r: (r["n_unique"], place.get(r["name"], 0)))]
    group = [c for c in cat if c in matched] or by_levels
    if method == "cronbach_alpha":
        coded = [r["name"] for r in cats if r["is_numeric"]]
        pool = coded if len(coded) >= 2 else numeric
        chosen = [c for c in pool if c in matched]
        return {"items": chosen if len(chosen) >= 2 else pool}
    if method == "repeated_measures_anova" and len(numeric) >= 3:
        return {"times": front(numeric)}
    if method in ("independent_t", "paired_t", "anova", "mann_whitney", "tost") and cont and group:
        return {"group": group[:1], "value": front(cont)[:1]}
    if method == "correlation" and len(cont) >= 2:
        return {"columns": front(cont)[:2]}
    if method in ("chi_square", "two_way_anova") and len(cat) >= 2:
        return {"factors": front(cat)[:2]}
    if method in ("linear_regression", "logistic_regression") and cont:
        target = front(cont)[0]
        return {"y": [target], "xs": [c for c in cont if c != target]}
    if cont and group:
        return {"group": group[:1], "value": cont[:1]}
    return {"value": cont[:1]} if cont else {"group": group[:1]}
