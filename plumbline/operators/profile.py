"""Column profiles and what follows from them: column kinds, scale items, method proposals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import fixed_values as fv
from plumbline.functions import names

#: Columns aggregated together; wider tables are profiled in several batches of one scan each.
BATCH = 40


def stacked(row: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Turn one wide row of aggregates into one row per struct; null structs are left out."""
    return row.select(F.inline(F.array_compact(F.array(*structs))))


def batches(columns: Sequence[str], size: int = BATCH) -> list[list[str]]:
    return [list(columns[i:i + size]) for i in range(0, len(columns), size)]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _family(dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return "bigint"
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return "double"
    return "string"


def column_frequency(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct values of each column with their counts: ``(name, value, n)``, value as text.

    One shuffle on (column, value).  Numbers are grouped as numbers and only the distinct ones become
    text.
    """
    columns = list(columns or df.columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "name string, value string, n bigint")
    families: dict[str, list[str]] = {}
    for field in df.schema.fields:
        if field.name in columns:
            families.setdefault(_family(field.dataType), []).append(field.name)
    parts = []
    for family, members in families.items():
        long = df.select(
            F.inline(F.array(*[
                F.struct(F.lit(c).alias("name"), F.col(c).cast(family).alias("value"))
                for c in members
            ]))
        )
        counted = long.where("value is not null").groupBy("name", "value").agg(
            F.count(F.lit(1)).alias("n")
        )
        parts.append(counted.select("name", F.col("value").cast("string").alias("value"), "n"))
    return union_all(parts)


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """The ``k`` most frequent values per column; ties go to the smaller text."""
    order = Window.partitionBy("name").orderBy(F.desc("n"), F.asc("value"))
    return (
        column_frequency(df, columns)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("name", F.col("rank").cast("long").alias("rank"), "value", "n")
    )


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return column_frequency(df, columns).groupBy("name").agg(F.count(F.lit(1)).alias("n_unique"))


def continuous_bound(n_total: Column) -> Column:
    """Distinct values from which a numeric column counts as continuous: max(10, 5 % of rows)."""
    return F.greatest(F.lit(10).cast("long"), F.floor(n_total * F.lit(0.05)).cast("long"))


def profile(
    df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False
) -> DataFrame:
    """One row per column: counts, distinct values, moments, and the kind of the column.

    ``approx`` replaces the exact distinct count by a sketch, which needs no shuffle of values.
    """
    columns = list(columns or df.columns)
    numeric = set(names.numeric_columns(df))
    types = dict(df.dtypes)
    parts = []
    for group in batches(columns):
        aggs = [F.count(F.lit(1)).alias("_n")]
        for i, c in enumerate(group):
            aggs.append(F.count(c).alias(f"_p{i}"))
            if approx:
                aggs.append(F.approx_count_distinct(c, 0.02).alias(f"_u{i}"))
            if c in numeric:
                x = F.col(c).cast("double")
                aggs += [
                    F.avg(x).alias(f"_m{i}"), F.stddev_samp(x).alias(f"_s{i}"),
                    F.min(x).alias(f"_a{i}"), F.max(x).alias(f"_b{i}"),
                ]
        row = df.agg(*aggs)
        structs = []
        for i, c in enumerate(group):
            is_numeric = c in numeric
            moment = (lambda key: F.col(f"_{key}{i}")) if is_numeric else (
                lambda key: F.lit(None).cast("double"))
            structs.append(F.struct(
                F.lit(c).alias("name"),
                F.lit(types[c]).alias("dtype"),
                F.lit(is_numeric).alias("is_numeric"),
                F.col("_n").alias("n_total"),
                (F.col("_n") - F.col(f"_p{i}")).alias("n_missing"),
                (F.col(f"_u{i}") if approx else F.lit(None).cast("long")).alias("n_unique"),
                moment("m").alias("mean"), moment("s").alias("std"),
                moment("a").alias("min"), moment("b").alias("max"),
            ))
        parts.append(stacked(row, structs))
    out = union_all(parts)
    if not approx:
        out = out.drop("n_unique").join(F.broadcast(distinct_counts(df, columns)), "name", "left")
        out = out.withColumn("n_unique", F.coalesce("n_unique", F.lit(0).cast("long")))
    bound = continuous_bound(F.col("n_total"))
    continuous = F.col("is_numeric") & (F.col("n_unique") >= bound)
    discrete = F.col("is_numeric") & (F.col("n_unique") >= 2) & (F.col("n_unique") < bound)
    return out.select(
        "name", "dtype", "is_numeric", "n_total", "n_missing", "n_unique",
        F.when(continuous, "continuous").otherwise("categorical").alias("type"),
        discrete.alias("is_numeric_discrete"),
        *[F.when(continuous, F.col(c)).alias(c) for c in ("mean", "std", "min", "max")],
    )


def profile_with_top(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """Profile with ``top_values`` as an array of (value, count) on categorical columns."""
    base = profile(df, columns)
    top = (
        top_values(df, columns, k)
        .groupBy("name")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("_t"))
    )
    tops = F.when(
        F.col("type") == "categorical",
        F.transform("_t", lambda t: F.struct(t["value"].alias("value"), t["n"].alias("count"))),
    )
    return base.join(F.broadcast(top), "name", "left").withColumn("top_values", tops).drop("_t")


def recommend_method(
    profiled: DataFrame, id_tokens: Sequence[str] = fv.ID_TOKENS, order: Sequence[str] = (),
    measured: Sequence[str] = (),
) -> DataFrame:
    """Propose a method from a profile: fewest-level category plus the first continuous column.

    ``order`` gives the column order of the table; without it names decide.  ``measured`` names columns
    known to be measurements: they stay continuous where a long table repeats their values.
    """
    position = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("name")) if order \
        else F.lit(0)
    flagged = profiled.withColumn("_pos", position).withColumn(
        "_id", F.lower("name").rlike("|".join(id_tokens)))
    known = F.col("is_numeric") & F.col("name").isin(*measured) if measured else F.lit(False)
    continuous = ((F.col("type") == "continuous") & ~F.col("_id")) | known
    categorical = (F.col("type") == "categorical") & ~known

    def sorted_names(condition: Column, *keys: Column) -> Column:
        picked = F.array_sort(F.collect_list(F.when(condition, F.struct(*keys, F.col("name")))))
        return F.transform(picked, lambda s: s["name"])

    row = flagged.agg(
        sorted_names(continuous, F.col("_pos")).alias("cont"),
        sorted_names(categorical, F.col("_pos")).alias("cat"),
        F.array_sort(F.collect_list(F.when(
            categorical, F.struct("n_unique", "_pos", "name")))).alias("by_levels"),
    )
    group = F.try_element_at("by_levels", F.lit(1))
    has_both = (F.size("cont") >= 1) & (F.size("cat") >= 1)
    method = (
        F.when(has_both & (group["n_unique"] == 2), "independent_t")
        .when(has_both, "anova")
        .when(F.size("cont") >= 2, "correlation")
        .when(F.size("cat") >= 2, "chi_square")
    )
    first = lambda array: F.try_element_at(array, F.lit(1))
    second = lambda array: F.try_element_at(array, F.lit(2))
    return row.select(
        method.alias("method"),
        F.when(has_both, group["name"])
        .when(method == "chi_square", first(F.col("cat"))).alias("group_col"),
        F.when(method == "chi_square", second(F.col("cat")))
        .when(method.isNotNull(), first(F.col("cont"))).alias("value_col"),
        F.when(method == "correlation", second(F.col("cont"))).alias("value_col2"),
    )


def group_candidates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns that can define groups: text, or whole numbers with 2-20 levels used at least twice."""
    columns = list(columns or df.columns)
    numeric = set(names.numeric_columns(df))
    freq = column_frequency(df, columns)
    value = F.col("value").try_cast("double")
    per = freq.groupBy("name").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("n_unique"),
        F.count_if(value != F.round(value)).alias("n_fraction"),
    )
    is_numeric = F.col("name").isin(*numeric) if numeric else F.lit(False)
    coded = (
        (F.col("n_fraction") == 0) & F.col("n_unique").between(2, 20)
        & (F.col("n") >= 2 * F.col("n_unique"))
    )
    return per.where(~is_numeric | coded).select("name", "n", "n_unique")


def scale_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of values in the scale range per column, one row per column."""
    parts = []
    for group in batches(columns):
        row = df.agg(*[
            agg for i, c in enumerate(group) for agg in (
                F.count(c).alias(f"_n{i}"),
                F.avg(F.col(c).between(fv.SCALE_LOW, fv.SCALE_HIGH).cast("int")).alias(f"_s{i}"),
            )
        ])
        parts.append(stacked(row, [
            F.struct(F.lit(c).alias("name"), F.col(f"_n{i}").alias("n"),
                     F.col(f"_s{i}").alias("share"))
            for i, c in enumerate(group)
        ]))
    return union_all(parts)


def scale_groups(
    df: DataFrame, not_scale: Sequence[str] = fv.NOT_SCALE_TOKENS
) -> dict[str, list[str]]:
    """Groups of scale items by shared name prefix.

    One aggregate row per column comes back to the driver, so the size is the table's width.
    """
    columns = [c for c in names.numeric_columns(df) if not names.has_token(c, not_scale)]
    if not columns:
        return {}
    rows = scale_shares(df, columns).where("n >= 5 and share >= 0.8").select("name").collect()
    found = {r["name"] for r in rows}
    loose = [c for c in columns if c in found]
    numbered = names.prefix_groups([c for c in loose if any(ch.isdigit() for ch in c)])
    groups = {prefix: members for prefix, members in numbered.items() if len(members) >= 3}
    if not groups and len(loose) >= 4:
        return {"unnamed": loose}
    return groups
