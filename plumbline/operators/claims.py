"""Claims in texts: methods, reported quantities, variable names, and the abstract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed_text as ft
from plumbline.functions import text as tx


def method_mentions(
    docs: DataFrame, keys: Sequence[str], text: str = "text", rules=ft.METHOD_PATTERNS
) -> DataFrame:
    """Methods named in each sentence, one row per sentence and method."""
    parts = tx.sentences(docs, keys, text, tx.METHOD_SENTENCE_END)
    found = F.array_compact(F.array(*[
        F.when(F.col("sentence").rlike(pattern), F.lit(key)) for key, pattern in rules]))
    return parts.select(
        *keys, "sentence_no", "sentence", F.explode(found).alias("method"))


def _claim_value(kind: Column, raw: Column) -> Column:
    plain = F.translate(raw, "−＝", "-=")
    after_equals = F.regexp_extract(plain, r"=\s*(-?\d*\.?\d+)", 1)
    p_number = F.regexp_extract(plain, r"(\d*\.?\d+)", 1)
    r_number = F.regexp_extract(plain, r"(-?0?\.\d+)", 1)
    first = F.regexp_extract(plain, r"(\d+\.?\d*)", 1)
    count = F.translate(F.regexp_extract(plain, r"(\d[\d,]*)", 1), ",", "")
    text = (
        F.when(kind == "p", p_number).when(kind == "r", r_number)
        .when(kind.isin("mean", "sd"), first).when(kind == "n", count).otherwise(after_equals))
    return text.try_cast("double")


def quantity_claims(
    docs: DataFrame, keys: Sequence[str], text: str = "text", patterns: dict[str, str] | None = None,
    context: int = 50,
) -> DataFrame:
    """Reported quantities with position, value, operator, degrees of freedom and context.

    p-values inside a significance legend (``*** p<0.01, ** p<0.05``) are notes of a table and are
    left out: legends are blanked, character for character, before p-values are searched.
    """
    patterns = dict(ft.QUANTITY_PATTERNS if patterns is None else patterns)
    # a legend keeps its length but loses its letters, so no offset moves
    blank = F.array_join(F.transform(
        F.split(F.regexp_replace(F.col(text), f"({ft.SIGNIFICANCE_LEGEND})", "\u0001$1\u0002"), "\u0001"),
        lambda piece: F.when(piece.contains("\u0002"), F.concat(
            F.repeat(F.lit(" "), F.length(F.substring_index(piece, "\u0002", 1))),
            F.substring_index(piece, "\u0002", -1))).otherwise(piece)), "")
    frame = docs.select(*keys, F.col(text).alias("_text"), F.when(
        F.col(text).rlike(ft.SIGNIFICANCE_LEGEND), blank).otherwise(F.col(text)).alias("_p_text"))
    found = tx.locate(frame, keys, "_text", patterns, context, texts={"p": "_p_text"})
    kind, raw = F.col("kind"), F.col("raw")
    window = F.concat(F.right("before", F.lit(context)), raw, F.left("after", F.lit(context)))
    pair = r"\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)"
    return found.select(
        *keys, F.col("start").alias("pos"), "kind", "raw", _claim_value(kind, raw).alias("value"),
        F.when(kind == "p", F.when(raw.rlike("[<≤＜]"), "lt").when(raw.rlike("[>≥＞]"), "gt").otherwise("eq")).alias("op"),
        F.regexp_extract(raw, pair, 1).try_cast("long").alias("df1"),
        F.regexp_extract(raw, pair, 2).try_cast("long").alias("df2"),
        F.trim(F.translate(window, "\n", " ")).alias("context"))


def unique_claims(claims: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Claims that read the same within a text, with their count and first position."""
    return claims.groupBy(*keys, "kind", "raw").agg(
        F.count(F.lit(1)).alias("count"), F.min("pos").alias("pos"),
        *[F.min_by(c, "pos").alias(c) for c in ("value", "op", "df1", "df2", "context")])


def corpus_scan(
    docs: DataFrame, keys: Sequence[str], text: str = "text", flag_many: int = 200
) -> DataFrame:
    """Per text: method, quantity and variable counts with flags for empty or overfull results."""
    methods = method_mentions(docs, keys, text).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_methods"), F.count_distinct("method").alias("n_method_kinds"))
    quantities = unique_claims(quantity_claims(docs, keys, text), keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_quantities"), F.count_distinct("kind").alias("n_kinds"))
    variables = variable_names(docs, keys, text).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_variables"))
    out = docs.select(*keys, F.length(text).alias("n_chars"))
    for part in (methods, quantities, variables):
        out = out.join(part, list(keys), "left")
    out = out.na.fill(0)
    return out.withColumn("flags", F.array_compact(F.array(
        F.when(F.col("n_methods") == 0, F.lit("no_methods")),
        F.when(F.col("n_quantities") == 0, F.lit("no_quantities")),
        F.when(F.col("n_variables") == 0, F.lit("no_variables")),
        F.when(F.col("n_quantities") > flag_many, F.lit("many_quantities")),
        F.when(F.col("n_variables") > flag_many, F.lit("many_variables")),
    )))


# ---- variable names --------------------------------------------------------------------------

def _is_phrase(name: Column) -> Column:
    heads = "^(?:" + "|".join(ft.PHRASE_HEADS) + ")"
    verbs = "|".join(ft.PHRASE_VERBS)
    return (name.contains("..") | name.contains("…") | name.rlike(heads) | name.rlike(verbs)
            | name.rlike("[了的地得着过]$"))


def variable_names(
    docs: DataFrame, keys: Sequence[str], text: str = "text",
    dictionary: Sequence[str] = ft.COMMON_VARIABLES,
) -> DataFrame:
    """Variable names from quotes, keywords and a dictionary; phrases are filtered out."""
    body = F.col(text)

    def pieces(pattern: str, source: str) -> Column:
        return F.transform(
            F.regexp_extract_all(body, F.lit(pattern), F.lit(1)),
            lambda x: F.struct(F.regexp_replace(F.trim(x), "^[。，；,.]+|[。，；,.]+$", "").alias("name"),
                               F.lit(source).alias("source")))

    listed = F.array_compact(F.array(*[
        F.when(body.contains(v), F.struct(F.lit(v).alias("name"), F.lit("dictionary").alias("source")))
        for v in dictionary]))
    rows = docs.select(*keys, F.inline(F.concat(
        pieces(ft.QUOTED_NAME, "quoted"), pieces(ft.NAME_AFTER_KEYWORD, "keyword"),
        pieces(ft.NAME_NEAR_STATISTIC, "near_statistic"), listed)))
    size = F.length("name")
    wanted = size.between(2, 15) & (
        (F.col("source") != "keyword") | ((size <= 8) & ~_is_phrase(F.col("name"))))
    return rows.where(wanted).groupBy(*keys, "name").agg(
        F.array_sort(F.collect_set("source")).alias("sources"), F.count(F.lit(1)).alias("count"))


# ---- abstract --------------------------------------------------------------------------------

def abstract_text(
    text: Column, head: str = ft.ABSTRACT_HEAD, end: str = ft.KEYWORD_HEAD,
    shortest: int = ft.ABSTRACT_MIN, longest: int | None = None,
) -> Column:
    """The abstract: from the last real head before the first keyword line; null when in doubt.

    A head followed by a page number alone on its line is a running header and does not count.  With ``longest``
    (``fixed_text.ABSTRACT_MAX``, say) a longer stretch is in doubt as well.
    """
    before = F.try_element_at(F.split(text, end, 2), F.lit(1))
    after_heads = F.split(before, head)
    real = F.filter(
        F.transform(F.slice(after_heads, 2, F.greatest(F.size(after_heads) - 1, F.lit(0))),
                    lambda piece, i: F.struct(i.alias("i"), piece.alias("piece"))),
        lambda p: ~p["piece"].rlike(ft.PAGE_NUMBER_LINE))
    last = F.try_element_at(real, F.lit(-1))["i"]
    body = F.array_join(F.slice(after_heads, last + 2, F.size(after_heads)), "")
    size = F.length(body)
    found = text.rlike(end) & last.isNotNull() & (size >= shortest)
    if longest is not None:
        found = found & (size <= longest)
    return F.when(found, body)


def split_abstract(docs: DataFrame, text: str = "text", **kw) -> DataFrame:
    """Add ``abstract`` (null when not located) and ``body`` (what follows the keyword line)."""
    rest = F.try_element_at(F.split(F.col(text), kw.get("end", ft.KEYWORD_HEAD), 2), F.lit(2))
    abstract = abstract_text(F.col(text), **kw)
    return docs.withColumn("abstract", abstract).withColumn(
        "body", F.when(F.col("abstract").isNotNull(), rest).otherwise(F.col(text)))
