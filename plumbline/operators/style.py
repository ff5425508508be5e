"""Writing-style densities.  Sentences are an array inside the row of their text, so the metrics of a
corpus need no shuffle at all."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import fixed_writing as fw
from plumbline.functions import text as tx
from plumbline.operators.joins import unfold


def style_view(text: Column) -> Column:
    """The author's own text: longer quotations out, and nothing after the reference heading."""
    cut = F.split(text, fw.STYLE_REFERENCES)
    kept = F.when(F.size(cut) > 1, F.array_join(F.slice(cut, 1, F.size(cut) - 1), "\n")).otherwise(text)
    return F.regexp_replace(kept, fw.QUOTED_SPAN, "（…）")


def sentence_array(text: Column, rules: fw.StyleRules) -> Column:
    """Sentences of six or more characters that are neither formulas nor table rows."""
    pattern, least = rules.min_letters
    parts = F.transform(F.split(text, rules.sentence_end), lambda s: F.trim(s))
    # the search for a class of characters may stop at the last one that is needed
    one_class = re.fullmatch(r"\[[^\[\]\\]+\]", pattern) and least > 0
    lettered = lambda s: (s.rlike(f"(?:{pattern}[\\s\\S]*?){{{least}}}") if one_class
                          else F.regexp_count(s, F.lit(pattern)) >= least)
    return F.filter(parts, lambda s: (F.length(s) >= 6) & ~s.rlike(r"[=＝|]") & lettered(s))


def sentence_rows(docs: DataFrame, keys: Sequence[str], rules: fw.StyleRules,
                  text: str = "text") -> DataFrame:
    return docs.select(*keys, F.posexplode(sentence_array(F.col(text), rules)).alias(
        "sentence_no", "sentence"))


def _share(array: str, pattern: str) -> Column:
    hits = F.size(F.filter(array, lambda s: s.rlike(pattern)))
    return F.coalesce(F.try_divide(hits, F.size(array)), F.lit(0.0))


def _mean_sd(array: str) -> tuple[Column, Column]:
    """Mean and population deviation of sentence lengths, from exact integer sums."""
    n = F.size(array).cast("double")
    lengths = F.aggregate(
        array, F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("q")),
        lambda a, x: F.struct(
            (a["s"] + F.length(x)).alias("s"),
            (a["q"] + F.length(x).cast("long") * F.length(x)).alias("q")))
    mean = F.try_divide(lengths["s"], n)
    spread = F.try_divide(lengths["q"] * n - lengths["s"].cast("double") * lengths["s"], n * n)
    return mean, F.sqrt(F.when(spread > 0, spread).when(spread.isNotNull(), 0.0))


_SHARES = T.StructType([T.StructField("pair_variety", T.DoubleType()), T.StructField("five_repeat", T.DoubleType())])


@F.pandas_udf(_SHARES)
def _gram_shares(texts: pd.Series, token: pd.Series) -> pd.DataFrame:
    """Share of distinct token pairs, and share of repeated five-token runs; runs are told apart by their tokens.

    ``token``: a pattern without groups.
    """
    def distinct_share(tokens: list[str], k: int, empty: float) -> float:
        n = len(tokens) - k + 1
        return len(set(zip(*(tokens[i:] for i in range(k))))) / n if n > 0 else empty

    def shares(text: str | None, pattern: str) -> tuple[float, float]:
        tokens = re.findall(pattern, text) if text and pattern else []
        return distinct_share(tokens, 2, 1.0), 1 - distinct_share(tokens, 5, 1.0)

    return pd.DataFrame(list(map(shares, texts, token)), columns=["pair_variety", "five_repeat"])


def _count_any(text: Column, patterns: Sequence[str]) -> Column:
    """Hits of all patterns; those that need a Han character are tried on texts that hold one."""
    out, han = F.lit(0), F.lit(0)
    for p in patterns:
        if tx.needs_han(p):
            han = han + F.regexp_count(text, F.lit(p))
        else:
            out = out + F.regexp_count(text, F.lit(p))
    if any(map(tx.needs_han, patterns)):
        out = out + F.when(~text.rlike(tx.HAN), 0).otherwise(han)
    return out


def unsupported_hype(text: Column, words: Sequence[str]) -> Column:
    """Big words without a number, percent sign or statistic in the next 30 characters."""
    out = F.lit(0)
    for w in words:
        tails = F.regexp_extract_all(text, F.lit(f"(?:{w})(?=([\\s\\S]{{0,30}}))"), F.lit(1))
        out = out + F.size(F.filter(tails, lambda t: ~t.rlike(fw.NUMBER_AFTER)))
    return out


def unjustified_models(text: Column, models: Sequence[str]) -> Column:
    """Uses of listed models whose first mention carries no reason near it."""
    out = F.lit(0)
    for m in models:
        # the text before the first mention but for 40 characters is cut off, so the search for them ends at once
        ahead = F.greatest(F.length(F.split(text, m, 2)[0]) - 40, F.lit(0))
        first = F.regexp_extract(F.substring(text, ahead + 1, F.length(text)), f"([\\s\\S]{{0,40}}(?:{m})[\\s\\S]{{0,60}})", 1)
        count = F.regexp_count(text, F.lit(m))
        out = out + F.when((count > 0) & ~first.rlike(fw.JUSTIFICATION), count).otherwise(0)
    return out


def phrase_counts(docs: DataFrame, keys: Sequence[str], phrases, text: str = "text") -> DataFrame:
    """Hits per text and phrase rule: ``(keys, rule_no, class, n)``; one regex pass per rule."""
    hits = F.array(*[
        F.struct(F.lit(i).alias("rule_no"), F.lit(c).alias("class"),
                 F.regexp_count(F.col(text), F.lit(p)).cast("long").alias("n"))
        for i, (c, p) in enumerate(phrases)])
    return docs.select(*keys, F.inline(F.filter(hits, lambda h: h["n"] > 0)))


def phrase_density(docs: DataFrame, keys: Sequence[str], phrases, text: str = "text") -> DataFrame:
    """Total phrase hits per text and per 1000 characters; stays within the row."""
    total = _count_any(F.col(text), [p for _, p in phrases])
    size = F.greatest(F.length(text), F.lit(1))
    return docs.select(*keys, total.cast("long").alias("total_hits"),
                       F.round(total * 1000.0 / size, 2).alias("density_per_1k"))


def phrase_classes(docs: DataFrame, keys: Sequence[str], phrases, text: str = "text") -> DataFrame:
    """Hits per text and class."""
    return phrase_counts(docs, keys, phrases, text).groupBy(*keys, "class").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_rules"))


def style_metrics(docs: DataFrame, keys: Sequence[str], rules: fw.StyleRules,
                  text: str = "text") -> DataFrame:
    """All style metrics of each text, one row per text."""
    frame = docs.select(*keys, style_view(F.col(text)).alias("_view"))
    frame = frame.withColumn("_s", sentence_array(F.col("_view"), rules))
    frame = frame.withColumn("_grams", _gram_shares(F.lower("_view"), F.lit((rules.token or "").replace("A-Z", ""))))
    mean, sd = _mean_sd("_s")
    view = F.col("_view")
    out = frame.select(
        *keys, F.length("_view").alias("n_chars"), F.size("_s").alias("n_sentences"),
        _share("_s", rules.connective_pattern).alias("connective_share"),
        _share("_s", rules.passive).alias("passive_share"), mean.alias("mean_length"),
        sd.alias("sd_length"), "_grams.pair_variety", "_grams.five_repeat",
        unsupported_hype(view, rules.hype).alias("hype"), _count_any(view, rules.residue).alias("residue"),
        unjustified_models(view, rules.redlist).alias("models"),
        _count_any(view, rules.generic).alias("generic"),
        _count_any(view, [p for _, p in rules.phrases]).alias("phrases"))
    long_enough = F.col("n_chars") >= 400
    cv = F.when(F.col("n_sentences") >= 8, F.try_divide(F.col("sd_length"), F.col("mean_length")))
    flags = (
        (long_enough & F.coalesce(cv < 0.35, F.lit(False))).cast("int")
        + (long_enough & (F.col("pair_variety") < 0.55)).cast("int")
        + (long_enough & (F.col("five_repeat") > 0.12)).cast("int"))
    return out.withColumns({
        "uniform": (F.col("n_sentences") >= 10) & (F.col("sd_length") < 6.0),
        "length_cv": F.when(long_enough, cv), "rhythm_flags": flags})


def connective_band(share: Column) -> Column:
    return F.when(share < 0.15, "normal").when(share < 0.20, "notice").when(
        share < 0.25, "revise").otherwise("high")


def passive_band(share: Column) -> Column:
    return F.when(share <= 0.20, "low").when(share <= 0.30, "mid").otherwise("high")


def style_score(metrics: DataFrame) -> DataFrame:
    """Sum of capped parts, 0 to 100, and its level.  It describes style, never authorship."""
    band = connective_band(F.col("connective_share"))
    passive = passive_band(F.col("passive_share"))
    cap = lambda c, top: F.least(c, F.lit(top))
    parts = {
        "part_connectives": F.when(band == "notice", 10).when(band == "revise", 25).when(
            band == "high", 45).otherwise(0),
        "part_uniform": F.when(F.col("uniform"), 15).otherwise(0),
        "part_passive": F.when(passive == "mid", 10).when(passive == "high", 20).otherwise(0),
        "part_hype": cap(F.col("hype") * 4, 20), "part_phrases": cap(F.col("phrases") * 3, 15),
        "part_residue": cap(F.col("residue") * 25, 50), "part_models": cap(F.col("models") * 10, 30),
        "part_generic": cap(F.col("generic") * 6, 18), "part_rhythm": cap(F.col("rhythm_flags") * 6, 12),
    }
    out = metrics.withColumns(parts)
    score = F.least(sum((F.col(p) for p in parts), F.lit(0)), F.lit(100))
    level = F.when(score <= 19, "low").when(score <= 34, "mid_low").when(score <= 54, "mid").when(
        score <= 74, "mid_high").otherwise("high")
    return out.withColumns({"score": score, "level": level})


# ---- passages --------------------------------------------------------------------------------

WEIGHTS = {"residue": 25, "connectives": 12, "hype": 8, "generic": 8, "passive": 5, "phrases": 3,
           "models": 6}
PASSAGE_MIN = 20


def passage_scores(docs: DataFrame, keys: Sequence[str], rules: fw.StyleRules,
                   text: str = "text") -> DataFrame:
    """Every paragraph of 60 or more characters and two or more sentences with its signal counts."""
    view = docs.select(*keys, style_view(F.col(text)).alias("_view"))
    paras = F.transform(F.split("_view", r"\n\s*\n"), lambda p: F.trim(p))
    rows = view.select(*keys, F.posexplode(paras).alias("paragraph_no", "paragraph")).where(
        F.length("paragraph") >= 60)
    p = F.col("paragraph")
    parts = F.filter(F.transform(F.split(p, rules.sentence_end), lambda s: F.trim(s)), lambda s: s != "")
    rows = rows.withColumn("_s", parts)
    count = lambda pattern: F.size(F.filter("_s", lambda s: s.rlike(pattern)))
    either = f"(?:{rules.connective_pattern})|(?:{rules.passive})"
    signals = {
        "residue": _count_any(p, rules.residue), "connectives": count(rules.connective_pattern),
        "hype": unsupported_hype(p, rules.hype), "generic": _count_any(p, rules.generic),
        "passive": count(rules.passive), "phrases": _count_any(p, [x for _, x in rules.phrases]),
        "models": unjustified_models(p, rules.redlist), "_flagged": count(either),
        "n_sentences": F.size("_s")}
    # unfolded, as a filter on the score would else be pushed below the signals and count them a second time
    row = F.when(F.size("_s") >= 2, F.array(F.struct(*[c.alias(k) for k, c in signals.items()])))
    rows = unfold(rows.select(*keys, "paragraph_no", "paragraph", row.alias("_row")), [*keys, "paragraph_no", "paragraph"],
                  "_row", "n_sentences")
    score = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0))
    return rows.withColumn("score", score)


def flagged_passages(docs: DataFrame, keys: Sequence[str], rules: fw.StyleRules, text: str = "text",
                     top: int | None = 8) -> DataFrame:
    """The highest-scoring paragraphs of each text that pass the gates.

    A lone passive in a method paragraph is custom of the field; signals in fewer than a fifth of the
    sentences are chance.  Only flagged paragraphs are shuffled for the ranking.
    """
    rows = passage_scores(docs, keys, rules, text).where(F.col("score") >= PASSAGE_MIN)
    others = sum((F.col(k) for k in WEIGHTS if k != "passive"), F.lit(0))
    custom = (others == 0) & (F.col("passive") > 0) & F.col("paragraph").rlike(fw.METHOD_MARK)
    dense = (F.col("_flagged") + F.col("hype") + F.col("generic")) >= F.greatest(
        F.lit(2.0), 0.2 * F.col("n_sentences"))
    kept = rows.where(~custom & (dense | (F.col("residue") > 0))).drop("_flagged")
    if top is None:
        return kept
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "paragraph_no")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


# ---- exemption gate --------------------------------------------------------------------------

def exemption(paragraph: Column, only_passive: Column, hype: Column) -> Column:
    """Why a passage does not count: cover layout, lone passive in methods, or a reference entry."""
    families = sum((paragraph.rlike(p).cast("int") for p in fw.COVER_FAMILIES), F.lit(0))
    lines = F.filter(F.transform(F.split(paragraph, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    short = F.size(F.filter(lines, lambda x: F.length(x) <= 40))
    cover = (families >= fw.COVER_MIN_FAMILIES) & (F.size(lines) >= 4) & (short * 2 >= F.size(lines))
    return (
        F.when(cover, "cover_page")
        .when(only_passive & paragraph.rlike(fw.METHOD_MARK), "method_passive")
        .when(paragraph.rlike(fw.REFERENCE_ENTRY) & (hype == 0), "reference_entry"))


def apply_gate(passages: DataFrame) -> DataFrame:
    """Add ``exempt_reason``; exempt passages stay in the frame with their reason."""
    others = sum((F.col(k) for k in WEIGHTS if k != "passive"), F.lit(0))
    return passages.withColumn("exempt_reason", exemption(
        F.col("paragraph"), (others == 0) & (F.col("passive") > 0), F.col("hype")))


def truncated(text: Column) -> Column:
    """An excerpt that does not end a sentence; an empty one carries no evidence either."""
    end = F.regexp_replace(text, r"\s+$", "")
    return (end == "") | end.rlike(r"(?:…|\.\.\.)$") | ~end.rlike(fw.SENTENCE_CLOSERS)


def unclosed_quote(text: Column) -> Column:
    """More opening than closing quotation marks."""
    out = F.lit(False)
    for a, b in fw.QUOTE_PAIRS:
        opened = F.length(text) - F.length(F.translate(text, a, ""))
        closed = F.length(text) - F.length(F.translate(text, b, ""))
        out = out | (opened > closed)
    return out
