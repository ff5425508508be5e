"""Recomputing reported p-values and comparing wording with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import dist
from plumbline.functions import fixed_text as ft
from plumbline.functions import numbers as num
from plumbline.functions import text as tx

_EPS = 1e-12


def document_alpha(text: Column, default: float = 0.05) -> Column:
    """The one significance level a text declares; the default when it declares none or several."""
    found = F.flatten(F.array(*[
        F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda x: x.try_cast("double"))
        for p in ft.ALPHA_DECLARATIONS]))
    allowed = F.array(*[F.lit(a) for a in ft.ALLOWED_ALPHA])
    levels = F.array_intersect(F.array_distinct(found), allowed)
    return F.when(F.size(levels) == 1, levels[0]).otherwise(F.lit(default))


def sentence_alpha(sentence: Column, default: Column) -> Column:
    """The widest level named in the sentence (``at the 10 % level``), else the document's."""
    percent = F.transform(
        F.regexp_extract_all(sentence, F.lit(ft.SENTENCE_LEVEL_PERCENT), F.lit(1)),
        lambda x: F.round(x.try_cast("double") / 100, 6))
    decimal = F.transform(
        F.regexp_extract_all(sentence, F.lit(ft.SENTENCE_LEVEL_DECIMAL), F.lit(1)),
        lambda x: x.try_cast("double"))
    allowed = F.array(*[F.lit(a) for a in ft.ALLOWED_ALPHA])
    return F.coalesce(F.array_max(F.array_intersect(F.concat(percent, decimal), allowed)), default)


def one_tailed(text: Column, default: Column | None = None) -> Column:
    """Whether one-sided testing is declared; denials and mixed declarations switch it off."""
    one, two = f"(?:{ft.ONE_TAILED})", f"(?:{ft.TWO_TAILED})"

    def denied(term: str) -> str:
        return f"(?:{ft.TAIL_DENIED_BEFORE}){term}|{term}(?:{ft.TAIL_DENIED_AFTER})"

    denies_one = text.rlike(denied(one))
    says_one = F.regexp_replace(text, denied(one), "").rlike(one)
    says_two = F.regexp_replace(text, denied(two), "").rlike(two)
    fallback = default if default is not None else F.lit(False)
    declared = F.when(says_one | says_two | denies_one, says_one & ~says_two & ~denies_one).otherwise(
        fallback)
    # most texts name no tail at all: the patterns with context run only where one is named
    return F.when(text.rlike(f"{one}|{two}"), declared).otherwise(fallback)


def p_mentions(frame: DataFrame, keys: Sequence[str], text: str, keep: Sequence[str] = ()) -> DataFrame:
    """p-values with operator, value and rounding half-width; anything above 1 is no p-value."""
    found = tx.locate(frame, keys, text, {"p": ft.P_VALUE}, 40, keep)
    return parse_p_hits(found).where("p <= 1")


def parse_p_hits(found: DataFrame) -> DataFrame:
    tail = F.regexp_extract("raw", r"(\d*\.?\d+(?:\s*[eE]\s*-?\s*\d+|\s*[×xX*]\s*10\s*\^?\s*-\s*\d+)?)$", 1)
    sign = F.regexp_extract("raw", r"(≤|≥|<=|>=|=|<|>|小于等于|大于等于|小于|大于|低于|高于|为|是)", 1)
    compact = F.regexp_replace(tail, r"\s+", "")
    op = (
        F.when(sign.isin("≤", "<=", "<", "小于等于", "小于", "低于"), "<")
        .when(sign.isin("≥", ">=", ">", "大于等于", "大于", "高于"), ">").otherwise("="))
    return found.withColumns({
        "p_op": op, "p": num.parse_p(compact), "p_tol": num.half_unit(compact), "p_text": compact})


def _parse_statistic(raw: Column) -> dict[str, Column]:
    kind = (
        F.when(raw.rlike(r"^[tT]"), "t").when(raw.rlike("^F"), "F").when(raw.rlike("^r"), "r")
        .when(raw.rlike("^[zZ]"), "z").otherwise("chi2"))
    body = F.regexp_replace(raw, r"^(?:χ\s*\^?\s*2|[xX]\s*\^?\s*2|[Cc]hi[\s-]*squared?)", "X")
    in_brackets = F.regexp_extract(body, r"^[A-Za-z]\s*\(\s*([\d.]+)", 1)
    second = F.regexp_extract(body, r"^[A-Za-z]\s*\(\s*[\d.]+\s*[,/]\s*([\d.]+)", 1)
    after = F.regexp_extract(body, r"(?:df|DF|自由度|υ|ν)\s*=\s*\(?\s*([\d.]+)", 1)
    after2 = F.regexp_extract(body, r"(?:df|DF|自由度|υ|ν)\s*=\s*\(?\s*[\d.]+\s*[,/]\s*([\d.]+)", 1)
    size = F.regexp_extract(body, r"[nN]\s*=\s*(\d+)\s*$", 1).try_cast("double")
    value = F.regexp_extract(body, r"^[A-Za-z]\s*(?:\([^)]*\))?\s*=\s*(-?(?:\d+(?:\.\d+)?|\.\d+))", 1)
    df1 = F.coalesce(in_brackets.try_cast("double"), after.try_cast("double"))
    return {
        "kind": kind, "value_text": value, "stat": value.try_cast("double"),
        "df1": F.when((kind == "r") & df1.isNull(), size - 2).otherwise(df1),
        "df2": F.when(kind == "F", F.coalesce(second.try_cast("double"), after2.try_cast("double"))),
    }


def statistic_pairs(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Test statistics with the p-value that follows: same sentence, at most 40 characters on, no
    other statistic in between.

    An as-of match: both kinds of hits are put in order of position and each statistic looks one
    row ahead.
    """
    doc = docs.select(*keys, tx.normalize(F.col(text)).alias("_norm"))
    doc = doc.withColumns({
        "doc_alpha": document_alpha(F.col("_norm")), "doc_one_tailed": one_tailed(F.col("_norm"))})
    parts = tx.sentences(doc, keys, "_norm", keep=["doc_alpha", "doc_one_tailed"])
    found = tx.locate(
        parts, [*keys, "sentence_no"], "sentence", {"stat": ft.STATISTIC, "p": ft.P_VALUE}, 60,
        ["doc_alpha", "doc_one_tailed", "sentence"])
    parsed = parse_p_hits(found).where("kind = 'stat' or p <= 1")
    around = F.concat("before", "raw", "after")
    # z is a test statistic only in the language of tests; rank correlations follow other formulas
    real = ~((F.col("kind") == "stat") & F.col("raw").rlike("^[zZ]") & ~around.rlike(ft.Z_CONTEXT)) \
        & ~((F.col("kind") == "stat") & F.col("raw").rlike("^r")
            & F.right("before", F.lit(40)).rlike(ft.RANK_CORRELATION))
    order = Window.partitionBy(*keys, "sentence_no").orderBy("start", "stop")
    ahead = parsed.where(real).withColumns({
        f"next_{c}": F.lead(c).over(order)
        for c in ("kind", "start", "p_op", "p", "p_tol", "p_text")})
    gap = F.col("next_start") - F.col("stop")
    pairs = ahead.where(
        (F.col("kind") == "stat") & (F.col("next_kind") == "p") & gap.between(0, ft.PAIR_GAP))
    fields = _parse_statistic(F.col("raw"))
    return pairs.select(
        *keys, "sentence_no", "start", "raw", "sentence", "doc_alpha", "doc_one_tailed",
        *[v.alias(k) for k, v in fields.items()],
        F.col("next_p_op").alias("p_op"), F.col("next_p").alias("p"),
        F.col("next_p_tol").alias("p_tol"), F.col("next_p_text").alias("p_text"))


def _tail(kind: Column, value: Column, df1: Column, df2: Column) -> Column:
    """p of a statistic through its F or chi-square form, so that two UDF calls cover all kinds."""
    size = F.abs(value)
    inside = F.least(size, F.lit(0.999999))
    as_f = (
        F.when(kind == "t", size * size).when(kind == "F", F.greatest(value, F.lit(0.0)))
        .when(kind == "r", inside * inside * df1 / (1 - inside * inside)))
    top = F.when(kind == "F", df1).otherwise(F.lit(1.0))
    bottom = F.when(kind == "F", df2).otherwise(df1)
    as_chi = F.when(kind == "z", size * size).when(kind == "chi2", F.greatest(value, F.lit(0.0)))
    dof = F.when(kind == "z", F.lit(1.0)).otherwise(df1)
    return F.coalesce(dist.p_f(as_f, top, bottom), dist.p_chi2(as_chi, dof))


def reported_significance(op: Column, p: Column, alpha: Column) -> Column:
    """What the reported p says at this level; null where it sits on the fence."""
    return (
        F.when((op == "=") & (p < alpha - _EPS), True).when((op == "=") & (p > alpha + _EPS), False)
        .when((op == "<") & (p <= alpha + _EPS), True).when((op == ">") & (p >= alpha - _EPS), False))


def _overlaps(op: Column, p: Column, tol: Column, low: Column, high: Column) -> Column:
    return (
        F.when(op == "=", (high >= p - tol - _EPS) & (low <= p + tol + _EPS))
        .when(op == "<", low < p + _EPS).otherwise(high > p - _EPS))


def recheck_pairs(pairs: DataFrame) -> DataFrame:
    """Status of each statistic-p pair from rounding intervals on both sides.

    ``consistent``, ``one_tailed``, ``inconsistent``, ``decision_error`` or ``invalid``.
    """
    kind, value = F.col("kind"), F.col("stat")
    df1, df2 = F.col("df1"), F.col("df2")
    half = F.lit(0.5) * F.pow(F.lit(10.0), -num.decimals_of(F.col("value_text")))
    size = F.abs(value)
    bad_df = kind.isin("t", "F", "chi2", "r") & (df1.isNull() | (df1 <= 0))
    bad_df2 = (kind == "F") & (df2.isNull() | (df2 <= 0))
    invalid = bad_df | bad_df2 | ((kind == "r") & (size > 1))
    out = pairs.withColumns({
        "invalid": invalid,
        "alpha": sentence_alpha(F.col("sentence"), F.col("doc_alpha")),
        "p_low": _tail(kind, size + half, df1, df2),
        "p_point": _tail(kind, size, df1, df2),
        "p_high": _tail(kind, F.greatest(size - half, F.lit(0.0)), df1, df2),
        "corrected": F.col("sentence").rlike(ft.CORRECTION),
    })
    op, p, tol, alpha = (F.col(c) for c in ("p_op", "p", "p_tol", "alpha"))
    low, high = F.col("p_low"), F.col("p_high")
    halved = kind.isin("t", "z", "r") & _overlaps(op, p, tol, low / 2, high / 2)
    reported = reported_significance(op, p, alpha)
    computed = F.when(high < alpha, True).when(low >= alpha, False)
    status = (
        F.when(F.col("invalid"), "invalid")
        .when(low.isNull() | high.isNull(), None)
        .when(_overlaps(op, p, tol, low, high), "consistent")
        .when(halved & one_tailed(F.col("sentence"), F.col("doc_one_tailed")), "one_tailed")
        .when(F.coalesce(reported != computed, F.lit(False)), "decision_error")
        .otherwise("inconsistent"))
    return out.withColumn("status", status).where("status is not null")


def recheck(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    return recheck_pairs(statistic_pairs(docs, keys, text))


STATUSES = ("consistent", "one_tailed", "inconsistent", "decision_error", "invalid")


def recheck_summary(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per text and status."""
    return items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("checked"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def reporting_gaps(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Per text: p-values found, p-values written as zero, statistics without degrees of freedom."""
    norm = docs.select(*keys, tx.normalize(F.col(text)).alias("_norm"))
    zero = r"(?<![A-Za-z])[pP](?:\s*值)?\s*=\s*0?\.0+(?![\d.]*[1-9])(?!\d)"
    return norm.select(
        *keys, tx.count_hits(F.col("_norm"), ft.P_VALUE).cast("long").alias("p_values"),
        tx.count_hits(F.col("_norm"), zero).cast("long").alias("p_zero"),
        tx.count_hits(F.col("_norm"), ft.MISSING_DF).cast("long").alias("missing_df"))


def polarity(clause: Column) -> Column:
    """``pos`` or ``neg`` when a clause takes one side on significance, else null."""
    negative = clause.rlike(ft.NOT_SIGNIFICANT)
    positive = F.regexp_replace(clause, ft.NOT_SIGNIFICANT, "").rlike(ft.SIGNIFICANT)
    return F.when(clause.rlike(ft.MARGINAL), None).when(negative & ~positive, "neg").when(
        positive & ~negative, "pos")


def wording_conflicts(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Clauses whose wording contradicts all of their own p-values.

    Questions are skipped, and so is a negative clause under a named correction.
    """
    doc = docs.select(*keys, tx.normalize(F.col(text)).alias("_norm"))
    doc = doc.withColumn("doc_alpha", document_alpha(F.col("_norm")))
    clauses = tx.sentences(doc, keys, "_norm", tx.CLAUSE_END, ["doc_alpha"])
    clauses = clauses.withColumn("polarity", polarity(F.col("sentence"))).where(
        F.col("polarity").isNotNull() & ~F.col("sentence").rlike(ft.QUESTION))
    hits = p_mentions(clauses, [*keys, "sentence_no"], "sentence",
                      ["doc_alpha", "sentence", "polarity"])
    hits = hits.where(~F.right("before", F.lit(6)).rlike(ft.P_NOT_PVALUE_BEFORE))
    alpha = sentence_alpha(F.col("sentence"), F.col("doc_alpha"))
    judged = hits.withColumn("alpha", alpha).withColumn(
        "sig", reported_significance(F.col("p_op"), F.col("p"), F.col("alpha")))
    grouped = judged.groupBy(*keys, "sentence_no", "sentence", "polarity", "alpha").agg(
        F.count(F.lit(1)).alias("n_p"), F.count("sig").alias("n_known"),
        F.bool_and("sig").alias("all_sig"), F.bool_or("sig").alias("any_sig"),
        F.min_by("raw", "start").alias("reported"))
    agree = (F.col("n_known") == F.col("n_p")) & (F.col("all_sig") == F.col("any_sig"))
    conflict = (F.col("polarity") == "pos") != F.col("all_sig")
    excused = (F.col("polarity") == "neg") & F.col("all_sig") & F.col("sentence").rlike(ft.CORRECTION)
    return grouped.where(agree & conflict & ~excused).select(
        *keys, "sentence_no", "polarity", "alpha", "n_p", "reported", "sentence")


# ---- confidence interval against its estimate ------------------------------------------------

# --- fixed values: named point estimates in order of priority, the interval, its tolerance ---
ESTIMATES = (
    r"(?i)(?:差值|均差|差异|difference)\s*[为是=＝:：]?\s*(-?\d+\.?\d*)",
    r"\bM\s*[=＝]\s*(-?\d+\.?\d*)",
    r"(?:均值|平均分|平均数)\s*[为是=＝:：]?\s*(-?\d+\.?\d*)",
    r"(?i)(?:β|beta)\s*[=＝]\s*(-?\d+\.?\d*)",
    r"(?i)\bOR\s*[=＝]\s*(-?\d+\.?\d*)",
    r"(?i)\bCohen'?s\s*d\s*[=＝]\s*(-?\d+\.?\d*)",
)
INTERVAL = (r"(?:95\s*%\s*(?:CI|置信区间)|置信区间|CI)\s*[:：=]?\s*[\[\(（]\s*"
            r"-?\d+\.?\d*\s*[,，]\s*-?\d+\.?\d*\s*[\]\)）]")
CENTRE_TOLERANCE = 0.06


def ci_against_estimate(
    docs: DataFrame, keys: Sequence[str], text: str = "text", reach: int = 60,
    tolerance: float = CENTRE_TOLERANCE,
) -> DataFrame:
    """Whether each interval is centred on the estimate named within ``reach`` characters.

    Only a named estimate can disagree.  A bare decimal in the 25 characters before the interval can
    confirm it, and an interval without either abstains.
    """
    found = tx.locate(docs, keys, text, {"ci": INTERVAL}, reach)
    numbers = F.regexp_extract_all(
        F.regexp_extract("raw", r"[\[\(（](.*)[\]\)）]", 1), F.lit(r"(-?\d+\.?\d*)"), F.lit(1))
    around = F.concat(F.col("before"), F.lit("\n"), F.col("after"))
    named = F.coalesce(*[
        F.nullif(F.regexp_extract(around, p, 1), F.lit("")).try_cast("double") for p in ESTIMATES])
    bare = F.transform(
        F.regexp_extract_all(F.right("before", F.lit(25)), F.lit(r"(-?\d+\.\d+)"), F.lit(1)),
        lambda x: x.try_cast("double"))
    out = found.select(
        *keys, "start", "raw", numbers[0].try_cast("double").alias("low"),
        numbers[1].try_cast("double").alias("high"), named.alias("estimate"), bare.alias("_bare"),
    ).where("low < high").withColumn("midpoint", (F.col("low") + F.col("high")) / 2)
    near = lambda v: F.abs(v - F.col("midpoint")) <= tolerance + 1e-9
    status = (
        F.when(F.col("estimate").isNotNull(),
               F.when(near(F.col("estimate")), "ok").otherwise("mismatch"))
        .when(F.exists("_bare", near), "ok").otherwise("abstain"))
    return out.withColumn("status", status).drop("_bare")
