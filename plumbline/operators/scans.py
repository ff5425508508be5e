"""Scans of texts: draft gate, red lines, secrets and evidence windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed_writing as fw
from plumbline.functions import text as tx
from plumbline.operators.joins import eq_join, unfold
from plumbline.session import pin


def draft_gate(
    drafts: DataFrame, keys: Sequence[str], claim_ids: DataFrame, text: str = "text"
) -> DataFrame:
    """Paragraphs that praise without a number or claim id, use vague phrases, or report results without
    a claim id.

    ``claim_ids``: keys, claim_id.  Ids are found as tokens of a paragraph and matched by equality, so
    no paragraph is compared with every id.
    """
    paras = drafts.select(*keys, F.posexplode(F.split(text, r"\n+")).alias("paragraph_no", "paragraph"))
    paras = paras.where((F.trim("paragraph") != "") & ~F.trim("paragraph").startswith("#"))
    p = F.col("paragraph")
    low = F.lower(p)
    any_of = lambda words: "|".join(w.replace(".", r"\.") for w in words)
    hits = lambda words, own=lambda s: F.lit(True): low.rlike(any_of(words)) & F.exists(
        F.split(low, r"(?<=[。.!?；;])(?!\d)"), lambda s: s.rlike(any_of(words)) & own(s))
    flags = F.struct(
        hits(fw.PRAISE_WORDS, lambda s: ~s.rlike(r"\d")).alias("praise"), hits(fw.VAGUE_PHRASES).alias("vague"),
        (p.rlike(fw.RESULT_NUMBER) & p.rlike(fw.RESULT_STATISTIC) & p.rlike(fw.RESULT_METHOD)).alias("result"))
    # judged before any shuffle, so that only ids of paragraphs with something to say go on, and no paragraph does
    judged = unfold(paras.withColumn("_row", F.array(flags)), [*keys, "paragraph_no", "paragraph"], "_row", "vague")
    tokens = F.array_distinct(F.regexp_extract_all(
        "paragraph", F.lit(r"[A-Za-z][A-Za-z0-9_]*(?:-[A-Za-z0-9_]+)+"), F.lit(0)))
    told = pin(judged.where("praise or vague or result").select(
        *keys, "paragraph_no", "praise", "vague", "result", tokens.alias("_ids")))
    found = told.select(*keys, "paragraph_no", F.explode("_ids").alias("claim_id"))
    anchored = eq_join(found, claim_ids.select(*keys, "claim_id").distinct(), [*keys, "claim_id"],
                       "left_semi").select(*keys, "paragraph_no").distinct().withColumn(
        "anchored", F.lit(True))
    marked = eq_join(told.drop("_ids"), anchored, [*keys, "paragraph_no"], "left").withColumn(
        "anchored", F.coalesce("anchored", F.lit(False)))
    issues = F.array_compact(F.array(
        F.when(F.col("praise") & ~F.col("anchored"), F.struct(
            F.lit("warn").alias("level"), F.lit("praise_without_number").alias("rule"))),
        F.when(F.col("vague"), F.struct(F.lit("warn").alias("level"), F.lit("vague_phrase").alias("rule"))),
        F.when(F.col("result") & ~F.col("anchored"), F.struct(
            F.lit("error").alias("level"), F.lit("result_without_claim").alias("rule")))))
    return marked.select(*keys, "paragraph_no", F.inline(issues))


def red_lines(
    texts: DataFrame, keys: Sequence[str], text: str = "text", rules=fw.RED_LINES,
    safe: str = fw.SAFE_INTENT,
) -> DataFrame:
    """Core rules block always; writing rules are waived by an editing intent."""
    body = F.lower(F.trim(text))
    n = {c: sum((body.rlike(p).cast("int") for k, p in rules if k == c), F.lit(0))
         for c in ("core", "writing")}
    core, writing = n["core"] > 0, (n["writing"] > 0) & ~body.rlike(safe)
    return texts.select(
        *keys, n["core"].cast("long").alias("core_hits"), n["writing"].cast("long").alias("writing_hits"),
        F.when(core, "core").when(writing, "writing").alias("category"), (core | writing).alias("blocked"))


def secret_scan(
    texts: DataFrame, keys: Sequence[str], text: str = "text", hashed: DataFrame | None = None,
) -> DataFrame:
    """Category and offset of secrets and identifiers; the matched string itself is never kept.

    ``hashed`` holds SHA-256 values of watched e-mail addresses or digit strings.
    """
    found = tx.locate(texts, keys, text, {
        "key": fw.KEY_SHAPE, "account": fw.ACCOUNT_SHAPE, "email": fw.EMAIL_SHAPE,
        "digits": r"\d{6,}"}, 0)
    raw = F.col("raw")
    after_dash = F.regexp_replace(raw, r"^[a-z]+-", "")
    varied = F.size(F.array_distinct(F.split(after_dash, ""))) >= 4
    plain = found.where(
        ((F.col("kind") == "key") & F.substring(raw, F.lit(4), F.length(raw)).rlike(fw.LONG_RUN))
        | ((F.col("kind") == "account") & varied) | (F.col("kind") == "email"))
    out = plain.select(*keys, F.col("kind").alias("category"), F.col("start").alias("pos"))
    if hashed is None:
        return out
    watched = found.where(F.col("kind").isin("email", "digits")).withColumn("sha", F.sha2(raw, 256))
    hits = watched.join(hashed.select(F.col("sha")), "sha", "left_semi")
    return out.unionByName(hits.select(
        *keys, F.lit("watched").alias("category"), F.col("start").alias("pos")))


def assigned_secrets(
    texts: DataFrame, keys: Sequence[str], text: str = "text", least: int = 20, any_case: bool = True
) -> DataFrame:
    """Long unbroken runs assigned to a name such as token, key or secret.

    ``any_case`` also takes names in capitals.  Bounds and blanks are those of ASCII, whatever the Java version.
    """
    pattern = (("(?i)" if any_case else "") + r"(?<![A-Za-z0-9_])(?:token|key|secret|password)[ \t\n\f\r]*[:=]"
               r"[ \t\n\f\r]*[\"']?[A-Za-z0-9]{" + str(least) + ",}")
    found = tx.locate(texts, keys, text, {"assigned": pattern}, 0)
    return found.select(*keys, F.col("kind").alias("category"), F.col("start").alias("pos"))


def evidence_windows(
    texts: DataFrame, keys: Sequence[str], keyword: str, text: str = "text", before: int = 300,
    after: int = 900, top: int | None = 4,
) -> DataFrame:
    """Windows around a keyword that do not overlap; the next search starts where a window ended.

    ``top`` is how many windows of a text are wanted; None keeps them all.  The walk over the hits is an
    aggregate over the text's own array of positions.
    """
    pieces = texts.select(*keys, F.col(text).alias("_t"), F.split(
        F.col(text), F.regexp_replace(F.lit(keyword), r"([\\\[\](){}.*+?^$|])", r"\\$1"), -1).alias("_p"))
    size = F.length(F.lit(keyword))
    positions = F.aggregate(
        F.slice("_p", 1, F.greatest(F.size("_p") - 1, F.lit(0))),
        F.struct(F.lit(0).alias("at"), F.lit(-1).alias("free"),
                 F.array().cast("array<int>").alias("kept")),
        lambda s, piece: _step(s, piece, size, after))
    found = pieces.where(F.size("_p") > 1).withColumn("_kept", positions["kept"])
    if top is not None:
        found = found.withColumn("_kept", F.slice("_kept", 1, top))
    rows = found.select(*keys, "_t", F.posexplode_outer("_kept").alias("window_no", "_pos")).where(
        "_pos is not null")
    start = F.greatest(F.col("_pos") - before, F.lit(0))
    stop = F.least(F.col("_pos") + after, F.length("_t"))
    return rows.select(*keys, "window_no", start.alias("start"), stop.alias("stop"),
                       F.substring(F.col("_t"), start + 1, stop - start).alias("excerpt"))


def _step(state: Column, piece: Column, size: Column, after: int) -> Column:
    position = state["at"] + F.length(piece)
    take = position >= state["free"]
    return F.struct(
        (position + size).alias("at"),
        F.when(take, position + after).otherwise(state["free"]).alias("free"),
        F.when(take, F.concat(state["kept"], F.array(position))).otherwise(state["kept"]).alias("kept"))


def anchored_excerpts(
    texts: DataFrame, keys: Sequence[str], anchors: dict[str, str], budget: int, text: str = "text",
    before: int = 500, after: int = 1300,
) -> DataFrame:
    """Excerpts around several anchors, interleaved by purpose, merged, within a character budget.

    ``anchors`` maps a purpose to a pattern; the order of the mapping is the order of preference.
    Windows that fit are merged where they touch, so nothing is counted twice.
    """
    from pyspark.sql import Window
    purposes = list(anchors)
    hits = tx.locate(texts, keys, text, anchors, 0)
    turn = Window.partitionBy(*keys, "kind").orderBy("start")
    preference = F.create_map(*[x for i, p in enumerate(purposes) for x in (F.lit(p), F.lit(i))])
    ranked = hits.withColumns({"turn": F.row_number().over(turn), "pref": preference[F.col("kind")]})
    sizes = texts.select(*keys, F.length(text).alias("_len"))
    placed = eq_join(ranked, sizes, keys).withColumns({
        "lo": F.greatest(F.col("start") - before, F.lit(0)).cast("long"),
        "hi": F.least(F.col("start") + after, F.col("_len")).cast("long")})
    spent = F.sum(F.col("hi") - F.col("lo")).over(
        Window.partitionBy(*keys).orderBy("turn", "pref", "start").rowsBetween(
            Window.unboundedPreceding, Window.currentRow))
    chosen = placed.withColumn("_spent", spent).where(F.col("_spent") <= budget)
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (F.coalesce(F.col("lo") > reach, F.lit(True))).cast("int")
    islands = chosen.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = islands.groupBy(*keys, "_island").agg(
        F.min("lo").alias("start"), F.max("hi").alias("stop"),
        F.array_sort(F.collect_set("kind")).alias("purposes"))
    cut = eq_join(merged, texts.select(*keys, F.col(text).alias("_t")), keys)
    return cut.select(*keys, "start", "stop", "purposes", F.substring(
        F.col("_t"), (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int"))
        .alias("excerpt"))
