"""References, citations, captions, typography and structure of texts.

Almost everything here stays inside the row of its text: lines, entries and citations are arrays, set
differences are array functions, and only findings are unfolded.  No text is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed_text as ft
from plumbline.functions import fixed_writing as fw
from plumbline.functions import text as tx
from plumbline.functions.numbers import chinese_numeral
from plumbline.operators.joins import unfold


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _ints(texts: Column) -> Column:
    return F.transform(texts, lambda x: x.try_cast("int"))


# ---- sections --------------------------------------------------------------------------------

def split_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``body``, ``refs`` and ``tail``.

    The reference section starts at the first heading that entries follow, else at the last heading.
    """
    frame = docs.withColumn("_parts", F.split(F.col(text), fw.REFERENCE_HEAD))
    starts = F.filter(
        F.transform("_parts", lambda p, i: F.struct(i.alias("i"), F.left(p, F.lit(400)).alias("h"))),
        lambda p: (p["i"] > 0) & p["h"].rlike(fw.FIRST_ENTRY))
    at = F.coalesce(F.try_element_at(starts, F.lit(1))["i"], F.size("_parts") - 1)
    frame = frame.withColumn("_at", F.when(F.size("_parts") > 1, at))
    rest = F.array_join(F.slice("_parts", F.col("_at") + 1, F.size("_parts")), "\n")
    frame = frame.withColumns({
        "body": F.when(F.col("_at").isNull(), F.col(text)).otherwise(
            F.array_join(F.slice("_parts", 1, F.greatest(F.col("_at"), F.lit(1))), "\n")),
        "_rest": F.when(F.col("_at").isNotNull(), rest)})
    cut = F.split(F.col("_rest"), fw.TAIL_HEAD, 2)
    return frame.withColumns({
        "refs": F.coalesce(F.try_element_at(cut, F.lit(1)), F.lit("")),
        "tail": F.coalesce(F.try_element_at(cut, F.lit(2)), F.lit("")),
        "has_reference_heading": F.col("_at").isNotNull(),
    }).drop("_parts", "_at", "_rest")


# ---- reference entries -----------------------------------------------------------------------

def _numbered(refs: Column, pattern: str) -> Column:
    """Entries ``(num, entry)`` of a block whose lines start with numbers."""
    marked = F.split(F.regexp_replace(refs, pattern, "\u0001$1\u0002"), "\u0001")
    return F.transform(
        F.slice(marked, 2, F.greatest(F.size(marked) - 1, F.lit(0))),
        lambda p: F.struct(
            F.substring_index(p, "\u0002", 1).try_cast("int").alias("num"),
            _entry_text(F.array(F.substring_index(p, "\u0002", -1))).alias("entry")))


#: Marks: before an entry's number and after it; before a number inside a line, after it, and after the text it was printed as.
_LINE, _NUMBER, _INSIDE, _VALUE, _PRINTED = (chr(k) for k in range(1, 6))


def _entry_text(parts: Column) -> Column:
    return F.trim(F.regexp_replace(F.array_join(parts, ""), r"\s*\n\s*", " "))


def _chained(refs: Column) -> Column:
    """Entries ``(num, entry)`` of a block whose lines start with bracketed numbers, entries inside a line included.

    Where lines were run together, an entry starts inside a line.  A number there counts only as the successor of the last number that
    counted, so the entries of a line are the chain of consecutive numbers that its first one begins; other numbers stay text.  A line
    is folded over its numbers once, and the chain holds at most as many entries as three digits name.
    """
    line = F.regexp_replace(refs, fw.ENTRY_BRACKET, f"{_LINE}$1{_NUMBER}")
    inside = F.regexp_replace(
        line, fw.ENTRY_INLINE.replace("([.", f"([{_NUMBER}.", 1), f"$1{_INSIDE}$3{_VALUE}$2{_PRINTED}")
    lines = F.split(inside, _LINE)
    pieces = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda p: F.split(p, _INSIDE))

    def number(piece: Column, i: Column) -> Column:
        return F.when(i == 0, F.substring_index(piece, _NUMBER, 1)).otherwise(F.substring_index(piece, _VALUE, 1)).try_cast("int")

    def follow(chain: Column, x: Column) -> Column:
        counts = (F.size(chain["at"]) == 0) | (x["num"] == chain["last"] + 1)
        return F.when(F.coalesce(counts, F.lit(False)), F.struct(
            x["num"].alias("last"), F.concat(chain["at"], F.array(x["i"])).alias("at"))).otherwise(chain)

    start = F.struct(F.lit(None).cast("int").alias("last"), _empty("int").alias("at"))
    found = F.transform(pieces, lambda p: F.struct(p.alias("p"), F.transform(
        p, lambda piece, i: F.struct(number(piece, i).alias("num"), i.alias("i"))).alias("n")))
    chains = F.transform(found, lambda f: F.struct(
        f["p"].alias("p"), f["n"].alias("n"), F.aggregate(f["n"], start, follow)["at"].alias("at")))

    def entries(f: Column) -> Column:
        def entry(at: Column, k: Column) -> Column:
            end = F.coalesce(F.try_element_at(f["at"], k + 2), F.size(f["p"]))
            parts = F.transform(F.slice(f["p"], at + 1, end - at), lambda piece, j: F.when(
                j > 0, F.translate(F.substring_index(piece, _VALUE, -1), _PRINTED, "")).otherwise(
                F.substring_index(F.substring_index(piece, _PRINTED, -1), _NUMBER, -1)))
            return F.struct(F.try_element_at(f["n"], at + 1)["num"].alias("num"), _entry_text(parts).alias("entry"))

        return F.transform(f["at"], entry)

    return F.flatten(F.transform(chains, entries))


def with_entries(sectioned: DataFrame) -> DataFrame:
    """Add ``entries`` (array of num, entry) and ``entry_mode`` to a frame from ``split_sections``.

    ``explicit``: numbered lines.  ``implicit``: numbers lost, every line that looks like a reference is
    one.  ``unparsed``: neither.  Bracketed numbers are followed into the lines, where one was pulled into the line of the entry before.
    """
    lines = F.filter(F.split("refs", "\n"), lambda x: (F.trim(x) != "")
                     & ~x.contains(fw.TABLE_ROW) & ~x.rlike(fw.PAGE_NOISE))
    frame = sectioned.withColumn("_lines", lines).withColumn("_block", F.array_join("_lines", "\n"))
    starts = F.regexp_count("_block", F.lit(fw.ENTRY_BRACKET))
    frame = frame.withColumns({"_bracket": _chained(F.col("_block")), "_starts": starts,
                               "_dotted": _numbered(F.col("_block"), fw.ENTRY_DOTTED)})
    looks = F.filter("_lines", lambda x: x.rlike(fw.TYPE_CODE) | (
        x.rlike(fw.YEAR) & (F.length(x) >= 15) & x.rlike("[.．,，]")))
    frame = frame.withColumn("_loose", F.transform(
        looks, lambda x, i: F.struct((i + 1).cast("int").alias("num"), F.trim(x).alias("entry"))))
    single = F.size("_lines") == 1
    use_bracket = (F.col("_starts") >= 2) | (single & (F.col("_starts") == 1))
    use_dotted = (F.size("_dotted") >= 2) | (single & (F.size("_dotted") == 1))
    use_loose = F.size("_loose") >= F.greatest(F.lit(2.0), F.floor(0.6 * F.size("_lines")))
    mode = (
        F.when(F.size("_lines") == 0, "none").when(use_bracket | use_dotted, "explicit")
        .when(use_loose, "implicit").otherwise("unparsed"))
    entries = F.when(use_bracket, F.col("_bracket")).when(use_dotted, F.col("_dotted")).when(
        use_loose, F.col("_loose")).otherwise(_empty("struct<num:int,entry:string>"))
    return frame.withColumns({"entries": entries, "entry_mode": mode}).drop(
        "_lines", "_block", "_bracket", "_starts", "_dotted", "_loose")


def reference_entries(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    frame = with_entries(split_sections(docs.select(*keys, text), text))
    return unfold(frame, [*keys, "entry_mode"], "entries", "num")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is read: inside lambdas nothing else shares a value."""
    return F.transform(F.array(value), use)[0]


def entry_problems(entry: Column, current_year: int) -> Column:
    """Problem codes of one entry after the national citation standard (GB/T 7714)."""
    def parts(entry: Column) -> Column:
        return F.struct(
            entry.alias("entry"), F.regexp_extract(entry, fw.TYPE_CODE, 1).alias("base"),
            (F.regexp_extract(entry, fw.TYPE_CODE, 2) == "OL").alias("online"),
            F.coalesce(F.try_element_at(F.split(entry, fw.TYPE_CODE, 2), F.lit(2)), F.lit("")).alias("after"),
            _ints(F.regexp_extract_all(entry, F.lit(fw.YEAR), F.lit(1))).alias("years"),
            F.try_element_at(F.split(entry, r"[.。](?!\d)", 2), F.lit(1)).alias("authors"))

    def people(x: Column) -> Column:
        return F.filter(F.split(F.regexp_replace(x["authors"], fw.ET_AL, ""), "[,，;；]"), lambda n: F.trim(n) != "")

    def judged(x: Column) -> Column:
        base, online, after, years, authors = (x[k] for k in ("base", "online", "after", "years", "authors"))
        many = _let(people(x), lambda named: (F.size(named) > 3) & F.forall(
            named, lambda n: F.trim(n).rlike(f"^(?:{fw.PERSON_NAME})$")))
        flags = [
            ("no_year", (F.size(years) == 0) & ~base.isin("S", "P")),
            ("year_in_future", (F.size(years) > 0) & (F.array_min(years) > current_year)),
            ("journal_volume", (base == "J") & ~online & ~after.rlike(fw.JOURNAL_VOLUME)),
            ("journal_pages", (base == "J") & ~online & ~after.rlike(fw.PAGES)),
            ("publisher", base.isin("M", "D") & (F.size(years) > 0) & ~after.rlike(fw.PUBLISHER)),
            ("no_address", (online | (base == "EB")) & ~x["entry"].rlike(fw.URL)),
            ("no_access_date", (online | (base == "EB")) & ~x["entry"].rlike(fw.CITE_DATE)),
            ("many_authors", many & ~authors.rlike(fw.ET_AL)),
            ("no_type_code", base == ""),
        ]
        return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in flags]))

    joined = F.regexp_replace(entry, r"(?<!\d)(19|20) (\d{2})(?!\d)", "$1$2")
    return _let(joined, lambda e: _let(parts(e), judged))


def check_entries(entries: DataFrame, keys: Sequence[str], current_year: int) -> DataFrame:
    """One row per entry and problem.  The year is a parameter, so that reruns agree."""
    return entries.withColumn("_p", entry_problems(F.col("entry"), current_year)).select(
        *keys, "num", F.explode_outer("_p").alias("problem")).where("problem is not null")


def title_key(entry: Column) -> Column:
    authors = F.try_element_at(F.split(entry, r"[.。](?!\d)", 2), F.lit(1))
    rest = F.substring(entry, F.length(authors) + 1, F.length(entry))
    title = F.try_element_at(F.split(rest, fw.TYPE_CODE, 2), F.lit(1))
    return F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", "")


def duplicate_titles(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Titles listed more than once in a text, with the first number and the count."""
    return entries.withColumn("title", title_key(F.col("entry"))).where(
        F.length("title") >= 8).groupBy(*keys, "title").agg(
        F.count(F.lit(1)).alias("n"), F.min("num").alias("first_num")).where("n > 1")


def _repeated(values: Column) -> Column:
    return F.filter(F.array_distinct(values), lambda v: F.size(
        F.filter(values, lambda w: w == v)) > 1)


def with_number_gaps(frame: DataFrame) -> DataFrame:
    """Add ``gaps`` and ``repeats`` of the entry numbers (explicit numbering only)."""
    frame = frame.withColumn("_nums", F.transform("entries", lambda e: e["num"]))
    top = F.array_max("_nums")
    gaps = F.when((F.col("entry_mode") == "explicit") & (top >= 1), F.array_except(
        F.sequence(F.lit(1), top), F.col("_nums"))).otherwise(_empty("int"))
    repeats = F.when(F.col("entry_mode") == "explicit", _repeated(F.col("_nums"))).otherwise(_empty("int"))
    return frame.withColumns({"gaps": gaps, "repeats": repeats}).drop("_nums")


# ---- citations -------------------------------------------------------------------------------

def cited_numbers(body: Column, most_span: int | None = None) -> Column:
    """Cited numbers in order of appearance; ``[2,5-7]`` becomes 2, 5, 6, 7.

    A range may be as wide as its three digits allow.  With ``most_span``, a group that holds a wider range counts as no citation.
    """
    joined = F.regexp_replace(body, r"\[\s*(\d{1,3})\s*\]\s*[-~]\s*\[\s*(\d{1,3})\s*\]", "[$1-$2]")
    inside = F.regexp_extract_all(joined, F.lit(fw.CITATION), F.lit(1))

    def span(part: Column) -> Column:
        ends = _ints(F.split(F.trim(part), r"\s*[-~]\s*"))
        low, high = ends[0], F.try_element_at(ends, F.lit(2))
        good = high.isNotNull() & (low > 0) & (low < high)
        if most_span is not None:
            good = good & (high <= low + most_span)
        return F.when(F.size(ends) == 1, F.array(low)).when(
            good, F.sequence(low, F.greatest(high, low))).otherwise(F.array(F.lit(0)))

    def numbers(group: Column) -> Column:
        flat = F.flatten(F.transform(F.split(group, r"\s*,\s*"), span))
        return F.when(F.exists(flat, lambda v: v == 0), _empty("int")).otherwise(flat)

    return F.flatten(F.transform(inside, numbers))


def with_citations(frame: DataFrame) -> DataFrame:
    """Add the citation columns to a frame that has ``body`` and ``entries``.

    All of it is array arithmetic within the row.
    """
    frame = frame.withColumn("_body", tx.normalize(F.col("body")))
    leaked = _ints(F.regexp_extract_all(
        "body", F.lit(fw.ENTRY_BRACKET + r"(?=[^\n]{0,300}(?:" + fw.TYPE_CODE + "|" + fw.YEAR + "))"),
        F.lit(1)))
    frame = frame.withColumns({
        "_cites": cited_numbers(F.col("_body")),
        "_nums": F.transform("entries", lambda e: e["num"]),
        "author_years": author_years(F.col("_body")),
        "_leaked": F.when(F.col("body").rlike(fw.ENTRY_BRACKET), leaked).otherwise(_empty("int"))})
    frame = frame.withColumn("_first", F.array_distinct("_cites"))
    n_num, n_ay = F.size("_cites"), F.size("author_years")
    style = (
        F.when((n_num >= 3) & (n_num >= n_ay), "numeric").when(n_ay >= 3, "author_year")
        .when(n_num > 0, "numeric").when(n_ay > 0, "author_year").otherwise("none"))
    ordered = F.aggregate(
        "_first", F.struct(F.lit(0).alias("top"), F.lit(0).alias("bad")),
        lambda s, n: F.struct(F.greatest(s["top"], n).alias("top"),
                              (s["bad"] + (n < s["top"]).cast("int")).alias("bad")))
    has = F.size("_nums") > 0
    numeric = (F.col("style") == "numeric") & has
    frame = frame.withColumn("style", style)
    return frame.withColumns({
        "n_cites": n_num, "n_author_year": n_ay, "n_entries": F.size("_nums"),
        "not_listed": F.when(numeric, F.array_sort(F.array_except(
            F.array_except("_first", "_nums"), F.col("_leaked")))).otherwise(_empty("int")),
        "not_cited": F.when(numeric & (F.size("_first") >= 3), F.array_sort(
            F.array_except("_nums", "_first"))).otherwise(_empty("int")),
        "out_of_order": F.when(
            numeric & (F.col("entry_mode") == "explicit"), ordered["bad"]).otherwise(0),
        "author_year_missing": F.when(
            (F.col("style") == "author_year") & has, F.size(missing_author_years())).otherwise(0),
    }).drop("_body", "_cites", "_nums", "_leaked", "_first", "author_years")


CITATION_COLUMNS = ("style", "entry_mode", "has_reference_heading", "n_cites", "n_author_year",
                    "n_entries", "not_listed", "not_cited", "out_of_order", "author_year_missing")


def citation_check(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Per text: citations without entry, entries without citation, and numbers out of order."""
    frame = with_citations(with_entries(split_sections(docs.select(*keys, text), text)))
    return frame.select(*keys, *CITATION_COLUMNS)


def author_years(body: Column) -> Column:
    """Author-year citations ``(Smith et al., 2020; Doe, 2021)`` as (name, year)."""
    groups = F.regexp_extract_all(body, F.lit(fw.AUTHOR_YEAR_GROUP), F.lit(1))
    parts = F.filter(F.flatten(F.transform(groups, lambda g: F.split(g, ";"))),
                     lambda p: p.rlike(fw.AUTHOR_YEAR))
    return F.transform(parts, lambda p: F.struct(
        F.regexp_replace(F.regexp_extract(p, fw.AUTHOR_YEAR, 1), "等人?$", "").alias("name"),
        F.regexp_extract(p, fw.AUTHOR_YEAR, 2).alias("year")))


def missing_author_years() -> Column:
    """Author-year citations that no entry matches by name and year."""
    return F.filter("author_years", lambda c: ~F.exists("entries", lambda e: e["entry"].contains(
        c["year"]) & F.lower(e["entry"]).contains(F.lower(c["name"]))))


# ---- captions --------------------------------------------------------------------------------

def _naming(text: Column, words: str) -> Column:
    """Whether a text holds one of the plain ``words`` of a pattern."""
    return reduce(or_, [text.contains(w.replace("\\", "")) for w in words.split("|")])


def _caption_array(lines: Column, words: str) -> Column:
    pattern = fw.CAPTION.format(words=words)
    lines = F.filter(lines, lambda x: x.rlike(pattern) & ~F.right(F.rtrim(x), F.lit(40)).rlike(fw.CONTENTS_LINE))
    found = F.transform(lines, lambda x: F.struct(
        F.regexp_replace(F.regexp_extract(x, pattern, 2), r"\.", "-").alias("num"),
        F.trim(F.regexp_extract(x, pattern, 3)).alias("title")))
    return F.filter(found, lambda c: ~c["title"].rlike(fw.NOT_CAPTION) & (F.length(c["title"]) <= 60)
                    & ~c["title"].rlike("[,，]$"))


def _number_gaps(nums: Column) -> Column:
    """Missing numbers: flat ones from 1, and within each chapter from 1."""
    flat = F.array_distinct(_ints(F.filter(nums, lambda x: ~x.contains("-"))))
    flat_gaps = F.when(F.size(flat) >= 2, F.array_except(
        F.sequence(F.lit(1), F.greatest(F.array_max(flat), F.lit(1))), flat)).otherwise(_empty("int"))
    parts = F.filter(nums, lambda x: x.contains("-"))
    chapters = F.array_distinct(F.transform(parts, lambda x: F.split(x, "-")[0]))

    def of_chapter(ch: Column) -> Column:
        subs = F.array_distinct(F.transform(
            F.filter(parts, lambda x: F.split(x, "-")[0] == ch), lambda x: F.split(x, "-")[1].cast("int")))
        lost = F.array_except(F.sequence(F.lit(1), F.greatest(F.array_max(subs), F.lit(1))), subs)
        return F.when(F.size(subs) >= 2, F.transform(
            lost, lambda n: F.concat(ch, F.lit("-"), n.cast("string")))).otherwise(_empty("string"))

    return F.concat(F.transform(flat_gaps, lambda n: n.cast("string")),
                    F.flatten(F.transform(chapters, of_chapter)))


CAPTION_KINDS = (("figure", fw.FIGURE_WORDS), ("table", fw.TABLE_WORDS))


def with_captions(frame: DataFrame) -> DataFrame:
    """Add one struct per kind (``figure``, ``table``) with the caption findings of ``body``."""
    frame = frame.withColumn("_body", tx.normalize(F.col("body")))
    for kind, words in CAPTION_KINDS:
        line = fw.CAPTION.format(words=words)
        # only lines that name the kind can hold a caption or a mention, and neither goes beyond its line
        frame = frame.withColumn("_named", F.when(~_naming(F.col("_body"), words), _empty("string")).otherwise(
            F.filter(F.split("_body", "\n"), lambda x: _naming(x, words) & ~x.contains(fw.TABLE_ROW))))  # noqa: B023
        # a caption line is no mention; other lines, table rows aside, are running text
        running = F.filter("_named", lambda x: ~(
            x.rlike(line) & ~F.trim(F.regexp_extract(x, line, 3)).rlike(fw.NOT_CAPTION)))  # noqa: B023
        mentions = F.flatten(F.transform(running, lambda x: F.regexp_extract_all(
            x, F.lit(fw.MENTION.format(words=words)), F.lit(1))))  # noqa: B023
        frame = frame.withColumns({
            "_caps": _caption_array(F.col("_named"), words),
            "_mentioned": F.array_distinct(F.transform(mentions, lambda x: F.regexp_replace(x, r"\.", "-")))})
        frame = frame.withColumn("_have", F.array_distinct(F.transform("_caps", lambda c: c["num"])))
        doubled = F.filter("_have", lambda n: F.size(F.array_distinct(F.transform(
            F.filter("_caps", lambda c: c["num"] == n),
            lambda c: F.regexp_replace(c["title"], r"\s+", "")))) > 1)
        depth = F.transform("_have", lambda n: F.size(F.split(n, "-")))
        some = F.size("_caps") > 0
        lost = F.filter(F.array_except("_mentioned", "_have"), lambda m: F.array_contains(
            depth, F.size(F.split(m, "-"))) & ~F.exists(  # noqa: B023
            "_have", lambda h: h.startswith(F.concat(m, F.lit("-")))))
        frame = frame.withColumn(kind, F.struct(
            F.size("_caps").alias("n_captions"), F.size("_mentioned").alias("n_mentions"),
            doubled.alias("duplicates"), _number_gaps(F.col("_have")).alias("gaps"),
            F.when(some, lost).otherwise(_empty("string")).alias("not_captioned"),
            F.when(some & (F.size("_mentioned") > 0), F.array_except("_have", "_mentioned"))
            .otherwise(_empty("string")).alias("not_mentioned")))
    return frame.drop("_body", "_named", "_caps", "_have", "_mentioned")


def caption_check(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Per text and kind (figure, table): duplicate numbers, gaps, mentioned without caption, captioned
    without mention."""
    frame = with_captions(split_sections(docs.select(*keys, text), text))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("v")) for k, _ in CAPTION_KINDS])
    return frame.select(*keys, F.inline(kinds)).select(*keys, "kind", "v.*")


# ---- typography and structure ----------------------------------------------------------------

def with_typography(frame: DataFrame, rules=fw.TYPOGRAPHY, pairs=fw.PAIRS,
                    shortest: int = 20) -> DataFrame:
    """Add ``typography``: an array of (rule, n) over body lines of some length."""
    lines = F.filter(
        F.transform(F.split("body", "\n"), lambda x: F.trim(x)),
        lambda x: (F.length(x) >= shortest) & ~x.contains(fw.TABLE_ROW) & ~x.rlike(fw.SKIP_LINE)
        & ~F.right(x, F.lit(40)).rlike(fw.CONTENTS_LINE))
    frame = frame.withColumn("_lines", lines)

    # most rules and pairs are about characters that few lines of other scripts have
    frame = frame.withColumn("_wide", F.filter("_lines", lambda x: x.rlike(tx.WIDE)))

    def total(pattern: str) -> Column:
        return F.aggregate("_wide" if tx.needs_wide(pattern) else "_lines", F.lit(0),
                           lambda s, x: s + F.regexp_count(x, F.lit(pattern)))

    def count_of(line: Column, mark: str) -> Column:
        return F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))

    def unbalanced(line: Column) -> Column:
        out = F.lit(False)
        for a, b in pairs:
            differs = count_of(line, a) != count_of(line, b)
            if a == "“":
                differs = differs & ~(line.startswith("“") & (count_of(line, a) == count_of(line, b) + 1))
            out = out | ((line.contains(a) | line.contains(b)) & differs)
        return out

    paired = "_wide" if all("\u2010" <= mark <= "\uffff" for pair in pairs for mark in pair) else "_lines"
    counts = F.array(*[F.struct(F.lit(n).alias("rule"), total(p).alias("n")) for n, p in rules],
                     F.struct(F.lit("unbalanced_pair").alias("rule"),
                              F.size(F.filter(paired, unbalanced)).alias("n")))
    kept = F.filter(counts, lambda c: (c["n"] > 0) & ~(
        (c["rule"] == "blank_between_characters") & (c["n"] < 3)))
    return frame.withColumn("typography", kept).drop("_lines", "_wide")


def typography_check(docs: DataFrame, keys: Sequence[str], text: str = "text", **kw) -> DataFrame:
    """Counts per text and rule; unbalanced pairs count lines.

    A few blanks between characters are alignment, so fewer than three of them are left out.
    """
    frame = with_typography(split_sections(docs.select(*keys, text), text), **kw)
    return unfold(frame, keys, "typography", "rule").withColumn("n", F.col("n").cast("long"))


STRUCTURE_COLUMNS = ("abstract_cn", "abstract_en", "n_keywords", "n_chapters", "missing_chapters",
                     "structure_issues")


def with_structure(frame: DataFrame) -> DataFrame:
    """Add abstract heads, number of keywords, chapters and the issues they raise."""
    line = F.regexp_extract("body", fw.KEYWORD_LINE, 1)
    words = F.filter(F.split(line, r"[;、,，；]|\s{2,}"), lambda x: F.trim(x) != "")
    joined = F.transform(F.regexp_extract_all("body", F.lit(fw.CHAPTER), F.lit(1)),
                         lambda x: chinese_numeral(x))
    latin = _ints(F.regexp_extract_all("body", F.lit(fw.CHAPTER), F.lit(2)))
    frame = frame.withColumns({
        "abstract_cn": F.col("body").rlike(fw.ABSTRACT_CN),
        "abstract_en": F.col("body").rlike(fw.ABSTRACT_EN),
        "_has_keywords": F.col("body").rlike(fw.KEYWORD_LINE), "n_keywords": F.size(words),
        "_ch": F.array_distinct(F.filter(F.concat(joined, latin), lambda x: x.isNotNull()))})
    cn, en, size = F.col("abstract_cn"), F.col("abstract_en"), F.length("body")
    missing = F.when(F.size("_ch") >= 2, F.array_except(
        F.sequence(F.lit(1), F.greatest(F.array_max("_ch"), F.lit(1))), F.col("_ch"))).otherwise(
        _empty("int"))
    frame = frame.withColumns({"n_chapters": F.size("_ch"), "missing_chapters": missing})
    return frame.withColumn("structure_issues", F.array_compact(F.array(
        F.when(F.col("_has_keywords") & ~F.col("n_keywords").between(3, 8), F.lit("keyword_count")),
        F.when(cn & ~en & (size > 15000), F.lit("no_english_abstract")),
        F.when(~cn & ~en & (size > 15000) & F.col("has_reference_heading"), F.lit("no_abstract")),
        F.when(F.size("missing_chapters") > 0, F.lit("chapter_gap"))))).drop("_ch", "_has_keywords")


def structure_check(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Abstract heads, number of keywords and missing chapter numbers per text."""
    frame = with_structure(split_sections(docs.select(*keys, text), text))
    return frame.select(*keys, *STRUCTURE_COLUMNS)


# ---- wording and hypotheses ------------------------------------------------------------------

def causal_wording(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Causal wording in texts that only name correlational methods, per sentence.

    Reported literature, assumptions and conditionals left of the verb excuse a sentence.
    """
    def named(kinds: Sequence[str]) -> Column:
        return F.coalesce(*[F.when(F.col(text).rlike(p), True) for k, p in ft.METHOD_PATTERNS if k in kinds], F.lit(False))

    # the verb is sought first: its one pattern leaves few texts for those of the methods
    verbal = docs.select(*keys, text).where(F.col(text).rlike(fw.CAUSAL_VERB))
    frame = verbal.where(named(fw.CORRELATIONAL_METHODS)).where(~named(fw.EXPERIMENTAL_METHODS))
    parts = tx.sentences(frame, keys, text, r"[。！？；\n]|[.!?;](?=\s|$)")
    excused = fw.CAUSAL_SKIP + r"[^。！？；\n]{0,30}?(?:" + fw.CAUSAL_VERB + ")"
    verb = F.regexp_extract("sentence", f"({fw.CAUSAL_VERB})", 1)
    return parts.where(F.col("sentence").rlike(fw.CAUSAL_VERB) & ~F.col("sentence").rlike(excused)) \
        .select(*keys, "sentence_no", verb.alias("verb"), "sentence")


def _quantity_starts(pieces: Column) -> Column:
    """Hits of the quantity patterns at the signs that begin all pieces but the first: ``n`` (length of the piece), ``p`` and ``others``
    (where hits of p and of other kinds start, counted from the sign, so never above 0).

    A hit has one sign followed by a number, so it lies in the end of one piece and the start of the next.  These are cut to what a hit
    can be long, unless a long run of blanks or digits is there.
    """
    def cut(piece: Column, some: Column) -> Column:
        return F.when(some.rlike(ft.LONG_BLANK), piece).otherwise(some)

    def first(around: Column, pattern: str) -> Column:
        lead = F.regexp_extract(around["text"], f"(?s)^(.*?)(?:{pattern})", 1)
        return F.when(around["text"].rlike(pattern), F.length(lead) - around["back"])

    def hits(around: Column) -> Column:
        others = [first(around, v) for k, v in ft.QUANTITY_PATTERNS.items() if k not in ("n", "p")]
        return F.struct(around["n"].alias("n"), first(around, ft.QUANTITY_PATTERNS["p"]).alias("p"),
                        F.array_distinct(F.array_compact(F.array(*others))).alias("others"))

    def near(piece: Column, i: Column) -> Column:
        before = cut(pieces[i], F.right(pieces[i], F.lit(ft.QUANTITY_LEAD)))
        after = cut(piece, F.left(piece, F.lit(ft.QUANTITY_TAIL)))
        return _let(before, lambda b: F.struct(
            F.length(piece).alias("n"), F.length(b).alias("back"), F.concat(b, after).alias("text")))

    later = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(F.transform(later, near), hits)


def _count_tests(length: Column, starts: Column, reach: int) -> Column:
    """p-values plus other statistics without a p-value within ``reach``, from ``_quantity_starts`` behind ``length`` characters.

    One fold in order of position; a statistic waits for its p-value while one can still be near, so few wait at a time.
    """
    def step(s: Column, x: Column) -> Column:
        p = s["at"] + x["p"]
        fresh = F.filter(F.transform(x["others"], lambda o: s["at"] + o), lambda o: s["last"].isNull() | (o - s["last"] > reach))

        def after(waiting: Column) -> Column:
            lost = F.filter(waiting, lambda o: F.when(p.isNotNull(), F.abs(o - p) > reach).otherwise(s["at"] - o > reach))
            return F.struct(
                (s["at"] + x["n"]).alias("at"), F.coalesce(p, s["last"]).alias("last"),
                (s["n"] + F.size(lost) + F.when(p.isNotNull(), 1).otherwise(0)).alias("n"),
                F.when(p.isNotNull(), _empty("int")).otherwise(F.filter(waiting, lambda o: s["at"] - o <= reach)).alias("waiting"))

        return _let(F.concat(s["waiting"], fresh), after)

    start = F.struct(length.alias("at"), F.lit(None).cast("int").alias("last"), F.lit(0).alias("n"), _empty("int").alias("waiting"))
    return F.aggregate(starts, start, step, lambda s: s["n"] + F.size(s["waiting"]))


def hypothesis_coverage(
    docs: DataFrame, keys: Sequence[str], text: str = "text", reach: int = 150
) -> DataFrame:
    """Numbered hypotheses against reported tests.

    Every p-value is a test; a statistic without a p-value within ``reach`` characters is one too.  A text is cut at the signs before
    numbers, and the patterns are tried around these only.  Nothing is shuffled.
    """
    named = F.regexp_extract_all(text, F.lit(fw.HYPOTHESIS), F.lit(0))
    declared = F.array_distinct(F.filter(F.transform(
        named, lambda x: chinese_numeral(F.regexp_replace(x, fw.HYPOTHESIS_HEAD, ""))), lambda x: x.isNotNull()))
    frame = docs.select(*keys, F.size(declared).cast("long").alias("n_declared"),
                        F.split(tx.unmarked(F.col(text)), f"(?={ft.QUANTITY_SIGN})").alias("_pieces"))
    tests = _count_tests(F.length(F.col("_pieces")[0]), _quantity_starts(F.col("_pieces")), reach)
    n_tests = F.col("n_tests")
    return frame.select(*keys, "n_declared", F.coalesce(tests, F.lit(0)).cast("long").alias("n_tests")).select(
        *keys, "n_declared", "n_tests",
        F.when(F.col("n_declared") < 3, "abstain").when(
            F.col("n_declared") - n_tests >= 2, "uncovered").otherwise("ok").alias("status"))


# ---- roll-up ---------------------------------------------------------------------------------

PROBLEM_PRIORITY = {
    "no_year": "P1", "year_in_future": "P1", "journal_volume": "P1", "journal_pages": "P1",
    "publisher": "P1", "no_address": "P2", "no_access_date": "P2", "many_authors": "P2",
    "no_type_code": "P1",
}


def lint(docs: DataFrame, keys: Sequence[str], current_year: int, text: str = "text") -> DataFrame:
    """All integrity findings as ``(keys, priority, category, issue, n)``.

    One pass over the texts: sections and entries are found once, every check adds columns to the same
    row, and the findings are unfolded at the end.  Nothing is shuffled.
    """
    keys = list(keys)
    frame = with_number_gaps(with_entries(split_sections(docs.select(*keys, text), text)))
    frame = with_structure(with_typography(with_captions(with_citations(frame)))).drop(
        text, "body", "refs", "tail")
    frame = frame.withColumns({
        "_problems": F.flatten(F.transform(
            "entries", lambda e: entry_problems(e["entry"], current_year))),
        "_titles": F.filter(F.transform("entries", lambda e: title_key(e["entry"])),
                            lambda x: F.length(x) >= 8)})
    implicit = F.col("entry_mode") == "implicit"
    rows: list[tuple[str, str, str, Column]] = [
        (priority, "references", code, _count_equal("_problems", code))
        for code, priority in PROBLEM_PRIORITY.items()]
    rows += [
        ("P1", "references", "duplicate_title", F.size(_repeated(F.col("_titles")))),
        ("P1", "references", "number_gap", F.size("gaps") + F.size("repeats")),
        ("P0", "citations", "not_listed", F.when(~implicit, F.size("not_listed"))),
        ("P1", "citations", "not_listed", F.when(implicit, F.size("not_listed"))),
        ("P1", "citations", "not_cited", F.size("not_cited")),
        ("P2", "citations", "out_of_order", F.col("out_of_order")),
        ("P1", "citations", "author_year_missing", F.col("author_year_missing")),
        ("P2", "citations", "no_citations",
         F.when((F.col("style") == "none") & (F.col("n_entries") > 0), 1)),
        ("P1", "citations", "no_reference_list", F.when(~F.col("has_reference_heading") & (
            (F.col("n_cites") >= 3) | (F.col("n_author_year") >= 3)), 1)),
    ]
    for kind, _ in CAPTION_KINDS:
        c = F.col(kind)
        rows += [
            ("P1", kind, "duplicate_number", F.size(c["duplicates"])),
            ("P2", kind, "number_gap", F.size(c["gaps"])),
            ("P1", kind, "not_captioned", F.size(c["not_captioned"])),
            ("P2", kind, "not_mentioned", F.size(c["not_mentioned"])),
            ("P2", kind, "no_captions",
             F.when((c["n_captions"] == 0) & (c["n_mentions"] >= 2), 1)),
        ]
    make = lambda p, c, i, n: F.struct(
        p.alias("priority"), c.alias("category"), i.alias("issue"), n.cast("long").alias("n"))
    fixed = F.array(*[make(F.lit(p), F.lit(c), F.lit(i), n) for p, c, i, n in rows])
    typo = F.transform("typography", lambda r: make(
        F.lit("P2"), F.lit("typography"), r["rule"], r["n"]))
    structure = F.transform("structure_issues", lambda i: make(
        F.when(i.isin("no_abstract", "chapter_gap"), "P1").otherwise("P2"), F.lit("structure"), i,
        F.lit(1)))
    found = F.filter(F.concat(fixed, typo, structure), lambda r: r["n"] > 0)
    return frame.select(*keys, F.inline(found))


def _count_equal(array: str, value: str) -> Column:
    return F.size(F.filter(array, lambda x: x == value))


def lint_summary(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    return findings.groupBy(*keys).agg(
        *[F.count_if(F.col("priority") == p).alias(p.lower()) for p in ("P0", "P1", "P2")],
        F.count(F.lit(1)).alias("n_findings"))
