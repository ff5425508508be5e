"""Text helpers: normalisation, sentence tables and pattern hits with their offsets.

Spark's regular expressions return no positions.  ``locate`` marks the hits in the text, splits at the
marks and adds up piece lengths, so offsets come out of built-in functions; only the hits and lengths
are shuffled, never the text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OPEN, _CLOSE = "\u0001", "\u0002"

# --- fixed values: glyphs replaced one for one, so that offsets stay true ----------------------
FULL_WIDTH = "（）＝＜＞≦≧，．：；－−–‐﹣＋［］～ＰｐＴｔＦｆＲｒＺｚＸｘＮｎ²Χ"
PLAIN = "()=<>≤≥,.:;-----+[]~PpTtFfRrZzXxNn2χ"
MATH_ITALIC = {
    "\U0001D45D": "p", "\U0001D443": "P", "\U0001D461": "t", "\U0001D447": "T", "\U0001D439": "F",
    "\U0001D45F": "r", "\U0001D467": "z", "\U0001D44D": "Z", "\U0001D45B": "n", "\U0001D441": "N",
    "\U0001D451": "d", "\U0001D453": "f", "\U0001D712": "χ", "\U0001D6FC": "α",
}
FULL_DIGITS = "".join(chr(0xFF10 + i) for i in range(10))

#: Every glyph above and more: one range, and the glyphs before it.
_MAYBE_GLYPH = "[" + "".join(c for c in FULL_WIDTH if c < "\u2010") + "\u2010-\U0010FFFF]"

SENTENCE_END = r"[。！？!?\n]"
CLAUSE_END = r"[。！？!?\n；;]"
METHOD_SENTENCE_END = r"[。！？；\n]|[.!?;](?=\s|$)"


def normalize(text: Column) -> Column:
    """Full-width and mathematical glyphs to plain ones, character by character."""
    source = FULL_WIDTH + FULL_DIGITS + "".join(MATH_ITALIC)
    target = PLAIN + "0123456789" + "".join(MATH_ITALIC.values())
    # translate looks up every character; texts without any of those glyphs are left as they are
    return F.when(text.rlike(_MAYBE_GLYPH), F.translate(text, source, target)).otherwise(text)


def sentences(
    df: DataFrame, keys: Sequence[str], text: str, end: str = SENTENCE_END,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per sentence: ``(keys, keep, sentence_no, sentence)``; empty ones are left out."""
    pieces = F.posexplode(F.split(F.col(text), end))
    return (
        df.select(*keys, *keep, pieces.alias("sentence_no", "sentence"))
        .where(F.trim("sentence") != "")
    )


def unmarked(text: Column) -> Column:
    """A text with blanks in place of the marks that ``locate`` sets, so that offsets stay true."""
    return F.when(text.contains(_OPEN) | text.contains(_CLOSE), F.translate(text, _OPEN + _CLOSE, "  ")).otherwise(text)


def _marked(text: Column, pattern: str) -> Column:
    """Pieces of a text, each but the first starting with a hit that ends at a closing mark."""
    return F.split(
        F.regexp_replace(unmarked(text), F.lit(f"(?:{pattern})"), F.lit(f"{_OPEN}$0{_CLOSE}")), _OPEN)


def _hits(pieces: Column, kind: str, context: int) -> Column:
    """Array of hits: ``gap`` (characters since the previous hit), ``raw``, ``before``, ``after``."""
    rest = lambda p: F.substring_index(p, _CLOSE, -1)
    return F.transform(
        F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda piece, i: F.struct(
            F.lit(kind).alias("kind"), F.length(rest(pieces[i])).alias("gap"),
            F.substring_index(piece, _CLOSE, 1).alias("raw"),
            # a piece holds one closing mark at most
            F.right(F.translate(F.right(pieces[i], F.lit(context + 1)), _CLOSE, ""), F.lit(context)).alias("before"),
            F.left(rest(piece), F.lit(context)).alias("after"),
        ))


def locate(
    df: DataFrame, keys: Sequence[str], text: str, patterns: dict[str, str], context: int = 50,
    keep: Sequence[str] = (), texts: dict[str, str] | None = None,
) -> DataFrame:
    """All hits of several patterns: ``(keys, keep, kind, start, stop, raw, before, after)``.

    ``start`` counts characters from zero.  ``texts`` names another column for some of the kinds.  The
    split pieces are columns of their own, so that each pattern scans the text once; the window runs
    over the hits of one text and kind.
    """
    texts = texts or {}
    pieces = df.select(*keys, *keep, *[
        _marked(F.col(texts.get(kind, text)), pattern).alias(f"_m{i}")
        for i, (kind, pattern) in enumerate(patterns.items())])
    found = F.flatten(F.array(*[
        _hits(F.col(f"_m{i}"), kind, context) for i, kind in enumerate(patterns)]))
    rows = pieces.select(*keys, *keep, F.posexplode(found).alias("_i", "_h")).select(
        *keys, *keep, "_i", "_h.*")
    order = Window.partitionBy(*keys, "kind").orderBy("_i")
    step = F.col("gap") + F.length("raw")
    stop = F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("stop", stop.cast("long")).withColumn(
        "start", F.col("stop") - F.length("raw")
    ).select(*keys, *keep, "kind", "start", "stop", "raw", "before", "after")


def count_hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


#: Han characters, and all from general punctuation on, as classes of a pattern.
HAN = "[\u3400-\u9fff]"
WIDE = "[\u2010-\uffff]"
_REPEAT = re.compile(r"(?:[?*+]|\{\d*,?\d*\})[?+]?")


def needs_han(pattern: str) -> bool:
    """Whether every hit of a pattern holds a Han character, as far as its literals tell; in doubt False.

    Such patterns need not be tried on texts without one.
    """
    return _needs(pattern, "\u3400", "\u9fff", (None, ":"))


def needs_wide(pattern: str) -> bool:
    """Whether every hit of a pattern holds a character of ``WIDE`` or looks at one beside it; in doubt False."""
    return _needs(pattern, "\u2010", "\uffff", (None, ":", "=", "<="))


def _needs(pattern: str, low: str, high: str, groups: Sequence[str | None]) -> bool:
    within = lambda c: low <= c <= high

    def branches(i: int) -> tuple[bool, int]:
        every, own = True, False
        while i < len(pattern) and pattern[i] != ")":
            if pattern[i] == "|":
                every, own, i = every and own, False, i + 1
                continue
            need = False
            if pattern[i] == "(":
                look = re.compile(r"\((?:\?(:|<?[=!]))?(?!\?)").match(pattern, i)
                if look is None:
                    return False, len(pattern) + 1
                inner, i = branches(look.end())
                need, i = inner and look[1] in groups, i + 1
            elif pattern[i] == "[":
                end = i + 1
                while end < len(pattern) and pattern[end] != "]":
                    end += 1 + (pattern[end] == "\\")
                body = pattern[i + 1:end].replace("-", "")
                need, i = bool(body) and all(map(within, body)), end + 1
            elif pattern[i] == "\\":
                i += 2
            else:
                need, i = within(pattern[i]), i + 1
            repeat = _REPEAT.match(pattern, i)
            if repeat:
                need, i = need and not repeat[0].startswith(("?", "*", "{0", "{,")), repeat.end()
            own = own or need
        return every and own, i

    need, end = branches(0)
    return need and end == len(pattern)
