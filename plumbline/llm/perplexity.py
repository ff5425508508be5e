"""Quality rules by n-gram perplexity: a modified Kneser-Ney model of letters across whole texts.

A text is its words one after the other, each closed by a bound, in 64 symbols: letters, digits and common marks are one symbol, every
byte over 127 is a pair of them (``FIRST``, ``SECOND``), so no two letters of any script are merged.  Five-grams run across the bounds of words,
so the end of one word and the start of the next are judged together.  Spark counts the five-grams of all texts by language, summed
per task before the shuffle; lower orders use continuation counts.  Probabilities and backoff weights lie in arrays sorted by n-gram code and
are found by binary search.  A language's model is mixed with that of all languages by the weight of its letters (``OWN_WEIGHT``).  A
document's figure is the mean negative log10 probability per symbol under the model of its language (column ``lang``); a second
figure is its variety, the log of its distinct words less what its number of words leads to expect.

Both have limits from the quartiles of the language's own documents: ``SPREAD`` interquartile ranges beyond them for the first,
``VARIETY_SPREAD`` below them for the second, wider for short texts.  Quartiles are taken from the language's median and shrunk towards those
of all documents by ``SHRINK`` documents, so that no number of documents switches the rule.  They are exact over bins of
``BIN``.  Documents outside the limits, and those that fail the base rules, are not kept.

Cases: a null or empty text has no words and fails the base rules; a null language is a group of its own;
repeated rows are judged alike; long texts are read whole; an empty table gives an empty result.  Only the
columns named by ``id``, ``text`` and ``lang`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - as pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import blocks as B
from plumbline.session import pin

ORDER = 5
SPREAD = 2.0
VARIETY_SPREAD = 6.0
#: Short texts vary more: the limits widen by this over the square root of the letters, or of the words.
WIDEN, VARIETY_WIDEN = 1.0, 1.5
#: The quartiles of all documents count as so many of a language's own.
SHRINK = 50.0
#: The model of all languages counts as so many letters of a language.
OWN_WEIGHT = 20_000.0
BIN = 0.001
LEAST_WORDS = 10
REPEATED_PERCENT = 20
WINDOW = 5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """First and second symbol of each byte (-1: none): 0 is the bound of a word, 1-26 letters, 27 digits, 28-36 marks, 37 other
    bytes below 128; a byte above is one of 38-53 by its upper and one of 54-61 by its lower bits."""
    first, second = np.zeros(256, np.int8), np.full(256, -1, np.int8)
    for b in range(256):
        c = chr(b).lower()
        if "a" <= c <= "z" and b < 128:
            first[b] = ord(c) - ord("a") + 1
        elif "0" <= c <= "9":
            first[b] = 27
        elif b < 128:
            place = ".,;:!?'-\"".find(c)
            first[b] = 28 + place if place >= 0 else 37
        else:
            first[b], second[b] = 38 + (b - 128) // 8, 54 + b % 8
    return first, second


FIRST, SECOND = _symbols()
WIDTH = (1 + (SECOND >= 0)).astype(np.int8)
CODE_BITS = 6 * ORDER


def grams(block: B.Block, words: B.Words) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the five-grams of each text, one for every symbol of its words and one for the bound after each, and bounds per text.

    A code holds the symbol itself in its low 6 bits and the four symbols before it above; before a text are bounds (0).
    """
    data = block.data
    inner = ~B.SPACE[data]
    width = WIDTH[data] * inner
    width[words.ends - 1] += 1
    to = np.zeros(len(data) + 1, np.int64)
    np.cumsum(width, out=to[1:])
    stream = np.zeros(to[-1], np.int64)
    stream[to[:-1][inner]] = FIRST[data[inner]]
    pair = inner & (SECOND[data] >= 0)
    stream[to[:-1][pair] + 1] = SECOND[data[pair]]
    at = to[block.offsets]
    whole = stream.copy()
    for back in range(1, ORDER):
        earlier = np.zeros_like(stream)
        earlier[back:] = stream[:-back]
        outside = (at[:-1, None] + np.arange(back)).ravel()
        earlier[outside[outside < len(stream)]] = 0
        whole += earlier << (6 * back)
    return whole, at


def by_language(code: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Codes with the numbers of their texts' languages in the bits above."""
    return (np.repeat(own.astype(np.int64), np.diff(at)) << CODE_BITS) + code


class Counter:
    """Counts of codes as sorted arrays; what was added since is merged when it has grown as large."""

    LEAST = 1 << 20

    def __init__(self):
        self.parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((codes, counts))
        if sum(len(c) for c, _ in self.parts[1:]) > max(self.LEAST, len(self.parts[0][0])):
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        codes, inverse = np.unique(np.concatenate([c for c, _ in self.parts]), return_inverse=True)
        counts = np.zeros(len(codes), np.int64)
        np.add.at(counts, inverse, np.concatenate([n for _, n in self.parts]))
        self.parts = [(codes, counts)]
        return codes, counts


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, code, n)``: five-gram counts over the whole texts of all documents by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str | None, Counter] = {}
        for batch in batches:
            kinds = pa.compute.dictionary_encode(batch.column(1), null_encoding="encode")
            names, numbers = kinds.dictionary.to_pylist(), kinds.indices.to_numpy()
            for block in B.blocks(batch.column(0)):
                keys, counts = np.unique(
                    by_language(*grams(block, block.words()), numbers[block.first:block.last]), return_counts=True)
                edges = np.searchsorted(keys, np.arange(len(names) + 1) << CODE_BITS)
                for name, a, b in zip(names, edges[:-1], edges[1:]):
                    if b > a:
                        tables.setdefault(name, Counter()).add(keys[a:b] & ((1 << CODE_BITS) - 1), counts[a:b])
        for name, table in tables.items():
            codes, counts = table.merged()
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "code", "n"])

    return docs.select(text, F.col(lang).cast("string")).mapInArrow(run, "lang string, code long, n long").groupBy(
        "lang", "code").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """One order: sorted codes with their log10 probability, sorted contexts with their backoff weight."""

    codes: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wanted = wanted.astype(keys.dtype, copy=False)
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def build(codes: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Modified Kneser-Ney, orders 1 to ``ORDER``, from sorted codes of the highest order and their counts."""
    tables = {ORDER: (codes, counts)}
    for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols before the n-gram
        short, n = np.unique(tables[order + 1][0] & ((1 << 6 * order) - 1), return_counts=True)
        tables[order] = (short, n)
    levels: list[Level] = []
    for order in range(1, ORDER + 1):
        c, n = tables[order]
        ones, twos, threes, fours = ((n == k).sum() for k in (1, 2, 3, 4))
        y = ones / (ones + 2 * twos) if ones and twos else 0.5
        discount = np.array([0.0, 1 - 2 * y * twos / ones if ones else 0.5, 2 - 3 * y * threes / twos if twos else 1.0,
                             3 - 4 * y * fours / threes if threes else 1.5])
        discount = np.clip(discount, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.9, 2.9])
        cut = discount[np.minimum(n, 3)]
        contexts, inverse = np.unique(c >> 6, return_inverse=True)
        total = np.bincount(inverse, n, len(contexts))
        gamma = np.bincount(inverse, cut, len(contexts)) / total
        lower = 10 ** score(levels, c & ((1 << 6 * (order - 1)) - 1)) if order > 1 else np.full(len(c), 1 / 64)
        p = (n - cut) / total[inverse] + gamma[inverse] * lower
        levels.append(Level(c, np.log10(p), contexts, np.log10(gamma)))
    return levels


def _single(levels: list[Level]) -> list[Level]:
    return [Level(v.codes, v.logp.astype(np.float32), v.contexts, v.backoff.astype(np.float32)) for v in levels]


def score(levels: list[Level], codes: np.ndarray) -> np.ndarray:
    """log10 probability of each code at the highest order given, backing off order by order."""
    if not levels:
        return np.full(len(codes), -np.log10(64))
    level, order = levels[-1], len(levels)
    out = np.empty(len(codes))
    at, found = _find(level.codes, codes)
    out[found] = level.logp[at[found]]
    rest = ~found
    if rest.any():
        own = codes[rest]
        ctx, known = _find(level.contexts, own >> 6)
        weight = np.where(known, level.backoff[ctx], 0.0) if len(level.contexts) else 0.0
        out[rest] = weight + score(levels[:-1], own & ((1 << 6 * (order - 1)) - 1))
    return out


@dataclass
class Models:
    """The model of all languages, and of each language its own with its weight."""

    whole: list[Level]
    own: dict[str | None, tuple[list[Level], float]]

    def score(self, lang: str | None, codes: np.ndarray) -> np.ndarray:
        whole = score(self.whole, codes)
        if lang not in self.own:
            return whole
        levels, weight = self.own[lang]
        return np.log10(weight * 10 ** score(levels, codes) + (1 - weight) * 10 ** whole)


def fit(docs: DataFrame, text: str = "text") -> list[Level]:
    """The model of all languages."""
    return fit_languages(docs.select(text, F.lit(None).cast("string").alias("lang")), text).whole


def _levels(table: pa.Table) -> pa.Table:
    """The levels of one model from its counts, as a row of packed arrays each."""
    codes, counts = (table.column(c).to_numpy() for c in ("code", "n"))
    order = np.argsort(codes)
    levels = build(codes[order], counts[order])
    head = {c: [table.column(c)[0].as_py()] * ORDER for c in ("whole", "lang")}
    return pa.table({
        **head, "level": list(range(ORDER)), "n": [int(counts.sum())] * ORDER,
        "codes": [v.codes.astype(np.int32).tobytes() for v in levels], "logp": [v.logp.tobytes() for v in levels],
        "contexts": [v.contexts.astype(np.int32).tobytes() for v in levels], "backoff": [v.backoff.tobytes() for v in levels],
    }, schema=pa.schema([("whole", pa.bool_()), ("lang", pa.string()), ("level", pa.int32()), ("n", pa.int64()), *[
        (c, pa.binary()) for c in ("codes", "logp", "contexts", "backoff")]]))


def fit_languages(docs: DataFrame, text: str = "text", lang: str = "lang") -> Models:
    """A model is built in a task of its own; its size is that of the spelling of a language.  The driver gets packed arrays."""
    own = pin(count_grams(docs, text, lang)).select(F.lit(False).alias("whole"), "lang", "code", "n")
    every = own.groupBy("code").agg(F.sum("n").alias("n")).select(
        F.lit(True).alias("whole"), F.lit(None).cast("string").alias("lang"), "code", "n")
    packed = own.unionByName(every).groupBy("whole", "lang").applyInArrow(
        _levels, "whole boolean, lang string, level int, n long, codes binary, logp binary, contexts binary, backoff binary").toArrow()
    models, sizes = {}, {}
    for r in sorted(packed.to_pylist(), key=lambda r: r["level"]):
        key = r["whole"], r["lang"]
        models.setdefault(key, []).append(Level(
            np.frombuffer(r["codes"], np.int32), np.frombuffer(r["logp"]),
            np.frombuffer(r["contexts"], np.int32), np.frombuffer(r["backoff"])))
        sizes[key] = r["n"]
    return Models(models.get((True, None), []), {
        name: (levels, sizes[whole, name] / (sizes[whole, name] + OWN_WEIGHT))
        for (whole, name), levels in models.items() if not whole})


def base_counts(block: B.Block, words: B.Words) -> dict[str, np.ndarray]:
    """``word_chars, n_symbols, n_dup_lines, n_repeat_words`` of each text."""
    data, n = block.data, len(block)
    inner = ~SPACE_OR_CONTINUATION[data]
    out = {
        "word_chars": B.doc_sums(inner.astype(np.int64), block.offsets),
        "n_symbols": B.doc_sums(SYMBOLS[data].astype(np.int64), block.offsets)}
    # lines: a text's line ends at \n or at the end of the text
    ends = data == 0x0A
    line_ends = np.union1d(np.flatnonzero(ends), block.offsets[1:]).astype(np.int64)
    line_starts = np.concatenate([[0], line_ends[:-1] + ends[np.minimum(line_ends[:-1], max(len(data) - 1, 0))]]) \
        if len(data) else np.zeros(len(line_ends), np.int64)
    doc = np.searchsorted(block.offsets, line_starts, "right") - 1
    has_word = np.concatenate([[0], np.cumsum(~B.SPACE[data])])
    real = (line_ends > line_starts) & (has_word[line_ends] > has_word[np.minimum(line_starts, len(data))])
    doc, h = doc[real], B.span_hashes(data, line_starts[real], line_ends[real])
    distinct = np.unique(B.mix(h + doc.astype(B.U) * B.U(0x9E3779B97F4A7C15)), return_index=True)[1]
    out["n_dup_lines"] = np.bincount(doc, minlength=n) - np.bincount(doc[distinct], minlength=n)
    # words in windows that occur twice or more in their text
    win, at = B.windows(block.word_hashes(words, lower=False), words.at, WINDOW)
    owner = np.repeat(np.arange(n), np.diff(at))
    _, inverse, often = np.unique(
        B.mix(win + owner.astype(B.U) * B.U(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    twice = often[inverse] >= 2
    first = (np.arange(len(win)) - np.repeat(at[:-1] - words.at[:-1], np.diff(at)))[twice]
    cover = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + WINDOW, -1)
    out["n_repeat_words"] = B.doc_sums((np.cumsum(cover)[:-1] > 0).astype(np.int64), words.at)
    return out


SPACE_OR_CONTINUATION = B.SPACE.copy()
SPACE_OR_CONTINUATION[0x80:0xC0] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(
    docs: DataFrame, levels: Models | list[Level], id: str = "doc_id", text: str = "text", lang: str = "lang",
) -> DataFrame:
    """``id, lang``, the base counts, ``n_kinds`` (distinct words), ``n_grams`` and ``neg_logp`` (per symbol; null
    without words).  A mere list of levels is used for every language."""
    given = levels if isinstance(levels, Models) else Models(levels, {})
    # sent to every task: single precision is far finer than the bins of the figures
    models = Models(_single(given.whole), {k: (_single(own), weight) for k, (own, weight) in given.own.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = pa.compute.dictionary_encode(batch.column(1), null_encoding="encode")
            names, numbers = kinds.dictionary.to_pylist(), kinds.indices.to_numpy()
            for block in B.blocks(batch.column(2)):
                words = block.words()
                code, to = grams(block, words)
                keys, inverse = np.unique(by_language(code, to, numbers[block.first:block.last]), return_inverse=True)
                edges = np.searchsorted(keys, np.arange(len(names) + 1) << CODE_BITS)
                logp = np.zeros(len(keys))
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    if b > a:
                        logp[a:b] = models.score(names[k], keys[a:b] & ((1 << CODE_BITS) - 1))
                total, n = B.doc_sums(logp[inverse], to), np.diff(to)
                doc = words.doc
                kinds_at = np.unique(B.mix(
                    block.word_hashes(words) + doc.astype(B.U) * B.U(0x9E3779B97F4A7C15)), return_index=True)[1]
                base = {"n_words": words.counts} | base_counts(block, words) | {
                    "n_kinds": np.bincount(doc[kinds_at], minlength=len(block))}
                with np.errstate(invalid="ignore"):
                    mean = -total / n
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(block.first, len(block)) for k in (0, 1)]
                    + [pa.array(base[c].astype(np.int64)) for c in (*COUNTS, "n_kinds")]
                    + [pa.array(n.astype(np.int64)), pa.array(mean, mask=n == 0)],
                    names=["id", "lang", *COUNTS, "n_kinds", "n_grams", "neg_logp"])

    frame = docs.select(F.col(id).alias("id"), F.col(lang).cast("string").alias("lang"), text)
    kind = frame.schema["id"].dataType.simpleString()
    return frame.mapInArrow(
        run, f"id {kind}, lang string, " + ", ".join(f"{c} long" for c in COUNTS)
        + ", n_kinds long, n_grams long, neg_logp double")


def bands(measured: DataFrame, figure: str) -> DataFrame:
    """``lang, q1, q3`` of a column, exact over bins: the language's median and, from there, its quartiles shrunk towards
    those of all documents by ``SHRINK`` documents."""
    # the number of bins is bounded by the range of the figure over BIN
    bins = measured.where(f"n_words >= {LEAST_WORDS}").select("lang", F.floor(F.col(figure) / BIN).alias("bin")).groupBy(
        "lang", "bin").agg(F.count(F.lit(1)).alias("n"))

    def reached(rows: DataFrame, keys: list[str], **shares: float) -> DataFrame:
        """The first bins at which the shares of the rows are reached, and the number of rows."""
        upto = rows.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))).withColumn(
            "total", F.sum("n").over(Window.partitionBy(*keys)))
        return upto.groupBy(*keys).agg(F.max("total").alias("total"), *[
            F.min(F.when(F.col("upto") >= F.col("total") * share, F.col("bin"))).alias(name) for name, share in shares.items()])

    own = reached(bins, ["lang"], mid=0.5, q1=0.25, q3=0.75).withColumnRenamed("lang", "_lang")
    apart = bins.join(own.select("_lang", "mid"), F.col("lang").eqNullSafe(F.col("_lang"))).groupBy(
        (F.col("bin") - F.col("mid")).alias("bin")).agg(F.sum("n").alias("n"))
    whole = reached(apart.withColumn("one", F.lit(1)), ["one"], all1=0.25, all3=0.75).select("all1", "all3")

    def shrunk(own: str, all_: str) -> Column:
        return F.col("mid") + (F.col("total") * (F.col(own) - F.col("mid")) + SHRINK * F.col(all_)) / (F.col("total") + SHRINK)

    return own.crossJoin(F.broadcast(whole)).select(  # one row
        "_lang", (shrunk("q1", "all1") * BIN).alias("q1"), ((shrunk("q3", "all3") + 1) * BIN).alias("q3"))


def judge(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Base counts, ``neg_logp``, its limits, ``variety``, its limit, ``base_failed`` and ``kept``, one row per document."""
    measured = pin(measure(docs, fit_languages(docs, text, lang), id, text, lang))
    x, y = F.log(F.col("n_words")), F.log(F.col("n_kinds"))
    line = measured.where(f"n_words >= {LEAST_WORDS}").agg(F.regr_slope(y, x), F.regr_intercept(y, x)).first()
    # texts of one length only have no slope
    slope, start = (line[0], line[1]) if line[0] is not None else (1.0, 0.0)
    m = measured.withColumn("variety", y - F.lit(slope) * x - F.lit(start))
    figure = pin(bands(m, "neg_logp"))
    kinds = pin(bands(m, "variety")).select(F.col("_lang").alias("_lang2"), F.col("q1").alias("k1"), F.col("q3").alias("k3"))
    m = m.join(figure, F.col("lang").eqNullSafe(F.col("_lang")), "left").join(
        kinds, F.col("lang").eqNullSafe(F.col("_lang2")), "left")
    room = WIDEN / F.sqrt(F.greatest(F.col("n_grams"), F.lit(1)))
    low = F.col("q1") - SPREAD * (F.col("q3") - F.col("q1"))
    high = F.col("q3") + SPREAD * (F.col("q3") - F.col("q1"))
    least = F.col("k1") - VARIETY_SPREAD * (F.col("k3") - F.col("k1"))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEATED_PERCENT)
    inside = F.coalesce(F.col("neg_logp").between(low - room, high + room), F.lit(True)) & F.coalesce(
        F.col("variety") >= least - VARIETY_WIDEN / F.sqrt(F.greatest(F.col("n_words"), F.lit(1))), F.lit(True))
    return m.select(
        F.col("id").alias(id), "lang", *COUNTS, "neg_logp", low.alias("low"), high.alias("high"), "variety",
        least.alias("least_variety"), failed.alias("base_failed"), (~failed & inside).alias("kept"))
