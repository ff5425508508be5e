"""Language identification by Bayesian evidence fusion.

The posterior of a language adds four log evidences: the text (byte trigrams of letters, a multinomial model per language,
tempered because trigrams overlap), the declared language, the address suffix, and a prior of the host.  The
trigram counts, the tables of declared language and suffix per language, and the host priors are grouped aggregates over
all rows; host priors are smoothed towards the registered domain, and that towards the whole.

A text is cut into equal segments of at most ``SEGMENT`` trigrams.  A segment supports a language unless its log likelihood per
trigram lies below the language's floor (gibberish, languages without a model) or another language, or the background of
all languages together, beats it clearly (mixed texts).  The floor is what the counts of all documents of the language lead to expect, each trigram left out of its own
count, less ``FLOOR`` standard deviations; it is lower for short segments.

A document is rejected if its text has fewer than ``LEAST_GRAMS`` trigrams, if the posterior of its best language is
below ``LEAST_POSTERIOR``, if segments with less than ``LEAST_SUPPORT`` of its trigrams support that language, or if it is not
among the wanted ones.  Texts are read whole.

Cases: a null or empty text has no text evidence: the other evidence still gives a language, and it is rejected; nulls or
unseen values of declaration, suffix or host add no evidence of their own; repeated rows are judged alike; ties go to
the language first by code point; without any training language the language is null and all are rejected; an empty
table gives an empty result.  Columns of the input pass through, but for those named like the result's.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import blocks as B
from plumbline.operators.joins import small_side
from plumbline.session import pin

BITS = 15
#: Share of the trigrams' log likelihood that counts: overlapping trigrams repeat each other.
TEMPER = 0.25
LEAST_GRAMS = 1
LEAST_POSTERIOR = 0.6
SEGMENT = 32
#: Overlapping trigrams vary together: the variance of a sum is this many times that of as many single ones.
OVERLAP = 3.0
FLOOR = 4.0
#: A segment's language is beaten where another one's tempered log likelihood is higher by this.
BEATEN = float(np.log(10))
LEAST_SUPPORT = 0.6
#: Pseudo-counts of the host prior, the domain prior, and the tables of declarations and suffixes.
HOST_WEIGHT, DOMAIN_WEIGHT, TABLE_WEIGHT = 20.0, 50.0, 1.0
RESULT = ("language", "posterior", "text_language", "accepted")

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTERS[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTERS[128:] = np.arange(128, 256)


def trigrams(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of letters and word bounds, and their bounds per text; runs of other bytes count once."""
    data = _LETTERS[block.data]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20)
    edges = block.offsets[:-1]
    keep[edges[edges < len(data)]] = True
    to = np.concatenate([[0], np.cumsum(keep)])
    data, at = data[keep].astype(np.uint32), to[block.offsets]
    counts = np.maximum(np.diff(at) - 2, 0)
    out = np.concatenate([[0], np.cumsum(counts)])
    first = np.repeat(at[:-1] - out[:-1], counts) + np.arange(out[-1])
    code = (data[first] << 16) | (data[first + 1] << 8) | data[first + 2]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32), out


@dataclass
class TextModel:
    """log P(bucket | language), (2 ** BITS, languages), that of all languages together, and mean and deviation of a trigram
    of the language; bounded by the number of languages."""

    languages: list[str]
    logp: np.ndarray
    background: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray

    def scores(self, block: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihood of each text for each language, its number of trigrams, and how many support the language."""
        slots, at = trigrams(block)
        grams = np.diff(at)
        if not self.languages:
            return np.zeros((len(block), 0)), grams, np.zeros((len(block), 0))
        parts = -(-grams // SEGMENT)
        to = np.concatenate([[0], np.cumsum(parts)])
        doc = np.repeat(np.arange(len(block)), parts)
        bounds = np.append(at[doc] + (np.arange(to[-1]) - to[doc]) * grams[doc] // parts[doc], len(slots))
        length = np.diff(bounds)
        like = np.stack([B.doc_sums(self.logp[slots, k].astype(np.float64), bounds) for k in range(len(self.languages))], 1)
        floor = self.mean - FLOOR * self.deviation * np.sqrt(OVERLAP / length)[:, None]
        best = np.maximum(like.max(1), B.doc_sums(self.background[slots].astype(np.float64), bounds))
        good = (like >= floor * length[:, None]) & (TEMPER * (best[:, None] - like) <= BEATEN)
        per_text = [np.stack([B.doc_sums(v[:, k], to) for k in range(len(self.languages))], 1) for v in (like, good * length[:, None])]
        return per_text[0], grams, per_text[1]


def fit_text(docs: DataFrame, text: str = "text", lang: str = "lang") -> TextModel:
    """Trigram counts of each declared language over all documents, summed per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for block in B.blocks(batch.column(0)):
                slots, at = trigrams(block)
                own = langs[block.first:block.last]
                for name in set(own.tolist()):
                    mine = np.repeat(own == name, np.diff(at))
                    n = np.bincount(slots[mine], minlength=1 << BITS)
                    sums[name] = sums[name] + n if name in sums else n
        for name, n in sums.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(n[seen], pa.int64())],
                names=["lang", "slot", "n"])

    counted = docs.where(F.col(lang).isNotNull()).select(F.col(text), F.col(lang).cast("string")).mapInArrow(
        run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    table = counted.toPandas()  # at most 2 ** BITS rows a language
    languages = sorted(table["lang"].unique().tolist())
    counts = np.zeros((1 << BITS, len(languages)))
    for k, name in enumerate(languages):
        own = table[table["lang"] == name]
        counts[own["slot"].to_numpy(), k] += own["n"].to_numpy()
    return smoothed(languages, counts)


def smoothed(languages: list[str], counts: np.ndarray) -> TextModel:
    """Each language smoothed towards all of them by the weight of its distinct trigrams, so that few documents say little."""
    if not languages:
        return TextModel(languages, counts, np.zeros(len(counts)), np.zeros(0), np.zeros(0))
    all_, slots = counts.sum(1, keepdims=True), len(counts)
    n, kinds = counts.sum(0), (counts > 0).sum(0)
    pool = (all_ + 0.5) / (all_.sum() + slots / 2)
    logp, background = np.log((counts + kinds * pool) / (n + kinds)), np.log(pool[:, 0])
    rest = np.maximum(counts - 1, 0)  # a trigram as the others foretell it
    pool = (np.maximum(all_ - 1, 0) + 0.5) / (all_.sum() + slots / 2)
    left_out = np.log((rest + kinds * pool) / (n - 1 + kinds))
    mean = (counts * left_out).sum(0) / n
    deviation = np.sqrt((counts * (left_out - mean) ** 2).sum(0) / n)
    return TextModel(languages, logp.astype(np.float32), background.astype(np.float32), mean, deviation)


def domain(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def identify(
    docs: DataFrame, model: TextModel, declared: Column, suffix: Column, host: Column, text: Column,
    wanted: Sequence[str] | None = None,
) -> DataFrame:
    """All rows and columns with ``language, posterior, text_language, accepted``."""
    kept = [c for c in docs.columns if c not in RESULT]
    languages, n = model.languages, len(model.languages)

    @F.arrow_udf("struct<like:array<double>,grams:bigint,support:array<double>>")
    def evidence_of(texts: pa.Array) -> pa.Array:
        got = [model.scores(b) for b in B.blocks(texts)]
        grams = np.concatenate([g[1] for g in got]) if got else np.zeros(0)

        def lists(part: int) -> pa.Array:
            rows = np.concatenate([g[part] for g in got]) if got else np.zeros((0, n))
            return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel().astype(np.float64)), n).cast(pa.list_(pa.float64()))

        return pa.StructArray.from_arrays([lists(0), pa.array(grams.astype(np.int64)), lists(2)], names=["like", "grams", "support"])

    if not n:
        return docs.select(*kept, F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("posterior"),
                           F.lit(None).cast("string").alias("text_language"), F.lit(False).alias("accepted"))
    names = F.array(*[F.lit(x) for x in languages])
    best = F.when(F.col("_grams") > 0, F.array_position("_text", F.array_max("_text")).cast("int"))
    scored = docs.select(
        F.struct(*kept).alias("_row"), evidence_of(text).alias("_e"), F.lower(declared.cast("string")).alias("_declared"),
        F.lower(suffix).alias("_suffix"), F.lower(host).alias("_host"))
    scored = scored.select(
        "*", F.col("_e.like").alias("_text"), F.col("_e.grams").alias("_grams"),
        F.col("_e.support").alias("_support")).withColumn("_best", best)
    # what the text says, counted by host, declaration and suffix: one aggregate, few rows
    seen = pin(scored.where("_best IS NOT NULL").groupBy("_host", "_declared", "_suffix", "_best").agg(
        F.count(F.lit(1)).alias("n")))

    def by(key: Column, name: str) -> DataFrame:
        """Counts per language of each value of ``key`` as one array."""
        rows = seen.where(key.isNotNull()).groupBy(key.alias(name))
        return rows.agg(F.array(*[
            F.sum(F.when(F.col("_best") == k + 1, F.col("n")).otherwise(0)) for k in range(n)]).alias(f"n{name}"))

    total = seen.agg(*[F.sum(F.when(F.col("_best") == k + 1, F.col("n")).otherwise(0)) for k in range(n)]).first()
    overall = np.array([v or 0 for v in total], float)
    whole = ((overall + 1) / (overall + 1).sum()).tolist()

    def table(key: str) -> DataFrame:
        """log P(value | language), with ``TABLE_WEIGHT`` spread over the values."""
        counts = by(F.col(key), key)
        values = counts.count()  # declared languages or suffixes
        return counts.select(key, F.array(*[
            F.log((F.col(f"n{key}")[k] + TABLE_WEIGHT / max(values, 1)) / (overall[k] + TABLE_WEIGHT))
            for k in range(n)]).alias(f"l{key}"))

    hosts = by(F.col("_host"), "_host").withColumn("_domain", domain(F.col("_host")))
    domains = by(domain(F.col("_host")), "_domain")
    sums = F.aggregate("n_domain", F.lit(0.0), lambda a, x: a + x)
    domains = domains.select("_domain", F.array(*[
        (F.col("n_domain")[k] + DOMAIN_WEIGHT * whole[k]) / (sums + DOMAIN_WEIGHT) for k in range(n)]).alias("_p"))
    of_host = F.aggregate("n_host", F.lit(0.0), lambda a, x: a + x)
    priors = hosts.join(domains, "_domain").select("_host", F.array(*[
        F.log((F.col("n_host")[k] + HOST_WEIGHT * F.col("_p")[k]) / (of_host + HOST_WEIGHT)) for k in range(n)]).alias("l_host"))

    def fused(evidence: DataFrame) -> DataFrame:
        sums = [F.col("_text")[k] * TEMPER + F.coalesce(F.col("l_declared")[k], F.lit(0.0))
                + F.coalesce(F.col("l_suffix")[k], F.lit(0.0))
                + F.coalesce(F.col("l_host")[k], F.lit(float(np.log(whole[k])))) for k in range(n)]
        out = evidence.withColumn("_sum", F.array(*sums)).withColumn("_top", F.array_max("_sum"))
        out = out.withColumn("_at", F.array_position("_sum", F.col("_top")).cast("int") - 1).withColumn(
            "language", F.get(names, F.col("_at"))).withColumn(
            "posterior", 1 / F.aggregate("_sum", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top"))))
        good = (F.col("_grams") >= LEAST_GRAMS) & (F.col("posterior") >= LEAST_POSTERIOR) & (
            F.get("_support", F.col("_at")) >= LEAST_SUPPORT * F.col("_grams"))
        if wanted is not None:
            good &= F.col("language").isin(*wanted)
        return out.select("_row.*", "language", "posterior", F.get(names, F.col("_best") - 1).alias("text_language"),
                          F.coalesce(good, F.lit(False)).alias("accepted"))

    # tables of values: broadcast where their rows were counted small, so that the texts are not shuffled; else joined by key
    evidence = scored.join(small_side(table("_declared")), "_declared", "left").join(
        small_side(table("_suffix")), "_suffix", "left").join(small_side(priors), "_host", "left")
    return fused(evidence)


def page_text(html: Column) -> Column:
    """Visible text of a page: without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(bare, r"&#?\w{1,10};", " ")


def identify_pages(pages: DataFrame, model: TextModel, wanted: Sequence[str] | None = None) -> DataFrame:
    """Pages ``(page_id, url, html)``: markup language, top-level suffix and host as further evidence."""
    declared = F.nullif(F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", 1), F.lit(""))
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    return identify(pages, model, declared, F.substring_index(host, ".", -1), host, page_text(F.col("html")), wanted)


def identify_documents(docs: DataFrame, model: TextModel, wanted: Sequence[str] | None = None) -> DataFrame:
    """Documents: the declared language is ``lang``, the host is ``source``, and there is no address."""
    return identify(docs, model, F.col("lang"), F.lit(None).cast("string"), F.col("source"), F.col("text"), wanted)
