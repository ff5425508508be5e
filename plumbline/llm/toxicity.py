"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Words are read with the obfuscation undone: letters only, lower case, digits and signs that stand for letters
replaced.  The lexicon holds the words whose document frequency among toxic training rows stands out, with their
log-odds as weights.  Features: densities of strong and weak lexicon words, lexicon words near a
second-person word, shares of capitals, punctuation, signs and digits, obfuscated words, length.  The lexicon, the
trees and the calibration come from one bounded sample of labelled rows outside the held-out fold; trees
and calibration from different rows of it.  All documents are then scored in one pass, whole.

Cases: a null or empty text has all-zero densities and gets a score like any other; repeated rows score alike;
without labelled rows of both classes the score is the share of label 1 (0 without any); an empty table gives
an empty result.  Columns of the input pass through, but for those named like the result's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import blocks as B
from plumbline.llm import boosting, training

SAMPLE = 10_000
FOLDS, HELD = 4, 2
ACCEPT = 0.3
LEXICON = 400
LEAST_DOCS = 3
STRONG, WEAK = 2.0, 0.7
NEAR = 5
#: Second-person words of the supported languages.
SECOND_PERSON = ("you your yours yourself u du dich dir dein deine ihr euch euer tu toi te vous votre vos ton ta tes "
                 "tú ti tu tus usted ustedes vosotros vuestro").split()
#: Signs read as letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
NAMES = ("strong_share strong_log weak_share heaviest weight_share near_second second_share capitals capital_words "
         "exclaim question punctuation signs digits obfuscated obfuscated_hits log_words").split()

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A"):ord("Z") + 1] = True
_READ = B.LOWER.copy()
for _sign, _letter in LEET.items():
    _READ[ord(_sign)] = ord(_letter)
_KEEP = _LETTER.copy()
_KEEP[[ord(c) for c in LEET]] = True


def _set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_EXCLAIM, _QUESTION, _PUNCT, _SIGNS, _DIGIT = _set("!"), _set("?"), _set(".,;:-'\"()"), _set("#*$%&|<>@_~^"), _set("0123456789")


def read_words(block: B.Block) -> tuple[B.Words, np.ndarray, np.ndarray]:
    """Words, their hashes with the obfuscation undone, and which had signs or digits inside."""
    words = block.words()
    keep = _KEEP[block.data]
    to = np.concatenate([[0], np.cumsum(keep)])
    h = B.span_hashes(_READ[block.data[keep]], to[words.starts], to[words.ends])
    letter = np.concatenate([[0], np.cumsum(_LETTER[block.data])])
    letters = letter[words.ends] - letter[words.starts]
    # an odd sign inside: the first and last bytes are letters, not all between are
    odd = (letters < words.ends - words.starts) & (letters >= 2)
    if len(words.starts):
        odd &= _LETTER[block.data[words.starts]] & _LETTER[block.data[words.ends - 1]]
    return words, h, odd


def hash_words(words: list[str]) -> np.ndarray:
    raw = [w.lower().encode() for w in words]
    ends = np.cumsum([len(r) for r in raw])
    return B.span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in B.blocks(batch.column(0)):
            words, h, _ = read_words(block)
            rows = [np.unique(h[a:b]).tobytes() for a, b in zip(words.at[:-1], words.at[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.binary()), batch.column(1).slice(block.first, len(block))], names=["words", "label"])


@dataclass
class Lexicon:
    """Sorted word hashes and their weights, at most ``LEXICON``."""

    hashes: np.ndarray
    weights: np.ndarray

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.weights[at], 0.0)


def build_lexicon(sample: DataFrame) -> Lexicon:
    rows = sample.select("text", "label").mapInArrow(_bags, "words binary, label int").collect()  # bounded sample
    sets = {k: [np.frombuffer(r["words"], B.U) for r in rows if r["label"] == k] for k in (0, 1)}
    if not sets[0] or not sets[1]:
        return Lexicon(np.zeros(0, B.U), np.zeros(0))
    h1, n1 = np.unique(np.concatenate(sets[1]), return_counts=True)
    h0, n0 = np.unique(np.concatenate(sets[0]), return_counts=True)
    at = np.minimum(np.searchsorted(h0, h1), max(len(h0) - 1, 0))
    other = np.where(h0[at] == h1, n0[at], 0) if len(h0) else np.zeros(len(h1))
    odds = np.log((n1 + 0.5) / (len(sets[1]) + 1)) - np.log((other + 0.5) / (len(sets[0]) + 1))
    sure = odds / np.sqrt(1 / (n1 + 0.5) + 1 / (other + 0.5))
    good = np.flatnonzero((n1 >= LEAST_DOCS) & (odds > WEAK) & (sure > 2))
    good = good[np.lexsort((h1[good], -sure[good]))][:LEXICON]
    good = good[np.argsort(h1[good])]
    return Lexicon(h1[good], odds[good])


def features(block: B.Block, lexicon: Lexicon) -> np.ndarray:
    """One row of ``NAMES`` per text."""
    words, h, odd = read_words(block)
    n = np.maximum(words.counts, 1)
    size = np.maximum(np.diff(block.offsets), 1)
    weight = lexicon.of(h)
    strong, weak = weight >= STRONG, (weight > 0) & (weight < STRONG)
    you = np.isin(h, hash_words(SECOND_PERSON))
    doc = words.doc
    seen = np.concatenate([[0], np.cumsum(you)])
    low = np.maximum(words.at[doc], np.arange(len(h)) - NEAR)
    high = np.minimum(words.at[doc + 1], np.arange(len(h)) + NEAR + 1)
    near = strong & (seen[high] > seen[low])
    upper = np.concatenate([[0], np.cumsum(_UPPER[block.data])])
    shout = (upper[words.ends] - upper[words.starts] >= 2) & (words.ends - words.starts >= 2)
    heaviest = np.zeros(len(block))
    np.maximum.at(heaviest, doc[weight > 0], weight[weight > 0])

    def per(flags: np.ndarray) -> np.ndarray:
        return B.doc_sums(flags.astype(np.float64), words.at)

    def share(chars: np.ndarray) -> np.ndarray:
        return B.doc_sums(chars[block.data].astype(np.float64), block.offsets) / size

    return np.stack([
        per(strong) / n, np.log1p(per(strong)), per(weak) / n, heaviest, per(weight) / n, np.log1p(per(near)), per(you) / n,
        share(_UPPER), per(shout) / n, share(_EXCLAIM), share(_QUESTION), share(_PUNCT), share(_SIGNS),
        share(_DIGIT), per(odd) / n, np.log1p(per(odd & (weight > 0))), np.log1p(words.counts)], 1)


@dataclass
class Model:
    lexicon: Lexicon
    trees: boosting.Trees | None
    knots: np.ndarray
    levels: np.ndarray
    constant: float = 0.0

    def scores(self, block: B.Block) -> np.ndarray:
        if self.trees is None:
            return np.full(len(block), self.constant)
        return np.interp(self.trees.raw(features(block, self.lexicon)), self.knots, self.levels)


def train(sample: DataFrame) -> Model:
    lexicon = build_lexicon(sample)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(b, lexicon) for b in B.blocks(batch.column(1))]
            x = np.concatenate(got) if got else np.zeros((0, len(NAMES)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(x), pa.list_(pa.float64())), batch.column(2)], names=["doc_id", "x", "label"])

    got = sorted(sample.select("doc_id", "text", "label").mapInArrow(
        rows, "doc_id long, x array<double>, label int").collect(), key=lambda r: r["doc_id"])  # bounded sample
    y = np.array([r["label"] for r in got], np.float64)
    if len(set(y.tolist())) < 2:
        return Model(lexicon, None, np.zeros(1), np.zeros(1), float(y.mean()) if len(y) else 0.0)
    x = np.array([r["x"] for r in got])
    aside = np.arange(len(y)) % 4 == 3
    if len(set(y[aside].tolist())) < 2 or len(set(y[~aside].tolist())) < 2:
        aside = np.zeros(len(y), bool)
    trees = boosting.fit(x[~aside], y[~aside])
    check = aside if aside.any() else ~aside
    knots, levels = boosting.isotonic(trees.raw(x[check]), y[check])
    return Model(lexicon, trees, knots, levels)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns with ``score`` and ``predicted``."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    place = kept.index(text)
    schema = docs.select(*kept).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.scores(b) for b in B.blocks(batch.column(place))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(got) if got else np.zeros(0))], names=[*kept, "score"])

    return docs.select(*kept).mapInArrow(run, schema).withColumn(
        "predicted", (F.col("score") >= ACCEPT).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    model = train(training.labelled_sample(docs, labels, "toxic", FOLDS, HELD, sample))
    return score(docs, model).withColumn("held_out", training.held_out("doc_id", FOLDS, HELD))
