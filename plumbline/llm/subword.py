"""Quality classifier: supervised subword embeddings.

A document is a bag of hashed features: words, word pairs, and byte n-grams of the raw text, upper and lower
case kept, plus one constant feature.  Each feature hashes to a row of a learned embedding table; the rows are averaged and
a softmax over two outputs follows.  Training is plain stochastic gradient descent in numpy over a bounded
sample whose features are computed on the executors.  Because the output is linear in the average, scoring
needs one number per feature, ``(w1 - w0) . e``, and reads every document once, whole.

Cases: a null or empty text has the constant feature only and gets its score; very long texts are read
whole; repeated rows get equal scores; without labelled rows of both classes the score is the share of label 1
(0.5 without any); an empty table gives an empty result.  Columns of the input pass through, but for those
named like the result's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import blocks as B
from plumbline.llm import training

BUCKET_BITS = 18
DIM = 8
GRAMS = (3, 5)
SAMPLE = 4000
EPOCHS = 12
RATE = 4.0
BATCH = 16
FOLDS, HELD = 5, 0
ACCEPT = 0.3
#: Texts of a block are short enough for its n-gram arrays to stay small.
_BYTES = 1 << 19


def feature_slots(block: B.Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Kinds of features one after the other: their buckets in text order, and the bounds per text."""
    shift = B.U(64 - BUCKET_BITS)
    words = block.words()
    h = block.word_hashes(words, lower=False)
    yield (h >> shift).astype(np.int32), words.at
    pairs, at = B.windows(h, words.at, 2)
    first = np.repeat(words.at[:-1] - at[:-1], np.diff(at)) + np.arange(at[-1])
    # a word said twice in a row is one feature, whatever the word
    yield np.where(h[first] == h[first + 1], 2, pairs >> shift).astype(np.int32), at
    sums = B.prefix_sums(block.data)
    for n in GRAMS:
        counts = np.maximum(np.diff(block.offsets) - n + 1, 0)
        to = np.concatenate([[0], np.cumsum(counts)])
        starts = np.repeat(block.offsets[:-1] - to[:-1], counts) + np.arange(to[-1])
        yield (B.spans_of(sums, starts, starts + n) >> shift).astype(np.int32), to
    n = len(block)
    yield np.full(n, 1, np.int32), np.arange(n + 1)


@dataclass
class Model:
    """Score of each bucket; ``slots`` is bounded by 2 ** BUCKET_BITS numbers."""

    slots: np.ndarray
    constant: float | None = None

    def scores(self, block: B.Block) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(block), self.constant)
        total, count = np.zeros(len(block)), np.zeros(len(block))
        for slots, at in feature_slots(block):
            total += B.doc_sums(self.slots[slots].astype(np.float64), at)
            count += np.diff(at)
        return 1 / (1 + np.exp(-np.clip(total / count, -40, 40)))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct buckets of each text and their counts, as bytes."""
    for batch in batches:
        for block in B.blocks(batch.column(1), _BYTES):
            kinds = list(feature_slots(block))
            rows = []
            for d in range(len(block)):
                slots, n = np.unique(
                    np.concatenate([s[at[d]:at[d + 1]] for s, at in kinds]), return_counts=True)
                rows.append((slots.astype("<i4").tobytes(), n.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(block.first, len(block)), pa.array([r[0] for r in rows], pa.binary()),
                 pa.array([r[1] for r in rows], pa.binary()), batch.column(2).slice(block.first, len(block))],
                names=["doc_id", "slots", "counts", "label"])


def _descend(rows: list[tuple], epochs: int, rate: float, dim: int) -> Model:
    """Stochastic gradient descent over bags ``(id, slots, counts, label)`` in the order of their ids."""
    rows = sorted(rows, key=lambda r: r[0])
    y = np.array([r[3] for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(0, np.float32), float(y.mean()) if len(y) else 0.5)
    slots = [np.frombuffer(r[1], "<i4") for r in rows]
    counts = [np.frombuffer(r[2], "<u4") for r in rows]
    rng = np.random.default_rng(7)
    table = rng.uniform(-1 / dim, 1 / dim, (1 << BUCKET_BITS, dim)).astype(np.float32)
    out = np.zeros((2, dim), np.float32)
    steps, step = epochs * math.ceil(len(rows) / BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for low in range(0, len(rows), BATCH):
            own = order[low:low + BATCH]
            lr = rate * (1 - step / steps)
            step += 1
            at = np.concatenate([[0], np.cumsum([len(slots[i]) for i in own])])
            idx = np.concatenate([slots[i] for i in own])
            w = np.concatenate([counts[i] / counts[i].sum() for i in own]).astype(np.float32)
            hidden = np.add.reduceat(table[idx] * w[:, None], at[:-1], axis=0)
            logits = hidden @ out.T
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), y[own].astype(int)] -= 1
            back = p @ out
            out -= lr / BATCH * (p.T @ hidden)
            change = -lr * np.repeat(back, np.diff(at), axis=0) * w[:, None]
            by_slot = np.argsort(idx, kind="stable")
            distinct, first = np.unique(idx[by_slot], return_index=True)
            table[distinct] += np.add.reduceat(change[by_slot], first, axis=0)
    return Model((table @ (out[1] - out[0])).astype(np.float32))


def train(sample: DataFrame, epochs: int = EPOCHS, rate: float = RATE, dim: int = DIM) -> Model:
    """Fit on ``(doc_id, text, label)``, a sample of bounded size; one task descends, the driver gets the scores of the
    buckets only."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []  # views of the Arrow buffers, not copies
        for batch in batches:
            ids, slots, counts, labels = batch.columns
            rows += [(i, a.as_buffer(), b.as_buffer(), y) for i, a, b, y in zip(
                ids.to_pylist(), slots, counts, labels.to_pylist())]
        model = _descend(rows, epochs, rate, dim)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.slots.tobytes()], pa.binary()), pa.array([model.constant], pa.float64())], names=["slots", "constant"])

    bags = sample.select("doc_id", "text", "label").mapInArrow(
        _bags, "doc_id long, slots binary, counts binary, label int")
    got = bags.repartition(1).mapInArrow(fit, "slots binary, constant double").collect()
    return Model(np.frombuffer(got[0]["slots"], np.float32), got[0]["constant"]) if got else Model(np.zeros(0, np.float32), 0.5)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns with ``score`` and ``predicted``; only the text goes to Python."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        got = [model.scores(b) for b in B.blocks(texts, _BYTES)]
        return pa.array(np.concatenate(got) if got else np.zeros(0))

    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*kept, run(text).alias("score")).withColumn(
        "predicted", (F.col("score") >= ACCEPT).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Train on labelled rows outside the held-out fold and score every document."""
    model = train(training.labelled_sample(docs, labels, "quality", FOLDS, HELD, sample))
    return score(docs, model).withColumn("held_out", training.held_out("doc_id", FOLDS, HELD))
