"""Language-model scoring by Katz backoff over word bigrams.

P(w | h) is the Good-Turing discounted relative frequency where the pair was seen, else the history's backoff weight times
P(w); the weights make each distribution sum to one exactly over the training vocabulary and one unknown word.
P(w) is itself discounted, and what the discounts free goes to the unknown word.

How it is distributed.  Documents are gathered into chunks of about ``CHUNK`` tokens that know each distinct word once.
1. Each chunk sends its distinct words with training counts to hash buckets; a bucket adds the counts of all
   chunks, numbers its words by falling count, and answers each chunk with numbers and counts.
2. Each chunk sends its distinct word pairs with training counts to buckets of the history; a bucket adds the counts, and answers with
   the totals and with what the backoff weight of each history needs.  A history that holds more than a quarter of a
   bucket's even share is spread over all buckets by the whole pair; its sums are few and are added up apart.
3. Each chunk scores its pairs once and adds them up per document.
Everything gathered is a table of compressed arrays, one row per chunk and bucket; the bucket tables (kind ``model``) are the stored model.
The driver sees only counts of counts, totals, and the sums of at most ``4 * buckets`` spread histories.

Cases: a null or empty text is the end token alone; a document whose training flag is null does not train; repeated rows
train and score as separate documents; null ids pass through; long texts are whole; with no training rows every probability is that
of the unknown word (1); an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import blocks as B
from plumbline.llm.packs import pack, unpack
from plumbline.session import pin

CHUNK = 3_000_000
#: Counts above this are not discounted.
TRUSTED = 5
START, END = B.U(1), B.U(2)
ROWS = "kind string, chunk long, bucket int, data binary"
_ROWS = pa.schema([("kind", pa.string()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])


def _table(rows: list[tuple[str, int, int, bytes]]) -> pa.Table:
    kind, chunk, bucket, data = zip(*rows) if rows else ((), (), (), ())
    return pa.table([pa.array(kind, pa.string()), pa.array(chunk, pa.int64()), pa.array(bucket, pa.int32()),
                     pa.array(data, pa.binary())], schema=_ROWS)


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """Katz's factors d_0 .. d_TRUSTED from n_1 .. n_(TRUSTED + 1); (r - 0.5) / r where Good-Turing gives none in (0, 1]."""
    n = np.concatenate([[0.0], counts_of_counts])
    k = TRUSTED
    d = np.ones(k + 1)
    tail = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        own = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
        got = (own - tail) / (1 - tail) if tail < 1 else 0.0
        d[r] = got if 0 < got <= 1 and (r > 1 or got < 1) else (r - 0.5) / r
    return d


@dataclass
class Unigrams:
    """What all tasks need of the lowest order: a handful of numbers."""

    tokens: int
    types: int
    factors: np.ndarray
    total: float  # denominator, one more where no count is discounted
    unknown: float  # probability of the unknown word

    @staticmethod
    def of(tokens: int, types: int, counts_of_counts: np.ndarray) -> Unigrams:
        d = discounts(counts_of_counts)
        freed = float(((1 - d[1:]) * np.arange(1, TRUSTED + 1) * counts_of_counts[:TRUSTED]).sum())
        total = tokens if freed > 0 else tokens + 1
        return Unigrams(tokens, types, d, float(total), (freed if freed > 0 else 1.0) / total)

    def p(self, counts: np.ndarray) -> np.ndarray:
        c = counts.astype(np.float64)
        known = self.factors[np.minimum(counts, TRUSTED).astype(np.int64)]
        known = np.where(counts > TRUSTED, 1.0, known)
        return np.where(c > 0, known * c / self.total, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts.astype(np.float64) + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


def _index(buckets: int):
    """Texts to chunks: a row ``docs`` each, and a row ``words`` for each bucket it needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, ...]] = []

        def close() -> pa.RecordBatch:
            nonlocal made
            ids, nulls, train, n, tokens = (np.concatenate(x) for x in zip(*held))
            words, inverse, often = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")  # small numbers for frequent words
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            words, index = np.append(words[order], START), rank[inverse]
            counts = np.append(np.bincount(index[np.repeat(train, n)], minlength=len(words) - 1), train.sum())
            home = (B.mix(words) % B.U(buckets)).astype(np.int64)
            chunk = (part << 32) + made
            made += 1
            rows = [("docs", chunk, -1, pack(ids.view(B.U), nulls, train, n, index, home))]
            for b in np.unique(home):
                own = home == b
                rows.append(("words", chunk, int(b), pack(words[own], counts[own])))
            held.clear()
            return _table(rows).to_batches()[0]

        for batch in batches:
            ids = batch.column(0)
            nulls = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            train = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
            for block in B.blocks(batch.column(1)):
                words = block.words()
                tokens = np.insert(block.word_hashes(words), words.at[1:], END)
                own = slice(block.first, block.last)
                held.append((ids[own], nulls[own], train[own], words.counts + 1, tokens))
                if sum(len(h[4]) for h in held) >= CHUNK:
                    yield close()
        if held:
            yield close()

    return run


def _number_words(buckets: int):
    """Bucket of words to answers ``ids`` (number and training count of each word asked for) and a row ``stats``."""

    def run(key, rows):
        bucket = key[0].as_py()
        asked = [unpack(d) for d in rows.column("data").to_pylist()]
        words, inverse = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([a[1] for a in asked]), len(words)).astype(np.int64)
        order = np.argsort(-counts, kind="stable")
        number = np.empty(len(words), np.int64)
        number[order] = np.arange(len(words)) * buckets + bucket + 1
        real = (words != START) & (counts > 0)
        n = np.bincount(np.minimum(counts[real], TRUSTED + 2), minlength=TRUSTED + 3)[1:TRUSTED + 2]
        out = [("stats", -1, bucket, pack(np.array([counts[real].sum(), real.sum(), *n]))),
               ("model", -1, bucket, pack(words[order], counts[order]))]
        ends = np.cumsum([len(a[0]) for a in asked])
        for chunk, low, high in zip(rows.column("chunk").to_pylist(), ends - [len(a[0]) for a in asked], ends):
            own = inverse[low:high]
            out.append(("ids", chunk, bucket, pack(number[own], counts[own])))
        return _table(out)

    return run


@dataclass
class Chunk:
    """A chunk's documents and its distinct pairs, in one order every time it is opened."""

    ids: np.ndarray
    nulls: np.ndarray
    train: np.ndarray
    n: np.ndarray
    index: np.ndarray  # token -> word of the chunk
    number: np.ndarray  # word of the chunk -> number
    counts: np.ndarray  # word of the chunk -> training count
    pair: np.ndarray  # token -> distinct pair
    left: np.ndarray  # distinct pair -> words of the chunk
    right: np.ndarray
    home: np.ndarray  # distinct pair -> bucket
    hot: np.ndarray  # word of the chunk -> whether its pairs are spread over all buckets

    @staticmethod
    def open(docs: pa.Table, answers: pa.Table, buckets: int, tokens: int) -> Chunk:
        ids, nulls, train, n, index, home = unpack(docs.column("data")[0].as_py())
        n, index = n.astype(np.int64), index.astype(np.int64)
        number, counts = np.zeros(len(home), np.int64), np.zeros(len(home), np.int64)
        for b, data in zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist()):
            number[home == b], counts[home == b] = unpack(data)
        before = np.concatenate([[0], index[:-1]])
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        before[starts] = len(home) - 1
        pairs, pair = np.unique(before * len(home) + index, return_inverse=True)
        left, right = np.divmod(pairs, len(home))
        hot = counts * 4 * buckets > tokens
        of = np.where(hot[left], number[left] * 0x9E3779B1 + number[right], number[left]).astype(B.U)
        return Chunk(ids.view(np.int64), nulls > 0, train > 0, n, index, number, counts, pair, left, right,
                     (B.mix(of) % B.U(buckets)).astype(np.int64), hot)

    def of_bucket(self, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of a bucket, and its histories (as words of the chunk) with their number of pairs."""
        own = np.flatnonzero(self.home == b)
        own = own[np.argsort(self.number[self.left[own]], kind="stable")]
        heads = self.left[own]
        first = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
        return own, heads[first], np.diff(np.append(first, len(own)))


def _ask_pairs(buckets: int, tokens: int):
    def run(docs, answers):
        c = Chunk.open(docs, answers, buckets, tokens)
        often = np.bincount(c.pair[np.repeat(c.train, c.n)], minlength=len(c.left))
        chunk, rows = docs.column("chunk")[0].as_py(), []
        for b in np.unique(c.home):
            own, heads, n = c.of_bucket(b)
            words, place = np.unique(c.number[c.right[own]], return_inverse=True)
            counts = np.zeros(len(words), np.int64)
            counts[place] = c.counts[c.right[own]]
            rows.append(("pairs", chunk, int(b), pack(
                np.diff(c.number[heads], prepend=0), c.hot[heads], n, place, often[own], np.diff(words, prepend=0), counts)))
        return _table(rows)

    return run


def _count_pairs(buckets: int, low: Unigrams):
    """Bucket of pairs to answers ``totals``, the rows ``stats`` and ``spread``, and the stored row ``model``."""

    def run(key, rows):
        bucket = key[0].as_py()
        asked = [unpack(d) for d in rows.column("data").to_pylist()]
        for a in asked:
            a[0] = np.cumsum(a[0])
        heads = np.concatenate([a[0] for a in asked])
        left = np.concatenate([np.repeat(a[0], a[2].astype(np.int64)) for a in asked])
        words = [np.cumsum(a[5]) for a in asked]
        right = np.concatenate([w[a[3].astype(np.int64)] for w, a in zip(words, asked)])
        right_count = np.concatenate([a[6][a[3].astype(np.int64)] for a in asked])
        names, left = np.unique(left, return_inverse=True)
        vocabulary, first, right = np.unique(right, return_index=True, return_inverse=True)
        pairs, inverse = np.unique(left * len(vocabulary) + right, return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([a[4] for a in asked]), len(pairs)).astype(np.int64)
        owner, follower = np.divmod(pairs, len(vocabulary))
        seen = counts > 0
        p = low.p(right_count[first].astype(np.int64))[follower]
        mass = np.bincount(owner[seen], p[seen], len(names))
        classes = [np.bincount(owner[counts == r], minlength=len(names)) for r in range(1, TRUSTED + 1)]
        _, first_head = np.unique(heads, return_index=True)
        hot = np.concatenate([a[1] for a in asked])[first_head] > 0
        n = np.bincount(np.minimum(counts, TRUSTED + 2), minlength=TRUSTED + 3)[1:TRUSTED + 2]
        out = [("stats", -1, bucket, pack(n)),
               ("model", -1, bucket, pack(np.diff(names, prepend=0), np.bincount(owner[seen], minlength=len(names)),
                                          np.diff(vocabulary, prepend=0), follower[seen], counts[seen]))]
        if hot.any():
            out.append(("spread", -1, bucket, pack(names[hot], mass[hot], *[c[hot] for c in classes])))
        at, at_head = 0, 0
        for chunk, a in zip(rows.column("chunk").to_pylist(), asked):
            mine = inverse[at:at + len(a[3])]
            own, of = counts[mine], owner[mine]
            # the chunk adds up its own pairs; it lacks only what others have seen
            part = np.bincount(of[own > 0], p[mine[own > 0]], len(names))
            whole = np.bincount(of[own > 0], minlength=len(names)) == np.bincount(owner[seen], minlength=len(names))
            rest = np.where(whole, 0.0, mass - part)
            mine = np.searchsorted(names, a[0])
            out.append(("totals", chunk, bucket, pack(own, rest[mine], *[c[mine] for c in classes])))
            at += len(a[3])
        return _table(out)

    return run


def _score(buckets: int, low: Unigrams, factors: np.ndarray, spread: dict[int, tuple]):
    """Chunk with both kinds of answers to its documents' scores."""

    def run(docs, answers):
        kinds = answers.column("kind")
        words = answers.filter(pa.compute.equal(kinds, "ids"))
        totals = answers.filter(pa.compute.equal(kinds, "totals"))
        c = Chunk.open(docs, words, buckets, low.tokens)
        pair_count = np.zeros(len(c.left), np.int64)
        mass = np.zeros(len(c.number))
        classes = np.zeros((TRUSTED, len(c.number)), np.int64)
        for b, data in zip(totals.column("bucket").to_pylist(), totals.column("data").to_pylist()):
            own, heads, _ = c.of_bucket(b)
            got = unpack(data)
            pair_count[own] = got[0]
            mass[heads] = got[1]
            for r in range(TRUSTED):
                classes[r, heads] = got[2 + r]
        own = pair_count > 0
        mass += np.bincount(c.left[own], low.p(c.counts[c.right[own]]), len(mass))
        for w in np.flatnonzero(c.hot):
            mass[w], classes[:, w] = spread.get(int(c.number[w]), (0.0, 0))
        p = conditional(low, factors, c.counts, mass, classes, c.left, pair_count, c.counts[c.right])
        at = np.concatenate([[0], np.cumsum(c.n)])
        known = (c.counts > 0).astype(np.int64)
        return pa.table({
            "id": pa.array(c.ids, pa.int64(), mask=c.nulls), "n_tokens": pa.array(c.n),
            "n_known": pa.array(B.doc_sums(known[c.index], at)),
            "base_score": pa.array(B.doc_sums(low.base(c.counts)[c.index], at)),
            "score": pa.array(B.doc_sums(np.log10(p)[c.pair], at))})

    return run


def conditional(
    low: Unigrams, factors: np.ndarray, history: np.ndarray, mass: np.ndarray, classes: np.ndarray,
    left: np.ndarray, pair_count: np.ndarray, word_count: np.ndarray,
) -> np.ndarray:
    """P(w | h) for pairs: discounted where seen, else the backoff weight times the lower order.

    ``history`` counts each word as history, ``mass`` sums P(w) over its seen followers, ``classes[r - 1]`` is the number
    of followers seen r times; ``left`` is each pair's history.
    """
    r = np.arange(1, TRUSTED + 1)[:, None]
    freed = ((1 - factors[1:, None]) * r * classes).sum(0)
    total = np.where(freed > 0, history, history + 1)  # no discounted follower: one more, for the unseen
    weight = np.where(history > 0, np.where(freed > 0, freed, 1.0) / np.maximum(total, 1) / np.maximum(1 - mass, 1e-300), 1.0)
    d = np.where(pair_count > TRUSTED, 1.0, factors[np.minimum(pair_count, TRUSTED)])
    seen = d * pair_count / np.maximum(total[left], 1)
    return np.where(pair_count > 0, seen, weight[left] * low.p(word_count))


def score(docs: DataFrame, train: Column, id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """``id, n_tokens, n_known, train_tokens, base_score, score`` of every row; learns from the rows where ``train`` holds."""
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), train.alias("train"))
    index = pin(source.mapInArrow(_index(buckets), ROWS))
    texts = index.where("kind = 'docs'")
    words = pin(index.where("kind = 'words'").groupBy("bucket").applyInArrow(_number_words(buckets), ROWS))
    stats = [unpack(r["data"])[0].astype(np.int64) for r in words.where("kind = 'stats'").select("data").collect()]  # one row a bucket
    sums = np.sum(stats, 0) if stats else np.zeros(TRUSTED + 3, np.int64)
    low = Unigrams.of(int(sums[0]), int(sums[1]), sums[2:].astype(float))
    ids = words.where("kind = 'ids'")

    asked = texts.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(_ask_pairs(buckets, low.tokens), ROWS)
    pairs = pin(asked.groupBy("bucket").applyInArrow(_count_pairs(buckets, low), ROWS))
    rows = pairs.where("kind IN ('stats', 'spread')").select("kind", "data").collect()  # bounded by the number of buckets
    n = np.sum([unpack(r["data"])[0].astype(float) for r in rows if r["kind"] == "stats"], 0) if rows else np.zeros(TRUSTED + 1)
    spread: dict[int, tuple] = {}
    for r in rows:
        if r["kind"] == "spread":
            names, mass, *classes = unpack(r["data"])
            for k, name in enumerate(names.tolist()):
                have = spread.get(name, (0.0, 0))
                spread[name] = (have[0] + mass[k], have[1] + np.array([int(c[k]) for c in classes]))
    answers = ids.unionByName(pairs.where("kind = 'totals'"))
    out = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _score(buckets, low, discounts(n), spread), "id long, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id), "n_tokens", "n_known", F.lit(low.tokens).cast("long").alias("train_tokens"),
                      "base_score", "score")
