"""Hard negatives by coordinate pruning over length buckets.

Vectors are quantised to integers.  Rows of one label and dimension are sorted by length and cut into buckets of like lengths; a
bucket holds, for every coordinate, the order of its rows by the coordinate of the normalised vector.  For an anchor and
a bucket, the score still needed becomes a least cosine: it is divided by both lengths.  A bucket that cannot reach it is passed over.  Else the
anchor's focus coordinates (its largest ones) bound the same coordinate of every row that reaches the cosine: the angles of the two
to that axis differ by at most the angle of the cosine.  Each range is a run of a sorted coordinate list, the runs are
intersected, and the rows left are verified by exact inner products.  An anchor whose runs exclude little is scored against the
whole bucket at once.

Two searches: the best rows of the anchor's own label (its positives; the needed score rises with the k best found), then, among
the buckets of other labels, the best rows below each positive's ceiling (the needed score starts at the positive's floor).  A
task holds one group of anchors and one stripe of buckets, both of bounded size; the best of all tasks are merged by a window of k rows a task.

Cases: rows with a null id or label, or a vector that is null, empty, or holds null or non-finite components, take no part; a component
or score beyond 64 bits is held at the limit; vectors of other dimensions than the anchor's are no candidates; rows with the anchor's own id are left out; repeated
rows are separate candidates but one anchor (the smallest row), and a repeated positive is mined once for each of its rows; fewer positives or negatives than
asked for are all returned; equal scores go to the smaller id; a positive score of 0 admits only scores of 0, a negative one none; an
empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.bit_slices import LIMIT, SCALE, quantised
from plumbline.session import pin

BUCKET_ROWS = 4096
#: A bucket ends where a length falls below this share of its longest.
BUCKET_RATIO = 0.9
#: Buckets that one task searches after another, the longest first, so that the needed score rises from one to the next.
STRIPE = 8
ANCHOR_ROWS = 1024
FOCUS = 6
#: Runs are intersected where they are expected to leave less than this share of a bucket.
SELECTIVE = 0.3
POSITIVES, NEGATIVES, FLOOR, CEILING = 5, 3, 50, 95

BUCKETS = "label long, dim int, n int, longest double, ids binary, values binary, orders binary, stripe long"
ANCHORS = "label long, dim int, ids binary, values binary, positives binary"
_BUCKET_SCHEMA = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("longest", pa.float64()),
                            ("ids", pa.binary()), ("values", pa.binary()), ("orders", pa.binary()), ("stripe", pa.int64())])
_ANCHOR_SCHEMA = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("values", pa.binary()),
                            ("positives", pa.binary())])
_FOUND = ("anchor_id", "positive_rank", "positive_id", "positive_score", "vec_id", "score")


def lengths(values: np.ndarray) -> np.ndarray:
    return np.sqrt((values.astype(np.float64) ** 2).sum(1))


def inner(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where every sum fits 53 bits, else in integers, held at the limits of 64 bits."""
    most = [max((abs(int(x)) for x in (a.min(initial=0), a.max(initial=0))), default=0) for a in (queries, rows)]
    bound = most[0] * most[1] * max(1, queries.shape[1])
    if bound < 1 << 53:
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    if bound <= LIMIT:
        return queries @ rows.T
    return np.clip(queries.astype(object) @ rows.T.astype(object), -LIMIT - 1, LIMIT).astype(np.int64)


def _runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``label, ids, values`` of consecutive rows of one label and dimension, at most ``rows`` at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    key, full = None, 0
    for batch in batches:
        ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(sizes)])
        edges = np.flatnonzero((labels[1:] != labels[:-1]) | (sizes[1:] != sizes[:-1])) + 1
        bounds = [0, *edges.tolist(), len(ids)] if len(ids) else []
        for a, b in zip(bounds[:-1], bounds[1:]):
            if key != (labels[a], sizes[a]):
                if held:
                    yield key[0], *map(np.concatenate, zip(*held))
                held, full, key = [], 0, (labels[a], sizes[a])
            while a < b:
                to = min(b, a + rows - full)
                held.append((ids[a:to], flat[at[a]:at[to]].reshape(to - a, -1)))
                full += to - a
                a = to
                if full == rows:
                    yield key[0], *map(np.concatenate, zip(*held))
                    held, full = [], 0
    if held:
        yield key[0], *map(np.concatenate, zip(*held))


def bucket(label: int, ids: np.ndarray, values: np.ndarray) -> dict[str, object]:
    """A bucket with its sorted coordinate lists, rows in id order."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order].astype(np.int64)
    length = lengths(values)
    unit = values / np.where(length > 0, length, 1)[:, None]
    orders = np.argsort(unit, axis=0, kind="stable").T
    return {"label": int(label), "dim": values.shape[1], "n": len(ids), "longest": float(length.max()), "ids": ids.astype("<i8").tobytes(),
            "values": values.astype("<i8").tobytes(), "orders": np.ascontiguousarray(orders, "<i4").tobytes()}


def build(vectors: DataFrame, rows: int = BUCKET_ROWS, ratio: float = BUCKET_RATIO, stripe: int = STRIPE) -> DataFrame:
    """Buckets of ``(id, label, vector)``; checkpointed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part = 0, TaskContext.get().partitionId()
        last = None
        for label, ids, values in _runs(batches, rows):
            length = lengths(values)
            a = 0
            while a < len(ids):  # rows come from the longest to the shortest
                b = a + max(1, int((length[a:] >= ratio * length[a]).sum()))
                if last is not None and last != (label, values.shape[1]):
                    made = -(-made // stripe) * stripe  # a stripe holds one label and dimension
                last = label, values.shape[1]
                yield pa.RecordBatch.from_pylist(
                    [bucket(label, ids[a:b], values[a:b]) | {"stripe": (part << 32) + made // stripe}], schema=_BUCKET_SCHEMA)
                made, a = made + 1, b

    parts = max(1, -(-vectors.count() // (rows * stripe)))
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    keyed = vectors.withColumn("dim", F.size("vector")).withColumn("length", -length)
    keys = ["label", "dim", "length", "id"]
    ordered = keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return pin(ordered.select("id", "label", "vector").mapInArrow(run, BUCKETS))


class Bucket:
    def __init__(self, row: dict):
        self.n, self.dim, self.longest = row["n"], row["dim"], row["longest"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.values = np.frombuffer(row["values"], "<i8").reshape(self.n, self.dim)
        self.orders = np.frombuffer(row["orders"], "<i4").reshape(self.dim, self.n)
        length = lengths(self.values)
        self.unit = self.values / np.where(length > 0, length, 1)[:, None]
        self.lists: dict[int, np.ndarray] = {}

    def list_of(self, f: int) -> np.ndarray:
        """The sorted values of coordinate ``f``."""
        if f not in self.lists:
            self.lists[f] = self.unit[self.orders[f], f]
        return self.lists[f]


def feasible(focus: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest coordinate of a unit vector whose cosine with a unit vector of coordinate ``focus`` is at least ``cosine``."""
    angle = np.arccos(np.clip(focus, -1, 1))
    wide = np.arccos(np.clip(cosine, -1, 1))[:, None]
    return np.cos(np.minimum(np.pi, angle + wide)) - 1e-9, np.cos(np.maximum(0, angle - wide)) + 1e-9


def reached(b: Bucket, ids: np.ndarray, values: np.ndarray, length: np.ndarray, need: np.ndarray, focus: int = FOCUS):
    """``(anchor, row, score)`` of all pairs whose score is at least the anchor's ``need``, without rows of the anchor's id."""
    reach = length * b.longest
    cosine = np.where(need > 0, need / np.where(reach > 0, reach, 1), -1.0)
    live = np.flatnonzero(~((need > 0) & ((reach <= 0) | (cosine > 1 + 1e-9))))
    if not len(live):
        return (np.zeros(0, np.int64),) * 3
    f = min(focus, b.dim)
    unit = values[live] / np.where(length[live] > 0, length[live], 1)[:, None]
    chosen = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :f]
    low, high = feasible(np.take_along_axis(unit, chosen, 1), cosine[live])
    start, stop = np.zeros(chosen.shape, np.int64), np.zeros(chosen.shape, np.int64)
    for c in np.unique(chosen):
        at = chosen == c
        start[at] = np.searchsorted(b.list_of(c), low[at], "left")
        stop[at] = np.searchsorted(b.list_of(c), high[at], "right")
    share = np.prod(np.maximum(stop - start, 0) / b.n, axis=1)
    pruned = share < SELECTIVE
    parts = []
    for i in np.flatnonzero(pruned):
        runs = np.argsort(stop[i] - start[i], kind="stable")
        rows = b.orders[chosen[i, runs[0]], start[i, runs[0]]:stop[i, runs[0]]]
        for k in runs[1:]:
            if not len(rows):
                break
            c = chosen[i, k]
            x = b.unit[rows, c]
            rows = rows[(x >= low[i, k]) & (x <= high[i, k])]
        if len(rows):
            score = inner(values[live[i]:live[i] + 1], b.values[rows])[0]
            parts.append((np.full(len(rows), live[i]), rows.astype(np.int64), score))
    whole = live[~pruned]
    step = max(1, (1 << 22) // b.n)
    for k in range(0, len(whole), step):
        own = whole[k:k + step]
        score = inner(values[own], b.values)
        a, rows = np.nonzero(score >= need[own][:, None])
        parts.append((own[a], rows, score[a, rows]))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    a, rows, score = map(np.concatenate, zip(*parts))
    keep = (score >= need[a]) & (b.ids[rows] != ids[a])
    return a[keep], rows[keep], score[keep]


def best(slot: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of every slot, by score downward and id upward."""
    order = np.lexsort((vec, -np.maximum(score, -LIMIT), slot))
    s = slot[order]
    first = np.searchsorted(s, s)
    return order[np.arange(len(s)) - first < k]


LEAST = -LIMIT - 1


def search_stripe(group: dict, buckets: list[Bucket], k: int, positives: int = POSITIVES):
    """The k best rows of each slot of a group: a slot is an anchor, or, where positives are given, an anchor's positive with
    its floor and ceiling."""
    ids = np.frombuffer(group["ids"], "<i8")
    values = np.frombuffer(group["values"], "<i8").reshape(len(ids), -1)
    length = lengths(values)
    if group["positives"] is None:
        owner, windows = np.arange(len(ids)), None
        low, high = np.full(len(ids), LEAST), np.full(len(ids), LIMIT)
    else:  # anchor, rank, positive, score, floor, ceiling
        windows = np.frombuffer(group["positives"], "<i8").reshape(-1, 6)
        owner, low, high = windows[:, 0], windows[:, 4].copy(), windows[:, 5]
    slot = vec = score = np.zeros(0, np.int64)
    sorted_owner = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[sorted_owner], np.arange(len(ids) + 1))
    for b in sorted(buckets, key=lambda b: (-b.longest, int(b.ids[0]))):
        need = np.full(len(ids), LIMIT)
        np.minimum.at(need, owner, low)
        open_ = np.zeros(len(ids), bool)
        open_[owner[low <= high]] = True
        some = np.flatnonzero(open_)
        a, rows, got = reached(b, ids[some], values[some], length[some], need[some])
        a = some[a]
        # each pair meets all slots of its anchor
        times = (bounds[1:] - bounds[:-1])[a]
        pair = np.repeat(np.arange(len(a)), times)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times)
        s = sorted_owner[bounds[a[pair]] + place]
        fits = (got[pair] >= low[s]) & (got[pair] <= high[s])
        slot = np.concatenate([slot, s[fits]])
        vec = np.concatenate([vec, b.ids[rows[pair[fits]]]])
        score = np.concatenate([score, got[pair[fits]]])
        keep = best(slot, vec, score, k)
        slot, vec, score = slot[keep], vec[keep], score[keep]
        full = np.bincount(slot, minlength=len(owner)) >= k
        worst = np.full(len(owner), LIMIT)
        np.minimum.at(worst, slot, score)
        low = np.where(full, np.maximum(low, worst), low)
    if windows is None:
        zero = np.zeros(len(slot), np.int64)
        return ids[owner[slot]], zero, zero, zero, vec, score
    w = windows[slot]
    return ids[w[:, 0]], w[:, 1], w[:, 2], w[:, 3], vec, score


def search(index: DataFrame, anchors: DataFrame, k: int, same_label: bool) -> DataFrame:
    """``_FOUND`` columns: the k best rows of every task for packed groups of anchors; among the own label or all others."""
    groups = anchors.select("dim", "label", "group")
    stripes = index.select("dim", F.col("label").alias("_label"), "stripe").distinct()
    match = F.col("label") == F.col("_label") if same_label else F.col("label") != F.col("_label")
    # a task for each group and stripe: both sides are lists of numbers, not of rows
    tasks = groups.join(stripes, "dim").where(match).select("group", "stripe")
    left = tasks.join(anchors, "group").select("group", F.col("stripe").alias("at"), "ids", "values", "positives")
    right = tasks.join(index, "stripe").select(
        F.col("group").alias("_group"), F.col("stripe").alias("_at"), "n", "dim", "longest", "ids", "values", "orders")

    def meet(left, right):
        buckets = [Bucket(row) for row in right.to_pylist()]
        out = [search_stripe(row, buckets, k) for row in left.to_pylist()]
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 6
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(_FOUND, columns)})

    found = left.groupBy("group", "at").cogroup(right.groupBy("_group", "_at")).applyInArrow(
        meet, ", ".join(f"{n} long" for n in _FOUND))
    order = Window.partitionBy("anchor_id", "positive_rank").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _packed(rows: DataFrame, size: int, with_positives: bool, floor: int, ceiling: int) -> DataFrame:
    """Groups of at most ``size`` anchors of one label and dimension."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positives: dict[int, list] = {}

        def seen(batches):
            for batch in batches:
                if with_positives:
                    for i, p in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                        positives[i] = p
                yield batch

        for label, ids, values in _runs(seen(batches), size):
            windows = None
            if with_positives:
                windows = np.array([
                    (k, p["positive_rank"], p["positive_id"], p["positive_score"],
                     max(-(-floor * p["positive_score"] // 100), LEAST), min(ceiling * p["positive_score"] // 100, LIMIT))
                    for k, i in enumerate(ids.tolist()) for p in positives.pop(i)], "<i8").tobytes()
            yield pa.RecordBatch.from_pylist([{
                "label": int(label), "dim": values.shape[1], "ids": ids.astype("<i8").tobytes(), "values": values.astype("<i8").tobytes(),
                "positives": windows}], schema=_ANCHOR_SCHEMA)

    columns = ["id", "label", "vector", *(["positives"] if with_positives else [])]
    parts = max(1, -(-rows.count() // size))
    keyed = rows.withColumn("dim", F.size("vector"))
    keys = ["label", "dim", "id"]
    ordered = keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select(*columns)
    return pin(ordered.mapInArrow(pack, ANCHORS).withColumn("group", F.monotonically_increasing_id()))


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
         floor: int = FLOOR, ceiling: int = CEILING, id: str = "vec_id", vector: str = "embedding", label: str = "label",
         scale: int = SCALE, group: int = ANCHOR_ROWS, rows: int = BUCKET_ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` are rows of the same columns.  An anchor's positives are its first ``positives`` other rows of its label; for each
    of them the first ``negatives`` rows of other labels are returned whose score is at least ``floor`` and at most ``ceiling`` percent of the positive's.
    """

    def sound(frame: DataFrame) -> DataFrame:
        return frame.select(
            F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), quantised(F.col(vector), scale).alias("vector")
        ).where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")

    index = build(sound(vectors), rows)
    asked = pin(sound(anchors).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.*"))
    near = search(index, _packed(asked, group, False, floor, ceiling), positives, True).select(
        F.col("anchor_id").alias("id"), F.col("rank").cast("long").alias("positive_rank"),
        F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    with_positives = asked.join(
        near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("positive_rank", "positive_id", "positive_score"))).alias("positives")),
        "id")  # at most ``positives`` a list
    found = search(index, _packed(with_positives, group, True, floor, ceiling), negatives, False)
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                        F.col("score").alias("negative_score"), "positive_rank")


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same,
    list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]))::BIGINT AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
o AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM p WHERE same),
n AS (SELECT o.anchor_id, o.vec_id AS positive_id, p.vec_id AS negative_id, o.score AS positive_score, p.score AS negative_score,
    row_number() OVER (PARTITION BY o.anchor_id, o.vec_id ORDER BY p.score DESC, p.vec_id) AS rank
  FROM o JOIN p ON o.k <= 5 AND o.anchor_id = p.anchor_id AND NOT p.same
    AND 50 * o.score <= 100 * p.score AND 100 * p.score <= 95 * o.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
