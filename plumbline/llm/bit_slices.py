"""Exact top-k inner products by a bit-sliced index.

Vectors are quantised to integers.  A block of rows is stored as bitmaps: for each component, one bitmap per bit of its value
above the block's least value of that component.  A query's score is a sum of slices shifted by the signed binary digits of its
components (a negative digit takes the complement): carry-save adders add all bitmaps of one weight at a time, and
the carries go to the next weight.  The result is the score of all rows of the block as bitmaps, from which the top rows are
selected from the most significant slice downward; rows that tie at the boundary are resolved by smaller id.  Every row is
indexed and every score is exact.

Queries in groups meet index blocks in blocks: each task holds one group and one block, both of bounded size.

Cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do null ids; a quantised
component beyond 64 bits is held at the limit of 64 bits, and so is a score (scores are exact before); a query is
compared with the vectors of its own length; rows with the query's id are its own and left out; repeated
rows count as separate candidates but are one query (the smallest vector); a query with fewer than k candidates returns all; an empty table gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import pin

BLOCK_ROWS = 16_384
QUERY_ROWS = 512
SCALE = 256
K = 5
INDEX = "dim int, n int, ids binary, least binary, bits binary, slices binary"
QUERIES = "dim int, ids binary, values binary"
U = np.uint64
LIMIT = np.iinfo(np.int64).max


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, x as double, as long; null where the vector takes no part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when((F.size(vector) > 0) & sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _matrices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and values of at most ``rows`` vectors of one length at a time."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        lists = batch.column(1)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(sizes)])
        for dim in np.unique(sizes):
            own = np.flatnonzero(sizes == dim)
            values = flat[at[own][:, None] + np.arange(dim)]
            for low in range(0, len(own), rows):
                part = held.setdefault(int(dim), [])
                part.append((ids[own[low:low + rows]], values[low:low + rows]))
                if sum(len(i) for i, _ in part) >= rows:
                    yield _joined(held.pop(int(dim)))
    for part in held.values():
        yield _joined(part)


def _joined(part: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([i for i, _ in part]), np.concatenate([v for _, v in part])


def slice_block(ids: np.ndarray, values: np.ndarray) -> dict[str, object]:
    """The index block of these rows, in id order."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order].astype(np.int64)
    least = values.min(0)
    above = (values - least).view(U)  # right modulo 2^64, and never negative
    bits = np.array([int(m).bit_length() for m in above.max(0)], np.int32)
    words = -(-len(ids) // 64)
    out = []
    for d, n in enumerate(bits):
        for b in range(n):
            bitmap = np.zeros(words * 8, np.uint8)
            packed = np.packbits((above[:, d] >> U(b) & U(1)).astype(np.uint8), bitorder="little")
            bitmap[:len(packed)] = packed
            out.append(bitmap.tobytes())
    return {"dim": values.shape[1], "n": len(ids), "ids": ids.astype("<i8").tobytes(), "least": least.astype("<i8").tobytes(),
            "bits": bits.astype("<i4").tobytes(), "slices": b"".join(out)}


def _digits(value: int) -> list[tuple[int, int]]:
    """Signed binary digits without neighbours: (position, +1 or -1)."""
    out, place = [], 0
    while value:
        if value & 1:
            digit = 2 - (value & 3)
            out.append((place, digit))
            value -= digit
        value >>= 1
        place += 1
    return out


def score_slices(query: np.ndarray, least: np.ndarray, bits: np.ndarray, slices: np.ndarray) -> tuple[np.ndarray, int]:
    """Bitmaps of ``score - base`` for all rows, least significant first, and ``base``."""
    first = np.concatenate([[0], np.cumsum(bits)])
    plus: dict[int, list[int]] = {}
    minus: dict[int, list[int]] = {}
    base = sum(q * low for q, low in zip(query.tolist(), least.tolist()))
    for d, q in enumerate(query.tolist()):
        for place, digit in _digits(q):
            to = plus if digit > 0 else minus
            for b in range(bits[d]):
                to.setdefault(place + b, []).append(first[d] + b)
            if digit < 0:
                base -= ((1 << int(bits[d])) - 1) << place
    words = slices.shape[1]
    weight, carried, out = 0, np.zeros((0, words), U), []
    last = max([*plus, *minus], default=-1)
    while weight <= last or len(carried):
        own = np.concatenate([carried, slices[plus.get(weight, [])], ~slices[minus.get(weight, [])]])
        carries = [np.zeros((0, words), U)]
        while len(own) > 1:  # full adders on thirds; a half adder for the last two
            n = len(own) // 3
            if n:
                a, b, c = own[:n], own[n:2 * n], own[2 * n:3 * n]
                half = a ^ b
                carries.append((a & b) | (half & c))
                own = np.concatenate([half ^ c, own[3 * n:]])
            else:
                carries.append(own[:1] & own[1:])
                own = own[:1] ^ own[1:]
        out.append(own[0] if len(own) else np.zeros(words, U))
        carried = np.concatenate(carries)
        weight += 1
    return (np.stack(out) if out else np.zeros((0, words), U)), base


def top_rows(score: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest scores among the set bits of ``among``, ties to the lower row."""
    sure, level = np.zeros_like(among), among
    for bitmap in score[::-1]:
        ones = level & bitmap
        n = int(np.bitwise_count(sure).sum()) + int(np.bitwise_count(ones).sum())
        if n > k:
            level = ones
        else:
            sure, level = sure | ones, level & ~bitmap
            if n == k:
                level = np.zeros_like(level)
                break
    chosen = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    tied = np.flatnonzero(np.unpackbits(level.view(np.uint8), bitorder="little"))[:max(0, k - len(chosen))]
    return np.concatenate([chosen, tied])


def search_block(block: dict, ids: np.ndarray, values: np.ndarray, k: int) -> tuple[list, list, list]:
    rows = np.frombuffer(block["ids"], "<i8")
    least, bits = np.frombuffer(block["least"], "<i8"), np.frombuffer(block["bits"], "<i4")
    words = -(-len(rows) // 64)
    slices = np.frombuffer(block["slices"], "<u8").reshape(-1, words)
    every = np.zeros(words * 64, np.uint8)
    every[:len(rows)] = 1
    out: tuple[list, list, list] = ([], [], [])
    for q, vector in zip(ids.tolist(), values):
        score, base = score_slices(vector, least, bits, slices)
        among = every.copy()
        among[np.searchsorted(rows, q):np.searchsorted(rows, q, "right")] = 0
        best = top_rows(score, np.packbits(among, bitorder="little").view(U), k)
        picked = (score[:, best >> 6] >> (best & 63).astype(U)) & U(1)
        total = [min(max(base + sum(1 << int(w) for w in np.flatnonzero(bits)), -LIMIT - 1), LIMIT) for bits in picked.T] \
            if len(score) else [min(max(base, -LIMIT - 1), LIMIT)] * len(best)
        out[0].extend([q] * len(best))
        out[1].extend(rows[best].tolist())
        out[2].extend(total)
    return out


def build(vectors: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Index blocks of ``(id, vector)``, with a block number; checkpointed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values in _matrices(batches, rows):
            yield pa.RecordBatch.from_pylist([slice_block(ids, values)], schema=_INDEX_SCHEMA)

    parts = max(1, -(-vectors.count() // rows))
    blocks = vectors.repartition(parts).mapInArrow(run, INDEX)
    return pin(blocks.withColumn("block", F.monotonically_increasing_id()))


def search(index: DataFrame, queries: DataFrame, k: int = K, group: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best rows of the index for each ``(id, vector)``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values in _matrices(batches, group):
            yield pa.RecordBatch.from_pylist([{
                "dim": values.shape[1], "ids": ids.astype("<i8").tobytes(), "values": values.astype("<i8").tobytes()}],
                schema=_QUERY_SCHEMA)

    parts = max(1, -(-queries.count() // group))
    packed = pin(queries.repartition(parts).mapInArrow(pack, QUERIES).withColumn("group", F.monotonically_increasing_id()))
    groups = packed.select("dim", "group")
    blocks = index.select("dim", "block")
    # a task for each group and block: both sides are lists of block numbers, not of rows
    tasks = groups.join(blocks, "dim").select("group", "block")
    left = tasks.join(packed, "group").select("group", "block", "ids", "values", "dim")
    right = tasks.join(index.drop("dim"), "block").select(
        F.col("group").alias("_group"), F.col("block").alias("_block"), *index.drop("block", "dim").columns)

    def meet(left, right):
        out: tuple[list, list, list] = ([], [], [])
        for block in right.to_pylist():
            for row in left.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                values = np.frombuffer(row["values"], "<i8").reshape(len(ids), -1)
                for to, got in zip(out, search_block(block, ids, values, k)):
                    to.extend(got)
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("query_id", "vec_id", "score"), out)})

    found = left.groupBy("group", "block").cogroup(right.groupBy("_group", "_block")).applyInArrow(
        meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


_INDEX_SCHEMA = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("least", pa.binary()),
                           ("bits", pa.binary()), ("slices", pa.binary())])
_QUERY_SCHEMA = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("values", pa.binary())])


def top_k(vectors: DataFrame, every: int = 50, k: int = K, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows whose id is divisible by ``every`` against all rows."""
    sound = vectors.select(F.col(id).cast("long").alias("id"), quantised(F.col(vector)).alias("v")).where(
        "id IS NOT NULL AND v IS NOT NULL")
    return search(build(sound), sound.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")), k)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]))::BIGINT AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
