"""Exact Jaccard join of word-shingle sets by partitioning the universe.

Two sets at the threshold differ in a bounded number of shingles, H.  A size band hashes the universe of shingles into segments; where fewer
than so many differences meet a segment, the two sets agree in it, or nearly.

1. Documents with equal sets form one class; its smallest id goes on alone.
2. A set belongs to the band of its size, ``[2^j, 2^(j+1))``, and also probes the band below where that may hold partners.  A
   band has D wide and M narrow segments.  A wide segment is matched with up to one difference: its content and the
   content without each single shingle are keys (the one-deletion neighbourhood).  A narrow segment is matched when equal.
3. A pair that no wide segment matches has two differences in each, so at least M - (H - 2 D) narrow segments are equal.  So a set
   indexes only H - 2 D + 1 narrow segments of its own H, the first in an order that depends on content alone (most shingles first, empty ones
   last), and some spare ones: whatever the pair, one equal segment is among the first of both.
4. D and M are chosen for each band by a cost: keys put out, and rows expected to meet by chance given the number of sets in the band.
5. Keys held by several sets stay.  The keys then known to be the most frequent are given up again, for each set as many as it has
   spare ones; the order is the same for all, so the argument of 3 holds for what is left.
6. The open keys are resolved as buckets: central leaders, lossless tests by size and parity bitmap, and links confirmed on the full sets.

A task first looks for shared keys among its own rows.  Rows of such keys are known to be open and only one of them goes on to
the shuffle by key, so a frequent key brings there at most one row a task and flush.

Sets are compared as 64-bit shingle hashes; no test drops a pair of a similarity at the threshold.

Cases: a null or empty text, or one without words, has an empty set, size 0, and is its own component; a text with fewer words than
a shingle is one shingle; repeated rows of an id share its component; a null id stays outside all links and has a null component;
an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import blocks as B
from plumbline.llm.components import compact
from plumbline.llm.near_dup import PARITY_WORDS, PERCENT, components_sql, labelled, lists, parity_bits, resolve, shingle_sets
from plumbline.operators.joins import small_side
from plumbline.session import pin

SHINGLE = 5
#: Keys held by more sets than this are given up first.
FREQUENT = 32
#: Assumed share of shingles that other documents repeat, and the part of a band that repeats one of them: they only steer the costs.
REPEATED, SPREAD = 0.1, 1e-3
#: Shingles that a wide segment takes of the smallest set of a band, so that empty ones are rare; all wide ones together take at most half.
WIDE_FILL = 6
FLUSH = 1_000_000
WIDE, SURE, PROBE, SPARE_SHIFT = 1, 2, 4, 3


def errors(small: int, large: int, percent: int = PERCENT) -> int:
    """Most shingles in which sets of these sizes differ at the threshold."""
    return (small + large) * (100 - percent) // (100 + percent)


@dataclass(frozen=True)
class Layout:
    """Segments of one band: ``wide`` and ``narrow`` ones, and spare narrow keys a set puts out."""

    wide: int
    narrow: int
    spare: int
    #: Part of the universe that each wide segment takes; the narrow ones share the rest alike.
    share: float


def most_errors(band: int, percent: int = PERCENT) -> int:
    largest = 2 ** (band + 1) - 1
    return errors(largest, largest * 100 // percent, percent)


def layouts(band: int, percent: int = PERCENT) -> Iterator[Layout]:
    """Layouts that find every pair of a band."""
    h = most_errors(band, percent)
    spare = 2 + h // 8
    for wide in range(min((h + 2) // 2, 8) + 1):
        need = h - 2 * wide + 1
        share = WIDE_FILL / 2 ** band
        if need <= 0:
            if wide == 1 or wide * share <= 1:
                yield Layout(wide, 0, 0, 1 / wide)
            break
        if wide * share <= 0.5:
            for more in (1.0, 1.5, 2.0):
                yield Layout(wide, math.ceil(more * (need + spare)), spare, share)


def _met(mean: float, size: float) -> tuple[np.ndarray, np.ndarray]:
    """Chances of 0, 1, ... shingles in a segment of this mean."""
    k = np.arange(int(min(size, mean + 10 * math.sqrt(mean) + 30)) + 1)
    return k, np.exp(k * math.log(mean) - mean - np.array([math.lgamma(x + 1) for x in k]))


def cost(layout: Layout, band: int, sets: int, percent: int = PERCENT) -> float:
    """Keys a set puts out, and rows it is expected to meet by chance, for the middle size of the band."""
    size = 1.5 * 2 ** band
    keys = chance = 0.0  # a segment meets others by chance where all of its shingles are repeated
    if layout.wide:
        mean = layout.share * size
        k, pmf = _met(mean, size)
        keys += layout.wide * (1 + mean)
        chance += layout.wide * float((pmf * REPEATED ** np.maximum(k - 1, 0)).sum())
    if layout.narrow:
        k, pmf = _met((1 - layout.wide * layout.share) * size / layout.narrow, size)
        used = min(layout.narrow, max(1, errors(int(size), int(size) * 100 // percent, percent) - 2 * layout.wide + 1) + layout.spare)
        mass = np.minimum(np.cumsum(pmf[::-1]), used / layout.narrow)[::-1]  # the fullest segments first
        taken = mass - np.append(mass[1:], 0)
        keys += used
        chance += layout.narrow * float((taken * REPEATED ** k).sum())
    return keys + sets * SPREAD * chance


def allocate(sizes: dict[int, int], percent: int = PERCENT) -> dict[int, Layout]:
    """The cheapest layout of each band, given the number of sets by band; bands of sets that only equal ones resemble have none."""
    out = {}
    for band in range(48):
        n = sizes.get(band, 0) + sizes.get(band + 1, 0)
        if most_errors(band, percent) > 0:
            out[band] = min(layouts(band, percent), key=lambda x: (cost(x, band, n, percent), x.wide, x.narrow))
    return out


def bands_of(size: np.ndarray) -> np.ndarray:
    """Floor of the binary logarithm of positive sizes."""
    return np.frexp(size.astype(np.float64))[1] - 1


def keys_of(sets: np.ndarray, at: np.ndarray, plan: dict[int, Layout], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``key, text, kind`` of all keys of the sets of a block."""
    size = np.diff(at)
    own = np.where(size > 0, bands_of(np.maximum(size, 1)), -1)
    least = -(-size * percent // 100)
    probes = np.where((own > 0) & (least < 2 ** np.maximum(own, 0)), own - 1, -1)
    parts = []
    for band, probing in ((own, False), (probes, True)):
        known = np.array([b in plan for b in band.tolist()], bool)
        docs = np.flatnonzero(known)
        if not len(docs):
            continue
        b, n = band[docs], size[docs]
        wide, narrow, spare = (np.array([getattr(plan[x], f) for x in b.tolist()], np.int64) for f in ("wide", "narrow", "spare"))
        share = np.array([plan[x].share for x in b.tolist()])
        partner = np.minimum(2 ** (b + 1) - 1, n) if probing else n * 100 // percent
        need = (n + partner) * (100 - percent) // (100 + percent) - 2 * wide + 1
        used = np.where(need > 0, np.minimum(narrow, need + spare), 0)
        key, text, kind = _keys(sets, at, docs, b, wide, narrow, share, used, np.maximum(used - np.maximum(need, 0), 0))
        parts.append((key, text, kind | (PROBE if probing else 0)))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    return tuple(np.concatenate(c) for c in zip(*parts))


def _keys(sets, at, docs, band, wide, narrow, share, used, spare):
    size = np.diff(at)[docs]
    segments = wide + narrow
    base = np.concatenate([[0], np.cumsum(segments)])
    of = np.repeat(np.arange(len(docs)), size)
    first = np.concatenate([[0], np.cumsum(size)])
    h = sets[np.repeat(at[docs] - first[:-1], size) + np.arange(first[-1])]
    salt = B.mix((band.astype(B.U) + B.U(1)) * B.U(0x9E3779B97F4A7C15))
    x = B.mix(h ^ salt[of])
    part = ((x >> B.U(11)).astype(np.float64) * 2.0 ** -53 / share[of]).astype(np.int64)
    rest = (B.mix(x) % np.maximum(narrow[of], 1).astype(B.U)).astype(np.int64)
    inside = (part < wide[of]) | (narrow[of] == 0)
    slot = base[of] + np.where(inside, np.minimum(part, wide[of] - 1), wide[of] + rest)
    value = B.mix(h + B.U(0x2545F4914F6CDD1D))
    order = np.argsort(slot, kind="stable")
    total = np.concatenate([np.zeros(1, B.U), np.cumsum(value[order])])  # sums modulo 2^64: single shingles can be taken out again
    count = np.bincount(slot, minlength=base[-1])
    to = np.cumsum(count)
    content = total[to] - total[to - count]
    doc = np.repeat(np.arange(len(docs)), segments)
    place = np.arange(base[-1]) - base[doc]
    name = B.mix(salt[doc] + (place.astype(B.U) + B.U(1)) * B.U(0xD6E8FEB86659FD93))
    key = B.mix(content ^ name)
    is_wide = place < wide[doc]
    # the narrow segments used: most shingles first, then by key
    n = np.flatnonzero(~is_wide)
    rank = np.lexsort((key[n], -count[n], doc[n]))
    ordered = n[rank]
    begin = np.concatenate([[0], np.cumsum(narrow)])
    chosen = ordered[np.arange(len(ordered)) - begin[doc[ordered]] < used[doc[ordered]]]
    w = np.flatnonzero(is_wide)
    inner = np.flatnonzero(is_wide[slot])  # shingles of wide segments: the content without them
    without = B.mix((content[slot[inner]] - value[inner]) ^ name[slot[inner]])
    keys = np.concatenate([key[chosen], key[w], without])
    owner = np.concatenate([doc[chosen], doc[w], of[inner]])
    kind = np.concatenate([spare[doc[chosen]] << SPARE_SHIFT, np.full(len(w) + len(inner), WIDE)])
    return keys.view(np.int64), docs[owner], kind.astype(np.int32)


def set_names(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, the same for equal sets."""
    sums = np.concatenate([np.zeros(1, B.U), np.cumsum(B.mix(sets + B.U(0x632BE59BD9B4E019)))])
    return B.mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(B.U)).view(np.int64)


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.blocks(batch.column(1)):
                sets, at = shingle_sets(block, width)
                size = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, len(block)), pa.array(size.astype(np.int64)), pa.array(set_names(sets, at)),
                     lists(parity_bits(sets, size))], names=["id", "n_shingles", "name", "parity"])

    return run


def _flushed(key: np.ndarray, name: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    """Rows of a task, once each; those whose key several sets of the task hold are sure, and one of them is sent to the others as well."""
    order = np.lexsort((name, key))
    key, name, kind = key[order], name[order], kind[order]
    once = np.ones(len(key), bool)
    once[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
    key, name, kind = key[once], name[once], kind[once]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    group = np.cumsum(new) - 1
    shared = np.bincount(group, minlength=0)[group] > 1 if len(key) else np.zeros(0, bool)
    sent = np.flatnonzero(shared & new)
    kind = np.where(shared, kind | SURE, kind)
    key, name = np.concatenate([key, key[sent]]), np.concatenate([name, name[sent]])
    kind = np.concatenate([kind, kind[sent] & ~SURE]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(name), pa.array(kind, pa.int32())], names=["key", "name", "kind"])


def _keyed(width: int, plan: dict[int, Layout]):
    """Keys of all texts of a task; a set that the task has met before is not put out again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        held, full = [], 0
        for batch in batches:
            for block in B.blocks(batch.column(0)):
                sets, at = shingle_sets(block, width)
                name = set_names(sets, at)
                fresh = np.zeros(len(name), bool)
                for k, x in enumerate(name.tolist()):
                    if x not in met:
                        met.add(x)
                        fresh[k] = True
                key, text, kind = keys_of(sets, at, plan)
                keep = fresh[text]
                held.append((key[keep], name[text[keep]], kind[keep]))
                full += int(keep.sum())
                if full >= FLUSH:
                    yield _flushed(*map(np.concatenate, zip(*held)))
                    held, full = [], 0
        if held:
            yield _flushed(*map(np.concatenate, zip(*held)))

    return run


def open_keys(texts: DataFrame, plan: dict[int, Layout], width: int) -> DataFrame:
    """``key, name, kind`` of the keys that several sets hold."""
    rows = texts.select("text").mapInArrow(_keyed(width, plan), "key long, name long, kind int")
    sure = (F.col("kind").bitwiseAND(SURE)) > 0
    spread = rows.withColumn("salt", F.when(sure, F.col("name")).otherwise(F.lit(0)))
    w = Window.partitionBy("key", "salt")
    marked = spread.withColumn("low", F.min("name").over(w)).withColumn("high", F.max("name").over(w))
    open_ = marked.where(sure | (F.col("low") < F.col("high")))
    return compact(pin(open_.select("key", "name", F.col("kind").bitwiseAND(~SURE).alias("kind")).distinct()))


def thinned(rows: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``key, name``: each set gives up as many of its most frequent keys as it has spare ones."""
    hot = small_side(pin(rows.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > frequent)))
    rest = rows.join(hot, "key", "left_anti").select("key", "name")
    among = rows.join(hot, "key")
    spare = F.shiftright("kind", SPARE_SHIFT)
    wide = F.col("kind").bitwiseAND(WIDE) > 0
    rank = F.row_number().over(Window.partitionBy("name", wide, F.col("kind").bitwiseAND(PROBE)).orderBy(F.desc("held"), "key"))
    kept = among.withColumn("rank", rank).where(wide | (F.col("rank") > spare))
    return rest.unionByName(kept.select("key", "name"))


def join(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """``id, n_shingles, component_id, kept``: one row per row of ``docs``; sets of 100 |A and B| >= 80 |A or B| are linked."""
    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    signed = pin(source.mapInArrow(_signed(width), "id long, n_shingles long, name long, parity array<long>"))
    real = signed.where("id IS NOT NULL AND n_shingles > 0")

    # equal sets: one representative each; an id that occurs with several sets ties their classes
    classes = pin(real.groupBy("name").agg(
        F.min("id").alias("rep"), F.min(F.struct("n_shingles", "parity")).alias("s")))
    member = pin(real.select("id", "name").join(classes.select("name", "rep"), "name").select("id", "rep").distinct())
    sizes = {int(r["band"]): r["n"] for r in classes.groupBy(F.floor(F.log2("s.n_shingles")).alias("band")).agg(
        F.count(F.lit(1)).alias("n")).collect()}  # one row a band
    texts = source.where("id IS NOT NULL")
    open_ = thinned(open_keys(texts, allocate(sizes), width))
    placed = pin(open_.join(classes.select("name", F.col("rep").alias("id")), "name").select("key", "id").distinct())
    used = placed.select("id").distinct()
    sketches = pin(classes.select(F.col("rep").alias("id"), "s").join(used, "id").dropDuplicates(["id", "s"]).select(
        "id", "s.n_shingles", *[F.col("s.parity")[k].alias(f"p{k}") for k in range(PARITY_WORDS)]))
    return labelled(signed, member, resolve(placed, sketches, texts, width), id)


ORACLE = f"SELECT doc_id, n_shingles, component_id FROM ({components_sql(SHINGLE)})"
