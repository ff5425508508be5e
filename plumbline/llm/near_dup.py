"""MinHash near-duplicates: minima, bands, verified links, components.

1. One pass over the texts gives each document its set of word shingles (64-bit hashes) as a size, a 128-bit
   fingerprint, ``BANDS`` band keys of ``ROWS`` universal-hash minima each, a sketch of
   ``SKETCH_BITS`` bits (one per further minimum), and a parity bitmap of the set.
2. Documents with equal sets form one class; its smallest id goes on alone.
3. In turns, every bucket that holds several components names a leader: the member that shares the most bucket rows with others, as the
   centre of a group does; later among the members outside the bucket's largest component.  A document is tied to the likest
   leader of its buckets: at most one candidate link per document and turn, however large the bucket.  Turns go on while they tie
   documents, halve the pairs that are still open, and the open buckets still hold many more pairs than rows.
4. Candidates whose sizes or sketches rule the threshold out are dropped; the others are confirmed on the full
   sets, recomputed from the two texts; a leader's text is sent and hashed once for a run of its candidates.
5. At last, buckets that still hold several components give the pairs between the smaller components' members and the others,
   tested by size and sketch inside the join; so no true candidate is lost and settled groups give no pairs.
6. Components come from alternating large-star and small-star steps over the confirmed links.

With 32 bands of 4 rows a pair at similarity 0.8 escapes all bands with probability 5e-8; the sketch test drops it with
probability below 1e-6.  Intermediate tables are reliable checkpoints.

Cases: a null or empty text, or one without words, has an empty set, size 0, and is its own component; a text with fewer words than a
shingle is one shingle; repeated rows of an id share its component; a null id stays outside all links and has a null
component and ``kept`` null; an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import blocks as B
from plumbline.llm.components import compact, components
from plumbline.operators.joins import small_side
from plumbline.session import pin

SHINGLE = 4
PERCENT = 80
BANDS, ROWS = 32, 4
SKETCH_WORDS = 4
SKETCH_BITS = 64 * SKETCH_WORDS
#: Star turns end when the pairs still open are at most so many times the rows of their buckets, or when a turn leaves more than half of them.
PAIRS_A_ROW = 4
#: A pair at similarity 0.8 differs in a tenth of the bits, 25.6 of 256 with deviation 4.8; this is five deviations more.
SKETCH_MOST = 50
#: Parity bitmap of a set: each shingle flips one of so many bits.  Two bitmaps differ in at most as many bits as
#: the sets differ in shingles, which the threshold bounds by a ninth of both sizes: a test that drops no true pair.
PARITY_WORDS = 16

_rng = np.random.default_rng(20)
#: Multipliers and addends of the universal hashes h(x) = (a x + b) mod 2^64, high 32 bits.
_A = _rng.integers(0, 1 << 63, BANDS * ROWS + SKETCH_BITS, dtype=np.uint64) * B.U(2) + B.U(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS + SKETCH_BITS, dtype=np.uint64)


def shingles(block: B.Block, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles, repeats included, and their bounds; short texts are one shingle."""
    words = block.words()
    h = block.word_hashes(words)
    full, at = B.windows(h, words.at, width)
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if not len(short):
        return full, at
    extra = np.zeros(len(short), B.U)
    for i, d in enumerate(short):
        for w in h[words.at[d]:words.at[d + 1]]:
            extra[i:i + 1] = B.mix(extra[i:i + 1] * B.U(0x9E3779B97F4A7C15) + w)
        extra[i:i + 1] = B.mix(extra[i:i + 1] + B.U(words.counts[d]))
    counts = np.diff(at)
    counts[short] = 1
    to = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(to[-1], B.U)
    single = np.zeros(len(out), bool)
    single[to[short]] = True
    out[single], out[~single] = extra, full
    return out, to


def shingle_sets(block: B.Block, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their bounds."""
    h, at = shingles(block, width)
    doc = np.repeat(np.arange(len(block)), np.diff(at))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(block)))])


def minima(sets: np.ndarray, at: np.ndarray, which: slice) -> np.ndarray:
    """(hashes, texts with a set): the minima of the chosen universal hashes."""
    a, b = _A[which], _ADD[which]
    out = np.empty((len(a), len(at) - 1), np.uint32)
    scratch = np.empty(len(sets), np.uint64)
    for k in range(len(a)):
        np.multiply(sets, a[k], out=scratch)
        np.add(scratch, b[k], out=scratch)
        out[k] = np.minimum.reduceat((scratch >> B.U(32)).astype(np.uint32), at[:-1])
    return out


SIGNATURE = "n_shingles long, fp1 long, fp2 long, bands array<long>, sketch array<long>, parity array<long>"


def parity_bits(sets: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(texts, PARITY_WORDS): each shingle of a set flips one bit of its text's bitmap."""
    slots = PARITY_WORDS * 64
    bit = (B.mix(sets ^ B.U(0x2545F4914F6CDD1D)) % B.U(slots)).astype(np.int64) + np.repeat(np.arange(len(size)), size) * slots
    odd = (np.bincount(bit, minlength=len(size) * slots) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(B.U).reshape(len(size), PARITY_WORDS)


def lists(x: np.ndarray) -> pa.Array:
    """Rows of an array of 64-bit values as lists of longs."""
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).view(np.int64).ravel()), x.shape[1]).cast(pa.list_(pa.int64()))


def _signatures(batches: Iterator[pa.RecordBatch], width: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in B.blocks(batch.column(1)):
            sets, at = shingle_sets(block, width)
            size = np.diff(at)
            full = np.flatnonzero(size > 0)
            bounds = np.append(at[full], at[-1])
            fp = np.zeros((2, len(block)), B.U)
            bands = np.zeros((len(block), BANDS), B.U)
            sketch = np.zeros((len(block), SKETCH_WORDS), B.U)
            if len(full):
                for k in range(2):
                    fp[k, full] = np.add.reduceat(B.mix(sets + B.U(k + 1) * B.U(0x632BE59BD9B4E019)), bounds[:-1])
                low = minima(sets, bounds, slice(0, BANDS * ROWS)).astype(B.U)
                for band in range(BANDS):
                    key = np.full(len(full), band + 1, B.U)
                    for row in range(ROWS):
                        key = B.mix(key * B.U(0x9E3779B97F4A7C15) + low[band * ROWS + row])
                    bands[full, band] = key
                bits = (B.mix(minima(sets, bounds, slice(BANDS * ROWS, None))) & B.U(1))
                for w in range(SKETCH_WORDS):
                    shifts = np.arange(64, dtype=B.U)[:, None]
                    sketch[full, w] = np.bitwise_or.reduce(bits[64 * w:64 * w + 64] << shifts, axis=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(block.first, len(block)), pa.array(size.astype(np.int64)),
                 pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)),
                 lists(bands), lists(sketch), lists(parity_bits(sets, size))],
                names=["id", "n_shingles", "fp1", "fp2", "bands", "sketch", "parity"])


def _sets_of(texts: pa.Array, width: int) -> list[np.ndarray]:
    parts = [shingle_sets(b, width) for b in B.blocks(texts)]
    return [s[a:b] for s, at in parts for a, b in zip(at[:-1], at[1:])]


def _confirm(batches: Iterator[pa.RecordBatch], width: int = SHINGLE, percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """Pairs with both texts to the pairs whose full sets are similar enough; equal texts in a run of rows are hashed once."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        leader = batch.column(2)
        new = np.ones(n, bool)
        new[1:] = pc.fill_null(pc.not_equal(leader.slice(1), leader.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
        one = _sets_of(leader.filter(pa.array(new)), width)
        run = np.cumsum(new) - 1
        keep = []
        for k, y in enumerate(_sets_of(batch.column(3), width)):
            x = one[run[k]]
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))


def confirm(pairs: DataFrame, texts: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The pairs ``(a, b)`` that pass on the full sets of ``texts (id, text)``.  The text of ``b`` travels with the pair, that of ``a`` once:
    ``a`` should be the side that repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _confirm(batches, width, percent)

    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    needed = texts.join(small_side(ids), "id", "left_semi")  # only these texts are shuffled
    a, b = (needed.select(F.col("id").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    return pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


SKETCH_COLUMNS = [f"s{k}" for k in range(SKETCH_WORDS)] + [f"p{k}" for k in range(PARITY_WORDS)]


def _distance(x: str, y: str, kind: str = "s", words: int = SKETCH_WORDS) -> Column:
    """Number of bits in which the sketches (``s``) or parity bitmaps (``p``) of the two sides differ."""
    bits = [F.bit_count(F.col(f"{x}{kind}{k}").bitwiseXOR(F.col(f"{y}{kind}{k}"))) for k in range(words)]
    return sum(bits[1:], bits[0])


def _like(x: str, y: str, sketch: bool = True) -> Column:
    """Sizes and parity bitmaps that allow the similarity, and, with ``sketch``, sketches near enough."""
    small, large = F.least(f"{x}n", f"{y}n"), F.greatest(f"{x}n", f"{y}n")
    # sets at the threshold t differ in (1 - t) / (1 + t) of both sizes
    parity = _distance(x, y, "p", PARITY_WORDS) * (100 + PERCENT) <= (small + large) * (100 - PERCENT)
    sure = (small * 100 >= large * PERCENT) & parity
    return sure & (_distance(x, y) <= SKETCH_MOST) if sketch else sure


def _side(sketches: DataFrame, id: str, prefix: str) -> DataFrame:
    return sketches.select(
        F.col("id").alias(id), F.col("n_shingles").alias(f"{prefix}n"),
        *[F.col(c).alias(f"{prefix}{c}") for c in SKETCH_COLUMNS if c in sketches.columns])


def _known(placed: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``key, id, component`` of the buckets that hold several components, with the bucket's rows, its largest component and that one's rows."""
    if labels is None:
        known = placed.withColumn("component", F.col("id"))
    else:
        known = placed.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").select(
            "key", "id", F.coalesce("component", "id").alias("component"))
    sizes = known.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    open_ = sizes.groupBy("key").agg(
        F.sum("n").alias("rows"), F.max(F.struct("n", "component")).alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return known.join(open_.select("key", "rows", F.col("m.component").alias("big"), F.col("m.n").alias("most")), "key")


def star_ties(known: DataFrame, sketches: DataFrame) -> DataFrame:
    """Each document's tie ``(a, b)`` to the likest leader ``a`` of its buckets in another component."""
    degree = known.groupBy("id").agg(F.sum("rows").alias("degree"))
    able = known.where("component <> big OR most = 1").join(degree, "id")
    leaders = able.groupBy("key").agg(F.max(F.struct("degree", F.xxhash64("id").alias("h"), "id", "component")).alias("l"))
    ties = known.join(leaders.select("key", F.col("l.id").alias("a"), F.col("l.component").alias("ca"), F.col("l.degree").alias("d")), "key").where(
        "component <> ca").groupBy("a", F.col("id").alias("b")).agg(F.max("d").alias("d"))
    sketch = "s0" in sketches.columns
    near = ties.join(_side(sketches, "a", "x_"), "a").join(_side(sketches, "b", "y_"), "b").where(_like("x_", "y_", sketch))
    far = _distance("x_", "y_") if sketch else _distance("x_", "y_", "p", PARITY_WORDS)
    best = near.groupBy("b").agg(F.min(F.struct(far.alias("f"), (-F.col("d")).alias("d"), "a")).alias("t"))
    return best.select(F.col("t.a").alias("a"), "b")


def open_pairs(known: DataFrame, sketches: DataFrame) -> DataFrame:
    """All like pairs ``(a, b)`` of different components that share a bucket, without those inside the bucket's largest."""
    one = known.where("component <> big").select("key", F.col("id").alias("x"), F.col("component").alias("cx")).join(
        _side(sketches, "x", "x_"), "x").withColumnRenamed("key", "kx")
    two = known.select("key", F.col("id").alias("y"), F.col("component").alias("cy"), "big").join(_side(sketches, "y", "y_"), "y")
    pairs = one.join(two, (F.col("kx") == F.col("key")) & (F.col("cx") != F.col("cy"))
                     & ((F.col("cy") == F.col("big")) | (F.col("x") < F.col("y"))) & _like("x_", "y_", "s0" in sketches.columns))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def resolve(placed: DataFrame, sketches: DataFrame, texts: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Confirmed links ``(a, b)`` with the same components as all links between documents that share a bucket.

    ``placed``: ``key, id``; ``sketches``: ``id, n_shingles``, parity and, where there are any, sketch columns; ``texts``: ``id, text``.
    """
    placed, links, labels, before = compact(placed), None, None, float("inf")
    while True:
        known = compact(pin(_known(placed, labels)))
        rows, pairs = known.dropDuplicates(["key"]).agg(
            F.sum("rows"), F.sum(F.col("rows").cast("double") * (F.col("rows") - F.col("most")))).first()
        if rows is None or pairs <= PAIRS_A_ROW * rows or 2 * pairs > before:
            break
        before = pairs
        new = pin(confirm(compact(pin(star_ties(known, sketches))), texts, width))
        found = new.count()
        if not found:
            break
        new = compact(new, found)
        links = new if links is None else links.unionByName(new)
        labels = components(links)
    if rows is not None:
        more = compact(pin(confirm(compact(pin(open_pairs(known, sketches))), texts, width)))
        links = more if links is None else links.unionByName(more)
    return links if links is not None else placed.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)


def labelled(signed: DataFrame, member: DataFrame, links: DataFrame, id: str) -> DataFrame:
    """``id, n_shingles, component_id, kept`` from links between classes and ``member (id, rep)``."""
    ids = member.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    final = components(links.unionByName(ids))
    out = signed.select("id", "n_shingles").join(final.select(F.col("node").alias("id"), "component"), "id", "left")
    return out.select(
        F.col("id").alias(id), "n_shingles", F.coalesce("component", "id").alias("component_id")).withColumn(
        "kept", F.col(id) == F.col("component_id"))


def link(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """``id, n_shingles, component_id, kept``: one row per row of ``docs``; shingles of ``width`` words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _signatures(batches, width)

    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    signed = pin(source.mapInArrow(sign, f"id long, {SIGNATURE}"))
    real = signed.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))

    # equal sets: one representative each; an id that occurs with several sets ties their classes
    classes = real.groupBy("fp1", "fp2", "n_shingles").agg(F.min("id").alias("rep"))
    member = pin(real.select("id", "fp1", "fp2", "n_shingles").join(classes, ["fp1", "fp2", "n_shingles"]).select(
        "id", "rep").distinct())
    reps = member.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).select(F.col("rep").alias("id"))
    chosen = real.join(reps, "id").dropDuplicates(["id", "fp1", "fp2"])
    sketches = pin(chosen.select("id", "n_shingles", *[F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH_WORDS)],
        *[F.col("parity")[k].alias(f"p{k}") for k in range(PARITY_WORDS)]))
    keys = chosen.select("id", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    placed = pin(keys.join(buckets.select("key"), "key"))

    links = resolve(placed, sketches, source.where("id IS NOT NULL"), width)
    return labelled(signed, member, links, id)


def components_sql(width: int) -> str:
    return r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < @ THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - @ + 2), lambda i: array_to_string(ws[i:i + @ - 1], ' '))) END AS ss FROM w),
g AS (SELECT min(doc_id) AS rep, ss FROM (SELECT doc_id, list_sort(ss) AS ss FROM s WHERE len(ss) > 0) GROUP BY ss),
x AS (SELECT rep, len(ss) AS n, unnest(ss) AS sh FROM g),
p AS (SELECT a.rep AS a, b.rep AS b FROM x AS a JOIN x AS b ON a.sh = b.sh AND a.rep < b.rep
  AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT rep AS node, rep AS low FROM g UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(low) AS low FROM r GROUP BY node),
m AS (SELECT s.doc_id, len(s.ss) AS n, c.low FROM s LEFT JOIN g ON len(s.ss) > 0 AND g.ss = list_sort(s.ss) LEFT JOIN c ON c.node = g.rep)
SELECT doc_id, n::BIGINT AS n_shingles, coalesce(low, doc_id) AS component_id, doc_id = coalesce(low, doc_id) AS kept FROM m
""".replace("@", str(width))


ORACLE = components_sql(SHINGLE)
