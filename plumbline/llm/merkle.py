"""Merkle manifest of a dataset, with membership proofs by octopus multiproofs.

A row is a leaf: the SHA-256 of its fields.  The leaves of a source, in id order, form a tree of ``ARITY`` children a node, and the
subroots, in source order, form the tree above.

1. Leaf digests are Column functions of the scan, so texts are never shuffled; the digests are range-partitioned by source and id, once.
2. Each partition packs its rows, in order, into units of at most ``UNIT_ROWS`` leaves.  Units hold a run of consecutive leaves of one or more
   sources; prefix sums of their counts give every run its first position.
3. A unit derives every node whose children all lie in it and puts out only the nodes whose parents reach beyond it (at most 2 x 15 a
   level).  Those fragments, a small table, are combined level by level into the nodes that no unit can derive alone.
4. Octopus: a unit's known nodes of a level are one run of positions, so the coordinates its proofs miss are the two ends of that run filled up to whole
   families.  Each unit names that minimal union of all levels of both trees, the coordinates are fetched once by a join with the fragments, the unit derives the shared
   interiors from them, and expands the proof of each of its leaves locally.

Cases: a null field is hashed as ``-``, which no value gives; a null id comes first in its source and is never tampered with; rows that
agree in source and id are ordered by their leaf, so equal rows have equal leaves and neighbouring places; a null source is the first source, apart from
an empty one; a source of one row is its own subroot, a table of one source has its subroot as root; an
empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.joins import small_side
from plumbline.session import pin, shuffle_width

ARITY = 16
UNIT_ROWS = 16_384
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each with its length in bytes before it."""
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


UNITS = ("unit long, part int, runs array<struct<source:string,n:long>>, ids binary, nulls binary, leaves binary, "
         "changed binary, at binary")
_RUN = pa.struct([("source", pa.string()), ("n", pa.int64())])
_UNIT_SCHEMA = pa.schema([("unit", pa.int64()), ("part", pa.int32()), ("runs", pa.list_(_RUN)), ("ids", pa.binary()),
                          ("nulls", pa.binary()), ("leaves", pa.binary()), ("changed", pa.binary()), ("at", pa.binary())])


def _units(rows: int):
    """Sorted ``(source, id, leaf, changed)`` rows to packed units; ``changed`` is the leaf after tampering, or null."""

    def unit(part: int, k: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        source = table.column(0).to_pylist()
        edges = [0, *[i for i in range(1, len(source)) if source[i] != source[i - 1]], len(source)]
        runs = [{"source": source[a], "n": b - a} for a, b in zip(edges[:-1], edges[1:])]
        changed = table.column(3).to_pylist()
        at = [i for i, c in enumerate(changed) if c is not None]
        return pa.RecordBatch.from_pylist([{
            "unit": (part << 32) + k, "part": part, "runs": runs,
            "ids": table.column(1).fill_null(0).to_numpy().astype("<i8").tobytes(),
            "nulls": table.column(1).is_null().to_numpy().astype(np.uint8).tobytes(),
            "leaves": bytes.fromhex("".join(table.column(2).to_pylist())),
            "changed": bytes.fromhex("".join(changed[i] for i in at)), "at": np.array(at, "<i4").tobytes()}], schema=_UNIT_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, full = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            a = 0
            while a < batch.num_rows:
                n = min(batch.num_rows - a, rows - full)
                held.append(batch.slice(a, n))
                full, a = full + n, a + n
                if full == rows:
                    yield unit(part, k, held)
                    k, held, full = k + 1, [], 0
        if held:
            yield unit(part, k, held)

    return run


def depth(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    d = 0
    while n > 1:
        n, d = -(-n // ARITY), d + 1
    return d


def _hexes(raw: bytes) -> list[str]:
    text = raw.hex()
    return [text[k:k + 64] for k in range(0, len(text), 64)]


class Run:
    """The nodes that one unit knows of one tree: a run of consecutive positions on each level."""

    def __init__(self, first: int, leaves: list[str], total: int):
        self.total = total
        self.levels: list[tuple[int, list[str]]] = [(first, leaves)]

    def _size(self, level: int) -> int:
        n = self.total
        for _ in range(level):
            n = -(-n // ARITY)
        return n

    def derive(self, fetched: dict[tuple[int, int], str] | None = None) -> None:
        """Derive the levels above: from whole families only, or from families filled up with ``fetched`` nodes."""
        for level in range(depth(self.total)):
            first, nodes = self.levels[level]
            last, size = first + len(nodes), self._size(level)
            if fetched is not None and nodes:
                low, high = first // ARITY * ARITY, min(size, -(-last // ARITY) * ARITY)
                nodes = [fetched[level, p] for p in range(low, first)] + nodes + [fetched[level, p] for p in range(last, high)]
                first, last = low, high
                self.levels[level] = (first, nodes)
            a = -(-first // ARITY)
            b = last // ARITY if last < size else -(-last // ARITY)
            self.levels.append((a, [H(*nodes[p * ARITY - first:(p + 1) * ARITY - first]) for p in range(a, b)]))

    def fragments(self) -> Iterator[tuple[int, int, str]]:
        """Known nodes whose parents are not known: ``level, position, digest``."""
        for level in range(depth(self.total)):
            first, nodes = self.levels[level]
            a, above = self.levels[level + 1]
            for p in range(first, first + len(nodes)):
                if not above:
                    yield level, p, nodes[p - first]
                elif p < a * ARITY or p >= (a + len(above)) * ARITY:
                    yield level, p, nodes[p - first]

    @staticmethod
    def missing(first: int, last: int, total: int) -> Iterator[tuple[int, int]]:
        """Coordinates needed beside leaves ``first .. last - 1`` to prove them all: the ends of each level's families."""
        level, size = 0, total
        while size > 1:
            low, high = first // ARITY * ARITY, min(size, -(-last // ARITY) * ARITY)
            yield from ((level, p) for p in (*range(low, first), *range(last, high)))
            first, last, size, level = low // ARITY, -(-high // ARITY), -(-size // ARITY), level + 1

    def family(self, level: int, p: int) -> tuple[list[str], int]:
        """The siblings' family of node ``p`` and its place in it."""
        first, nodes = self.levels[level]
        low = p // ARITY * ARITY
        return nodes[low - first:low + ARITY - first], p - low

    def siblings(self, p: int) -> str:
        """Siblings of the node at leaf position ``p``, level by level, left to right."""
        out = []
        for level in range(depth(self.total)):
            family, k = self.family(level, p)
            out += family[:k] + family[k + 1:]
            p //= ARITY
        return "".join(out)

    def fold(self, p: int, digest: str) -> str:
        for level in range(depth(self.total)):
            family, k = self.family(level, p)
            digest = H(*family[:k], digest, *family[k + 1:])
            p //= ARITY
        return digest


NODES = "tree string, level int, p long, digest string"
_NODE_SCHEMA = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("p", pa.int64()), ("digest", pa.string())])
#: The tree of subroots; a source's own tree is named by ``s`` and the source, that of a null source by an empty name.
TOP = "top"


def _tree(source: str | None) -> str:
    return "" if source is None else "s" + source


def _nodes(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _NODE_SCHEMA)], schema=_NODE_SCHEMA)


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            leaves, at, out = _hexes(row["leaves"]), 0, []
            for r in row["runs"]:
                run = Run(r["first"], leaves[at:at + r["n"]], r["total"])
                at += r["n"]
                run.derive()
                out += [(_tree(r["source"]), *x) for x in run.fragments()]
                if len(run.levels[0][1]) == r["total"]:  # the whole source lies here: its subroot is a node of the top tree
                    out.append((TOP, 0, r["place"], run.levels[-1][1][0]))
            if out:
                yield _nodes(out)


def _combined(nodes: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """``nodes`` of all levels: families that no unit holds whole are combined level by level.  ``sizes``: tree, total."""
    every = nodes
    for level in range(depth(most)):
        family = F.floor(F.col("p") / ARITY)
        whole = every.where(F.col("level") == level).groupBy("tree", family.alias("p")).agg(
            F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("p", "digest"))), lambda x: x["digest"])), 256).alias("digest"),
            F.count(F.lit(1)).alias("n"))  # at most ARITY nodes a family
        made = whole.join(small_side(sizes), "tree").withColumn("size", _level_size(level)).where(
            (F.col("size") > 1) & (F.col("n") == F.least(F.lit(ARITY), F.col("size") - F.col("p") * ARITY)))
        every = pin(every.unionByName(made.select("tree", F.lit(level + 1).alias("level"), "p", "digest")))
    return every


def _level_size(level: int) -> Column:
    """Nodes of a level of a tree of ``total`` leaves."""
    return F.ceil(F.col("total") / F.lit(ARITY ** level)).cast("long")


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            runs = row["runs"]
            out = [(_tree(r["source"]), level, p) for r in runs for level, p in Run.missing(r["first"], r["first"] + r["n"], r["total"])]
            out += [(TOP, level, p) for level, p in Run.missing(runs[0]["place"], runs[-1]["place"] + 1, row["sources"])]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["unit"]] * len(out), pa.int64()), *[pa.array(c, f.type) for c, f in zip(zip(*out), _NODE_SCHEMA)]],
                    names=["unit", "tree", "level", "p"])


PROOFS = ("id long, leaf string, subroot string, root string, proof_sha256 string, proof array<string>, folded_root string, "
          "verified boolean, source string")


def _expand(proofs: bool, root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield expand(row, proofs, root)

    return run


def expand(row: dict, proofs: bool, root: str) -> pa.RecordBatch:
    """Rows of one unit: nodes derived from its leaves and the fetched coordinates, and each leaf's own proof."""
    fetched: dict[str, dict[tuple[int, int], str]] = {}
    for x in row["fetched"] or ():
        fetched.setdefault(x["tree"], {})[x["level"], x["p"]] = x["digest"]
    leaves, at, runs = _hexes(row["leaves"]), 0, []
    for r in row["runs"]:
        run = Run(r["first"], leaves[at:at + r["n"]], r["total"])
        run.derive(fetched.get(_tree(r["source"]), {}))
        runs.append((at, r, run))
        at += r["n"]
    top = Run(row["runs"][0]["place"], [run.levels[-1][1][0] for _, _, run in runs], row["sources"])
    top.derive(fetched.get(TOP, {}))
    derived = top.levels[-1][1][0]
    changed = dict(zip(np.frombuffer(row["at"], "<i4").tolist(), _hexes(row["changed"])))
    out: list[list] = [[] for _ in range(7)]
    for at, r, run in runs:
        subroot, place = run.levels[-1][1][0], r["place"]
        above, first = top.siblings(place), r["first"]
        shared: tuple[int, str] = (-1, "")
        for k in range(r["n"]):
            p = first + k
            if run.total > 1 and shared[0] != p // ARITY:  # leaves of a family share what lies above it
                upper, q = [], p // ARITY
                for level in range(1, depth(run.total)):
                    family, j = run.family(level, q)
                    upper += family[:j] + family[j + 1:]
                    q //= ARITY
                shared = (p // ARITY, "".join(upper) + above)
            if run.total > 1:
                family, j = run.family(0, p)
                proof = "".join(family[:j]) + "".join(family[j + 1:]) + shared[1]
            else:
                proof = above
            folded = top.fold(place, run.fold(p, changed[at + k])) if at + k in changed else derived
            for column, value in zip(out, (leaves[at + k], subroot, root, hashlib.sha256(proof.encode()).hexdigest(),
                                           [proof[i:i + 64] for i in range(0, len(proof), 64)] if proofs else None, folded, folded == root)):
                column.append(value)
    ids = pa.array(np.frombuffer(row["ids"], "<i8"), mask=np.frombuffer(row["nulls"], np.uint8).astype(bool))
    types = [pa.string()] * 4 + [pa.list_(pa.string()), pa.string(), pa.bool_()]
    sources = [r["source"] for _, r, _ in runs for _ in range(r["n"])]
    return pa.RecordBatch.from_arrays(
        [ids, *[pa.array(c, t) for c, t in zip(out, types)], pa.array(sources, pa.string())],
        names=["id", "leaf", "subroot", "root", "proof_sha256", "proof", "folded_root", "verified", "source"])


def manifest(rows: DataFrame, tampered: Column | None = None, instead: Column | None = None, fields: Sequence[str] = FIELDS,
             id: str = "doc_id", source: str = "source", proofs: bool = True, unit: int = UNIT_ROWS) -> DataFrame:
    """``id, leaf, subroot, root, proof_sha256, proof, folded_root, verified, source`` for each row.

    ``proof`` lists the siblings of the leaf from the lowest family to the root's.  Where ``tampered`` holds, the last field is
    read as ``instead`` when the root is folded from the leaf and its siblings; elsewhere the leaf is the original.
    """
    own = [F.col(c) for c in fields]
    digest = leaf(own)
    changed = F.lit(None).cast("string") if tampered is None else F.when(tampered, leaf([*own[:-1], instead]))
    keyed = rows.select(F.col(source).cast("string").alias("source"), F.col(id).cast("long").alias("id"), digest.alias("leaf"),
                        changed.alias("changed"), F.monotonically_increasing_id().alias("row"))
    order = ["source", "id", "leaf", "row"]  # the row number only splits equal rows over partitions
    ranged = keyed.repartitionByRange(shuffle_width(rows, ceiling=1 << 20), *order).sortWithinPartitions(*order)
    units = pin(ranged.select("source", "id", "leaf", "changed").mapInArrow(_units(unit), UNITS))

    runs = units.select("unit", "part", F.posexplode("runs").alias("k", "r")).select("unit", "part", "k", "r.source", "r.n")
    # a source's runs are as many as the units it reaches; a part's are its own rows
    runs = runs.withColumn("first", F.coalesce(F.sum("n").over(
        Window.partitionBy("source").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = pin(runs.withColumn("total", F.sum("n").over(Window.partitionBy("source"))))
    begins = runs.groupBy("part").agg(F.sum((F.col("first") == 0).cast("long")).alias("new"))
    before = begins.withColumn("before", F.coalesce(F.sum("new").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    state = begins.agg(F.sum("new")).first()[0], runs.agg(F.max("total")).first()[0]
    if state[0] is None:
        return rows.sparkSession.createDataFrame([], PROOFS).withColumnRenamed("id", id)
    sources, most = state
    placed = runs.join(small_side(before.select("part", "before")), "part").withColumn("place", F.col("before") - 1 + F.sum(
        (F.col("first") == 0).cast("long")).over(Window.partitionBy("part").orderBy("unit", "k")))
    laid = placed.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("k", "source", "n", "first", "total", "place"))).alias("runs"))
    ready = pin(units.drop("runs").join(laid, "unit").withColumn("sources", F.lit(sources)))

    sizes = runs.where("first = 0").select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("tree"), "total", "source", "unit", "k")
    nodes = _combined(pin(ready.select("runs", "leaves").mapInArrow(_fragments, NODES)), sizes.select("tree", "total"), most)
    # subroots that no unit holds: the uppermost nodes of their trees
    known = nodes.where(F.col("tree") == TOP).select("p")
    places = ready.select(F.explode("runs").alias("r")).where("r.first = 0").select(
        F.coalesce(F.concat(F.lit("s"), "r.source"), F.lit("")).alias("tree"), "r.total", F.col("r.place").alias("p"))
    open_ = pin(places.join(known, "p", "left_anti"))
    roots = nodes.where("p = 0 AND tree <> 'top'").join(small_side(open_.select("tree", "total", F.col("p").alias("place"))), "tree").where(
        F.expr(" + ".join(f"CAST(total > {ARITY ** k} AS INT)" for k in range(15))) == F.col("level"))
    top = pin(nodes.where(F.col("tree") == TOP).unionByName(roots.select(
        F.lit(TOP).alias("tree"), F.lit(0).alias("level"), F.col("place").alias("p"), "digest")))
    top_size = rows.sparkSession.createDataFrame([(TOP, sources)], "tree string, total long")
    top = _combined(top, top_size, sources)
    every = nodes.where(F.col("tree") != TOP).unionByName(top)
    root = top.where(F.col("level") == depth(sources)).first()["digest"]

    asked = pin(ready.select("unit", "runs", "sources").mapInArrow(_requests, "unit long, tree string, level int, p long"))
    fetched = asked.join(every, ["tree", "level", "p"]).groupBy("unit").agg(
        F.collect_list(F.struct("tree", "level", "p", "digest")).alias("fetched"))  # at most 2 x 15 a level and source at the unit's ends
    out = ready.join(fetched, "unit", "left").select("unit", "runs", "ids", "nulls", "leaves", "changed", "at", "sources", "fetched")
    result = out.mapInArrow(_expand(proofs, root), PROOFS)
    return result.withColumnRenamed("id", id)


def _sql_field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"


_SQL_LEAF = " || ".join(_sql_field(c) for c in FIELDS)
_SQL_CHANGED = " || ".join(_sql_field(c) for c in (*FIELDS[:-1], f"translate(text, '{UPPER}', '{LOWER}')"))

ORACLE = f"""
WITH RECURSIVE bits AS (SELECT doc_id, list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda ch: list_transform(range(8), lambda i: ((ord(ch) >> i::INT) & 1)::UBIGINT)))),
    lambda c, b: xor(c >> 1, 3988292384::UBIGINT * (xor(c, b) & 1))) AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
l AS (SELECT doc_id, source, sha256({_SQL_LEAF}) AS leaf,
    CASE WHEN xor(c, 4294967295::UBIGINT) % 5 = 0 THEN sha256({_SQL_CHANGED}) END AS changed,
    CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS tree FROM documents AS d LEFT JOIN bits USING (doc_id)),
r AS (SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS row,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM l),
z AS (SELECT tree, count(*) AS n, row_number() OVER (ORDER BY tree) - 1 AS place FROM r GROUP BY tree),
t AS (SELECT tree, 0 AS level, p, leaf AS digest, n AS size FROM r JOIN z USING (tree)
  UNION ALL SELECT tree, level + 1, p // 16, sha256(string_agg(digest, '' ORDER BY p)), (any_value(size) + 15) // 16 FROM t WHERE size > 1 GROUP BY tree, level, p // 16),
u AS (SELECT 0 AS level, place AS p, digest, (SELECT count(*) FROM z) AS size FROM t JOIN z USING (tree) WHERE size = 1
  UNION ALL SELECT level + 1, p // 16, sha256(string_agg(digest, '' ORDER BY p)), (any_value(size) + 15) // 16 FROM u WHERE size > 1 GROUP BY level, p // 16),
k AS (SELECT tree, max(level) AS high FROM t GROUP BY tree),
nodes AS (SELECT tree, level, p, digest FROM t WHERE size > 1 UNION ALL SELECT 'top', level, p, digest FROM u WHERE size > 1),
path AS (SELECT row, g AS step, tree, g AS level, p // (16 ** g)::BIGINT AS p FROM (SELECT row, tree, p, unnest(range(high)) AS g FROM r JOIN k USING (tree))
  UNION ALL SELECT row, high + g, 'top', g, place // (16 ** g)::BIGINT
    FROM (SELECT row, high, place, unnest(range((SELECT max(level) FROM u))) AS g FROM r JOIN k USING (tree) JOIN z USING (tree))),
f AS (SELECT row, 0 AS step, coalesce(changed, leaf) AS digest FROM r
  UNION ALL SELECT f.row, f.step + 1, sha256(string_agg(CASE WHEN nodes.p = path.p THEN f.digest ELSE nodes.digest END, '' ORDER BY nodes.p))
    FROM f JOIN path ON path.row = f.row AND path.step = f.step JOIN nodes ON nodes.tree = path.tree AND nodes.level = path.level AND nodes.p // 16 = path.p // 16
    GROUP BY f.row, f.step),
e AS (SELECT row, max_by(digest, step) AS folded_root FROM f GROUP BY row),
q AS (SELECT path.row, string_agg(nodes.digest, '' ORDER BY step, nodes.p) AS proof FROM path
    JOIN nodes ON nodes.tree = path.tree AND nodes.level = path.level AND nodes.p // 16 = path.p // 16 AND nodes.p <> path.p GROUP BY path.row)
SELECT doc_id, leaf, s.digest AS subroot, o.digest AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = o.digest AS verified
FROM r JOIN z USING (tree) JOIN u AS s ON s.level = 0 AND s.p = z.place JOIN u AS o ON o.size = 1 JOIN e ON e.row = r.row LEFT JOIN q ON q.row = r.row
"""
