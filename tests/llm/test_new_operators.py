"""Operators 11 to 13, and the contract cases mended with them, against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bit_slices, components, hard_negatives, merkle, near_dup, queries, set_join, training

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def families(nodes):
    return [nodes[k:k + 16] for k in range(0, len(nodes), 16)]


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(f)) for f in families(levels[-1])])
    return levels


def siblings(levels, p):
    out = []
    for nodes in levels[:-1]:
        low = p // 16 * 16
        out.append((nodes[low:p], nodes[p + 1:low + 16]))
        p //= 16
    return out


def expected_manifest(rows):
    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for place, s in enumerate(order):
        for p, (_, _, own, r) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            path = siblings(trees[s], p) + siblings(top, place)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            folded = leaf(r, None if r[1] is None else r[1].translate(A_Z)) if hit else own
            for before, after in path:
                folded = H("".join(before) + folded + "".join(after))
            out.append((r[0], own, trees[s][-1][0], top[-1][0], H("".join("".join(a + b) for a, b in path)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def manifest_of(frame, **options):
    made = merkle.manifest(frame, tampered=F.crc32(F.col("doc_id").cast("string")) % 5 == 0,
                           instead=F.translate("text", merkle.UPPER, merkle.LOWER), **options)
    return sorted((tuple(r) for r in made.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("unit", [1, 7, 100_000])
def test_manifest_equals_the_tree_built_whole(spark, unit):
    rng = np.random.default_rng(3)
    rows = [(int(k), ["Some TEXT", "lower", "", None, "é" * 50][k % 5], ["en", None][k % 2], ["big", "big", "a", None, "ä", ""][min(int(rng.integers(9)), 5)],
             [5, None][k % 2]) for k in rng.permutation(300)]
    rows += [(k, "Own", "en", f"s{k % 40:02d}", 3) for k in range(1000, 1050)]
    rows += [rows[0]] * 20 + [(rows[1][0], "Other", "en", rows[1][3], 1), (None, None, None, None, None), (None, "Null Id", "en", "big", 2)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit(1)).withColumn("part", F.lit("x")).repartition(5)
    assert manifest_of(frame, unit=unit) == expected_manifest(rows)


def test_manifest_of_small_tables(spark):
    for rows in ([], [(5, "One", "en", "s", 3)], [(5, "One", "en", "s", 3), (6, "Two", None, None, None)]):
        assert manifest_of(spark.createDataFrame(rows, SCHEMA)) == (expected_manifest(rows) if rows else [])


def test_manifest_proofs_list_the_siblings(spark):
    rows = [(k, f"T{k}", "en", "s", 2) for k in range(40)]
    for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect():
        assert H("".join(r["proof"])) == r["proof_sha256"] and r["verified"]
        assert len(r["proof"]) == (15 if r["doc_id"] < 32 else 7) + 2


# ---- the set join

def sets_of(text, n=5):
    words = WORD.findall((text or "").translate(A_Z))
    if not words:
        return frozenset()
    return frozenset([" ".join(words)] if len(words) < n else (" ".join(words[k:k + n]) for k in range(len(words) - n + 1)))


def expected_components(rows, n=5):
    sets = [(r[0], sets_of(r[1], n)) for r in rows if r[0] is not None]
    low = {i: i for i, _ in sets}
    changed = True
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return sorted(((r[0], len(sets_of(r[1], n)), None if r[0] is None else low[r[0]]) for r in rows), key=repr)


def edited(words, k, rng):
    words = list(words)
    for at in rng.integers(0, len(words), k):
        words[at] = f"edit{rng.integers(1 << 40)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def similar(spark):
    rng = np.random.default_rng(9)
    texts = ["", None, " \t", "One", "one", "one two", "one two three four", "One two three four five", "one two three four five six"]
    passage = [f"p{k}" for k in range(60)]
    for k in range(60):
        words = [f"w{rng.integers(3000)}" for _ in range(int(rng.choice([6, 9, 14, 30, 70, 150, 600])))]
        texts += [" ".join(words), edited(words, 1, rng), edited(words, max(1, len(words) // 60), rng), " ".join(words[2:]), " ".join(words) + " more"]
        texts.append(" ".join(passage + words[:30]))
    centre = [f"c{k}" for k in range(110)]
    texts += [" ".join(centre)] + [edited(centre, 2, rng) for _ in range(80)]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]
    rows += [rows[20], (rows[21][0], "quite another text under the same id as one above"), (None, texts[30]), (None, None)]
    return rows


def test_set_join_equals_brute_force(spark, similar):
    frame = spark.createDataFrame(similar, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("name", F.lit("x")).repartition(6)
    got = sorted((tuple(r) for r in set_join.join(frame).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == expected_components(similar)


def test_near_duplicates_of_other_widths(spark, similar):
    frame = spark.createDataFrame(similar, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in near_dup.link(frame, width=5).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == expected_components(similar)


def test_set_join_of_an_empty_table(spark):
    assert set_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert set_join.join(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 2


def test_every_layout_finds_every_pair():
    rng = np.random.default_rng(1)
    for band in range(2, 9):
        for layout in set_join.layouts(band):
            for _ in range(12):
                n = int(rng.integers(2 ** band, 2 ** (band + 1)))
                a = rng.integers(0, 1 << 62, n, dtype=np.uint64)
                gone, more = (int(x) for x in rng.integers(0, n // 4 + 1, 2))
                if 100 * (n - gone) < 80 * (n + more) or n - gone + more < n:
                    continue
                b = np.concatenate([a[gone:], rng.integers(0, 1 << 62, more, dtype=np.uint64)])
                key, text, kind = set_join.keys_of(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, n, n + len(b)]), {band: layout})
                held = []
                for t in (0, 1):  # each set gives up as many of its narrow keys as it may, by an order of content alone
                    own = [(k, s) for k, s in zip(key[text == t].tolist(), kind[text == t].tolist())]
                    narrow = sorted(k for k, s in own if not s & set_join.WIDE)
                    spare = max([s >> set_join.SPARE_SHIFT for _, s in own], default=0)
                    held.append({k for k, s in own if s & set_join.WIDE} | set(narrow[spare:]))
                assert held[0] & held[1], (band, layout, n, gone, more)


def test_large_counts_buy_wide_segments():
    few, many = (set_join.allocate({k: n for k in range(2, 12)}) for n in (10, 10 ** 9))
    assert few[2].wide == 0 and many[2].wide > 0 and all(few[b] in set_join.layouts(b) for b in range(2, 12))


def test_one_large_group_of_near_copies(spark):
    rng = np.random.default_rng(4)
    centre = [f"c{k}" for k in range(120)]
    texts = [edited(centre, 2, rng) for _ in range(5000)]
    texts.insert(2500, " ".join(centre))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for made in (near_dup.link(frame, width=4), set_join.join(frame, width=4)):
        assert [tuple(r) for r in made.select("component_id").distinct().collect()] == [(0,)]


def test_components_of_a_hub_and_a_chain(spark):
    links = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(1000, 1200)] + [(7, 7), (5, 0)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(got[k] == 0 for k in range(400)) and all(got[k] == 1000 for k in range(1000, 1201))


# ---- hard negatives

def quantised(v):
    if not v or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [min(max(math.floor(256 * x), -(1 << 63)), (1 << 63) - 1) for x in v]


def expected_negatives(rows, every=10):
    sound = [(i, label, q) for i, v, label in rows if i is not None and label is not None and (q := quantised(v)) is not None]
    out = []
    for i in sorted({i for i, _, _ in sound if i % every == 0}):
        label, q = min((label, q) for j, label, q in sound if j == i)
        others = [(-max(min(sum(a * b for a, b in zip(q, v)), (1 << 63) - 1), -(1 << 63)), j, own == label) for j, own, v in sound if j != i and len(v) == len(q)]
        for p, j, _ in sorted(x for x in others if x[2])[:5]:
            fits = sorted(x for x in others if not x[2] and 50 * -p <= 100 * -x[0] <= 95 * -p)[:3]
            out += [(i, j, rank, x[1], -p, -x[0]) for rank, x in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("rows", [7, 4096])
def test_hard_negatives_equal_brute_force(spark, rows):
    rng = np.random.default_rng(2)
    data = [(int(k), [float(x) for x in rng.normal(size=8) * rng.choice([0.2, 1, 3])], int(rng.integers(4))) for k in range(400)]
    data += [(400 + k, list(data[10 * k][1]), data[10 * k][2] if k % 2 else 3) for k in range(30)]  # equal vectors, equal scores
    data += [(440, [0.0] * 8, 1), (441, None, 1), (442, [None] * 8, 1), (443, [float("nan")] * 8, 1), (444, [1.0] * 3, 1), (450, [1.0] * 3, 1),
             (445, [0.5] * 3, 2), (None, [1.0] * 8, 1), (460, [1.0] * 8, None), (470, [], 1), (480, [1e10] + [0.0] * 7, 2), (481, [9e9] + [1.0] * 7, 3),
             (482, [1e10] + [1.0] * 7, 2)]
    data.append(data[33])
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("rank", F.lit(1)).repartition(4)
    got = hard_negatives.mine(frame, frame.where("vec_id % 10 = 0"), rows=rows, group=11)
    found = sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert found == expected_negatives(data)
    none = hard_negatives.mine(frame.limit(0), frame.limit(0))
    assert none.count() == 0


def test_coordinate_ranges_prune_and_keep_every_row():
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(5, 16))
    values = np.floor(256 * (centre[rng.integers(0, 5, 2000)] + 0.05 * rng.normal(size=(2000, 16)))).astype(np.int64)
    b = hard_negatives.Bucket(hard_negatives.bucket(0, np.arange(2000), values))
    length = hard_negatives.lengths(values)
    need = (0.9 * length[:20] * b.longest).astype(np.int64)
    a, row, score = hard_negatives.reached(b, np.arange(20), values[:20], length[:20], need)
    all_scores = values[:20] @ values.T
    want = {(i, j) for i, j in zip(*np.nonzero(all_scores >= need[:, None])) if i != j}
    assert set(zip(a.tolist(), row.tolist())) == want and (score == all_scores[a, row]).all()


# ---- contract cases

def test_top_k_of_huge_components(spark):
    data = [(0, [1e10, 1.0]), (50, [-1e10, 2.0]), (1, [1e10, -1.0]), (2, [3e38, 1.0]), (3, [0.5, 0.5])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in bit_slices.top_k(frame).collect()}
    v = {i: quantised(x) for i, x in data}
    for q in (0, 50):
        exact = sorted((-max(min(sum(a * b for a, b in zip(v[q], v[j])), (1 << 63) - 1), -(1 << 63)), j) for j in v if j != q)
        assert [got[q, k + 1] for k in range(4)] == [(j, -s) for s, j in exact]


def test_a_spelled_out_special_token_is_one_id(spark, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    from plumbline.llm import token_files
    text = "a <|endoftext|> b"
    manifest = token_files.write(spark.createDataFrame([(1, text)], "doc_id long, text string"), f"{tmp_path}/t", path)
    row = token_files.read(manifest, f"{tmp_path}/t").first()
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids + [0]
    assert row["n_tokens"] == len(ids) and row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_sample_takes_the_smallest_text_of_an_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None), (None, "z")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, 7)], "doc_id long, toxic int")
    got = sorted(tuple(r) for r in training.labelled_sample(docs, labels, "toxic", 1, 9, 10).select("doc_id", "text", "label").collect())
    assert got == [(1, "a", 1), (2, None, 0)]
