"""The ten operators against brute force on small tables, with nulls, empty and long texts, ties, repeats and empty tables."""

import collections
import math
import re
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import (bit_slices, blocks, boosting, components, katz, language, mixture, near_dup, packs, perplexity,
                           pieces, queries, subword, token_files, toxicity)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, words="the of and river stone light quiet window table green paper orange city north harbour".split()):
    rng = np.random.default_rng(seed)
    return " ".join(words[i] + str(rng.integers(40)) * (rng.random() < 0.5) for i in rng.integers(0, len(words), n))


EDGE = ["", None, "   \t\n ", "One", "one two", "été ÀB naïve 日本語 😀 x", "a " * 400, "x" * 5000, "\n\nline\nline\n other \n",
        "Tab\tand\x0bvertical", "▁ mark ▁x"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = EDGE + [prose(k, 30 + 7 * k) for k in range(25)]
    texts += [texts[20], texts[20] + " extra", texts[21].upper(), " ".join(texts[25].split()[3:])]
    rows = [(k, t, ["en", "de", None][k % 3], ["b", "a", None, "ä", "a"][k % 5], None) for k, t in enumerate(texts)]
    rows += [(20, texts[20], "en", "b", 5), (None, "no id here at all", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- blocks and packs

def test_words_and_hashes_do_not_depend_on_the_block():
    texts = [t or "" for t in EDGE] + ["ab cd", "cd ab"]
    whole = next(blocks.blocks(pa.array(texts)))
    h = whole.word_hashes(whole.words())
    seen = {}
    words = [w for t in texts for w in WORD.findall(t.translate(A_Z))]
    assert len(words) == len(h)
    for w, x in zip(words, h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    small = np.concatenate([b.word_hashes(b.words()) for b in blocks.blocks(pa.array(texts).slice(0), 4)])
    assert small.tolist() == h.tolist()
    sliced = next(blocks.blocks(pa.array(["zz"] + texts).slice(1)))
    assert sliced.word_hashes(sliced.words()).tolist() == h.tolist()


def test_pack_round_trip():
    arrays = [np.arange(5), np.zeros(0, np.int64), np.array([2**63 + 5], np.uint64), np.array([0.25, -1e300])]
    for a, b in zip(arrays, packs.unpack(packs.pack(*arrays))):
        assert a.tolist() == b.tolist()


# ---- 1 language

def test_language_evidence(spark, empty):
    en = [prose(k, 40) for k in range(12)]
    de = [prose(k, 40, "der die und fluss stein licht fenster tisch grün papier stadt hafen".split()) for k in range(12)]
    train = spark.createDataFrame([(t, "en") for t in en] + [(t, "de") for t in de] + [("x", None), (None, "en")], "text string, lang string")
    model = language.fit_text(train)
    assert model.languages == ["de", "en"]
    html = '<html lang="{}"><head><script>der die das</script></head><body>{}</body></html>'
    rows = [(1, "http://a.de/x", html.format("de", de[0])), (2, "http://b.com/", html.format("en", en[0])),
            (3, "http://a.de/y", html.format("de", "")), (4, None, None), (5, "no url", ""), (2, "http://b.com/", html.format("en", en[0]))]
    rows += [(10 + k, "http://a.de/x", html.format("de", de[1 + k])) for k in range(6)]
    rows += [(20 + k, "http://b.com/x", html.format("en", en[1 + k])) for k in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = language.identify_pages(pages.withColumn("language", F.lit(1)), model)
    assert out.columns == ["page_id", "url", "html", *language.RESULT]
    got = {(r.page_id, r.language, r.accepted) for r in out.collect()}
    assert {(1, "de", True), (2, "en", True), (3, "de", False)} <= got  # page 3 has only outer evidence
    assert out.count() == len(rows)
    assert {r.accepted for r in out.where("page_id IN (4, 5)").collect()} == {False}
    assert language.identify_pages(pages.limit(0), model).count() == 0
    none = language.fit_text(empty)
    assert none.languages == []
    assert [r.accepted for r in language.identify_documents(train.withColumn("source", F.lit(None).cast("string")), none).take(1)] == [False]
    wanted = language.identify_pages(pages, model, wanted=["en"]).where("accepted").select("language").distinct().collect()
    assert [r.language for r in wanted] == ["en"]


LANGUAGES = {
    "en": "the of and river stone light quiet window table green paper orange city north harbour when they have would".split(),
    "de": "der die und fluss stein licht fenster tisch grün papier stadt hafen wenn sie haben würde nicht auch zwischen".split()}


def test_language_rejects_gibberish_mixed_and_unmodelled_texts(spark):
    rng = np.random.default_rng(5)

    def words(vocabulary, n):
        return " ".join(rng.choice(vocabulary, n))

    train = spark.createDataFrame([(words(v, 80), k) for k, v in LANGUAGES.items() for _ in range(40)]
                                  + [(words(LANGUAGES["en"], 80), "xx")], "text string, lang string")
    model = language.fit_text(train)
    finnish = "ja ei se että hän oli mutta talo järvi metsä kaupunki päivä yö ihminen tyttö vesi tuli maa taivas vanha".split()
    en, de = LANGUAGES.values()
    cases = {"clean en": lambda n: (words(en, n), "en"), "clean de": lambda n: (words(de, n), "de"),
             "undeclared": lambda n: (words(de, n), None), "with a foreign line": lambda n: (words(en, n) + "\n" + words(de, n // 10), "en"),
             "gibberish": lambda n: (" ".join("".join(map(chr, rng.integers(97, 123, rng.integers(3, 9)))) for _ in range(n)), "en"),
             "halves": lambda n: (words(en, n // 2) + " " + words(de, n // 2), "en"),
             "in turn": lambda n: (" ".join(w for p in zip(rng.choice(en, n), rng.choice(de, n)) for w in p), "en"),
             "unmodelled": lambda n: (words(finnish, n), "en")}
    rows = [(f"{case} {n} {k}", *make(n), "s") for case, make in cases.items() for n in (20, 60, 300) for k in range(10)]
    found = language.identify_documents(spark.createDataFrame(rows, "doc_id string, text string, lang string, source string"), model).collect()
    share = collections.defaultdict(list)
    for r in found:
        share[r.doc_id.rsplit(" ", 2)[0]].append(r.accepted)
    means = {case: np.mean(v) for case, v in share.items()}
    assert all(means[c] >= 0.9 for c in ("clean en", "clean de", "undeclared", "with a foreign line")), str(means)
    assert all(means[c] <= 0.15 for c in ("gibberish", "halves", "in turn", "unmodelled")), str(means)


# ---- 2 near duplicates

def brute_near(rows):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(A_Z))
        sets.append((i, {tuple(w[k:k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def test_near_duplicates_equal_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id IS NOT NULL").collect()]
    base = prose(99, 120).split()
    rng = np.random.default_rng(3)
    for k in range(40):  # a chain of edits: neighbours are similar, the ends are not
        base[int(rng.integers(len(base)))] = f"edit{k}"
        rows.append((500 - k, " ".join(base)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = sorted(tuple(r) for r in near_dup.link(frame).collect())
    assert got == brute_near(rows)


def test_near_duplicates_of_no_rows_and_of_null_ids(spark, empty):
    assert near_dup.link(empty).count() == 0
    got = near_dup.link(spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (8, None)], "doc_id long, text string"))
    assert sorted(map(str, got.collect())) == sorted(map(str, [
        *spark.createDataFrame([(None, 1, None, None), (7, 1, 7, True), (8, 0, 8, True)],
                               "doc_id long, n_shingles long, component_id long, kept boolean").collect()]))


def test_star_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(k, k + 1) for k in range(0, 60)] + [(100, int(x)) for x in range(101, 160)] + [(200, 200)]
    pairs += [tuple(map(int, p)) for p in rng.integers(300, 380, (50, 2))]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    low = {n: n for p in pairs for n in p}
    for _ in range(100):
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    assert got == {n: m for n, m in low.items() if n in got}
    assert {n for p in pairs if p[0] != p[1] for n in p} == set(got)


# ---- 3 token files

def test_token_files_equal_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    extra = spark.createDataFrame([(900, " lead  two  spaces 　 wide x 's <|endoftext|> it's"), (901, "a\r\n b")], "doc_id long, text string")
    frame = docs.select("doc_id", "text").unionByName(extra)
    got = token_files.read(token_files.write(frame, folder, path, parts=3), folder, with_tokens=True).collect()
    want = sorted(((r.doc_id, r.text) for r in frame.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [w[0] for w in want]
    at = 0
    by_id = collections.defaultdict(list)
    for i, t in want:
        by_id[i].append(tok.encode(t or "", add_special_tokens=False).ids + [0])
    for r in got:
        assert r.start == at and r.n_tokens == len(r.tokens)
        assert r.tokens in by_id[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(r.tokens, "<u4").tobytes())
        at += r.n_tokens
    other = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    assert token_files.read(token_files.write(empty, other, path, parts=2), other).count() == 0


# ---- 4 Katz

def brute_katz(rows):
    tokens = [(WORD.findall((t or "").translate(A_Z)) + ["</s>"], train) for _, t, train in rows]
    uni, pairs = collections.Counter(), collections.defaultdict(collections.Counter)
    for ws, train in tokens:
        if train:
            uni.update(ws)
            for h, w in zip(["<s>"] + ws, ws):
                pairs[h][w] += 1
    n, v = sum(uni.values()), len(uni)

    def factors(counts):
        c = collections.Counter(counts)
        return katz.discounts(np.array([c[k] for k in range(1, 7)], float))

    du, db = factors(uni.values()), factors(c for f in pairs.values() for c in f.values())
    lost = any(c <= 5 for c in uni.values())
    p1 = {w: (du[c] if c <= 5 else 1) * c / (n if lost else n + 1) for w, c in uni.items()}
    unknown = 1 - sum(p1.values())
    models = {}
    for h, f in pairs.items():
        total = sum(f.values()) + (not any(c <= 5 for c in f.values()))
        seen = {w: (db[c] if c <= 5 else 1) * c / total for w, c in f.items()}
        models[h] = (seen, (1 - sum(seen.values())) / (1 - sum(p1[w] for w in f)))

    def p(h, w):
        seen, weight = models.get(h, ({}, 1))
        return seen.get(w) or weight * p1.get(w, unknown)

    total = sum(p("the", w) for w in uni) + p("the", None)
    return [(len(ws), sum(uni[w] > 0 for w in ws), n, sum(math.log10((uni[w] + .1) / (n + .1 * (v + 1))) for w in ws),
             sum(math.log10(p(h, w)) for h, w in zip(["<s>"] + ws, ws))) for ws, _ in tokens], total


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_katz_equals_brute_force(spark, docs, buckets):
    rows = [(k, r.text, k % 4 != 0) for k, r in enumerate(docs.orderBy("doc_id", "text", "lang").collect())]
    frame = spark.createDataFrame(rows, "doc_id long, text string, train boolean").withColumn("score", F.lit("clash"))
    got = sorted(katz.score(frame, F.col("train"), buckets=buckets).collect(), key=lambda r: r.doc_id)
    want, total = brute_katz(rows)
    assert abs(total - 1) < 1e-9
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[1:4] == w[:3]
        assert math.isclose(g.base_score, w[3], rel_tol=1e-9) and math.isclose(g.score, w[4], rel_tol=1e-9)


def test_katz_without_training_rows(spark, empty):
    assert katz.score(empty, F.lit(True)).count() == 0
    frame = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_tokens, r.n_known, r.score) for r in katz.score(frame, F.lit(None).cast("boolean")).collect()}
    assert got == {(1, 3, 0, 0.0), (None, 1, 0, 0.0)}


# ---- 5 and 10 classifiers

def labelled(spark, bad):
    rows, labels = [], []
    for k in range(240):
        text, mark = prose(k, 25), k % 4 == 0
        rows.append((k, bad(text, k) if mark else text))
        labels.append((k, int(not mark), int(mark)))
    rows += [(1000, None), (1001, ""), (1002, rows[1][1]), (1, rows[1][1])]
    return (spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


@pytest.mark.parametrize("case", ["toxicity", "subword"])
def test_classifiers_on_held_out_rows(spark, case):
    bad = (lambda t, k: t.replace("and", ["you moron", "scum", "M0RON"][k % 3]) + " you moron") if case == "toxicity" else (
        lambda t, k: " ".join(w.upper() + "!!" for w in t.split()))
    docs, labels = labelled(spark, bad)
    module = toxicity if case == "toxicity" else subword
    out = module.classify(docs, labels)
    rows = out.collect()
    assert len(rows) == 244 and out.columns.count("score") == 1
    truth = {k: int((k % 4 == 0) == (case == "toxicity")) for k in range(240)}
    folds = (4, 2) if case == "toxicity" else (5, 0)
    held = [r for r in rows if r.held_out and r.doc_id < 1000]
    assert {r.doc_id for r in held} == {k for k in range(240) if zlib.crc32(str(k).encode()) % folds[0] == folds[1]}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    by_id = collections.defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add(r.score)
    assert by_id[1] == by_id[1002] and len(by_id[1]) == 1
    assert module.classify(docs.limit(0), labels).count() == 0
    assert module.classify(docs, labels.limit(0)).select("score").distinct().count() == 1


def test_isotonic_rises_and_pools():
    knots, levels = boosting.isotonic(np.array([0.0, 1, 2, 3, 3]), np.array([0, 1, 0, 1, 1]))
    assert (np.diff(levels) >= 0).all() and levels[0] == 0 and levels[-1] == 1
    assert np.interp(1.5, knots, levels) == 0.5


# ---- 6 mixing

def test_mix_meets_targets(spark, docs, empty):
    rows = mixture.mix(docs.withColumn("taken", F.lit("clash"))).collect()
    assert len(rows) == docs.count()
    size = {id(r): len(WORD.findall(r.text or "")) for r in rows}
    assert all(r["size"] == size[id(r)] and 0 <= r.taken <= 3 * r["size"] for r in rows)
    sums = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        s = sums[r.source]
        s[0], s[1], s[2] = s[0] + r["size"], s[1] + r.taken, r.target
    weights = dict(zip(sorted((s for s in sums if s is not None)) + [None], [5, 2, 1, 5]))
    total, left, targets = sum(s[0] for s in sums.values()), set(sums), {}
    budget = float(total)
    while True:  # reshare the excess until nothing is above
        share = budget / sum(weights[s] for s in left)
        above = [s for s in left if share * weights[s] > 3 * sums[s][0]]
        if not above:
            break
        for s in above:
            targets[s] = 3.0 * sums[s][0]
            budget -= targets[s]
            left.remove(s)
    targets |= {s: share * weights[s] for s in left}
    for s, (_, taken, target) in sums.items():
        assert math.isclose(target, targets[s]) and taken == math.floor(target)
    copies = mixture.expand(mixture.mix(docs), docs.columns, length="n_chars").collect()
    assert sum(len(WORD.findall(r.text or "")) for r in copies) == sum(r.taken for r in rows)
    assert mixture.mix(empty).count() == 0


# ---- 7 perplexity rules

def test_base_rules_equal_brute_force(docs, empty):
    model = perplexity.fit(docs)
    for r in perplexity.measure(docs.withColumn("n_words", F.lit("clash")), model).join(docs.select(F.col("doc_id").alias("id"), "text").dropDuplicates(["id"]), "id").collect():
        text = r.text or ""
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        runs = collections.Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
        covered = {k + j for k in range(len(words) - 4) if runs[tuple(words[k:k + 5])] > 1 for j in range(5)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    assert perplexity.judge(empty).count() == 0


def test_kneser_ney_sums_to_one_and_rejects_noise(spark, docs):
    levels = perplexity.fit(docs)
    for context in (levels[-1].codes[0] >> 6, levels[-1].codes[-1] >> 6, 63 << 12 | 62 << 6 | 61):
        p = 10 ** perplexity.score(levels, (context << 6) + np.arange(64))
        assert math.isclose(p.sum(), 1, rel_tol=1e-9)
    rng = np.random.default_rng(8)
    noise = " ".join("".join(map(chr, rng.integers(97, 123, 7))) for _ in range(60))
    rows = [(k, prose(k, 60), "en") for k in range(120)] + [(900, noise, "en"), (901, "few words", "en")]
    got = {r.doc_id: (r.base_failed, r.kept) for r in perplexity.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[900] == (False, False) and got[901] == (True, False)
    assert all(got[k][1] for k in range(120) if not got[k][0])


def judged(spark, rows):
    return {r.doc_id: r.kept for r in perplexity.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}


def syllables(seed, n, of):
    """Invented words of two or three syllables, few of them twice."""
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(of, rng.integers(2, 4))) for _ in range(n))


EN, FI = "th er ing stone ight wh ou and ver ment qu ast".split(), "kä yö ttä ssa järv oin uu lla kki päi nen mme".split()


def test_perplexity_rejects_the_wrong_language_and_low_variety(spark):
    rng = np.random.default_rng(3)
    rows = [(k, syllables(k, 150, EN), "en") for k in range(100)] + [(200 + k, syllables(k, 150, FI), "fi") for k in range(100)]
    rows += [(400 + k, syllables(400 + k, 150, FI), "en") for k in range(3)]
    rows += [(500 + k, " ".join(rng.choice(syllables(k, 12, EN).split(), 150)), "en") for k in range(3)]
    kept = judged(spark, rows)
    assert not any(kept[k] for k in kept if k >= 400)
    assert np.mean([kept[k] for k in kept if k < 400]) >= 0.98


@pytest.mark.parametrize("n", [49, 51])
def test_perplexity_of_a_small_language(spark, n):
    rows = [(k, syllables(k, 150, EN), "en") for k in range(600)] + [(1000 + k, syllables(k, 150, FI), "fi") for k in range(n)]
    rows += [(2000, " ".join("".join(map(chr, np.random.default_rng(8).integers(97, 123, 7))) for _ in range(150)), "fi")]
    kept = judged(spark, rows)
    assert not kept[2000]
    assert np.mean([kept[k] for k in kept if 1000 <= k < 2000]) >= 0.95


def test_perplexity_judges_the_order_of_words(spark):
    """Texts of one order of words: the same words shuffled read as unlikely."""
    parts = ["ka mo ti re".split(), "suel vorn garp biss".split(), "axi emu iro uda".split(), "lump nost quip fent".split()]

    def ordered(seed):
        rng = np.random.default_rng(seed)
        return ["".join(map(str, rng.choice(parts[k % 4], 3))) for k in range(160)]

    rows = [(k, " ".join(ordered(k)), "en") for k in range(120)]
    for k in range(3):
        rows.append((500 + k, " ".join(np.random.default_rng(k).permutation(ordered(900 + k))), "en"))
    kept = judged(spark, rows)
    assert not any(kept[500 + k] for k in range(3))
    assert np.mean([kept[k] for k in range(120)]) >= 0.97


def test_grams_by_brute_force(spark):
    texts = ["Ab é, x", "", " one\ttwo  three\n", "Я b", None, "z"]
    counts = collections.Counter()
    for text in texts:
        run = [0] * (perplexity.ORDER - 1)
        for word in WORD.findall(text or ""):
            for b in word.encode():
                run += [int(perplexity.FIRST[b])] + ([int(perplexity.SECOND[b])] if b > 127 else [])
            run.append(0)
        for k in range(perplexity.ORDER, len(run) + 1):
            counts[sum(c << 6 * j for j, c in enumerate(reversed(run[k - perplexity.ORDER:k])))] += 1
    rows = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    got = {r.code: r.n for r in perplexity.count_grams(rows).collect()}
    assert got == counts
    pairs = {(int(perplexity.FIRST[b]), int(perplexity.SECOND[b])) for b in range(128, 256)}
    assert len(pairs) == 128 and all(0 < c < 64 for pair in pairs for c in pair)


# ---- 8 pieces

def test_pieces_equal_the_library_and_round_trip(spark, docs):
    from sentencepiece import SentencePieceProcessor

    path = queries.tokenizer_path("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=path)
    out = docs.select("text", pieces.encode_udf(path)("text").alias("ids")).withColumn("back", pieces.decode_udf(path)("ids")).collect()
    for r in out:
        assert r.ids == (None if r.text is None else sp.encode(r.text))
        assert r.back == (None if r.text is None else r.text.replace("▁", " "))
    assert all(r.c.round_trip for r in docs.select(pieces.check_udf(path)("text").alias("c")).collect())


def test_viterbi_finds_the_best_segmentation():
    texts = [c.encode() for c in "a b c ab bc abc ca".split()] + [b" ", b" a", "é".encode()]
    scores = np.array([-1.5, -2.25, -2.5, -2.0, -3.25, -5.1, -3.0, -1.0, -2.2, -4.0])
    known = dict(zip([t.decode() for t in texts], scores))
    coder = pieces.Coder(pieces.Pieces(texts, scores, np.ones(len(texts), bool), None, 0), "unigram")
    words = ["abcabc", "cab", "a é b", "bca", "c" * 30 + "ab", "aébc", "b"]

    def best(word):
        table = [0.0] + [-math.inf] * len(word)
        for j in range(1, len(word) + 1):
            table[j] = max(table[i] + known[word[i:j]] for i in range(j) if word[i:j] in known)
        return table[-1]

    for word in words:
        ids, _ = coder.encode(next(blocks.blocks(pa.array([word]))))
        assert b"".join(texts[i] for i in ids).decode() == " " + word
        assert math.isclose(sum(scores[i] for i in ids), best(" " + word))


# ---- 9 top-k

def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(0, 0.3, 7).round(3).tolist()) for k in range(300)]
    rows += [(400 + k, rows[3][1]) for k in range(20)] + [(50, None), (450, [0.1, None]), (460, [float("nan")] * 7), (461, []), (None, rows[0][1]),
                                                           (500, [0.5, -0.5]), (501, [0.25, 1.0]), (10, rows[10][1]), (150, [0.0] * 7)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    queries_ = {}
    for i, v in sorted(good):
        if i % 50 == 0:
            queries_.setdefault(i, v)
    want = set()
    for q, v in queries_.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])}
    assert {tuple(r) for r in bit_slices.top_k(frame).collect()} == want
    assert bit_slices.top_k(frame.limit(0)).count() == 0
    sound = frame.select(F.col("vec_id").alias("id"), bit_slices.quantised(F.col("embedding")).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    small = bit_slices.search(bit_slices.build(sound, 70), sound.where("id % 50 = 0").groupBy("id").agg(F.min("v").alias("v")), group=2)
    assert {tuple(r) for r in small.collect()} == want


def test_token_pieces_are_few_and_joined_ones_equal_the_library():
    import random

    from tokenizers import Tokenizer

    from plumbline.llm import blocks, token_files

    path = queries.tokenizer_path("byte_bpe_50k.json")
    own = token_files.Encoder(path)
    own.encode(next(blocks.blocks(pa.array(["".join(f" {w}{m}" for w in ("alpha", "beta", "gamma") for m in ",.;!?")]))))
    assert len(own.memory.at) - 1 <= 8
    draw = random.Random(7)
    signs = ["a", "Bc", "é", " ", "  ", "\n", "1", "'s", "'", "!", "中", "\u2581", "<|endoftext|>", "<|", "|>", "\x00"]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    got = []
    for k in range(0, len(texts), 100):
        for block in blocks.blocks(pa.array(texts[k:k + 100])):
            ids, n = own.encode(block)
            got += [part.tolist() for part in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [e.ids for e in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]


# ---- pipeline

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark, lambda t, k: " ".join(w.upper() + "!!" for w in t.split()))
    table = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("doc_id") % 3).alias("source"), F.length("text").cast("long").alias("n_chars"))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, before = current.columns, current.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, current, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        current = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert current.columns == columns
        if k == 0:
            assert 150 < current.count() < before
            assert current.where("doc_id < 240 AND doc_id % 4 = 0").count() <= 6
        if k == 2:
            ids = [r.doc_id for r in current.select("doc_id").collect()]
            assert len(ids) == len(set(ids)) and 1 in ids and 1002 not in ids
    assert current.columns == ["doc_id", "source", "n_tokens", "ids"]
    assert current.where("n_tokens <> size(ids)").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == current.count()
