"""Printed tables, integrity, style and scans."""

import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions import fixed_writing as fw
from plumbline.operators import compare as cp
from plumbline.operators import evaluation as ev
from plumbline.operators import forensics as fo
from plumbline.operators import integrity as it
from plumbline.operators import scans as sc
from plumbline.operators import style as st
from plumbline.sources import readers, tables, writers


def cells_of(frame, header, rows):
    data = [(1, 1, i, j, header[j], str(v)) for i, row in enumerate(rows) for j, v in enumerate(row)]
    return frame(data, "d int, table_no long, row_no long, col_no long, header string, raw string")


def test_pipe_tables_both_forms(frame):
    text = ("intro\n### 表1 Means\n| a | b |\n|---|:-:|\n| 1 | 2 |\n| 3 | 4 |\nend\n\n"
            "x | y\n5 | 6\n7 | 8\n\n|---|---|\nlone | row\n")
    df = frame([(1, text)], "d int, text string")
    got = [(r["table_no"], r["row_no"], r["header"], r["raw"]) for r in
           tables.pipe_tables(df, ["d"]).orderBy("table_no", "row_no", "col_no").collect()]
    assert got == [(1, 0, "a", "1"), (1, 0, "b", "2"), (1, 1, "a", "3"), (1, 1, "b", "4"),
                   (2, 0, "x", "5"), (2, 0, "y", "6"), (2, 1, "x", "7"), (2, 1, "y", "8")]
    assert tables.pipe_tables(df, ["d"]).where("table_no = 1").first()["title"] == "表1 Means"


def test_group_rows_shapes(frame):
    cells = cells_of(frame, ["g", "n", "M", "SD"], [["A", "30", "3.50", "0.40"], ["B", "2.10", "0.30", ""],
                                                    ["C", "3.20±0.10", "", ""], ["D", "12", "4.5", ""]])
    got = {r["label"]: (r["n"], r["mean"], r["sd"]) for r in cp.group_rows(cells, ["d"]).collect()}
    assert got == {"A": (30, 3.5, 0.4), "B": (None, 2.1, 0.3), "C": (None, 3.2, 0.1), "D": (12, 4.5, None)}


def test_digits_fire_on_copied_tail_only(frame):
    good = [[f"{i * 1.37 + 0.01:.2f}"] for i in range(60)]
    bad = [[f"{i}.37"] for i in range(40)] + [[f"{i}.{i % 10}9"] for i in range(5)]
    assert fo.check_last_digits(cells_of(frame, ["x"], good), ["d"]).count() == 0
    assert fo.check_tails(cells_of(frame, ["x"], good), ["d"]).count() == 0
    cells = cells_of(frame, ["x"], bad)
    assert fo.check_last_digits(cells, ["d"]).count() == 1
    assert fo.check_tails(cells, ["d"]).first()["metric"]["tail"] == 37
    coarse = cells_of(frame, ["x"], [[f"{i}.5"] for i in range(40)])
    assert fo.check_last_digits(coarse, ["d"]).count() == 0


def test_progressions(frame):
    values = ["1.5", "2.0", "2.5", "3.0", "3.5", "9.1", "4.2"]
    cells = cells_of(frame, ["x", "year"], [[v, str(2000 + i)] for i, v in enumerate(values)])
    row = fo.progression_runs(cells, ["d"]).collect()
    assert [(r["header"], r["kind"], r["first"], r["last"]) for r in row] == [("x", "arithmetic", 1, 5)]
    cells = cells_of(frame, ["x"], [["1.1"], ["2.2"], ["4.4"], ["8.8"], ["17.6"], ["3.0"]])
    assert fo.progression_runs(cells, ["d"]).first()["kind"] == "geometric"


def test_totals_and_percentages(frame):
    cells = cells_of(frame, ["g", "count", "percent"], [
        ["a", "10", "20.0"], ["b", "15", "30.0"], ["c", "25", "50.0"], ["合计", "50", "100.0"]])
    assert fo.check_totals(cells, ["d"]).count() == 0 and fo.check_percentages(cells, ["d"]).count() == 0
    wrong = cells_of(frame, ["g", "count", "percent"], [
        ["a", "10", "26.0"], ["b", "15", "30.0"], ["c", "25", "50.0"], ["合计", "53", "100.0"]])
    assert {r["level"] for r in fo.check_totals(wrong, ["d"]).collect()} == {"low"}
    other = cells_of(frame, ["g", "count", "percent"], [
        ["a", "10", "60.0"], ["b", "15", "70.0"], ["c", "25", "80.0"]])
    assert {r["status"] for r in fo.percent_rows(other, ["d"]).collect()} == {"abstain"}


def test_table_grim_and_participation(frame):
    cells = cells_of(frame, ["g", "n", "均值"], [["a", "30", "3.46"], ["b", "30", "3.47"], ["c", "200", "3.46"]])
    got = {r["mean_text"] + "/" + str(int(r["n"])): r["verdict"] for r in fo.grim_rows(cells, ["d"]).collect()}
    assert got == {"3.46/30": "impossible", "3.47/30": "ok", "3.46/200": "abstain"}
    state = {r["family"]: r["state"] for r in fo.participation(cells, ["d"]).collect()}
    assert state["F7"] == "applicable" and state["F1"] == "abstained" and len(state) == 7


def test_votes_fold_dependent_kinds(frame):
    rows = [(1, 1, "F1", "digit", "mid"), (1, 1, "F2", "tail", "mid"), (2, 1, "F1", "digit", "mid"),
            (2, 1, "F3", "precision", "low"), (3, 1, "F4", "progression", "low"), (3, 1, "F5", "relation", "mid"),
            (4, 1, "F6", "", "mid")]
    df = frame(rows, "d int, table_no int, family string, `group` string, level string")
    got = {(r["d"], r["family"]): r["level"] for r in fo.fuse_votes(df, ["d"]).collect()}
    assert got[(1, "F1")] == "low" and got[(2, "F1")] == "mid" and got[(3, "F5")] == "low" and got[(4, "F6")] == "mid"


PAPER = """摘要
本文研究学习。
关键词：a；b；c
如图 1 所示，已有研究支持 [1,3-4]，另见[9]；区间 [0,1] 不算引用，a[2] 也不算。见图 3。
图 1 框架
图 2 结果
参考文献
[1] 张三. 学习投入研究综述[J]. 心理学报, 2020, 36(4): 12-18.
[2] 李四. 统计学原理[M]. 2019.
[3] 王五, 赵六, 钱七, 孙八. 在线学习研究[J]. 教育学报, 2030, 3(1): 1-9.
[4] 张三. 学习投入研究综述[J]. 心理学报, 2020, 36(4): 12-18.
致谢
谢谢。
"""


def test_lint_of_a_paper(frame):
    df = frame([(1, PAPER)], "d int, text string")
    got = {(r["category"], r["issue"]): (r["priority"], r["n"]) for r in it.lint(df, ["d"], 2024).collect()}
    assert got[("citations", "not_listed")] == ("P0", 1)
    assert got[("citations", "not_cited")] == ("P1", 1)
    assert got[("references", "publisher")] == ("P1", 1)
    assert got[("references", "year_in_future")] == ("P1", 1)
    assert got[("references", "many_authors")] == ("P2", 1)
    assert got[("references", "duplicate_title")] == ("P1", 1)
    assert got[("figure", "not_captioned")] == ("P1", 1) and got[("figure", "not_mentioned")] == ("P2", 1)
    sections = it.split_sections(df).first()
    assert sections["tail"].strip() == "谢谢。" and "[4]" in sections["refs"]


def test_author_year_citations(frame):
    text = ("As shown (Smith, 2020; Doe et al., 2019) and (Brown, 2001) and (Lee and Kim, 2018).\nReferences\n"
            "Smith A. Title one of work[J]. J, 2020, 3(1): 1-2.\nDoe B. Title two of work[J]. J, 2019, 3(1): 1-2.\n"
            "Lee C. Title three of work[J]. J, 2018, 3(1): 1-2.\n")
    row = it.citation_check(frame([(1, text)], "d int, text string"), ["d"]).first()
    assert (row["style"], row["entry_mode"], row["n_author_year"], row["author_year_missing"]) == (
        "author_year", "implicit", 4, 1)


def test_typography_and_structure(frame):
    text = "这是一段足够长的中文文本,用来检查标点；；以及（不成对的括号。还有很多...\n第一章 绪论\n第三章 方法\n"
    df = frame([(1, text)], "d int, text string")
    got = {r["rule"]: r["n"] for r in it.typography_check(df, ["d"]).collect()}
    assert got == {"half_width_punctuation": 1, "repeated_punctuation": 1, "ellipsis": 1, "unbalanced_pair": 1}
    assert it.structure_check(df, ["d"]).first()["missing_chapters"] == [2]


def test_causal_wording_needs_correlation_only(frame):
    rows = [(1, "采用Pearson相关。手机使用导致焦虑。"), (2, "采用Pearson相关。前人研究发现手机使用导致焦虑。"),
            (3, "采用Pearson相关与独立样本T检验。手机使用导致焦虑。"), (4, "手机使用导致焦虑。")]
    got = [r["d"] for r in it.causal_wording(frame(rows, "d int, text string"), ["d"]).collect()]
    assert got == [1]


def test_hypothesis_coverage(frame):
    rows = [(1, "H1 a. H2 b. H3 c. H4 d. t(28) = 2.31, p = 0.028."), (2, "假设1。假设 3 个因素。"),
            (3, "H1 H2 H3. " + "t = 2.1, p = 0.04 " + "x" * 400 + " F = 3.2 " + "y" * 400 + " p = 0.03")]
    got = {r["d"]: (r["n_declared"], r["n_tests"], r["status"]) for r in
           it.hypothesis_coverage(frame(rows, "d int, text string"), ["d"]).collect()}
    assert got[1] == (4, 1, "uncovered") and got[2][2] == "abstain" and got[3] == (3, 3, "ok")


def test_hype_and_models(frame):
    rules = fw.chinese_style()
    df = frame([("本方法显著提高了准确率。",), ("本方法显著提高了 12% 的准确率。",), ("采用LSTM建模。",),
                ("因为序列很长，采用LSTM建模。",)], "t string")
    got = df.select(st.unsupported_hype(F.col("t"), rules.hype).alias("h"),
                    st.unjustified_models(F.col("t"), rules.redlist).alias("m")).collect()
    assert [(r["h"], r["m"]) for r in got] == [(1, 0), (0, 0), (0, 1), (0, 0)]


def test_overlapping_hype_windows_match_python(frame):
    text = "tionon abc tionon 7 tionon" + "x" * 40 + "tionon"
    want = sum(not re.search(fw.NUMBER_AFTER, text[m.end():m.end() + 30]) for m in re.finditer("tionon", text))
    got = frame([(text,)], "t string").select(st.unsupported_hype(F.col("t"), ["tionon"])).first()[0]
    assert got == want


def test_style_score_bands(frame):
    rules = fw.chinese_style()
    dull = "综上所述这个方法具有重要意义。此外它具有广阔的应用前景。" * 20 + "作为一个AI我无法回答。"
    plain = "实验用了三十只鼠，测了七天的体重与心率，记录在表二。" + "样本来自两所学校的四个班级，男女各半，年龄从九岁到十二岁不等，家长都签了字。"
    out = {r["d"]: r for r in st.style_score(st.style_metrics(
        frame([(1, dull), (2, plain)], "d int, text string"), ["d"], rules)).collect()}
    assert out[1]["score"] >= 75 and out[1]["level"] == "high"
    assert out[2]["level"] == "low"


def test_style_view_and_gate(frame):
    df = frame([("正文。“这是一段受访者说的原话内容”\n参考文献\n[1] 张三.",)], "t string")
    assert df.select(st.style_view(F.col("t"))).first()[0].strip() == "正文。（…）"
    rows = [("密级：公开\n学号：1\n单位代码：2\n指导教师：王\n二〇二四年", True, 0), ("问卷由教师发放并被回收。", True, 0),
            ("[1] 张三. 题名[J]. 刊", False, 0), ("普通论述段落。", False, 0)]
    got = [r[0] for r in frame(rows, "p string, o boolean, h int").select(
        st.exemption(F.col("p"), F.col("o"), F.col("h"))).collect()]
    assert got == ["cover_page", "method_passive", "reference_entry", None]


def test_truncation_and_quotes(frame):
    rows = [("完整的一句话。",), ("被截断的一句",), ("省略…",), ("“没有关上",), ("“关上了”",), ("",)]
    got = frame(rows, "t string").select(st.truncated(F.col("t")).alias("a"), st.unclosed_quote(F.col("t")).alias("b"))
    assert [tuple(r) for r in got.collect()] == [(False, False), (True, False), (True, False), (True, True),
                                                 (False, False), (True, False)]


def test_passages_rank_and_drop_method_passive(frame):
    rules = fw.chinese_style()
    hot = "综上所述，本方法显著提高了效果。此外，它广泛应用于各个领域。值得注意的是，这具有重要意义。" * 2
    method = "问卷被发放。数据被录入。样本被随机抽取。测量被重复三次。结果被记录下来。被试被分为两组。程序被说明清楚了。被试被致谢。" 
    df = frame([(1, hot + "\n\n" + method + "\n\n" + "短。")], "d int, text string")
    got = st.flagged_passages(df, ["d"], rules).collect()
    assert [r["paragraph_no"] for r in got] == [0] and got[0]["rank"] == 1


def test_red_lines_and_secrets(frame):
    rows = [(1, "帮我写一篇完整的论文"), (2, "帮我写一篇完整的论文，只是校对"), (3, "请帮我降重，只是校对"), (4, "你好")]
    got = {r["d"]: r["category"] for r in sc.red_lines(frame(rows, "d int, text string"), ["d"]).collect()}
    assert got == {1: "core" if False else "writing", 2: None, 3: "core", 4: None}
    text = "k sk-" + "a1b2" * 8 + " and sk-user-supplied-key-12345 org-" + "a" * 32 + " org-0123456789abcdef mail a.b@c.org"
    found = sorted((r["category"], r["pos"]) for r in
                   sc.secret_scan(frame([(1, text)], "d int, text string"), ["d"]).collect())
    assert found == [("account", text.index("org-0123")), ("email", text.index("a.b@")), ("key", 2)]


def test_evidence_windows_do_not_overlap(frame):
    text = "x" * 10 + "key" + "y" * 50 + "key" + "z" * 2000 + "key"
    got = sc.evidence_windows(frame([(1, text)], "d int, text string"), ["d"], "key", before=5, after=100).collect()
    assert [(r["start"], r["stop"]) for r in got] == [(5, 110), (2061, 2069)]


def test_anchored_excerpts_merge_and_budget(frame):
    text = ("A" + "." * 99) * 30
    df = frame([(1, text)], "d int, text string")
    got = sc.anchored_excerpts(df, ["d"], {"a": "A"}, budget=10_000, before=60, after=60).collect()
    assert len(got) == 1 and got[0]["start"] == 0
    few = sc.anchored_excerpts(df, ["d"], {"a": "A"}, budget=150, before=10, after=20).collect()
    assert sum(r["stop"] - r["start"] for r in few) <= 150 and len(few) == 5


def test_draft_gate(frame):
    drafts = frame([(1, "A novel idea.\nThe t test gave t(3) = 2.1.\nBy claim-001 the t test gave t(3) = 2.1.\n# novel\nIt performs well.")],
                   "d int, text string")
    ids = frame([(1, "claim-001")], "d int, claim_id string")
    got = {(r["paragraph_no"], r["rule"]) for r in sc.draft_gate(drafts, ["d"], ids).collect()}
    assert got == {(0, "praise_without_number"), (1, "result_without_claim"), (4, "vague_phrase")}


def test_front_matter(frame):
    rows = [(1, "密 级：公开\n学 号：1"), (2, "正文提到学号一次。" + "字" * 900), (3, "密级 学号 分类号 " + "字" * 1500)]
    kept = [r["d"] for r in readers.drop_front_matter(frame(rows, "d int, text string")).collect()]
    assert kept == [2]


def test_readers_and_writers(spark, frame, tmp_path):
    gbk = tmp_path / "a.csv"
    gbk.write_bytes("姓名,成绩\n张三,90\n李四,85\n".encode("gbk"))
    df = readers.read_csv(spark, str(gbk))
    assert df.columns == ["姓名", "成绩"] and df.agg(F.sum("成绩")).first()[0] == 175
    bom = tmp_path / "b.csv"
    bom.write_bytes("﻿id,v\n1,2\n".encode())
    assert readers.read_csv(spark, str(bom)).columns == ["id", "v"]
    rules = tmp_path / "r.json"
    rules.write_text('{"rules": [{"name": "s", "match": ["score"], "min": 0, "max": 100}, {"name": "none"}]}')
    assert [r["name"] for r in readers.read_rules(spark, str(rules)).collect()] == ["s"]
    source = str(tmp_path / "in")
    frame([(1,)], "a int").write.parquet(source)
    data = spark.read.parquet(source)
    with pytest.raises(ValueError):
        writers.write_copy(data, source)
    writers.write_copy(data, str(tmp_path / "out"))
    issues = frame([("x", "high")], "check string, level string")
    for _ in range(2):
        writers.append_issues(issues, str(tmp_path / "runs"), "r1")
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 1


def test_wilson_and_rates(frame):
    low, high = ev.wilson(F.lit(8), F.lit(10))
    row = frame([(1,)], "a int").select(low, high).first()
    assert row[0] == pytest.approx(49.02, abs=0.01) and row[1] == pytest.approx(94.33, abs=0.01)
    none = frame([(0, 0)], "k int, n int").select(*ev.wilson(F.col("k"), F.col("n"))).first()
    assert none[0] is None
    rows = [("真", "真"), ("假", "假"), ("存疑", "假"), ("假", "真")]
    c = ev.rates(ev.agreement_counts(frame(rows, "predicted string, label string"), [])).first()
    assert (c["strict_rate"], c["direction_rate"], c["specificity"], c["false_coverage"], c["missed"]) == (
        50.0, 75.0, 100.0, 50.0, 1)


def test_trials_list_what_they_leave_out(frame):
    rows = [(t, "真", "真", t == 2) for t in (1, 2, 3) for _ in range(4)] + [(4, "真", "真", False)]
    df = frame(rows, "trial int, predicted string, label string, fell boolean")
    good, out = ev.trial_summary(df, [], "trial", 4, "fell")
    assert good.first()["trials"] == 2
    assert {r["trial"]: r["reason"] for r in out.collect()} == {2: "fallback", 4: "incomplete"}


def test_wide_citation_ranges_are_whole(frame):
    df = frame([("a [1-60] b [3, 10-70] c [7] d [9-2] e",)], "body string")
    uncut, cut = df.select(it.cited_numbers(F.col("body")), it.cited_numbers(F.col("body"), 50)).first()
    assert uncut == [*range(1, 61), 3, *range(10, 71), 7] and cut == [7]


def test_long_abstracts_are_found_unless_cut(frame):
    from plumbline.functions import fixed_text as ft
    from plumbline.operators import claims as cl

    df = frame([("摘要\n" + "字" * 6000 + "\n关键词：甲；乙\n正文",)], "text string")
    whole, cut = df.select(cl.abstract_text(F.col("text")), cl.abstract_text(F.col("text"), longest=ft.ABSTRACT_MAX)).first()
    assert whole is not None and len(whole) >= 6000 and cut is None


def entries_of(frame, refs):
    row = it.with_entries(frame([(1, refs)], "d int, refs string")).first()
    return row["entry_mode"], [(e["num"], e["entry"]) for e in row["entries"]]


def test_entries_pulled_into_the_line_before(frame):
    got = entries_of(frame, "[1] Smith A. One[J]. 2019. [2] Lee B. Two[J]. 2020.[3]  Kim C. Three\ncontinued. 2021.\n[4] Fox D. Four, 2022.")
    assert got == ("explicit", [
        (1, "Smith A. One[J]. 2019."), (2, "Lee B. Two[J]. 2020."), (3, "Kim C. Three continued. 2021."), (4, "Fox D. Four, 2022.")])
    # a number that does not follow the last one stays text, as does one in the middle of a sentence
    got = entries_of(frame, "[1] As in Lee. [5] and later [2] again. [2 ] Real two.\n[7] Seven. [3] no. [8] Eight.")
    assert got == ("explicit", [
        (1, "As in Lee. [5] and later [2] again."), (2, "Real two."), (7, "Seven. [3] no."), (8, "Eight.")])
    # one line alone; two numbers side by side; dotted numbers are not followed
    assert entries_of(frame, "[1] One. [2] Two.")[1] == [(1, "One."), (2, "Two.")]
    assert entries_of(frame, "[1][2] Both.\n[3] Three.")[1] == [(1, ""), (2, "Both."), (3, "Three.")]
    assert entries_of(frame, "1. One, 2019. 2. Two.\n3. Three.")[1] == [(1, "One, 2019. 2. Two."), (3, "Three.")]
    assert entries_of(frame, "") == ("none", []) and entries_of(frame, None)[1] in ([], None)


def test_many_numbers_in_one_line(frame):
    refs = " ".join(f"[{i}] Work {i}. [1] seen." for i in range(1, 1000)) + "\n[1000] no number of three digits\n[1] last."
    mode, got = entries_of(frame, refs)
    assert mode == "explicit" and [n for n, _ in got] == [*range(1, 1000), 1]
    assert got[1] == (2, "Work 2. [1] seen.") and got[-1] == (1, "last.")


def runs_by_hand(values):
    """Longest run of a column as ``(kind, first, last)``, numbered from 1."""
    found = []
    for kind in ("arithmetic", "geometric"):
        change = [None]
        for x, y in zip(values, values[1:]):
            if kind == "arithmetic":
                change.append(y - x if y != x else None)
            else:
                change.append(y / x if x != 0 and abs(y / x - 1) >= 1e-9 else None)
        tolerance, start = (1e-9 if kind == "arithmetic" else 1e-6), None
        for i in range(1, len(values) + 1):
            now = change[i] if i < len(values) else None
            before = change[i - 1]
            if start is not None and (now is None or before is None or abs(now - before) > tolerance * max(abs(now), 1.0)):
                if i - start + 1 >= fo.MIN_RUN:
                    found.append((-(i - start), kind, start, i))
                start = None
            if start is None and now is not None:
                start = i
    return min(found)[1:] if found else None


@pytest.mark.parametrize("chunk", [1, 2, 7, 4096])
def test_progression_runs_do_not_depend_on_chunks(frame, chunk):
    import random
    r = random.Random(5)
    columns = []
    for c in range(12):
        values = []
        while len(values) < 60:
            kind, n, x = r.randrange(4), r.randrange(2, 14), round(r.uniform(1, 9), 2)
            values += [[x + 0.75 * k for k in range(n)], [x * 2.0 ** k for k in range(n)], [x] * n,
                       [round(r.uniform(-9, 9), 2) for _ in range(n)] + [0.0]][kind]
        columns.append([round(v, 4) for v in values])
    rows = [(1, 1, 3 * i + i % 2, c, f"h{c}", str(v) if i % 17 else "none")
            for c, column in enumerate(columns) for i, v in enumerate(column)]
    cells = frame(rows, "d int, table_no long, row_no long, col_no long, header string, raw string")
    want = {}
    for c, column in enumerate(columns):
        run = runs_by_hand([v for i, v in enumerate(column) if i % 17])
        if run:
            want[c] = run
    got = {x["col_no"]: (x["kind"], x["first"], x["last"]) for x in fo.progression_runs(cells, ["d"], chunk).collect()}
    assert got == want and len(want) > 8


def test_group_rows_large_sizes(frame):
    cells = cells_of(frame, ["g", "n", "M", "SD"], [["A", "7200", "3.50", "0.40"], ["B", "1000", "2.50", "0.30"]])
    got = {r["label"]: (r["n"], r["mean"], r["sd"]) for r in cp.group_rows(cells, ["d"]).collect()}
    assert got == {"A": (7200, 3.5, 0.4), "B": (1000, 2.5, 0.3)}
    plain = cells_of(frame, ["g", "M", "SD"], [["A", "7200", "35"]])
    assert [(r["n"], r["mean"], r["sd"]) for r in cp.group_rows(plain, ["d"]).collect()] == [(None, 7200.0, 35.0)]


def test_assigned_secrets_case(frame):
    run = "9233A8ECF7C5B09FE5949719"
    df = frame([(1, f"ab token = '{run}'"), (2, f"TOKEN = {run}"), (3, f"mytoken = {run}"), (4, f"\u00dftoken: {run}")],
               "d int, text string")
    some = sc.assigned_secrets(df, ["d"], any_case=False).collect()
    assert sorted((r["d"], r["pos"]) for r in some) == [(1, 3), (4, 1)]
    assert sorted(r["d"] for r in sc.assigned_secrets(df, ["d"]).collect()) == [1, 2, 4]


def test_front_matter_takes_blanks_out_once(frame):
    df = frame([(1, "UDC 1\n分 类 号 7\nx"), (2, "UDC"), (3, "UDC 分类号 " + "x" * 900), (4, "UDC 分类号 学号 " + "x" * 900),
                (5, "UDC 分类号 学号 " + "x" * 2000), (6, None)], "d int, text string")
    out = readers.drop_front_matter(df)
    assert sorted(r["d"] for r in out.collect()) == [2, 3, 5]
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_replace") == 1


def test_rules_that_need_han(frame):
    from plumbline.functions import text as tx

    yes = ["综上所述[，,]", "旨在|致力于", "(丰富|补充)了.{0,12}(理论|文献)", "(?:表|图)中?", "[一-鿿]{2,}", "(?<!a)分析"]
    no = ["yyds|破防", "——", "的?a", "(的)?a", "的*", "的{0,2}x", "(?=的).", "(?!的)a", "[的a]", "[^的]", "(?i)的", "a|的", r"[\\])的]|b", ""]
    assert [tx.needs_han(p) for p in yes] == [True] * len(yes) and [tx.needs_han(p) for p in no] == [False] * len(no)
    rules = fw.chinese_style().phrases
    df = frame([(1, "plain yyds text"), (2, "综上所述，旨在 yyds"), (3, None)], "d int, text string")
    got = {r["d"]: r["total_hits"] for r in st.phrase_density(df, ["d"], rules).collect()}
    assert got == {1: 1, 2: 3, 3: None}


LATIN = fw.StyleRules(
    sentence_end=r"[.!?;\n]+", min_letters=(r"[a-z]", 4), connectives=(" and ",), passive=" was ", hype=("hugely",),
    residue=("token = ",), redlist=("clown",), generic=("loser",), phrases=(("en", " the "),), token="[a-z]+")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gram_shares_keep_no_strings_of_grams(frame):
    texts = ["", None, "one", "a b a b a b a b", "x y z u v w x y z u v", "The the, THE the the the"]
    out = st.style_metrics(frame(list(enumerate(texts)), "d int, text string"), ["d"], LATIN)
    for r in out.collect():
        t = re.findall("[a-z]+", (texts[r["d"]] or "").lower())
        share = lambda k: len({tuple(t[i:i + k]) for i in range(len(t) - k + 1)}) / (len(t) - k + 1)  # noqa: E731, B023
        assert r["pair_variety"] == (share(2) if len(t) > 1 else 1.0)
        assert r["five_repeat"] == (1 - share(5) if len(t) > 4 else 0.0)
    assert "array_distinct(" not in _plan(out.select("pair_variety", "five_repeat"))


def test_sentences_stop_at_the_letters_they_need(frame):
    df = frame([("1234 abc. 12a b c d. abcd ef. ab=cdef gh.",)], "t string")
    out = df.select(st.sentence_array(F.col("t"), LATIN).alias("s"))
    assert out.first()["s"] == ["12a b c d", "abcd ef"]
    assert "regexp_count" not in _plan(out)


def test_first_mention_of_a_model_at_any_place(frame):
    texts = ["x" * i + "clown" + "y" * j + "because" + "z" * 50 + "clown" for i in (0, 3, 39, 40, 41, 90) for j in (0, 50, 54, 60)]
    texts += ["y" * 20 + "because" + "x" * i + "clown" for i in (20, 39, 40, 41)] + ["clown clown because", "none", ""]
    out = frame([(t,) for t in texts], "t string").select("t", st.unjustified_models(F.col("t"), ("clown",)).alias("m"))
    for r in out.collect():
        first = re.search(r"([\s\S]{0,40}(?:clown)[\s\S]{0,60})", r["t"])
        bad = first is not None and not re.search(fw.JUSTIFICATION, first[1])
        assert r["m"] == (len(re.findall("clown", r["t"])) if bad else 0)
    assert "substring" in _plan(out)


def test_signals_of_a_passage_are_counted_once(frame):
    out = st.flagged_passages(frame([(1, "x")], "d int, text string"), ["d"], LATIN)
    assert _plan(out).count("token = ") == 1


def test_columns_are_sent_to_the_cells_and_parsed_once(frame, monkeypatch):
    cells = cells_of(frame, ["a", "b", "c"], [[f"{i}.25", i, f"{i} of {i}"] for i in range(9)] + [["x", None, "y"]])
    out = {r["col_no"]: r for r in fo.numeric_columns(cells, ["d"]).collect()}
    assert sorted(out) == [0, 1] and out[1]["int_col"] and (out[0]["n"], out[0]["n_decimals"], out[0]["coarse"], out[0]["int_col"]) == (9, 9, False, False)
    assert "strategy=broadcast" in _plan(fo.numeric_cells(cells, fo.numeric_columns(cells, ["d"]), ["d"]))
    calls, real = [], fo.numeric_columns
    monkeypatch.setattr(fo, "numeric_columns", lambda *a: calls.append(1) or real(*a))
    fo.audit_tables(cells, ["d"]).collect()
    assert len(calls) == 1


def test_draft_gate_shuffles_no_paragraph(frame):
    text = ("A novel idea. It has 3 parts.\n\nThis novel 7 idea\n# A novel title\nIt performs well; so do all.\n"
            "The t test gave t(30) = 2.10.\nBy claim-1 the t test gave t(30) = 2.10, which is novel.\nplain\nA robust one by claim-x.")
    drafts = frame([(1, text), (2, None), (3, "")], "d int, text string")
    out = sc.draft_gate(drafts, ["d"], frame([(1, "claim-1")], "d int, claim_id string"))
    assert sorted((r["paragraph_no"], r["rule"]) for r in out.collect()) == [
        (0, "praise_without_number"), (3, "vague_phrase"), (4, "result_without_claim"), (7, "praise_without_number")]
    assert "paragraph#" not in _plan(out)


def test_entries_are_found_once_a_text(spark, tmp_path):
    from plumbline.plans import catalog, corpus

    spark.createDataFrame([(1, "one. two. three. four"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus.run_on_entries(catalog.Tables(spark, str(tmp_path)))
    assert [(r["num"], r["entry"]) for r in out.orderBy("num").collect()] == [(1, "one."), (2, "two."), (3, "three."), (4, "four.")]
    assert "size(" not in "".join(line for line in _plan(out).split("\n") if "Filter" in line)


def test_lint_tries_wide_rules_on_wide_lines(frame):
    from plumbline.functions import text as tx

    problems = _plan(frame([("x",)], "entry string").select(it.entry_problems(F.col("entry"), 2024).alias("p")))
    assert problems.count("(19|20) (") == 1
    yes = ["…+", "[０-９]+", r"([，。])\1+", r"(?<=[一-鿿])\.{3,}", r"\([一-鿿][^()\n]{0,40}\)"]
    no = ["e[,.] ", "(?<![一-鿿])a", "…?a", "…|a", "²"]
    assert [tx.needs_wide(p) for p in yes] == [True] * len(yes) and [tx.needs_wide(p) for p in no] == [False] * len(no)
    lines = "plain words go here in this line\n甲,乙 and some more words here\n（plain words go here in this\n１２ and １ stand in this line e, "
    got = {r["rule"]: r["n"] for r in it.typography_check(
        frame([(1, lines)], "d int, text string"), ["d"], rules=(*fw.TYPOGRAPHY, ("after_e", "e[,.]|words"))).collect()}
    assert got == {"half_width_punctuation": 1, "full_width_digits": 2, "unbalanced_pair": 1, "after_e": 4}
    captions = it.caption_check(frame([(1, "Figure 1 One\nsee Figure 1\n | Figure 7 \n见图２ 和\nplain"), (2, None)], "d int, text string"), ["d"])
    found = {(r["d"], r["kind"]): (r["n_captions"], r["n_mentions"]) for r in captions.collect()}
    assert found[1, "figure"] == (1, 2) and found[1, "table"] == (0, 0)
    glyphs = frame([("ｐ＝．０５",), ("x²",), ("Χ𝑝",), ("plain é",), (None,)], "t string").select(tx.normalize(F.col("t")).alias("t"))
    assert [r["t"] for r in glyphs.collect()] == ["p=.05", "x2", "χp", "plain é", None]


def test_hypothesis_coverage_shuffles_nothing(frame):
    from plumbline.functions import fixed_text as ft
    from plumbline.functions import text as tx

    blank, far = " " * 120, "x" * 151
    texts = ["t(30) = 2.1, p = .05", f"t = 2 {far} p = .05 {far} r = .3", f"p{blank}= .04 F(1,{blank}{'3' * 40}) = 2", "p = 1.0" + "0" * 90,
             "p = 1.0" + "0" * 90 + "5", "or = 1.2 R2 = .4 ap = .05 aM = 2", "均值为3，标准差 是 2 比值比 = 2", "chi" + "-" * 130 + "square = 3",
             "= 5 p == .05 p <= .05", "p\u0001= .05 x\u0002² = 3", "T =" + "\n" * 80 + "-3 p = 为 2", "", "\U0001F600p<.05" + "t = 1 " * 40, "p=.01 t=1 t=2p=.02" * 9]
    df = frame([*enumerate(texts), (99, None)], "d int, text string")
    out = it.hypothesis_coverage(df, ["d"])
    plan = _plan(out)
    assert "Join" not in plan and "Window" not in plan and plan.count("(?=[") == 1
    kinds = {k: v for k, v in ft.QUANTITY_PATTERNS.items() if k != "n"}
    hits = {(r["d"], r["kind"] == "p", r["start"]) for r in tx.locate(df, ["d"], "text", kinds, 0).collect()}
    for r in out.collect():
        p = [s for d, is_p, s in hits if d == r["d"] and is_p]
        alone = [s for d, is_p, s in hits if d == r["d"] and not is_p and all(abs(s - x) > 150 for x in p)]
        assert (r["d"], r["n_tests"]) == (r["d"], len(p) + len(alone))
    again = frame([(1, "H1 H1a aH1 h 2 假设3 假说十二 假设5个 假设 四"), (1, "H7 H8"), (None, "H1")], "d int, text string")
    assert sorted(r["n_declared"] for r in it.hypothesis_coverage(again, ["d"]).collect()) == [1, 2, 5]


def test_full_rule_table_counts_dashes(spark, tmp_path):
    from plumbline.plans import catalog, corpus

    texts = ["样本分为两组——实验组与对照组——分别施测。", "two ——paired—— dashes, then ——two—— more", "one —— only", "S-O-R（刺激——机体——反应）",
             "综上所述，旨在 yyds", None]
    for name, rows in (("some", list(enumerate(texts))), ("none", []), ("null", [(1, None)])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = {name: corpus.phrase_rules_full(catalog.Tables(spark, f"{tmp_path}/{name}")).collect() for name in ("some", "none", "null")}
    assert {name: [tuple(r) for r in rows] for name, rows in got.items()} == {"some": [(6, 6)], "none": [(0, 0)], "null": [(1, 0)]}
