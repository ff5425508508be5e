"""The audit of papers: results by kind for each method, method choice, verdicts."""

from pyspark.sql import functions as F

from plumbline.operators import audit as au
from plumbline.operators import registry


def test_results_by_kind_of_each_method(frame):
    rows = [(k % 2, "ab"[k % 2], "xyz"[k % 3], float(k % 7), float((k * 5) % 11), float((k * 3) % 13)) for k in range(60)]
    df = frame(rows, "paper int, g string, h string, a double, b double, c double")
    cases = {
        "independent_t": ({"group": "h2", "value": "a"}, {"t", "p", "d", "n"}),
        "paired_t": ({"a": "a", "b": "b"}, {"t", "p", "n"}),
        "anova": ({"group": "h", "value": "a"}, {"f", "p", "n"}),
        "mann_whitney": ({"group": "h2", "value": "a"}, {"p"}),
        "wilcoxon": ({"a": "a", "b": "b"}, {"p"}),
        "correlation": ({"a": "a", "b": "b"}, {"r", "p", "n"}),
        "chi_square": ({"group": "h", "value": "h2"}, {"chi2", "p", "n"}),
        "linear_regression": ({"y": "a", "xs": ["b", "c"]}, {"r2", "f", "p", "n"}),
    }
    df = df.withColumn("h2", F.when(F.col("a") + F.col("b") > 8, "u").otherwise("v"))
    for method, (arguments, kinds) in cases.items():
        got = au.results_by_kind(registry.run(method, df, by=["paper"], **arguments), ["paper"], method)
        assert {r.kind for r in got.collect()} == kinds, method


def test_audit_runs_each_papers_own_method(frame):
    docs = frame([(1, "We ran a one-way ANOVA, F(2, 27) = 9.99, p = .500, n = 30."),
                  (2, "A paired samples t test gave n = 31."), (3, "No method, n = 30.")], "paper int, text string")
    rows = [(p, "xyz"[k % 3], float(k % 7 + 3 * (k % 3)), float(k % 5)) for p in (1, 2, 3) for k in range(30)]
    data = frame(rows, "paper int, h string, a double, b double")
    out = au.audit_papers(docs, data, ["paper"], {
        "anova": {"group": "h", "value": "a"}, "paired_t": {"a": "a", "b": "b"}}, value="a")
    got = {(r.paper, r.kind): r.verdict for r in out.collect()}
    assert got[(1, "n")] == "agrees" and got[(1, "f")] == "check_source_data"
    assert got[(2, "n")] == "check_source_data" and got[(3, "n")] == "agrees"
    verdicts = {r.paper: r.verdict for r in au.audit_summary(out, ["paper"]).collect()}
    assert verdicts == {1: "check_source_data", 2: "check_source_data", 3: "agrees"}
