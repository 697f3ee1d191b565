import json

import pytest
from pyspark.sql import functions as F

from factgrid import queries
from factgrid.operators import compare, metrics, resolve, verify
from factgrid.plans import analysis
from factgrid.sinks import export, report

RUN = ["run_id"]


def test_resolution_cascade(spark):
    vocab = resolve.typed(spark.createDataFrame([("f", "function", "calculate_total"), ("f", "class", "Calculator"), ("f", "method", "__init__"), ("f", "variable", "data"), ("g", "function", "other")], "file_id string, category string, name string"))
    asked = [("calculate_total", ""), (" Calculator ", "class"), ("init", "method"), ("calc_total", "function"), ("lculator", ""), ("calc", ""), ("other", ""), ("data", "function")]
    m = spark.createDataFrame([("f", t, k) for t, k in asked], "file_id string, text string, expected_type string")
    got = {(r["text"], r["expected_type"]): (r["code_entity"], r["match_type"], round(r["confidence"], 2)) for r in resolve.resolved(m, vocab).collect()}
    assert got["calculate_total", ""] == ("calculate_total", "exact", 1.0) and got[" Calculator ", "class"] == ("Calculator", "exact", 1.0)
    assert got["init", "method"] == ("__init__", "alias", 0.95) and got["calc_total", "function"] == ("calculate_total", "fuzzy", 0.8)
    assert got["lculator", ""] == ("Calculator", "fuzzy", 0.89) and got["calc", ""][1] == "no_match" and got["other", ""][1] == "no_match" and got["data", "function"][1] == "no_match"


def test_metrics_of_five_verdicts(spark):
    rows = [("r", k, t, s, v, c) for k, (t, s, v, c) in enumerate([("call", 1, "valid", 0.95), ("call", 1, "valid", 0.85), ("call", 2, "hallucination", 0.9), ("existence", 3, "hallucination", 0.85), ("existence", 3, "valid", 1.0)])]
    v = spark.createDataFrame(rows, "run_id string, ord long, claim_type string, source_step int, result string, verdict_confidence double")
    r = metrics.rates(v, RUN).first()
    assert (r["hallucination_rate"], r["validity_rate"]) == (0.4, 0.6)
    assert metrics.step_validity(v, RUN).first()["step_validity"] == 0.5 and metrics.chain_coherence(v, RUN).first()["chain_coherence"] == 0.5
    c = metrics.confidence_distribution(v, RUN).first()
    assert (round(c["average"], 6), c["min"], c["max"], c["high"]) == (0.91, 0.85, 1.0, 5)
    assert metrics.graded(metrics.rates(v, RUN)).first()["overall_assessment"] == "ZAYIF"
    summary = metrics.rates(v, RUN).withColumn("coverage", F.lit(0.0))
    assert [(x["rule"], x["of"]) for x in metrics.recommended(summary, metrics.type_breakdown(v, RUN), RUN).orderBy("place").collect()] == [("high_hallucination", ""), ("low_coverage", ""), ("bad_type", "existence")]
    assert metrics.chain_coherence(v.limit(1), RUN).first()["chain_coherence"] == 1.0


def test_scores_of_thirteen_and_fourteen(spark):
    truth = spark.createDataFrame([("f", f"a{k}", "x") for k in range(13)], "file_id string, caller string, callee string")
    said = spark.createDataFrame([("f", f"M.a{k}", "x") for k in range(12)] + [("f", "b1", "x"), ("f", "b2", "x")], "file_id string, caller string, callee string")
    s = compare.scores(truth, said, compare.compared(truth, said, ["file_id"]), ["file_id"]).first()
    assert (s["matched"], s["missed"], s["hallucinations"]) == (12, 1, 2)
    assert (s["precision"], s["recall"], s["f1_score"], s["hallucination_rate"], s["coverage"]) == (85.7, 92.3, 88.9, 14.3, 92.3)


def test_an_equal_edge_goes_before_one_of_the_same_base_name(spark):
    kind = "file_id string, caller string, callee string"
    got = compare.compared(spark.createDataFrame([("f", "a", "x")], kind), spark.createDataFrame([("f", "A.a".lower(), "x"), ("f", "a", "x")], kind), ["file_id"])
    assert sorted((r["caller"], r["status"]) for r in got.collect()) == [("a", "correct"), ("a.a", "hallucination")]


def test_verdict_rules(spark):
    p = analysis.program(queries.sources(spark))
    said = [("call", "run", "finish"), ("call", "run", "print"), ("call", "run", "helper"), ("call", "nobody", "run"), ("call", "run", "qqqq"), ("call", "finish", "run"), ("data_flow", "limit", "scale"), ("data_flow", "scale", "limit"), ("existence", "run", None), ("existence", "zzzz", None), ("attribute", "shape", "area"), ("attribute", "shape", "zzzz"), ("attribute", "zzzz", "area"), ("unknown", "run", None)]
    c = spark.createDataFrame([("a.py", "r", k, *x) for k, x in enumerate(said)], "file_id string, run_id string, ord long, claim_type string, subject string, object string")
    got = [(r["result"], round(r["verdict_confidence"], 2)) for r in verify.verified(c, p.vocab, p.nodes, p.edges).orderBy("ord").collect()]
    assert got == [("valid", 1.0), ("valid", 0.9), ("partially_valid", 0.6), ("unverifiable", 0.3), ("hallucination", 0.8), ("hallucination", 0.9), ("valid", 0.85), ("partially_valid", 0.6), ("valid", 1.0), ("hallucination", 0.9), ("valid", 1.0), ("hallucination", 0.8), ("unverifiable", 0.3), ("unverifiable", 0.0)]


@pytest.fixture(scope="module")
def analysed(spark):
    own = spark.createDataFrame([("a.py", "json", queries.RESPONSE, [])], "file_id string, run_id string, content string, reasoning_steps array<string>")
    return own, analysis.analyse(queries.sources(spark), own)


def test_analysis_end_to_end(analysed, tmp_path):
    _, done = analysed
    r = done.report.first()
    assert (r["total_claims"], r["valid_count"], r["hallucination_count"]) == (5, 3, 2)
    page = report.generate(done.verdicts, done.summary, done.metrics, done.recommendations, "a.py", "json")
    assert "ghost" in page and "hallucination_rate" in page
    assert open(report.save(page, str(tmp_path / "x" / "r.html")), encoding="utf-8").read() == page


def test_comparison_end_to_end(spark, analysed):
    done = analysis.compare(queries.sources(spark), analysed[0])
    body = json.loads(export.api_json(done.truth, done.claimed, done.comparison, done.scores, analysis.RUN).first()["json"])
    assert body["success"] and {(e["caller"], e["callee"]) for e in body["comparison"]["matched"]} == {("run", "area"), ("run", "finish")}
    assert body["comparison"]["only_in_llm"] == [{"caller": "run", "callee": "missing"}] and body["metrics"]["precision"] == 66.7
