import pytest

from factgrid import queries
from factgrid.operators import graph
from factgrid.plans import analysis
from factgrid.sources import mock, providers, syntax

CODE = queries.PROGRAM


@pytest.fixture(scope="module")
def program(spark):
    return analysis.program(queries.sources(spark))


def test_parse_facts():
    f = syntax.parse(CODE)
    by = {x["name"]: x for x in f["functions"]}
    assert by["area"]["args"] == ["self", "w", "*rest", "**more"] and by["area"]["returns"] == "float" and by["area"]["docstring"] == "Area."
    assert by["area"]["calls"] == ["helper", "sqrt"] and by["area"]["variables"] == ["total"]
    assert f["classes"][0]["methods"] == ["area", "helper"] and f["classes"][0]["attributes"] == ["kind"] and f["classes"][0]["bases"] == ["Base"]
    assert [(i["module"], i["names"], i["alias"]) for i in f["imports"]] == [("os", ["os"], None), ("sys", ["sys"], "system"), ("math", ["sqrt"], None)]
    assert [(v["name"], v["assigned_value"], v["dependencies"]) for v in f["variables"]] == [("LIMIT", "10", []), ("SCALE", "LIMIT * 2", ["LIMIT"])]
    assert f["module_calls"] == ["run"]


def test_nested_calls_belong_to_both_and_decorators_of_the_inner_only():
    f = syntax.parse("@deco()\ndef a():\n    @inner()\n    def b():\n        c()\n    return b\n")
    assert {x["name"]: x["calls"] for x in f["functions"]} == {"a": ["c", "inner"], "b": ["c"]}


def test_last_definition_wins_but_calls_stay(spark):
    rows = [("f", "class A:\n    def m(self):\n        go()\nclass B:\n    def m(self):\n        pass\n")]
    facts = syntax.facts(spark.createDataFrame(rows, "file_id string, code string"))
    assert [(r["name"], r["calls"]) for r in syntax.functions(facts).collect()] == [("m", [])]
    assert [tuple(r) for r in syntax.call_rel(facts).collect()] == [("f", "m", "go")]
    assert syntax.functions(facts, "each").where("name = 'm'").count() >= 2


def test_a_broken_file_is_a_row_with_an_error(program):
    rows = {r["file_id"]: r for r in program.facts.collect()}
    assert "syntax" in rows["broken.py"]["error"] and rows["a.py"]["error"] is None and rows["empty.py"]["functions"] == []


def test_graphs(program):
    edges = {(r["graph"], r["src"], r["dst"]): r["relationship"] for r in program.edges.collect()}
    assert edges["call", "run", "finish"] == "calls" and edges["data_flow", "LIMIT", "SCALE"] == "provides_data" and edges["combined", "area", "total"] == "defines"
    kinds = {(r["graph"], r["id"]): r["node_type"] for r in program.nodes.collect()}
    assert kinds["call", "sqrt"] == "external_function" and kinds["data_flow", "Shape"] == "class" and kinds["data_flow", "total"] == "local_variable" and kinds["combined", "run"] == "function"


def test_truth_edges(program):
    got = {(r["caller"], r["callee"]) for r in graph.truth_edges(program.functions, program.call_rel, syntax.module_calls(program.facts)).collect()}
    assert got == {("area", "helper"), ("area", "sqrt"), ("run", "Shape"), ("run", "area"), ("run", "finish"), ("run", "print"), ("run", "range"), ("<module>", "run")}


def test_mock_narrative():
    text = mock.mock_analysis("def a(x):\n    b(x)\n    print(x)\n\ndef b(x):\n    return x\n\nclass C:\n    def m(self):\n        a(1)\n\ndef z():\n    return 1\n")
    assert "Bu kod 4 fonksiyon ve 1 sınıf içermektedir." in text and "- a fonksiyonu şu fonksiyonları çağırıyor: b" in text
    assert "FONKSIYON: a\nÇAĞIRIYOR: b" in text and "FONKSIYON: z\nÇAĞIRIYOR: YOK" in text and "- Metodları: m" in text
    assert mock.mock_steps(text)[0].startswith("ADIM 1: GENEL BAKIŞ")


def test_choosing_a_provider():
    assert providers.choose("auto", available=lambda p, k: p == "gemini") == "gemini"
    assert providers.choose("auto", available=lambda p, k: False) == "mock"
    with pytest.raises(RuntimeError):
        providers.choose("openai", available=lambda p, k: False)
    assert providers.prompt("groq", "review", "X") == providers.prompt("groq", "analysis", "X") and "X" in providers.prompt("openai", "review", "X")


def test_retries_wait_and_change_the_model():
    waits, asked = [], []

    def ask(model):
        asked.append(model)
        if len(asked) == 1:
            raise ValueError("429 quota; retry in 7s")
        if len(asked) == 2:
            raise ValueError("404 model not found")
        return "ok", {}

    assert providers.with_retries(ask, ("a", "b", "c"), sleep=waits.append) == ("c", "ok", {}) and waits == [8.0] and asked == ["a", "b", "c"]
    with pytest.raises(ValueError):
        providers.with_retries(lambda m: (_ for _ in ()).throw(ValueError("bad key")), ("a",))
