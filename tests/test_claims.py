from pyspark.sql import functions as F

from factgrid.operators import claims

SCHEMA = "file_id string, run_id string, content string, reasoning_steps array<string>"


def extract(spark, content, steps=()):
    rows = claims.extracted(spark.createDataFrame([("f", "r", content, list(steps))], SCHEMA)).orderBy("ord").collect()
    return [(r["claim_type"], r["subject"], r["object"], r["predicate"], r["confidence"], r["source_step"]) for r in rows]


def test_json(spark):
    body = '```json\n{"functions": [{"name": " Run ", "calls": ["go", "a.b", "go", 5]}, 7, {"calls": ["x"]}, {"name": 3}]}\n```'
    assert extract(spark, body) == [("existence", "run", None, "exists", 1.0, 0), ("call", "run", "go", "calls", 1.0, 0)]


def test_text_that_is_no_json_is_searched_for_phrases(spark):
    got = extract(spark, "The function load calls parse. method run of class Shop", ["total is derived from price", "save function is defined"])
    assert ("call", "load", "parse", "calls", 0.9, 0) in got and ("attribute", "run", "shop", "has_attribute", 0.8, 0) in got
    assert ("data_flow", "total", "price", "data_flows_to", 0.8, 1) in got and ("existence", "save", None, "exists", 0.85, 2) in got


def test_turkish_blocks(spark):
    got = extract(spark, "FONKSIYON: `Shop.run` (ana)\nÇAĞIRIYOR: `load`, x.save\n\nFONKSIYON: idle\nÇAĞIRIYOR: YOK")
    assert ("call", "run", "load", "calls", 0.95, 0) in got and ("call", "run", "save", "calls", 0.95, 0) in got
    assert not any(c[0] == "call" and c[1] == "idle" for c in got)
    assert ("call", "döküm", "şeker", "calls", 0.9, 0) in extract(spark, "döküm calls Şeker")


def test_method_lists(spark):
    got = extract(spark, "ADIM 2: Shop SINIFI ANALİZİ\n- Metodları: add, drop_it")
    assert ("attribute", "shop", "add", "has_method", 0.9, 0) in got and ("attribute", "shop", "drop_it", "has_method", 0.9, 0) in got


def test_nulls_and_empty_tables(spark):
    assert extract(spark, None) == [] and extract(spark, "") == [] and extract(spark, "[1, 2]") == []
    assert claims.extracted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_steps(spark):
    df = spark.createDataFrame([("f", "r", "intro\n 1. one\n more\nADIM 2\nx", [])], SCHEMA)
    assert [r["step"] for r in claims.reasoning_steps(df).orderBy("segment").collect()] == ["1. one\nmore", "ADIM 2\nx"]
    assert [r["step"] for r in claims.reasoning_steps(df, mock=True).collect()] == ["ADIM 2\nx"]


def test_statistics_name_every_type(spark):
    df = spark.createDataFrame([("f", "r", "call")], "file_id string, run_id string, claim_type string")
    assert {r["claim_type"]: r["n"] for r in claims.statistics(df).collect()} == {"call": 1, "data_flow": 0, "existence": 0, "attribute": 0, "relationship": 0, "unknown": 0}
    assert df.select(claims.entity_type(F.lit("bu sınıf"))).first()[0] == "class"


def test_groups_of_a_match_are_those_of_the_text(spark):
    said = "a1 fonksiyonu b1 çağırır. x2 içinde y2 çağrıldı; in f3, g3 is called and h4 calls i4, j5 -> k5→l5\nFONKSIYON: m6\nÇAĞIRIYOR: n6, o6\np7 depends on q7 x8 y8 tarafından hesaplanır r9 sınıfının s9 metodu var t10 contains u10 method of class v10\nthere is a function called w11 exists"
    df = spark.createDataFrame([(said,), (said.upper(),), ("",), (None,)], "text string")
    n = 0
    for _, _, _, patterns in claims.FAMILIES:
        for pattern in patterns:
            two = 2 if patterns is not claims.EXISTENCE_PATTERNS else 1
            rx = F.lit(claims.FLAGS + pattern)
            got = F.transform(F.regexp_extract_all("text", rx, F.lit(0)), claims._groups(pattern, two))
            for r in df.select(got.alias("got"), *(F.regexp_extract_all("text", rx, F.lit(g)).alias(f"g{g}") for g in range(two + 1))).collect():
                assert [tuple(x) for x in r["got"] or []] == [*zip(*(r[f"g{g}"] or [] for g in range(two + 1)), strict=True)], pattern
                n += len(r["got"] or [])
    assert n > 20
