import random

import pytest
from pyspark.sql import functions as F

from factgrid.functions import names, similarity


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_similarity_against_a_table_in_python(spark):
    rng = random.Random(3)
    pairs = [("calc_total", "calculate_total"), ("calc", "calculator"), ("data", "date"), ("", "x"), ("", "")]
    pairs += [("".join(rng.choice("abcd") for _ in range(rng.randint(0, 8))), "".join(rng.choice("abcd") for _ in range(rng.randint(0, 8)))) for _ in range(40)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.common_subsequence(F.col("a"), F.col("b")).alias("l"), similarity.indel_ratio(F.col("a"), F.col("b")).alias("r"))
    for a, b, l, r in df.collect():
        assert l == lcs(a, b)
        assert r == (round(200 * l / (len(a) + len(b))) if a + b else 0)
    assert [tuple(x)[3] for x in df.limit(3).collect()] == [80, 57, 75]


def test_charset_similarity(spark):
    df = spark.createDataFrame([("ab", "ab"), ("abc", "xaybz"), ("", "a"), ("aab", "b")], "a string, b string")
    assert [r[0] for r in df.select(similarity.charset_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.4, 0.0, pytest.approx(1 / 3)]


@pytest.mark.parametrize("name", ["döküm", "x1", "1x", "a", "The", "değişken", "_x", "a-b", "Şeker", "x y", ""])
def test_identifiers_as_python_has_them(spark, name):
    low = name.lower().strip()
    want = len(low) >= 2 and low not in names.STOP_WORDS and low.isidentifier()
    assert spark.createDataFrame([(name,)], "n string").select(names.is_identifier(F.col("n"))).first()[0] == want


def test_normal_forms(spark):
    df = spark.createDataFrame([(" A.B.Run ",), ("Shop.__init__",), ("main",)], "n string")
    got = df.select(names.normal(F.col("n")), names.base_name(F.col("n")), names.contextual_name(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("a.b.run", "run", "run"), ("shop.__init__", "__init__", "shop.__init__"), ("main", "main", "main")]
    assert len(names.BUILTINS) == 44 and len(names.STOP_WORDS) == 28 and len(names.SPECIAL_METHODS) == 23
