import re
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from factgrid.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    twice = {w for w in windows if times[w] > 1}
    covered = {i + j for i, w in enumerate(windows) if w in twice for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_against_python(spark, with_nulls):
    repeated = "a b c d e f g h " * 3 + "x y\nx y\n z"
    df = with_nulls.select("text").unionByName(spark.createDataFrame([(repeated,), ("a b c d e f g h i a b c d e f g h",), (" ".join(f"w{k}" for k in range(9000)) + " w1 w2 w3 w4 w5 w6 w7 w8 w9",)], "text string"))
    for r in quality.measured(df).collect():
        assert tuple(r["_fg_q"][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == by_hand(r["text"])


def test_binomial_tail(spark):
    df = spark.createDataFrame([(0, 10), (3, 10), (10, 10), (5, 400)], "k long, n long")
    for k, n, p in df.select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.03)).collect():
        assert p == pytest.approx(sum(comb(n, i) * 0.03**i * 0.97 ** (n - i) for i in range(k + 1)), rel=1e-9)


def test_cutoffs_are_certified_for_each_stratum_and_junk_goes(spark):
    good = [(k, " ".join(f"word{k}x{j}" for j in range(40)), "en", 1, 0) for k in range(1500)]
    junk = [(2000 + k, " ".join(f"ab{j}{k} |#" for j in range(40)), "en", 0, 0) for k in range(20)]
    few = [(3000 + k, " ".join(f"wort{k}x{j} |#" for j in range(40)), "de", 1, 0) for k in range(5)]
    df = spark.createDataFrame([*good, *junk, *few], "doc_id long, text string, lang string, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.verdicts(df, df.select("doc_id", "quality", "toxic")).collect()}
    assert all(out[k]["kept"] for k in range(1500)) and not any(out[2000 + k]["kept"] for k in range(20))
    assert all(out[3000 + k]["kept"] for k in range(5))  # five labels certify nothing
    kept = {r["doc_id"] for r in quality.filtered(df, df.select("doc_id", "quality")).collect()}
    assert kept == {k for k, r in out.items() if r["kept"]}


def test_edges(spark, with_nulls, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (999, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    out = quality.verdicts(with_nulls, labels)
    assert out.count() == with_nulls.count() and out.where("kept is null or base_failed is null").count() == 0
    kept = quality.filtered(with_nulls, labels)
    assert kept.schema == with_nulls.schema and kept.where("text is null").count() == 0
    assert quality.verdicts(empty, labels.where("false")).count() == 0 and quality.filtered(empty, labels).count() == 0


def test_repeated_labels_and_documents_are_one_trial_each(spark):
    docs = spark.createDataFrame([(k, " ".join(f"word{k}x{j}" for j in range(40)), "en") for k in range(20)], "doc_id long, text string, lang string")
    once = spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    many, more = once, docs
    for _ in range(6):
        many, more = many.union(many), more.union(more)
    slim = lambda d: quality.measured(d).select("doc_id", F.col("lang").alias("stratum"), "_fg_q")
    assert quality.fitted(slim(docs), many).count() == 0 and quality.fitted(slim(more), once).count() == 0
    assert [tuple(r)[:4] for r in quality.fitted(slim(docs), many, risk=0.2).collect()] == [("en", 3, 20, 0)]  # the words have 8 letters or more
    torn = once.union(spark.createDataFrame([(k, 0, 0) for k in range(15)], once.schema))
    assert [r["n"] for r in quality.fitted(slim(docs), torn, risk=0.5).collect()] == [5]


def test_about_a_hundred_labels_certify_and_texts_are_not_dealt_by_language(spark):
    docs = spark.createDataFrame([(k, " ".join(f"word{k}x{j}" for j in range(40)) + (" #" * 30 if k >= 100 else ""), "en") for k in range(110)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(100)], "doc_id long, quality int")
    left = quality.filtered(docs, labels)
    assert {r["doc_id"] for r in left.collect()} == set(range(100))
    assert "Exchange hashpartitioning" not in left._jdf.queryExecution().executedPlan().toString()
