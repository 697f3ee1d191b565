import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from factgrid.llm import pitman_yor as py


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    return {k: " ".join(rng.choices(words, weights, k=60) + [f"own{k // 4}"]) for k in range(240)}


def scores(spark, texts, parts):
    rows = sorted(texts.items(), key=lambda x: (x[0] % parts, x[0]))
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")
    return {r["doc_id"]: r["score"] / r["n_tokens"] for r in py.scored(df, F.col("doc_id") % 3 == 0).collect()}


def single(texts, sweeps=20):
    """The same model in one process, customer by customer, children and parent in turn."""
    rng, docs = random.Random(5), {d: ["", *t.split(), ""] for d, t in texts.items()}
    pairs = Counter(p for d, t in docs.items() if d % 3 for p in zip(t, t[1:]))
    c = Counter()
    for (_, w), n in pairs.items():
        c[w] += n
    v = len(c)

    def sweep(tables, customers, discount, strength, base):
        total = sum(tables.values())
        before = dict(tables)
        for w, k in customers.items():
            others, t = total - before.get(w, 1), 1
            for sat in range(1, k):
                new = (strength + discount * others) * base(w)
                t += rng.random() < new / (new + sat - discount * t)
            tables[w] = t

    rooms = defaultdict(dict)
    for (u, w), k in pairs.items():
        rooms[u][w] = k
    seats = {u: dict.fromkeys(x, 1) for u, x in rooms.items()}
    top, mean = {}, defaultdict(Counter)
    asked = {p for t in docs.values() for p in zip(t, t[1:])}
    for k in range(sweeps + 5):
        customers = Counter()
        for x in seats.values():
            customers.update(x)
        if k == 0:
            top = dict.fromkeys(customers, 1)
        else:
            sweep(top, customers, py.PARENT_DISCOUNT, py.PARENT_STRENGTH, lambda w: 1 / (v + 1))
        total, all_tables = sum(customers.values()), sum(top.values())

        def p0(w):
            return (max(0, customers[w] - py.PARENT_DISCOUNT * top.get(w, 0)) + (py.PARENT_STRENGTH + py.PARENT_DISCOUNT * all_tables) / (v + 1)) / (py.PARENT_STRENGTH + total)

        if k >= 5:
            for u, w in asked:
                own, sat = seats.get(u, {}), rooms.get(u, {})
                mean[u][w] += (sat.get(w, 0) - py.DISCOUNT * own.get(w, 0) + (py.STRENGTH + py.DISCOUNT * sum(own.values())) * p0(w)) / (py.STRENGTH + sum(sat.values())) / sweeps
        for u, x in rooms.items():
            sweep(seats[u], x, py.DISCOUNT, py.STRENGTH, p0)

    def p(u, w):
        return mean[u][w]

    return {d: sum(math.log10(p(*x)) for x in zip(t, t[1:])) / (len(t) - 1) for d, t in docs.items()}


def apart(a, b):
    return sum(a[d] - b[d] for d in a) / len(a), max(abs(a[d] - b[d]) for d in a)


def test_scores_are_those_of_one_process_however_the_input_is_split(spark, texts):
    want = single(texts)
    for parts in (1, 12):
        mean, most = apart(scores(spark, texts, parts), want)
        print(parts, mean, most)
        assert abs(mean) < 0.006 and most < 0.03


def test_held_out_texts_teach_nothing(spark, texts):
    more = {d: t + (" zzz" * 2000 if d % 3 == 0 else "") for d, t in texts.items()}
    a, b = scores(spark, texts, 4), scores(spark, more, 4)
    mean, most = apart({d: x for d, x in a.items() if d % 3}, {d: x for d, x in b.items() if d % 3})
    print(mean, most)
    assert abs(mean) < 0.006 and most < 0.03


def test_perplexity_is_that_of_all_tokens(spark, texts):
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    rows = py.scored(df, F.col("doc_id") % 3 == 0).collect()
    out = {r["held_out"]: r for r in py.perplexity(spark.createDataFrame(rows)).collect()}
    for held in (True, False):
        own = [r for r in rows if r["held_out"] == held]
        assert out[held]["perplexity"] == pytest.approx(10 ** (-sum(r["score"] for r in own) / sum(r["n_tokens"] for r in own)))
        assert held or out[held]["perplexity"] < out[held]["base_perplexity"]  # words of these texts are independent: there is nothing to gain on others
    assert all(r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"])) for r in rows)
