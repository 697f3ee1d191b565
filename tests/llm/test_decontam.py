import random
import tracemalloc

from factgrid.llm import decontam
from tests.llm.conftest import prose


def by_hand(docs, items):
    out = set()
    for d, t in docs:
        own = decontam.shingles(decontam.words_of(t))
        for i, x in items:
            w = decontam.words_of(x)
            if len(w) >= decontam.MIN_ITEM_WORDS and len(decontam.shingles(w) & own) >= 0.8 * len(decontam.shingles(w)):
                out.add((d, i))
    return out


def test_leaks_against_python_and_in_blocks(spark):
    rng = random.Random(11)
    vocabulary = [f"t{k}" for k in range(400)]
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + ". " + " ".join(rng.choice(vocabulary) for _ in range(6)) + "."
    items = [(k, item(rng.randint(6, 60))) for k in range(40)] + [(90, "too short"), (91, None), (92, ""), (93, item(300))]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 700)))) for k in range(30)]
    for k in range(25):
        w = docs[k][1].split()
        at = rng.randrange(len(w))
        source = items[rng.randrange(40)][1] if k else items[-1][1]
        docs[k] = (k, " ".join([*w[:at], source.upper() if k % 2 else source, *w[at:]]))
    docs += [(50, None), (51, ""), (None, items[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = by_hand(docs, items)
    assert len(want) >= 26
    for chars in (decontam.MAX_INDEX_CHARS, 2000):
        assert {(r["doc_id"], r["item_id"]) for r in decontam.matches(d, b, max_chars=chars).collect()} == want
    assert sorted((r["doc_id"] for r in decontam.filtered(d, b).collect()), key=str) == sorted((x for x, _ in docs if x not in {y for y, _ in want}), key=str)


def test_wand_returns_all_above_the_threshold():
    rng = random.Random(2)
    words = [f"t{k}" for k in range(50)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(5, 30)))) for k in range(60)]
    counts = {w: sum(w in t.split() for _, t in items) for w in words}
    index = decontam.Index(items, len(items), 15.0, counts, 0.3)
    for _ in range(30):
        terms = sorted({index.vocabulary[w] for w in rng.sample(words, 20) if w in index.vocabulary})
        want = {}
        for t, i, x in zip(index.term, index.posting, index.weight, strict=True):
            if t in terms:
                want[int(i)] = want.get(int(i), 0) + x
        got = dict(index.search(terms, [*range(index.n_blocks)]))
        assert set(got) == {i for i, s in want.items() if s >= 0.3 - 1e-9}


def test_edges(spark, with_nulls, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame([(1, prose(random.Random(1), 20))], "item_id long, text string")
    assert decontam.matches(with_nulls, none).count() == 0 and decontam.matches(empty, items).count() == 0
    left = decontam.filtered(with_nulls, items)
    assert left.schema == with_nulls.schema and left.count() == with_nulls.count() and decontam.filtered(empty, none).count() == 0


def test_question_and_answer_apart_are_a_leak_and_one_of_them_is_none(spark):
    question, answer = "which river crosses the old stone town today?", "it is the umbra of the far north."
    items = spark.createDataFrame([(1, f"{question} {answer}")], "item_id long, text string")
    filler = " ".join(f"f{k}" for k in range(3))
    docs = [(1, f"{question} {filler} {answer}"), (2, f"{answer} {filler} {question}"), (3, question), (4, f"{answer} {filler}"), (5, f"{question} {answer}")]
    got = {r["doc_id"]: r for r in decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert set(got) == {1, 2, 5} and got[1]["overlap"] < 0.8 and got[1]["question_overlap"] == got[1]["answer_overlap"] == 1 and got[5]["overlap"] == 1


def test_an_index_keeps_to_its_bytes():
    rng = random.Random(5)
    items = [(k, " ".join(f"w{rng.randrange(100_000)}" for _ in range(60))) for k in range(2500)]
    chars = sum(len(t) for _, t in items)
    counts = {}
    for _, t in items:
        for w in set(t.split()):
            counts[w] = counts.get(w, 0) + 1
    tracemalloc.start()
    index = decontam.Index(items, len(items), 60.0, counts, 0.5)
    took = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert index.ids and took < decontam.BYTES_PER_CHAR * chars


def test_small_indexes_share_a_pass(spark):
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(10 + 400 * (k % 2)))) for k in range(6)], "item_id long, text string")
    assert [len(x) for x in decontam.indexes(items)] == [2] and len([*decontam.indexes(items, max_chars=100)]) > 2
