import random
import re
from collections import Counter, defaultdict

import pytest

from factgrid.llm import jaccard


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").encode().lower().decode())
    k = min(k, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def by_hand(rows, k, percent):
    sets = [(r[0], shingles(r[1], k)) for r in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for j, both in Counter(j for x in s for j in index[x]).items():
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                parent[find(i)] = find(j)
        for x in s:
            index[x].append(i)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("k, percent, boundary", [(3, 90, None), (5, 80, None), (3, 90, 60), (3, 70, 25)])
def test_components_against_python(documents, rows, k, percent, boundary):
    got = sorted((tuple(r) for r in jaccard.joined(documents, k, percent, boundary=boundary).collect()), key=str)
    assert got == by_hand(rows, k, percent)


def test_a_group_of_near_copies_that_form_chains(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(80)]
    rows = [(0, " ".join(words))]
    for k in range(1, 60):
        own = rng.choice(rows)[1].split()
        own[rng.randrange(len(own))] = f"e{k}"
        rows.append((k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for boundary in (None, 100):
        assert sorted(map(tuple, jaccard.joined(df, 3, 90, boundary=boundary).collect()), key=str) == by_hand(rows, 3, 90)


def test_stage_keeps_one_of_each_group(documents, rows, with_nulls, empty):
    want = {d for d, n, c in by_hand(rows, 5, 80) if d == c}
    left = [r["doc_id"] for r in jaccard.filtered(documents).collect()]
    assert sorted(left) == sorted(want)
    assert None in {r["doc_id"] for r in jaccard.filtered(with_nulls).collect()}
    assert jaccard.joined(empty).count() == 0 and jaccard.filtered(empty).schema == empty.schema


def edited(words, k):
    return " ".join([*words[:k], f"edit{k}", *words[k + 1 :]])


def test_links_run_through_rows_without_doc_id(spark):
    words = [f"w{k}" for k in range(100)]
    between = " ".join(words)
    rows = [(1, edited(words, 10)), (None, between), (3, edited(words, 90)), (None, "alone without a name in this table"), (None, edited(words, 50))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.joined(df, 3, 90).collect()), key=str)
    assert got == by_hand(rows, 3, 90) and {c for d, _, c in got if d in (1, 3)} == {1}
    kept = [tuple(r) for r in jaccard.filtered(df, 3, 90).collect()]
    assert sorted(kept, key=str) == sorted([rows[0], rows[3]], key=str)


def test_a_repeated_doc_id_loses_only_copies(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (5, b, "x"), (7, "", "x"), (7, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_key string")
    for most in (100, 0):
        left = jaccard.filtered(df, max_broadcast=most)
        assert left.columns == df.columns
        assert sorted(map(tuple, left.collect()), key=str) == sorted([rows[0], rows[2], rows[4], rows[5]], key=str)


def test_without_broadcast_and_with_sliced_lists(documents, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "SLICE", 2)
    monkeypatch.setattr(jaccard, "size_of_cell", lambda n: 0)
    for boundary in (None, 60):
        got = sorted((tuple(r) for r in jaccard.joined(documents, 3, 90, boundary=boundary, max_broadcast=0).collect()), key=str)
        assert got == by_hand(rows, 3, 90)
