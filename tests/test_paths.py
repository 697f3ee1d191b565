import random
from collections import deque

from factgrid.operators import graph


def bfs(edges, a):
    far, queue = {a: 0}, deque([a])
    while queue:
        x = queue.popleft()
        for s, d in edges:
            if s == x and d not in far:
                far[d] = far[x] + 1
                queue.append(d)
    return far


def test_shortest_paths_against_a_search_in_python(spark):
    rng = random.Random(1)
    edges = sorted({(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(14)})
    e = spark.createDataFrame([("f", "call", s, d, "calls", "call") for s, d in edges], "file_id string, graph string, src string, dst string, relationship string, graph_source string")
    n = spark.createDataFrame([("f", "call", x, "function", 0) for x in sorted({x for y in edges for x in y})], "file_id string, graph string, id string, node_type string, lineno int")
    got = {(r["src"], r["dst"]): r for r in graph.shortest_paths(e.select("file_id", "src"), e).collect()}
    want = {(s, d): h for s in {s for s, _ in edges} for d, h in bfs(edges, s).items()}
    assert {k: r["hops"] for k, r in got.items()} == want
    assert all(r["path"][0] == s and r["path"][-1] == d and all(p in edges for p in zip(r["path"], r["path"][1:])) for (s, d), r in got.items())
    pairs = spark.createDataFrame([("f", "n0", "n0"), ("f", "n0", "absent")], "file_id string, src string, dst string")
    ends = {r["dst"]: r["has_path"] for r in graph.has_path(pairs, n, e).collect()}
    assert ends == {"n0": any("n0" in x for x in edges), "absent": False}


def test_simple_paths(spark):
    e = spark.createDataFrame([("f", *x) for x in (("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"))], "file_id string, src string, dst string")
    pairs = spark.createDataFrame([("f", "a", "c")], "file_id string, src string, dst string")
    assert sorted(r["path"] for r in graph.simple_paths(pairs, e, 5).collect()) == [["a", "b", "c"], ["a", "c"]]
