from collections import deque

import pytest

from factgrid.queries import QUERIES

KEYS = range(1, 41)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A supplier table whose graph has shortest paths of more than six hops."""
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(k, 1.0) for k in KEYS], "s_suppkey long, s_acctbal double").write.parquet(f"{at}/supplier.parquet")
    return at


def following():
    out = {}
    for k in KEYS:
        for d in ((7 * k + 3) % 100, k // 2):
            if d != k:
                out.setdefault(f"s{k}", set()).add(f"s{d}")
    return out


def searched(g):
    far = {}
    for a in g:
        far[a, a], queue = 0, deque([a])
        while queue:
            x = queue.popleft()
            for d in g.get(x, ()):
                if (a, d) not in far:
                    far[a, d] = far[a, x] + 1
                    queue.append(d)
    return far


def test_paths_of_any_length_are_found(spark, sf):
    g = following()
    want = searched(g)
    assert max(want.values()) > 6
    pairs = [(r["src"], r["dst"]) for r in QUERIES["q2_has_path"](spark, sf).collect()]
    assert sorted(pairs) == sorted(want)
    rows = QUERIES["q3_find_path"](spark, sf).collect()
    assert {(r["src"], r["dst"]): r["hops"] for r in rows} == want and len(rows) == len(want)
    for r in rows:
        path = r["path"].split(">")
        assert (path[0], path[-1], len(path)) == (r["src"], r["dst"], r["hops"] + 1)
        assert all(b in g[a] for a, b in zip(path, path[1:]))


def test_all_paths_lead_to_every_node(spark, sf):
    g, want = following(), []
    live = [(a,) for a in g]
    for _ in range(6):
        live = [(*p, d) for p in live for d in g.get(p[-1], ()) if d not in p]
        want += live
    assert len({p[-1] for p in want}) > 20
    rows = QUERIES["q4_all_paths"](spark, sf).collect()
    assert sorted((r["src"], r["dst"], r["path"]) for r in rows) == sorted((p[0], p[-1], ">".join(p)) for p in want)


def test_claims_come_from_every_event(spark, tmp_path):
    spark.createDataFrame([(k, f"t{k}", 10 + k) for k in range(7)], "event_id long, event_type string, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(r[c] for c in ("event_id", "subject", "claim_type", "object")) for r in QUERIES["c2_json_claims"](spark, str(tmp_path)).collect()]
    want = [x for k in range(7) for x in ((k, f"t{k}", "existence", None), (k, f"t{k}", "call", f"u{10 + k}"))]
    assert sorted(got, key=str) == sorted(want, key=str)
