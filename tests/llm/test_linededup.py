import hashlib
import tracemalloc
from collections import defaultdict

import numpy as np

from factgrid.llm import linededup


def by_hand(rows):
    key = lambda x: bytes(x.encode()).lower().strip(b" \t\n\x0b\x0c\r").decode()
    docs = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 20:
                docs[key(line)].add(r[0])
    last = {k: max((x for x in v if x is not None)) for k, v in docs.items() if len(v) >= 3}
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        stay = [x for x in lines if not (key(x) in last and last[key(x)] != r[0])]
        out.append((r[0], len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def test_digests_against_python(with_nulls):
    rows = [tuple(r) for r in with_nulls.collect()]
    got = sorted((tuple(r) for r in linededup.digests(with_nulls).collect()), key=str)
    assert got == by_hand(rows) and sum(r[2] for r in got) > 5


def test_the_way_beyond_the_broadcast_gives_the_same(with_nulls):
    a = linededup.deduplicated(with_nulls)
    b = linededup.deduplicated(with_nulls, max_broadcast=0)
    order = lambda t: sorted((tuple(r) for r in t.collect()), key=str)
    assert order(a) == order(b) and a.columns == [*with_nulls.columns, "_fg_n_lines", "_fg_n_dropped"]


def test_a_full_filter_changes_nothing(with_nulls, monkeypatch):
    want = sorted((tuple(r) for r in linededup.digests(with_nulls).collect()), key=str)
    monkeypatch.setattr(linededup, "LEAST_BITS", 512)
    monkeypatch.setattr(linededup, "MAX_FILTER_BYTES", 64)
    assert sorted((tuple(r) for r in linededup.digests(with_nulls).collect()), key=str) == want


def test_empty(empty):
    assert linededup.digests(empty).count() == 0 and linededup.filtered(empty).schema == empty.schema


def test_filter_at_its_bound_takes_its_own_bytes():
    n_bits = linededup.MAX_FILTER_BYTES * 8
    places = linededup.bits_of(np.random.default_rng(1).integers(0, 1 << 63, 50_000).astype(np.uint64), n_bits).ravel()
    tracemalloc.start()
    bits = linededup.with_bits(places, n_bits)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < linededup.MAX_FILTER_BYTES + 100 * len(places) and int(np.unpackbits(bits).sum()) == len(np.unique(places))
    assert np.unpackbits(bits, bitorder="little")[places.astype(np.int64)].all()


def test_many_small_filters_meet_in_a_tree(with_nulls, monkeypatch):
    want = sorted((tuple(r) for r in linededup.digests(with_nulls).collect()), key=str)
    assert sorted((tuple(r) for r in linededup.digests(with_nulls.repartition(40)).collect()), key=str) == want
