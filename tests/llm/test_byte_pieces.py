import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark import TaskContext
from tokenizers import Tokenizer

from factgrid.llm import rans, tokens

WIDE = "\x85\xa0\u1680\u2000\u200a\u200b\u2028\u202f\u205f\u2060\u3000\u3001"
ODD = ["", " ", "a. b, c.\nd", "d.", "né.", "é, é. é", "×. ÷, x", "Жж. да, ²,", "字. 字", "it's. it's", "a.. b", " a", "a ", "a\nb\n", "\nab", "a  b", "a\n\nb", "a \nb", "a\x1c b", "a\tb c", *(f"ab{c}cd ef.{c} gh" for c in WIDE), *WIDE]


def column(texts, kind):
    return pa.array(["cut off", *texts, "cut off"], kind).slice(1, len(texts))


@pytest.mark.parametrize("waiting", [1, 40, 8_000_000])
def test_ids_of_columns_are_those_of_the_library(waiting, monkeypatch):
    monkeypatch.setattr(tokens, "_WAITING", waiting)
    rng = random.Random(5)
    texts = [*ODD, None, *("".join(rng.choice("ab\u00e9. ,\n\xa0'\u30001\u0416") for _ in range(rng.randrange(30))) for _ in range(600))]
    whole = Tokenizer.from_file(tokens.public_path(tokens.BYTE_VOCABULARY))
    e = tokens.Encoder(tokens.public_path(tokens.BYTE_VOCABULARY), "bytes", max_cached=400)
    columns = [column(texts[:90], pa.string()), column([], pa.string()), column(["", None], pa.string()), column(texts[90:], pa.large_string())]
    got = [x for ids, ends in e.encode_columns(columns) for x in np.split(ids, ends[:-1])]
    for text, ids in zip([*texts[:90], "", None, *texts[90:]], got, strict=True):
        assert ids.tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 0], text


def test_a_piece_is_looked_up_once_for_many_columns():
    """The cost of op9: before, each thousand texts asked the cache for all their pieces anew."""
    asked = []

    class Cache(dict):
        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

    e = tokens.Encoder(tokens.public_path(tokens.BYTE_VOCABULARY), "bytes")
    e.cache = Cache()
    texts = ["some words of a text."] * 50
    ids = [*e.encode_all(texts * tokens._TOGETHER)]
    assert len({*ids}) == 1 and sorted(asked) == sorted({"some", " words", " of", " a", " text", ".", ""})


@pytest.mark.parametrize("block_tokens", [1, 7, 1000])
def test_blocks_count_their_ids_and_end_with_a_document(block_tokens, monkeypatch):
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 3})()))
    path = tokens.public_path(tokens.BYTE_VOCABULARY)
    texts = [t for t in ODD for _ in range(3)]
    batches = [pa.RecordBatch.from_arrays([pa.array([*range(a, min(a + 25, len(texts)))]), pa.array(texts[a : a + 25])], names=["doc_id", "text"]) for a in range(0, len(texts), 25)]
    rows = [r for b in rans._blocks(path, block_tokens)(iter([batches[0].slice(0, 0), *batches])) for r in b.to_pylist()]
    want = [np.frombuffer(x, "<u4") for x in tokens.Encoder(path, "bytes").encode_all(texts)]
    assert [d for r in rows for d in r["doc_ids"]] == [*range(len(texts))] and [x for r in rows for x in r["lengths"]] == [*map(len, want)]
    ids = [rans._ids(r["ids"], r["n"]) for r in rows]
    assert zlib.crc32(np.concatenate(ids)) == zlib.crc32(np.concatenate(want).astype(np.int64))
    assert [r["block"] for r in rows] == [*range(len(rows))] and {r["shard"] for r in rows} == {3}
    assert all(r["n"] >= block_tokens > r["n"] - r["lengths"][-1] for r in rows[:-1])
    for r, own in zip(rows, ids, strict=True):
        assert r["n"] == sum(r["lengths"]) == len(own) and np.frombuffer(r["counts"], "<u4").tolist() == np.bincount(own).tolist()
    (total,) = rans._counted(iter([pa.table({"counts": [r["counts"] for r in rows]}, schema=pa.schema([("counts", pa.binary())])).to_batches()[0]]))
    assert total.column("n").to_pylist() == np.bincount(np.concatenate(want))[total.column("id").to_pylist()].tolist()
