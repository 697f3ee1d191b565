import pyarrow as pa

from factgrid.llm import jaccard, packing, tokens


def test_workers_give_back_what_arrow_holds_unused(monkeypatch):
    """After each batch of packing, and at the end of the join's tasks that read whole texts."""
    given = []
    for module in (packing, jaccard):
        monkeypatch.setattr(module, "give_back", lambda name=module.__name__: given.append(name))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words of a text", None])], names=["doc_id", "text"])
    out = [*packing._pieces(tokens.public_path(tokens.WORD_VOCABULARY), 2048)(iter([batch, batch]))]
    assert sum(len(x) for x in out) == 4 and given == [packing.__name__] * 2
    monkeypatch.setattr(jaccard, "lanes", lambda: iter(range(9)))
    assert len([*jaccard._sketches(3, jaccard.LEAST_CELLS)(iter([batch.select(["text"])]))]) == 1
    assert given[2:] == [jaccard.__name__]
