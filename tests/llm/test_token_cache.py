import string

import numpy as np
import pytest
from tokenizers import Tokenizer

from factgrid.llm import tokens

BOTH = pytest.mark.parametrize("name, splitting", [(tokens.WORD_VOCABULARY, "words"), (tokens.BYTE_VOCABULARY, "bytes")])


class Recorded:
    """A tokenizer that keeps the lines it is given."""

    def __init__(self, own):
        self.own, self.lines = own, []

    def encode_batch_fast(self, lines, **more):
        self.lines += lines
        return self.own.encode_batch_fast(lines, **more)


@BOTH
def test_pieces_that_are_met_again_are_encoded_once(name, splitting, monkeypatch):
    monkeypatch.setattr(tokens, "_TOGETHER", 10)
    e = tokens.Encoder(tokens.public_path(name), splitting, max_cached=200)
    e.plain = Recorded(e.plain)
    once = [a + b + c for a in string.ascii_lowercase for b in "qxz" for c in "abcdefgh"]
    texts = [f"some {w} stone" for w in once]
    whole = Tokenizer.from_file(tokens.public_path(name))
    for text, ids in zip(texts, e.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*whole.encode(text, add_special_tokens=False).ids, 0], text
    assert " ".join(e.plain.lines).split().count("stone") == 1
    assert len(e.cache) + len(e.old) <= 200


@BOTH
def test_texts_keep_their_order_over_many_portions(name, splitting, monkeypatch):
    monkeypatch.setattr(tokens, "_TOGETHER", 3)
    monkeypatch.setattr(tokens, "_TOGETHER_CHARS", 40)
    texts = ["", "ab  cd", None, "x" * 90, " ", "He said, go. Now", "a\nb", "\n", "ab cd", "a b " * 30, "ab"]
    whole = Tokenizer.from_file(tokens.public_path(name))
    e = tokens.Encoder(tokens.public_path(name), splitting)
    want = [[*whole.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode_all(texts)] == want
    assert [np.frombuffer(x, "<u4").tolist() for t in texts for x in e.encode_all([t])] == want
    assert [*e.encode_all([])] == []
