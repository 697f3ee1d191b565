"""Token ids by the tokenizers library, with each distinct piece of text encoded once per worker.

Both public vocabularies split a text into pieces before they merge bytes, and no merge crosses a piece. So the ids of a
text are those of its pieces in order. Pieces are cut here only where the vocabulary's own splitting surely cuts:

* "words": white space is dropped and A-Z is lower-cased, so a text is cut at each space and line feed, and before a full
  stop or comma that stands between a letter or digit and one of these.
* "bytes": a word takes the one space before it with it. If every white space of a text is one space or line feed between
  other characters, the same cuts hold; other texts are cut by the vocabulary's own pattern, more coarsely. The pieces lie
  one behind the other, so cutting finds where they begin in the bytes of a whole column and copies none.

Pieces are numbered by Arrow, many texts at once, so that Python sees a distinct piece once for all of them; for "bytes" the
numbers of many columns wait for each other, without the texts. The library encodes the pieces that a worker has not seen; a
cache of bounded size keeps their ids as little-endian unsigned 32-bit integers. It has two halves: when the newer is full it
becomes the older, and what was the older goes, without the pieces that were met meanwhile.
"""

from __future__ import annotations

import itertools
import operator
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from factgrid.llm.common import give_back

#: Unicode white space, as the vocabulary's pattern has it.
_WS = "\t-\r \x85\xa0  -     　"
_COARSE = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: A stop or comma that may belong to what stands before it: no letter or digit is there.
_BOUND_STOP = re.compile(r"[.,](?<![^\W_][.,])[ \n]")
#: A word and the ASCII signs that end it, without the apostrophe: both vocabularies cut between the two.
_TAILED = re.compile(r"( ?[^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")
#: Of the characters that take one or two bytes, those that are letters or digits.
_WORDLY = np.array([bool(re.match(r"[^\W_]", chr(c))) for c in range(1 << 11)])
#: White space that takes two or three bytes, by these.
_WIDE_SPACE = {n: np.array([int.from_bytes(x) for c in range(0x80, 0x3001) if re.match(f"[{_WS}]", chr(c)) and len(x := chr(c).encode()) == n]) for n in (2, 3)}
END = (0).to_bytes(4, "little")
#: Pieces in both halves of the cache, by splitting. Packing keeps less, as it shares its workers with a pipeline's other stages.
MAX_CACHED = {"words": 300_000, "bytes": 1_200_000}
#: Plain words that are encoded in one string; where each begins or ends shows in its tokens.
_JOINED = 64
#: Texts that are cut together: so many at most, or as many as first have so many characters.
_TOGETHER, _TOGETHER_CHARS = 2000, 4_000_000
#: Pieces that are looked up together, of which the new ones are encoded together.
_LOOKED_UP = 20_000
#: Pieces whose numbers wait for each other, in several columns: they take four bytes each.
_WAITING = 8_000_000

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _portions(texts: Iterable[str | None]) -> Iterator[list[str]]:
    some, n = [], 0
    for text in texts:
        some.append(text or "")
        n += len(some[-1])
        if len(some) >= _TOGETHER or n >= _TOGETHER_CHARS:
            yield some
            some, n = [], 0
    if some:
        yield some


def cut_column(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the pieces of the vocabulary "bytes" begin in the UTF-8 of all texts, with an empty piece behind each text, and where the last one ends; the number of pieces up to each text's end; that UTF-8."""
    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    full = bounds[:-1] < bounds[1:]
    begins, ends = bounds[:-1][full], bounds[1:]
    line = raw == 10
    white = line | (raw == 32)
    cut = white.copy()
    cut[1:] |= line[:-1]
    cut[begins] = True
    # stops and commas behind a letter or digit, before white space or a text's end
    edge = white.copy()
    edge[begins] = True
    at = np.flatnonzero(((raw == 46) | (raw == 44)) & np.append(edge, True)[1:])
    before, lead = raw[at - 1].astype(np.int32), raw[at - 2].astype(np.int32)
    code = np.where(before < 128, before, np.where((lead >= 0xC0) & (lead < 0xE0), (lead & 31) << 6 | before & 63, 0))
    cut[at[_WORDLY[code]]] = True
    # white space that is not one space or line feed between other characters
    odd = [begins[white[begins]], ends[full][white[ends[full] - 1]] - 1, np.flatnonzero(white[1:] & white[:-1]), np.flatnonzero((raw - np.uint8(9) < 5) & ~line)]
    wide = np.flatnonzero(raw == 0xC2)
    odd.append(wide[np.isin(raw[wide].astype(np.int32) << 8 | raw[wide + 1], _WIDE_SPACE[2])])
    wide = np.flatnonzero(raw - np.uint8(0xE1) < 3)
    wide = wide[np.isin(raw[wide + 1], (0x80, 0x81, 0x9A))]
    odd.append(wide[np.isin(raw[wide].astype(np.int32) << 16 | raw[wide + 1].astype(np.int32) << 8 | raw[wide + 2], _WIDE_SPACE[3])])
    for k in np.unique(np.searchsorted(ends, np.concatenate(odd), "right")).tolist():
        text = texts[k].as_py()
        sizes = [*map(len, _COARSE.findall(text) if text.isascii() else map(str.encode, _COARSE.findall(text)))]
        cut[bounds[k] : ends[k]] = False
        cut[bounds[k] + np.cumsum([0, *sizes[:-1]])] = True
    starts = np.flatnonzero(cut)
    k = np.searchsorted(starts, ends)
    return np.append(np.insert(starts, k, ends), len(raw)), k + np.arange(1, len(k) + 1), raw


class Encoder:
    """ids of whole texts; splitting: "words" or "bytes"; path: the vocabulary's file on the machine that runs it."""

    def __init__(self, path: str, splitting: str, max_cached: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.splitting, self.max_cached = splitting, max_cached or MAX_CACHED[splitting]
        size = self.tokenizer.get_vocab_size()
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.edge = np.array([t.endswith("</w>") if splitting == "words" else t.startswith("Ġ") for t in tokens])
        self.line = -1 if splitting == "words" else tokens.index("Ċ")
        # plain words need no normal form and no pattern: the same model behind a splitter that knows spaces alone
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), level]) if splitting == "words" else level
        self.small = size <= 1 << 16
        self._clear()

    def _clear(self) -> None:
        self.old: dict[str, bytes] = {}
        self.cache: dict[str, bytes] = {}

    def _cut(self, text: str) -> str:
        """For "words": the text with one space between pieces."""
        text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        if not _BOUND_STOP.search(text):
            text = text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " . ").replace(",\n", " , ")
        return text.replace("\n", " ")

    def _is_plain(self, piece: str) -> bool:
        """Letters alone, which the vocabulary's normal form and splitting leave as they are; for "bytes" a space may come first."""
        if self.splitting == "bytes":
            return piece.removeprefix(" ").isalpha()
        return piece.isalpha() and (piece.isascii() or (piece == piece.lower() and unicodedata.is_normalized("NFC", piece)))

    def _learn(self, pieces: list[str]) -> None:
        """Puts distinct pieces that the newer half of the cache lacks into it."""
        words, held = self.splitting == "words", [*map(self.old.get, pieces)]
        if len(self.cache) + len(pieces) > self.max_cached // 2:
            self.old, self.cache = self.cache, {}
        cache = self.cache
        cache.update(x for x in zip(pieces, held) if x[1] is not None)
        if not words:
            cache[""] = END
        new = [p for p, ids in zip(pieces, held) if ids is None and (p or words)]
        is_plain = [*map(self._is_plain, new)]
        plain, other, tailed = dict.fromkeys(itertools.compress(new, is_plain)), set(), {}
        for p in itertools.compress(new, map(operator.not_, is_plain)):
            if (m := _TAILED.fullmatch(p)) and self._is_plain(m[1]):
                word, tail = tailed[p] = m.groups()
                if word not in cache:
                    plain[word] = None
                if tail not in cache:
                    other.add(tail)
            else:
                other.add(p)
        if other := [*other]:
            for p, x in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
                cache[p] = np.array(x.ids, dtype="<u4").tobytes()
        # words one after another: each ends with its last token, or begins with the space, or has a line feed behind it
        spaced = [*plain] if words else [p for p in plain if p[0] == " "]
        bare = [] if words else [p for p in plain if p[0] != " "]
        for keys, between, last in ((spaced, " " if words else "", ""), (bare, "\n", "\n")):
            if not keys:
                continue
            lines = [between.join(keys[i : i + _JOINED]) + last for i in range(0, len(keys), _JOINED)]
            ids = np.fromiter(itertools.chain.from_iterable(x.ids for x in self.plain.encode_batch_fast(lines, add_special_tokens=False)), dtype="<u4")
            at = np.flatnonzero(ids == self.line if last else self.edge[ids])
            if last:
                begins, ends = np.append(0, at[:-1] + 1), at
            elif words:
                begins, ends = np.append(0, at[:-1] + 1), at + 1
            else:
                begins, ends = at, np.append(at[1:], len(ids))
            assert len(at) == len(keys)
            raw = ids.tobytes()
            cache.update(zip(keys, [raw[a:b] for a, b in zip((begins * 4).tolist(), (ends * 4).tolist())]))
        for p, (word, tail) in tailed.items():
            cache[p] = cache[word] + cache[tail]

    def _ids(self, pieces: pa.Array) -> pa.Array:
        """ids of distinct pieces; what the library returns for many at once takes far more than their ids."""
        parts, most = [], max(1, min(_LOOKED_UP, self.max_cached // 4))
        for i in range(0, len(pieces), most):
            keys = pieces.slice(i, most).to_numpy(zero_copy_only=False).tolist()
            found = pa.array([*map(self.cache.get, keys)], pa.large_binary())
            if found.null_count:
                lacking = found.is_null()
                self._learn(missing := [*itertools.compress(keys, lacking.to_numpy(zero_copy_only=False).tolist())])
                found = pc.replace_with_mask(found, lacking, pa.array([*map(self.cache.__getitem__, missing)], pa.large_binary()))
            parts.append(found)
        return pa.concat_arrays(parts)

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        """For "words": ids of each text and the end id."""
        lists = pc.split_pattern(pa.array([*map(self._cut, texts)], pa.large_string()), " ")
        numbered = lists.flatten().dictionary_encode()
        ids = self._ids(numbered.dictionary).take(numbered.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[lists.offsets.to_numpy()]
        raw = memoryview(ids.buffers()[2] or b"")
        for begin, end in itertools.pairwise(ends.tolist()):
            yield raw[begin:end].tobytes() + END

    def encode_columns(self, columns: Iterable[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For "bytes" and each column of texts that has any: the ids of all of them, an end id behind each text, and where each text ends."""
        waiting, n = [], 0
        for column in columns:
            if not len(column):
                continue
            starts, ends, raw = cut_column(column)
            pieces = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(raw)).dictionary_encode()
            waiting.append((pieces.indices.to_numpy(), pieces.dictionary, ends))
            n += len(pieces)
            del column, starts, raw, pieces
            give_back()
            if n >= _WAITING:
                yield from self._numbered(waiting)
                waiting, n = [], 0
        yield from self._numbered(waiting)

    def _numbered(self, columns: list[tuple[np.ndarray, pa.Array, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not columns:
            return
        known = pa.concat_arrays([dictionary for _, dictionary, _ in columns]).dictionary_encode()
        ids, number, at = self._ids(known.dictionary), known.indices.to_numpy(), 0
        for own, dictionary, ends in columns:
            taken = ids.take(pa.array(number[at : at + len(dictionary)][own]))
            at += len(dictionary)
            yield np.frombuffer(taken.buffers()[2], "<u4"), np.frombuffer(taken.buffers()[1], np.int64, len(own) + 1)[ends] // 4
        del taken
        give_back()

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """For each text its ids and the end id, as little-endian unsigned 32-bit integers."""
        if self.splitting == "words":
            for some in _portions(texts):
                yield from self._together(some)
        else:
            for ids, ends in self.encode_columns(pa.array(some, pa.large_string()) for some in _portions(texts)):
                yield from (ids[a:b].tobytes() for a, b in itertools.pairwise([0, *ends.tolist()]))

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, splitting: str) -> Encoder:
    """The worker's encoder: one process runs many tasks, and keeps what it has learnt."""
    if (path, splitting) not in _encoders:
        _encoders[path, splitting] = Encoder(path, splitting)
    return _encoders[path, splitting]
