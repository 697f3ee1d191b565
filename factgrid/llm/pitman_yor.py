"""Scores of texts by a hierarchical Pitman-Yor bigram model of the corpus.

Each word is a context with a restaurant of its own, in which the words after it are seated; all these share one parent
restaurant over words, whose base is uniform over the vocabulary and an unknown word. A new table in a child sends one
customer to the parent. Sweeps alternate: first the children, whose new tables weigh by the parent's predictive
probability of the dish, then the parent, whose customers are the children's tables. In a sweep all customers of a dish take
their seats again, given the other tables of the restaurant (`seated`: one by one at first, then in parties of a sixteenth
of those that sit). The first sweep burns in; after each of the SWEEPS that follow the predictive probability of each pair
is noted, and their average counts. score is the log10 probability of a text's tokens, each after the one before it, and
the first after an end; perplexity is 10 ** (-score / n_tokens).

How it is spread: texts become chunks of tokens (numbers in the chunk's own vocabulary), written to the shared folder. A
chunk sends each distinct pair once, with its count in training texts, to the shard of the pair's first word; pairs of very
frequent first words are dealt by both words. Shards of pairs merge counts; shards of words count words and seat the parent.
A sweep is two steps, each written: the shards of pairs get the parent's numerators for their dishes, and send their tables
by dish back. Sums over all shards (tables of the restaurants that are dealt out, customers and tables of the parent) go
through the driver. Last, shards answer the chunks in the order of their requests, and each chunk meets its answers and
scores its documents. What moves is sorted arrays, compressed: distinct words and pairs of each chunk, which grow with the
corpus, and no rows for single tokens. The number of shards grows with the number of tokens; mail between chunks and shards
has a row for each of both.

Word counts (c, N, V) use 64-bit hashes of words and are exact counts of all training tokens; the model's pairs use 40 bits
for each word. Nulls: a null text is empty: one end; a document with a null doc_id belongs to training. Rows that repeat
count as often as they are there. An empty table gives an empty result; without training texts all words are unknown.
Other columns, whatever their names, stay outside.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgrid.llm.common import crc32_of_id, forgotten_shuffles, only, release, schema, stored

DISCOUNT, STRENGTH = 0.75, 1.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.6, 1.0
SWEEPS = 3
CHUNK_TOKENS = 2_000_000
TOKENS_PER_SHARD, LEAST_SHARDS = 2_000_000, 64
#: The end of a text as a token; no word holds a space.
END = np.uint64(xxhash.xxh3_64_intdigest(b" end"))
_SHORT = np.uint64(24)


def _pack(*arrays: np.ndarray) -> list[bytes]:
    """Compressed arrays, first bytes first: the upper bytes of numbers are mostly alike."""
    c = zstandard.ZstdCompressor(level=1)
    return [c.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()) for a in arrays]


def _unpack(parts: list[bytes], *kinds) -> list[np.ndarray]:
    d = zstandard.ZstdDecompressor()
    return [np.ascontiguousarray(np.frombuffer(d.decompress(p), dtype=np.uint8).reshape(np.dtype(k).itemsize, -1).T).view(k).ravel() for p, k in zip(parts, kinds, strict=True)]


def seated(customers: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after all its customers have sat down; new: the weight of a new table. One by one at first, then in growing parties."""
    tables = np.minimum(customers, 1).astype(np.float64)
    at = np.flatnonzero(customers > 1)
    c, a, t = customers[at], new[at], np.ones(len(at))
    n = 1
    while len(at):
        party = max(1, n // 16)
        come = np.minimum(party, c - n).astype(np.int64)
        p = a / (a + n - discount * t)
        t = np.minimum(t + (rng.random(len(at)) < p if party == 1 else rng.binomial(come, p)), c)
        n += party
        if (done := c <= n).any():
            tables[at[done]] = t[done]
            at, c, a, t = at[~done], c[~done], a[~done], t[~done]
    return tables


# ---- chunks --------------------------------------------------------------------------------------------------------

_CHUNK = "chunk long, n long, n_train long, doc_ids array<long>, held array<boolean>, lengths array<long>, parts array<binary>"
_MAIL = "kind int, target long, origin long, parts array<binary>"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, k = TaskContext.get().partitionId() << 32, 0
    docs, held, hashes, n = [], [], [], 0

    def ship() -> pa.RecordBatch:
        tokens = np.concatenate(hashes)
        lengths = np.array([len(h) for h in hashes], dtype=np.int64)
        vocabulary, numbers = np.unique(tokens, return_inverse=True)
        train = np.repeat(~np.array(held, dtype=bool), lengths)
        counts = np.bincount(numbers[train], minlength=len(vocabulary)).astype(np.uint32)
        row = [[first + k], [len(tokens)], [int(train.sum())], [docs], [held], [lengths.tolist()], [_pack(vocabulary, numbers.astype(np.uint32), counts)]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.binary())), strict=True)], names=["chunk", "n", "n_train", "doc_ids", "held", "lengths", "parts"])

    for batch in batches:
        for doc_id, text, out in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            own = np.empty(len(words) + 1, dtype=np.uint64)
            own[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
            own[-1] = END
            docs.append(doc_id)
            held.append(bool(out))
            hashes.append(own)
            n += len(own)
            if n >= CHUNK_TOKENS:
                yield ship()
                docs, held, hashes, n, k = [], [], [], 0, k + 1
    if docs:
        yield ship()


def _pairs(n_words: int, end: int, numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each token the pair of the token before it and itself, as one number; end: the number of the end token."""
    before = np.empty(len(numbers), dtype=np.int64)
    before[1:] = numbers[:-1]
    before[np.cumsum(lengths) - lengths] = end
    return before * n_words + numbers.astype(np.int64)


def _turns(vocabulary: np.ndarray, hot: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each word as a first word, and whether its pairs are dealt by both words."""
    mixed = ((vocabulary >> _SHORT) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return (mixed % np.uint64(shards)).astype(np.uint32), np.isin(vocabulary, hot)


def _dealt(turn: np.ndarray, often: np.ndarray, distinct: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the distinct pairs by shard, and bounds of the shards in it."""
    first, second = distinct // len(turn), distinct % len(turn)
    shard = (turn[first] + np.where(often[first], turn[second] * np.uint32(31), np.uint32(0))) % np.uint32(shards)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _slim(shards: int, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks with the shards of their words in place of the words: what is needed to place the answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                vocabulary, numbers, _ = _unpack(parts, np.uint64, np.uint32, np.uint32)
                end = np.array([np.searchsorted(vocabulary, END)], dtype=np.int64)
                out.append(_pack(end, *_turns(vocabulary, shared.value, shards), numbers))
            at = batch.schema.get_field_index("parts")
            yield batch.set_column(at, "parts", pa.array(out, pa.list_(pa.binary())))

    return run


def _often(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, parts in zip(batch.column("n").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                vocabulary, numbers, _ = _unpack(parts, np.uint64, np.uint32, np.uint32)
                counts = np.bincount(numbers)
                at = np.flatnonzero(counts * 4 * shards > n)  # at most 4 * shards words of a chunk
                yield pa.RecordBatch.from_arrays([pa.array(vocabulary[at].view(np.int64), pa.int64()), pa.array(counts[at], pa.int64())], names=["word", "n"])

    return run


def _pair_requests(shards: int, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vocabulary, numbers, _ = _unpack(row["parts"], np.uint64, np.uint32, np.uint32)
                lengths = np.array(row["lengths"], dtype=np.int64)
                pairs = _pairs(len(vocabulary), int(np.searchsorted(vocabulary, END)), numbers, lengths)
                train = np.repeat(~np.array(row["held"], dtype=bool), lengths)
                distinct = np.unique(pairs)
                known, times = np.unique(pairs[train], return_counts=True)
                counts = np.zeros(len(distinct), dtype=np.uint32)
                counts[np.searchsorted(distinct, known)] = times
                order, bounds = _dealt(*_turns(vocabulary, shared.value, shards), distinct, shards)
                counts, short = counts[order], vocabulary >> _SHORT
                first, second = short[distinct[order] // len(vocabulary)], short[distinct[order] % len(vocabulary)]
                targets, parts = [], []
                for s in range(shards):
                    own = slice(bounds[s], bounds[s + 1])
                    if bounds[s] < bounds[s + 1]:
                        u = first[own]
                        starts = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
                        runs = np.diff(np.append(starts, len(u))).astype(np.uint32)
                        w = second[own]
                        targets.append(s)
                        parts.append(_pack(u[starts], runs, (w & np.uint64(0xFFFFFFFF)).astype(np.uint32), (w >> np.uint64(32)).astype(np.uint8), counts[own]))
                yield _mail([2] * len(targets), targets, [row["chunk"]] * len(targets), parts)

    return run


def _word_requests(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, parts in zip(batch.column("chunk").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                vocabulary, _, counts = _unpack(parts, np.uint64, np.uint32, np.uint32)
                bounds = _word_bounds(vocabulary >> _SHORT, shards)
                used = [s for s in range(shards) if bounds[s] < bounds[s + 1]]
                yield _mail([2] * len(used), used, [chunk] * len(used), [_pack(vocabulary[bounds[s] : bounds[s + 1]], counts[bounds[s] : bounds[s + 1]]) for s in used])

    return run


def _word_bounds(short: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's words begin in a sorted array of short hashes; shards is a power of two."""
    step = 40 - (shards.bit_length() - 1)
    return np.append(np.searchsorted(short, np.arange(shards, dtype=np.uint64) << np.uint64(step)), len(short))


def _mail(kinds: list, targets: list, origins: list, parts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(targets, pa.int64()), pa.array(origins, pa.int64()), pa.array(parts, pa.list_(pa.binary()))], names=["kind", "target", "origin", "parts"])


def _posted(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_mail(*map(list, zip(*rows, strict=True)))]) if rows else pa.Table.from_batches([_mail([], [], [], [])])


# ---- shards --------------------------------------------------------------------------------------------------------
# Kinds of mail. 0: answers of pairs to a chunk; 2: requests of a chunk; 4: sums for all; 5: word counts to a chunk;
# 6: a shard's restaurants; 7: where a chunk's pairs are; 8: dishes asked of a shard of words, 13: where they are there;
# 9: the parent's numerators of dishes; 12: tables of pairs; 14: tables and customers of
# a shard's part of the dealt restaurants; 15: tables by dish; 16: the parent's tables. 9 and 12 of a sample that counts have
# 100 times its number more.


def _steps(at: np.ndarray) -> bytes:
    return _pack(np.diff(at, prepend=0).astype(np.int32))[0]


def _places(part: bytes) -> np.ndarray:
    return np.cumsum(_unpack([part], np.int32)[0], dtype=np.int64)


def _mailbox(table: pa.Table) -> tuple[int, dict[int, list[tuple[int, list[bytes]]]]]:
    """The shard, and its mail by kind: (origin, parts) in the order of origins."""
    table = table.sort_by([("kind", "ascending"), ("origin", "ascending")])
    by: dict[int, list[tuple[int, list[bytes]]]] = {}
    for kind, origin, parts in zip(*(table.column(c).to_pylist() for c in ("kind", "origin", "parts")), strict=True):
        by.setdefault(kind, []).append((origin, parts))
    return table.column("target")[0].as_py(), by


def _by_dish(shard: int, shards: int, bounds: np.ndarray, which: np.ndarray, tables: np.ndarray) -> list[tuple]:
    sums = np.bincount(which, weights=tables, minlength=int(bounds[-1])).astype(np.int64)
    return [(15, s, shard, _pack(sums[bounds[s] : bounds[s + 1]])) for s in range(shards) if bounds[s] < bounds[s + 1]]


def _of_dealt(shard: int, room: np.ndarray, place: np.ndarray, *values: np.ndarray) -> tuple:
    sums = [np.bincount(room, weights=x, minlength=len(place))[place >= 0] for x in values]
    return 14, -1, shard, _pack(place[place >= 0].astype(np.int64), *sums)


def _merged(shards: int, shared) -> Callable[[pa.Table], pa.Table]:
    """Merges the pairs of a shard, and seats each dish at one table."""

    def run(table: pa.Table) -> pa.Table:
        shard, by = _mailbox(table)
        us, ws, cs = [], [], []
        for _, parts in by[2]:
            u, runs, low, high, c = _unpack(parts, np.uint64, np.uint32, np.uint32, np.uint8, np.uint32)
            us.append(np.repeat(u, runs))
            ws.append((high.astype(np.uint64) << np.uint64(32)) | low)
            cs.append(c)
        sizes = [len(c) for c in cs]
        u, w, c = (np.concatenate(x) for x in (us, ws, cs))
        del us, ws, cs
        order = np.lexsort((w, u))
        su, sw = u[order], w[order]
        fresh = np.concatenate(([True], (su[1:] != su[:-1]) | (sw[1:] != sw[:-1])))
        starts = np.flatnonzero(fresh)
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.cumsum(fresh) - 1
        u, w = su[starts], sw[starts]
        counts = np.bincount(group, weights=c, minlength=len(starts))
        first = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
        runs = np.diff(np.append(first, len(u))).astype(np.uint32)
        dishes, which = np.unique(w, return_inverse=True)
        bounds = _word_bounds(dishes, shards)
        hot = np.unique(np.asarray(shared.value, dtype=np.uint64) >> _SHORT)
        at = np.minimum(np.searchsorted(hot, u[first]), max(0, len(hot) - 1))
        place = np.where(hot[at] == u[first], at, -1).astype(np.int32) if len(hot) else np.full(len(first), -1, dtype=np.int32)
        out = [(6, shard, -1, _pack(runs, place, which.astype(np.uint32), counts.astype(np.int64), bounds.astype(np.int64)))]
        at = 0
        for (origin, _), size in zip(by[2], sizes, strict=True):
            out.append((7, shard, origin, [_steps(group[at : at + size])]))
            at += size
        tables = np.minimum(counts, 1)
        out += [(8, s, shard, _pack(dishes[bounds[s] : bounds[s + 1]])) for s in range(shards) if bounds[s] < bounds[s + 1]]
        room = np.repeat(np.arange(len(runs)), runs)
        return _posted([*out, *_by_dish(shard, shards, bounds, which, tables), _of_dealt(shard, room, place, tables, counts)])

    return run


def _counted(table: pa.Table) -> pa.Table:
    """Merges the word counts of a shard, and finds its dishes."""
    shard, by = _mailbox(table)
    words, counts = zip(*(_unpack(parts, np.uint64, np.uint32) for _, parts in by[2]), strict=True)
    vocabulary, which = np.unique(np.concatenate(words), return_inverse=True)
    c = np.bincount(which, weights=np.concatenate(counts))
    short = vocabulary >> _SHORT
    out = [(4, -1, shard, [np.array([c.sum(), float((c > 0).sum())]).tobytes()])]
    at = 0
    for (origin, _), own in zip(by[2], words, strict=True):
        out.append((5, origin, shard, _pack(c[which[at : at + len(own)]].astype(np.int64))))
        at += len(own)
    return _posted([*out, *((13, shard, origin, [_steps(np.searchsorted(short, _unpack(parts, np.uint64)[0]))]) for origin, parts in by.get(8, ()))])


class _Shared:
    """What a sweep knows of all shards: the vocabulary, the parent's customers and tables, and those of the dealt restaurants by place."""

    def __init__(self, v: float, customers: float, tables: float, dealt_tables: np.ndarray, dealt_customers: np.ndarray):
        self.v, self.customers, self.tables, self.dealt_tables, self.dealt_customers = v, customers, tables, dealt_tables, dealt_customers

    def parent(self, numerator: np.ndarray) -> np.ndarray:
        """The parent's predictive probabilities."""
        return (numerator + (PARENT_STRENGTH + PARENT_DISCOUNT * self.tables) / (self.v + 1)) / (PARENT_STRENGTH + self.customers)


class _Restaurants:
    """The restaurants of a shard: its pairs by context and by dish, with their counts."""

    def __init__(self, parts: list[bytes]):
        runs, self.place, self.which, counts, self.bounds = _unpack(parts, np.uint32, np.int32, np.uint32, np.int64, np.int64)
        self.counts = counts.astype(np.float64)
        self.room = np.repeat(np.arange(len(runs)), runs)

    def of_rooms(self, values: np.ndarray, dealt: np.ndarray) -> np.ndarray:
        out = np.bincount(self.room, weights=values, minlength=len(self.place))
        own = self.place >= 0
        out[own] = dealt[self.place[own]]
        return out[self.room]

    def parent(self, numerators: list[tuple[int, list[bytes]]], known: _Shared) -> np.ndarray:
        return known.parent(np.concatenate([_unpack(parts, np.float32)[0] for _, parts in numerators]).astype(np.float64))[self.which]

    def predictive(self, tables: np.ndarray, p0: np.ndarray, known: _Shared) -> np.ndarray:
        t, c = self.of_rooms(tables, known.dealt_tables), self.of_rooms(self.counts, known.dealt_customers)
        return (self.counts - DISCOUNT * tables + (STRENGTH + DISCOUNT * t) * p0) / (STRENGTH + c)


def _tables(parts: list[bytes]) -> np.ndarray:
    return _unpack(parts, np.uint32)[0].astype(np.float64)


def _children(shards: int, sweep: int, known: _Shared) -> Callable[[pa.Table], pa.Table]:
    """A sweep over a shard's restaurants, given the parent and the tables before."""

    def run(table: pa.Table) -> pa.Table:
        shard, by = _mailbox(table)
        own = _Restaurants(by[6][0][1])
        tables = _tables(by[12][0][1]) if 12 in by else np.minimum(own.counts, 1)
        others = np.maximum(0, own.of_rooms(tables, known.dealt_tables) - tables)
        tables = seated(own.counts, (STRENGTH + DISCOUNT * others) * own.parent(by[9], known), DISCOUNT, np.random.default_rng((17, shard, sweep)))
        return _posted([(12, shard, -1, _pack(tables.astype(np.uint32))), *_by_dish(shard, shards, own.bounds, own.which, tables), _of_dealt(shard, own.room, own.place, tables, own.counts)])

    return run


def _answered(samples: list[_Shared]) -> Callable[[pa.Table], pa.Table]:
    """Predictive probabilities, averaged over the samples, in the order in which each chunk asked."""

    def run(table: pa.Table) -> pa.Table:
        shard, by = _mailbox(table)
        own = _Restaurants(by[6][0][1])
        p = np.zeros(len(own.counts))
        for k, known in enumerate(samples):
            p += own.predictive(_tables(by[12 + 100 * (k + 1)][0][1]), own.parent(by[9 + 100 * (k + 1)], known), known) / len(samples)
        p = p.astype(np.float32)
        return _posted([(0, origin, shard, _pack(p[_places(parts[0])])) for origin, parts in by[7]])

    return run


def _parent(sweep: int, v: float, tables: float | None) -> Callable[[pa.Table], pa.Table]:
    """Seats the parent's customers of a shard of words anew, given its tables in all shards (None: each word gets one table), and answers the shards of pairs."""

    def run(table: pa.Table) -> pa.Table:
        shard, by = _mailbox(table)
        places = {origin: _places(parts[0]) for origin, parts in by.get(13, ())}
        n = max((int(x.max()) + 1 for x in places.values() if len(x)), default=0)
        customers = np.zeros(n)
        for origin, parts in by.get(15, ()):
            customers[places[origin]] += _unpack(parts, np.int64)[0]
        before = _unpack(by[16][0][1], np.uint32)[0].astype(np.float64) if 16 in by else np.minimum(customers, 1)
        own = before
        if tables is not None:
            new = (PARENT_STRENGTH + PARENT_DISCOUNT * np.maximum(0, tables - before)) / (v + 1)
            own = seated(customers, new, PARENT_DISCOUNT, np.random.default_rng((29, shard, sweep)))
        numerator = np.maximum(0, customers - PARENT_DISCOUNT * own).astype(np.float32)
        out = [(16, shard, -1, _pack(own.astype(np.uint32))), (4, -1, shard, [np.array([customers.sum(), own.sum()]).tobytes()])]
        return _posted([*out, *((9, origin, shard, _pack(numerator[at])) for origin, at in places.items())])

    return run


def _unpacked_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for parts in batch.column("parts").to_pylist():
            place, tables, customers = _unpack(parts, np.int64, np.float64, np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(tables, pa.float64()), pa.array(customers, pa.float64())], names=["place", "tables", "customers"])


def _scored(shards: int, n_all: float, v: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        _, by = _mailbox(answers)
        end, turn, often, numbers = _unpack(row["parts"], np.int64, np.uint32, bool, np.uint32)
        lengths = np.array(row["lengths"], dtype=np.int64)
        c = np.concatenate([_unpack(parts, np.int64)[0] for _, parts in by[5]])
        distinct, at = np.unique(_pairs(len(turn), int(end[0]), numbers, lengths), return_inverse=True)
        order = _dealt(turn, often, distinct, shards)[0]
        of_pair = np.empty(len(distinct))
        of_pair[order] = np.log10(np.concatenate([_unpack(parts, np.float32)[0] for _, parts in by[0]]).astype(np.float64))
        log_base = np.log10((c + 1.0) / (n_all + v + 1.0))
        starts = np.cumsum(lengths) - lengths
        known, base, score = (np.add.reduceat(x, starts) for x in ((c > 0).astype(np.int64)[numbers], log_base[numbers], of_pair[at]))
        arrays = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(lengths, pa.int64()), pa.array(known, pa.int64()), pa.array([int(n_all)] * len(lengths), pa.int64())]
        arrays += [pa.array(x, pa.float64()) for x in (base, score, 10 ** (-score / lengths))]
        return pa.Table.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return run


# ---- the operator ---------------------------------------------------------------------------------------------------


def scored(documents: DataFrame, held_out: Column, scope: str = "query") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each document; learnt from those not held out."""
    spark = documents.sparkSession
    docs = only(documents, doc_id="long", text="string").withColumn("held", F.coalesce(held_out, F.lit(False)))
    first, early = f"{scope} {uuid.uuid4().hex}", f"{scope} {uuid.uuid4().hex}"  # tables that go before the end
    chunks = stored(docs.mapInArrow(_chunks, schema(_CHUNK)), "chunks", first)
    n = chunks.agg(F.sum("n").alias("n")).first()["n"] or 0
    shards = LEAST_SHARDS
    while shards * TOKENS_PER_SHARD < n:
        shards *= 2
    often = chunks.select("n", "parts").mapInArrow(_often(shards), schema("word long, n long")).groupBy("word").agg(F.sum("n").alias("n"))
    hot = [r["word"] for r in often.where(F.col("n") * 8 * shards > n).collect()]  # 8 * shards words at most
    shared = spark.sparkContext.broadcast(np.sort(np.array(hot, dtype=np.int64).view(np.uint64)))

    mail = schema(_MAIL)
    by_target = lambda df, f, name, scope: stored(df.groupBy("target").applyInArrow(f, mail), name, scope, by="kind")
    of = lambda df, *kinds: df.where(F.col("kind").isin(*kinds)).select(*mail.names)
    summed = lambda df: [float(x) for x in np.sum([[0.0, 0.0], *(np.frombuffer(r["parts"][0]) for r in of(df, 4).collect())], axis=0)]  # noqa: E731 - a row for each shard

    def dealt(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((2, len(hot)))
        for r in of(df, 14).mapInArrow(_unpacked_sums, schema("place long, tables double, customers double")).groupBy("place").agg(F.sum("tables").alias("t"), F.sum("customers").alias("c")).collect():  # 8 * shards rows at most
            out[:, r["place"]] = r["t"], r["c"]
        return out[0], out[1]

    asked = chunks.select("chunk", "held", "lengths", "parts").mapInArrow(_pair_requests(shards, shared), mail)
    merged = by_target(asked, _merged(shards, shared), "merged", early)
    del asked
    forgotten_shuffles(spark)
    requests = chunks.select("chunk", "parts").mapInArrow(_word_requests(shards), mail).unionByName(of(merged, 8))
    words = by_target(requests, _counted, "words", scope)
    del requests
    forgotten_shuffles(spark)
    n_all, v = summed(words)

    slim = stored(chunks.mapInArrow(_slim(shards, shared), schema(_CHUNK)), "slim-chunks", scope)
    del chunks
    release(spark, first)

    children, parent, known, samples, noted = merged, None, None, [], None
    for sweep in range(2 + SWEEPS):
        asked = of(words, 13).unionByName(of(children, 15))
        new = by_target(asked.unionByName(of(parent, 16)) if parent else asked, _parent(sweep, v, known.tables if known else None), "parent", f"{early} {sweep}")
        known, parent = _Shared(v, *summed(new), *dealt(children)), new
        if sweep > 1:  # the first sweep burned in: this state is a sample
            samples.append(known)
            own = of(parent, 9).unionByName(of(children, 12)).withColumn("kind", F.col("kind") + 100 * len(samples))
            noted = noted.unionByName(own) if noted else own
        if sweep <= SWEEPS:
            given = of(merged, 6).unionByName(of(parent, 9))
            children = by_target(given.unionByName(of(children, 12)) if sweep else given, _children(shards, sweep, known), "children", f"{early} {sweep}")
            del given
        del asked, new
        forgotten_shuffles(spark)
    answers = stored(of(merged, 6, 7).unionByName(noted).groupBy("target").applyInArrow(_answered(samples), mail), "answers", scope)
    del merged, children, parent, noted
    for done in (early, *(f"{early} {sweep}" for sweep in range(2 + SWEEPS))):
        release(spark, done)
    forgotten_shuffles(spark)
    replies = answers.unionByName(of(words, 5))
    kind = schema("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
    return slim.groupBy("chunk").cogroup(replies.groupBy("target")).applyInArrow(_scored(shards, n_all, v), kind)


def evaluated(documents: DataFrame) -> DataFrame:
    return scored(documents, F.pmod(crc32_of_id(F.col("doc_id")), F.lit(7)) == 2)


def perplexity(scores: DataFrame) -> DataFrame:
    """held_out, n_tokens, perplexity and base_perplexity (of the counts alone) over all tokens."""
    out = scores.groupBy("held_out").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "score", "base_score")))
    return out.select("held_out", "n_tokens", *(F.pow(F.lit(10.0), -F.col(c) / F.col("n_tokens")).alias(name) for c, name in (("score", "perplexity"), ("base_score", "base_perplexity"))))
