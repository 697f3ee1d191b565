"""Packing of documents into sequences by a grouping genetic algorithm on islands.

A document's ids (tokenizers, then an end id) are cut into pieces of `capacity` only if they exceed it. Full pieces are
sequences of their own. The other pieces are dealt evenly into districts of about DISTRICT pieces, and each district is
packed by ISLANDS populations, each a row of its own, which may go to any task:

* an individual is a grouping of pieces into bins; the first is best-fit decreasing, others best-fit in perturbed orders;
* crossover injects a stretch of the other parent's best-filled bins whole, removes the bins that hold duplicates of
  their pieces, and best-fits the displaced pieces; mutation empties a few of the worst-filled bins and best-fits them;
* fitness is the mean of (fill / capacity) squared; a population stops at the lower bound, which no packing can beat;
* after an epoch each island sends its elite to the next island of its district, where it replaces the worst individual; the
  rest of an island's population lives on.

Then bins that are not nearly full give their pieces back, and these are dealt anew and packed again, over districts, until
a round saves no bin or one district holds them all. Where best fit alone reaches the lower bound nothing evolves. What moves between tasks is lengths and groupings, never texts or ids.
Every round is written to the shared folder, so a lost executor costs a task.

Nulls: a null text is empty: one end id. Rows with a null or repeated doc_id are packed like others, a row each. Empty
tables give empty results. A row's place in the written table of pieces names it, so ties need no rule.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgrid.llm.common import give_back, only, schema, stored
from factgrid.llm.tokens import WORD_VOCABULARY, encoder, public_path

CAPACITY = 2048
DISTRICT = 4096
ISLANDS = 2
#: Islands that a task evolves one after another: an island alone takes less time than the start of its task.
ISLANDS_A_TASK = 8
EPOCHS = 2
POPULATION = 6
GENERATIONS = 6


def _pieces(path: str, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, "words")
        step = 4 * capacity
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, ids in zip(batch.column(0).to_pylist(), e.encode_all(batch.column(1).to_pylist()), strict=True):
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for to, x in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        to.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def tokenized(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None, scope: str = "query") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32."""
    docs = only(documents, doc_id="long", text="string")
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return stored(docs.mapInArrow(_pieces(path or public_path(WORD_VOCABULARY), capacity), schema(kind)), "pieces", scope)


# ---- one district, in memory: lengths of a bounded number of pieces ------------------------------------------------


class _Bins:
    """Open bins by what is left in them: best fit is the lowest set bit at or above a length."""

    def __init__(self, capacity: int):
        self.capacity, self.mask, self.by_rest, self.members = capacity, 0, [[] for _ in range(capacity + 1)], []

    def add(self, members: list[int], fill: int) -> None:
        rest = self.capacity - fill
        self.by_rest[rest].append(len(self.members))
        self.mask |= 1 << rest
        self.members.append(members)

    def fit(self, piece: int, length: int) -> None:
        if not (able := self.mask >> length):
            self.add([piece], length)
            return
        rest = length + (able & -able).bit_length() - 1
        bin_ = self.by_rest[rest].pop()
        if not self.by_rest[rest]:
            self.mask ^= 1 << rest
        self.members[bin_].append(piece)
        self.by_rest[rest - length].append(bin_)
        self.mask |= 1 << (rest - length)


def _best_fit(lengths: list[int], order: list[int], kept: list[list[int]], capacity: int) -> list[list[int]]:
    bins = _Bins(capacity)
    for members in kept:
        bins.add([*members], sum(lengths[i] for i in members))
    for i in order:
        bins.fit(i, lengths[i])
    return bins.members


def _fitness(lengths: list[int], bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (negated, so that smaller is better)."""
    return len(bins), -sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def _crossed(a: list[list[int]], b: list[list[int]], lengths: list[int], capacity: int, rng) -> list[list[int]]:
    """The best-filled stretch of b's bins injected whole into a; bins of a that hold any of their pieces go, and the displaced pieces are best-fitted."""
    ranked = sorted(b, key=lambda x: -sum(lengths[i] for i in x))
    share = max(1, int(len(ranked) * (0.2 + 0.4 * rng.random())))
    at = int(rng.integers(0, max(1, len(ranked) // 10)))
    injected = ranked[at : at + share]
    taken = {i for x in injected for i in x}
    kept, loose = [], []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(x)
        else:
            loose += [i for i in x if i not in taken]
    loose.sort(key=lambda i: -lengths[i])
    return _best_fit(lengths, loose, kept + injected, capacity)


def _mutated(a: list[list[int]], lengths: list[int], capacity: int, rng) -> list[list[int]]:
    ranked = sorted(a, key=lambda x: sum(lengths[i] for i in x) + rng.random() * capacity / 20)
    n = max(2, len(ranked) // 20)
    loose = [i for x in ranked[:n] for i in x]
    loose.sort(key=lambda i: -lengths[i] * (1 + 0.1 * rng.random()))
    return _best_fit(lengths, loose, ranked[n:], capacity)


def evolved(lengths: list[int], people: list[list[list[int]]] | None, migrant: list[list[int]] | None, capacity: int, seed: int) -> list[list[list[int]]]:
    """An island's population after an epoch, the best grouping first. people: that of the epoch before, best first, None in the first epoch; migrant: the neighbour's elite."""
    bound = -(-sum(lengths) // capacity)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    rng = np.random.default_rng(seed)
    if people is None:
        people = [_best_fit(lengths, order, [], capacity)]
        if len(people[0]) <= bound or len(lengths) < 3:
            return people
        while len(people) < POPULATION:
            noise = rng.normal(1, 0.03 * len(people), len(lengths))
            people.append(_best_fit(lengths, sorted(order, key=lambda i: -lengths[i] * noise[i]), [], capacity))
    elif migrant is not None:
        people = [*people[: POPULATION - 1], migrant]
    score = lambda x: _fitness(lengths, x, capacity)
    ranked = sorted(((score(x), k, x) for k, x in enumerate(people)), key=lambda x: x[:2])
    if len(lengths) < 3:
        return [ranked[0][2]]
    for g in range(GENERATIONS):
        if ranked[0][0][0] <= bound:
            break
        half = [x for _, _, x in ranked[: POPULATION // 2]]
        born = []
        for k in range(POPULATION - len(half)):
            i, j = rng.choice(len(half), 2, replace=len(half) < 2)
            born.append(_mutated(_crossed(half[i], half[j], lengths, capacity, rng), lengths, capacity, rng))
        ranked = sorted(((score(x), 1000 * g + k, x) for k, x in enumerate([*half, *born])), key=lambda x: x[:2])
    return [x for _, _, x in ranked]


def _coded(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, dtype=np.int32)
    for k, x in enumerate(bins):
        out[x] = k
    return out.tobytes()


def _decoded(raw: bytes) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, k in enumerate(np.frombuffer(raw, dtype=np.int32).tolist()):
        bins.setdefault(k, []).append(i)
    return [*bins.values()]


def _islands(capacity: int, epoch: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for district, island, raw, people, migrant, fit in zip(*(batch.column(c).to_pylist() for c in ("district", "island", "lengths", "people", "migrant", "fit")), strict=True):
                lengths = np.frombuffer(raw, dtype=np.int32).tolist()
                if people and (bins := int(np.frombuffer(people[0], dtype=np.int32).max(initial=-1)) + 1) <= -(-sum(lengths) // capacity):
                    out.append((people, bins, fit))  # at the lower bound: nothing is left to find
                    continue
                seed = 1 + 7919 * int(district) + 104729 * island + 15485863 * epoch
                grown = evolved(lengths, [_decoded(x) for x in people] if people else None, _decoded(migrant) if migrant else None, capacity, seed)
                out.append(([_coded(x, len(lengths)) for x in grown], len(grown[0]), _fitness(lengths, grown[0], capacity)[1]))
            columns = [pa.array([x[0] for x in out], pa.list_(pa.binary())), pa.array([x[0][0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("district"), batch.column("island"), batch.column("lengths"), *columns], names=["district", "island", "lengths", "people", "elite", "bins", "fit"])

    return run


def _lengths(table: pa.Table) -> pa.Table:
    order = np.argsort(table.column("row").to_numpy(), kind="stable")
    lengths = table.column("length").to_numpy()[order].astype(np.int32)
    return pa.table({"district": table.column("district")[:1], "lengths": pa.array([lengths.tobytes()], pa.binary())})


def _assigned(capacity: int, last: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Bin, place and fill of each piece of a district; loose: bins that give their pieces back."""

    def run(pieces: pa.Table, best: pa.Table) -> pa.Table:
        order = np.argsort(pieces.column("row").to_numpy(), kind="stable")
        pieces = pieces.take(pa.array(order))
        bins = np.frombuffer(best.column("elite")[0].as_py(), dtype=np.int32)
        lengths = pieces.column("length").to_numpy()
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        by_bin = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[by_bin])
        starts = np.concatenate(([0], np.cumsum(fill)))[:-1]
        offset = np.empty(len(bins), dtype=np.int64)
        offset[by_bin] = ends - lengths[by_bin] - starts[bins[by_bin]]
        loose = np.zeros(len(fill), dtype=bool) if last else fill < capacity * 0.995
        return pa.table({"row": pieces.column("row"), "length": pieces.column("length"), "district": pieces.column("district"), "bin": pa.array(bins, pa.int32()), "offset": pa.array(offset, pa.int64()), "loose": pa.array(loose[bins], pa.bool_())})

    return run


def _round(pieces: DataFrame, n: int, k: int, capacity: int, last: bool, scope: str) -> DataFrame:
    """pieces: row, length. Returns row, length, district, bin, offset, loose."""
    districts = max(1, round(n / DISTRICT))
    dealt = stored(pieces.withColumn("district", F.pmod(F.xxhash64("row", F.lit(k)), F.lit(districts)).cast("long")).select("row", "length", "district"), "dealt", scope)
    packed = dealt.groupBy("district").applyInArrow(_lengths, schema("district long, lengths binary"))
    state = packed.select("district", F.explode(F.array(*(F.lit(i) for i in range(ISLANDS)))).alias("island"), "lengths", F.lit(None).cast("array<binary>").alias("people"), F.lit(None).cast("binary").alias("migrant"), F.lit(None).cast("double").alias("fit"))
    kind = schema("district long, island int, lengths binary, people array<binary>, elite binary, bins long, fit double")
    for epoch in range(EPOCHS):
        grown = stored(state.repartition(max(1, min(-(-districts * ISLANDS // ISLANDS_A_TASK), 4096)), "district", "island").mapInArrow(_islands(capacity, epoch), kind), f"islands{epoch}", scope)
        elite = grown.select("district", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elite").alias("migrant"))
        state = grown.select("district", "island", "lengths", "people", "fit").join(elite, ["district", "island"])
    best = grown.groupBy("district").agg(F.min_by("elite", F.struct("bins", "fit", "island")).alias("elite"))
    kind = schema("row long, length long, district long, bin int, offset long, loose boolean")
    out = dealt.groupBy("district").cogroup(best.groupBy("district")).applyInArrow(_assigned(capacity, last), kind)
    return stored(out, "assigned", scope)


def packed(pieces: DataFrame, capacity: int = CAPACITY, scope: str = "query") -> DataFrame:
    """pieces (length, others) with sequence_id and offset: as few sequences of at most capacity as it can."""
    named = stored(pieces.withColumn("_fg_row", F.monotonically_increasing_id()), "rows", scope)
    rest = named.where(F.col("length") < capacity).select(F.col("_fg_row").alias("row"), "length")
    done: list[DataFrame] = []
    n, before = rest.count(), None
    while n:
        k = len(done)
        out = _round(rest, n, k, capacity, n <= DISTRICT, scope)
        bins = out.groupBy("district").agg(F.count_distinct("bin").alias("all"), F.count_distinct(F.when(F.col("loose"), F.col("bin"))).alias("loose")).agg(F.sum("all"), F.sum("loose")).first()
        saved = before is None or bins[0] < before
        ids = F.col("bin").cast("long") + F.lit(1 << 20) * (F.col("district") + F.lit(1) + (k << 32))
        done.append((out.where(~F.col("loose")) if saved else out).select("row", ids.alias("sequence_id"), "offset"))
        if not saved:
            break
        rest, before = out.where("loose").select("row", "length"), bins[1]
        n = rest.count()
    full = named.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.col("_fg_row")).withColumn("offset", F.lit(0).cast("long")).drop("_fg_row")
    if not done:
        return full
    places = done[0]
    for x in done[1:]:
        places = places.unionByName(x)
    met = named.where(F.col("length") < capacity).join(places, F.col("_fg_row") == F.col("row")).drop("_fg_row", "row")
    return full.unionByName(met.select(*full.columns))


def sequences(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None, scope: str = "query") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of each document."""
    return packed(tokenized(documents, capacity, path, scope), capacity, scope)
