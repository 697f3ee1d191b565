"""Token ids of documents in binary files, coded by a static range asymmetric numeral system (rANS).

One pass tokenizes, in ascending doc_id order, and keeps the ids in blocks of about BLOCK_TOKENS and how often each occurs
there; counts of all ids of all documents become one shared frequency table (quantised to 2 ** SCALE, at least 1 for each id that occurs). Each block is
then coded by itself: `lanes` interleaved coders of 64-bit state and 32-bit renormalisation, which advance together, token
i on lane i % lanes. A block is a row (shard, block, payload) of a table in ascending order, with the frequency table in a
table beside it. A payload is, little-endian:

    magic "RNS1" | u32 lanes | u64 tokens | u64 documents | u32 crc32 of the ids as u32 | u32 steps between checkpoints
    i64 doc_id of each document, u8 1 where it is null | i64 tokens of each document
    for each checkpoint: u64 place in the words, u64 state of each lane
    u32 words

A decoder may begin at any checkpoint, so checkpoints and blocks decode in parallel; a checksum guards each block.

Nulls: a null text is empty: one end id. A null doc_id comes first. Rows that repeat a doc_id stay beside each other. An
empty table gives empty files. Other columns are left out.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factgrid.llm.common import give_back, only, schema, stored, work_dir
from factgrid.llm.tokens import BYTE_VOCABULARY, encoder, public_path

SCALE = 20
LOW = np.uint64(1 << 31)
BLOCK_TOKENS = 1 << 20
LANES = 2048
CHECK_STEPS = 256
_HEAD = struct.Struct("<4sIQQII")


# ---- the coder -----------------------------------------------------------------------------------------------------


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2 ** SCALE; each id that occurs gets 1 or more."""
    total, size = int(counts.sum()), 1 << SCALE
    if not total:
        return np.zeros(len(counts), dtype=np.uint64)
    used = counts > 0
    out = np.where(used, np.maximum(1, np.floor(counts.astype(np.float64) * size / total)), 0).astype(np.int64)
    order = np.lexsort((np.arange(len(out)), -out))
    while (over := int(out.sum()) - size) > 0:  # too many ones: the frequent ids give
        give = np.minimum(out[order] - 1, np.ceil(out[order] * over / out.sum()).astype(np.int64)).clip(0)
        give = np.where(np.cumsum(give) <= over, give, np.maximum(0, over - (np.cumsum(give) - give)))
        out[order] -= give
    out[order[0]] += size - int(out.sum())
    return out.astype(np.uint64)


class Table:
    """freq and cumulative frequency of each id, and the id at each slot."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), self.freq.astype(np.int64))


def coded(ids: np.ndarray, table: Table, lanes: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """Checkpoints (place in the words, states) and words."""
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    n = 0
    for step in range(steps - 1, -1, -1):
        at = slice(step * lanes, min(len(ids), (step + 1) * lanes))
        k = at.stop - at.start
        x, own, first = state[:k], table.freq.take(ids[at]), table.start.take(ids[at])
        full = x >= own << np.uint64(63 - SCALE)
        out = x[full]
        words.append((out & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        n += len(out)
        x = np.where(full, x >> np.uint64(32), x)
        q = x // own
        state[:k] = (q << np.uint64(SCALE)) + first + (x - q * own)
        if step % CHECK_STEPS == 0:
            marks.append((n, state.copy()))
    return [(n - done, s) for done, s in reversed(marks)], np.concatenate(words[::-1]) if words else np.empty(0, dtype=np.uint32)


def decoded(state: np.ndarray, words: np.ndarray, first: int, last: int, n: int, table: Table) -> np.ndarray:
    """ids of tokens first to last of a block of n, from a checkpoint's states and the words from its place on."""
    lanes = len(state)
    out = np.empty(last - first, dtype=np.uint32)
    state, at = state.copy(), 0
    mask = np.uint64((1 << SCALE) - 1)
    for i in range(first, last, lanes):
        k = min(lanes, n - i)
        x = state[:k]
        low = x & mask
        ids = table.slot.take(low.view(np.int64))
        at_id = ids.astype(np.int64)
        x = table.freq.take(at_id) * (x >> np.uint64(SCALE)) + low - table.start.take(at_id)
        short = np.flatnonzero(x < LOW)
        x[short] = (x[short] << np.uint64(32)) | words[at : at + len(short)]
        at += len(short)
        state[:k] = x
        out[i - first : i - first + k] = ids
    return out


def payload(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, table: Table) -> bytes:
    lanes = LANES
    while lanes > 1 and lanes * 64 > len(ids):
        lanes //= 2
    marks, words = coded(ids, table, lanes)
    head = _HEAD.pack(b"RNS1", lanes, len(ids), len(doc_ids), zlib.crc32(ids.astype("<u4").tobytes()), CHECK_STEPS)
    named = np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes() + bytes(d is None for d in doc_ids)
    checks = b"".join(struct.pack("<Q", place) + s.astype("<u8").tobytes() for place, s in marks)
    return head + named + np.array(lengths, dtype="<i8").tobytes() + checks + words.astype("<u4").tobytes()


def unpacked(raw: bytes, table: Table) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a block; raises ValueError if the checksum differs."""
    magic, lanes, n, docs, crc, every = _HEAD.unpack_from(raw)
    if magic != b"RNS1":
        raise ValueError("not a block of token ids")
    at = _HEAD.size
    doc_ids = np.frombuffer(raw, "<i8", docs, at).tolist()
    null = raw[at + 8 * docs : at + 9 * docs]
    lengths = np.frombuffer(raw, "<i8", docs, at + 9 * docs)
    at += 17 * docs
    steps = -(-n // lanes)
    n_marks = -(-steps // every)
    marks = []
    for _ in range(n_marks):
        marks.append((struct.unpack_from("<Q", raw, at)[0], np.frombuffer(raw, "<u8", lanes, at + 8)))
        at += 8 + 8 * lanes
    words = np.frombuffer(raw, "<u4", (len(raw) - at) // 4, at)
    parts = [decoded(state, words[place:], k * every * lanes, min(n, (k + 1) * every * lanes), n, table) for k, (place, state) in enumerate(marks)]
    ids = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block's checksum differs")
    return [None if null[i] else d for i, d in enumerate(doc_ids)], lengths, ids


# ---- the operator ---------------------------------------------------------------------------------------------------

_IDS = "shard int, block int, n long, doc_ids array<long>, lengths array<long>, counts binary, ids binary"


def _blocks(path: str, block_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, shard, block = encoder(path, "bytes"), TaskContext.get().partitionId(), 0
        kind, names = np.uint16 if e.small else np.uint32, deque()
        docs, lengths, held, n = [], [], [], 0

        def texts() -> Iterator[pa.Array]:
            for batch in batches:
                if len(batch):
                    names.append(batch.column(0))
                    yield batch.column(1)

        def ship() -> pa.RecordBatch:
            ids = np.concatenate(held)
            counts = np.bincount(ids).astype("<u4").tobytes()
            arrays = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([n], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([counts], pa.binary()), pa.array([ids.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["shard", "block", "n", "doc_ids", "lengths", "counts", "ids"])

        for ids, ends in e.encode_columns(texts()):
            own, sizes, ids = names.popleft().to_pylist(), np.diff(ends, prepend=0).tolist(), ids.astype(kind)
            at = done = 0  # documents and ids of this column that have their block
            while at < len(own):
                to = min(len(own), 1 + int(np.searchsorted(ends, done + block_tokens - n)))
                end = int(ends[to - 1])
                docs += own[at:to]
                lengths += sizes[at:to]
                held.append(ids[done:end])
                n += end - done
                at, done = to, end
                if n >= block_tokens:
                    yield ship()
                    docs, lengths, held, n, block = [], [], [], 0, block + 1
        if docs:
            yield ship()
        ids = held = None
        give_back()

    return run


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for raw in batch.column("counts").to_pylist():
            own = np.frombuffer(raw, "<u4").astype(np.int64)
            own, total = (own, total) if len(own) > len(total) else (total, own)
            own[: len(total)] += total
            total = own
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["id", "n"])


def _encoded(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                raw = payload(row["doc_ids"], row["lengths"], _ids(row["ids"], row["n"]), table)
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]], pa.int32()), pa.array([row["block"]], pa.int32()), pa.array([row["n"]], pa.int64()), pa.array([raw], pa.binary())], names=["shard", "block", "n", "payload"])

    return run


def _read(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        for batch in batches:
            for shard, block, raw in zip(batch.column("shard").to_pylist(), batch.column("block").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                doc_ids, lengths, ids = unpacked(raw, table)
                ends = np.cumsum(lengths)
                ids = ids.astype("<u4")
                crcs = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                arrays = [pa.array([shard] * len(crcs), pa.int32()), pa.array([block] * len(crcs), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["shard", "block", "doc_id", "before", "n_tokens", "ids_crc32"])

    return run


def write(documents: DataFrame, path: str, vocabulary: str | None = None, block_tokens: int = BLOCK_TOKENS, scope: str = "query") -> None:
    """Writes path/blocks and path/table."""
    spark = documents.sparkSession
    docs = only(documents, doc_id="long", text="string")
    ordered = docs.repartitionByRange(F.col("doc_id")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ids = stored(ordered.mapInArrow(_blocks(vocabulary or public_path(BYTE_VOCABULARY), block_tokens), schema(_IDS)), "ids", scope)
    counts = ids.select("counts").mapInArrow(_counted, schema("id int, n long")).groupBy("id").agg(F.sum("n").alias("n")).collect()  # as many rows as ids
    total = np.zeros(1 + max((r["id"] for r in counts), default=0), dtype=np.int64)
    for r in counts:
        total[r["id"]] = r["n"]
    freq = frequencies(total)
    spark.createDataFrame([(SCALE, freq.tolist())], schema("scale int, freq array<long>")).coalesce(1).write.parquet(f"{path}/table")
    blocks = ids.drop("counts").mapInArrow(_encoded(spark.sparkContext.broadcast(freq)), schema("shard int, block int, n long, payload binary"))
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files, decoded; start counts the ids before it."""
    freq = np.array(spark.read.parquet(f"{path}/table").first()["freq"], dtype=np.uint64)
    blocks = spark.read.schema(schema("shard int, block int, n long, payload binary")).parquet(f"{path}/blocks")
    kind = "shard int, block int, doc_id long, before long, n_tokens long, ids_crc32 long"
    rows = blocks.select("shard", "block", "payload").mapInArrow(_read(spark.sparkContext.broadcast(freq)), schema(kind))
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("shard", "block", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("in_shard"))
    shards = blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect()  # as many rows as partitions
    at, first = 0, {}
    for r in sorted(shards, key=lambda r: r["shard"]):
        first[r["shard"]] = at
        at += r["n"]
    base = spark.createDataFrame([*first.items()], schema("shard int, base long"))
    starts = starts.join(F.broadcast(base), "shard").select("shard", "block", (F.col("in_shard") + F.col("base")).alias("first"))
    return rows.join(starts, ["shard", "block"]).select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    spark = documents.sparkSession
    path = f"{work_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(documents, path, vocabulary)
    return read(spark, path)
