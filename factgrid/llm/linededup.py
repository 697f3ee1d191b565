"""Line deduplication by two Bloom filters, for hashes seen once and seen twice.

Pass 1 reads all lines. Each task notes the bits of its line hashes in a pair of filters (seen once, seen twice) and
ships them in compressed segments; two pairs meet as twice = twice | twice' | (once & once'), once = once | once', so a
pair of any number of tasks is that of all their lines (they meet in a tree, a few at a time). Pass 2 tests each line against the "seen twice" filter; only
suspects leave the map side, as 16-byte digests with their doc_id, and an aggregation by digest confirms exactly in how
many documents a line stands and which of them has the largest doc_id. Pass 3 rewrites the texts.

Sizes: a filter has BITS_PER_LINE bits for each line of the corpus, MAX_FILTER_BYTES at most; beyond that more lines are
suspects, and the exact step gets more rows, but no result changes. Confirmed lines are broadcast only if there are at
most MAX_BROADCAST_LINES of them; else they meet the documents in a join by doc_id.

A line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased. Nulls: a null text is one empty line and
stays null; rows with a null doc_id count together as one document, which comes before all others. Rows that repeat a
doc_id are one document: what stays in it stays in each of its rows. Empty tables give empty results. All other columns
pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgrid.llm.common import SPACE, lanes, merged_in_a_tree, only, schema, small, stored

MIN_CHARS = 20
MIN_DOCS = 3
BITS_PER_LINE = 12
HASHES = 3
SEGMENTS = 64
LEAST_BITS, MAX_FILTER_BYTES = 1 << 16, 64 << 20
MAX_BROADCAST_LINES = 200_000
#: A task ships its filters after so many lines, and begins anew: its memory has a bound.
FLUSH_LINES = 1_000_000
_ENDS = SPACE.encode()


def keys_of(text: str | None, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text and their keys; None for a key that is too short to count."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    keys: list[bytes | None] = []
    for line in raw.lower().split(b"\n"):
        key = line.strip(_ENDS)
        n = len(key)
        keys.append(key if n >= min_chars and (n >= 4 * min_chars or key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars) else None)
    return raw.split(b"\n"), keys


def bits_of(hashes: np.ndarray, n_bits: int) -> np.ndarray:
    """HASHES places of each hash in a filter of n_bits (a power of two)."""
    a, b = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) & np.uint64(n_bits - 1) for i in range(HASHES)])


def with_bits(places: np.ndarray, n_bits: int) -> np.ndarray:
    """A filter with these bits set, n_bits / 8 bytes; the work beside it grows with the places alone."""
    out = np.zeros(n_bits // 8, dtype=np.uint8)
    if len(places):
        places = np.sort(places)
        at = (places >> np.uint64(3)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        out[at[first]] = np.bitwise_or.reduceat(np.uint8(1) << (places & np.uint64(7)).astype(np.uint8), first)
    return out


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _filters(n_bits: int, min_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        lane = lanes()

        def ship(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            found, times = np.unique(np.concatenate(parts), return_counts=True)
            pair = [with_bits(bits_of(hashes, n_bits).ravel(), n_bits).reshape(SEGMENTS, -1) for hashes in (found, found[times > 1])]
            used = [s for s in range(SEGMENTS) if pair[0][s].any()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array([next(lane)] * len(used), pa.int64()), pa.array([pack(pair[0][s].tobytes()) for s in used], pa.binary()), pa.array([pack(pair[1][s].tobytes()) for s in used], pa.binary())],
                names=["segment", "lane", "once", "twice"],
            )

        held, n = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if own := {k for k in keys_of(text, min_chars)[1] if k is not None}:
                    held.append(np.fromiter(map(xxhash.xxh3_64_intdigest, own), dtype=np.uint64, count=len(own)))
                    n += len(own)
                    if n >= FLUSH_LINES:
                        yield from ship(held)
                        held, n = [], 0
        if held:
            yield from ship(held)

    return run


def _merged(table: pa.Table) -> pa.Table:
    """The pair of filters of several pairs, for one segment."""
    once = twice = None
    unpack = zstandard.ZstdDecompressor().decompress
    for a, b in zip(table.column("once"), table.column("twice"), strict=True):
        a, b = (np.frombuffer(unpack(x.as_py()), dtype=np.uint8) for x in (a, b))
        once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
    pack = zstandard.ZstdCompressor(level=1).compress
    return pa.table({"segment": table.column("segment")[:1].cast(pa.int32()), "lane": table.column("lane")[:1].cast(pa.int64()), "once": pa.array([pack(once.tobytes())], pa.binary()), "twice": pa.array([pack(twice.tobytes())], pa.binary())})


_PAIR = "segment int, lane long, once binary, twice binary"


def seen_twice(texts: DataFrame, n_bits: int, min_chars: int, n_parts: int) -> np.ndarray:
    """The filter of lines that two documents or more hold, n_bits / 8 bytes."""
    pairs = texts.mapInArrow(_filters(n_bits, min_chars), schema(_PAIR))
    whole = merged_in_a_tree(pairs, _merged, schema(_PAIR), n_parts, fan_in=16).select("segment", "twice")  # 32 segments of 1 MB at a time
    out = np.zeros((SEGMENTS, n_bits // 8 // SEGMENTS), dtype=np.uint8)
    for row in whole.collect():  # SEGMENTS rows, MAX_FILTER_BYTES in all
        out[row["segment"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["twice"]), dtype=np.uint8)
    return out.ravel()


def _tested(bits: np.ndarray, keys: list[bytes]) -> np.ndarray:
    at = bits_of(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys)), len(bits) * 8)
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def _suspects(shared, min_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own := [*{k for k in keys_of(text, min_chars)[1] if k is not None}]:
                    hit = [k for k, yes in zip(own, _tested(bits, own), strict=True) if yes]
                    keys += map(_digest, hit)
                    ids += [doc_id] * len(hit)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], names=["key", "doc_id"])

    return run


def _rewritten(shared, confirmed, doc_at: int, text_at: int, drop_at: int | None, min_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """confirmed: digest to the doc_id that keeps the line, broadcast; or drop_at: the column that has the digests to drop in this row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, last = shared.value, confirmed.value if confirmed else {}
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            drops = batch.column(drop_at).to_pylist() if drop_at is not None else None
            for row, (doc_id, text) in enumerate(zip(batch.column(doc_at).to_pylist(), batch.column(text_at).to_pylist(), strict=True)):
                lines, keys = keys_of(text, min_chars)
                at = [i for i, k in enumerate(keys) if k is not None]
                if at:
                    at = [i for i, yes in zip(at, _tested(bits, [keys[i] for i in at]), strict=True) if yes]
                if drops is None:
                    gone = {i for i in at if (d := _digest(keys[i])) in last and last[d] != doc_id}
                else:
                    own = {*(drops[row] or ())}
                    gone = {i for i in at if own and _digest(keys[i]) in own}
                n_lines.append(len(lines))
                n_dropped.append(len(gone))
                texts.append(b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode("utf-8", "surrogatepass") if gone else text)
            columns = [pa.array(texts, pa.string()) if i == text_at else batch.column(i) for i in range(batch.num_columns) if i != drop_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[f"c{i}" for i in range(len(columns) + 2)])

    return run


def deduplicated(documents: DataFrame, text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_broadcast: int = MAX_BROADCAST_LINES, scope: str = "query") -> DataFrame:
    """documents with the texts that remain, and _fg_n_lines (before) and _fg_n_dropped."""
    spark = documents.sparkSession
    docs = only(documents.withColumnRenamed(text, "text"), doc_id="long", text="string")
    body = F.coalesce(F.col("text"), F.lit(""))
    lines = (F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).alias("n")
    size = docs.select(lines, F.spark_partition_id().alias("task")).agg(F.sum("n").alias("n"), F.max("task").alias("tasks")).first()
    n = size["n"] or 1
    n_bits = min(max(LEAST_BITS, 1 << math.ceil(math.log2(n * BITS_PER_LINE))), MAX_FILTER_BYTES * 8)
    shared = spark.sparkContext.broadcast(seen_twice(docs.select("text"), n_bits, min_chars, 1 + (size["tasks"] or 0) + n // FLUSH_LINES))

    suspects = docs.mapInArrow(_suspects(shared, min_chars), schema("key binary, doc_id long"))
    suspects = stored(suspects, "line-suspects", scope)
    exact = suspects.groupBy("key", "doc_id").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("one").alias("n_docs"), F.max("doc_id").alias("last"))
    exact = stored(exact.where(F.col("n_docs") >= min_docs).select("key", "last"), "line-confirmed", scope)

    names = documents.columns
    typed = [f"c{i}" for i in range(len(names))]
    plain = documents.select(*(F.col(f"`{c}`").cast("string" if c == text else "long" if c == "doc_id" else kind).alias(x) for (c, kind), x in zip(documents.dtypes, typed, strict=True)))
    fields = ", ".join(f"{x} {kind}" for x, kind in plain.dtypes) + f", c{len(names)} long, c{len(names) + 1} long"
    doc_at, text_at = names.index("doc_id"), names.index(text)
    if (few := small(exact, max_broadcast)) is not None:
        last = spark.sparkContext.broadcast({bytes(r["key"]): r["last"] for r in few})
        out = plain.mapInArrow(_rewritten(shared, last, doc_at, text_at, None, min_chars), schema(fields))
    else:
        lost = suspects.join(exact, "key").where(~F.col("doc_id").eqNullSafe(F.col("last")))
        lost = lost.groupBy(F.col("doc_id").alias("d")).agg(F.collect_set("key").alias("drops"))
        met = plain.join(lost, F.col(f"c{doc_at}").eqNullSafe(F.col("d")), "left").drop("d")
        out = met.mapInArrow(_rewritten(shared, None, doc_at, text_at, len(names), min_chars), schema(fields))
    return out.toDF(*names, "_fg_n_lines", "_fg_n_dropped")


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the text that remains."""
    out = deduplicated(only(documents, doc_id="long", text="string"))
    return out.select("doc_id", F.col("_fg_n_lines").alias("n_lines"), F.col("_fg_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def filtered(documents: DataFrame, scope: str = "query") -> DataFrame:
    """The documents with the texts that remain, in the same columns; n_chars, if there, counts anew."""
    out = deduplicated(documents, scope=scope).drop("_fg_n_lines", "_fg_n_dropped")
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*(F.col(f"`{c}`") for c in documents.columns))


#: The contract's rule in SQL. Key lengths count code points.
ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, u.i AS i, string_split(t, chr(10))[u.i] AS line
      FROM d, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS u(i)),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.i, k.line, coalesce(r.last <> k.doc_id, FALSE) AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
