"""Resharding by minimum-cost flow: from old shard sizes to new capacities with the fewest bytes moved.

Rows of an old shard fall into blocks by a hash, as many blocks in all as BLOCKS allows, in proportion to the shards'
bytes; so what the driver sees is a bounded table of block sizes, at any size of the data. A flow network has a node for
each old shard (its bytes), each new shard (its capacity, bytes in equal parts) and a pool: bytes that stay where they are
cost nothing, bytes that go through the pool cost one each. Successive shortest paths find the cheapest flow. Blocks are
then dealt to the flow's transfers, largest first, and single blocks move on between the fullest and the emptiest shard
while that brings the sizes closer together. Law: `bytes`.

Only shards that lose or gain a block are written anew (`rewrite`), in files of about FILE_BYTES, spread over tasks by
shard and block. slot numbers a shard's rows from 0: blocks have their offsets from the plan, rows are numbered in blocks.

Nulls: a null text has size OVERHEAD and the crc of nothing; a null old shard is a shard of its own; null doc_ids are
placed like others. Rows that repeat, and equal texts, are placed one by one: this law keeps no groups together. An empty
table gives an empty result. Names of old shards beyond MAX_OLD are folded by a hash; what moves is then counted by them. Other columns pass through `rewrite`, whatever their names; work columns start with `_fg_`.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgrid.llm.common import schema, work_dir

SHARDS = 40
OVERHEAD = 16
BLOCKS = 16384
MAX_OLD = 2048
FILE_BYTES = 128 << 20
LEAST_PARTS = 8


def min_cost_flow(n: int, edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each edge (from, to, capacity, cost) of the cheapest maximum flow: successive shortest paths with potentials."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, room, cost = [], [], []
    for a, b, c, w in edges:
        for x, y, r, z in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(z)
    potential = [0] * n
    while True:
        far = [math.inf] * n
        by: list[int] = [-1] * n
        far[source] = 0
        queue = [(0, source)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in graph[x]:
                if room[e] > 0 and (new := d + cost[e] + potential[x] - potential[to[e]]) < far[to[e]]:
                    far[to[e]], by[to[e]] = new, e
                    heapq.heappush(queue, (new, to[e]))
        if far[sink] == math.inf:
            return [room[2 * i + 1] for i in range(len(edges))]
        for x in range(n):
            if far[x] < math.inf:
                potential[x] += far[x]
        path, x = [], sink
        while x != source:
            path.append(by[x])
            x = to[by[x] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push


def transfers(old: list[int], capacities: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from each old shard to each new one; old shard i is new shard i where both exist, and what stays there is free."""
    n, m = len(old), len(capacities)
    source, sink, pool = n + m, n + m + 1, n + m + 2
    edges = [(source, i, size, 0) for i, size in enumerate(old)] + [(n + j, sink, c, 0) for j, c in enumerate(capacities)]
    stay = [(i, n + i, old[i], 0) for i in range(min(n, m))]
    flow = min_cost_flow(n + m + 3, [*edges, *stay, *((i, pool, old[i], 1) for i in range(n)), *((pool, n + j, capacities[j], 0) for j in range(m))], source, sink)
    out: dict[tuple[int, int], int] = {}
    at = n + m
    for k in range(len(stay)):
        if flow[at + k]:
            out[k, k] = flow[at + k]
    at += len(stay)
    give = [(i, flow[at + i]) for i in range(n) if flow[at + i]]
    take = [[j, flow[at + n + j]] for j in range(m) if flow[at + n + j]]
    for i, size in give:
        while size and take:
            part = min(size, take[0][1])
            out[i, take[0][0]] = out.get((i, take[0][0]), 0) + part
            size -= part
            take[0][1] -= part
            if not take[0][1]:
                take.pop(0)
    return out


def planned(blocks: list[tuple[int, int, int, int]], n_old: int, n_new: int) -> dict[tuple[int, int], int]:
    """New shard of each block (old shard, block, bytes, rows)."""
    old = [0] * n_old
    for i, _, size, _ in blocks:
        old[i] += size
    total = sum(old)
    capacities = [total // n_new + (j < total % n_new) for j in range(n_new)]
    left: dict[int, dict[int, int]] = defaultdict(dict)
    for (i, j), size in transfers(old, capacities).items():
        left[i][j] = size
    shard: dict[tuple[int, int], int] = {}
    load = [0] * n_new
    held: list[list[tuple[int, int, int]]] = [[] for _ in range(n_new)]
    for i, b, size, _ in sorted(blocks, key=lambda x: (-x[2], x[0], x[1])):
        j = max(left[i], key=lambda j: (left[i][j], -load[j])) if left[i] else min(range(n_new), key=load.__getitem__)
        if left[i]:
            left[i][j] -= size
        shard[i, b] = j
        load[j] += size
        held[j].append((size, i, b))
    fixed: set[int] = set()  # shards that hold too much and can give nothing, as one document may be larger than a shard
    for _ in range(20 * n_new):
        if len(fixed) >= n_new - 1:
            break
        most, least = max((j for j in range(n_new) if j not in fixed), key=load.__getitem__), min(range(n_new), key=load.__getitem__)
        gap = load[most] - load[least]
        # the block whose move, or the pair whose exchange, brings the two closest together; blocks that move anyway first
        best = min(((abs(gap - 2 * s), i == most, s, i, b, None) for s, i, b in held[most] if s), default=None, key=lambda x: x[:5])
        if best is None or best[0] >= gap:
            own, other = sorted(held[most])[:400], sorted(held[least])[:400]
            best = min(((abs(gap - 2 * (x[0] - y[0])), False, x[0], x[1], x[2], y) for x in own for y in other if x[0] > y[0]), default=None, key=lambda x: x[:5])
            if best is None or best[0] >= gap:
                fixed.add(most)
                continue
        _, _, s, i, b, back = best
        for (size, x, y), a, z in [((s, i, b), most, least)] + ([(back, least, most)] if back else []):
            held[a].remove((size, x, y))
            held[z].append((size, x, y))
            load[a] -= size
            load[z] += size
            shard[x, y] = z
    return shard


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def resharded(documents: DataFrame, old: Column, n_new: int = SHARDS) -> DataFrame:
    """documents with _fg_size, _fg_old (index of the old shard), _fg_block, _fg_shard, _fg_offset (rows of the shard before the block) and _fg_touched (the shard loses or gains a block)."""
    key = old.cast("string")
    sized = documents.withColumn("_fg_size", size_of(F.col("text"))).withColumn("_fg_key", key)
    n_keys = sized.select(F.approx_count_distinct("_fg_key").alias("n")).first()["n"]
    if n_keys > MAX_OLD:
        sized = sized.withColumn("_fg_key", F.when(F.col("_fg_key").isNotNull(), F.pmod(F.xxhash64("_fg_key"), F.lit(MAX_OLD)).cast("string")))
    olds = sized.groupBy("_fg_key").agg(F.sum("_fg_size").alias("size")).collect()  # about MAX_OLD rows and one at most
    olds = sorted(olds, key=lambda r: (r["_fg_key"] is not None, len(r["_fg_key"] or ""), r["_fg_key"] or ""))
    total = sum(r["size"] for r in olds) or 1
    parts = [(r["_fg_key"], i, max(1, round(BLOCKS * r["size"] / total))) for i, r in enumerate(olds)]
    spark = documents.sparkSession
    known = F.broadcast(spark.createDataFrame(parts, schema("_fg_k string, _fg_old int, _fg_parts int")))
    blocked = sized.join(known, F.col("_fg_key").eqNullSafe(F.col("_fg_k")), "left")
    draw = F.xxhash64(F.col("doc_id"), F.length("text"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    blocked = blocked.withColumn("_fg_block", F.pmod(draw, F.col("_fg_parts")).cast("int")).drop("_fg_k", "_fg_parts", "_fg_key")
    sizes = blocked.groupBy("_fg_old", "_fg_block").agg(F.sum("_fg_size").alias("size"), F.count(F.lit(1)).alias("n")).collect()  # about BLOCKS rows
    blocks = sorted((r["_fg_old"], r["_fg_block"], r["size"], r["n"]) for r in sizes)
    shard = planned(blocks, len(olds), n_new)
    rows, before = [], [0] * n_new
    touched = {j for i, b, _, _ in blocks for j in (i, shard[i, b]) if shard[i, b] != i}
    for i, b, size, n in blocks:
        j = shard[i, b]
        rows.append((i, b, j, before[j], j in touched))
        before[j] += n
    plan = F.broadcast(spark.createDataFrame(rows, schema("_fg_o int, _fg_b int, _fg_shard int, _fg_offset long, _fg_touched boolean")))
    return blocked.join(plan, (F.col("_fg_old") == F.col("_fg_o")) & (F.col("_fg_block") == F.col("_fg_b"))).drop("_fg_o", "_fg_b")


def rewrite(placed: DataFrame, path: str, total_bytes: int) -> None:
    """Files of the shards: path/_fg_shard=j/. A shard's rows go to several tasks, by block, in files of about FILE_BYTES."""
    parts = max(LEAST_PARTS, math.ceil(total_bytes / SHARDS / FILE_BYTES))
    spread = placed.withColumn("_fg_part", F.pmod(F.xxhash64("_fg_old", "_fg_block"), F.lit(parts)))
    spread.repartition(F.col("_fg_shard"), F.col("_fg_part")).drop("_fg_part").write.partitionBy("_fg_shard").option("compression", "zstd").parquet(path)


def moved_bytes(placed: DataFrame) -> DataFrame:
    """moved, total, least: bytes that change their shard, all bytes, and the fewest that any plan with equal capacities moves (the flow's cost)."""
    sizes = placed.groupBy("_fg_old").agg(F.sum("_fg_size").alias("size")).collect()  # a row for each old shard
    n_new = (placed.agg(F.max("_fg_shard").alias("n")).first()["n"] or 0) + 1
    old = [0] * (max((r["_fg_old"] for r in sizes), default=-1) + 1)
    for r in sizes:
        old[r["_fg_old"]] = r["size"]
    total = sum(old)
    least = total - sum(min(size, total // n_new + (j < total % n_new)) for j, size in enumerate(old[:n_new]))
    return placed.agg(F.sum(F.when(F.col("_fg_old") != F.col("_fg_shard"), F.col("_fg_size")).otherwise(0)).alias("moved"), F.sum("_fg_size").alias("total")).withColumn("least", F.lit(least))


def sharded(documents: DataFrame, old: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard: rows of the shards that lose or gain a block are read back from the rewritten files, the others stay where they are."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(f"`{old}`").cast("string").alias("_fg_from"))
    placed = resharded(docs, F.col("_fg_from"))
    total = docs.agg(F.sum(size_of(F.col("text"))).alias("n")).first()["n"] or 0
    path = f"{work_dir(spark)}/shards-{uuid.uuid4().hex}"
    rewrite(placed.where("_fg_touched").drop("_fg_touched"), path, total)
    rows = spark.read.schema(schema("doc_id long, text string, _fg_from string, _fg_size long, _fg_old int, _fg_block int, _fg_offset long, _fg_shard int")).parquet(path)
    if placed.where("not _fg_touched").limit(1).count():
        rows = rows.unionByName(placed.where("not _fg_touched").select(*rows.columns))
    rows = rows.withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).withColumn("size", size_of(F.col("text"))).drop("text")
    order = Window.partitionBy("_fg_old", "_fg_block").orderBy("doc_id", "text_crc32", "size")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("_fg_shard").alias("shard"),
        (F.col("_fg_offset") + F.row_number().over(order) - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("_fg_old").alias("old_shard"),
    )
