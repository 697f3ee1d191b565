"""Jaccard join of word shingle sets: a size-aware heavy-light join.

Documents link when 100 * |A & B| >= percent * |A | B|, over sets of distinct k-word shingles (64-bit hashes of lower-cased
words in [^\\x20\\x09-\\x0D]+). Equal sets become one class first (a class is named by the 128-bit digest of its set).

A global order of shingles puts rare ones first: by a logarithmic rank of a count-min estimate of their document counts
over the whole corpus, then by hash. The estimate only orders; any order gives the same result. Two sets that link share a
shingle in their prefixes, the first |A| - ceil(t |A|) + 1 shingles of each, and two shingles in prefixes one longer.

* Small (light) sets pair with small sets through all 2-subsets of the longer prefix, each subset one signature.
* Pairs with a large (heavy) set come from the inverted lists of prefix shingles.
* The boundary between them is where a set makes as many subsets as its lists have members, at the mean length of a list,
  which is counted over all lists. (Members of a long list meet its pivot alone at first, so long lists don't weigh more.)

Within a list no pairs are expanded: first each member meets one pivot (the member nearest to the list's common text),
links that hold are contracted to components, and then members outside the list's largest component meet those of other
components, if sizes and places in the prefixes still allow the overlap. So a group of thousands of near copies costs a
star, and no link is lost: members of one list either are in one component already, or cannot reach the overlap, or have
been compared. What is not spared are the pairs of unlike sets of one list that could still overlap.

Lists move once, as numbers (key, class, size, place). Those that the sketch takes for frequent are sliced by a hash of
the class; each slice has a pivot, and the pivots of a list meet the first of them.

Nulls and empties: a null, empty or wordless text has an empty set, n_shingles 0, and links with nothing. Fewer than k
words make one shingle of the whole sequence. Rows that repeat a doc_id are judged row by row; a component's id is the
smallest doc_id of its rows. Rows with a null doc_id take part, link others, and never name a component unless all its rows
are null (its id is null then). Empty tables give empty results; other columns, whatever their names, stay outside.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgrid.llm.common import forgotten_shuffles, give_back, lanes, merged_in_a_tree, only, schema, stored

SEGMENTS = 64
#: Cells of the count-min sketch: one for so many shingles, within these bounds. It is broadcast as one byte a cell.
SHINGLES_PER_CELL, LEAST_CELLS, MOST_CELLS = 8, 1 << 16, 1 << 22
FLUSH_SHINGLES = 4_000_000
#: Up to so many rows are named to the executors by broadcast, of at most 48 bytes each; beyond that by a join.
MAX_BROADCAST_ROWS = 1_000_000
MAX_ROUNDS = 40
#: A posting has a set's size above so many bits, and the place of its shingle in them.
PLACE_BITS = 28
#: Members of a slice of a frequent list, about; a list counts as frequent beyond that and so many times a cell's mean load.
SLICE, MEAN_LOADS = 2048, 16
#: Members of a home that are verified in one place, about.
PIECE = 256
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.array([*map(xxhash.xxh3_64_intdigest, words)], dtype=np.uint64)
    width = min(k, len(words))
    out = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        out = _mixed(out * _M1 + hashes[i : len(words) - width + 1 + i] * _M2 + _M3)
    return np.unique(out)


def _sketches(k: int, cells: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        lane = lanes()

        def ship(parts: list[np.ndarray]) -> pa.RecordBatch:
            counts = np.bincount(np.concatenate(parts), minlength=cells).reshape(SEGMENTS, -1)
            return pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS), pa.int32()), pa.array([next(lane)] * SEGMENTS, pa.int64()), pa.array([pack(_narrow(x)) for x in counts], pa.binary())], names=["segment", "lane", "counts"])

        held, n = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if len(own := shingle_set(text, k)):
                    held.append((own & np.uint64(cells - 1)).astype(np.int32))
                    n += len(own)
                    if n >= FLUSH_SHINGLES:
                        yield ship(held)
                        held, n = [], 0
        if held:
            yield ship(held)
        give_back()

    return run


def _narrow(counts: np.ndarray) -> bytes:
    """The counts in bytes if they fit, else in four bytes each, behind the width."""
    wide = bool(counts.max(initial=0) > 255)
    return bytes([4 if wide else 1]) + np.minimum(counts, 0xFFFFFFFF).astype(np.uint32 if wide else np.uint8).tobytes()


def _counts(packed: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    return np.frombuffer(raw, dtype=np.uint32 if raw[0] == 4 else np.uint8, offset=1)


def _summed(table: pa.Table) -> pa.Table:
    total = None
    for x in table.column("counts"):
        own = _counts(x.as_py())
        total = own.astype(np.uint64) if total is None else total + own
    return pa.table({"segment": table.column("segment")[:1].cast(pa.int32()), "lane": table.column("lane")[:1].cast(pa.int64()), "counts": pa.array([zstandard.ZstdCompressor(level=1).compress(_narrow(total))], pa.binary())})


def document_counts(texts: DataFrame, k: int, n_shingles: int, n_tasks: int) -> np.ndarray:
    """Ranks (eight to an octave) of the estimated document counts of shingles, a byte for each cell."""
    cells = min(max(LEAST_CELLS, 1 << math.ceil(math.log2(max(1, n_shingles / SHINGLES_PER_CELL)))), MOST_CELLS)
    kind = schema("segment int, lane long, counts binary")
    whole = merged_in_a_tree(texts.mapInArrow(_sketches(k, cells), kind), _summed, kind, n_tasks + n_shingles // FLUSH_SHINGLES)
    ranks = np.zeros((SEGMENTS, cells // SEGMENTS), dtype=np.uint8)
    for row in whole.select("segment", "counts").collect():  # SEGMENTS rows, four bytes a cell at most
        ranks[row["segment"]] = np.minimum(255, 8 * np.log2(1.0 + _counts(row["counts"]))).astype(np.uint8)
    return ranks.ravel()


def prefix_length(n: int, percent: int, shared: int = 1) -> int:
    """Shingles of a set of n, first in the order, among which a linked set has `shared` at least."""
    return min(n, n - -(-percent * n // 100) + shared)


def _profiles(k: int, percent: int, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        cells = np.uint64(len(ranks) - 1)
        for batch in batches:
            sizes, nodes, prefixes = [], [], []
            for text in batch.column(2).to_pylist():
                own = shingle_set(text, k)
                order = (ranks[own & cells].astype(np.uint64) << np.uint64(56)) | (own >> np.uint64(8))
                p = prefix_length(len(own), percent, 2)
                first = np.sort(np.partition(order, p - 1)[:p]) if 0 < p < len(order) else np.sort(order)
                sizes.append(len(own))
                nodes.append(xxhash.xxh3_128_digest(own.tobytes()))
                prefixes.append(first.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], names=["doc_id", "row_key", "n", "node", "prefix"])
        give_back()

    return run


def _signatures(percent: int, boundary: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Postings of classes: (key, num, at), where at is the size and the place, << PLACE_BITS; place 0 for 2-subsets, whose lists have light sets only. A key's first byte is the rank of its shingle, or of the rarer one of two."""
    top = np.uint64(0xFF << 56)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least_light = percent * (boundary + 1) // 100
        for batch in batches:
            keys, owner, places = [], [], []
            sizes = batch.column("n").to_pylist()
            for row, (n, prefix) in enumerate(zip(sizes, batch.column("prefix"), strict=True)):
                own = prefix.values.to_numpy(zero_copy_only=False)
                if n > boundary or n >= least_light:  # a large set, or a small one that a large one can link with
                    p = prefix_length(n, percent)
                    keys.append(own[:p])
                    owner.append(np.full(p, row))
                    places.append((n << PLACE_BITS) + np.arange(1, p + 1))
                if n <= boundary:
                    two = np.array([*combinations(own, 2)], dtype=np.int64).reshape(-1, 2).view(np.uint64)
                    mixed = _mixed(two[:, 0] * _M1 + _mixed(two[:, 1] + _M3) * _M2)
                    keys.append(((two.min(axis=1) & top) | (mixed >> np.uint64(8))).view(np.int64))
                    owner.append(np.full(len(two), row))
                    places.append(np.full(len(two), n << PLACE_BITS))
            at = pa.array(np.concatenate(owner) if owner else [], pa.int64())
            columns = [pa.array(np.concatenate(keys) if keys else [], pa.int64()), batch.column("num").take(at), pa.array(np.concatenate(places) if places else [], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "num", "at"])

    return run


def _sets(k: int, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sets of the wanted rows, once for each place where one is wanted: (home, slice, num, shingles).

    shared: the wanted (row_key, node, num, home, slice), sorted by row_key; or None if rows come with their wants. A task sends a set once to a place, however often its row is repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int, int]] = set()
        wanted = None if shared is None else shared.value
        for batch in batches:
            if wanted is not None:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                first, last = np.searchsorted(wanted["row_key"], keys), np.searchsorted(wanted["row_key"], keys, side="right")
                rows = np.flatnonzero(last > first)
                wants = [[(bytes(wanted["node"][i]), *(int(wanted[c][i]) for c in ("num", "home", "slice"))) for i in range(first[r], last[r])] for r in rows]
                texts = batch.column(1).take(pa.array(rows)).to_pylist()
            else:
                wants = [[x] for x in zip(*(batch.column(c).to_pylist() for c in ("node", "num", "home", "slice")), strict=True)]
                texts = batch.column(1).to_pylist()
            out: tuple[list, ...] = ([], [], [], [])
            for text, own in zip(texts, wants, strict=True):
                own = [x for x in own if x[1:] not in sent]
                if own:
                    raw = shingle_set(text, k).tobytes()
                    node = xxhash.xxh3_128_digest(raw)
                    for x in own:
                        if x[0] == node:
                            sent.add(x[1:])
                            for to, value in zip(out, (x[2], x[3], x[1], raw), strict=True):
                                to.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())], names=["home", "slice", "num", "shingles"])
        give_back()

    return run


def _reachable(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs whose prefixes let them link: what both hold up to the end of the shorter reach of the prefixes is known exactly, and beyond it no more than either set has left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, x, n2, y in zip(batch.column("n").to_pylist(), batch.column("prefix"), batch.column("n2").to_pylist(), batch.column("prefix2"), strict=True):
                x, y = (v.values.to_numpy(zero_copy_only=False).view(np.uint64) for v in (x, y))
                end = min(x[-1], y[-1])
                i, j = np.searchsorted(x, end, side="right"), np.searchsorted(y, end, side="right")
                most = len(np.intersect1d(x[:i], y[:j])) + min(n - i, n2 - j)
                keep.append(100 * most >= percent * (n + n2 - most))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["member", "home"])

    return run


def _linked(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links (a, b) of homes with the members that came to them. Rows are sorted by home and slice, the home's own set first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        own, last = np.empty(0, dtype=np.uint64), None
        for batch in batches:
            a, b = [], []
            for home, piece, num, raw in zip(*(batch.column(c).to_pylist() for c in ("home", "slice", "num")), batch.column("shingles"), strict=True):
                shingles = np.frombuffer(raw.as_buffer(), dtype=np.uint64)
                if (home, piece) != at:
                    at, own, last = (home, piece), shingles.copy() if home == num else np.empty(0, dtype=np.uint64), num
                elif num != last:
                    last = num
                    both = len(np.intersect1d(own, shingles, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(shingles) - both):
                        a.append(num)
                        b.append(home)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def components(links: DataFrame, scope: str = "query") -> DataFrame:
    """node, label: the smallest node that links (a, b) reach. Large-star and small-star steps until nothing changes."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges", scope)
    for _ in range(MAX_ROUNDS):
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(least, "x").where(F.col("y") > F.col("x")).select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(low, "u")
        new = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = stored(new, "edges", scope)
        # a star forest: each node has one edge, and no node is both an end and a centre
        more = new.groupBy("u").count().where("count > 1").limit(1).count() or new.join(new.select(F.col("u").alias("c")), F.col("v") == F.col("c"), "left_semi").limit(1).count()
        edges = new
        if not more:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    raise RuntimeError("components did not settle")


def _overlap_needed(na: Column, nb: Column, percent: int) -> Column:
    return F.ceil((na + nb) * percent / F.lit(100 + percent) - 1e-9)


def _possible(percent: int) -> Column:
    """Sizes and places of x and y let them link, if this list's shingle is the first they share."""
    sizes = (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))
    reach = F.when(F.col("place") == 0, F.least("n", "n2")).otherwise(F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) + 1)
    return sizes & (reach >= _overlap_needed(F.col("n"), F.col("n2"), percent))


def row_key() -> Column:
    """Names a row by its doc_id and text. Rows with another key differ; where different rows share one, sets are told apart by their digests."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def classes(documents: DataFrame, k: int, percent: int, scope: str = "query", boundary: int | None = None, max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """doc_id, row_key, n, node, label for each row: node is the class of equal sets, label that of the component. boundary: the largest light set, by cost if None."""
    spark = documents.sparkSession
    docs = only(documents, doc_id="long", text="string")
    size = docs.select(F.length("text").alias("n"), F.spark_partition_id().alias("task")).agg(F.sum(F.col("n") / 6).alias("n"), F.max("task").alias("tasks")).first()
    shared = spark.sparkContext.broadcast(document_counts(docs.select("text"), k, int(size["n"] or 1), 1 + (size["tasks"] or 0)))
    profiles = docs.select("doc_id", row_key().alias("row_key"), "text").mapInArrow(_profiles(k, percent, shared), schema("doc_id long, row_key long, n long, node binary, prefix array<long>"))
    profiles = stored(profiles, "profiles", scope)
    rows = profiles.select("doc_id", "row_key", "n", "node")

    least = -(-100 // (100 - percent)) - 1 if percent < 100 else 1 << 60  # smaller sets link with equal sets alone
    one_each = profiles.where(F.col("n") >= least).select("node", "n", "row_key", "prefix").dropDuplicates(["node"])
    classed = stored(one_each.withColumn("num", F.monotonically_increasing_id()), "classes", scope)
    del one_each
    forgotten_shuffles(spark)

    if boundary is None:  # C(p + 1, 2) subsets against the members of p lists
        lists = classed.select(F.explode("prefix").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("key").alias("lists")).first()
        mean, boundary = lists["n"] / max(1, lists["lists"]), least - 1
        while prefix_length(boundary + 1, percent, 2) <= 2 * mean:
            boundary += 1

    # postings move once, by key and, for keys that may be frequent, a slice: the nearest member comes first and is the pivot
    postings = classed.select("num", "n", "prefix").mapInArrow(_signatures(percent, boundary), schema("key long, num long, at long"))
    octave = (F.shiftrightunsigned("key", 56) / 8).cast("int") - F.lit(math.ceil(math.log2(SLICE + MEAN_LOADS * size_of_cell(int(size["n"] or 1)))))
    sliced = postings.withColumn("slice", F.when(octave > 0, F.pmod(F.xxhash64("num"), F.pow(F.lit(2.0), F.least(octave, F.lit(12))).cast("long")) + 1).otherwise(F.lit(0)).cast("int"))
    sliced = sliced.repartition("key", "slice").select("key", "slice", "num", F.shiftright("at", PLACE_BITS).alias("n"), F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int").alias("place"))
    member = F.struct("num", "n", "place")
    order = [F.col("n") <= boundary, F.col("place"), F.col("n").desc(), F.col("num")]
    here = Window.partitionBy("key", "slice").orderBy(*order)
    behind = lambda k: F.lead("num", k).over(here).isNotNull().cast("int")
    met = sliced.withColumn("pivot", F.first(member).over(here)).withColumn("members", F.row_number().over(here) + behind(1) + behind(2))
    met = met.where((F.col("slice") > 0) | (F.col("members") > 1)).where((F.col("slice") > 0) | (F.col("pivot.n") > boundary) | (F.col("pivot.place") == 0))
    kept = stored(met, "postings", scope)
    del postings, sliced, met
    forgotten_shuffles(spark)

    # the pivots of a list's slices meet the first of them
    among = kept.where((F.col("slice") > 0) & (F.col("num") == F.col("pivot.num"))).withColumn("pivot", F.first(member).over(Window.partitionBy("key").orderBy(*order)))
    stars = kept.select("num", "n", "place", "pivot").unionByName(among.select("num", "n", "place", "pivot")).where(F.col("num") != F.col("pivot.num"))
    stars = stars.select("num", "n", "place", F.col("pivot.num").alias("num2"), F.col("pivot.n").alias("n2"), F.col("pivot.place").alias("place2"))
    pairs = stored(stars.where(_possible(percent)).select(F.col("num").alias("member"), F.col("num2").alias("home")).distinct(), "pairs", scope)
    links = _verified(docs, classed, pairs, k, percent, scope, max_broadcast)
    label = components(links, scope)

    # who is outside its list's largest component meets the members of the others: each pair of components has one outside.
    # In a list of two the star was all
    longer = kept.where((F.col("slice") > 0) | (F.col("members") > 2)).select("key", "num", "n", "place")
    known = stored(longer.join(label, F.col("num") == F.col("node"), "left").select("key", "num", "n", "place", F.coalesce("label", "num").alias("label")), "known", scope)
    heads = known.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("most")).groupBy("key")
    heads = heads.agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("labels"), F.max("most").alias("most"))
    heads = stored(heads.where("labels > 1").select("key", "main", "most"), "heads", scope)
    open_lists = stored(known.join(heads, "key").where((F.col("place") == 0) | (F.col("most") > boundary)).drop("most"), "open", scope)
    outside = open_lists.where(F.col("label") != F.col("main")).select("key", *(F.col(c).alias(f"{c}2") for c in ("num", "n", "place", "label")))
    once = (F.col("label") == F.col("main")) | (F.col("num") < F.col("num2"))
    able = (F.col("label") != F.col("label2")) & once & ((F.col("place") == 0) | (F.greatest("n", "n2") > boundary)) & _possible(percent)
    rest = open_lists.join(outside, "key").where(able).select(F.col("num").alias("member"), F.col("num2").alias("home")).distinct()
    done = pairs.unionByName(pairs.select(F.col("home").alias("member"), F.col("member").alias("home")))
    rest = stored(rest.join(done, ["member", "home"], "left_anti"), "pairs", scope)
    if rest.limit(1).count():
        links = links.unionByName(_verified(docs, classed, rest, k, percent, scope, max_broadcast))
        label = components(links, scope)
    names = classed.select("num", "node")
    named = label.join(names.toDF("label", "label_node"), "label").select(F.col("node").alias("num"), "label_node").join(names, "num").select("node", "label_node")
    return rows.join(stored(named, "named", scope), "node", "left").select("doc_id", "row_key", "n", "node", F.coalesce("label_node", "node").alias("label"))


def size_of_cell(n_shingles: int) -> int:
    """Shingles that a cell of the sketch counts in the mean, beside the one that is asked for."""
    return n_shingles // MOST_CELLS


def _verified(docs: DataFrame, classed: DataFrame, pairs: DataFrame, k: int, percent: int, scope: str, max_broadcast: int) -> DataFrame:
    """The pairs (member, home) that link, by their whole sets, made again from the texts of the rows that represent them.

    Prefixes meet first, as they are a small part of the sets and exclude most pairs that share a shingle by chance. Then
    sets move once: a member's to its home, a home's own to each slice of its members, as a home can have very many.
    """
    spark = docs.sparkSession
    nums = stored(pairs.select(F.explode(F.array("member", "home")).alias("num")).distinct(), "nums", scope)
    known = stored(classed.join(F.broadcast(nums) if nums.count() <= max_broadcast else nums, "num", "left_semi"), "prefixes", scope)
    both = pairs.join(known.select(F.col("num").alias("member"), "n", "prefix"), "member").join(known.select(F.col("num").alias("home"), F.col("n").alias("n2"), F.col("prefix").alias("prefix2")), "home")
    pairs = stored(both.select("member", "home", "n", "prefix", "n2", "prefix2").mapInArrow(_reachable(percent), schema("member long, home long")), "reachable", scope)
    pieces = pairs.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / PIECE).alias("pieces"))
    meet = pairs.join(pieces, "home").select("home", F.pmod(F.xxhash64("member"), F.col("pieces")).alias("slice"), F.col("member").alias("num"))
    meet = meet.unionByName(pieces.select("home", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("slice"), F.col("home").alias("num")))
    wanted = stored(meet.join(known.select("num", "row_key", "node"), "num").select("row_key", "node", "num", "home", "slice"), "wanted", scope)
    keyed = docs.select(row_key().alias("row_key"), "text")
    kind = schema("home long, slice long, num long, shingles binary")
    if wanted.count() <= max_broadcast:
        few = wanted.toArrow().sort_by("row_key")
        arrays = {c: few.column(c).to_numpy() for c in ("row_key", "num", "home", "slice")}
        arrays["node"] = np.frombuffer(b"".join(few.column("node").to_pylist()), dtype="V16")
        sets = keyed.mapInArrow(_sets(k, spark.sparkContext.broadcast(arrays)), kind)
    else:
        sets = keyed.join(wanted, "row_key").select("row_key", "text", "node", "num", "home", "slice").mapInArrow(_sets(k, None), kind)
    dealt = sets.repartition("home", "slice").sortWithinPartitions("home", "slice", F.col("num") != F.col("home"), "num")
    links = stored(dealt.mapInArrow(_linked(percent), schema("a long, b long")), "links", scope)
    del sets, dealt
    forgotten_shuffles(spark)
    return links


def joined(documents: DataFrame, k: int = 3, percent: int = 90, scope: str = "query", boundary: int | None = None, max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of documents."""
    rows = stored(classes(documents, k, percent, scope, boundary, max_broadcast), "labelled", scope)
    names = rows.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c"))
    names = stored(names.where("c > 1").drop("c"), "names", scope)
    out = rows.join(names, "label", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def filtered(documents: DataFrame, k: int = 5, percent: int = 80, scope: str = "query", max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The documents without the rows that another row of their group stands for: that with the smallest doc_id, and of the rows that repeat it the one with the smallest row_key, stays.

    A row with a null doc_id stands for its group only if all rows of it have none. Of rows with equal doc_id and text one
    stays. Other rows of a doc_id that is repeated are judged for themselves. Rows without words stay.
    """
    rows = stored(classes(documents, k, percent, scope, max_broadcast=max_broadcast).where("n > 0").select("doc_id", "row_key", "label"), "labelled", scope)
    best = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")).alias("best"), F.count(F.lit(1)).alias("c"))
    best = stored(best.where("c > 1").select("label", F.col("best.doc_id").alias("best_id"), F.col("best.row_key").alias("best_key")), "best", scope)
    met = rows.join(best, "label")
    stays = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("row_key") == F.col("best_key"))
    gone = stored(met.where(~stays).select(F.col("doc_id").alias("_fg_id"), F.col("row_key").alias("_fg_key")).distinct(), "gone", scope)
    again = stored(met.where(stays).groupBy(F.col("doc_id").alias("_fg_id"), F.col("row_key").alias("_fg_key")).count().where("count > 1").drop("count"), "again", scope)

    names, typed = documents.columns, [f"c{i}" for i in range(len(documents.columns))]
    plain = documents.toDF(*typed)
    own_id, own_text = (F.col(typed[names.index(c)]) for c in ("doc_id", "text"))
    same = lambda other: own_id.cast("long").eqNullSafe(other["_fg_id"]) & (F.xxhash64(own_id.cast("long"), own_text.cast("string")) == other["_fg_key"])
    gone = F.broadcast(gone) if gone.count() <= max_broadcast else gone
    left = plain.join(gone, same(gone), "left_anti")
    if again.limit(1).count():
        one = left.join(again, same(again), "left_semi").dropDuplicates([typed[names.index("doc_id")], typed[names.index("text")]])
        left = left.join(again, same(again), "left_anti").unionByName(one)
    return left.toDF(*names)
