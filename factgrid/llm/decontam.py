"""Benchmark decontamination: BM25 retrieval of test items by training passages with block-max WAND, then verification.

The test items form an inverted index: for each word, postings (item, weight) in item order, in blocks of BLOCK items with
the largest weight of each block. A weight is the BM25 term score divided by the item's score for itself, so a passage
that holds a whole item scores 1 against it, and one threshold holds for short and long items.

Each document is read whole, as overlapping passages of twice the longest item's words, a step of the longest item's words
apart: any run of words as long as an item lies in one passage. All passages of a document first meet the block maxima of
the rarer words at once, in arrays; what the common words could add is a constant of the block. Passages and blocks whose
bound reaches the threshold are then searched by block-max WAND, which returns every item above the threshold.

A retrieved item is verified on the words of its passage: distinct 5-word shingles of the item, and of its question and
answer (its last sentence, if it has several), that the passage holds. It is a leak if the item's overlap, or those of
question and answer both, reach 0.8.

Items of like length share an index; indexes go together, up to a bound on their size, in one broadcast and one pass over all
documents; a larger benchmark takes more passes. Shingles are kept as sorted 64-bit hashes. Counts of words are over all items. An item of fewer than five words is one shingle, its whole word sequence, and only that makes it a leak; items
without a word are left out. Nulls: null or empty texts hold
no leak and leak nothing; documents with a null doc_id are searched like others. Repeated items and rows each give their
rows. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgrid.llm.common import only, schema, stored

WORD = re.compile(r"[^\W_]+")
SHINGLE = 5
MIN_ITEM_WORDS = 1
THRESHOLD = 0.5
OVERLAP = 0.8
K1, B = 1.2, 0.75
BLOCK = 4
#: The indexes of a pass hold items of so many characters in all, or one item; an index takes BYTES_PER_CHAR at most for each.
MAX_INDEX_CHARS, BYTES_PER_CHAR = 4 << 20, 40


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words before the last sentence, and those of the last sentence; an item of one sentence is all question."""
    parts = [w for x in re.split(r"(?<=[.!?])\s+|\n+", text) if (w := words_of(x))]
    return [w for x in parts[:-1] for w in x] or (parts[0] if parts else []), parts[-1] if len(parts) > 1 else []


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    k = min(SHINGLE, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def hashed(words: list[str], k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words."""
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(" ".join(words[i : i + k])) for i in range(len(words) - k + 1)), dtype=np.uint64))


class Index:
    """An inverted index of items with block maxima."""

    def __init__(self, items: list[tuple[int, str]], n_items: int, mean_words: float, counts: dict[str, int], threshold: float):
        self.threshold, self.ids = threshold, [i for i, _ in items]
        texts = [words_of(t) for _, t in items]
        self.longest = max(map(len, texts))
        own = lambda w: (min(SHINGLE, len(w)), hashed(w, min(SHINGLE, len(w))) if w else np.empty(0, dtype=np.uint64))
        self.item = [own(w) for w in texts]
        self.parts = [tuple(map(own, question_and_answer(t))) if len(w) >= SHINGLE else (whole, own([])) for w, whole, (_, t) in zip(texts, self.item, items, strict=True)]
        self.vocabulary: dict[str, int] = {}
        rows: list[tuple[int, int, float]] = []
        for item, words in enumerate(texts):
            times: dict[str, int] = {}
            for w in words:
                times[w] = times.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(words) / mean_words)
            score = {w: math.log(1 + (n_items - counts[w] + 0.5) / (counts[w] + 0.5)) * n * (K1 + 1) / (n + norm) for w, n in times.items()}
            whole = sum(score.values())
            rows += [(self.vocabulary.setdefault(w, len(self.vocabulary)), item, x / whole) for w, x in score.items()]
        rows.sort()
        v = len(self.vocabulary)
        self.term = np.fromiter((r[0] for r in rows), dtype=np.int64, count=len(rows))
        self.posting = np.fromiter((r[1] for r in rows), dtype=np.int64, count=len(rows))
        self.weight = np.array([r[2] for r in rows])
        self.at = np.searchsorted(self.term, np.arange(v + 1))
        # common words: those that together add at most half the threshold to any item
        self.rare = np.ones(v, dtype=bool)
        common = np.zeros(len(items))
        for t in np.argsort(-(np.diff(self.at)), kind="stable"):
            own = slice(self.at[t], self.at[t + 1])
            if self.at[t + 1] - self.at[t] > 1 and (common[self.posting[own]] + self.weight[own]).max() <= threshold / 2:
                common[self.posting[own]] += self.weight[own]
                self.rare[t] = False
        self.n_blocks = -(-len(items) // BLOCK)
        self.common = np.zeros(self.n_blocks)
        np.maximum.at(self.common, np.arange(len(items)) // BLOCK, common)
        # block maxima of each word
        key = self.term * self.n_blocks + self.posting // BLOCK
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        self.block_max = np.maximum.reduceat(self.weight, first)
        self.block_of = key[first] % self.n_blocks
        self.blocks_at = np.searchsorted(key[first] // self.n_blocks, np.arange(v + 1))

    def reached(self, terms: np.ndarray, n_passages: int, step: int) -> dict[int, list[int]]:
        """Passages and the blocks whose bound reaches the threshold; terms: a document's words, -1 where not indexed."""
        at = np.flatnonzero(terms >= 0)
        at = at[self.rare[terms[at]]]
        if not len(at):
            return {}
        v = len(self.rare)
        home = at // step
        pairs = np.unique(np.concatenate((home * v + terms[at], (home - 1) * v + terms[at])))
        pairs = pairs[(pairs >= 0) & (pairs // v < n_passages)]
        passage, term = pairs // v, pairs % v
        n = self.blocks_at[term + 1] - self.blocks_at[term]
        row = np.repeat(self.blocks_at[term] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        key = np.repeat(passage, n) * self.n_blocks + self.block_of[row]
        order = np.argsort(key, kind="stable")
        key = key[order]
        if not len(key):
            return {}
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        bound = np.add.reduceat(self.block_max[row][order], first) + self.common[key[first] % self.n_blocks]
        found: dict[int, list[int]] = {}
        for k in key[first][bound >= self.threshold - 1e-9].tolist():
            found.setdefault(k // self.n_blocks, []).append(k % self.n_blocks)
        return found

    def search(self, terms: list[int], blocks: list[int]) -> list[tuple[int, float]]:
        """Every item of the blocks whose score reaches the threshold, by block-max WAND over the terms' postings."""
        out, least = [], self.threshold - 1e-9
        cursors = [[int(self.at[t]), int(self.at[t + 1]), t, float(self.block_max[self.blocks_at[t] : self.blocks_at[t + 1]].max())] for t in terms]
        for block in blocks:
            first, end = block * BLOCK, (block + 1) * BLOCK
            live = []
            for c in cursors:
                c[0] += int(np.searchsorted(self.posting[c[0] : c[1]], first))
                if c[0] < c[1] and self.posting[c[0]] < end:
                    b = self.blocks_at[c[2]] + int(np.searchsorted(self.block_of[self.blocks_at[c[2]] : self.blocks_at[c[2] + 1]], block))
                    live.append([c[0], c[1], float(self.block_max[b])])
            while live:
                live.sort(key=lambda c: self.posting[c[0]])
                bound, pivot = 0.0, None
                for k, c in enumerate(live):
                    bound += c[2]
                    if bound >= least:
                        pivot = k
                        break
                if pivot is None:
                    break
                item = int(self.posting[live[pivot][0]])
                if self.posting[live[0][0]] == item:
                    score = 0.0
                    for c in live:
                        if self.posting[c[0]] == item:
                            score += float(self.weight[c[0]])
                            c[0] += 1
                    if score >= least:
                        out.append((item, score))
                else:
                    for c in live[:pivot]:
                        while c[0] < c[1] and self.posting[c[0]] < item:
                            c[0] += 1
                live = [c for c in live if c[0] < c[1] and self.posting[c[0]] < end]
        return out

    def leaks(self, words: list[str]) -> list[tuple[int, float, float, float, float]]:
        """(item_id, score, overlap, question_overlap, answer_overlap) of each verified item in a document's words, best passage of each."""
        if len(words) < MIN_ITEM_WORDS:
            return []
        get = self.vocabulary.get
        terms = np.array([get(w, -1) for w in words], dtype=np.int64)
        step = self.longest
        n_passages = max(1, -(-len(words) // step))
        best: dict[int, tuple] = {}
        for passage, blocks in self.reached(terms, n_passages, step).items():
            own = terms[passage * step : (passage + 2) * step]
            items = self.search(np.unique(own[own >= 0]).tolist(), blocks)
            if not items:
                continue
            held = words[passage * step : (passage + 2) * step]
            by_size: dict[int, np.ndarray] = {}

            def share(wanted: tuple[int, np.ndarray]) -> float:
                k, own = wanted
                if not len(own):
                    return 1.0
                if k not in by_size:
                    by_size[k] = hashed(held, k)
                return len(np.intersect1d(own, by_size[k], assume_unique=True)) / len(own)

            for item, score in items:
                whole, (q, a) = share(self.item[item]), map(share, self.parts[item])
                if whole >= OVERLAP or min(q, a) >= OVERLAP:
                    best[item] = max(best.get(item, ()), (whole, min(1.0, score), q, a))
        return [(self.ids[i], s, w, q, a) for i, (w, s, q, a) in sorted(best.items())]


def indexes(benchmark: DataFrame, threshold: float = THRESHOLD, max_chars: int = MAX_INDEX_CHARS, scope: str = "query") -> Iterator[list[Index]]:
    """The indexes of each pass; items of like length share an index, so that passages suit them."""
    items = only(benchmark, item_id="long", text="string").where("item_id is not null and text is not null")
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    items = items.withColumn("words", words).withColumn("size", F.greatest(F.lit(8), F.ceil(F.log2(F.size("words") + 1))))
    total = items.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("mean")).first()
    sizes = items.groupBy("size").agg(F.sum(F.length("text")).alias("chars")).orderBy("size").collect()
    counts = stored(items.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c")), "item-words", scope)
    held, chars = [], 0
    for size in sizes:
        parts = max(1, math.ceil(size["chars"] / max_chars))
        for part in range(parts):
            own = items.where((F.col("size") == size["size"]) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part))
            rows = [(r["item_id"], r["text"]) for r in own.select("item_id", "text").orderBy("item_id", "text").collect()]  # about max_chars
            rows = [r for r in rows if len(words_of(r[1])) >= MIN_ITEM_WORDS]
            if not rows:
                continue
            n = sum(len(t) for _, t in rows)
            if held and chars + n > max_chars:
                yield held
                held, chars = [], 0
            used = own.select(F.explode(F.array_distinct("words")).alias("word")).distinct()
            known = {r["word"]: r["c"] for r in counts.join(used, "word", "left_semi").collect()}
            held.append(Index(rows, total["n"], max(1.0, total["mean"]), {w: known.get(w, 1) for _, t in rows for w in words_of(t)}, threshold))
            chars += n
    if held:
        yield held


_PAIR = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"


def _searched(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[Index] = shared.value
        for batch in batches:
            rows = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(t)
                rows += [(d, *x) for index in own for x in index.leaks(words)]
            kinds = [x.split()[0] for x in _PAIR.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i < 2 else pa.float64()) for i in range(6)], names=kinds)

    return run


def _flagged(shared, text_at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[Index] = shared.value
        for batch in batches:
            texts = map(words_of, batch.column(text_at).to_pylist())
            yield batch.filter(pa.array([not any(index.leaks(words) for index in own) for words in texts], pa.bool_()))

    return run


def matches(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, max_chars: int = MAX_INDEX_CHARS, scope: str = "query") -> DataFrame:
    """doc_id, item_id, score, overlap, question_overlap, answer_overlap: each leak of an item into a document."""
    spark = documents.sparkSession
    docs = only(documents, doc_id="long", text="string")
    out = None
    for own in indexes(benchmark, threshold, max_chars, scope):
        found = docs.mapInArrow(_searched(spark.sparkContext.broadcast(own)), schema(_PAIR))
        out = out.unionByName(found) if out else found
    return out if out else spark.createDataFrame([], schema(_PAIR))


def filtered(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, max_chars: int = MAX_INDEX_CHARS, scope: str = "query") -> DataFrame:
    """The documents that hold no leak, with all their columns."""
    spark = documents.sparkSession
    names, typed = documents.columns, [f"c{i}" for i in range(len(documents.columns))]
    out = documents.toDF(*typed)
    for own in indexes(benchmark, threshold, max_chars, scope):
        out = out.mapInArrow(_flagged(spark.sparkContext.broadcast(own), names.index("text")), out.schema)
    return out.toDF(*names)
