"""Language identification by interpolated Kneser-Ney character models, one for each language.

Models are fitted on a bounded sample of labelled documents: whole texts, chosen by a hash of doc_id so that each language
gives about SAMPLE_CHARS characters, and at least one text (the documented bound). With many languages the share of each is
smaller, so that the models, whose size grows with the square of their number, keep to MAX_MODEL_BYTES, which is checked. Four fifths of a language's sample train its model; the rest
calibrates. A model of order 5 has, for each order, the n-grams of any language as a sorted array of 64-bit hashes, and
beside it a row of log probabilities, one for each language; contexts have their interpolation weights likewise. A text's
distinct n-grams are looked up with their counts; those that no language has seen fall to the next lower order.

The language with the lowest cross-entropy per character wins. score is the posterior at a temperature that is fitted on
the calibration part, so 0 to 1. `rejected` says that the cross-entropy is above the level that a share ALPHA of the
winner's calibration texts exceed: such a text is unlike any language that was learnt.

All texts are scored whole. Nulls: a null text, or one without a letter, is `und` with score 0; documents with null lang
are not learnt from. With no language to learn all texts are `und`. Ties go to the alphabetically first language. Rows
that repeat are scored alike; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgrid.llm.common import crc32_of_id, only, schema

ORDER = 5
SAMPLE_CHARS = 1_000_000
#: The models are broadcast: a row of languages for each n-gram of any of them.
MAX_MODEL_BYTES = 384 << 20
ALPHA = 0.005
UNKNOWN = "und"
#: Characters that any model allows for, seen or not.
ALPHABET = 2048
_POWERS = np.array([pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(ORDER + 1)], dtype=np.uint64)


def characters(text: str) -> np.ndarray:
    """Code points, lower-cased and mixed to 64 bits, white space as single spaces, with a margin of spaces for the first contexts."""
    plain = " " * (ORDER - 1) + " ".join(text.lower().split())
    chars = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    chars = (chars + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
    return chars ^ (chars >> np.uint64(31))


def hashes(chars: np.ndarray, k: int, ends: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the k characters that end at the given places, or at all places behind the margin."""
    n = len(chars) if ends is None else len(ends)
    total = np.full(n - (ORDER - 1 if ends is None else 0), k, dtype=np.uint64)
    for j in range(k):
        total += (chars[ORDER - 1 - j : n - j] if ends is None else chars[ends - j]) * _POWERS[j]
    total *= np.uint64(0xC4CEB9FE1A85EC53)
    total ^= total >> np.uint64(29)
    return total * _POWERS[1]


def fitted(texts: list[str]) -> list[dict[str, np.ndarray]]:
    """For each order: grams (sorted hashes), p (interpolated), contexts (sorted hashes), gamma."""
    grams = []
    for k in range(1, ORDER + 1):
        own, context, lower, example = [], [], [], []
        for text in texts:
            chars = characters(text)
            ends = np.arange(ORDER - 1, len(chars))
            own.append(hashes(chars, k))
            context.append(hashes(chars, k - 1, ends - 1))
            lower.append(hashes(chars, k - 1))
            if k == ORDER:
                example.append(np.stack([chars[ends - j] for j in range(ORDER - 1, -1, -1)], axis=1))
        own, first, counts = np.unique(np.concatenate(own), return_index=True, return_counts=True)
        grams.append({"grams": own, "n": counts.astype(np.float64), "context": np.concatenate(context)[first], "lower": np.concatenate(lower)[first], "example": np.concatenate(example)[first] if example else None})
    out, below = [], None
    for k, g in enumerate(grams):
        n = g["n"]
        if k < ORDER - 1:  # continuation counts: in how many longer n-grams this one is the end
            ends, times = np.unique(grams[k + 1]["lower"], return_counts=True)
            at = np.minimum(np.searchsorted(ends, g["grams"]), len(ends) - 1)
            n = np.where(ends[at] == g["grams"], times[at], 1).astype(np.float64)
        once, twice = (n == 1).sum(), (n == 2).sum()
        discount = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
        contexts, which = np.unique(g["context"], return_inverse=True)
        total, kinds = np.bincount(which, weights=n), np.bincount(which)
        gamma = discount * kinds / total
        if below is None:
            lower = np.full(len(n), 1.0 / ALPHABET)
        else:
            lower = below["p"][np.searchsorted(below["grams"], g["lower"])]
        below = {"grams": g["grams"], "p": np.maximum(n - discount, 0) / total[which] + gamma[which] * lower, "contexts": contexts, "gamma": gamma, "example": g["example"]}
        out.append(below)
    return out


class Hashes:
    """A sorted array of hashes with a directory of their leading bits: places of wanted hashes in a step or two."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF))
        bits = max(4, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.most = int(np.diff(np.append(self.first, len(keys))).max())

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.first[wanted >> self.shift]
        seen = self.keys[at] == wanted
        rest = np.flatnonzero(~seen)
        for _ in range(self.most):
            rest = rest[self.keys[at[rest]] < wanted[rest]]
            if not len(rest):
                break
            at[rest] += 1
            seen[rest] = self.keys[at[rest]] == wanted[rest]
        return np.where(seen, at, 0), seen


class Models:
    """The models of all languages over common sorted hash arrays."""

    def __init__(self, languages: list[str], models: list[list[dict[str, np.ndarray]]]):
        self.languages, n = languages, len(languages)
        self.contexts, self.gamma, self.grams, self.p = [], [], [], []
        for k in range(ORDER if n else 0):
            contexts = np.unique(np.concatenate([m[k]["contexts"] for m in models]))
            gamma = np.zeros((len(contexts), n), dtype=np.float32)
            grams = np.unique(np.concatenate([m[k]["grams"] for m in models]))
            p = np.full((len(grams), n), np.nan, dtype=np.float32)
            for i, m in enumerate(models):
                gamma[np.searchsorted(contexts, m[k]["contexts"]), i] = np.log(m[k]["gamma"])
                p[np.searchsorted(grams, m[k]["grams"]), i] = np.log(m[k]["p"])
            for to, x in ((self.contexts, Hashes(contexts)), (self.gamma, gamma), (self.grams, Hashes(grams)), (self.p, p)):
                to.append(x)
        if n:  # n-grams that some languages have and others have not: interpolated once, here, from the orders below
            chars = np.zeros((len(self.p[-1]), ORDER), dtype=np.uint64)
            for m in models:
                chars[np.searchsorted(self.grams[-1].keys[:-1], m[-1]["grams"])] = m[-1]["example"]
            self._interpolated(ORDER, chars.ravel(), np.arange(len(chars)) * ORDER + ORDER - 1, self.p[-1])
        self.temperature, self.limits = 1.0, np.full(n, np.inf)

    @staticmethod
    def bytes_for(models: list[list[dict[str, np.ndarray]]]) -> int:
        """What the models' arrays take at most: a row of all languages for each n-gram and each context, and its hash."""
        return sum((len(m[k]["grams"]) + len(m[k]["contexts"])) * (4 * len(models) + 16) for m in models for k in range(ORDER))

    def _log_p(self, k: int, chars: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log probabilities of the characters at ends after the k - 1 before them, for each language."""
        if k == 0:
            return np.full((len(ends), len(self.languages)), -np.log(ALPHABET), dtype=np.float32)
        row, seen = self.grams[k - 1].find(hashes(chars, k, ends))
        out = self.p[k - 1][row]
        out[~seen] = np.nan
        return self._interpolated(k, chars, ends, out)

    def _interpolated(self, k: int, chars: np.ndarray, ends: np.ndarray, out: np.ndarray) -> np.ndarray:
        """out with its gaps filled from the order below."""
        gaps = np.flatnonzero(np.isnan(out.sum(axis=1)))
        if len(gaps):
            own = ends[gaps]
            row, seen = self.contexts[k - 1].find(hashes(chars, k - 1, own - 1))
            lower = self._log_p(k - 1, chars, own) + np.where(seen[:, None], self.gamma[k - 1][row], 0)
            out[gaps] = np.where(np.isnan(out[gaps]), lower, out[gaps])
        return out

    def entropies(self, text: str) -> tuple[np.ndarray, int]:
        """Cross-entropy per character for each language, and the number of characters."""
        chars = characters(text)
        n = len(chars) - ORDER + 1
        row, seen = self.grams[-1].find(hashes(chars, ORDER))
        total = self.p[-1][row[seen]].sum(axis=0, dtype=np.float64)
        if len(ends := np.flatnonzero(~seen) + ORDER - 1):
            gaps = np.full((len(ends), len(total)), np.nan, dtype=np.float32)
            total += self._interpolated(ORDER, chars, ends, gaps).sum(axis=0, dtype=np.float64)
        return -total / max(1, n), n

    def posterior(self, entropy: np.ndarray, n: int) -> np.ndarray:
        z = -entropy * np.sqrt(n) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        entropy, n = self.entropies(text)
        best = int(np.argmin(entropy))
        return self.languages[best], float(self.posterior(entropy, n)[best]), bool(entropy[best] > self.limits[best])

    def calibrate(self, texts: list[tuple[str, str]]) -> None:
        """texts: (language, text) that no model was fitted on."""
        known = {x: i for i, x in enumerate(self.languages)}
        seen = [(known[x], *self.entropies(t)) for x, t in texts if any(map(str.isalpha, t))]
        best: list[tuple[float, float]] = []
        for temperature in (0.05, 0.1, 0.2, 0.4, 0.8, 1.6, 3.2, 6.4):
            self.temperature = float(temperature)
            best.append((-sum(np.log(max(1e-9, self.posterior(e, n)[i])) for i, e, n in seen), self.temperature))
        self.temperature = min(best)[1]
        for i in range(len(self.languages)):
            if own := [e[i] for j, e, _ in seen if j == i]:
                self.limits[i] = float(np.quantile(own, 1 - ALPHA)) * 1.02


def learnt(texts: DataFrame, sample_chars: int = SAMPLE_CHARS, max_bytes: int = MAX_MODEL_BYTES) -> Models:
    """texts: doc_id, text, lang. The sample comes to the driver: about sample_chars characters a language and no more than max_bytes / 32 in all, beside one text of each."""
    spark = texts.sparkSession
    texts = texts.where("text is not null and lang is not null")
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sizes = texts.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.min(draw).alias("least")).collect()  # a row for each language
    each = min(sample_chars, max_bytes // (32 * max(1, len(sizes))))
    rows = [(r["lang"], min(1.0, each / max(1, r["chars"])), r["least"]) for r in sizes]
    shares = F.broadcast(spark.createDataFrame(rows, schema("lang string, share double, least double")))
    drawn = texts.withColumn("draw", draw).join(shares, "lang").where((F.col("draw") < F.col("share")) | (F.col("draw") == F.col("least")))
    sample = drawn.select("lang", "doc_id", "text").orderBy("lang", "doc_id", "text").collect()
    train: dict[str, list[str]] = {}
    held: list[tuple[str, str]] = []
    for k, r in enumerate(sample):
        if not r["text"].strip():
            continue
        if k % 5 or r["lang"] not in train:
            train.setdefault(r["lang"], []).append(r["text"])
        else:
            held.append((r["lang"], r["text"]))
    languages = sorted(train)
    if not languages:
        return Models([], [])
    while True:
        parts = [fitted(train[x]) for x in languages]
        if Models.bytes_for(parts) <= max_bytes:
            break
        # half of each language's sample goes: whole texts, and where one is left, its second half
        train = {x: t[: len(t) // 2] if len(t) > 1 else [t[0][: max(1, len(t[0]) // 2)]] for x, t in train.items()}
    models = Models(languages, parts)
    models.calibrate(held)
    return models


def _predicted(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: Models = shared.value
        for batch in batches:
            out = [models.predict(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return run


def identified(documents: DataFrame, models: Models) -> DataFrame:
    """doc_id, lang_pred, score, rejected of each document, by its whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(models)  # MAX_MODEL_BYTES
    return only(documents, doc_id="long", text="string").mapInArrow(_predicted(shared), schema("doc_id long, lang_pred string, score double, rejected boolean"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(crc32_of_id(doc_id), F.lit(4)) == 2, F.lit(False))


def evaluated(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learnt from the documents that are not held out."""
    docs = only(documents, doc_id="long", text="string", lang="string")
    out = identified(docs, learnt(docs.where(~held_out(F.col("doc_id")))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
