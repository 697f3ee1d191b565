"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Features of a text are rates (symbols, repeated lines, repeated words, capitals, exclamation marks, word length). A text
is rejected if any feature is above its cutoff. Cutoffs are not set by hand: LEVELS names sets of cutoffs for all rules
together, each stricter than the one before, and a labelled holdout says for each stratum and level how many of n good
texts the rules together would reject (k). A level is certified if the exact binomial tail P(Bin(n, RISK) <= k) is at
most DELTA / m: then less than RISK of the stratum's good texts are rejected, for all m strata at once with probability
1 - DELTA (Bonferroni). Within a stratum levels are tested from the laxest on until one fails, which needs no further
correction (a fixed sequence; k grows with strictness and the tail with k, so the levels that pass alone are those that
pass in sequence). The strictest certified level holds. A stratum with too few labels (fewer than 90, with five strata) has
none, and only the base rules hold there.

A good document counts once, however often it or its label is repeated: one trial for a doc_id, by the least of its rows'
strata and features, and only if all its labels with a quality say good. Documents that the base rules reject are no trials.

Nulls: a null text is an empty text; a null stratum is a stratum of its own; rows with a null doc_id are judged, and take
no part in the fit; labels without doc_id or quality are ignored, as are those of unknown documents. Empty text: no words,
fails the base rules. Repeated rows are judged alike. Empty tables give empty results. Other columns pass through
`filtered` untouched whatever their names; work columns start with `_fg_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgrid.llm.common import SPACE_CLASS, let, only, stored

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Cutoffs of each rule, from the laxest level to the strictest. All features are rates that grow with the fault.
LEVELS = {
    "symbol_rate": (0.3, 0.2, 0.1, 0.05, 0.02),
    "dup_line_rate": (0.8, 0.6, 0.5, 0.4, 0.3),
    "repeat_rate": (0.28, 0.25, 0.2, 0.15, 0.1),
    "upper_rate": (0.8, 0.5, 0.3, 0.2, 0.1),
    "shout_rate": (0.2, 0.1, 0.05, 0.03, 0.02),
    "mean_word": (15.0, 12.0, 10.0, 9.0, 8.0),
}
RISK = 0.05
DELTA = 0.05
#: Cutoffs of up to so many strata are broadcast; beyond that they meet the documents in a join.
MAX_BROADCAST_STRATA = 10_000


def _covered(starts: Column) -> Column:
    """Words in the union of windows that begin at the sorted starts."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + F.lit(WINDOW) - F.greatest(a["end"] - p, F.lit(0))).alias("n"))
    return F.aggregate(starts, zero, step, lambda a: a["n"])


def _repeated_exactly(words: Column) -> Column:
    """Windows sorted as strings next to their places; equal neighbours are repeats."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("w"), i.alias("i")))
    same = lambda s, a, b: F.get(s, a)["w"] == F.get(s, b)["w"]
    twice = lambda s: F.filter(s, lambda e, k: F.coalesce(same(s, k, k - 1), F.lit(False)) | F.coalesce(same(s, k, k + 1), F.lit(False)))
    return let(F.array_sort(windows), lambda s: _covered(F.array_sort(F.transform(twice(s), lambda e: e["i"]))))


def repeat_words(words: Column) -> Column:
    """Words in windows of 8 words that the text holds twice or more. 64-bit hashes only tell whether to look closer: equal windows have equal hashes, and the count itself compares strings."""
    hashes = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
    alike = let(let(F.transform(words, lambda w: F.xxhash64(w)), hashes), lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).when(alike, _repeated_exactly(words)).otherwise(F.lit(0).cast("long"))


def measures(text: Column) -> Column:
    """A struct of the counts on which all rules rest, over the whole text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    words = F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "")
    return let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            count(r"[#*$%&|<>]").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            repeat_words(w).alias("n_repeat_words"),
            count(r"\p{Lu}").alias("n_upper"),
            count("!").alias("n_shout"),
        ),
    )


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])


def rates(q: Column) -> Column:
    """The features of LEVELS from the counts; 0 where there is nothing to divide by."""
    part = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return F.struct(
        part(q["n_symbols"], q["word_chars"]).alias("symbol_rate"),
        part(q["n_dup_lines"], q["n_lines"]).alias("dup_line_rate"),
        part(q["n_repeat_words"], q["n_words"]).alias("repeat_rate"),
        part(q["n_upper"], q["word_chars"]).alias("upper_rate"),
        part(q["n_shout"], q["word_chars"]).alias("shout_rate"),
        part(q["word_chars"], q["n_words"]).alias("mean_word"),
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column _fg_q of measures."""
    return docs.withColumn("_fg_q", measures(F.col(f"`{text}`").cast("string")))


def binomial_tail(k: Column, n: Column, risk: float) -> Column:
    """P(Bin(n, risk) <= k), summed exactly in logarithms from term to term."""
    odds = F.lit(risk / (1 - risk))
    first = n.cast("double") * F.log1p(F.lit(-risk))
    add = lambda a, i: let(
        a["term"] + F.log((n - i + 1).cast("double") / i.cast("double") * odds),
        lambda t: F.struct(t.alias("term"), (F.greatest(a["sum"], t) + F.log1p(F.exp(-F.abs(a["sum"] - t)))).alias("sum")),
    )
    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.least(F.lit(1.0), F.exp(F.aggregate(terms, F.struct(first.alias("term"), first.alias("sum")), add, lambda a: a["sum"])))


def _above(rate: Column, level: Column | int) -> Column:
    """Any feature is above its cutoff at a level (a number, or a column of numbers; null: no cutoffs)."""
    cutoff = lambda rule: F.lit(LEVELS[rule][level]) if isinstance(level, int) else F.get(F.array(*map(F.lit, LEVELS[rule])), level)
    out = F.lit(False)
    for rule in LEVELS:
        out = out | F.coalesce(rate[rule] > cutoff(rule), F.lit(False))
    return out


def fitted(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, scope: str = "query") -> DataFrame:
    """stratum, level, n, k, p: the strictest certified level of each stratum that has one.

    docs: doc_id, stratum, _fg_q; labels: doc_id, quality (1: good). Labels meet features by doc_id, without texts, and
    become one row for each stratum before anything else.
    """
    n_levels = len(next(iter(LEVELS.values())))
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = 1 and high = 1").select("doc_id")
    tried = docs.where(~base_failed(F.col("_fg_q"))).join(good, "doc_id").groupBy("doc_id").agg(F.min(F.struct("stratum", rates(F.col("_fg_q")).alias("rate"))).alias("_fg_t"))
    over = [F.count_if(_above(F.col("_fg_t.rate"), i)).alias(f"k{i}") for i in range(n_levels)]
    counts = stored(tried.groupBy(F.col("_fg_t.stratum").alias("stratum")).agg(F.count(F.lit(1)).alias("n"), *over), "strata", scope)
    m = max(1, counts.count())
    tested = counts.select("stratum", "n", F.inline(F.array(*(F.struct(F.lit(i).alias("level"), F.col(f"k{i}").alias("k")) for i in range(n_levels)))))
    certain = F.when(F.col("k") <= F.col("n") * risk, binomial_tail(F.col("k"), F.col("n"), risk)).otherwise(F.lit(1.0))
    passed = tested.withColumn("p", certain).where(F.col("p") <= delta / m)
    return passed.groupBy("stratum").agg(F.max(F.struct("level", "n", "k", "p")).alias("best")).select("stratum", "best.*")


def judged(docs: DataFrame, levels: DataFrame, scope: str = "query") -> DataFrame:
    """docs (_fg_stratum, _fg_q, others) with _fg_failed (base rules) and _fg_kept. Levels are a row for each stratum, broadcast if there are few."""
    levels = stored(levels.select(F.col("stratum").alias("_fg_s"), F.col("level").alias("_fg_level")), "levels", scope)
    if levels.count() <= MAX_BROADCAST_STRATA:
        levels = F.broadcast(levels)
    on = docs.join(levels, docs["_fg_stratum"].eqNullSafe(levels["_fg_s"]), "left")
    on = on.withColumn("_fg_failed", base_failed(F.col("_fg_q"))).withColumn("_fg_kept", ~F.col("_fg_failed") & ~_above(rates(F.col("_fg_q")), F.col("_fg_level")))
    return on.drop("_fg_s", "_fg_level")


def verdicts(documents: DataFrame, labels: DataFrame, stratum: str = "lang", scope: str = "query") -> DataFrame:
    """doc_id, the counts, base_failed, kept and stratum, a row for each document."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{stratum}`").cast("string").alias("_fg_stratum"), F.col("text"))
    docs = stored(measured(docs).drop("text"), "quality", scope)
    levels = fitted(docs.withColumnRenamed("_fg_stratum", "stratum"), only(labels, doc_id="long", quality="int"), scope=scope)
    return judged(docs, levels, scope).select(
        "doc_id",
        *(F.col(f"_fg_q.{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        F.col("_fg_failed").alias("base_failed"),
        F.col("_fg_kept").alias("kept"),
        F.col("_fg_stratum").alias("stratum"),
    )


def filtered(documents: DataFrame, labels: DataFrame, stratum: str = "lang", scope: str = "query") -> DataFrame:
    """The documents that are kept, with all their columns.

    Texts are read and measured once: measures are written next to the documents, the fit reads the measures alone.
    """
    table = stored(measured(documents).withColumn("_fg_stratum", F.col(f"`{stratum}`").cast("string")), "quality-docs", scope)
    slim = table.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_fg_stratum").alias("stratum"), "_fg_q")
    levels = fitted(slim, only(labels, doc_id="long", quality="int"), scope=scope)
    return judged(table, levels, scope).where("_fg_kept").select(*(F.col(f"`{c}`") for c in documents.columns))
