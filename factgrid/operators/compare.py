"""Claimed call edges against true ones, by exact or base names, and the scores of the comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgrid.functions.names import base_name, normal

MODULE = "<module>"
# What a response may call the top level of a program.
MODULE_NAMES = ("module", "<module>", "program", "script", "global")


def _known(edges: DataFrame, names: DataFrame, functions: DataFrame) -> DataFrame:
    """edges (keys, caller, callee in normal form) with caller_known and callee_known; names: file_id, name; functions likewise."""
    for column, table in (("caller", names), ("callee", functions)):
        own = table.select("file_id", F.lower("name").alias("_n")).distinct()
        full = own.withColumnRenamed("_n", column).withColumn("_full", F.lit(True))
        part = own.withColumnRenamed("_n", "_base").withColumn("_part", F.lit(True))
        edges = edges.withColumn("_base", base_name(F.col(column))).join(full, ["file_id", column], "left").join(part, ["file_id", "_base"], "left")
        edges = edges.withColumn(f"{column}_known", F.coalesce("_full", "_part", F.lit(False))).drop("_full", "_part", "_base")
    return edges


def truth_calls(edges: DataFrame, functions: DataFrame, methods: DataFrame) -> DataFrame:
    """file_id, caller, callee of the true edges that count: those of known callers, and module calls of known functions."""
    low = edges.select("file_id", normal(F.col("caller")).alias("caller"), normal(F.col("callee")).alias("callee")).distinct()
    known = _known(low, functions.select("file_id", "name").unionByName(methods.select("file_id", "name")), functions)
    return known.where(F.col("caller_known") | ((F.col("caller") == MODULE) & F.col("callee_known"))).select("file_id", "caller", "callee").distinct()


def claimed_calls(edges: DataFrame, functions: DataFrame, methods: DataFrame) -> DataFrame:
    """file_id, run_id, caller, callee: names of the top level become one; such an edge counts only if its callee is known."""
    low = edges.select("file_id", "run_id", normal(F.col("caller")).alias("caller"), normal(F.col("callee")).alias("callee")).distinct()
    known = _known(low, functions.select("file_id", "name").unionByName(methods.select("file_id", "name")), functions)
    top = ~F.col("caller_known") & F.col("caller").isin(*MODULE_NAMES)
    kept = known.where(~top | F.col("callee_known"))
    return kept.select("file_id", "run_id", F.when(top, F.lit(MODULE)).otherwise(F.col("caller")).alias("caller"), "callee").distinct()


def compared(truth: DataFrame, claimed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, caller, callee, status: correct (a true edge that is claimed), missed, hallucination.

    Edges match if they are equal, or equal in base names. Each true edge takes one claimed edge: the equal one, else the
    least of those with its base names; a claimed edge that no true edge takes is a hallucination. They meet in a join on keys
    and base names, which are equal wherever the edges are; only edges that meet are ordered, by their true edge.
    """
    base = lambda t: t.withColumn("_a", base_name(F.col("caller"))).withColumn("_b", base_name(F.col("callee")))
    t = base(truth.distinct()).select(*keys, "_a", "_b", F.col("caller").alias("tc"), F.col("callee").alias("te"))
    c = base(claimed.distinct()).select(*keys, "_a", "_b", F.col("caller").alias("cc"), F.col("callee").alias("ce"))
    met = t.join(c, [*keys, "_a", "_b"])
    equal = (F.col("tc") == F.col("cc")) & (F.col("te") == F.col("ce"))
    first = Window.partitionBy(*keys, "tc", "te").orderBy(equal.desc(), "cc", "ce")
    taken = met.withColumn("_k", F.row_number().over(first)).where("_k = 1").select(*keys, "tc", "te", "cc", "ce", F.lit(True).alias("_taken"))
    of_truth = t.join(taken.select(*keys, "tc", "te", "_taken"), [*keys, "tc", "te"], "left")
    of_truth = of_truth.select(*keys, F.col("tc").alias("caller"), F.col("te").alias("callee"), F.when(F.col("_taken"), "correct").otherwise("missed").alias("status"))
    free = c.join(taken.select(*keys, "cc", "ce").distinct(), [*keys, "cc", "ce"], "left_anti")
    return of_truth.unionByName(free.select(*keys, F.col("cc").alias("caller"), F.col("ce").alias("callee"), F.lit("hallucination").alias("status")))


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.bround(F.try_divide(100.0 * part, whole), 1), F.lit(0.0))


def scores(truth: DataFrame, claimed: DataFrame, comparison: DataFrame, keys: list[str]) -> DataFrame:
    """keys, five counts and precision, recall, f1_score, hallucination_rate, coverage in percent with one decimal; F1 is that of the rounded two."""
    count = lambda t, n: t.distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    s = F.col("status")
    kinds = comparison.groupBy(*keys).agg(F.count_if(s == "correct").alias("matched"), F.count_if(s == "missed").alias("missed"), F.count_if(s == "hallucination").alias("hallucinations"))
    out = kinds.join(count(truth, "truth_edges"), keys, "left").join(count(claimed, "claimed_edges"), keys, "left").na.fill(0, ["truth_edges", "claimed_edges"])
    out = out.withColumn("precision", percent(F.col("matched"), F.col("claimed_edges"))).withColumn("recall", percent(F.col("matched"), F.col("truth_edges")))
    p, r = F.col("precision"), F.col("recall")
    out = out.withColumn("f1_score", F.coalesce(F.bround(F.try_divide(2 * p * r, p + r), 1), F.lit(0.0)))
    return out.withColumn("hallucination_rate", percent(F.col("hallucinations"), F.col("claimed_edges"))).withColumn("coverage", F.col("recall"))
