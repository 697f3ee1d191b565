"""Graphs, verdicts and comparisons as JSON rows, built by expressions; one row a file or run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgrid.operators import graph

#: Colours of node kinds in pictures.
NODE_COLOURS = {"function": "#4CAF50", "external_function": "#FF9800", "class": "#2196F3", "variable": "#9C27B0", "local_variable": "#CE93D8"}
OTHER_COLOUR = "#9E9E9E"


def as_json(table: DataFrame, keys: list[str]) -> DataFrame:
    """keys and json: the row as an object."""
    return table.select(*keys, F.to_json(F.struct(*table.columns)).alias("json"))


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """file_id, json: nodes and edges of the call and data flow graphs, and their statistics."""
    out = graph.statistics(nodes, edges)
    out = out.select("file_id", F.struct(*(c for c in out.columns if c != "file_id")).alias("statistics"))
    empty = F.array()
    for kind in ("call", "data_flow"):
        n = graph.in_graph(nodes, kind).groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("id", F.col("node_type").alias("type"), "lineno"))).alias("nodes"))
        e = graph.in_graph(edges, kind).groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "relationship"))).alias("edges"))
        out = out.join(n, "file_id", "left").join(e, "file_id", "left")
        out = out.withColumn(f"{kind}_graph", F.struct(F.coalesce("nodes", empty.cast("array<struct<id:string,type:string,lineno:int>>")).alias("nodes"), F.coalesce("edges", empty.cast("array<struct<source:string,target:string,relationship:string>>")).alias("edges"))).drop("nodes", "edges")
    return out.select("file_id", F.to_json(F.struct("call_graph", "data_flow_graph", "statistics")).alias("json"))


def node_colour(node_type: Column) -> Column:
    colours = F.create_map(*[F.lit(x) for pair in NODE_COLOURS.items() for x in pair])
    return F.coalesce(F.try_element_at(colours, node_type), F.lit(OTHER_COLOUR))


def score_label(scores: DataFrame) -> DataFrame:
    """scores with label: danger above 30 % of hallucinations, warning above 10 or below 70 % precision, else success."""
    h, p = F.col("hallucination_rate"), F.col("precision")
    return scores.withColumn("label", F.when(h > 30, "danger").when((h > 10) | (p < 70), "warning").otherwise("success"))


def drawn_nodes(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id: the distinct ends of edges (caller, callee)."""
    ends = edges.select(*keys, F.col("caller").alias("id")).unionByName(edges.select(*keys, F.col("callee").alias("id")))
    return ends.distinct()


def api_json(truth: DataFrame, claimed: DataFrame, comparison: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """keys, json: {success, ground_truth, llm_analysis, comparison, metrics} of each comparison."""
    edge = F.struct("caller", "callee")
    lists = lambda t, name: t.groupBy(*keys).agg(F.sort_array(F.collect_set(edge)).alias(name))
    of = lambda status: lists(comparison.where(F.col("status") == status), status)
    none = F.array().cast("array<struct<caller:string,callee:string>>")
    names = ("call_graph", "function_calls", "correct", "missed", "hallucination")
    out = scores.select(*keys, F.struct(*(c for c in scores.columns if c not in keys)).alias("metrics"))
    for t in (lists(truth, "call_graph"), lists(claimed, "function_calls"), of("correct"), of("missed"), of("hallucination")):
        out = out.join(t, keys, "left")
    out = out.withColumns({n: F.coalesce(n, none) for n in names})
    body = F.struct(
        F.lit(True).alias("success"), F.struct("call_graph").alias("ground_truth"), F.struct("function_calls").alias("llm_analysis"),
        F.struct(F.col("correct").alias("matched"), F.col("missed").alias("only_in_truth"), F.col("hallucination").alias("only_in_llm")).alias("comparison"), "metrics",
    )
    return out.select(*keys, F.to_json(body).alias("json"))


def failure_json(errors: DataFrame) -> DataFrame:
    """errors (file_id, error) as the answer to a request that failed."""
    return errors.select("file_id", F.lit(500).alias("status"), F.to_json(F.struct(F.lit(False).alias("success"), "error")).alias("json"))
