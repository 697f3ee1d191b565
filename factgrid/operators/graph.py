"""Graphs of a corpus of programs as node and edge tables, and questions about them.

nodes(file_id, graph, id, node_type, lineno) and edges(file_id, graph, src, dst, relationship, graph_source); graph is call,
data_flow or combined. All joins and aggregates are by file_id and a node, so one partitioning serves them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgrid.storage import cut

GRAPHS = ("call", "data_flow", "combined")


def graph_name(kind: str) -> str:
    """Anything that isn't call or data_flow means the combined graph."""
    return kind if kind in GRAPHS else "combined"


def in_graph(table: DataFrame, kind: str) -> DataFrame:
    return table.where(F.col("graph") == graph_name(kind))


def node_info(functions: DataFrame, classes: DataFrame, variables: DataFrame) -> DataFrame:
    """file_id, id, node_type, lineno of declared entities; a class hides a function of its name, a variable both."""
    kinds = ((0, "function", functions), (1, "class", classes), (2, "variable", variables))
    union = None
    for rank, kind, t in kinds:
        own = t.select("file_id", F.col("name").alias("id"), F.lit(kind).alias("node_type"), F.col("lineno").cast("int").alias("lineno"), F.lit(rank).alias("rank"))
        union = own if union is None else union.unionByName(own)
    best = union.groupBy("file_id", "id").agg(F.max(F.struct("rank", "node_type", "lineno")).alias("b"))
    return best.select("file_id", "id", "b.node_type", "b.lineno")


def call_graph(functions: DataFrame, call_rel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; a callee that no function declares becomes an external function on line 0."""
    declared = functions.groupBy("file_id", F.col("name").alias("id")).agg(F.max("lineno").cast("int").alias("lineno"))
    edges = call_rel.select("file_id", F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct()
    ends = edges.select("file_id", F.col("dst").alias("id")).distinct()
    external = ends.join(declared, ["file_id", "id"], "left_anti").select("file_id", "id", F.lit("external_function").alias("node_type"), F.lit(0).alias("lineno"))
    nodes = declared.select("file_id", "id", F.lit("function").alias("node_type"), "lineno").unionByName(external)
    nodes = nodes.select("file_id", F.lit("call").alias("graph"), "id", "node_type", "lineno")
    edges = edges.select("file_id", F.lit("call").alias("graph"), "src", "dst", F.lit("calls").alias("relationship"), F.lit("call").alias("graph_source"))
    return nodes, edges


def data_flow_graph(functions: DataFrame, classes: DataFrame, variables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """dependency -> variable provides data, function -> local variable defines; ends that nothing declares become nodes.

    Of the ways in which a node can come in, the first counts: variable, class, missing dependency, then functions and
    their local variables in the order of the functions.
    """
    provides = variables.select("file_id", F.explode("dependencies").alias("src"), F.col("name").alias("dst")).withColumn("relationship", F.lit("provides_data"))
    defines = functions.select("file_id", F.col("name").alias("src"), F.explode("variables").alias("dst")).withColumn("relationship", F.lit("defines"))
    edges = provides.withColumn("rank", F.lit(0)).unionByName(defines.withColumn("rank", F.lit(1)))
    edges = edges.groupBy("file_id", "src", "dst").agg(F.max_by("relationship", "rank").alias("relationship"))
    way = lambda t, name, kind, line, rank, ord_: t.select("file_id", name.alias("id"), F.lit(kind).alias("node_type"), line.cast("int").alias("lineno"), F.lit(rank).alias("rank"), ord_.cast("long").alias("ord"))
    none, at = F.lit(0), F.col("ord")
    ways = way(variables, F.col("name"), "variable", F.col("lineno"), 0, none)
    ways = ways.unionByName(way(classes, F.col("name"), "class", F.col("lineno"), 1, none))
    ways = ways.unionByName(way(provides, F.col("src"), "variable", none, 2, none))
    ways = ways.unionByName(way(functions, F.col("name"), "function", F.col("lineno"), 3, at * 2))
    ways = ways.unionByName(way(functions.select("file_id", "ord", F.explode("variables").alias("v")), F.col("v"), "local_variable", none, 3, at * 2 + 1))
    first = ways.groupBy("file_id", "id").agg(F.min(F.struct("rank", "ord", "node_type", "lineno")).alias("b"))
    nodes = first.select("file_id", F.lit("data_flow").alias("graph"), "id", "b.node_type", "b.lineno")
    edges = edges.select("file_id", F.lit("data_flow").alias("graph"), "src", "dst", "relationship", F.lit("data_flow").alias("graph_source"))
    return nodes, edges


def combined_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both graphs in one: on a clash of nodes or edges the data flow's values stand."""
    later = F.when(F.col("graph") == "data_flow", 1).otherwise(0)
    n = nodes.groupBy("file_id", "id").agg(F.max(F.struct(later.alias("l"), "node_type", "lineno")).alias("b"))
    e = edges.groupBy("file_id", "src", "dst").agg(F.max(F.struct(later.alias("l"), "relationship", "graph_source")).alias("b"))
    return (
        n.select("file_id", F.lit("combined").alias("graph"), "id", "b.node_type", "b.lineno"),
        e.select("file_id", F.lit("combined").alias("graph"), "src", "dst", "b.relationship", "b.graph_source"),
    )


def build(functions: DataFrame, classes: DataFrame, variables: DataFrame, call_rel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the three graphs."""
    cn, ce = call_graph(functions, call_rel)
    dn, de = data_flow_graph(functions, classes, variables)
    nodes, edges = cn.unionByName(dn), ce.unionByName(de)
    n, e = combined_graph(nodes, edges)
    return nodes.unionByName(n), edges.unionByName(e)


def truth_edges(functions: DataFrame, call_rel: DataFrame, module_calls: DataFrame) -> DataFrame:
    """Distinct file_id, caller, callee: calls of functions, edges of the call graph, calls of the module's top level."""
    own = functions.select("file_id", F.col("name").alias("caller"), F.explode("calls").alias("callee"))
    top = module_calls.select("file_id", F.lit("<module>").alias("caller"), "callee")
    return own.unionByName(call_rel.select("file_id", "caller", "callee")).unionByName(top).dropDuplicates(["file_id", "caller", "callee"])


# ---- questions: pairs(file_id, src, dst) or names(file_id, id) get an answer column ---------------------------------


def has_call(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs with has_call: the call graph has that very edge."""
    own = in_graph(edges, "call").select("file_id", "src", "dst").distinct().withColumn("has_call", F.lit(True))
    return pairs.join(own, ["file_id", "src", "dst"], "left").withColumn("has_call", F.coalesce("has_call", F.lit(False)))


def shortest_paths(sources: DataFrame, edges: DataFrame, max_hops: int | None = None) -> DataFrame:
    """file_id, src, dst, hops, path: of the shortest paths from each source the lexicographically first; a source reaches itself in 0.

    A frontier moves one hop at a time, against the nodes already seen, and each step is written: the plan stays small
    and a lost executor costs one step. Work is bounded by sources x nodes, not by the number of paths.
    """
    step = edges.select("file_id", F.col("src").alias("dst"), F.col("dst").alias("next")).distinct()
    step = cut(step, "edges")
    frontier = cut(sources.select("file_id", "src").distinct().select("file_id", "src", F.col("src").alias("dst"), F.lit(0).alias("hops"), F.array("src").alias("path")), "frontier")
    seen = frontier
    hop = 0
    while max_hops is None or hop < max_hops:
        hop += 1
        near = frontier.select("file_id", "src", "dst", "path").join(step, ["file_id", "dst"])
        near = near.select("file_id", "src", F.col("next").alias("dst"), F.array_append("path", F.col("next")).alias("path"))
        near = near.join(seen.select("file_id", "src", "dst"), ["file_id", "src", "dst"], "left_anti")
        near = near.groupBy("file_id", "src", "dst").agg(F.min("path").alias("path")).select("file_id", "src", "dst", F.lit(hop).alias("hops"), "path")
        frontier = cut(near, "frontier")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def find_path(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, kind: str = "call", max_hops: int | None = None) -> DataFrame:
    """pairs with path (null if there is none) and has_path; both ends must be nodes of the graph, and a node reaches itself."""
    own = in_graph(nodes, kind).select("file_id", "id").distinct()
    ends = pairs.join(own.withColumnRenamed("id", "src"), ["file_id", "src"], "left_semi").join(own.withColumnRenamed("id", "dst"), ["file_id", "dst"], "left_semi")
    paths = shortest_paths(ends.select("file_id", "src"), in_graph(edges, kind), max_hops)
    found = ends.select("file_id", "src", "dst").distinct().join(paths.select("file_id", "src", "dst", "path"), ["file_id", "src", "dst"])
    return pairs.join(found, ["file_id", "src", "dst"], "left").withColumn("has_path", F.col("path").isNotNull())


def has_path(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, kind: str = "call", max_hops: int | None = None) -> DataFrame:
    return find_path(pairs, nodes, edges, kind, max_hops).drop("path")


def simple_paths(pairs: DataFrame, edges: DataFrame, max_hops: int) -> DataFrame:
    """file_id, src, dst, path: every path without a repeated node, of at most max_hops edges; there can be very many. Pairs without a dst ask for every end."""
    step = cut(edges.select("file_id", F.col("src").alias("at"), F.col("dst").alias("next")).distinct(), "edges")
    every = "dst" not in pairs.columns
    wanted = pairs.select("file_id", "src", *([] if every else ["dst"])).distinct()
    live = wanted.select("file_id", "src").distinct().select("file_id", "src", F.col("src").alias("at"), F.array("src").alias("path"))
    found = None
    for _ in range(max_hops):
        live = live.join(step, ["file_id", "at"]).where(~F.array_contains("path", F.col("next")))
        live = cut(live.select("file_id", "src", F.col("next").alias("at"), F.array_append("path", F.col("next")).alias("path")), "paths")
        own = live.withColumnRenamed("at", "dst")
        own = (own if every else own.join(wanted, ["file_id", "src", "dst"], "left_semi")).select("file_id", "src", "dst", "path")
        found = own if found is None else found.unionByName(own)
    return found


def neighbours(names: DataFrame, edges: DataFrame, kind: str, forward: bool) -> DataFrame:
    """names with neighbours: sorted successors (forward) or predecessors, an empty array if there are none."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    own = in_graph(edges, kind).groupBy("file_id", F.col(a).alias("id")).agg(F.array_sort(F.collect_set(b)).alias("neighbours"))
    return names.join(own, ["file_id", "id"], "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<string>")))


def callers(names: DataFrame, edges: DataFrame) -> DataFrame:
    return neighbours(names, edges, "call", False)


def callees(names: DataFrame, edges: DataFrame) -> DataFrame:
    return neighbours(names, edges, "call", True)


def dependencies(names: DataFrame, edges: DataFrame) -> DataFrame:
    return neighbours(names, edges, "data_flow", False)


def dependents(names: DataFrame, edges: DataFrame) -> DataFrame:
    return neighbours(names, edges, "data_flow", True)


def node_exists(names: DataFrame, nodes: DataFrame, kind: str = "combined") -> DataFrame:
    own = in_graph(nodes, kind).select("file_id", "id").distinct().withColumn("node_exists", F.lit(True))
    return names.join(own, ["file_id", "id"], "left").withColumn("node_exists", F.coalesce("node_exists", F.lit(False)))


def node_type(names: DataFrame, info: DataFrame, nodes: DataFrame) -> DataFrame:
    """names with node_type: as declared, else as the combined graph has it, else null."""
    declared = info.select("file_id", "id", F.col("node_type").alias("declared"))
    other = in_graph(nodes, "combined").select("file_id", "id", F.col("node_type").alias("other"))
    return names.join(declared, ["file_id", "id"], "left").join(other, ["file_id", "id"], "left").withColumn("node_type", F.coalesce("declared", "other")).drop("declared", "other")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each file: node and edge counts of the call and data flow graphs, and nodes by kind."""
    call, flow = F.col("graph") == "call", F.col("graph") == "data_flow"
    kind = F.col("node_type")
    n = nodes.groupBy("file_id").agg(
        F.count_if(call).alias("call_nodes"),
        F.count_if(flow).alias("data_flow_nodes"),
        F.count_if(call & (kind == "function")).alias("functions"),
        F.count_if(call & (kind == "external_function")).alias("external_functions"),
        F.count_if(flow & kind.isin("variable", "local_variable")).alias("variables"),
    )
    e = edges.groupBy("file_id").agg(F.count_if(call).alias("call_edges"), F.count_if(flow).alias("data_flow_edges"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("call_nodes", "call_edges", "data_flow_nodes", "data_flow_edges", "functions", "external_functions", "variables")]
    return n.join(e, "file_id", "full").select("file_id", *zero)


def listing(nodes: DataFrame, edges: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    return in_graph(nodes, kind).select("file_id", "id", "node_type", "lineno"), in_graph(edges, kind).select("file_id", "src", "dst", "relationship")
