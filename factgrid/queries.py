"""Queries that run the operators over the driver's tables, and SQL that says the same.

The tables hold no source code, so each operator is bound to rows of the same shape: events are verdicts (a user is a run,
the hour its step), orders and line items are call edges, suppliers a sparse graph, names of parts and nations a vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgrid.functions import names, similarity
from factgrid.operators import claims, compare, graph, metrics, resolve, verify

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: str, digits: int = 6) -> Column:
    return F.round(F.col(c), digits).alias(c)


# ---- verdicts: events ----------------------------------------------------------------------------------------------

_V = """v AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS ord, event_type AS claim_type, hour(ts) AS source_step,
  CASE WHEN k < 50 THEN 'valid' WHEN k < 70 THEN 'partially_valid' WHEN k < 85 THEN 'unverifiable' ELSE 'hallucination' END AS result, k / 100.0::DOUBLE AS conf
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e)"""
_OK = "result IN ('valid', 'partially_valid')"


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    result = F.when(k < 50, "valid").when(k < 70, "partially_valid").when(k < 85, "unverifiable").otherwise("hallucination")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("claim_type"), F.hour("ts").alias("source_step"), result.alias("result"), (k / 100.0).alias("verdict_confidence")
    )


RUN = ["run_id"]


@_query("a1_hallucination_rate", f"WITH {_V} SELECT run_id, count(*) AS total_claims, round(avg(CASE WHEN result = 'hallucination' THEN 1.0 ELSE 0 END), 6) AS hallucination_rate FROM v GROUP BY 1")
def a1(spark, sf_dir):
    return metrics.rates(verdicts(spark, sf_dir), RUN).select("run_id", "total_claims", rounded("hallucination_rate"))


@_query("a2_validity_rate", f"WITH {_V} SELECT run_id, round(avg(CASE WHEN {_OK} THEN 1.0 ELSE 0 END), 6) AS validity_rate FROM v GROUP BY 1")
def a2(spark, sf_dir):
    return metrics.rates(verdicts(spark, sf_dir), RUN).select("run_id", rounded("validity_rate"))


_A3 = """vo AS (SELECT DISTINCT p_brand AS b, p_partkey AS name FROM part),
me AS (SELECT DISTINCT p_brand AS b, l_partkey AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate < TIMESTAMP '1995-01-01 00:00:00')"""


@_query("a3_coverage", f"WITH {_A3} SELECT vo.b AS brand, count(*) AS total_entities, count(me.name) AS mentioned_entities, round(count(me.name) / count(*)::DOUBLE, 6) AS coverage FROM vo LEFT JOIN me ON vo.b = me.b AND vo.name = me.name GROUP BY 1")
def a3(spark, sf_dir):
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    vocab = part.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("name"))
    said = line.where(F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp")).select(F.col("l_partkey").alias("name")).distinct().join(vocab, "name")
    return metrics.coverage(said, vocab, ["brand"]).select("brand", "total_entities", "mentioned_entities", rounded("coverage"))


@_query("a4_step_validity", f"WITH {_V}, s AS (SELECT run_id, source_step, avg(CASE WHEN {_OK} THEN 1.0 ELSE 0 END) AS rate FROM v GROUP BY 1, 2) SELECT run_id, count(*) AS steps, round(avg(rate), 6) AS step_validity FROM s GROUP BY 1")
def a4(spark, sf_dir):
    return metrics.step_validity(verdicts(spark, sf_dir), RUN).select("run_id", "steps", rounded("step_validity"))


_A5 = f"""SELECT run_id, claim_type, count(*) AS total, count(*) FILTER (WHERE {_OK}) AS valid, count(*) FILTER (WHERE result = 'hallucination') AS hallucination,
 count(*) FILTER (WHERE result = 'unverifiable') AS other, round(avg(CASE WHEN {_OK} THEN 1.0 ELSE 0 END), 6) AS validity_rate, round(avg(CASE WHEN result = 'hallucination' THEN 1.0 ELSE 0 END), 6) AS hallucination_rate FROM v GROUP BY 1, 2"""


@_query("a5_claim_type_breakdown", f"WITH {_V} {_A5}")
def a5(spark, sf_dir):
    out = metrics.type_breakdown(verdicts(spark, sf_dir), RUN)
    return out.withColumns({c: F.round(c, 6) for c in ("validity_rate", "hallucination_rate")})


@_query("a6_confidence_distribution", f"WITH {_V} SELECT run_id, round(avg(conf), 6) AS average, min(conf) AS min, max(conf) AS max, count(*) FILTER (WHERE conf < 0.3) AS low, count(*) FILTER (WHERE conf >= 0.3 AND conf < 0.7) AS medium, count(*) FILTER (WHERE conf >= 0.7) AS high FROM v GROUP BY 1")
def a6(spark, sf_dir):
    return metrics.confidence_distribution(verdicts(spark, sf_dir), RUN).withColumn("average", F.round("average", 6))


_A7 = f"""p AS (SELECT run_id, ({_OK}) = lag({_OK}) OVER (PARTITION BY run_id ORDER BY source_step, ord) AS alike FROM v)
SELECT run_id, count(alike) AS transitions, count(*) FILTER (WHERE alike) AS coherent, round(coalesce(count(*) FILTER (WHERE alike) / nullif(count(alike), 0)::DOUBLE, 1.0), 6) AS chain_coherence FROM p GROUP BY 1"""


@_query("a7_chain_coherence", f"WITH {_V}, {_A7}")
def a7(spark, sf_dir):
    return metrics.chain_coherence(verdicts(spark, sf_dir), RUN).withColumn("chain_coherence", F.round("chain_coherence", 6))


_RATES = f"r AS (SELECT run_id, avg(CASE WHEN result = 'hallucination' THEN 1.0 ELSE 0 END) AS h, avg(CASE WHEN {_OK} THEN 1.0 ELSE 0 END) AS k FROM v GROUP BY 1)"
_GRADE = "CASE WHEN h < 0.1 AND k > 0.8 THEN '{}' WHEN h < 0.2 AND k > 0.6 THEN '{}' WHEN h < 0.3 THEN '{}' ELSE '{}' END"


@_query("a8_grade", f"WITH {_V}, {_RATES} SELECT run_id, {_GRADE.format('MÜKEMMEL', 'İYİ', 'ORTA', 'ZAYIF')} AS overall_assessment, {_GRADE.format('green', 'yellow', 'orange', 'red')} AS assessment_color FROM r")
def a8(spark, sf_dir):
    return metrics.graded(metrics.rates(verdicts(spark, sf_dir), RUN)).select("run_id", "overall_assessment", "assessment_color")


_A9 = f"""t AS (SELECT run_id, claim_type, avg(CASE WHEN result = 'hallucination' THEN 1.0 ELSE 0 END) AS h FROM v GROUP BY 1, 2),
c AS (SELECT run_id, h, k, least(1.0, k) AS c FROM r),
u AS (SELECT run_id, 0 AS place, 'high_hallucination' AS rule, '' AS of FROM c WHERE h > 0.3
 UNION ALL SELECT run_id, 0, 'some_hallucination', '' FROM c WHERE h > 0.1 AND h <= 0.3
 UNION ALL SELECT run_id, 1, 'low_validity', '' FROM c WHERE k < 0.5
 UNION ALL SELECT run_id, 2, 'low_coverage', '' FROM c WHERE c < 0.5
 UNION ALL SELECT run_id, 3, 'bad_type', claim_type FROM t WHERE h > 0.4)
SELECT * FROM u UNION ALL SELECT run_id, 4, 'good', '' FROM c WHERE run_id NOT IN (SELECT run_id FROM u)"""


@_query("a9_recommendations", f"WITH {_V}, {_RATES}, {_A9}")
def a9(spark, sf_dir):
    v = verdicts(spark, sf_dir)
    summary = metrics.rates(v, RUN).withColumn("coverage", F.least(F.lit(1.0), F.col("validity_rate")))
    return metrics.recommended(summary, metrics.type_breakdown(v, RUN), RUN).drop("recommendation")


@_query("a10_metric_lookup", f"WITH {_V}, {_RATES} SELECT run_id, round(h, 6) AS hallucination_rate, 0.0::DOUBLE AS absent FROM r")
def a10(spark, sf_dir):
    rows = metrics.as_rows(metrics.rates(verdicts(spark, sf_dir), RUN), RUN, ["hallucination_rate", "validity_rate"])
    return metrics.value_of(rows, RUN, "hallucination_rate").join(metrics.value_of(rows, RUN, "absent"), RUN).withColumn("hallucination_rate", F.round("hallucination_rate", 6))


@_query("a11_percentage", f"WITH {_V} SELECT run_id, printf('%.1f%%', round_even(100 * round(avg(CASE WHEN {_OK} THEN 1.0::DOUBLE ELSE 0 END), 4), 1)) AS validity FROM v GROUP BY 1")
def a11(spark, sf_dir):
    return metrics.rates(verdicts(spark, sf_dir), RUN).select("run_id", metrics.percentage(F.round(F.col("validity_rate") * 10000) / 10000).alias("validity"))


_V8 = f"""SELECT run_id, count(*) AS total_claims, count(*) FILTER (WHERE result = 'valid') AS valid_count, count(*) FILTER (WHERE result = 'hallucination') AS hallucination_count,
 count(*) FILTER (WHERE result = 'unverifiable') AS unverifiable_count, count(*) FILTER (WHERE result = 'partially_valid') AS partially_valid_count,
 round(avg(CASE WHEN {_OK} THEN 1.0 ELSE 0 END), 6) AS validity_rate, round(avg(CASE WHEN result = 'hallucination' THEN 1.0 ELSE 0 END), 6) AS hallucination_rate FROM v GROUP BY 1"""


@_query("v8_report", f"WITH {_V} {_V8}")
def v8(spark, sf_dir):
    return verify.report(verdicts(spark, sf_dir), RUN).withColumns({c: F.round(c, 6) for c in ("validity_rate", "hallucination_rate")})


@_query("v9_hallucinations_and_valid", f"WITH {_V} SELECT ord, result FROM v WHERE result IN ('hallucination', 'valid')")
def v9(spark, sf_dir):
    v = verdicts(spark, sf_dir)
    return verify.hallucinations(v).unionByName(verify.valid_claims(v)).select("ord", "result")


@_query("v10_predicates", f"WITH {_V} SELECT ord, {_OK} AS is_valid, result = 'hallucination' AS is_hallucination FROM v")
def v10(spark, sf_dir):
    r = F.col("result")
    return verdicts(spark, sf_dir).select("ord", verify.is_valid(r).alias("is_valid"), verify.is_hallucination(r).alias("is_hallucination"))


# ---- call edges: orders and line items -----------------------------------------------------------------------------

_E = """x AS (SELECT CAST(o_custkey AS VARCHAR) AS c, 's' || l_suppkey AS s, o_custkey + l_suppkey AS z, l_returnflag AS f, l_linestatus AS g FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
t AS (SELECT DISTINCT c AS caller, s AS callee FROM x WHERE f = 'R'),
k AS (SELECT DISTINCT 'c.' || c AS caller, s AS callee FROM x WHERE g = 'F' AND z % 3 <> 0)"""


def call_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    x = line.where("l_returnflag = 'R' or l_linestatus = 'F'").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    truth = x.where("l_returnflag = 'R'").select(F.lit("all").alias("file_id"), F.col("o_custkey").cast("string").alias("caller"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("callee")).distinct()
    said = x.where("l_linestatus = 'F' and (o_custkey + l_suppkey) % 3 <> 0")
    return truth, said.select(F.lit("all").alias("file_id"), F.concat(F.lit("c."), F.col("o_custkey")).alias("caller"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("callee")).distinct()


_V11 = f"""WITH {_E} SELECT coalesce(t.caller, k.caller) AS caller, coalesce(t.callee, k.callee) AS callee,
 CASE WHEN t.caller IS NULL THEN 'hallucination' WHEN k.caller IS NULL THEN 'missed' ELSE 'correct' END AS status FROM t FULL JOIN k ON 'c.' || t.caller = k.caller AND t.callee = k.callee"""


@_query("v11_set_comparison", _V11)
def v11(spark, sf_dir):
    return compare.compared(*call_edges(spark, sf_dir), ["file_id"]).drop("file_id")


_A12 = f"""WITH {_E}, n AS (SELECT (SELECT count(*) FROM t) AS truth_edges, (SELECT count(*) FROM k) AS claimed_edges, (SELECT count(*) FROM t JOIN k ON 'c.' || t.caller = k.caller AND t.callee = k.callee) AS matched),
p AS (SELECT *, round_even(100.0::DOUBLE * matched / claimed_edges, 1) AS precision, round_even(100.0::DOUBLE * matched / truth_edges, 1) AS recall FROM n)
SELECT matched, truth_edges - matched AS missed, claimed_edges - matched AS hallucinations, truth_edges, claimed_edges, precision, recall, round_even(2 * precision * recall / (precision + recall), 1) AS f1_score,
 round_even(100.0::DOUBLE * (claimed_edges - matched) / claimed_edges, 1) AS hallucination_rate, recall AS coverage FROM p"""


@_query("a12_scores", _A12)
def a12(spark, sf_dir):
    truth, said = call_edges(spark, sf_dir)
    return compare.scores(truth, said, compare.compared(truth, said, ["file_id"]), ["file_id"]).drop("file_id")


_Q1 = f"WITH {_E} SELECT k.caller, k.callee, t.caller IS NOT NULL AS has_call FROM k LEFT JOIN t ON k.caller = 'c.' || t.caller AND k.callee = t.callee"


@_query("q1_has_call", _Q1)
def q1(spark, sf_dir):
    truth, said = call_edges(spark, sf_dir)
    edges = truth.select("file_id", F.lit("call").alias("graph"), F.concat(F.lit("c."), F.col("caller")).alias("src"), F.col("callee").alias("dst"))
    return graph.has_call(said.withColumnsRenamed({"caller": "src", "callee": "dst"}), edges).select(F.col("src").alias("caller"), F.col("dst").alias("callee"), "has_call")


# ---- a graph: suppliers --------------------------------------------------------------------------------------------

_S = """g AS (SELECT DISTINCT 's' || s AS src, 's' || d AS dst FROM (SELECT s_suppkey AS s, (7 * s_suppkey + 3) % 100 AS d FROM supplier WHERE s_acctbal > 0
 UNION ALL SELECT s_suppkey, s_suppkey // 2 FROM supplier WHERE s_acctbal > 0) e WHERE s <> d)"""
#: Sources of path questions; the questions are bounded, the graph isn't.
_FROM = "SELECT DISTINCT src FROM g"


def supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    e = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(s.alias("s"), F.explode(F.array((7 * s + 3) % 100, F.floor(s / 2))).alias("d")).where("s <> d")
    name = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    return e.select(F.lit("sup").alias("file_id"), F.lit("call").alias("graph"), name("s").alias("src"), name("d").alias("dst"), F.lit("calls").alias("relationship"), F.lit("call").alias("graph_source")).distinct()


def supplier_nodes(edges: DataFrame) -> DataFrame:
    called = edges.select("file_id", "graph", F.col("dst").alias("id"))
    both = edges.select("file_id", "graph", F.col("src").alias("id"), F.lit(1).alias("r")).unionByName(called.withColumn("r", F.lit(0))).groupBy("file_id", "graph", "id").agg(F.max("r").alias("r"))
    return both.select("file_id", "graph", "id", F.when(F.col("r") == 1, "function").otherwise("external_function").alias("node_type"), F.lit(0).alias("lineno"))


_HOPS = 6
_WALKS = f"""WITH RECURSIVE {_S}, w AS (SELECT src, src AS dst, 0 AS hops, [src] AS path FROM ({_FROM}) f
 UNION ALL SELECT w.src, g.dst, hops + 1, list_append(path, g.dst) FROM w JOIN g ON w.dst = g.src WHERE hops < {_HOPS} AND NOT list_contains(path, g.dst))"""
_REACH = f"WITH RECURSIVE {_S}, w AS (SELECT src, src AS dst FROM ({_FROM}) f UNION SELECT w.src, g.dst FROM w JOIN g ON w.dst = g.src)"
_SHORTEST = f"""WITH RECURSIVE {_S}, w(src, dst, hops, path) USING KEY (src, dst) AS (SELECT DISTINCT src, src, 0, [src] FROM ({_FROM}) f
 UNION SELECT w.src, g.dst, w.hops + 1, min(list_append(w.path, g.dst)) FROM w JOIN g ON w.dst = g.src
 WHERE NOT EXISTS (SELECT 1 FROM recurring.w k WHERE k.src = w.src AND k.dst = g.dst) GROUP BY 1, 2, 3)"""


@_query("q2_has_path", f"{_REACH} SELECT src, dst FROM w")
def q2(spark, sf_dir):
    e = supplier_edges(spark, sf_dir)
    return graph.shortest_paths(e.select("file_id", "src"), e).select("src", "dst")


@_query("q3_find_path", f"{_SHORTEST} SELECT src, dst, hops, array_to_string(path, '>') AS path FROM w")
def q3(spark, sf_dir):
    e = supplier_edges(spark, sf_dir)
    return graph.shortest_paths(e.select("file_id", "src"), e).select("src", "dst", "hops", F.array_join("path", ">").alias("path"))


_ASKED = "SELECT DISTINCT 's' || l_suppkey AS src, 's' || (l_partkey % 150) AS dst FROM lineitem"


def _asked(spark, sf_dir):
    """Questions of every line item: from its supplier to a name that may be no node."""
    e = supplier_edges(spark, sf_dir)
    pairs = table(spark, sf_dir, "lineitem").select(F.lit("sup").alias("file_id"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("s"), F.col("l_partkey") % 150).alias("dst")).distinct()
    return pairs, supplier_nodes(e).withColumn("graph", F.lit("call")), e.withColumn("graph", F.lit("call"))


_NODES = "n AS (SELECT src AS id FROM g UNION SELECT dst FROM g)"


@_query("q2_path_answers", f"{_REACH}, {_NODES} SELECT src, dst, (src IN (SELECT id FROM n) AND src = dst) OR (src, dst) IN (SELECT (src, dst) FROM w) AS has_path FROM ({_ASKED}) a")
def q2_answers(spark, sf_dir):
    return graph.has_path(*_asked(spark, sf_dir)).select("src", "dst", "has_path")


@_query("q3_path_answers", f"{_SHORTEST}, {_NODES} SELECT a.src, a.dst, coalesce(array_to_string(path, '>'), CASE WHEN a.src = a.dst AND a.src IN (SELECT id FROM n) THEN a.src END) AS path FROM ({_ASKED}) a LEFT JOIN w ON w.src = a.src AND w.dst = a.dst")
def q3_answers(spark, sf_dir):
    return graph.find_path(*_asked(spark, sf_dir)).select("src", "dst", F.array_join("path", ">").alias("path"))


@_query("q4_all_paths", f"{_WALKS} SELECT src, dst, array_to_string(path, '>') AS path FROM w WHERE hops > 0")
def q4(spark, sf_dir):
    e = supplier_edges(spark, sf_dir)
    return graph.simple_paths(e.select("file_id", "src"), e, _HOPS).select("src", "dst", F.array_join("path", ">").alias("path"))


_NEAR = "WITH {}, n AS (SELECT src AS id FROM g UNION SELECT dst FROM g) SELECT n.id, coalesce(string_agg(DISTINCT {}, ',' ORDER BY {}), '') AS neighbours FROM n LEFT JOIN g ON n.id = g.{} GROUP BY 1"


def _neighbours(spark, sf_dir, f, kind="call"):
    e = supplier_edges(spark, sf_dir)
    own = e.withColumn("graph", F.lit(kind))
    return f(supplier_nodes(e).select("file_id", "id"), own).select("id", F.array_join("neighbours", ",").alias("neighbours"))


for _name, _f, _kind, _a, _b in (("q5_callers", graph.callers, "call", "src", "dst"), ("q6_callees", graph.callees, "call", "dst", "src"), ("q7_dependencies", graph.dependencies, "data_flow", "src", "dst"), ("q8_dependents", graph.dependents, "data_flow", "dst", "src")):
    _query(_name, _NEAR.format(_S, f"g.{_a}", f"g.{_a}", _b))(lambda spark, sf_dir, f=_f, kind=_kind: _neighbours(spark, sf_dir, f, kind))


@_query("q9_node_exists", f"WITH {_S} SELECT 's' || s_suppkey AS id, 's' || s_suppkey IN (SELECT src FROM g UNION SELECT dst FROM g) AS node_exists FROM supplier")
def q9(spark, sf_dir):
    nodes = supplier_nodes(supplier_edges(spark, sf_dir)).withColumn("graph", F.lit("combined"))
    asked = table(spark, sf_dir, "supplier").select(F.lit("sup").alias("file_id"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"))
    return graph.node_exists(asked, nodes).select("id", "node_exists")


# ---- whole graphs: suppliers as functions, regions as classes, nations as variables --------------------------------


def programs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """functions, classes, variables, call_rel: a file is a nation's number modulo 5, so files meet the hierarchy unevenly."""
    file = lambda c: F.concat(F.lit("f"), F.col(c) % 5)
    s, n, r = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    met = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    functions = met.select(file("s_nationkey").alias("file_id"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"), F.col("s_suppkey").cast("int").alias("lineno"), F.array("n_name", F.concat(F.lit("v"), F.col("s_suppkey") % 7)).alias("variables"))
    variables = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(file("n_nationkey").alias("file_id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("lineno"), F.array("r_name").alias("dependencies"))
    classes = r.select(file("r_regionkey").alias("file_id"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("lineno"))
    calls = s.select(file("s_nationkey").alias("file_id"), F.col("s_name").alias("caller"), F.concat(F.lit("Supplier#"), F.lpad(((7 * F.col("s_suppkey") + 3) % 100).cast("string"), 9, "0")).alias("callee"))
    return functions, classes, variables, calls


_P = """fn AS (SELECT 'f' || (s_nationkey % 5) AS file_id, s_name AS name, s_suppkey AS k, n_name AS nat FROM supplier JOIN nation ON s_nationkey = n_nationkey),
va AS (SELECT 'f' || (n_nationkey % 5) AS file_id, n_name AS name, r_name AS dep, n_nationkey AS l FROM nation JOIN region ON n_regionkey = r_regionkey),
cl AS (SELECT 'f' || (r_regionkey % 5) AS file_id, r_name AS name, r_regionkey AS l FROM region),
ca AS (SELECT DISTINCT 'f' || (s_nationkey % 5) AS file_id, s_name AS src, 'Supplier#' || lpad(CAST((7 * s_suppkey + 3) % 100 AS VARCHAR), 9, '0') AS dst FROM supplier),
cn AS (SELECT file_id, name AS id, 'function' AS node_type, max(k) AS lineno FROM fn GROUP BY 1, 2
 UNION ALL SELECT DISTINCT file_id, dst, 'external_function', 0 FROM ca WHERE (file_id, dst) NOT IN (SELECT file_id, name FROM fn)),
de AS (SELECT DISTINCT file_id, dep AS src, name AS dst, 'provides_data' AS relationship FROM va UNION SELECT file_id, name, nat, 'defines' FROM fn UNION SELECT file_id, name, 'v' || (k % 7), 'defines' FROM fn),
dw AS (SELECT file_id, name AS id, 'variable' AS node_type, l AS lineno, 0 AS r FROM va UNION ALL SELECT file_id, name, 'class', l, 1 FROM cl UNION ALL SELECT file_id, dep, 'variable', 0, 2 FROM va
 UNION ALL SELECT file_id, name, 'function', k, 3 FROM fn UNION ALL SELECT file_id, nat, 'local_variable', 0, 4 FROM fn UNION ALL SELECT file_id, 'v' || (k % 7), 'local_variable', 0, 4 FROM fn),
dn AS (SELECT file_id, id, arg_min(node_type, r) AS node_type, arg_min(lineno, r) AS lineno FROM dw GROUP BY 1, 2)"""


@_query("g1_declared_nodes", f"WITH {_P}, u AS (SELECT file_id, name AS id, 'function' AS t, max(k) AS l, 0 AS r FROM fn GROUP BY 1, 2 UNION ALL SELECT file_id, name, 'class', l, 1 FROM cl UNION ALL SELECT file_id, name, 'variable', l, 2 FROM va) SELECT file_id, id, arg_max(t, r) AS node_type, CAST(arg_max(l, r) AS BIGINT) AS lineno FROM u GROUP BY 1, 2")
def g1(spark, sf_dir):
    f, c, v, _ = programs(spark, sf_dir)
    return graph.node_info(f, c, v).withColumn("lineno", F.col("lineno").cast("long"))


@_query("g2_call_graph", f"WITH {_P} SELECT file_id, id, node_type, CAST(lineno AS BIGINT) AS lineno, (SELECT count(*) FROM ca WHERE ca.file_id = cn.file_id AND src = id) AS out_edges FROM cn")
def g2(spark, sf_dir):
    f, _, _, calls = programs(spark, sf_dir)
    nodes, edges = graph.call_graph(f, calls)
    out = edges.groupBy("file_id", F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_edges"))
    return nodes.join(out, ["file_id", "id"], "left").select("file_id", "id", "node_type", F.col("lineno").cast("long").alias("lineno"), F.coalesce("out_edges", F.lit(0).cast("long")).alias("out_edges"))


@_query("g3_data_flow_edges", f"WITH {_P} SELECT file_id, src, dst, relationship FROM de")
def g3(spark, sf_dir):
    f, c, v, _ = programs(spark, sf_dir)
    return graph.data_flow_graph(f, c, v)[1].select("file_id", "src", "dst", "relationship")


@_query("g3_data_flow_nodes", f"WITH {_P} SELECT file_id, id, node_type, CAST(lineno AS BIGINT) AS lineno FROM dn")
def g3_nodes(spark, sf_dir):
    f, c, v, _ = programs(spark, sf_dir)
    return graph.data_flow_graph(f, c, v)[0].select("file_id", "id", "node_type", F.col("lineno").cast("long").alias("lineno"))


@_query("g4_combined_nodes", f"WITH {_P} SELECT coalesce(dn.file_id, cn.file_id) AS file_id, coalesce(dn.id, cn.id) AS id, coalesce(dn.node_type, cn.node_type) AS node_type FROM dn FULL JOIN cn ON dn.file_id = cn.file_id AND dn.id = cn.id")
def g4(spark, sf_dir):
    return graph.in_graph(graph.build(*programs(spark, sf_dir))[0], "combined").select("file_id", "id", "node_type")


@_query("g5_combined_edges", f"WITH {_P} SELECT file_id, src, dst, 'calls' AS relationship, 'call' AS graph_source FROM ca WHERE (file_id, src, dst) NOT IN (SELECT file_id, src, dst FROM de) UNION ALL SELECT file_id, src, dst, relationship, 'data_flow' FROM de")
def g5(spark, sf_dir):
    return graph.in_graph(graph.build(*programs(spark, sf_dir))[1], "combined").select("file_id", "src", "dst", "relationship", "graph_source")


@_query("g6_truth_edges", f"WITH {_P} SELECT file_id, src AS caller, dst AS callee FROM ca UNION SELECT file_id, name, nat FROM fn UNION SELECT file_id, name, 'v' || (k % 7) FROM fn UNION SELECT file_id, '<module>', name FROM cl")
def g6(spark, sf_dir):
    f, c, _, calls = programs(spark, sf_dir)
    return graph.truth_edges(f.withColumnRenamed("variables", "calls"), calls, c.select("file_id", F.col("name").alias("callee")))


@_query("q10_node_type", f"WITH {_P}, u AS (SELECT file_id, name AS id, 'function' AS t, 0 AS r FROM fn UNION ALL SELECT file_id, name, 'class', 1 FROM cl UNION ALL SELECT file_id, name, 'variable', 2 FROM va), i AS (SELECT file_id, id, arg_max(t, r) AS t FROM u GROUP BY 1, 2), a AS (SELECT file_id, id, node_type FROM dn UNION ALL SELECT file_id, id, node_type FROM cn WHERE (file_id, id) NOT IN (SELECT file_id, id FROM dn)) SELECT a.file_id, a.id, coalesce(i.t, a.node_type) AS node_type FROM a LEFT JOIN i ON a.file_id = i.file_id AND a.id = i.id")
def q10(spark, sf_dir):
    f, c, v, calls = programs(spark, sf_dir)
    nodes = graph.build(f, c, v, calls)[0]
    return graph.node_type(graph.in_graph(nodes, "combined").select("file_id", "id"), graph.node_info(f, c, v), nodes)


@_query("q11_graph_choice", f"WITH {_P} SELECT 'call' AS asked, count(*) AS n FROM cn UNION ALL SELECT 'data_flow', count(*) FROM dn UNION ALL SELECT 'anything', (SELECT count(*) FROM (SELECT file_id, id FROM cn UNION SELECT file_id, id FROM dn))")
def q11(spark, sf_dir):
    nodes = graph.build(*programs(spark, sf_dir))[0]
    out = None
    for kind in ("call", "data_flow", "anything"):
        own = graph.in_graph(nodes, kind).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("asked"), "n")
        out = own if out is None else out.unionByName(own)
    return out


_Q12 = f"""WITH {_P}, a AS (SELECT file_id, count(*) AS call_nodes, count(*) FILTER (WHERE node_type = 'function') AS functions, count(*) FILTER (WHERE node_type = 'external_function') AS external_functions FROM cn GROUP BY 1),
b AS (SELECT file_id, count(*) AS data_flow_nodes, count(*) FILTER (WHERE node_type IN ('variable', 'local_variable')) AS variables FROM dn GROUP BY 1),
c AS (SELECT file_id, count(*) AS call_edges FROM ca GROUP BY 1), d AS (SELECT file_id, count(*) AS data_flow_edges FROM de GROUP BY 1)
SELECT a.file_id, call_nodes, call_edges, data_flow_nodes, data_flow_edges, functions, external_functions, variables FROM a JOIN b USING (file_id) JOIN c USING (file_id) JOIN d USING (file_id)"""


@_query("q12_statistics", _Q12)
def q12(spark, sf_dir):
    return graph.statistics(*graph.build(*programs(spark, sf_dir)))


@_query("q13_listing", f"WITH {_P} SELECT file_id, src, dst, 'calls' AS relationship FROM ca")
def q13(spark, sf_dir):
    return graph.listing(*graph.build(*programs(spark, sf_dir)), "call")[1]


# ---- names: parts, nations -----------------------------------------------------------------------------------------

_M = """vo AS (SELECT DISTINCT p_brand AS file_id, p_name AS name FROM part), me AS (SELECT DISTINCT p_brand AS file_id, lower(p_name) AS low FROM part)"""


@_query("m1_vocabulary", "WITH k AS (SELECT n_name AS name, 0 AS r, 'function' AS category FROM nation UNION ALL SELECT r_name, 1, 'class' FROM region UNION ALL SELECT n_name, 2, 'method' FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT r_name, 3, 'variable' FROM region WHERE r_regionkey > 1), t AS (SELECT name, arg_max(category, r) AS entity_type FROM k GROUP BY 1) SELECT DISTINCT category, k.name, entity_type FROM k JOIN t USING (name)")
def m1(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    name = lambda t, c: t.select(F.lit("all").alias("file_id"), F.col(c).alias("name"))
    own = n.where("n_nationkey % 2 = 0").groupBy().agg(F.collect_list("n_name").alias("m"))
    classes = name(r, "r_name").join(F.broadcast(own)).select("file_id", "name", F.col("m").alias("methods"))  # one row of nations
    none = name(r, "r_name").where("false").withColumnRenamed("name", "module")
    return resolve.vocabulary(name(n, "n_name"), classes, name(r.where("r_regionkey > 1"), "r_name"), none).select("category", "name", "entity_type")


def _names(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    r = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("name")).distinct()
    kind = lambda t, k: t.select(F.lit("all").alias("file_id"), F.lit(k).alias("category"), "name")
    special = spark.createDataFrame([("__init__",), ("__main__",), ("__str__",)], "name string")
    return resolve.typed(kind(n, "function").unionByName(kind(r, "class")).unionByName(kind(words, "variable")).unionByName(kind(special, "method")))


def _mentions(spark, sf_dir):
    """Names as they are, cut at the end, and with an end of their own; spoken names."""
    n = table(spark, sf_dir, "nation").select(F.explode(F.array(F.col("n_name"), F.concat(F.lit(" "), F.lower("n_name")), F.expr("left(n_name, length(n_name) - 1)"), F.expr("substr(n_name, 3)"), F.concat("n_name", F.lit("xyz")))).alias("text"))
    said = spark.createDataFrame([(x,) for x in ("init", "constructor", "main", "str", "nothing like it")], "text string")
    return n.unionByName(said).select(F.lit("all").alias("file_id"), "text", F.lit("").alias("expected_type"))


_CASCADE = """vo AS (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT DISTINCT unnest(string_split(p_name, ' ')) FROM part UNION SELECT unnest(['__init__', '__main__', '__str__'])),
me AS (SELECT DISTINCT text FROM (SELECT unnest([n_name, ' ' || lower(n_name), left(n_name, length(n_name) - 1), substr(n_name, 3), n_name || 'xyz']) AS text FROM nation UNION ALL SELECT unnest(['init', 'constructor', 'main', 'str', 'nothing like it'])) u),
q AS (SELECT text, lower(trim(text)) AS low FROM me),
ex AS (SELECT low, min(name) AS name FROM q JOIN vo ON low = lower(name) GROUP BY 1),
al AS (SELECT low, arg_min(name, p) AS name FROM q JOIN (VALUES ('init', '__init__', 0), ('constructor', '__init__', 0), ('str', '__str__', 0), ('repr', '__repr__', 0), ('main', 'main', 0), ('main', '__main__', 1), ('self', 'self', 0)) a(alias, c, p) ON low = alias JOIN vo ON name = c WHERE low NOT IN (SELECT low FROM ex) GROUP BY 1),
op AS (SELECT DISTINCT low FROM q WHERE low NOT IN (SELECT low FROM ex) AND low NOT IN (SELECT low FROM al)),
fs AS (SELECT low, name, CAST(round_even(100.0::DOUBLE - 100.0::DOUBLE * levenshtein(low, lower(name)) / greatest(length(low), length(name)), 0) AS INT) AS s FROM op JOIN vo ON TRUE),
fu AS (SELECT low, max(s) AS s FROM fs WHERE s >= 75 GROUP BY 1), fb AS (SELECT low, min(name) AS name, s FROM fs JOIN fu USING (low, s) GROUP BY 1, 3),
ps AS (SELECT low, name, least(length(low), length(name)) / greatest(length(low), length(name))::DOUBLE AS r FROM op JOIN vo ON contains(low, lower(name)) OR contains(lower(name), low) WHERE low NOT IN (SELECT low FROM fb)),
pm AS (SELECT low, max(r) AS r FROM ps WHERE r >= 0.6 GROUP BY 1), pb AS (SELECT low, min(name) AS name, r FROM ps JOIN pm USING (low, r) GROUP BY 1, 3),
al2 AS (SELECT low, name, 'exact' AS match_type, 1.0::DOUBLE AS confidence FROM ex UNION ALL SELECT low, name, 'alias', 0.95::DOUBLE FROM al UNION ALL SELECT low, name, 'fuzzy', s / 100.0::DOUBLE FROM fb UNION ALL SELECT low, name, 'partial', r FROM pb),
rs AS (SELECT text, name AS code_entity, coalesce(match_type, 'no_match') AS match_type, round(coalesce(confidence, 0.0::DOUBLE), 6) AS confidence FROM q LEFT JOIN al2 USING (low))"""


def _cascade(spark, sf_dir):
    return resolve.resolved(_mentions(spark, sf_dir), _names(spark, sf_dir), score=similarity.levenshtein_ratio).select("text", "code_entity", "match_type", F.round("confidence", 6).alias("confidence"))


@_query("m3_cascade", f"WITH {_CASCADE} SELECT * FROM rs")
def m3(spark, sf_dir):
    return _cascade(spark, sf_dir)


for _k, _kind in (("m5_exact", "exact"), ("m6_alias", "alias"), ("m7_fuzzy", "fuzzy"), ("m8_partial", "partial")):
    _query(_k, f"WITH {_CASCADE} SELECT * FROM rs WHERE match_type = '{_kind}'")(lambda spark, sf_dir, kind=_kind: _cascade(spark, sf_dir).where(F.col("match_type") == kind))


@_query("m9_charset_similarity", "WITH a AS (SELECT n1.n_name AS a, n2.n_name AS b FROM nation n1 JOIN nation n2 ON n1.n_regionkey = n2.n_regionkey) SELECT a, b, round(CASE WHEN a = b THEN 1.0::DOUBLE ELSE len(list_filter(string_split(a, ''), lambda c: contains(b, c))) / greatest(length(a), length(b))::DOUBLE END, 6) AS score FROM a")
def m9(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_name")
    return n.withColumnRenamed("n_name", "a").join(n.withColumnRenamed("n_name", "b"), "n_regionkey").select("a", "b", F.round(similarity.charset_similarity(F.col("a"), F.col("b")), 6).alias("score"))


@_query("m10_match_statistics", f"WITH {_CASCADE} SELECT match_type, count(*) AS n FROM rs GROUP BY 1")
def m10(spark, sf_dir):
    return resolve.statistics(_cascade(spark, sf_dir))


@_query("m12_entity_lookup", "WITH v AS (SELECT DISTINCT p_brand AS b, p_type AS n FROM part WHERE p_size > 25) SELECT DISTINCT p_brand AS file_id, p_type AS name, n IS NOT NULL AS entity_exists FROM part LEFT JOIN v ON p_brand = b AND p_type = n")
def m12(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    pair = lambda t: t.select(F.col("p_brand").alias("file_id"), F.col("p_type").alias("name")).distinct()
    return resolve.entity_exists(pair(part), pair(part.where("p_size > 25")).withColumn("entity_type", F.lit("function"))).select("file_id", "name", "entity_exists")


_DOTTED = "SELECT DISTINCT ' ' || p_brand || '.' || p_type || CASE WHEN p_size % 2 = 0 THEN '.__init__' ELSE '' END AS raw FROM part"


@_query("m13_normal_names", f"SELECT raw, lower(trim(raw)) AS normal, list_extract(string_split(lower(trim(raw)), '.'), -1) AS base, CASE WHEN list_extract(string_split(lower(trim(raw)), '.'), -1) = '__init__' THEN lower(trim(raw)) ELSE list_extract(string_split(lower(trim(raw)), '.'), -1) END AS contextual FROM ({_DOTTED}) d")
def m13(spark, sf_dir):
    raw = F.concat(F.lit(" "), "p_brand", F.lit("."), "p_type", F.when(F.col("p_size") % 2 == 0, ".__init__").otherwise(""))
    d = table(spark, sf_dir, "part").select(raw.alias("raw")).distinct()
    return d.select("raw", names.normal(F.col("raw")).alias("normal"), names.base_name(F.col("raw")).alias("base"), names.contextual_name(F.col("raw")).alias("contextual"))


@_query("v7_builtins", "SELECT DISTINCT w, w IN ('print', 'len', 'range', 'str', 'int', 'any', 'all', 'id', 'map', 'max', 'min', 'set', 'sum', 'open', 'type', 'help') AS is_builtin FROM (SELECT lower(unnest(string_split(p_name, ' '))) AS w FROM part UNION ALL SELECT unnest(['print', 'Len', 'widget'])) u WHERE w <> 'Len'")
def v7(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w"))
    more = spark.createDataFrame([("print",), ("widget",)], "w string")
    return words.unionByName(more).distinct().select("w", names.is_builtin(F.col("w")).alias("is_builtin"))


# ---- claims: documents, conversations, events ----------------------------------------------------------------------

_PATTERN = r"([A-Za-z]+) of ([A-Za-z]+)"
_FOLDED = f"(?i){_PATTERN}"
_STOP = "'bir','bu','ve','ile','the','a','an','is','are','was','were','this','that','these','function','fonksiyon','method','metod','class','variable','yok','none','true','false'"
_PHRASES = f"""m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_FOLDED}', 1)) AS s, unnest(regexp_extract_all(text, '{_FOLDED}', 2)) AS o, generate_subscripts(regexp_extract_all(text, '{_FOLDED}', 1), 1) AS i FROM documents),
k AS (SELECT doc_id, i, lower(s) AS subject, lower(o) AS object FROM m WHERE length(s) >= 2 AND length(o) >= 2 AND lower(s) NOT IN ({_STOP}) AND lower(o) NOT IN ({_STOP}))"""


def _phrases(spark, sf_dir, kind="call", predicate="calls", confidence=0.9):
    found = claims.pattern_claims(F.col("text"), kind, predicate, confidence, (_PATTERN,))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("c"))
    return rows.select(F.col("doc_id").cast("string").alias("file_id"), F.lit("r").alias("run_id"), (F.get("c.rank", 1) + 1).cast("long").alias("ord"), "c.text", "c.claim_type", "c.subject", "c.object", "c.predicate", "c.confidence", F.lit(0).alias("source_step"))




@_query("c4_phrase_claims", f"WITH {_PHRASES} SELECT CAST(doc_id AS VARCHAR) AS file_id, subject, object, count(*) AS n FROM k GROUP BY 1, 2, 3")
def c4(spark, sf_dir):
    return _phrases(spark, sf_dir).groupBy("file_id", "subject", "object").agg(F.count(F.lit(1)).alias("n"))


@_query("c5_data_flow_claims", f"WITH {_PHRASES} SELECT 'data_flow' AS claim_type, 'data_flows_to' AS predicate, 0.8::DOUBLE AS confidence, count(*) AS n FROM k")
def c5(spark, sf_dir):
    return _phrases(spark, sf_dir, "data_flow", "data_flows_to", 0.8).groupBy("claim_type", "predicate", "confidence").agg(F.count(F.lit(1)).alias("n"))


@_query("c8_identifiers", f"WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part UNION SELECT unnest(['a', 'the', 'x1', '1x', 'a-b', '_ok', 'None'])) SELECT w, length(w) >= 2 AND lower(w) NOT IN ({_STOP}) AND regexp_full_match(w, '[A-Za-z_][A-Za-z0-9_]*') AS ok FROM w")
def c8(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w"))
    more = spark.createDataFrame([(x,) for x in ("a", "the", "x1", "1x", "a-b", "_ok", "None")], "w string")
    return words.unionByName(more).distinct().select("w", names.is_identifier(F.col("w")).alias("ok"))


@_query("c9_entity_types", "WITH t AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'the Function ' WHEN 1 THEN 'a class ' WHEN 2 THEN 'method of ' WHEN 3 THEN 'variable ' ELSE '' END || url AS t FROM pages) SELECT page_id, CASE WHEN contains(lower(t), 'function') THEN 'function' WHEN contains(lower(t), 'class') THEN 'class' WHEN contains(lower(t), 'method') THEN 'method' WHEN contains(lower(t), 'variable') THEN 'variable' ELSE 'unknown' END AS entity_type FROM t")
def c9(spark, sf_dir):
    m = F.col("page_id") % 5
    said = F.when(m == 0, "the Function ").when(m == 1, "a class ").when(m == 2, "method of ").when(m == 3, "variable ").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", claims.entity_type(F.concat(said, "url")).alias("entity_type"))


@_query("c10_first_claims", f"WITH {_PHRASES} SELECT CAST(doc_id AS VARCHAR) AS file_id, subject, object, CAST(min(i) AS BIGINT) AS ord FROM k GROUP BY 1, 2, 3")
def c10(spark, sf_dir):
    return claims.deduplicated(_phrases(spark, sf_dir)).select("file_id", "subject", "object", "ord")


def _turns(spark, sf_dir):
    kind = F.when(F.col("role") == "assistant", "call").when(F.col("role") == "user", "existence").otherwise("attribute")
    word = lambda k: F.lower(F.get(F.split("text", " "), k))
    return table(spark, sf_dir, "conversations").select(F.lit("all").alias("file_id"), F.col("conv_id").cast("string").alias("run_id"), F.col("turn").alias("ord"), kind.alias("claim_type"), word(0).alias("subject"), word(1).alias("object"))


_T = "t AS (SELECT CAST(conv_id AS VARCHAR) AS run_id, turn AS ord, CASE role WHEN 'assistant' THEN 'call' WHEN 'user' THEN 'existence' ELSE 'attribute' END AS claim_type, lower(string_split(text, ' ')[1]) AS subject, lower(string_split(text, ' ')[2]) AS object FROM conversations)"


@_query("c11_claim_statistics", f"WITH {_T}, d AS (SELECT DISTINCT run_id FROM t), y AS (SELECT unnest(['call', 'data_flow', 'existence', 'attribute', 'relationship', 'unknown']) AS claim_type) SELECT d.run_id, y.claim_type, (SELECT count(*) FROM t WHERE t.run_id = d.run_id AND t.claim_type = y.claim_type) AS n FROM d, y")
def c11(spark, sf_dir):
    return claims.statistics(_turns(spark, sf_dir)).drop("file_id")


@_query("c12_claims_by_type", f"WITH {_T} SELECT run_id, ord FROM t WHERE claim_type = 'existence'")
def c12(spark, sf_dir):
    return claims.of_type(_turns(spark, sf_dir), "existence").select("run_id", "ord")


@_query("c15_call_pairs", f"WITH {_T} SELECT run_id, subject AS caller, object AS callee FROM t WHERE claim_type = 'call' AND coalesce(subject, '') <> '' AND coalesce(object, '') <> ''")
def c15(spark, sf_dir):
    return claims.call_pairs(_turns(spark, sf_dir)).drop("file_id")


_C13 = """WITH s AS (SELECT user_id, event_id, ts, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM events)
SELECT user_id, CAST(segment AS BIGINT) AS segment, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS events FROM s WHERE segment > 0 GROUP BY 1, 2"""


# Sentences that one pattern of a family fits: {0} and {1} are names made of a supplier's key and of the next one.
_SENTENCES = {
    "call": ("{0} calls {1}", "The {0} function calls {1} here", "{0} invokes {1}", "{0} executes {1}", "in {0}, {1} is called", "{0} -> {1}", "{0} → {1}", "ÇAĞIRIYOR: {0}, {1}"),
    "data_flow": ("{0} is derived from {1}", "{0} depends on {1}", "{0} uses {1}", "{0} is passed to {1}", "Data flows from {0} to {1}"),
    "existence": ("there is a function called {0}", "Class {0} is defined", "{0} method is declared", "variable named {0} exists"),
    "attribute": ("{0} has a method called {1}", "{0} contains {1} method", "method {0} of class {1}"),
}
_SPEAKS_OF = "['function', 'class', 'method', 'variable'][sentence + 1]"


def _sentence_query(name: str, kind: str, predicate: str, confidence: float, patterns: tuple[str, ...]) -> None:
    two = kind != "existence"
    sql = f"""SELECT CAST(s_suppkey AS VARCHAR) AS file_id, CAST(sentence AS INT) AS sentence, 'item' || s_suppkey AS subject, {"'item' || (s_suppkey + 1)" if two else "NULL::VARCHAR"} AS object,
     '{predicate}' AS predicate, {confidence}::DOUBLE AS confidence, {"NULL::VARCHAR" if two else _SPEAKS_OF} AS entity_type FROM supplier, range({len(_SENTENCES[kind])}) r(sentence)"""

    @_query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, b = F.concat(F.lit("Item"), F.col("s_suppkey")), F.concat(F.lit("item"), F.col("s_suppkey") + 1)
        said = F.array(*(F.struct(F.lit(i).alias("sentence"), F.replace(F.replace(F.lit(x), F.lit("{0}"), a), F.lit("{1}"), b).alias("text")) for i, x in enumerate(_SENTENCES[kind])))
        rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("file_id"), F.inline(said))
        found = rows.select("file_id", "sentence", F.explode(claims.pattern_claims(F.col("text"), kind, predicate, confidence, patterns)).alias("c"))
        return found.select("file_id", "sentence", "c.subject", "c.object", "c.predicate", "c.confidence", "c.entity_type")


for _name, _family in zip(("c4_call_sentences", "c5_data_flow_sentences", "c6_existence_sentences", "c7_attribute_sentences"), claims.FAMILIES, strict=True):
    _sentence_query(_name, *_family)


@_query("c13_segments", _C13)
def c13(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("id", F.col("event_id").cast("string"))
    out = claims.segments(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", "id")
    return out.select("user_id", "segment", F.size("values").cast("long").alias("n"), F.array_join("values", ",").alias("events"))




@_query("c2_json_claims", f"SELECT event_id, event_type AS subject, 'existence' AS claim_type, NULL::VARCHAR AS object FROM events UNION ALL SELECT event_id, event_type, 'call', 'u' || user_id FROM events")
def c2(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    body = F.concat(F.lit('```json\n{"functions": [{"name": "'), "event_type", F.lit('", "calls": ["u'), F.col("user_id").cast("string"), F.lit('", "a.b", 7]}, 5, {"calls": []}]}\n```'))
    rows = e.select("event_id", F.explode(claims.json_claims(body)).alias("c"))
    return rows.select("event_id", "c.subject", "c.claim_type", "c.object")


# ---- verdict rules: suppliers as functions, classes and methods, orders as claims about them ------------------------

_RULES = """WITH RECURSIVE id AS (SELECT k, 'n' || substr(md5(CAST(k AS VARCHAR)), 1, 14) AS name FROM range(1300) r(k)),
s AS (SELECT s_suppkey AS k, name, CASE s_suppkey % 4 WHEN 2 THEN 'class' WHEN 3 THEN 'method' ELSE 'function' END AS category FROM supplier JOIN id ON k = s_suppkey),
ca AS (SELECT DISTINCT a.name AS src, b.name AS dst FROM s a JOIN s b ON b.k = (7 * a.k + 3) % 100 OR b.k = a.k // 2 WHERE a.k <> b.k UNION SELECT name, 'print' FROM s WHERE k % 6 = 0),
fl AS (SELECT DISTINCT a.name AS src, b.name AS dst FROM s a JOIN s b ON b.k = (3 * a.k + 1) % 100 WHERE a.k <> b.k AND a.k % 2 = 0),
rc AS (SELECT name AS src, name AS dst FROM s UNION SELECT rc.src, ca.dst FROM rc JOIN ca ON rc.dst = ca.src),
rf AS (SELECT name AS src, name AS dst FROM s UNION SELECT rf.src, fl.dst FROM rf JOIN fl ON rf.dst = fl.src),
c AS (SELECT DISTINCT ['call', 'data_flow', 'existence', 'attribute', 'relationship'][o_orderkey % 5 + 1] AS claim_type, i.name AS subject, CASE WHEN o_orderkey % 11 = 0 THEN 'print' ELSE j.name END AS object
 FROM orders JOIN id i ON i.k = o_custkey % 130 JOIN id j ON j.k = o_orderkey % 130),
m AS (SELECT c.*, subject IN (SELECT name FROM s WHERE c.claim_type NOT IN ('call', 'attribute') OR category = CASE c.claim_type WHEN 'call' THEN 'function' ELSE 'class' END) AS has_s,
 object IN (SELECT name FROM s WHERE c.claim_type NOT IN ('call', 'attribute') OR category = CASE c.claim_type WHEN 'call' THEN 'function' ELSE 'method' END) AS has_o,
 (subject, object) IN (SELECT (src, dst) FROM ca) AS edge, (subject, object) IN (SELECT (src, dst) FROM rc) AS calls, (subject, object) IN (SELECT (src, dst) FROM rf) AS flows, (object, subject) IN (SELECT (src, dst) FROM rf) AS back FROM c),
v AS (SELECT claim_type, subject, object, CASE claim_type
  WHEN 'call' THEN CASE WHEN NOT has_s THEN 'unverifiable 0.3' WHEN NOT has_o AND object = 'print' AND edge THEN 'valid 0.9' WHEN NOT has_o THEN 'hallucination 0.8' WHEN edge THEN 'valid 1.0' WHEN calls THEN 'partially_valid 0.6' ELSE 'hallucination 0.9' END
  WHEN 'data_flow' THEN CASE WHEN NOT (has_s AND has_o) THEN 'unverifiable 0.3' WHEN flows THEN 'valid 0.85' WHEN back THEN 'partially_valid 0.6' ELSE 'hallucination 0.7' END
  WHEN 'existence' THEN CASE WHEN has_s THEN 'valid 1.0' ELSE 'hallucination 0.9' END
  WHEN 'attribute' THEN CASE WHEN NOT has_s THEN 'unverifiable 0.3' WHEN has_o THEN 'valid 1.0' ELSE 'hallucination 0.8' END
  ELSE 'unverifiable 0.0' END AS verdict FROM m)
SELECT claim_type, subject, object, string_split(verdict, ' ')[1] AS result, CAST(string_split(verdict, ' ')[2] AS DOUBLE) AS verdict_confidence FROM v"""


@_query("v1_rules", _RULES)
def v1_rules(spark, sf_dir):
    """Every rule over whole tables: names are digests, so that none is near another, and lookups go by the type that a claim expects."""
    name = lambda k: F.concat(F.lit("n"), F.substring(F.md5(k.cast("string").cast("binary")), 1, 14))
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(F.lit("all").alias("file_id"), k.alias("k"), name(k).alias("name"), F.when(k % 4 == 2, "class").when(k % 4 == 3, "method").otherwise("function").alias("category"))
    ends = s.select(F.col("k").alias("d"), F.col("name").alias("dst"))
    edge = lambda kind, to, some: s.where(some).withColumn("d", to).where("d <> k").join(ends, "d").select("file_id", F.lit(kind).alias("graph"), F.col("name").alias("src"), "dst")
    k = F.col("k")
    calls = edge("call", (7 * k + 3) % 100, F.lit(True)).unionByName(edge("call", F.floor(k / 2), F.lit(True)))
    calls = calls.unionByName(s.where(k % 6 == 0).select("file_id", F.lit("call").alias("graph"), F.col("name").alias("src"), F.lit("print").alias("dst")))
    edges = calls.unionByName(edge("data_flow", (3 * k + 1) % 100, k % 2 == 0))
    nodes = s.select("file_id", F.explode(F.array(F.lit("call"), F.lit("data_flow"))).alias("graph"), F.col("name").alias("id"), F.col("category").alias("node_type"), F.lit(0).alias("lineno"))
    o = table(spark, sf_dir, "orders")
    kind = F.get(F.array(*map(F.lit, ("call", "data_flow", "existence", "attribute", "relationship"))), (F.col("o_orderkey") % 5).cast("int"))
    said = o.select(F.lit("all").alias("file_id"), kind.alias("claim_type"), name(F.col("o_custkey") % 130).alias("subject"), F.when(F.col("o_orderkey") % 11 == 0, "print").otherwise(name(F.col("o_orderkey") % 130)).alias("object")).distinct()
    return verify.verified(said, resolve.typed(s.select("file_id", "category", "name")), nodes, edges).select("claim_type", "subject", "object", "result", "verdict_confidence")


# ---- programs of our own: what no table holds, rows only ------------------------------------------------------------

PROGRAM = '''
import os, sys as system
from math import sqrt

LIMIT = 10
SCALE: int = LIMIT * 2


class Shape(Base):
    kind = "shape"

    def area(self, w, *rest, **more) -> float:
        """Area."""
        total = sqrt(w)
        return self.helper(total)

    def helper(self, x):
        return x


def run(n):
    shape = Shape()
    for i in range(n):
        print(shape.area(i))
    return finish(n)


def finish(n):
    return n


run(LIMIT)
'''
RESPONSE = '{"functions": [{"name": "run", "calls": ["area", "finish", "missing"]}, {"name": "ghost", "calls": []}]}'


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("a.py", PROGRAM), ("broken.py", "def ("), ("empty.py", "")], "file_id string, code string")


def _values(columns: str, *rows: str) -> str:
    """What follows from the programs above by reading them."""
    whole = " REPLACE (CAST(ord AS BIGINT) AS ord)" if "ord" in columns.split(", ") else ""
    return f"SELECT *{whole} FROM (VALUES {', '.join(rows)}) v({columns})"


def _program_query(name: str, sql: str):
    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from factgrid.plans.analysis import program

            return f(spark, program(sources(spark)))

        _query(name, sql)(run)
        return f

    return put


def _joined(df: DataFrame) -> DataFrame:
    """Lists as strings."""
    return df.select(*(F.array_join(c, ",").alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes))


_program_query("x1_facts", _values("file_id, functions, classes, variables, imports, failed", "('a.py', 4, 1, 2, 3, FALSE)", "('broken.py', 0, 0, 0, 0, TRUE)", "('empty.py', 0, 0, 0, 0, FALSE)"))(
    lambda spark, p: p.facts.select("file_id", F.size(F.array_distinct("functions.name")).alias("functions"), F.size("classes").alias("classes"), F.size("variables").alias("variables"), F.size("imports").alias("imports"), F.col("error").isNotNull().alias("failed"))
)
_program_query("x2_functions", _values("file_id, name, ord, lineno, args, returns, calls, variables, docstring",
    "('a.py', 'area', 4, 12, 'self,w,*rest,**more', 'float', 'helper,sqrt', 'total', 'Area.')", "('a.py', 'helper', 5, 17, 'self,x', NULL, '', '', NULL)",
    "('a.py', 'run', 2, 21, 'n', NULL, 'Shape,area,finish,print,range', 'shape', NULL)", "('a.py', 'finish', 3, 28, 'n', NULL, '', '', NULL)"))(lambda spark, p: _joined(p.functions))
_program_query("x3_classes", _values("file_id, name, ord, lineno, bases, methods, attributes, docstring", "('a.py', 'Shape', 0, 9, 'Base', 'area,helper', 'kind', NULL::VARCHAR)"))(lambda spark, p: _joined(p.classes))
_program_query("x4_imports", _values("file_id, ord, module, names, alias, lineno", "('a.py', 0, 'os', 'os', NULL, 2)", "('a.py', 1, 'sys', 'sys', 'system', 2)", "('a.py', 2, 'math', 'sqrt', NULL, 3)"))(lambda spark, p: _joined(p.imports))
_program_query("x6_variables", _values("file_id, name, ord, lineno, scope, assigned_value, dependencies", "('a.py', 'LIMIT', 0, 5, 'global', '10', '')", "('a.py', 'SCALE', 1, 6, 'global', 'LIMIT * 2', 'LIMIT')"))(lambda spark, p: _joined(p.variables))
_program_query("x7_calls", _values("file_id, caller, callee", *(f"('a.py', '{a}', '{b}')" for a, b in (("area", "helper"), ("area", "sqrt"), ("run", "Shape"), ("run", "area"), ("run", "finish"), ("run", "print"), ("run", "range")))))(lambda spark, p: p.call_rel)


@_program_query("x12_all_entities", _values("file_id, functions, classes, methods, variables, imports", "('a.py', 'area,finish,helper,run', 'Shape', 'area,helper', 'LIMIT,SCALE', 'math,os,sys')", "('broken.py', '', '', '', '', '')", "('empty.py', '', '', '', '', '')"))
def x12(spark, p):
    from factgrid.sources import syntax

    return _joined(syntax.all_entities(p.facts))


@_program_query("x13_module_calls", _values("file_id, callee", "('a.py', 'run')"))
def x13(spark, p):
    from factgrid.sources import syntax

    return syntax.module_calls(p.facts)


@_query("k7_graph_json")
def k7(spark, sf_dir):
    from factgrid.plans.analysis import program
    from factgrid.sinks import export

    p = program(sources(spark))
    return export.graph_json(p.nodes, p.edges)


def _responses(spark: SparkSession) -> DataFrame:
    from factgrid.sources.providers import generate

    own = spark.createDataFrame([("a.py", "json", RESPONSE, [])], "file_id string, run_id string, content string, reasoning_steps array<string>")
    return generate(sources(spark), "mock", run_id="mock").select(*own.columns).unionByName(own)


@_query("s8_mock_responses")
def s8(spark, sf_dir):
    return _responses(spark).select("file_id", "run_id", "content", F.size("reasoning_steps").alias("steps"))


_JSON, _NONE = """'{"source":"json"}'""", "'{}'"
_FUNCTION, _CLASS, _FROM_JSON = """'{"entity_type":"function"}'""", """'{"entity_type":"class"}'""", """'{"entity_type":"function","source":"json"}'"""
#: run, ord, text, type, subject, object, predicate, confidence, metadata; result, confidence of the verdict, reason.
_JUDGED = f"""j AS (SELECT 'a.py' AS file_id, * FROM (VALUES
('json', 0, 'Function run exists', 'existence', 'run', NULL, 'exists', 1.0::DOUBLE, {_FROM_JSON}, 'valid', 1.0::DOUBLE, 'exists: run'),
('json', 1, 'run calls area', 'call', 'run', 'area', 'calls', 1.0, {_JSON}, 'valid', 1.0, 'direct call run -> area'),
('json', 2, 'run calls finish', 'call', 'run', 'finish', 'calls', 1.0, {_JSON}, 'valid', 1.0, 'direct call run -> finish'),
('json', 3, 'run calls missing', 'call', 'run', 'missing', 'calls', 1.0, {_JSON}, 'hallucination', 0.8, 'unknown callee missing'),
('json', 4, 'Function ghost exists', 'existence', 'ghost', NULL, 'exists', 1.0, {_FROM_JSON}, 'hallucination', 0.9, 'nothing is called ghost'),
('mock', 0, 'çağırıyor: Shape, area', 'call', 'shape', 'area', 'calls', 0.9, {_NONE}, 'unverifiable', 0.3, 'unknown caller shape'),
('mock', 2, 'ÇAĞIRIYOR: run, area', 'call', 'run', 'area', 'calls', 0.9, {_NONE}, 'valid', 1.0, 'direct call run -> area'),
('mock', 3, 'ÇAĞIRIYOR: area, finish', 'call', 'area', 'finish', 'calls', 0.9, {_NONE}, 'hallucination', 0.9, 'no call area -> finish'),
('mock', 4, 'FONKSIYON: helper' || chr(10) || 'ÇAĞIRIYOR: run', 'call', 'helper', 'run', 'calls', 0.9, {_NONE}, 'hallucination', 0.9, 'no call helper -> run'),
('mock', 6, 'FONKSIYON: finish' || chr(10) || 'ÇAĞIRIYOR: run', 'call', 'finish', 'run', 'calls', 0.9, {_NONE}, 'hallucination', 0.9, 'no call finish -> run'),
('mock', 8, 'helper calls area', 'call', 'helper', 'area', 'calls', 0.95, {_NONE}, 'hallucination', 0.9, 'no call helper -> area'),
('mock', 9, 'helper calls finish', 'call', 'helper', 'finish', 'calls', 0.95, {_NONE}, 'hallucination', 0.9, 'no call helper -> finish'),
('mock', 13, 'run calls finish', 'call', 'run', 'finish', 'calls', 0.95, {_NONE}, 'valid', 1.0, 'direct call run -> finish'),
('mock', 16, 'Shape sınıfı tanımlanmış', 'existence', 'shape', NULL, 'exists', 0.85, {_CLASS}, 'valid', 1.0, 'exists: Shape'),
('mock', 17, 'FONKSIYON: area', 'existence', 'area', NULL, 'exists', 0.85, {_FUNCTION}, 'valid', 1.0, 'exists: area'),
('mock', 18, 'FONKSIYON: helper', 'existence', 'helper', NULL, 'exists', 0.85, {_FUNCTION}, 'valid', 1.0, 'exists: helper'),
('mock', 19, 'FONKSIYON: run', 'existence', 'run', NULL, 'exists', 0.85, {_FUNCTION}, 'valid', 1.0, 'exists: run'),
('mock', 20, 'FONKSIYON: finish', 'existence', 'finish', NULL, 'exists', 0.85, {_FUNCTION}, 'valid', 1.0, 'exists: finish'),
('mock', 25, 'Shape has method area', 'attribute', 'shape', 'area', 'has_method', 0.9, {_NONE}, 'valid', 1.0, 'has method shape -> area'),
('mock', 26, 'Shape has method helper', 'attribute', 'shape', 'helper', 'has_method', 0.9, {_NONE}, 'valid', 1.0, 'has method shape -> helper')
) v(run_id, ord, text, claim_type, subject, object, predicate, confidence, metadata, result, verdict_confidence, reason))"""


@_query("c1_claims", f"WITH {_JUDGED} SELECT file_id, run_id, CAST(ord AS BIGINT) AS ord, text, claim_type, subject, object, predicate, confidence, 0 AS source_step, metadata FROM j")
def c1(spark, sf_dir):
    return claims.extracted(_responses(spark)).withColumn("metadata", F.to_json("metadata"))


@_query("c14_mock_steps")
def c14(spark, sf_dir):
    return claims.reasoning_steps(_responses(spark), mock=True)


@_query("v1_verdicts", f"WITH {_JUDGED} SELECT file_id, run_id, CAST(ord AS BIGINT) AS ord, claim_type, subject, object, result, verdict_confidence, reason FROM j")
def v1(spark, sf_dir):
    from factgrid.plans.analysis import analyse

    return analyse(sources(spark), _responses(spark)).verdicts.select("file_id", "run_id", "ord", "claim_type", "subject", "object", "result", "verdict_confidence", "reason")


@_query("k9_comparison_json")
def k9(spark, sf_dir):
    from factgrid.plans.analysis import RUN, compare
    from factgrid.sinks import export

    done = compare(sources(spark), _responses(spark))
    return export.api_json(done.truth, done.claimed, done.comparison, done.scores, RUN)


@_query("s4_requests", _values("file_id, use_llm, provider, lines", "('1', FALSE, 'gemini', 2)"))
def s4(spark, sf_dir):
    from factgrid.sources.files import code_info, read_requests

    bodies = spark.createDataFrame([("1", '{"code": "x = 1\\ny = 2", "use_llm": false}'), ("2", '{"code": "  "}'), ("3", "{}")], "file_id string, body string")
    asked = read_requests(bodies)
    return asked.join(code_info(asked), "file_id").select("file_id", "use_llm", "provider", "lines")


@_query("s11_prompts")
def s11(spark, sf_dir):
    from factgrid.sources.providers import prompts

    return prompts(sources(spark), "openai", F.lit("review")).select("file_id", "prompt")


@_query("k3_report_rows", f"WITH {_JUDGED} SELECT file_id, run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY ord) AS INT) AS place, text, claim_type, result, verdict_confidence, reason FROM j")
def k3(spark, sf_dir):
    from factgrid.plans.analysis import analyse
    from factgrid.sinks.report import numbered

    return numbered(analyse(sources(spark), _responses(spark)).verdicts)


_K12 = f"WITH {_E}, c AS (SELECT DISTINCT caller AS id FROM t UNION SELECT DISTINCT callee FROM t) SELECT id FROM c"


@_query("k12_drawn_nodes", _K12)
def k12(spark, sf_dir):
    from factgrid.sinks.export import drawn_nodes

    return drawn_nodes(call_edges(spark, sf_dir)[0], ["file_id"]).select("id")


@_query("k12_score_label", "SELECT run_id, CASE WHEN h > 30 THEN 'danger' WHEN h > 10 OR p < 70 THEN 'warning' ELSE 'success' END AS label FROM (SELECT CAST(user_id AS VARCHAR) AS run_id, 100 * avg(CASE WHEN value > 150 THEN 1.0 ELSE 0 END) AS h, 100 * avg(CASE WHEN value < 100 THEN 1.0 ELSE 0 END) AS p FROM events GROUP BY 1) r")
def k12_label(spark, sf_dir):
    from factgrid.sinks.export import score_label

    share = lambda c: (100 * F.avg(F.when(c, 1.0).otherwise(0.0)))
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("run_id")).agg(share(F.col("value") > 150).alias("hallucination_rate"), share(F.col("value") < 100).alias("precision"))
    return score_label(e).select("run_id", "label")


@_query("k11_node_colours", f"WITH {_P} SELECT file_id, id, CASE node_type WHEN 'function' THEN '#4CAF50' ELSE '#FF9800' END AS colour FROM cn")
def k11(spark, sf_dir):
    from factgrid.sinks.export import node_colour

    f, _, _, calls = programs(spark, sf_dir)
    return graph.call_graph(f, calls)[0].select("file_id", "id", node_colour(F.col("node_type")).alias("colour"))
