"""Verdicts on claims: each claim meets its names' matches and the graph's edges and paths; rules are CASE expressions.

Reachability is asked only for pairs that the rules can't decide without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgrid.functions.names import is_builtin
from factgrid.operators import graph
from factgrid.operators.resolve import resolved
from factgrid.storage import cut

CALL_CONFIDENCE = {"unverifiable": 0.3, "builtin": 0.9, "no_object": 0.8, "path": 0.6, "none": 0.9}
FLOW_CONFIDENCE = {"unverifiable": 0.3, "path": 0.85, "reversed": 0.6, "none": 0.7}
NO_ENTITY, NO_METHOD = 0.9, 0.8


def mention_types(claim_type: Column) -> Column:
    """What the subject and object of a claim are looked up as; '' is anything."""
    as_ = lambda s, o: F.struct(F.lit(s).alias("s"), F.lit(o).alias("o"))
    return F.when(claim_type == "call", as_("function", "function")).when(claim_type == "attribute", as_("class", "method")).otherwise(as_("", ""))


def _verdict(result: str, confidence: Column, reason: Column) -> Column:
    return F.struct(F.lit(result).alias("result"), confidence.cast("double").alias("confidence"), reason.alias("reason"))


def verified(claims: DataFrame, vocab: DataFrame, nodes: DataFrame, edges: DataFrame, max_hops: int | None = None, **matching) -> DataFrame:
    """claims with result, verdict_confidence, reason, subject_match, object_match and evidence."""
    asked = claims.withColumn("_t", mention_types(F.col("claim_type")))
    one = asked.select("file_id", F.col("subject").alias("text"), F.col("_t.s").alias("expected_type"))
    two = asked.select("file_id", F.col("object").alias("text"), F.col("_t.o").alias("expected_type"))
    matches = cut(resolved(one.unionByName(two).where("text is not null"), vocab, **matching), "matches")
    side = lambda name, text, kind: matches.select(F.col("file_id"), F.col("text").alias(text), F.col("expected_type").alias(kind), F.struct("code_entity", "match_type", "confidence", "entity_type").alias(name))
    met = asked.withColumn("_ts", F.col("_t.s")).withColumn("_to", F.col("_t.o"))
    met = met.join(side("subject_match", "subject", "_ts"), ["file_id", "subject", "_ts"], "left").join(side("object_match", "object", "_to"), ["file_id", "object", "_to"], "left")
    s, o = F.col("subject_match.code_entity"), F.col("object_match.code_entity")
    direct = graph.in_graph(edges, "call").select("file_id", F.col("src").alias("_s"), F.col("dst").alias("_o")).distinct().withColumn("_edge", F.lit(True))
    # a callee that no vocabulary has is looked for as it was said
    met = met.withColumn("_s", s).withColumn("_o", F.coalesce(o, F.col("object"))).join(direct, ["file_id", "_s", "_o"], "left")
    met = cut(met.withColumn("_edge", F.coalesce("_edge", F.lit(False))), "met")  # path questions and verdicts both read it
    edge = F.col("_edge")

    call, flow = F.col("claim_type") == "call", F.col("claim_type") == "data_flow"
    both = s.isNotNull() & o.isNotNull()
    pairs = met.where(both & call & ~edge).select("file_id", F.lit("call").alias("kind"), s.alias("src"), o.alias("dst"))
    there = met.where(both & flow).select("file_id", F.lit("data_flow").alias("kind"), s.alias("src"), o.alias("dst"))
    back = there.select("file_id", "kind", F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = None
    for kind, wanted in (("call", pairs), ("data_flow", there.unionByName(back))):
        own = graph.find_path(wanted.select("file_id", "src", "dst").distinct(), nodes, edges, kind, max_hops).where("has_path").select("file_id", F.lit(kind).alias("claim_type"), F.col("src").alias("_s"), F.col("dst").alias("_o"), "path")
        found = own if found is None else found.unionByName(own)
    met = met.join(found, ["file_id", "claim_type", "_s", "_o"], "left")
    met = met.join(found.select("file_id", "claim_type", F.col("_s").alias("_o"), F.col("_o").alias("_s"), F.col("path").alias("_back")), ["file_id", "claim_type", "_s", "_o"], "left")

    cs, co = F.col("subject_match.confidence"), F.col("object_match.confidence")
    lit, quote = F.lit, lambda c: F.coalesce(c, F.lit("?"))
    arrow = F.concat(quote(F.col("subject")), lit(" -> "), quote(F.col("object")))
    on_call = (
        F.when(s.isNull(), _verdict("unverifiable", lit(CALL_CONFIDENCE["unverifiable"]), F.concat(lit("unknown caller "), quote(F.col("subject")))))
        .when(o.isNull() & is_builtin(F.col("object")) & edge, _verdict("valid", lit(CALL_CONFIDENCE["builtin"]), F.concat(lit("calls builtin "), arrow)))
        .when(o.isNull(), _verdict("hallucination", lit(CALL_CONFIDENCE["no_object"]), F.concat(lit("unknown callee "), quote(F.col("object")))))
        .when(edge, _verdict("valid", F.least(cs, co), F.concat(lit("direct call "), arrow)))
        .when(F.col("path").isNotNull(), _verdict("partially_valid", lit(CALL_CONFIDENCE["path"]), F.concat(lit("indirect call "), F.array_join("path", " -> "))))
        .otherwise(_verdict("hallucination", lit(CALL_CONFIDENCE["none"]), F.concat(lit("no call "), arrow)))
    )
    on_flow = (
        F.when(~both, _verdict("unverifiable", lit(FLOW_CONFIDENCE["unverifiable"]), F.concat(lit("unknown name in "), arrow)))
        .when(F.col("path").isNotNull(), _verdict("valid", lit(FLOW_CONFIDENCE["path"]), F.concat(lit("data flows "), F.array_join("path", " -> "))))
        .when(F.col("_back").isNotNull(), _verdict("partially_valid", lit(FLOW_CONFIDENCE["reversed"]), F.concat(lit("data flows the other way "), arrow)))
        .otherwise(_verdict("hallucination", lit(FLOW_CONFIDENCE["none"]), F.concat(lit("no data flow "), arrow)))
    )
    on_existence = F.when(s.isNotNull(), _verdict("valid", cs, F.concat(lit("exists: "), s))).otherwise(_verdict("hallucination", lit(NO_ENTITY), F.concat(lit("nothing is called "), quote(F.col("subject")))))
    on_attribute = (
        F.when(s.isNull(), _verdict("unverifiable", lit(0.3), F.concat(lit("unknown class "), quote(F.col("subject")))))
        .when(o.isNotNull(), _verdict("valid", F.least(cs, co), F.concat(lit("has method "), arrow)))
        .otherwise(_verdict("hallucination", lit(NO_METHOD), F.concat(lit("no method "), arrow)))
    )
    kind = F.col("claim_type")
    verdict = F.when(call, on_call).when(flow, on_flow).when(kind == "existence", on_existence).when(kind == "attribute", on_attribute).otherwise(_verdict("unverifiable", lit(0.0), lit("no rule for this type")))
    evidence = F.struct(
        F.when(call, edge).alias("direct_call"), F.when(call | flow, F.col("path").isNotNull() | (call & edge)).alias("path_exists"), F.when(flow, F.col("_back").isNotNull() & F.col("path").isNull()).alias("reversed"),
        F.when(call, is_builtin(F.col("object"))).alias("is_builtin"), F.when(kind == "existence", s.isNotNull()).alias("exists"), F.col("subject_match.entity_type").alias("entity_type"),
        F.when(kind == "attribute", o.isNotNull()).alias("has_attribute"), F.col("path").alias("path"),
    )
    out = met.withColumn("_v", verdict).withColumn("evidence", evidence)
    return out.select(*claims.columns, F.col("_v.result").alias("result"), F.col("_v.confidence").alias("verdict_confidence"), F.col("_v.reason").alias("reason"), "subject_match", "object_match", "evidence")


def is_valid(result: Column) -> Column:
    """Valid or partially valid."""
    return result.isin("valid", "partially_valid")


def is_hallucination(result: Column) -> Column:
    return result == "hallucination"


def report(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of results and the two rates, for each key."""
    r = F.col("result")
    out = verdicts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_claims"), F.count_if(r == "valid").alias("valid_count"), F.count_if(is_hallucination(r)).alias("hallucination_count"),
        F.count_if(r == "unverifiable").alias("unverifiable_count"), F.count_if(r == "partially_valid").alias("partially_valid_count"),
    )
    rate = lambda n: F.coalesce(F.try_divide(n.cast("double"), F.col("total_claims")), F.lit(0.0))
    return out.withColumn("validity_rate", rate(F.col("valid_count") + F.col("partially_valid_count"))).withColumn("hallucination_rate", rate(F.col("hallucination_count")))


def hallucinations(verdicts: DataFrame) -> DataFrame:
    return verdicts.where(is_hallucination(F.col("result")))


def valid_claims(verdicts: DataFrame) -> DataFrame:
    return verdicts.where(F.col("result") == "valid")
