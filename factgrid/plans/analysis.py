"""The two ways from programs and responses to a judgement, over a whole corpus.

`analyse` judges each claim by lookups in the graphs; `compare` sets claimed call edges against true ones. Facts come out of
a Python parser, which Catalyst can't look into, so they are written once and read as tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgrid.operators import claims, graph, metrics, resolve, verify
from factgrid.operators import compare as comparing
from factgrid.sources import syntax
from factgrid.storage import cut

RUN = ["file_id", "run_id"]


@dataclass
class Program:
    """Tables of a corpus of programs."""

    facts: DataFrame
    functions: DataFrame
    classes: DataFrame
    variables: DataFrame
    imports: DataFrame
    call_rel: DataFrame
    nodes: DataFrame
    edges: DataFrame
    vocab: DataFrame


def program(sources: DataFrame) -> Program:
    """sources: file_id, code."""
    facts = cut(syntax.facts(sources), "facts")
    f, c, v, i, r = syntax.functions(facts), syntax.classes(facts), syntax.variables(facts), syntax.imports(facts), syntax.call_rel(facts)
    nodes, edges = graph.build(f, c, v, r)
    return Program(facts, f, c, v, i, r, cut(nodes, "nodes"), cut(edges, "edges"), cut(resolve.vocabulary(f, c, v, i), "vocab"))


@dataclass
class Analysis:
    """What `analyse` returns, each table keyed by file_id and run_id."""

    claims: DataFrame
    verdicts: DataFrame
    report: DataFrame
    metrics: DataFrame
    summary: DataFrame
    types: DataFrame
    recommendations: DataFrame


def analyse(sources: DataFrame, responses: DataFrame, max_hops: int | None = None) -> Analysis:
    p = program(sources)
    said = cut(claims.extracted(responses), "claims")
    verdicts = cut(verify.verified(said, p.vocab, p.nodes, p.edges, max_hops), "verdicts")
    names = responses.select(*RUN).distinct().join(p.vocab.select("file_id", "name").distinct(), "file_id")
    rates, types = metrics.rates(verdicts, RUN), metrics.type_breakdown(verdicts, RUN)
    wide = rates.join(metrics.coverage(metrics.mentioned(verdicts, RUN), names, RUN), RUN, "left")
    wide = wide.join(metrics.step_validity(verdicts, RUN), RUN, "left").join(metrics.confidence_distribution(verdicts, RUN).select(*RUN, F.col("average").alias("average_confidence")), RUN, "left").join(metrics.chain_coherence(verdicts, RUN), RUN, "left")
    wide = wide.na.fill(0.0, ["coverage"])
    summary = metrics.graded(rates)
    rows = metrics.as_rows(wide, RUN, ["hallucination_rate", "validity_rate", "coverage", "step_validity", "average_confidence", "chain_coherence"])
    return Analysis(said, verdicts, verify.report(verdicts, RUN), rows, summary, types, metrics.recommended(wide, types, RUN))


@dataclass
class Comparison:
    truth: DataFrame
    claimed: DataFrame
    comparison: DataFrame
    scores: DataFrame


def compare(sources: DataFrame, responses: DataFrame) -> Comparison:
    """True edges of each run's program against the edges that its response claims."""
    p = program(sources)
    methods = p.classes.select("file_id", F.explode("methods").alias("name"))
    edges = graph.truth_edges(p.functions, p.call_rel, syntax.module_calls(p.facts))
    truth = responses.select(*RUN).distinct().join(comparing.truth_calls(edges, p.functions, methods), "file_id").select(*RUN, "caller", "callee")
    said = comparing.claimed_calls(claims.call_pairs(claims.extracted(responses)), p.functions, methods).select(*RUN, "caller", "callee")
    truth, said = cut(truth, "truth"), cut(said, "claimed")
    result = cut(comparing.compared(truth, said, RUN), "compared")
    return Comparison(truth, said, result, comparing.scores(truth, said, result, RUN))
