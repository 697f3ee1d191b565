"""Call claims as a stream against graphs that stand still: a verdict for each claim, and rates by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgrid.operators import graph


def direct_verdicts(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """claims (file_id, subject, object, ts, others), a stream, with result: valid if the call graph has the edge, else hallucination."""
    own = graph.in_graph(edges, "call").select("file_id", F.col("src").alias("subject"), F.col("dst").alias("object")).distinct().withColumn("_edge", F.lit(True))
    met = claims.join(own, ["file_id", "subject", "object"], "left")
    return met.withColumn("result", F.when(F.col("_edge"), "valid").otherwise("hallucination")).drop("_edge")


def windowed_rates(verdicts: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """start, file_id, total_claims, hallucination_rate of event-time windows; rows later than the watermark are dropped."""
    out = verdicts.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "file_id")
    rates = out.agg(F.count(F.lit(1)).alias("total_claims"), F.avg((F.col("result") == "hallucination").cast("double")).alias("hallucination_rate"))
    return rates.select(F.col("w.start").alias("start"), "file_id", "total_claims", "hallucination_rate")
