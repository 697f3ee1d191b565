"""Programs as rows: whole files, or request bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sources(spark: SparkSession, *paths: str) -> DataFrame:
    """file_id (the path) and code (the whole UTF-8 text) of each file that the paths or patterns name."""
    return spark.read.text([*paths], wholetext=True).select(F.col("_metadata.file_path").alias("file_id"), F.col("value").alias("code"))


def read_requests(requests: DataFrame) -> DataFrame:
    """file_id, code, use_llm, provider of the requests that have code; use_llm and provider have defaults.

    requests: file_id, body (JSON). A blank or missing code makes no program: see `rejected_requests`.
    """
    body = F.from_json("body", "code string, use_llm boolean, provider string")
    out = requests.select("file_id", body.alias("b")).select("file_id", "b.code", F.coalesce("b.use_llm", F.lit(True)).alias("use_llm"), F.coalesce("b.provider", F.lit("gemini")).alias("provider"))
    return out.where(F.trim(F.coalesce("code", F.lit(""))) != "")


def rejected_requests(requests: DataFrame) -> DataFrame:
    """file_id and status 400 of requests without code."""
    return requests.join(read_requests(requests), "file_id", "left_anti").select("file_id", F.lit(400).alias("status"))


def code_info(sources: DataFrame) -> DataFrame:
    """file_id, filename, path, lines."""
    return sources.select("file_id", F.element_at(F.split("file_id", "/"), -1).alias("filename"), F.col("file_id").alias("path"), F.size(F.split("code", "\n")).alias("lines"))
