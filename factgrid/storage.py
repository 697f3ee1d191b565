"""Scratch tables in the folder that the cluster shares."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where scratch tables go in local mode if no shared folder is named, as in tests: a cluster has to name one.
LOCAL_WORK_DIR = "/tmp/checkpoints/factgrid"


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, only a session in local mode gets a folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
    return f"{(named or LOCAL_WORK_DIR).rstrip('/')}/factgrid"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written to the shared folder and read again, so that its lineage ends there and a lost executor costs nothing."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
