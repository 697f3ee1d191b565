"""What the operators of this subpackage share: input columns, scratch tables, checked broadcasts."""

from __future__ import annotations

import gc
import math
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgrid.storage import work_dir

#: White space of the words and line keys: space and the controls 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")

#: Settings of batches to Python workers: Spark's default, and ours. A batch is held several times at once: by the JVM, the
#: worker, and as Python strings.
_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16m"),
}

_scratch: dict[str, list[str]] = {}


def stored(df: DataFrame, name: str, scope: str = "query", by: str | None = None) -> DataFrame:
    """df as a table written to the shared folder (in a folder for each value of `by`) and read again: lineage ends there, and a lost executor costs no recomputation."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    _scratch.setdefault(scope, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, scope: str) -> None:
    """Deletes the scratch tables of a scope. To be called once the results built on them are written."""
    for path in _scratch.pop(scope, []):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession) -> None:
    """Batches to Python workers of at most 1,000 rows and 16 MB in this session, unless it has settings of its own."""
    for key, (default, ours) in _BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)


def give_back() -> None:
    """Returns to the system what Arrow's allocator holds unused in a Python worker, which else adds to all that comes after."""
    pa.default_memory_pool().release_unused()


def forgotten_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that no plan needs any more: it does so when the driver's JVM collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: an optimiser can't copy it into each use."""
    return F.get(F.transform(F.array(value), body), 0)


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of the decimal form of an id; null stays null."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def small(df: DataFrame, most_rows: int) -> list | None:
    """The rows of df if there are at most most_rows, else None: at most one more than that comes to the driver."""
    rows = df.limit(most_rows + 1).collect()
    return rows if len(rows) <= most_rows else None


def only(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns alone, cast: other columns, whatever their names, stay outside the operator."""
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in kinds.items()))


def schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def lanes() -> Iterator[int]:
    """Well-spread numbers that differ from task to task: the leaves of `merged_in_a_tree`."""
    part, k = TaskContext.get().partitionId(), 0
    while True:
        yield xxhash.xxh32_intdigest(f"{part} {k}")
        k += 1


def merged_in_a_tree(parts: DataFrame, merge: Callable[[pa.Table], pa.Table], kind: T.StructType, n_parts: int, fan_in: int = 64) -> DataFrame:
    """One row for each segment. parts: segment, lane (of `lanes`) and values; merge takes about fan_in rows of a segment into one, however many there are."""
    n = max(1, n_parts)
    while n > 1:
        n = math.ceil(n / fan_in)
        parts = parts.withColumn("lane", F.pmod("lane", F.lit(n))).groupBy("segment", "lane").applyInArrow(merge, kind)
    return parts if n_parts > 1 else parts.groupBy("segment").applyInArrow(merge, kind)
