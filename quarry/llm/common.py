"""Shared plumbing: reading tables, cutting lineage in the shared folder, Arrow batch helpers."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: White space and words, in Java, Python and RE2 syntax alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, one beside the warehouse, which they share too."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        root = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), ".quarry")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/quarry-{uuid.uuid4().hex}/{tag}"
    jvm = spark._jvm
    parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
    parent.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(parent)
    return path


def release(spark: SparkSession) -> None:
    """Let the driver's cleaner drop shuffle files of plans that are no longer referenced: disk is scarcer than a short collection."""
    gc.collect()
    spark._jvm.System.gc()


def cut(df: DataFrame, tag: str, **options) -> DataFrame:
    """Write ``df`` as a table in the shared folder (with the writer's ``options``) and read it again: lineage ends there, statistics begin."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.options(**options).parquet(path)
    schema = df.schema
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns renamed by position, and each new name by its old one: no name of an operator's own can clash."""
    names = {name: f"c{k}" for k, name in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Arrow batches between the JVM and Python hold at most ``rows`` rows for the rest of the session: whole texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def arrow_rows(
    schema: pa.Schema, fn: Callable[[pa.RecordBatch], list[list]], rows: int = 2048
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function: ``fn`` turns slices of at most ``rows`` input rows into one list per column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                columns = fn(batch.slice(at, rows))
                arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t) for c, t in zip(columns, schema.types)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return run
