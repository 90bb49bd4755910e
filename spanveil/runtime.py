"""Session helpers: import path of the workers, the shared folder, written tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Arrow batches between the JVM and Python workers hold no more than this, so that long texts cost little memory.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 20)}


#: A worker is one core, and gives memory back when a task has freed it.
WORKERS = {"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1", "MALLOC_ARENA_MAX": "1", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ensure_importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did (a shared or equal path on every node), and bounds their batches and memory."""
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    for k, v in WORKERS.items():
        env.setdefault(k, v)
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); a folder of our own only where that is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
    own = "file://" + tempfile.mkdtemp(prefix="spanveil-")
    spark.conf.set("spark.checkpoint.dir", own)
    spark.sparkContext.setCheckpointDir(own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths of the tables that written() made and drop_written() hasn't removed.
_TABLES: list[str] = []


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes ``df`` as Parquet in the shared folder and reads it again: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    # row groups of 32 MB: a task holds one in memory
    df.write.option("compression", "zstd").option("parquet.block.size", str(32 << 20)).parquet(path)
    _TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_written(spark: SparkSession, keep: tuple[str, ...] = ()) -> None:
    """Removes the tables that written() has made so far, but for ``keep``; for callers that need no result which reads them any more."""
    for path in [p for p in _TABLES if p not in keep]:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    if path in _TABLES:
        _TABLES.remove(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def paths_below(spark: SparkSession, folder: str) -> list[str]:
    """The paths in a folder; none if it isn't there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(str(s.getPath().toString()) for s in fs.listStatus(target)) if fs.exists(target) else []
