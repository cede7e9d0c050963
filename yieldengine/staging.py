"""Lineage cuts: write an intermediate table once to the shared checkpoint folder and read it back.

A staged table is plain Parquet, so later readers prune columns, Spark knows its size (which is what lets the planner
broadcast a small one by its own threshold and shuffle a big one) and a lost executor costs a re-read, not a recompute.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import RDD, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="yieldengine-")
    spark.sparkContext.setCheckpointDir(root)
    return root


_staged: list[str] = []
_tables: list[str] = []


def stage(df: DataFrame, label: str, reader: SparkSession | None = None) -> DataFrame:
    """Materialise `df` under the checkpoint folder and return a reader over the written table (in session `reader`)."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append(path)
    return (reader or spark).read.schema(df.schema).parquet(path)


def stage_objects(rdd: RDD, spark: SparkSession, label: str) -> tuple[str, RDD]:
    """Like `stage`, for an RDD of Python objects, one a record; with the path, for `remove`."""
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    rdd.saveAsPickleFile(path, 1)
    _staged.append(path)
    return path, spark.sparkContext.pickleFile(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a staged table that nothing reads any more."""
    if path in _staged:
        _staged.remove(path)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage_clustered(parts: dict[str, DataFrame], *keys: str) -> list[DataFrame]:
    """Like `stage`, but as tables in as many buckets by `keys` as a shuffle has partitions; all are written at the same time.

    Joins and groupings by the keys, or by more columns beside them, then need no exchange, however often a table is
    read. A bucket is written and read by one task, so the rows must already be aggregated by the keys: a key may
    have as many rows as it has groups (materials and plants of an order), not as it has ledger lines.
    """
    spark = next(iter(parts.values())).sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    root = checkpoint_root(spark)

    def written(label: str, df: DataFrame) -> DataFrame:
        name = f"{label}_{uuid.uuid4().hex}"
        # a task per bucket, so a file per bucket; Spark drops this exchange where the aggregate has left the rows that way
        by_key = df.repartition(buckets, *keys)
        by_key.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{root}/{name}").format("parquet").saveAsTable(name)
        _staged.append(f"{root}/{name}")
        _tables.append(name)
        return spark.table(name)

    with ThreadPoolExecutor(len(parts)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(written), parts, parts.values()))


def remove_unreachable(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of steps that have ended; else they stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove_staged(spark: SparkSession) -> None:
    """Remove the tables staged so far by this process; call it once a run's results are written."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _staged:
        remove(spark, _staged[-1])
