"""Intermediate tables in the folder that all executors share, and joins that heavy keys don't slow.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``. The setting is read from the
session; only where it is unset and the master is local (tests) a temporary folder is made.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

KEY = "spark.checkpoint.dir"
#: rows of an Arrow batch, where the session leaves Spark's default of 10,000
BATCH_ROWS = 1_000
#: a key is heavy if more than one in so many rows have it, so there are fewer heavy keys than that
HEAVY = 1_000
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {KEY} to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set(KEY, found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python workers in batches of ``BATCH_ROWS``, unless the session says otherwise."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


@contextmanager
def _shuffles_end(spark: SparkSession):
    """Shuffle files of the jobs within go when the jobs end."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before) if before else spark.conf.unset(_CLEAN)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back, so that lost executors re-read files, not lineage."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    with _shuffles_end(spark):
        df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_tidemark_path", None)
        if path:
            spark = table.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` joined to ``facts``, which has one row a key and in ``weight`` the rows of that key.

    Heavy keys are fewer than ``HEAVY``, so their facts are broadcast and their rows stay where they are;
    the rest are shuffled, and none of them fills a task.
    """
    least = max(1, total // HEAVY)
    heavy = F.broadcast(facts.filter(F.col(weight) > least))
    light = facts.filter(F.col(weight) <= least)
    calm = rows.join(F.broadcast(facts.filter(F.col(weight) > least).select(keys)), keys, "left_anti")
    return rows.join(heavy, keys).unionByName(calm.join(light, keys))
