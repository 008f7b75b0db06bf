"""Splittable CSV with quoted line breaks: records are put together from lines by where they begin.

Spark's ``multiLine`` reads a file in one task. Here a file's splits are read as lines, in parallel
and from any store that Spark reads. A line that begins like a record begins one; the lines that
follow belong to it, also past the end of its split. A record's shard is the split it begins in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from .readers import NEWS

#: Fixed value: how a record begins, an optional number and a timestamp.
RECORD = r"^(?:\d+(?:\.\d+)?)?,\d{4}-\d{2}-\d{2}"


def records(spark: SparkSession, path: str, record: str = RECORD) -> DataFrame:
    """(file, shard, place, record): each record's text, its line breaks included.

    ``shard`` is the offset of the split a record begins in and ``place`` its number there. Lines
    before a file's first record, such as its header, belong to none. A body's line that begins
    like a record would be taken for one.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("shard"), F.monotonically_increasing_id().alias("at"), "value")
    own = W.partitionBy("file", "shard").orderBy("at")
    numbered = lines.withColumn("place", F.count_if(F.col("value").rlike(record)).over(own.rowsBetween(W.unboundedPreceding, 0)))
    # a split's first lines go on with the last record of the splits before it: a row a split
    last = numbered.groupBy("file", "shard").agg(F.max("place").alias("n"))
    found = F.when(F.col("n") > 0, F.struct("shard", "n"))
    before = W.partitionBy("file").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    last = last.select("file", "shard", F.last(found, ignorenulls=True).over(before).alias("open"))
    placed = numbered.join(last, ["file", "shard"])
    goes_on = F.col("place") == 0
    placed = placed.select("file", F.col("shard").alias("split"), "at", "value", F.when(goes_on, F.col("open.shard")).otherwise(F.col("shard")).alias("shard"), F.when(goes_on, F.col("open.n")).otherwise(F.col("place")).alias("place"))
    whole = placed.filter("place IS NOT NULL").groupBy("file", "shard", "place").agg(F.array_sort(F.collect_list(F.struct("split", "at", "value"))).alias("lines"))
    return whole.select("file", "shard", "place", F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("record"))


def read_news_split(spark: SparkSession, path: str, schema: T.StructType = NEWS, strict: bool = True, record: str = RECORD) -> DataFrame:
    """The rows of a news CSV of any size with its columns as strings, and _shard (file name and offset).

    A row that isn't CSV of the schema fails the job, or is all null if not ``strict``.
    """
    options = {"quote": '"', "escape": '"', "mode": "FAILFAST" if strict else "PERMISSIVE", "maxCharsPerColumn": "-1"}
    row = F.from_csv(F.rtrim(F.col("record"), F.lit("\r")), schema.simpleString()[7:-1].replace(":", " "), options)
    shard = F.concat(F.element_at(F.split("file", "/"), -1), F.lit("-"), F.col("shard"))
    return records(spark, path, record).select(row.alias("row"), shard.alias("_shard")).select("row.*", "_shard")


def ingest(spark: SparkSession, path: str, out: str, schema: T.StructType = NEWS, record: str = RECORD) -> DataFrame:
    """Append the shards of ``path`` that the dataset ``out`` doesn't hold yet, and return the dataset.

    A failed job commits nothing, so a shard is there whole or not at all. Shards are splits: keep
    spark.sql.files.maxPartitionBytes between runs.
    """
    rows = read_news_split(spark, path, schema, record=record)
    target = spark._jvm.org.apache.hadoop.fs.Path(out)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        done = spark.read.parquet(out).select("_shard").distinct()
        rows = rows.join(F.broadcast(done), "_shard", "left_anti")  # a row a split
    rows.write.mode("append").partitionBy("_shard").option("compression", "zstd").parquet(out)
    return spark.read.parquet(out)
