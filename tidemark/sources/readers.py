"""Sources and sinks: news files, listings, aliases, price archives, compositions, logs."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.text import security_name

NEWS = T.StructType([T.StructField(c, T.StringType()) for c in ("row", "published", "title", "symbol", "url", "publisher", "author", "body", "lsa", "luhn", "textrank", "lexrank")])


def read_news(spark: SparkSession, path: str, strict: bool = True, schema: T.StructType = NEWS) -> DataFrame:
    """CSV with quoted line breaks, all columns as strings; a bad row fails or is null."""
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").csv(path).withColumn("_shard", F.col("_metadata.file_name"))


def read_new_shards(spark: SparkSession, path: str, loaded: DataFrame, **more) -> DataFrame:
    """Rows of the files that ``loaded`` (with a _shard column) has none of."""
    return read_news(spark, path, **more).join(F.broadcast(loaded.select("_shard").distinct()), "_shard", "left_anti")  # a row a file


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files whose columns may differ; missing ones are null. Adds _file."""
    return spark.read.option("mergeSchema", True).parquet(*paths).withColumn("_file", F.col("_metadata.file_path"))


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, codec: str = "zstd") -> None:
    """Replace a dataset; a failed job leaves no half of it."""
    writer = df.write.mode("overwrite").option("compression", codec)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def read_listing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(ticker, name, is_etf) of pipe-delimited listings by header; footers and repeats are left out."""
    out = None
    for k, path in enumerate(paths):
        raw = spark.read.option("sep", "|").option("header", True).csv(path)
        symbol = "Symbol" if "Symbol" in raw.columns else "ACT Symbol"
        own = raw.filter(F.col("Security Name").isNotNull()).select(F.replace(F.col(symbol), F.lit("."), F.lit("-")).alias("ticker"), security_name(F.col("Security Name")).alias("name"), (F.col("ETF") == "Y").alias("is_etf"), F.lit(k).alias("k"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("ticker").agg(F.min_by(F.struct("name", "is_etf"), F.struct("k", "name")).alias("v")).select("ticker", "v.*")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(from, to, is_key) of an alias file with # comments; key: marks a name's key."""
    raw = spark.read.option("comment", "#").option("header", True).csv(path)
    key = F.startswith("from", F.lit("key:"))
    return raw.select(F.when(key, F.substring("from", 5, 1000)).otherwise(F.col("from")).alias("from"), "to", key.alias("is_key"))


PRICE = "ticker string, date date, open double, high double, low double, close double, adj_close double, volume double"


def read_price_archive(spark: SparkSession, path: str, start: str = "1900-01-01") -> DataFrame:
    """Prices of ZIP archives of a CSV a ticker, columns by header; the ticker is the member's name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                with zipfile.ZipFile(io.BytesIO(raw.as_py())) as z:
                    for member in z.namelist():
                        if member.lower().endswith(".csv"):
                            df = pd.read_csv(z.open(member))
                            df.columns = [c.strip().lower().replace(" ", "_") for c in df.columns]
                            df["date"] = pd.to_datetime(df["date"], errors="coerce").dt.date
                            df = df[df["date"] >= pd.Timestamp(start).date()]
                            df["ticker"] = member.rsplit("/", 1)[-1][:-4].upper()
                            cols = [pa.array(df["ticker"], pa.string()), pa.array(df["date"], pa.date32())]
                            cols += [pa.array(pd.to_numeric(df[c], errors="coerce"), pa.float64(), from_pandas=True) for c in ("open", "high", "low", "close", "adj_close", "volume")]
                            yield pa.RecordBatch.from_arrays(cols, ["ticker", "date", "open", "high", "low", "close", "adj_close", "volume"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, PRICE)


def read_composition(spark: SparkSession, path: str) -> DataFrame:
    """(date, ticker) of an index file: a date and a comma list a row; AAL-199702 is AAL, BRK.B is BRK-B."""
    raw = spark.read.option("header", True).option("quote", '"').csv(path).toDF("date", "tickers")
    t = F.explode(F.split("tickers", ","))
    out = raw.select(F.to_date("date").alias("date"), t.alias("t"))
    return out.select("date", F.replace(F.regexp_replace(F.trim("t"), r"-\d{6}$", ""), F.lit("."), F.lit("-")).alias("ticker")).filter("ticker <> ''").distinct()


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a half-written line is left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
