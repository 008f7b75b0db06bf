"""Every query with SQL gives what DuckDB gives."""

import os

import duckdb
import pandas as pd
import pytest

from tests.conftest import DATA
from tidemark import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(df):
    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or x != x:
            return None
        if isinstance(x, float):
            return round(x, 5) + 0.0
        return str(x)[:19].replace(" 00:00:00", "") if hasattr(x, "year") else x

    df = df[sorted(df.columns)]
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_matches_sql(spark, duck, folder, name):
    got, want = plans.QUERIES[name](spark, folder).toPandas(), duck.execute(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["stream_tumbling", "stream_dedup", "louvain", "placebo_p2", "pagerank", "cov_poet", "weights_hierarchical"])
def test_kernels_run(spark, folder, name):
    assert plans.QUERIES[name](spark, folder).count() > 0


def test_stream_equals_batch(spark, folder):
    from pyspark.sql import functions as F

    got = plans.QUERIES["stream_tumbling"](spark, folder).toPandas()
    e = spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n").toPandas()
    merged = got.merge(want, on=["start", "event_type"], suffixes=("", "_batch"))
    assert len(merged) == len(got) and (merged.n == merged.n_batch).all()  # the last windows are still open
