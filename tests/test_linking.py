"""Aliases, event build, names, split CSV, and the numbering of rows."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import names as N
from tidemark.operators import linking as L, relational as R
from tidemark.sources import shards


def test_alias_chains_and_circles():
    assert L.closed({"a": "b", "b": "c", "x": "y", "y": "z", "z": "x", "s": "s"}) == {"a": "c", "b": "c", "x": "x", "y": "x", "z": "x", "s": "s"}


def test_resolve(spark):
    df = spark.createDataFrame([("a", 1), ("q", 2), (None, 3)], "name string, v int")
    aliases = spark.createDataFrame([("a", "b"), ("b", "c")], "from string, to string")
    assert sorted(map(tuple, L.resolve(df, "name", aliases).collect()), key=repr) == sorted([("c", 1), ("q", 2), (None, 3)], key=repr)


def test_merged_ends_are_noise_of_their_own(spark):
    tuples = spark.createDataFrame([("A", "B", "sues", 1), ("A", "C", "sues", 2), ("A", "A", "buys", 3), ("A", "D", "buys", 4)], "a string, b string, rt string, n int")
    names = spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "c")], "name string, key string")
    nodes = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "Y")], "key string, node string")
    classes = spark.createDataFrame([("sues", "legal")], "rt string, rel_class string")
    got = {r.n: (r.src, r.dst, r.rel_class, r.noise) for r in L.build_events(tuples, names, nodes, classes, F.when(F.col("a") == F.col("b"), "self_loop")).collect()}
    assert got == {1: ("X", "X", "legal", "merged"), 2: ("X", "Y", "legal", None), 3: ("X", "X", "other", "self_loop"), 4: ("X", None, "other", None)}


@pytest.mark.parametrize("a,b,ok", [("crude oil", "oil prices", True), ("fed", "Federal Reserve", True), ("eia", "U.S. Energy Information Administration", True), ("mexico central bank", "Federal Reserve", False), ("x", "", True)])
def test_compatible(spark, a, b, ok):
    assert spark.range(1).select(N.compatible(F.lit(a), F.lit(b))).first()[0] is ok


@pytest.mark.parametrize("a,b,ok", [("TSMC", "Taiwan Semiconductor Manufacturing Company", True), ("Goldman", "The Goldman Sachs Group", True), ("quidel", "QuidelOrtho Corp", True), ("Walmart", "Walmart Stores", True), ("Bank of X", "Bank of Y", False)])
def test_same_listing(spark, a, b, ok):
    assert spark.range(1).select(N.same_listing(F.lit(a), F.lit(b))).first()[0] is ok


def test_not_in_with_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    some, nulls, none = (spark.createDataFrame(x, "k int") for x in ([(1,)], [(1,), (None,)], []))
    rows = lambda df: sorted((r.k for r in df.collect()), key=repr)
    assert rows(R.not_in(left, some, "k")) == [2] and rows(R.not_in(left, nulls, "k")) == [] and rows(R.not_in(left, none, "k")) == [1, 2, None]


def test_total_order_and_ntile(spark):
    values = random.Random(1).sample(range(1000), 103)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(5)
    assert {r.v: r.n for r in R.total_order(df, ["v"], "n").collect()} == {v: k + 1 for k, v in enumerate(sorted(values))}
    tiles = [r.q for r in R.with_ntile(df, ["v"], 4, "q").orderBy("v").collect()]
    assert tiles == [1] * 26 + [2] * 26 + [3] * 26 + [4] * 25
    assert R.total_order(df.limit(0), ["v"], "n").count() == 0


def test_split_csv_at_every_size(spark, tmp_path):
    schema = shards.T.StructType([shards.T.StructField(c, shards.T.StringType()) for c in ("row", "published", "body")])
    rng = random.Random(2)
    rows = [(f"{i}.0" if i % 3 else None, f"2020-01-{i % 28 + 1:02d} 10:00:00 UTC", "".join(rng.choice('ab ,"\né') for _ in range(rng.choice([0, 3, 40])))) for i in range(12)]
    with open(tmp_path / "news.csv", "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator="\n").writerows([("row", "published", "body"), *[(a or "", b, c) for a, b, c in rows]])
    size = (tmp_path / "news.csv").stat().st_size
    want = sorted(((a, b, c or None) for a, b, c in rows), key=repr)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for split in (*range(1, size, 23), size - 1, size, 10 * size):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(split, size // 40)))
            got = shards.read_news_split(spark, str(tmp_path / "news.csv"), schema)
            assert sorted((tuple(r)[:3] for r in got.collect()), key=repr) == want
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 4))
        out = shards.ingest(spark, str(tmp_path / "news.csv"), str(tmp_path / "out"), schema)
        parts = {r[0] for r in out.select("_shard").distinct().collect()}
        assert out.count() == len(rows) and len(parts) > 1
        (tmp_path / "out" / f"_shard={sorted(parts)[0]}").rename(tmp_path / "lost")
        assert shards.ingest(spark, str(tmp_path / "news.csv"), str(tmp_path / "out"), schema).count() == len(rows)
        assert shards.ingest(spark, str(tmp_path / "news.csv"), str(tmp_path / "out"), schema).count() == len(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_masks_and_bytes(spark):
    text = F.lit("The Apple Inc and apple met on 2020-01-02; pineapple did not.")
    assert spark.range(1).select(N.masked(text, {"apple": "[A]", "The Apple Inc": "[B]"})).first()[0] == "[B] and [A] met on [DATE]; pineapple did not."
    assert [r[0] for r in spark.createDataFrame([(0,), (1536,), (5 << 30,)], "n long").select(N.readable_bytes(F.col("n"))).collect()] == ["0.0 B", "1.5 KiB", "5.0 GiB"]


def test_readable_bytes_past_a_gibibyte(spark, tmp_path):
    """The query's SQL knows no unit above MiB."""
    import duckdb

    from tidemark import plans

    keys = [(1, 1), (32, 32), (1 << 14, 1 << 16), (1_200_000, 60_000), ((1 << 20) - 1, 1 << 10)]
    spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(keys)], "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.l_orderkey: r["size"] for r in plans.QUERIES["readable_bytes"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == {k: size for k, _, size in con.execute(plans.SQL["readable_bytes"]).fetchall()}
    assert got[2] == "1024.0 MiB"
