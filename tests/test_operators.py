"""Golden cases of operators, the backtest against a day-by-day simulation, readers."""

import datetime as dt
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import backtest as BT
from tidemark.functions import text as T
from tidemark.operators import graph as G, market as M, matrices as MX, relational as R
from tidemark.sources import readers

EVENTS = [("A", "B", "2020-01-01", 1, "impact", 0.5, 1), ("A", "B", "2020-01-31", 2, "impact", 1.0, -1), ("B", "A", "2020-02-10", 3, "ma", 0.2, 0), ("A", "C", "2020-03-01", 3, "ma", 0.8, 1)]


@pytest.fixture(scope="module")
def events(spark):
    df = spark.createDataFrame(EVENTS, "src string, dst string, d string, doc_id long, rel_class string, strength double, sign int")
    return df.withColumns({"dt": F.to_date("d"), "src_kind": F.lit("x"), "dst_kind": F.lit("x")}).drop("d")


def test_snapshot_is_strict_and_decays(events):
    got = {(r.src, r.dst): r for r in G.snapshot(events, "2020-01-31", 90, 30).collect()}
    assert set(got) == {("A", "B")} and got["A", "B"].w_decay == pytest.approx(0.25)
    both = {(r.src, r.dst): r.n_events for r in G.snapshot(events, "2020-03-01", None, directed=False).collect()}
    assert both == {("A", "B"): 3}
    assert G.snapshot(events, "2021-01-01", 30).count() == 0


def test_later_events_change_nothing(events):
    late = events.withColumn("dt", F.lit("2020-02-01").cast("date"))
    assert G.snapshot(events.filter("dt < '2020-02-01'").unionByName(late), "2020-02-01").count() == G.snapshot(events.filter("dt < '2020-02-01'"), "2020-02-01").count()


def test_series_equals_single_snapshots(events):
    series = G.snapshots(events, "2020-01-01", "2020-03-11", half_life=20, window_days=60)
    for day in ("2020-01-08", "2020-02-19", "2020-03-11"):
        one = sorted(map(tuple, G.snapshot(events, day, 60, 20).collect()))
        own = sorted(map(tuple, series.filter(F.col("asof") == F.lit(day).cast("date")).drop("asof").collect()))
        assert one == own


def test_asof(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, "b", 9)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 3, "x"), ("a", 5, "y")], "k string, u int, v string")
    strict = {r.id: r.v for r in R.asof_join(left, right, "k", "t", "u", ["v"]).collect()}
    loose = {r.id: r.v for r in R.asof_join(left, right, "k", "t", "u", ["v"], strict=False).collect()}
    assert strict == {1: "x", 2: None, 3: None} and loose == {1: "y", 2: "x", 3: None}


def test_names(spark):
    raw = ["The Apple Inc.", "Apple's", "apple, inc", "AT&T Corp (NYSE: T)", "The", "Inc", None, "U.S. Steel Holdings Group"]
    df = spark.createDataFrame([(x,) for x in raw], "x string")
    assert [r[0] for r in df.select(T.name_key(F.col("x"))).collect()] == ["apple", "apple", "apple", "at and t", "", "inc", "", "us steel"]
    t = spark.createDataFrame([("Brk (NYSE: BRK.B) and NASDAQ: AAPL",)], "x string").select(T.explicit_tickers(F.col("x"))).first()[0]
    assert t == ["BRK-B", "BRK-B", "AAPL"] or t == ["BRK-B", "AAPL", "BRK-B"] or set(t) == {"BRK-B", "AAPL"}
    assert T.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)


def test_price_flags(spark):
    days = [d.date() for d in pd.bdate_range("2021-01-04", periods=60)]
    rows = [(t, d, 10.0 + 0.01 * k) for t in "ABC" for k, d in enumerate(days)]
    rows = [(t, d, 60.0 if (t, k % 60) == ("A", 20) else p) for k, (t, d, p) in enumerate(rows) if not (t == "B" and k % 60 == 30)]
    px = spark.createDataFrame([(t, d, p, p, 5.0) for t, d, p in rows], "ticker string, date date, close double, adj_close double, volume double")
    cal = M.trading_calendar(px)
    flags = {(r.ticker, r.date): r.flag for r in M.flagged_returns(px, cal).filter("flag IS NOT NULL").collect()}
    assert flags["A", days[20]] == "spike" and flags["A", days[21]] == "spike_revert" and flags["B", days[31]] == "gap" and flags["C", days[0]] == "first"


def test_backtest_equals_simulation(spark):
    rng = np.random.default_rng(1)
    days = [d.date() for d in pd.bdate_range("2021-01-04", periods=130)]
    frame = pd.DataFrame([(t, d, k + 1, float(rng.normal(0, 0.02))) for t in "ABCD" for k, d in enumerate(days)], columns=["ticker", "date", "cal_i", "ret"])
    returns = spark.createDataFrame(frame, "ticker string, date date, cal_i int, ret double")
    cal = returns.select("date", "cal_i").distinct()
    at = BT.dates_of(cal, "month")
    w = BT.target_weights(returns, at, BT.shipped("min_variance", "const_corr"), days=40, coverage=0.9, high=0.6).cache()
    daily, trades = BT.hold(returns, w, at, cost=0.002)
    got = {r.date: r.net for r in daily.collect()}
    weights = {d: dict(zip(g.ticker, g.weight)) for d, g in w.toPandas().groupby("rebalance_date")}
    want = BT.simulate(frame, weights, 0.002)
    assert len(got) == len(want) and all(abs(got[d] - want[d]) < 1e-12 for d in want.index)
    assert BT.load_model("tidemark.kernels.portfolio:equal_weight")


def test_readers(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("full/aapl.csv", "date,open,high,low,close,adj close,volume\n2020-01-02,1,2,0,1.5,1.4,10\n2019-01-02,1,1,1,1,1,1\n")
        z.writestr("full/ibm.csv", "Volume,Date,Close,Adj Close,Open,High,Low\n7,2020-01-03,3,3,3,3,3\n")
    got = readers.read_price_archive(spark, str(tmp_path / "p.zip"), "2020-01-01").orderBy("ticker").collect()
    assert [(r.ticker, r.date, r.close, r.volume) for r in got] == [("AAPL", dt.date(2020, 1, 2), 1.5, 10.0), ("IBM", dt.date(2020, 1, 3), 3.0, 7.0)]
    (tmp_path / "list.txt").write_text("Symbol|Security Name|ETF\nBRK.B|Berkshire - Common Stock|N\nSPY|SPDR Trust|Y\nFile Creation Time: 1||\n")
    assert {r.ticker: r.is_etf for r in readers.read_listing(spark, [str(tmp_path / "list.txt")]).collect() if r.name} == {"BRK-B": False, "SPY": True}
    (tmp_path / "c.csv").write_text('date,tickers\n2020-01-01,"AAL-199702,BRK.B"\n')
    assert {r.ticker for r in readers.read_composition(spark, str(tmp_path / "c.csv")).collect()} == {"AAL", "BRK-B"}
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a":')
    assert readers.read_log(spark, str(tmp_path / "l.jsonl"), "a int").filter("a is not null").count() == 2
    (tmp_path / "n.csv").write_text('row,published,title\n1,2020-01-01,"two\nlines"\n')
    assert readers.read_news(spark, str(tmp_path / "n.csv"), schema=readers.T.StructType(readers.NEWS.fields[:3])).first().title == "two\nlines"


@pytest.mark.parametrize("local, tolerance", [(True, 1e-12), (False, 1e-3)])
def test_pagerank_converges(spark, monkeypatch, local, tolerance):
    monkeypatch.setattr(MX, "LOCAL_EDGES", 10**6 if local else 0)
    both = [(f"s{i}", f"b{i % 3}", 1.0 + i % 4) for i in range(30)]
    both += [(b, a, w) for a, b, w in both] + [("s0", "sink", 2.0)]
    nodes = sorted({x for e in both for x in e[:2]})
    n, p = len(nodes), np.zeros((len(nodes), len(nodes)))
    for a, b, w in both:
        p[nodes.index(a), nodes.index(b)] += w
    total = p.sum(axis=1, keepdims=True)
    p = np.where(total > 0, p / np.where(total > 0, total, 1), 1 / n)
    want = np.linalg.solve(np.eye(n) - 0.85 * p.T, np.full(n, 0.15 / n))
    more = {} if local else {"tolerance": tolerance}
    got = {r["node"]: r["rank"] for r in MX.pagerank(spark.createDataFrame(both, "src string, dst string, w double"), **more).collect()}
    # what is left after the last step is at most 0.85 / 0.15 times as large
    assert sorted(got) == nodes and np.abs(np.array([got[x] for x in nodes]) - want).max() <= 6 * tolerance


def test_random_signs_of_many_nodes(spark, folder, monkeypatch):
    from tidemark.plans import QUERIES, kernel_queries
    from tidemark.sources.tables import graph_events

    monkeypatch.setattr(kernel_queries, "MAX_NODES", 10, raising=False)  # the bound that a dense matrix had
    monkeypatch.setattr(kernel_queries, "MAX_LINKS", 10)
    got = {(r.i, r.j): r.w for r in QUERIES["placebo_p4"](spark, folder).collect()}
    edges = G.snapshot(graph_events(spark, folder), "2000-01-01", 365, directed=False).withColumn("w_sum", F.round("w_sum", 9))
    want = {tuple(sorted((r.src, r.dst))): abs(r.w_sum) for r in edges.collect() if r.w_sum and r.src != r.dst}
    assert {k: abs(w) for k, w in got.items()} == want
    assert 0.3 < sum(w < 0 for w in got.values()) / len(got) < 0.7
    back = G.random_signs(edges.repartition(3).withColumns({"src": F.col("dst"), "dst": F.col("src")}), "w_sum", 5)
    assert {(r.i, r.j): r.w for r in back.collect()} == got
    assert {(r.i, r.j): r.w for r in G.random_signs(edges, "w_sum", 6).collect()} != got


@pytest.mark.parametrize("block", [7, 64])
def test_diffusion_kernel_of_many_nodes(spark, folder, monkeypatch, block):
    from tidemark.kernels import network as N
    from tidemark.plans import QUERIES, kernel_queries
    from tidemark.sources.tables import graph_events

    monkeypatch.setattr(kernel_queries, "MAX_NODES", 10, raising=False)  # the bound that a dense matrix had
    monkeypatch.setattr(kernel_queries, "BLOCK_NODES", block, raising=False)
    got = {(r.i, r.j): r.k for r in QUERIES["diffusion_kernel"](spark, folder).collect()}
    edges = G.snapshot(graph_events(spark, folder), "2000-01-01", 365, directed=False).collect()
    nodes = sorted({r.src for r in edges} | {r.dst for r in edges})
    w = np.zeros((len(nodes),) * 2)
    for r in edges:
        w[nodes.index(r.src), nodes.index(r.dst)] = w[nodes.index(r.dst), nodes.index(r.src)] = r.w_sum
    want = N.diffusion(w / np.abs(w).sum(axis=1).max())
    assert set(got) == {(a, b) for k, a in enumerate(nodes) for b in nodes[k + 1 :]}
    assert all(abs(k - want[nodes.index(a), nodes.index(b)]) < 1e-12 for (a, b), k in got.items())
