"""Queries whose numbers come from numpy kernels inside grouped maps, and streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from .. import backtest as BT
from ..kernels import covariance as C, network as N, portfolio as P, resampling as S
from ..operators import graph as G, market as M
from ..sources.scratch import materialise
from ..sources.tables import Catalog, graph_events, load, prices
from ..streaming import windows as ST
from .market_queries import _returns

catalog = Catalog()


def _indexed(spark, d):
    """Returns on the calendar, a hundredth of the proxy's, with their session numbers."""
    cal = M.trading_calendar(prices(spark, d))
    r = _returns(spark, d).withColumn("ret", F.col("ret") / 100).join(F.broadcast(cal.select("date", "cal_i")), "date")  # a row a session
    return cal, r


def _by_date(spark, d, f, schema, every="year", days=400):
    cal, r = _indexed(spark, d)
    at = F.broadcast(BT.dates_of(cal, every).withColumnRenamed("cal_i", "t0"))  # a row a date
    window = r.join(at, (F.col("cal_i") >= F.col("t0") - days) & (F.col("cal_i") < F.col("t0")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot_table(index="cal_i", columns="ticker", values="ret", aggfunc="first").sort_index(axis=1)
        return pd.DataFrame(f(x.to_numpy(), list(x.columns), pdf["rebalance_date"].iloc[0]))

    return window.groupBy("rebalance_date").applyInPandas(one, schema)


def _estimator_query(name):
    def query(spark, d):
        def f(x, tickers, date):
            s = C.make(name)(x)
            i, j = np.triu_indices(len(s))
            return {"rebalance_date": date, "i": [tickers[k] for k in i], "j": [tickers[k] for k in j], "cov": s[i, j]}

        return _by_date(spark, d, f, "rebalance_date date, i string, j string, cov double")

    query.__name__ = f"cov_{name}"
    catalog.add()(query)


for _name in C.ESTIMATORS:
    _estimator_query(_name)


def _model_query(name):
    def query(spark, d):
        def f(x, tickers, date):
            s = C.make("single_factor")(x)
            mu = P.shrunk_mean(np.nan_to_num(x), s) if name in ("mean_variance", "max_sharpe") else None
            return {"rebalance_date": date, "ticker": tickers, "weight": P.MODELS[name](s, mu, high=0.3)}

        return _by_date(spark, d, f, "rebalance_date date, ticker string, weight double")

    query.__name__ = f"weights_{name}"
    catalog.add()(query)


for _name in P.MODELS:
    _model_query(_name)


@catalog.add()
def gmv(spark, d):
    return _by_date(spark, d, lambda x, t, date: {"rebalance_date": date, "ticker": t, "weight": P.min_variance_free(C.const_corr(x))}, "rebalance_date date, ticker string, weight double")


@catalog.add()
def condition_numbers(spark, d):
    def f(x, t, date):
        names = sorted(C.ESTIMATORS)
        return {"rebalance_date": date, "estimator": names, "condition": [C.condition(C.make(n)(x)) for n in names]}

    return _by_date(spark, d, f, "rebalance_date date, estimator string, condition double")


@catalog.add()
def backtest_min_variance(spark, d):
    cal, r = _indexed(spark, d)
    at = BT.dates_of(cal, "quarter")
    w = materialise(BT.target_weights(r, at, BT.shipped("min_variance", "const_corr"), days=250, coverage=0.2, high=0.25), "weights")
    return BT.hold(r, w, at)[0]


@catalog.add()
def backtest_trades(spark, d):
    cal, r = _indexed(spark, d)
    at = BT.dates_of(cal, "quarter")
    w = materialise(BT.target_weights(r, at, BT.shipped("risk_parity"), days=250, coverage=0.2), "weights")
    return BT.hold(r, w, at)[1]


#: links that one task takes
MAX_LINKS = 20_000_000
#: nodes whose part of a kernel over all pairs is worked out at once
BLOCK_NODES = 64


def _matrix(spark, d):
    """The undirected snapshot in one grouped map. A graph past ``MAX_LINKS`` is refused, not cut."""
    edges = materialise(G.snapshot(graph_events(spark, d), "2000-01-01", 365, directed=False), "edges")
    if edges.count() > MAX_LINKS:
        raise ValueError(f"more than {MAX_LINKS} links; filter the snapshot by class, sector or weight")
    return edges.select(F.lit(0).alias("g"), "src", "dst", F.col("n_events").cast("double").alias("w"), "w_sum")


def _numbered(pdf):
    nodes = sorted({*pdf["src"], *pdf["dst"]})
    at = {n: k for k, n in enumerate(nodes)}
    return nodes, pdf["src"].map(at).to_numpy(), pdf["dst"].map(at).to_numpy()


@catalog.add()
def louvain(spark, d):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, i, j = _numbered(pdf)
        return pd.DataFrame({"node": nodes, "community": N.communities(i, j, pdf["w"].to_numpy(), len(nodes), 3)})

    return _matrix(spark, d).groupBy("g").applyInPandas(one, "node string, community long")


@catalog.add()
def placebo_p2(spark, d):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = sorted(set(pdf["src"])), sorted(set(pdf["dst"]))
        m = np.zeros((len(rows), len(cols)), int)
        m[pdf["src"].map({n: k for k, n in enumerate(rows)}), pdf["dst"].map({n: k for k, n in enumerate(cols)})] = 1
        i, j = np.nonzero(N.curveball(m, 5 * len(rows), 11))
        return pd.DataFrame({"src": [rows[k] for k in i], "dst": [cols[k] for k in j]})

    return _matrix(spark, d).groupBy("g").applyInPandas(one, "src string, dst string")


@catalog.add()
def placebo_p4(spark, d):
    """Signs are drawn a link, so the graph has no bound. Sums are rounded, so that the order of the events can't tell which are 0."""
    edges = G.snapshot(graph_events(spark, d), "2000-01-01", 365, directed=False)
    return G.random_signs(edges.withColumn("w_sum", F.round("w_sum", 9)), "w_sum", 5)


@catalog.add()
def diffusion_kernel(spark, d):
    """Every pair of nodes i < j; the kernel is worked out by blocks of nodes, dealt over tasks."""
    links = _matrix(spark, d).filter("src <> dst").select("src", "dst", "w_sum").toArrow()  # at most ``MAX_LINKS`` rows, checked above
    nodes = sorted({*links["src"].unique().to_pylist(), *links["dst"].unique().to_pylist()})
    i, j = (pc.index_in(links[c], pa.array(nodes, pa.string())).to_numpy() for c in ("src", "dst"))
    kernel, n = N.Diffusion(i, j, links["w_sum"].to_numpy(), len(nodes)), len(nodes)
    blocks = -(-n // BLOCK_NODES)
    tasks = max(1, min(blocks, 1_000))
    held = spark.sparkContext.broadcast((kernel, nodes))

    def diagonal(batches):
        kernel, _ = held.value
        for b in batches:
            lo = np.concatenate([np.arange(k * BLOCK_NODES, min((k + 1) * BLOCK_NODES, kernel.nodes)) for k in b.column(0).to_pylist()] or [np.zeros(0, int)])
            own = [kernel.diagonal(k * BLOCK_NODES, min((k + 1) * BLOCK_NODES, kernel.nodes)) for k in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(np.concatenate(own or [np.zeros(0)]))], ["node", "own"])

    got = spark.range(blocks, numPartitions=tasks).mapInArrow(diagonal, "node long, own double").toArrow()  # a number a node
    root = np.empty(n)
    root[got["node"].to_numpy()] = np.sqrt(got["own"].to_numpy())
    roots = spark.sparkContext.broadcast(root)

    def pairs(batches):
        (kernel, nodes), root = held.value, roots.value
        names = pa.array(nodes, pa.string())
        for b in batches:
            for turn in b.column(0).to_pylist():
                k = turn // 2 if turn % 2 == 0 else blocks - 1 - turn // 2  # long rows and short ones by turns
                lo, hi = k * BLOCK_NODES, min((k + 1) * BLOCK_NODES, n)
                own = kernel.rows(lo, hi, lo)
                for a in range(lo, min(hi, n - 1)):
                    value = own[a - lo, a - lo + 1 :] / (root[a] * root[a + 1 :])
                    yield pa.RecordBatch.from_arrays([pa.repeat(names[a], n - a - 1), names[a + 1 :], pa.array(value)], ["i", "j", "k"])

    return spark.range(blocks, numPartitions=tasks).mapInArrow(pairs, "i string, j string, k double")


@catalog.add()
def block_bootstrap(spark, d):
    """Replicates are rows, seeded by their number, dealt over tasks."""
    daily = _returns(spark, d).groupBy("date").agg(F.avg("ret").alias("r")).orderBy("date")
    x = np.array([r[0] for r in daily.select("r").collect()])  # a number a trading day

    def draw(batches):
        for pdf in batches:
            out = []
            for rep in pdf["rep"]:
                own = x[S.stationary_index(len(x), 10, np.random.default_rng(int(rep)))]
                out.append((rep, own.mean(), own.std(ddof=1)))
            yield pd.DataFrame(out, columns=["rep", "mean", "sd"])

    return spark.range(200, numPartitions=8).toDF("rep").mapInPandas(draw, "rep long, mean double, sd double")


def _wide(spark, d):
    """Weekly returns of all tickers, a row a week that any has; a missing one is the week's mean."""
    pdf = _returns(spark, d).groupBy(F.date_trunc("week", "date").alias("week"), "ticker").agg(F.avg("ret").alias("r")).toPandas()
    x = pdf.pivot(index="week", columns="ticker", values="r").sort_index().sort_index(axis=1)  # weeks by tickers
    return x.apply(lambda row: row.fillna(row.mean()), axis=1)


@catalog.add()
def mcs(spark, d):
    x = _wide(spark, d)
    keep, p = S.confidence_set((x.to_numpy() - x.to_numpy().mean()) ** 2, 8, 500, 1)
    return spark.createDataFrame([(t, float(p[k]), k in keep) for k, t in enumerate(x.columns)], "name string, p double, kept boolean")


@catalog.add()
def spa(spark, d):
    x = _wide(spark, d).to_numpy()
    return spark.createDataFrame([(S.superior_ability(x - x[:, :1], 8, 500, 1),)], "p double")


@catalog.add()
def compare_variance_ratio(spark, d):
    x = _wide(spark, d)
    rows = [(t, *S.variance_ratio(x[t].to_numpy(), x.iloc[:, 0].to_numpy(), 8, 300, 2)) for t in x.columns[1:]]
    return spark.createDataFrame(rows, "name string, ratio double, p double")


@catalog.add()
def qap(spark, d):
    """Correlation of two pair matrices under permutations of the nodes: a row a permutation, dealt over tasks.

    Only linked pairs are walked; the sums over all pairs follow from theirs.
    """
    pdf = _matrix(spark, d).toPandas()  # at most ``MAX_LINKS`` rows, checked above
    nodes, i, j = _numbered(pdf)
    held = spark.sparkContext.broadcast((len(nodes), i, j, pdf["w"].to_numpy(), pdf["w_sum"].to_numpy()))

    def draw(batches):
        n, i, j, a, b = held.value
        pairs = n * (n - 1) / 2
        key = np.minimum(i, j) * n + np.maximum(i, j)
        order = np.argsort(key)
        key, b = key[order], b[order]
        for part in batches:
            out = []
            for rep in part["rep"]:
                o = np.random.default_rng(int(rep)).permutation(n) if rep else np.arange(n)
                back = np.argsort(o)
                own = np.minimum(back[i], back[j]) * n + np.maximum(back[i], back[j])
                at = np.minimum(np.searchsorted(key, own), len(key) - 1)
                product = (a * np.where(key[at] == own, b[at], 0)).sum()
                cov = product / pairs - a.sum() * b.sum() / pairs**2
                spread = ((a**2).sum() / pairs - (a.sum() / pairs) ** 2) * ((b**2).sum() / pairs - (b.sum() / pairs) ** 2)
                out.append((rep, cov / np.sqrt(spread)))
            yield pd.DataFrame(out, columns=["rep", "corr"])

    return spark.range(100, numPartitions=8).toDF("rep").mapInPandas(draw, "rep long, corr double")


def _stream(spark, d, f):
    import uuid

    from ..sources import scratch

    schema = load(spark, d, "events").schema
    folder = scratch.folder(spark) + f"/tidemark/stream-{uuid.uuid4().hex}"
    return ST.drain(f(ST.event_stream(spark, f"{d}/events.parquet*", schema)), folder + "/out", folder + "/checkpoint")


@catalog.add()
def stream_tumbling(spark, d):
    return _stream(spark, d, lambda s: ST.tumbling(s, "1 day", "1 hour", "event_type"))


@catalog.add()
def stream_sliding(spark, d):
    return _stream(spark, d, lambda s: ST.sliding(s, "2 days", "1 day", "1 hour", "event_type"))


@catalog.add()
def stream_session(spark, d):
    return _stream(spark, d, lambda s: ST.sessions(s, "6 hours", "1 hour", "user_id"))


@catalog.add()
def stream_dedup(spark, d):
    return _stream(spark, d, lambda s: ST.first_seen(s, "event_id", "1 hour").select("event_id", "ts", "user_id"))
