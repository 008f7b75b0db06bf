"""Queries over panels of pairs, runs, sentiment factors and walk-forward studies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W, functions as F

from .. import walkforward as WF
from ..kernels import covariance as C
from ..operators import market as M, matrices as MX, panels as P
from ..sources.scratch import materialise
from ..sources.tables import Catalog, graph_events, load, mentions, prices, sql
from .graph_queries import ASOF
from .kernel_queries import _indexed
from .market_queries import _CAL, _MKT, _RET, _SMALL, _r, _returns, _small

catalog = Catalog()

# --- pairs --------------------------------------------------------------------------------------

#: the proxy's part types in the place of relation classes
_GROUPS = {"chain": ("ECONOMY", "PROMO"), "rivalry": ("SMALL",), "control": ("STANDARD",), "impact": ("MEDIUM",)}
_CASE = "CASE " + " ".join(f"WHEN rel_class IN ({', '.join(repr(c) for c in cs)}) THEN 'direct_{g}'" for g, cs in _GROUPS.items()) + " ELSE 'direct_other_rel' END"
_PAIR_CTES = dict(
    mem="SELECT 'S' || s_suppkey AS node FROM supplier WHERE s_suppkey % 4 = 0 UNION SELECT 'P' || p_brand FROM part",
    listed="SELECT 'S' || s_suppkey AS node FROM supplier WHERE s_suppkey % 2 = 0 UNION SELECT 'P' || p_brand FROM part",
    sec="SELECT 'S' || s_suppkey AS node, s_nationkey AS industry, s_nationkey % 5 AS sector FROM supplier",
    seen=f"SELECT *, strength * pow(0.5, (DATE '{ASOF}' - dt) / 90.0) AS w FROM ge WHERE dt < DATE '{ASOF}' AND dt >= DATE '{ASOF}' - 365",
    ends="SELECT src AS node, dst AS other, doc_id, w FROM seen UNION ALL SELECT dst, src, doc_id, w FROM seen",
    df="SELECT other, count(DISTINCT node) AS df FROM ends WHERE node IN (SELECT node FROM listed) GROUP BY 1",
    x="""SELECT node, other, greatest(sum(w) * ln((SELECT count(DISTINCT node) FROM ends WHERE node IN (SELECT node FROM listed)) / any_value(df)), 0) AS x
 FROM ends JOIN df USING (other) WHERE node IN (SELECT node FROM mem) AND other NOT IN (SELECT node FROM mem) GROUP BY 1, 2""",
    unit="SELECT node, other, x / sqrt(sum(x * x) OVER (PARTITION BY node)) AS u FROM x WHERE x > 0",
    d="SELECT DISTINCT doc_id, node FROM ends WHERE node IN (SELECT node FROM mem)",
    m=f"SELECT DISTINCT doc_id, 'S' || symbol AS node FROM men WHERE dt < DATE '{ASOF}' AND dt >= DATE '{ASOF}' - 365 AND 'S' || symbol IN (SELECT node FROM mem)",
    s="SELECT * FROM sec WHERE node IN (SELECT node FROM mem)",
    f=f"""SELECT least(src, dst) AS i, greatest(src, dst) AS j, {_CASE} AS feature, sum(w) AS value FROM seen WHERE src <> dst AND src IN (SELECT node FROM mem) AND dst IN (SELECT node FROM mem) GROUP BY 1, 2, 3
 UNION ALL SELECT a.node, b.node, 'exposure', sum(a.u * b.u) FROM unit a JOIN unit b ON a.other = b.other AND a.node < b.node GROUP BY 1, 2
 UNION ALL SELECT a.node, b.node, 'cooccur', CAST(count(*) AS DOUBLE) FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.node < b.node GROUP BY 1, 2
 UNION ALL SELECT a.node, b.node, 'comention', CAST(count(*) AS DOUBLE) FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.node < b.node GROUP BY 1, 2
 UNION ALL SELECT a.node, b.node, 'same_industry', 1.0 FROM s a JOIN s b ON a.industry = b.industry AND a.node < b.node
 UNION ALL SELECT a.node, b.node, 'same_sector', 1.0 FROM s a JOIN s b ON a.sector = b.sector AND a.node < b.node""",
)


def _nodes(spark, d, every):
    """The suppliers whose number ``every`` divides, and all brands."""
    s = load(spark, d, "supplier").filter(F.col("s_suppkey") % every == 0).select(F.concat(F.lit("S"), "s_suppkey").alias("node"))
    return s.union(load(spark, d, "part").select(F.concat(F.lit("P"), "p_brand")).distinct())


@catalog.add(sql("ge men", "SELECT i, j, feature, round(value, 5) AS value FROM f", **_PAIR_CTES))
def pair_features(spark, d):
    sec = load(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("node"), F.col("s_nationkey").alias("industry"), (F.col("s_nationkey") % 5).alias("sector"))
    men = mentions(spark, d).withColumn("node", F.concat(F.lit("S"), "symbol"))
    return _r(P.pair_features(graph_events(spark, d), _nodes(spark, d, 4), _nodes(spark, d, 2), men, sec, ASOF, groups=_GROUPS), "value", n=5)


_ALIAS = "SELECT DISTINCT doc_id, 'N' || (symbol - symbol % 3) AS node FROM men WHERE dt < DATE '1999-06-30' AND dt >= DATE '1999-06-30' - 365"


@catalog.add(sql("men", "SELECT a.node AS i, b.node AS j, count(*) AS n FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.node <= b.node GROUP BY 1, 2", m=_ALIAS))
def comention(spark, d):
    """Documents that mention two nodes, each known by three symbols; with itself, the node's documents."""
    own = mentions(spark, d).filter((F.col("dt") < F.lit(ASOF).cast("date")) & (F.col("dt") >= F.date_sub(F.lit(ASOF).cast("date"), 365)))
    own = own.select("doc_id", F.concat(F.lit("N"), F.col("symbol") - F.col("symbol") % 3).alias("node"))
    totals = own.distinct().groupBy("node").agg(F.count("*").alias("n")).select(F.col("node").alias("i"), F.col("node").alias("j"), "n")
    return MX.cooccurrence(own, "doc_id", "node").unionByName(totals)


_SIDES = dict(
    starts="SELECT min(date) AS rebalance_date, min(cal_i) AS t0 FROM cal GROUP BY year(date)",
    p="SELECT rebalance_date, t0, coalesce(lead(t0) OVER (ORDER BY t0), (SELECT max(cal_i) + 1 FROM cal)) AS t1 FROM starts",
    rc="SELECT ticker, cal_i, ret FROM ret JOIN cal USING (date)",
    xy="SELECT a.ticker AS i, b.ticker AS j, a.cal_i, a.ret AS x, b.ret AS y FROM rc a JOIN rc b ON a.cal_i = b.cal_i AND a.ticker < b.ticker",
    before="SELECT rebalance_date, i, j, count(*) AS n, corr(x, y) AS c FROM p JOIN xy ON cal_i >= t0 - 500 AND cal_i < t0 GROUP BY 1, 2, 3",
    after="SELECT rebalance_date, i, j, count(*) AS n, corr(x, y) AS c FROM p JOIN xy ON cal_i >= t0 AND cal_i < t1 GROUP BY 1, 2, 3",
    raw="SELECT b.rebalance_date, b.i, b.j, atanh(b.c) AS z_before, atanh(a.c) AS z_after, a.n AS n_after FROM before b JOIN after a USING (rebalance_date, i, j) WHERE b.n >= 20 AND a.n >= 10 AND abs(b.c) < 1 AND abs(a.c) < 1",
    de="SELECT DISTINCT rebalance_date, doc_id, substr(dst, 2) AS node FROM ge JOIN p ON dt < rebalance_date AND dt >= rebalance_date - 365",
    co="SELECT a.rebalance_date, a.node AS i, b.node AS j, count(*) AS n FROM de a JOIN de b ON a.rebalance_date = b.rebalance_date AND a.doc_id = b.doc_id AND a.node < b.node GROUP BY 1, 2, 3",
    panel="SELECT raw.*, coalesce(ln(1 + co.n), 0) AS cooccur FROM raw LEFT JOIN co USING (rebalance_date, i, j)",
)


def _panel(spark, d):
    """Pairs of brands at each year's first session, with the orders that hold both in the year before."""
    cal, r = _indexed(spark, d)
    r = materialise(r.select("ticker", "cal_i", "ret"), "returns")  # read four times below
    at = materialise(WF.periods(cal, "year"), "dates")  # a row a year
    ev = graph_events(spark, d).select("dt", "doc_id", F.substring("dst", 2, 100).alias("node"))
    days = P.seen_by(ev, "dt", at.select("rebalance_date", F.date_sub("rebalance_date", 365).alias("low"), F.col("rebalance_date").alias("high")), "low", "high")
    held = ev.join(days.select("dt", "rebalance_date"), "dt").select(F.struct("rebalance_date", "doc_id").alias("doc"), "node").distinct()
    pairs = held.join(held.select("doc", F.col("node").alias("j")), "doc").filter("node < j")
    co = pairs.groupBy("doc.rebalance_date", F.col("node").alias("i"), "j").agg(F.count("*").cast("double").alias("value")).withColumn("feature", F.lit("cooccur"))
    return P.pair_panel(r, at, co, days=500, least_before=20, least_after=10, names=["cooccur"])


@catalog.add(sql("px ge", "SELECT rebalance_date, i, j, round(z_before, 5) AS z_before, round(z_after, 5) AS z_after, n_after, round(cooccur, 6) AS cooccur FROM panel", cal=_CAL, ret=_RET, **_SIDES))
def pair_panel(spark, d):
    return _r(_r(_panel(spark, d), "z_before", "z_after", n=5), "cooccur")


_OLS = "SELECT rebalance_date, count(*) * covar_pop(cooccur, z_after) AS c, count(*) * var_pop(cooccur) AS s, count(*) * var_pop(z_after) AS sst, count(*) AS n FROM panel GROUP BY 1"
_CUM = "SELECT *, sum(c) OVER w / (sum(s) OVER w + 1e-9) AS b, count(*) OVER w AS k FROM ols WINDOW w AS (ORDER BY rebalance_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@catalog.add(sql("px ge", "SELECT rebalance_date, n, CASE WHEN k >= 2 THEN round(b, 5) END AS coef, CASE WHEN k >= 2 THEN round(1 - (sst - 2 * b * c + b * b * s) / sst, 5) END AS r2 FROM cum", cal=_CAL, ret=_RET, **_SIDES, ols=_OLS, cum=_CUM))
def expanding_r2(spark, d):
    fits = P.expanding_fits(_panel(spark, d), "rebalance_date", "z_after", ["cooccur"], train=2)
    return _r(fits.select("rebalance_date", "n", F.col("coefs")[0].alias("coef"), F.try_divide(F.col("sst") - F.col("sse"), "sst").alias("r2")), "coef", "r2", n=5)


@catalog.add(sql("px ge", "SELECT p.rebalance_date, i, j, round(tanh(avg(z_before) OVER w + CASE WHEN k >= 2 THEN b ELSE 0 END * (cooccur - avg(cooccur) OVER w)), 5) AS r FROM panel p JOIN cum USING (rebalance_date) WINDOW w AS (PARTITION BY p.rebalance_date)", cal=_CAL, ret=_RET, **_SIDES, ols=_OLS, cum=_CUM))
def news_prior(spark, d):
    panel = materialise(_panel(spark, d), "panel")
    return _r(P.news_prior(panel, P.expanding_fits(panel, "rebalance_date", "z_after", ["cooccur"], train=2), "rebalance_date", "z_before", ["cooccur"]), "r", n=5)


# --- cross sections and runs --------------------------------------------------------------------

_XS = "SELECT CAST(date_trunc('month', r.date) AS DATE) AS m, ret, ln(volume) AS x1, ln(close) AS x2 FROM ret r JOIN px ON r.ticker = px.ticker AND r.date = px.date"
_FM = dict(ret=_RET, p=_XS,
           mo="SELECT m, count(*) AS n, corr(x1, x2) AS r, covar_pop(x1, ret) / stddev_pop(x1) AS c1, covar_pop(x2, ret) / stddev_pop(x2) AS c2, var_pop(ret) AS v FROM p GROUP BY 1 HAVING count(*) >= 10",
           b="SELECT m, (c1 - r * c2) / (1 - r * r) AS b1, (c2 - r * c1) / (1 - r * r) AS b2, c1, c2, v FROM mo",
           l="SELECT 'x1' AS name, m, b1 AS coef, (b1 * c1 + b2 * c2) / v AS r2 FROM b UNION ALL SELECT 'x2', m, b2, (b1 * c1 + b2 * c2) / v FROM b",
           e="SELECT *, coef - avg(coef) OVER (PARTITION BY name) AS d FROM l",
           t="SELECT name, coef, r2, d * d + " + " + ".join(f"{2 * (1 - h / 7)!r} * d * coalesce(lag(d, {h}) OVER w, 0)" for h in range(1, 7)) + " AS t FROM e WINDOW w AS (PARTITION BY name ORDER BY m)")


@catalog.add(sql("px", "SELECT name, count(*) AS n, round(avg(coef), 5) AS mean, round(avg(coef) / sqrt(sum(t) / count(*) / count(*)), 3) AS t, round(avg(r2), 5) AS r2 FROM t GROUP BY 1", **_FM))
def fama_macbeth_many(spark, d):
    px = prices(spark, d).select("ticker", "date", F.log("volume").alias("x1"), F.log("close").alias("x2"))
    panel = _returns(spark, d).join(px, ["ticker", "date"]).withColumn("m", F.to_date(F.date_trunc("month", "date")))
    return _r(_r(P.fama_macbeth_many(panel, "m", "ret", ["x1", "x2"], least=10), "mean", "r2", n=5), "t", n=3)


@catalog.add(sql("px", """SELECT ticker, count(*) AS n, round(corr(a, b), 6) AS spearman FROM (SELECT ticker, rank() OVER (PARTITION BY ticker ORDER BY volume) + (count(*) OVER (PARTITION BY ticker, volume) - 1) / 2.0 AS a,
 rank() OVER (PARTITION BY ticker ORDER BY close) + (count(*) OVER (PARTITION BY ticker, close) - 1) / 2.0 AS b FROM px2) GROUP BY 1""", px2="SELECT ticker, volume, round(close, 4) AS close FROM px"))
def rank_correlation(spark, d):
    return _r(P.rank_correlation(prices(spark, d).withColumn("close", F.round("close", 4)), "ticker", "volume", "close"), "spearman")


_MONTHLY = "SELECT ticker AS run, date_trunc('month', date) AS date, avg(ret) / 100 AS ret FROM ret GROUP BY 1, 2"


@catalog.add(sql("px", """SELECT a.run, count(*) AS n, round(var_samp(a.ret) / var_samp(b.ret), 5) AS var_ratio, round((avg(a.ret) / stddev_samp(a.ret) - avg(b.ret) / stddev_samp(b.ret)) * sqrt(12), 5) AS sharpe_diff,
 round(avg(a.ret - b.ret) * 12, 6) AS active_return, round(stddev_samp(a.ret - b.ret) * sqrt(12), 6) AS active_vol FROM c a JOIN c b ON a.date = b.date AND b.run = 'Brand#1' WHERE a.run <> 'Brand#1' GROUP BY 1""",
 ret=_RET, runs=_MONTHLY, c="SELECT * FROM runs WHERE date IN (SELECT date FROM runs GROUP BY 1 HAVING count(DISTINCT run) = (SELECT count(DISTINCT run) FROM runs))"))
def run_comparison(spark, d):
    runs = _returns(spark, d).groupBy(F.col("ticker").alias("run"), F.date_trunc("month", "date").alias("date")).agg((F.avg("ret") / 100).alias("ret"))
    return _r(_r(P.compare_runs(runs, "Brand#1", 12), "var_ratio", "sharpe_diff", n=5), "active_return", "active_vol")


_KEYS = [f"{f}|{s}" for f in "ANR" for s in "FO"]


@catalog.add("SELECT date, " + ", ".join(f"round(max(r) FILTER (WHERE key = '{k}'), 8) AS \"{k}\"" for k in _KEYS) + " FROM (SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag || '|' || l_linestatus AS key, (1 - 0.001 * avg(l_tax)) * (1 + avg(l_discount)) - 1 AS r FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def net_returns(spark, d):
    daily = load(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("est"), F.col("l_linestatus").alias("port")).agg(F.avg("l_tax").alias("turnover"), F.avg("l_discount").alias("gross"))
    return P.net_returns(daily, keys=_KEYS).select("date", *[F.round(F.col(f"`{k}`"), 8).alias(k) for k in _KEYS])


@catalog.add(sql("px", """SELECT ticker, date, CASE WHEN k = 63 THEN round(avg(ret) OVER w, 6) END AS mean, CASE WHEN k = 63 THEN round(quantile_cont(ret, 0.5) OVER w, 6) END AS median, CASE WHEN k = 63 THEN round(covar_samp(ret, market) OVER w, 6) END AS cov
 FROM (SELECT *, least(row_number() OVER (PARTITION BY ticker ORDER BY date), 63) AS k FROM ret JOIN mkt USING (date)) WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)""", ret=_RET, mkt=_MKT))
def rolling_stats(spark, d):
    """Mean, median and covariance with the market over 63 sessions; null until the window is full."""
    ret = _returns(spark, d)
    w = W.partitionBy("ticker").orderBy("date").rowsBetween(-62, 0)
    full = lambda c: F.when(F.count("*").over(w) == 63, F.round(c.over(w), 6))
    return ret.join(M.market_factor(ret), "date").select("ticker", "date", full(F.avg("ret")).alias("mean"), full(F.percentile("ret", F.lit(0.5))).alias("median"), full(F.covar_samp("ret", "market")).alias("cov"))


@catalog.add(sql("px", "SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS m, max(date) AS last, round(exp(sum(ln(1 + ret))) - 1, 6) AS ret FROM small GROUP BY 1, 2", ret=_RET, small=_SMALL))
def resample_month_product(spark, d):
    own = _small(spark, d).groupBy("ticker", F.to_date(F.date_trunc("month", "date")).alias("m"))
    return own.agg(F.max("date").alias("last"), F.round(F.exp(F.sum(F.log1p("ret"))) - 1, 6).alias("ret"))


@catalog.add(sql("ge", "SELECT a.label AS src_label, b.label AS dst_label, rel_class, count(*) AS n FROM ge JOIN nd a ON src = a.node JOIN nd b ON dst = b.node WHERE a.kind <> b.kind GROUP BY 1, 2, 3",
 nd="SELECT 'S' || s_suppkey AS node, 'k' || (s_nationkey % 3) AS kind, 'n' || s_nationkey AS label FROM supplier UNION ALL SELECT DISTINCT 'P' || p_brand, 'k' || (length(p_brand) % 3), p_brand FROM part"))
def edges_both_roles(spark, d):
    """Events with the node table joined twice, as source and as target."""
    s = load(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("node"), F.concat(F.lit("k"), F.col("s_nationkey") % 3).alias("kind"), F.concat(F.lit("n"), "s_nationkey").alias("label"))
    p = load(spark, d, "part").select(F.concat(F.lit("P"), "p_brand").alias("node"), F.concat(F.lit("k"), F.length("p_brand") % 3).alias("kind"), F.col("p_brand").alias("label")).distinct()
    nodes = s.unionByName(p)
    a, b = nodes.toDF("src", "src_k", "src_label"), nodes.toDF("dst", "dst_k", "dst_label")
    return graph_events(spark, d).join(a, "src").join(b, "dst").filter("src_k <> dst_k").groupBy("src_label", "dst_label", "rel_class").agg(F.count("*").alias("n"))


# --- sentiment ----------------------------------------------------------------------------------

_KIND = "CASE s_nationkey % 9 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(P.MACRO_KINDS)) + " ELSE 'company' END"
_SENT = dict(
    nd=f"SELECT 'S' || s_suppkey AS node, {_KIND} AS kind, s_name || CASE WHEN s_suppkey % 11 = 0 THEN ' ADR' ELSE '' END AS label, n FROM supplier JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey",
    ag=f"SELECT node FROM nd WHERE n >= {P.MIN_EVENTS} AND kind <> 'company' AND NOT regexp_matches(label, '\\bADRs?\\b')",
    d="SELECT dt, src AS agent, sum(sign * strength) AS w, count(*) AS c FROM ge WHERE src IN (SELECT node FROM ag) GROUP BY 1, 2",
)


def _factors(spark, d):
    n = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n_events"))
    label = F.concat("s_name", F.when(F.col("s_suppkey") % 11 == 0, " ADR").otherwise(""))
    nodes = load(spark, d, "supplier").join(n, "s_suppkey").select(F.concat(F.lit("S"), "s_suppkey").alias("node"), F.expr(_KIND).alias("kind"), label.alias("label"), F.lit(None).cast("string").alias("ticker"), "n_events")
    cal = M.trading_calendar(prices(spark, d))
    events = graph_events(spark, d).select("src", "dst", "dt", (F.col("sign") * F.col("strength")).alias("w"))
    return cal, P.sentiment_factors(events, P.macro_agents(nodes), cal)


@catalog.add(sql("px ge", "SELECT c.date AS session, agent, round(sum(w), 6) AS f, CAST(sum(c) AS BIGINT) AS n FROM d ASOF JOIN cal c ON d.dt < c.date GROUP BY 1, 2", cal=_CAL, **_SENT))
def sentiment_factors(spark, d):
    return _r(_factors(spark, d)[1], "f")


@catalog.add()
def sentiment_regressions(spark, d):
    """Of each session's last 252 returns of each brand, on the six agents of most events in that window."""
    cal, f = _factors(spark, d)
    r = materialise(_indexed(spark, d)[1].select("ticker", "cal_i", "ret"), "returns")
    f = f.join(F.broadcast(cal.select(F.col("date").alias("session"), "cal_i")), "session").select("cal_i", "agent", "f", "n")  # a row a session
    return P.rolling_regressions(r, f, coverage=0.5)


# --- walk-forward -------------------------------------------------------------------------------


@catalog.add()
def share_choice(spark, d):
    cal, r = _indexed(spark, d)
    at = materialise(WF.periods(cal, "quarter"), "dates")
    equal = lambda x: np.full((x.shape[1],) * 2, 0.3) + 0.7 * np.eye(x.shape[1])
    told = materialise(WF.share_losses(r, at, equal, np.round(np.arange(0, 1.01, 0.05), 2).tolist(), days=250, coverage=0.2), "shares")
    return WF.chosen_shares(told, "gmv").withColumnRenamed("share", "share_gmv").join(WF.chosen_shares(told, "qlike").withColumnRenamed("share", "share_qlike"), "rebalance_date")


def _grid(spark, d, estimators, models):
    cal, r = _indexed(spark, d)
    r = materialise(r, "returns")
    at = materialise(WF.periods(cal, "quarter"), "dates")
    return r, at, materialise(WF.grid(r, at, estimators, models, days=250, coverage=0.2, high=0.3), "grid")


@catalog.add()
def walk_forward_losses(spark, d):
    _, _, runs = _grid(spark, d, sorted(C.ESTIMATORS), ["equal_weight"])
    return runs.drop("port", "tickers", "weights")


@catalog.add()
def walk_forward_books(spark, d):
    estimators, models = ["const_corr", "nonlinear"], ["gmv", "min_variance", "hierarchical", "risk_parity"]
    r, at, runs = _grid(spark, d, estimators, models)
    return WF.book(r, runs, at, estimators, models)


@catalog.add()
def eigenvector_centrality(spark, d):
    """Of the brands, linked by how much they share suppliers."""
    cells = MX.exposure(graph_events(spark, d).filter(F.col("dt") < F.lit(ASOF)), ASOF, 90, "P")
    return MX.eigenvector_centrality(MX.projection(MX.weighted(cells, "raw", "w_abs")).select("i", "j", F.col("cosine").alias("w")))
