"""Queries over prices, universes, panels and tests."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators import inference as I, market as M
from ..sources.tables import Catalog, graph_events, load, prices, sql

catalog = Catalog()

_CAL = """SELECT date, n AS n_tickers, row_number() OVER (ORDER BY date) AS cal_i FROM (SELECT date, n, median(n) OVER (ORDER BY date ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS med FROM (
 SELECT date, count(*) AS n FROM px WHERE dayofweek(date) NOT IN (0, 6) AND close > 0 AND adj_close > 0 GROUP BY 1)) WHERE n >= 0.5 * med"""
_SPLICE = ", ".join(f"DATE '{x}'" for x in M.SPLICE_DATES)
_P1 = "SELECT r.*, c.cal_i, lag(adj_close) OVER w AS prev, c.cal_i - lag(c.cal_i) OVER w - 1 AS gap FROM px r JOIN cal c ON r.date = c.date WHERE close > 0 AND adj_close > 0 WINDOW w AS (PARTITION BY ticker ORDER BY r.date)"
_P2 = f"SELECT *, adj_close / prev - 1 AS ret_raw, CASE WHEN prev IS NULL THEN 'first' WHEN gap > 0 THEN 'gap' WHEN date IN ({_SPLICE}) THEN 'splice' WHEN volume = 0 AND adj_close = prev THEN 'stale' END AS f0 FROM p1"
_P3 = "SELECT *, lead(ret_raw) OVER w AS nx, lead(gap) OVER w AS ng, lag(ret_raw) OVER w AS pv, lag(f0) OVER w AS pf FROM p2 WINDOW w AS (PARTITION BY ticker ORDER BY date)"
_P4 = """SELECT *, coalesce(f0, CASE WHEN abs(ret_raw) >= 0.5 AND ng = 0 AND abs((1 + ret_raw) * (1 + nx) - 1) <= 0.05 THEN 'spike'
 WHEN pf IS NULL AND abs(pv) >= 0.5 AND gap = 0 AND abs((1 + pv) * (1 + ret_raw) - 1) <= 0.05 THEN 'spike_revert' END) AS flag FROM p3"""
_DAY = "SELECT ticker, date, cal_i, close, adj_close, volume, close * volume AS dollar_volume, ret_raw, CASE WHEN flag IS NULL THEN ret_raw END AS ret, flag FROM p4"
_CHAIN = {"cal": _CAL, "p1": _P1, "p2": _P2, "p3": _P3, "p4": _P4, "daily": _DAY}


def _panel(spark, d):
    px = prices(spark, d)
    cal = M.trading_calendar(px)
    return cal, M.flagged_returns(px, cal)


def _r(df, *cols, n=6):
    return df.withColumns({c: F.round(F.col(c) + 0.0, n) for c in cols})


@catalog.add(sql("px", "SELECT * FROM cal", cal=_CAL))
def trading_calendar(spark, d):
    return M.trading_calendar(prices(spark, d))


@catalog.add(sql("px", "SELECT ticker, date, cal_i, round(close, 9) AS close, round(ret_raw, 6) AS ret_raw, round(ret, 6) AS ret, flag FROM daily", **_CHAIN))
def price_flags(spark, d):
    return _r(_r(_panel(spark, d)[1].select("ticker", "date", "cal_i", "close", "ret_raw", "ret", "flag"), "ret_raw", "ret"), "close", n=9)


@catalog.add(sql("px", "SELECT ticker, date, round(ret, 6) AS ret FROM daily WHERE ret IS NOT NULL", **_CHAIN))
def returns_clean(spark, d):
    return _r(_panel(spark, d)[1].filter("ret IS NOT NULL").select("ticker", "date", "ret"), "ret")


@catalog.add(sql("px", "SELECT date, count(*) AS n FROM (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) AS f FROM daily) WHERE f IS NOT NULL AND flag IS DISTINCT FROM 'gap' AND abs(f - 1) > 0.05 GROUP BY 1 HAVING count(*) >= 10", **_CHAIN))
def splice_detector(spark, d):
    f = F.col("close") / F.lag("close").over(W.partitionBy("ticker").orderBy("date"))
    jumps = _panel(spark, d)[1].withColumn("f", f).filter(F.col("f").isNotNull() & ~F.col("flag").eqNullSafe(F.lit("gap")) & (F.abs(F.col("f") - 1) > 0.05))
    return jumps.groupBy("date").agg(F.count("*").alias("n")).filter("n >= 10")


_QUAL = """SELECT s.ticker, first_date, last_date, n_obs, n_ret, n_gap, n_spike, n_splice, n_stale, round(max_abs_ret, 6) AS max_abs_ret, round(median_close, 6) AS median_close, round(median_dollar_volume, 4) AS median_dollar_volume,
 n_cal, round(n_obs / n_cal, 6) AS coverage, last_date IN (SELECT last_date FROM s GROUP BY 1 HAVING count(*) >= 3 AND last_date < (SELECT max(date) FROM cal)) AS truncated
 FROM s JOIN (SELECT s.ticker, count(c.date) AS n_cal FROM s JOIN cal c ON c.date BETWEEN s.first_date AND s.last_date GROUP BY 1) USING (ticker)"""
_S = """SELECT ticker, min(date) AS first_date, max(date) AS last_date, count(*) AS n_obs, count(ret) AS n_ret, count(*) FILTER (WHERE flag = 'gap') AS n_gap, count(*) FILTER (WHERE flag IN ('spike', 'spike_revert')) AS n_spike,
 count(*) FILTER (WHERE flag = 'splice') AS n_splice, count(*) FILTER (WHERE flag = 'stale') AS n_stale, max(abs(ret)) AS max_abs_ret, median(close) AS median_close, median(dollar_volume) AS median_dollar_volume FROM daily GROUP BY 1"""


@catalog.add(sql("px", _QUAL, **_CHAIN, s=_S))
def price_quality(spark, d):
    cal, daily = _panel(spark, d)
    return _r(_r(M.quality(daily, cal, same_end=3), "max_abs_ret", "median_close", "coverage"), "median_dollar_volume", n=4)


_UNI = """SELECT rebalance_date, ticker, n_events, n_docs, n_ret, round(last_close, 6) AS last_close, round(median_dollar_volume, 4) AS median_dollar_volume, rank FROM (
 SELECT o.*, e.n_events, e.n_docs, row_number() OVER (PARTITION BY o.rebalance_date ORDER BY n_events DESC, o.median_dollar_volume DESC, o.ticker) AS rank FROM ok o JOIN ev e ON e.rebalance_date = o.rebalance_date AND 'P' || o.ticker = e.node) WHERE rank <= 10"""
_UNI_CTES = dict(
    t0="SELECT r.rebalance_date, min(cal_i) AS t0 FROM r JOIN cal ON date >= rebalance_date GROUP BY 1",
    own="SELECT t0.rebalance_date, t0.t0, ticker, count(ret) AS n_ret, count(*) FILTER (WHERE flag IN ('spike', 'spike_revert')) AS n_spike, arg_max(close, date) AS last_close, max(cal_i) AS last_i, median(dollar_volume) AS median_dollar_volume FROM daily JOIN t0 ON cal_i >= t0.t0 - 120 AND cal_i < t0.t0 GROUP BY ALL",
    ok="SELECT * FROM own WHERE n_ret >= 0.2 * 120 AND n_spike <= 0 AND last_i = t0 - 1 AND last_close >= 5 AND median_dollar_volume >= 5000",
    ev="SELECT rebalance_date, node, count(*) AS n_events, count(DISTINCT doc_id) AS n_docs FROM (SELECT src AS node, doc_id, dt FROM ge UNION ALL SELECT dst, doc_id, dt FROM ge) JOIN r ON dt < rebalance_date AND dt >= rebalance_date - 365 GROUP BY 1, 2",
)


def _universe(spark, d, dates):
    cal, daily = _panel(spark, d)
    ev = graph_events(spark, d).withColumns({c: F.when(F.col(c).startswith("P"), F.substring(c, 2, 100)).otherwise(F.col(c)) for c in ("src", "dst")})
    at = spark.createDataFrame([(x,) for x in dates], "s string").select(F.col("s").cast("date").alias("rebalance_date"))
    return _r(M.universes(daily, ev, cal, at, n=10, days=120, min_fraction=0.2, min_volume=5000).withColumn("last_close", F.round("last_close", 6)), "median_dollar_volume", n=4)


@catalog.add(sql("px ge", _UNI, **_CHAIN, r="SELECT DATE '1999-07-01' AS rebalance_date", **_UNI_CTES))
def universe_asof(spark, d):
    return _universe(spark, d, ["1999-07-01"])


@catalog.add(sql("px ge", _UNI, **_CHAIN, r="SELECT CAST(unnest(['1998-01-05', '1998-07-01', '1999-01-04', '1999-07-01', '2000-01-03']) AS DATE) AS rebalance_date", **_UNI_CTES))
def universe_series(spark, d):
    return _universe(spark, d, ["1998-01-05", "1998-07-01", "1999-01-04", "1999-07-01", "2000-01-03"])


# returns of the panels: every observed price over the one before, whatever the gap
_RET = "SELECT ticker, date, ret FROM (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM px) WHERE ret IS NOT NULL"
_MKT = "SELECT date, avg(ret) AS market FROM ret GROUP BY 1"


def _returns(spark, d):
    ret = F.col("close") / F.lag("close").over(W.partitionBy("ticker").orderBy("date")) - 1
    return prices(spark, d).withColumn("ret", ret).filter("ret IS NOT NULL").select("ticker", "date", "ret")


@catalog.add(sql("px", "SELECT a.ticker AS i, b.ticker AS j, count(*) AS n, round(covar_samp(a.ret, b.ret), 6) AS cov FROM ret a JOIN ret b ON a.date = b.date AND a.ticker < b.ticker GROUP BY 1, 2", ret=_RET))
def sample_cov(spark, d):
    return M.pairs(_returns(spark, d), "ret").groupBy("i", "j").agg(F.count("*").alias("n"), F.round(F.covar_samp("x", "y"), 6).alias("cov"))


@catalog.add(sql("px", "SELECT i, j, n, CASE WHEN n >= 60 THEN round(c, 6) END AS corr FROM (SELECT a.ticker AS i, b.ticker AS j, count(*) AS n, corr(a.ret, b.ret) AS c FROM ret a JOIN ret b ON a.date = b.date AND a.ticker < b.ticker GROUP BY 1, 2)", ret=_RET))
def pairwise_corr(spark, d):
    return _r(M.pairwise_corr(_returns(spark, d), "ret"), "corr")


@catalog.add(sql("px", "SELECT i, j, n, round(atanh(greatest(-0.999, least(0.999, c))), 6) AS z FROM (SELECT a.ticker AS i, b.ticker AS j, count(*) AS n, corr(a.ret, b.ret) AS c FROM ret a JOIN ret b ON a.date = b.date AND a.ticker < b.ticker GROUP BY 1, 2) WHERE n >= 60", ret=_RET))
def fisher_z(spark, d):
    p = M.pairwise_corr(_returns(spark, d), "ret").filter("n >= 60")
    return p.select("i", "j", "n", F.round(F.atanh(F.greatest(F.lit(-0.999), F.least(F.lit(0.999), F.col("corr")))), 6).alias("z"))


@catalog.add(sql("px", "SELECT ticker, round(regr_intercept(ret, market), 6) AS alpha, round(regr_slope(ret, market), 6) AS beta, count(*) AS n FROM ret JOIN mkt USING (date) GROUP BY 1", ret=_RET, mkt=_MKT))
def market_beta(spark, d):
    return _r(M.betas(_returns(spark, d)), "alpha", "beta")


@catalog.add(sql("px", "SELECT ticker, round(regr_intercept(ret, market), 6) AS alpha, round(regr_slope(ret, market), 6) AS beta, count(*) AS n FROM ret JOIN mkt USING (date) WHERE market < 0 GROUP BY 1", ret=_RET, mkt=_MKT))
def downside_beta(spark, d):
    return _r(M.betas(_returns(spark, d), F.col("market") < 0), "alpha", "beta")


_RES = "SELECT ticker, date, ret - alpha - beta * market AS resid, market FROM ret JOIN mkt USING (date) JOIN (SELECT ticker, regr_intercept(ret, market) AS alpha, regr_slope(ret, market) AS beta FROM ret JOIN mkt USING (date) GROUP BY 1) USING (ticker)"


@catalog.add(sql("px", "SELECT i, j, n, CASE WHEN n >= 60 THEN round(c, 6) END AS corr FROM (SELECT a.ticker AS i, b.ticker AS j, count(*) AS n, corr(a.resid, b.resid) AS c FROM res a JOIN res b ON a.date = b.date AND a.ticker < b.ticker GROUP BY 1, 2)", ret=_RET, mkt=_MKT, res=_RES))
def residual_corr(spark, d):
    return _r(M.pairwise_corr(M.residuals(_returns(spark, d)), "resid"), "corr")


@catalog.add(sql("px", "SELECT ticker, round(avg(resid * m * m) / (sqrt(avg(resid * resid)) * avg(m * m)), 5) AS coskew FROM (SELECT ticker, resid, market - (SELECT avg(market) FROM mkt) AS m FROM res) GROUP BY 1", ret=_RET, mkt=_MKT, res=_RES))
def coskewness(spark, d):
    ret = _returns(spark, d)
    mkt = M.market_factor(ret)
    mean = F.broadcast(mkt.agg(F.avg("market").alias("mean")))  # one row
    r = M.residuals(ret).join(mkt, "date").crossJoin(mean).withColumn("m", F.col("market") - F.col("mean"))
    return r.groupBy("ticker").agg(F.round(F.avg(F.col("resid") * F.col("m") * F.col("m")) / (F.sqrt(F.avg(F.col("resid") * F.col("resid"))) * F.avg(F.col("m") * F.col("m"))), 5).alias("coskew"))


@catalog.add(sql("px", "SELECT a.ticker AS i, b.ticker AS j, round(sum(pow(0.97, DATE '2001-11-05' - a.date) * a.ret * b.ret) / sum(pow(0.97, DATE '2001-11-05' - a.date)), 6) AS cov FROM ret a JOIN ret b ON a.date = b.date AND a.ticker <= b.ticker WHERE a.date >= DATE '2001-01-01' GROUP BY 1, 2", ret=_RET))
def ewma_cov(spark, d):
    r = _returns(spark, d).filter(F.col("date") >= F.lit("2001-01-01").cast("date"))
    a, b = r.toDF("i", "date", "x"), r.toDF("j", "date", "y")
    w = F.pow(F.lit(0.97), F.datediff(F.lit("2001-11-05").cast("date"), F.col("date")))
    return a.join(b, "date").filter("i <= j").groupBy("i", "j").agg(F.round(F.sum(w * F.col("x") * F.col("y")) / F.sum(w), 6).alias("cov"))


@catalog.add(sql("px", "SELECT ticker, date, CASE WHEN count(ret) OVER w = 21 THEN round(stddev_samp(ret) OVER w, 6) END AS vol FROM ret WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)", ret=_RET))
def rolling_vol(spark, d):
    w = W.partitionBy("ticker").orderBy("date").rowsBetween(-20, 0)
    return _returns(spark, d).select("ticker", "date", F.when(F.count("ret").over(w) == 21, F.round(F.stddev_samp("ret").over(w), 6)).alias("vol"))


@catalog.add(sql("px", "SELECT ticker, date, round(close, 9) AS close, round(med, 9) AS med FROM (SELECT ticker, date, close, quantile_cont(close, 0.5) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS med FROM px)"))
def moving_median(spark, d):
    w = W.partitionBy("ticker").orderBy("date").rowsBetween(-15, 15)
    return prices(spark, d).select("ticker", "date", F.round("close", 9).alias("close"), F.round(F.percentile("close", F.lit(0.5)).over(w), 9).alias("med"))


@catalog.add(sql("px", "SELECT ticker, date, round(lag(close) OVER w, 9) AS before, round(lead(close) OVER w, 9) AS after, row_number() OVER w AS k FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date)"))
def lag_lead_flags(spark, d):
    w = W.partitionBy("ticker").orderBy("date")
    return prices(spark, d).select("ticker", "date", F.round(F.lag("close").over(w), 9).alias("before"), F.round(F.lead("close").over(w), 9).alias("after"), F.row_number().over(w).alias("k"))


_SMALL = "SELECT ticker, date, ret / 100 AS ret FROM ret"
_NAV = "SELECT ticker, date, ret, exp(sum(ln(1 + ret)) OVER (PARTITION BY ticker ORDER BY date)) AS nav FROM small"
_DD = "SELECT *, nav / greatest(1, max(nav) OVER (PARTITION BY ticker ORDER BY date)) - 1 AS dd FROM nav"


def _small(spark, d):
    return _returns(spark, d).withColumn("ret", F.col("ret") / 100)


@catalog.add(sql("px", "SELECT ticker, date, round(ln(nav), 6) AS log_nav, round(dd, 6) AS drawdown FROM dd", ret=_RET, small=_SMALL, nav=_NAV, dd=_DD))
def drawdown(spark, d):
    return _r(M.drawdowns(_small(spark, d)).select("ticker", "date", F.log("nav").alias("log_nav"), "drawdown"), "log_nav", "drawdown")


@catalog.add(sql("px", """SELECT ticker, count(*) AS n, round(exp(sum(ln(1 + ret)) * 252.0 / count(*)) - 1, 6) AS growth, round(stddev_samp(ret) * sqrt(252.0), 6) AS vol, round(avg(ret) / stddev_samp(ret) * sqrt(252.0), 5) AS sharpe,
 round(avg(pow(ret - m, 3)) / pow(avg(pow(ret - m, 2)), 1.5), 5) AS skew, round(avg(pow(ret - m, 4)) / pow(avg(pow(ret - m, 2)), 2) - 3, 5) AS kurt, round(avg(CAST(ret > 0 AS INT)), 6) AS hit, round(min(dd), 6) AS mdd
 FROM (SELECT *, avg(ret) OVER (PARTITION BY ticker) AS m FROM dd) GROUP BY 1""", ret=_RET, small=_SMALL, nav=_NAV, dd=_DD))
def nav_metrics(spark, d):
    return _r(_r(M.performance(_small(spark, d)), "growth", "vol", "hit", "mdd"), "sharpe", "skew", "kurt", n=5)


@catalog.add(sql("px", "SELECT ticker, round(regr_slope(ret, market), 6) AS beta, round(stddev_samp(ret - market), 6) AS te, round(avg(ret - market) / stddev_samp(ret - market), 6) AS ir FROM ret JOIN mkt USING (date) GROUP BY 1", ret=_RET, mkt=_MKT))
def benchmark_metrics(spark, d):
    ret = _returns(spark, d)
    both = ret.join(M.market_factor(ret), "date").withColumn("x", F.col("ret") - F.col("market"))
    return _r(both.groupBy("ticker").agg(F.regr_slope("ret", "market").alias("beta"), F.stddev_samp("x").alias("te"), (F.avg("x") / F.stddev_samp("x")).alias("ir")), "beta", "te", "ir")


@catalog.add(sql("px", "SELECT ticker, count(*) AS n, round(avg(ret), 6) AS mean, round(sum(t) / count(*), 6) AS lrv, round(avg(ret) / sqrt(sum(t) / count(*) / count(*)), 5) AS t FROM (SELECT ticker, ret, d * d + " + " + ".join(f"{2 * (1 - h / 5)!r} * d * coalesce(lag(d, {h}) OVER w, 0)" for h in range(1, 5)) + " AS t FROM (SELECT *, ret - avg(ret) OVER (PARTITION BY ticker) AS d FROM ret) WINDOW w AS (PARTITION BY ticker ORDER BY date)) GROUP BY 1", ret=_RET))
def newey_west_t(spark, d):
    return _r(_r(I.newey_west(_returns(spark, d), "ticker", "date", "ret", 4), "mean", "lrv"), "t", n=5)


_TESTS = "SELECT p_brand AS name, round((count(*) % 97) / 97.0, 6) AS p FROM part GROUP BY 1"


def _tests(spark, d):
    return load(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.round((F.count("*") % 97) / 97.0, 6).alias("p"))


@catalog.add(sql("", "SELECT name, p, round(max(a) OVER (ORDER BY p, name), 6) AS holm FROM (SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) * p) AS a FROM t)", t=_TESTS))
def holm_adjust(spark, d):
    return _r(I.holm(_tests(spark, d)), "holm")


@catalog.add(sql("", "SELECT name, p, round(min(a) OVER (ORDER BY p DESC, name DESC), 6) AS bh FROM (SELECT *, least(1, p * count(*) OVER () / row_number() OVER (ORDER BY p, name)) AS a FROM t)", t=_TESTS))
def bh_adjust(spark, d):
    return _r(I.benjamini_hochberg(_tests(spark, d)), "bh")


@catalog.add("""SELECT round(pow(sum(k - ra * cb / n), 2) / sum(ra * cb * (n - ra) * (n - cb) / (n * n * (n - 1))), 5) AS statistic, round(sum(k * (n - ra - cb + k) / n) / nullif(sum((ra - k) * (cb - k) / n), 0), 5) AS odds_ratio
 FROM (SELECT lang, CAST(count(*) AS DOUBLE) AS n, CAST(sum(quality * toxic) AS DOUBLE) AS k, CAST(sum(quality) AS DOUBLE) AS ra, CAST(sum(toxic) AS DOUBLE) AS cb FROM labels JOIN documents USING (doc_id) GROUP BY 1) WHERE n > 1""")
def cmh(spark, d):
    rows = load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return _r(I.cochran_mantel_haenszel(rows, "lang", "quality", "toxic"), "statistic", "odds_ratio", n=5)


@catalog.add(sql("px", "SELECT count(*) AS n_dates, round(avg(s), 6) AS mean, round(avg(s) / (stddev_samp(s) / sqrt(count(*))), 5) AS t FROM (SELECT date, regr_slope(ret, z) AS s FROM (SELECT date, ret, CASE WHEN stddev_pop(x) OVER w > 0 THEN (x - avg(x) OVER w) / stddev_pop(x) OVER w ELSE 0 END AS z FROM p WINDOW w AS (PARTITION BY date)) GROUP BY 1) WHERE s IS NOT NULL AND NOT isnan(s)", ret=_RET, p="SELECT r.ticker, r.date, ret, ln(volume) AS x FROM ret r JOIN px ON r.ticker = px.ticker AND r.date = px.date"))
def fama_macbeth_univariate(spark, d):
    px = prices(spark, d).select("ticker", "date", F.log("volume").alias("x"))
    return _r(_r(I.fama_macbeth(_returns(spark, d).join(px, ["ticker", "date"]), "date", "ret", "x"), "mean"), "t", n=5)


@catalog.add(sql("px", "SELECT decile, count(*) AS n, round(avg(ret), 6) AS mean FROM (SELECT ret, ntile(10) OVER (ORDER BY x, ticker, date) AS decile FROM (SELECT r.ticker, r.date, ret, volume AS x FROM ret r JOIN px ON r.ticker = px.ticker AND r.date = px.date)) GROUP BY 1", ret=_RET))
def deciles_gain(spark, d):
    px = prices(spark, d).select("ticker", "date", F.col("volume").alias("x"))
    t = _returns(spark, d).join(px, ["ticker", "date"]).withColumn("decile", F.ntile(10).over(W.orderBy("x", "ticker", "date")))
    return t.groupBy(F.col("decile").cast("long").alias("decile")).agg(F.count("*").alias("n"), F.round(F.avg("ret"), 6).alias("mean"))


@catalog.add(sql("px", "SELECT min(date) AS rebalance_date, CAST(date_trunc('quarter', date) AS DATE) AS quarter FROM cal GROUP BY 2", cal=_CAL))
def schedule(spark, d):
    cal = M.trading_calendar(prices(spark, d))
    return cal.groupBy(F.to_date(F.date_trunc("quarter", "date")).alias("quarter")).agg(F.min("date").alias("rebalance_date"))


# equal and inverse-volatility weights at each quarter's first session, held to the next
_BT = dict(ret=_RET, small=_SMALL,
           own="SELECT *, CAST(date_trunc('quarter', date) AS DATE) AS q FROM small",
           growth="SELECT q, ticker, date, exp(sum(ln(1 + ret)) OVER (PARTITION BY q, ticker ORDER BY date)) AS g, count(*) OVER (PARTITION BY q, ticker ORDER BY date) AS k FROM own")


@catalog.add(sql("px", "SELECT q, count(*) AS n, round(avg(g) - 1, 6) AS ret FROM (SELECT q, ticker, arg_max(g, date) AS g FROM growth GROUP BY 1, 2) GROUP BY 1", **_BT))
def equal_weight_backtest(spark, d):
    own = _small(spark, d).withColumn("q", F.to_date(F.date_trunc("quarter", "date")))
    g = own.groupBy("q", "ticker").agg(F.exp(F.sum(F.log1p("ret"))).alias("g"))
    return g.groupBy("q").agg(F.count("*").alias("n"), F.round(F.avg("g") - 1, 6).alias("ret"))


_IV = dict(_BT, vol="SELECT q, ticker, stddev_samp(ret) AS s, exp(sum(ln(1 + ret))) AS g FROM own GROUP BY 1, 2 HAVING count(*) >= 5",
           w="SELECT a.q, a.ticker, (1 / b.s) / sum(1 / b.s) OVER (PARTITION BY a.q) AS w, a.g FROM vol a JOIN vol b ON a.ticker = b.ticker AND b.q = a.q - INTERVAL 3 MONTH")


def _inverse(spark, d):
    own = _small(spark, d).withColumn("q", F.to_date(F.date_trunc("quarter", "date")))
    v = own.groupBy("q", "ticker").agg(F.stddev_samp("ret").alias("s"), F.exp(F.sum(F.log1p("ret"))).alias("g"), F.count("*").alias("n")).filter("n >= 5")
    before = v.select(F.add_months("q", 3).alias("q"), "ticker", (1 / F.col("s")).alias("inv"))
    both = v.select("q", "ticker", "g").join(before, ["q", "ticker"])
    return both.withColumn("w", F.col("inv") / F.sum("inv").over(W.partitionBy("q")))


@catalog.add(sql("px", "SELECT q, count(*) AS n, round(sum(w * g) - 1, 6) AS ret FROM w GROUP BY 1", **_IV))
def inverse_vol_backtest(spark, d):
    return _inverse(spark, d).groupBy("q").agg(F.count("*").alias("n"), F.round(F.sum(F.col("w") * F.col("g")) - 1, 6).alias("ret"))


@catalog.add(sql("px", "SELECT coalesce(a.q, b.q) AS q, round(sum(abs(coalesce(a.w, 0) - coalesce(b.d, 0))), 6) AS turnover, round(0.001 * sum(abs(coalesce(a.w, 0) - coalesce(b.d, 0))), 8) AS cost FROM w a FULL JOIN (SELECT CAST(q + INTERVAL 3 MONTH AS DATE) AS q, ticker, w * g / sum(w * g) OVER (PARTITION BY q) AS d FROM w) b ON a.q = b.q AND a.ticker = b.ticker GROUP BY 1", **_IV))
def turnover_cost(spark, d):
    w = _inverse(spark, d)
    drift = w.select(F.add_months("q", 3).alias("q"), "ticker", (F.col("w") * F.col("g") / F.sum(F.col("w") * F.col("g")).over(W.partitionBy("q"))).alias("d"))
    both = w.select("q", "ticker", "w").join(drift, ["q", "ticker"], "full")
    t = F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("d", F.lit(0.0))))
    return both.groupBy("q").agg(F.round(t, 6).alias("turnover"), F.round(t * 0.001, 8).alias("cost"))
