"""Prices: trading calendar, flagged returns, quality, point-in-time universes, factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Days on which the price source changed its adjustment, and the rules' limits.
SPLICE_DATES = ("2015-01-02", "2020-04-02", "2020-07-02", "2020-07-06")
SPIKE = 0.5
SPIKE_REVERTED = 0.05
MIN_FRACTION = 0.5
SAME_END = 50


def trading_calendar(prices: DataFrame) -> DataFrame:
    """(date, n_tickers, cal_i): weekdays with at least half the tickers of the days around them."""
    valid = prices.filter(~F.dayofweek("date").isin(1, 7) & (F.col("close") > 0) & (F.col("adj_close") > 0))
    days = valid.groupBy("date").agg(F.count("*").alias("n_tickers"))
    near = W.orderBy("date").rowsBetween(-15, 15)  # a row a day
    days = days.withColumn("median", F.percentile("n_tickers", F.lit(0.5)).over(near)).filter(F.col("n_tickers") >= MIN_FRACTION * F.col("median"))
    return days.select("date", "n_tickers", F.row_number().over(W.orderBy("date")).alias("cal_i"))


def flagged_returns(prices: DataFrame, calendar: DataFrame, splices: tuple[str, ...] = SPLICE_DATES) -> DataFrame:
    """Each price with its raw return, the first reason against it, and the return if none."""
    w = W.partitionBy("ticker").orderBy("date")
    days = F.broadcast(calendar.select("date", "cal_i"))  # a row a trading day
    p = prices.filter((F.col("close") > 0) & (F.col("adj_close") > 0)).join(days, "date")
    p = p.withColumns({"prev": F.lag("adj_close").over(w), "gap": F.col("cal_i") - F.lag("cal_i").over(w) - 1})
    raw = F.col("adj_close") / F.col("prev") - 1
    first = (F.when(F.col("prev").isNull(), "first").when(F.col("gap") > 0, "gap").when(F.col("date").isin([F.lit(d).cast("date") for d in splices]), "splice")
             .when((F.col("volume") == 0) & (F.col("adj_close") == F.col("prev")), "stale"))
    p = p.withColumns({"ret_raw": raw, "first": first})
    p = p.withColumns({"next": F.lead("ret_raw").over(w), "next_gap": F.lead("gap").over(w), "before": F.lag("ret_raw").over(w), "before_flag": F.lag("first").over(w)})
    undone = lambda x, y: F.abs((1 + x) * (1 + y) - 1) <= SPIKE_REVERTED
    spike = (F.abs("ret_raw") >= SPIKE) & (F.col("next_gap") == 0) & undone(F.col("ret_raw"), F.col("next"))
    back = F.col("before_flag").isNull() & (F.abs("before") >= SPIKE) & (F.col("gap") == 0) & undone(F.col("before"), F.col("ret_raw"))
    flag = F.coalesce("first", F.when(spike, "spike").when(back, "spike_revert"))
    return p.withColumn("flag", flag).select("ticker", "date", "cal_i", "close", "adj_close", "volume", (F.col("close") * F.col("volume")).alias("dollar_volume"), "ret_raw", F.when(F.col("flag").isNull(), F.col("ret_raw")).alias("ret"), "flag")


def quality(daily: DataFrame, calendar: DataFrame, same_end: int = SAME_END) -> DataFrame:
    """Per ticker: counts of flags, coverage of its span, and whether its source ended early."""
    s = daily.groupBy("ticker").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.min("cal_i").alias("first_i"), F.max("cal_i").alias("last_i"),
        F.count("*").alias("n_obs"), F.count("ret").alias("n_ret"), F.count_if(F.col("flag") == "gap").alias("n_gap"),
        F.count_if(F.col("flag").isin("spike", "spike_revert")).alias("n_spike"), F.count_if(F.col("flag") == "splice").alias("n_splice"),
        F.count_if(F.col("flag") == "stale").alias("n_stale"), F.max(F.abs("ret")).alias("max_abs_ret"),
        F.median("close").alias("median_close"), F.median("dollar_volume").alias("median_dollar_volume"),
    )
    ends = s.groupBy("last_date").agg(F.count("*").alias("n")).filter(F.col("n") >= same_end)
    ends = ends.crossJoin(F.broadcast(calendar.agg(F.max("date").alias("end")))).filter("last_date < end").select("last_date", F.lit(True).alias("truncated"))
    n = F.col("last_i") - F.col("first_i") + 1  # calendar days are numbered without gaps
    return s.join(ends, "last_date", "left").select(*[c for c in s.columns if c not in ("first_i", "last_i")], n.alias("n_cal"), (F.col("n_obs") / n).alias("coverage"), F.coalesce("truncated", F.lit(False)).alias("truncated"))


def universes(daily: DataFrame, events: DataFrame, calendar: DataFrame, dates: DataFrame, n: int = 100, days: int = 252, news_days: int = 365, min_fraction: float = 0.95, min_price: float = 5.0, min_volume: float = 5e6) -> DataFrame:
    """The n tickers of most news at each of ``dates``(rebalance_date), all dates in one job.

    Price rules look at the ``days`` sessions before the date, news at the ``news_days`` before it.
    """
    at = calendar.join(F.broadcast(dates), F.col("date") >= F.col("rebalance_date")).groupBy("rebalance_date").agg(F.min("cal_i").alias("t0"))  # a row a date
    px = daily.join(F.broadcast(at), (F.col("cal_i") >= F.col("t0") - days) & (F.col("cal_i") < F.col("t0")))
    own = px.groupBy("rebalance_date", "t0", "ticker").agg(
        F.count("ret").alias("n_ret"), F.count_if(F.col("flag").isin("spike", "spike_revert")).alias("n_spike"), F.max_by("close", "date").alias("last_close"),
        F.max("cal_i").alias("last_i"), F.median("dollar_volume").alias("median_dollar_volume"))
    own = own.filter((F.col("n_ret") >= min_fraction * days) & (F.col("n_spike") == 0) & (F.col("last_i") == F.col("t0") - 1) & (F.col("last_close") >= min_price) & (F.col("median_dollar_volume") >= min_volume))
    ends = events.select(F.col("src").alias("ticker"), "doc_id", "dt").unionByName(events.select(F.col("dst").alias("ticker"), "doc_id", "dt"))
    news = ends.join(F.broadcast(dates), (F.col("dt") < F.col("rebalance_date")) & (F.col("dt") >= F.date_sub("rebalance_date", news_days)))
    news = news.groupBy("rebalance_date", "ticker").agg(F.count("*").alias("n_events"), F.count_distinct("doc_id").alias("n_docs"))
    w = W.partitionBy("rebalance_date").orderBy(F.desc("n_events"), F.desc("median_dollar_volume"), "ticker")
    return own.join(news, ["rebalance_date", "ticker"]).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("rebalance_date", "ticker", "n_events", "n_docs", "n_ret", "last_close", "median_dollar_volume", "rank")


def market_factor(returns: DataFrame) -> DataFrame:
    """(date, market): the equal-weight mean return."""
    return returns.filter("ret IS NOT NULL").groupBy("date").agg(F.avg("ret").alias("market"))


def betas(returns: DataFrame, where: Column | None = None) -> DataFrame:
    """(ticker, alpha, beta, n): regression on the market over days for which ``where`` holds."""
    both = returns.filter("ret IS NOT NULL").join(market_factor(returns), "date")
    both = both.filter(where) if where is not None else both
    return both.groupBy("ticker").agg(F.regr_intercept("ret", "market").alias("alpha"), F.regr_slope("ret", "market").alias("beta"), F.count("*").alias("n"))


def residuals(returns: DataFrame) -> DataFrame:
    """(ticker, date, resid): returns less alpha and beta times the market."""
    both = returns.filter("ret IS NOT NULL").join(market_factor(returns), "date").join(betas(returns), "ticker")
    return both.select("ticker", "date", (F.col("ret") - F.col("alpha") - F.col("beta") * F.col("market")).alias("resid"))


def pairs(values: DataFrame, value: str, key: str = "ticker", date: str = "date") -> DataFrame:
    """(i, j, x, y, date) of every two keys i < j that have a value on a date."""
    a = values.select(F.col(key).alias("i"), F.col(date).alias("date"), F.col(value).alias("x"))
    b = values.select(F.col(key).alias("j"), F.col(date).alias("date"), F.col(value).alias("y"))
    return a.join(b, "date").filter("i < j")


def pairwise_corr(values: DataFrame, value: str, least: int = 60) -> DataFrame:
    """(i, j, n, corr) over the days both have; null below ``least`` days."""
    out = pairs(values.filter(F.col(value).isNotNull()), value).groupBy("i", "j").agg(F.count("*").alias("n"), F.corr("x", "y").alias("corr"))
    return out.select("i", "j", "n", F.when(F.col("n") >= least, F.col("corr")).alias("corr"))


def drawdowns(returns: DataFrame, ret: str = "ret") -> DataFrame:
    """``returns`` with nav, peak and drawdown; the first peak is the initial 1."""
    w = W.partitionBy("ticker").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    nav = returns.withColumn("nav", F.exp(F.sum(F.log1p(ret)).over(w)))
    return nav.withColumn("peak", F.greatest(F.lit(1.0), F.max("nav").over(w))).withColumn("drawdown", F.col("nav") / F.col("peak") - 1)


def performance(returns: DataFrame, year: int = 252) -> DataFrame:
    """Per ticker: n, growth a year, volatility, Sharpe, skewness, excess kurtosis, hit rate, worst drawdown."""
    m = drawdowns(returns).groupBy("ticker").agg(
        F.count("*").alias("n"), F.exp(F.sum(F.log1p("ret")) * F.lit(float(year)) / F.count("*")).alias("growth"), (F.stddev_samp("ret") * F.sqrt(F.lit(float(year)))).alias("vol"),
        (F.avg("ret") / F.stddev_samp("ret") * F.sqrt(F.lit(float(year)))).alias("sharpe"), F.skewness("ret").alias("skew"), F.kurtosis("ret").alias("kurt"),
        F.avg((F.col("ret") > 0).cast("double")).alias("hit"), F.min("drawdown").alias("mdd"))
    return m.withColumn("growth", F.col("growth") - 1)
