"""Walk-forward studies: several estimators and portfolios at each date, losses of the period after it,
and a shrinkage share chosen by the periods before.

A date's estimates depend on its own window alone, so dates are tasks. What a date learns from
earlier ones (the share) is a window over a row a date and share.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from . import backtest
from .kernels import covariance, portfolio
from .operators.panels import seen_by
from .sources.scratch import materialise


def periods(calendar: DataFrame, every: str = "month") -> DataFrame:
    """(rebalance_date, t0, t1): each date's session and the next date's; the last period ends with the calendar."""
    at = backtest.dates_of(calendar, every)
    end = F.broadcast(calendar.agg((F.max("cal_i") + 1).alias("end")))  # one row
    after = F.lead("cal_i").over(W.orderBy("cal_i"))  # a row a date
    return at.withColumn("t1", after).crossJoin(end).select("rebalance_date", F.col("cal_i").alias("t0"), F.coalesce("t1", "end").alias("t1"))


def windows(returns: DataFrame, at: DataFrame, days: int) -> DataFrame:
    """``returns``(ticker, cal_i, ret) of the ``days`` sessions before each date and of its period (late)."""
    spans = at.select("rebalance_date", "t0", (F.col("t0") - days).alias("low"), F.col("t1").alias("high"))
    who = seen_by(returns, "cal_i", spans, "low", "high").select("cal_i", "rebalance_date", (F.col("cal_i") >= F.col("t0")).alias("late"))
    return returns.select("ticker", "cal_i", "ret").join(who, "cal_i")


def split(pdf: pd.DataFrame, days: int, coverage: float) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(tickers, before, after) of a date's rows: the tickers with ``coverage`` of the window."""
    wide = pdf.pivot_table(index=["late", "cal_i"], columns="ticker", values="ret", aggfunc="first").sort_index()
    late = wide.index.get_level_values("late").to_numpy(bool)
    names = wide.columns[wide[~late].notna().sum() >= coverage * days]
    return list(names), wide.loc[~late, names].to_numpy(), wide.loc[late, names].to_numpy()


def share_losses(returns: DataFrame, at: DataFrame, target: Callable[[np.ndarray], np.ndarray], shares: Sequence[float], days: int = 252, coverage: float = 0.9) -> DataFrame:
    """(rebalance_date, share, gmv, qlike): what each share of the target correlation would have cost in the
    period after the date: the variance of the least-variance portfolio, and the Gaussian loss."""
    schema = "rebalance_date date, share double, gmv double, qlike double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names, x, after = split(pdf, days, coverage)
        rows = []
        if len(names) > 1 and len(after):
            y, z = covariance.centred(x), np.nan_to_num(after)
            s, realised = y.T @ y / len(y), z.T @ z / len(z)
            prior = covariance.from_corr(target(x), s)
            for share in shares:
                mix = share * prior + (1 - share) * s
                w = portfolio.min_variance_free(mix)
                loss = covariance.qlike(mix, realised)
                rows.append((pdf["rebalance_date"].iloc[0], float(share), float((z @ w).var()), loss))
        return pd.DataFrame(rows, columns=["rebalance_date", "share", "gmv", "qlike"])

    return windows(returns, at, days).groupBy("rebalance_date").applyInPandas(one, schema)


def chosen_shares(told: DataFrame, criterion: str = "gmv", last: int = 12, least: int = 3) -> DataFrame:
    """(rebalance_date, share): the share of the least summed loss over the ``last`` dates before; null with
    fewer than ``least``, where the analytical share serves. Ties go to the smaller share."""
    before = W.partitionBy("share").orderBy("rebalance_date").rowsBetween(-last, -1)  # a row a date
    summed = told.withColumns({"_n": F.count(criterion).over(before), "_sum": F.sum(criterion).over(before)})
    best = F.min_by(F.when(F.col("_n") >= least, F.col("share")), F.struct(F.coalesce("_sum", F.lit(float("inf"))), F.col("share")))
    return summed.groupBy("rebalance_date").agg(best.alias("share"))


def grid(returns: DataFrame, at: DataFrame, estimators: Sequence[str], models: Sequence[str], days: int = 252, coverage: float = 0.9, high: float = 1.0, linked: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """(rebalance_date, est, port, tickers, weights, losses): every estimator with every portfolio at every
    date, and the estimator's losses in the period after. ``linked`` tells which pairs had news."""
    names_of_losses = ["qlike", "frob_cov", "frob_corr", "err_linked", "err_unlinked", "spearman", "cond"]
    schema = "rebalance_date date, est string, port string, tickers array<string>, weights array<double>, " + ", ".join(f"{n} double" for n in names_of_losses)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names, x, after = split(pdf, days, coverage)
        rows = []
        if len(names) > 1 and len(names) * high >= 1:
            news = linked(names) if linked else np.zeros((len(names), len(names)), bool)
            corr = pd.DataFrame(after).corr(min_periods=5).to_numpy()
            for est in estimators:
                s = covariance.make(est)(x)
                lost = covariance.losses(s, after, news, corr) if len(after) else dict.fromkeys(names_of_losses, np.nan)
                mu = portfolio.shrunk_mean(np.nan_to_num(x), s)
                for port in models:
                    w = portfolio.min_variance_free(s) if port == "gmv" else portfolio.MODELS[port](s, mu, low=0.0, high=high)
                    rows.append((pdf["rebalance_date"].iloc[0], est, port, names, [float(v) for v in w], *[lost[n] for n in names_of_losses]))
        return pd.DataFrame(rows, columns=["rebalance_date", "est", "port", "tickers", "weights", *names_of_losses])

    out = windows(returns, at, days).groupBy("rebalance_date").applyInPandas(one, schema)
    return out.replace(float("nan"), None, subset=names_of_losses)


def book(returns: DataFrame, runs: DataFrame, at: DataFrame, estimators: Sequence[str], models: Sequence[str], cost: float = 0.001) -> DataFrame:
    """(date, est, port, gross, net) of every run of ``grid``, a written table; ``returns`` is (ticker, date, cal_i, ret)."""
    flat = runs.select("rebalance_date", "est", "port", F.explode(F.arrays_zip("tickers", "weights")).alias("p")).select("rebalance_date", "est", "port", F.col("p.tickers").alias("ticker"), F.col("p.weights").alias("weight"))
    dates = at.select("rebalance_date", F.col("t0").alias("cal_i"))
    own = [backtest.hold(returns, flat.filter((F.col("est") == e) & (F.col("port") == m)).select("rebalance_date", "ticker", "weight"), dates, cost)[0]
           .select("date", F.lit(e).alias("est"), F.lit(m).alias("port"), "gross", "net") for e in estimators for m in models]
    return materialise(reduce(DataFrame.unionByName, own), "book")
