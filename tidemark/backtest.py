"""Walk-forward backtests in two passes.

Pass 1, parallel over rebalance dates: each date's window of returns goes to one task, which runs a
covariance estimator and a portfolio model and returns target weights. Pass 2, relational: the
drift of a period depends on its own targets only, so drifted weights, turnover, cost and daily
returns are windows and joins, without a sequential loop.
"""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .kernels import covariance, portfolio


@dataclass
class Context:
    """What a model may see at a rebalance: returns strictly before the date."""

    date: object
    tickers: list[str]
    returns: np.ndarray
    low: float = 0.0
    high: float = 1.0
    params: dict = field(default_factory=dict)


Model = Callable[[Context], "np.ndarray | dict[str, float]"]


def load_model(spec: str) -> Model:
    """A model by name of a shipped one, as module:function or as file.py:function; a class is
    made with no arguments and its ``weights`` method is the model."""
    if spec in portfolio.MODELS:
        return shipped(spec)
    where, _, name = spec.rpartition(":")
    if where.endswith(".py"):
        own = importlib.util.spec_from_file_location("tidemark_plugin", where)
        module = importlib.util.module_from_spec(own)
        own.loader.exec_module(module)
    else:
        module = importlib.import_module(where)
    found = getattr(module, name)
    return found().weights if isinstance(found, type) else found


def shipped(name: str, estimator: str = "single_factor", **params) -> Model:
    estimate = covariance.make(estimator)

    def model(ctx: Context) -> np.ndarray:
        s = estimate(ctx.returns)
        mu = portfolio.shrunk_mean(np.nan_to_num(ctx.returns), s) if name in ("mean_variance", "max_sharpe") else None
        return portfolio.MODELS[name](s, mu, low=ctx.low, high=ctx.high, **params)

    return model


def dates_of(calendar: DataFrame, every: str = "month") -> DataFrame:
    """(rebalance_date, cal_i): the first session of each period; ``every`` may be a number of sessions."""
    if every.isdigit():
        return calendar.filter((F.col("cal_i") - 1) % int(every) == 0).select(F.col("date").alias("rebalance_date"), "cal_i")
    return calendar.groupBy(F.date_trunc(every, "date").alias("p")).agg(F.min("date").alias("rebalance_date"), F.min("cal_i").alias("cal_i")).drop("p")


def target_weights(returns: DataFrame, rebalances: DataFrame, model: Model, days: int = 252, coverage: float = 0.9, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(rebalance_date, ticker, weight) from returns(ticker, date, cal_i, ret).

    Names need ``coverage`` of the window's sessions. A date whose names can't carry the limits
    has no weights.
    """
    at = F.broadcast(rebalances.select("rebalance_date", F.col("cal_i").alias("t0")))  # a row a rebalance
    window = returns.join(at, (F.col("cal_i") >= F.col("t0") - days) & (F.col("cal_i") < F.col("t0")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot_table(index="cal_i", columns="ticker", values="ret", aggfunc="first")
        x = x.loc[:, x.notna().sum() >= coverage * days]
        empty = pd.DataFrame({"rebalance_date": pd.Series(dtype="object"), "ticker": pd.Series(dtype="object"), "weight": pd.Series(dtype="float64")})
        if x.shape[1] < 2 or x.shape[1] * high < 1:
            return empty
        w = model(Context(pdf["rebalance_date"].iloc[0], list(x.columns), x.to_numpy(), low, high))
        if isinstance(w, dict):
            w = np.array([w.get(t, 0.0) for t in x.columns])
        w = portfolio.to_box_simplex(np.asarray(w, float), low, high)
        return pd.DataFrame({"rebalance_date": pdf["rebalance_date"].iloc[0], "ticker": x.columns, "weight": w})

    return window.groupBy("rebalance_date").applyInPandas(one, "rebalance_date date, ticker string, weight double")


def hold(returns: DataFrame, weights: DataFrame, rebalances: DataFrame, cost: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """(daily, trades): daily portfolio returns net of cost on each period's first day, and each
    rebalance's turnover.

    Between rebalances positions drift; a missing return is 0. The first rebalance trades from cash.
    """
    used = weights.select("rebalance_date").distinct().join(rebalances.select("rebalance_date", "cal_i"), "rebalance_date")
    order = W.orderBy("cal_i")  # a row a rebalance
    spans = used.withColumns({"next_i": F.lead("cal_i").over(order), "next_date": F.lead("rebalance_date").over(order)}).withColumnRenamed("cal_i", "start_i")
    own = weights.join(F.broadcast(spans), "rebalance_date")
    days = returns.select("cal_i", "date").distinct().join(F.broadcast(spans), (F.col("cal_i") >= F.col("start_i")) & (F.col("next_i").isNull() | (F.col("cal_i") < F.col("next_i"))))
    grid = days.select("cal_i", "date", "rebalance_date").join(own.select("rebalance_date", "ticker", "weight", "next_date"), "rebalance_date")
    path = W.partitionBy("rebalance_date", "ticker").orderBy("cal_i")
    held = grid.join(returns.select("ticker", "cal_i", "ret"), ["ticker", "cal_i"], "left").withColumn("growth", F.exp(F.sum(F.log1p(F.coalesce("ret", F.lit(0.0)))).over(path)))
    held = held.withColumn("value", F.col("weight") * F.col("growth"))
    nav = held.groupBy("rebalance_date", "cal_i", "date").agg(F.sum("value").alias("nav"))
    before = F.lag("nav").over(W.partitionBy("rebalance_date").orderBy("cal_i"))
    gross = nav.withColumns({"gross": F.col("nav") / F.coalesce(before, F.lit(1.0)) - 1, "first": before.isNull()})
    end = held.groupBy("rebalance_date", "ticker", "next_date").agg(F.max_by("value", "cal_i").alias("value")).filter("next_date IS NOT NULL")
    drifted = end.select(F.col("next_date").alias("rebalance_date"), "ticker", (F.col("value") / F.sum("value").over(W.partitionBy("next_date"))).alias("drifted"))
    both = weights.join(drifted, ["rebalance_date", "ticker"], "full")
    trades = both.groupBy("rebalance_date").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("drifted", F.lit(0.0)))).alias("turnover"))
    net = F.when(F.col("first"), (1 - cost * F.col("turnover")) * (1 + F.col("gross")) - 1).otherwise(F.col("gross"))
    daily = gross.join(F.broadcast(trades), "rebalance_date").select("date", "rebalance_date", F.col("gross"), net.alias("net"))
    return daily, trades


def simulate(returns: pd.DataFrame, weights: dict, cost: float = 0.001) -> pd.Series:
    """The same, a day at a time in plain Python; for tests."""
    book: dict[str, float] = {}
    out = {}
    wide = returns.pivot(index="date", columns="ticker", values="ret").fillna(0.0)
    started = False
    for day, row in wide.iterrows():
        drag = 0.0
        if day in weights:
            new = weights[day]
            drag = cost * sum(abs(new.get(t, 0) - book.get(t, 0)) for t in {*new, *book})
            book, started = dict(new), True
        if started:
            g = sum(w * row.get(t, 0.0) for t, w in book.items())
            book = {t: w * (1 + row.get(t, 0.0)) / (1 + g) for t, w in book.items()}
            out[day] = (1 - drag) * (1 + g) - 1
    return pd.Series(out)
