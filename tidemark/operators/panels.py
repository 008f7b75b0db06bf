"""Panels of pairs and runs: features and correlations of pairs, regressions across them, sentiment.

Dates on which a panel is taken are few; what each of them sees is found by joining them with the
distinct days once, and rows then meet their dates by an equal day.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.scratch import materialise
from . import inference, market, matrices, relational
from .graph import both_directions, decay

#: Relation classes that act alike on how two prices move together.
GROUPS = {"chain": ("supply_chain", "partnership"), "rivalry": ("competition",), "control": ("ma", "ownership"), "impact": ("impact",)}
OTHER = "other_rel"
#: Kinds of agents that sentiment is taken of, names left out, events needed.
MACRO_KINDS = ("central_bank", "government", "country", "macro", "currency", "commodity", "index")
ADR = r"\bADRs?\b"
MIN_EVENTS = 50


def class_group(rel_class: Column, groups: dict[str, Sequence[str]] = GROUPS) -> Column:
    """The group of a relation class."""
    out = F.lit(OTHER)
    for name, classes in groups.items():
        out = F.when(rel_class.isin(*classes), name).otherwise(out)
    return out


def pair_features(events: DataFrame, members: DataFrame, listed: DataFrame, mentions: DataFrame, sectors: DataFrame, asof: str, days: int = 365, half_life: float = 90.0, groups: dict[str, Sequence[str]] = GROUPS) -> DataFrame:
    """(i, j, feature, value) of every two members i < j that have one, as of a day.

    direct_<group>: decayed strength of the events between them; exposure: cosine of their decayed
    strengths towards agents that aren't members, by inverse frequency among ``listed`` nodes;
    cooccur: documents with events of both; comention: documents that mention both; same_<column>:
    1 where a column of ``sectors``(node, ...) is equal. ``mentions`` is (doc_id, node, dt). Pairs
    are at most the square of the members, which are a universe.
    """
    day = F.lit(asof).cast("date")
    own, listed = members.select("node").distinct(), listed.select("node").distinct()
    recent = (F.col("dt") < day) & (F.col("dt") >= F.date_sub(day, days))
    seen = events.filter(recent).withColumn("w", F.col("strength") * decay(F.datediff(day, "dt"), half_life))
    seen = materialise(seen.select("src", "dst", "doc_id", "rel_class", "w"), "seen")  # read five times below
    as_src, as_dst = own.withColumnRenamed("node", "src"), own.withColumnRenamed("node", "dst")
    linked = seen.filter("src <> dst").join(as_src, "src", "left_semi").join(as_dst, "dst", "left_semi")
    feature = F.concat(F.lit("direct_"), class_group(F.col("rel_class"), groups)).alias("feature")
    direct = linked.groupBy(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"), feature).agg(F.sum("w").alias("value"))

    ends = both_directions(seen.select("src", "dst", "doc_id", "w"))
    of_listed = ends.join(listed, "node", "left_semi")
    df = of_listed.groupBy("other").agg(F.count_distinct("node").alias("df"))
    total = F.broadcast(of_listed.agg(F.count_distinct("node").alias("total")))  # one row
    inside = ends.join(own, "node", "left_semi")
    outside = inside.join(own.withColumnRenamed("node", "other"), "other", "left_anti").groupBy("node", "other").agg(F.sum("w").alias("w"))
    cells = outside.join(df, "other").crossJoin(total).select("node", F.col("other").alias("agent"), F.greatest(F.col("w") * F.ln(F.col("total") / F.col("df")), F.lit(0.0)).alias("x"))
    exposure = matrices.projection(cells.filter("x > 0")).select("i", "j", F.lit("exposure").alias("feature"), F.col("cosine").alias("value"))

    def together(rows: DataFrame, name: str) -> DataFrame:
        return matrices.cooccurrence(rows, "doc_id", "node").select("i", "j", F.lit(name).alias("feature"), F.col("n").cast("double").alias("value"))

    out = direct.unionByName(exposure).unionByName(together(inside, "cooccur"))
    out = out.unionByName(together(mentions.filter(recent).join(own, "node", "left_semi"), "comention"))
    known = sectors.join(own, "node", "left_semi")
    for name in (c for c in sectors.columns if c != "node"):
        a, b = known.select(F.col("node").alias("i"), name), known.select(F.col("node").alias("j"), name)
        same = a.join(b, name).filter("i < j").distinct()
        out = out.unionByName(same.select("i", "j", F.lit(f"same_{name}").alias("feature"), F.lit(1.0).alias("value")))
    return out


def seen_by(days: DataFrame, day: str, dates: DataFrame, low: str, high: str) -> DataFrame:
    """(day, ...columns of ``dates``) of each distinct day in [low, high) of a date. A row a day and date."""
    own = days.select(day).distinct()
    return own.join(F.broadcast(dates), (F.col(day) >= F.col(low)) & (F.col(day) < F.col(high)))


def pair_panel(returns: DataFrame, rebalances: DataFrame, features: DataFrame | None = None, days: int = 252, least_before: int = 126, least_after: int = 15, names: Sequence[str] | None = None) -> DataFrame:
    """(rebalance_date, i, j, z_before, z_after, n_after, ...features): Fisher z of the correlations of two
    tickers in the ``days`` sessions before each date and from it to the next date.

    ``returns`` is (ticker, cal_i, ret) and ``rebalances`` (rebalance_date, t0, t1), where t1 is the
    next date's session. Pairs with too few common sessions or a correlation of 1 are left out.
    ``features`` is (rebalance_date, i, j, feature, value); values become log1p, those named
    ``same_`` and ``exposure`` stay, and what a pair doesn't have is 0. ``names`` are the features to take
    (all that occur if none), so that an empty table has their columns too.
    """
    spans = rebalances.select("rebalance_date", (F.col("t0") - days).alias("low"), F.col("t0").alias("high"), F.lit("before").alias("side"))
    spans = spans.unionByName(rebalances.select("rebalance_date", F.col("t0").alias("low"), F.col("t1").alias("high"), F.lit("after").alias("side")))
    who = seen_by(returns, "cal_i", spans, "low", "high").select("cal_i", "rebalance_date", "side")
    r = returns.filter("ret IS NOT NULL").select("ticker", "cal_i", "ret")
    both = r.toDF("i", "cal_i", "x").join(r.toDF("j", "cal_i", "y"), "cal_i").filter("i < j").join(who, "cal_i")
    c = both.groupBy("rebalance_date", "i", "j").agg(*[
        f.alias(f"{k}_{s}") for s in ("before", "after")
        for k, f in (("n", F.count_if(F.col("side") == s)), ("c", F.corr(F.when(F.col("side") == s, F.col("x")), F.when(F.col("side") == s, F.col("y")))))])
    c = c.filter((F.col("n_before") >= least_before) & (F.col("n_after") >= least_after) & (F.abs("c_before") < 1) & (F.abs("c_after") < 1))
    out = c.select("rebalance_date", "i", "j", F.atanh("c_before").alias("z_before"), F.atanh("c_after").alias("z_after"), "n_after")
    if features is None:
        return out
    raw = F.col("feature").startswith("same_") | (F.col("feature") == "exposure")
    wide = features.withColumn("value", F.when(raw, F.col("value")).otherwise(F.log1p("value"))).groupBy("rebalance_date", "i", "j").pivot("feature", list(names) if names else None).agg(F.first("value"))
    return out.join(wide, ["rebalance_date", "i", "j"], "left").na.fill(0.0, [c for c in wide.columns if c not in ("rebalance_date", "i", "j")])


def cross_sections(panel: DataFrame, date: str, y: str, xs: Sequence[str], least: int = 2) -> DataFrame:
    """(date, n, name, coef, r2): each date's regression of y on its standardised xs.

    Rows with a null take no part. One aggregation gives each date's moments; the regressions are
    solved on a row a date. A regressor without variance has the coefficient 0, and of regressors
    that determine each other the solution is the shortest.
    """
    k = len(xs)
    rows = panel.dropna(subset=[y, *xs])
    moments = [F.covar_pop(a, b).alias(f"m{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs) if i <= j]
    moments += [F.covar_pop(a, y).alias(f"c{i}") for i, a in enumerate(xs)] + [F.var_pop(y).alias("v"), F.count("*").alias("n")]
    own = rows.groupBy(F.col(date).alias("date")).agg(*moments).filter(F.col("n") >= least)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                s = np.array([[getattr(row, f"m{min(i, j)}_{max(i, j)}") for j in range(k)] for i in range(k)])
                sd = np.sqrt(np.maximum(np.diag(s), 0))
                unit = np.divide(1, sd, out=np.zeros(k), where=sd > 0)
                c = np.array([getattr(row, f"c{i}") for i in range(k)]) * unit
                b = np.linalg.pinv(s * np.outer(unit, unit), hermitian=True) @ c
                out += [(row.date, row.n, name, b[i], float(b @ c / row.v) if row.v > 0 else None) for i, name in enumerate(xs)]
            yield pd.DataFrame(out, columns=["date", "n", "name", "coef", "r2"])

    return own.mapInPandas(solve, f"date {own.schema['date'].dataType.simpleString()}, n long, name string, coef double, r2 double").withColumnRenamed("date", date)


def fama_macbeth_many(panel: DataFrame, date: str, y: str, xs: Sequence[str], lags: int = 6, least: int = 2) -> DataFrame:
    """(name, n, mean, t, r2): means over the dates of the regressions' coefficients, their Newey-West t
    and the mean r2."""
    coefs = cross_sections(panel, date, y, xs, least)
    tests = inference.newey_west(coefs, "name", date, "coef", lags).drop("lrv")
    return tests.join(coefs.groupBy("name").agg(F.avg("r2").alias("r2")), "name")


def rank_correlation(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, n, spearman): correlation of the average ranks within a key, over rows that have both."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    place = lambda c: F.rank().over(W.partitionBy(key).orderBy(c)) + (F.count("*").over(W.partitionBy(key, c)) - 1) / 2.0
    ranked = rows.withColumn("_x", place(x)).withColumn("_y", place(y))
    return ranked.groupBy(key).agg(F.count("*").alias("n"), F.corr("_x", "_y").alias("spearman"))


def compare_runs(runs: DataFrame, base: str, year: int = 252) -> DataFrame:
    """(run, n, var_ratio, sharpe_diff, active_return, active_vol) of each run(run, date, ret) against the
    run ``base``, over the days that all runs have."""
    total = F.broadcast(runs.agg(F.count_distinct("run").alias("_all")))  # one row
    common = runs.groupBy("date").agg(F.count_distinct("run").alias("_n")).crossJoin(total).filter("_n = _all").select("date")
    own = runs.join(common, "date", "left_semi")
    both = own.filter(F.col("run") != base).join(own.filter(F.col("run") == base).select("date", F.col("ret").alias("b")), "date").withColumn("d", F.col("ret") - F.col("b"))
    root = F.sqrt(F.lit(float(year)))
    sharpe = lambda c: F.avg(c) / F.stddev_samp(c) * root
    return both.groupBy("run").agg(
        F.count("*").alias("n"), (F.var_samp("ret") / F.var_samp("b")).alias("var_ratio"), (sharpe("ret") - sharpe("b")).alias("sharpe_diff"),
        (F.avg("d") * year).alias("active_return"), (F.stddev_samp("d") * root).alias("active_vol"))


def net_returns(daily: DataFrame, cost: float = 0.001, keys: Sequence[str] | None = None) -> DataFrame:
    """A row a date, a column ``estimator|portfolio``: (1 - cost * turnover)(1 + gross) - 1."""
    r = daily.select("date", F.concat_ws("|", "est", "port").alias("key"), ((1 - cost * F.col("turnover")) * (1 + F.col("gross")) - 1).alias("r"))
    return r.groupBy("date").pivot("key", list(keys) if keys else None).agg(F.first("r"))


def macro_agents(nodes: DataFrame) -> DataFrame:
    """The nodes (node, kind, label, ticker, n_events) that sentiment is taken of: without a ticker, of a
    macroeconomic kind, with enough events, and no depositary receipt by name."""
    return nodes.filter(F.col("ticker").isNull() & (F.col("n_events") >= MIN_EVENTS) & F.col("kind").isin(*MACRO_KINDS) & ~F.col("label").rlike(ADR))


def sentiment_factors(events: DataFrame, agents: DataFrame, calendar: DataFrame) -> DataFrame:
    """(session, agent, f, n): net signed strength of an agent's events that a session is the first after.

    Events of a day count from the next session on; loops don't count.
    """
    ends = both_directions(events.filter("src <> dst").select("src", "dst", "dt", "w")).join(agents.select("node"), "node", "left_semi")
    daily = ends.groupBy("dt", F.col("node").alias("agent")).agg(F.sum("w").alias("w"), F.count("*").alias("c"))
    return relational.next_day(daily, calendar, "dt", "session").groupBy("session", "agent").agg(F.sum("w").alias("f"), F.sum("c").alias("n"))


def chosen_agents(n: np.ndarray, names: Sequence[str], fixed: Sequence[str], top: int) -> list[int]:
    """The fixed agents, then the ``top`` others of most events ``n``, ties by name."""
    own = [names.index(a) for a in fixed if a in names]
    rest = sorted(set(range(len(names))) - set(own), key=lambda k: (-n[k], names[k]))
    return own + rest[:top]


def masked_regressions(y: np.ndarray, x: np.ndarray):
    """For each column of y (NaN where missing): (n, coefficients, standard errors, r2) on a constant and x.

    Columns without a gap share one solution. Standard errors are NaN without degrees of freedom.
    """
    design = np.column_stack([np.ones(len(x)), x])
    have = np.isfinite(y)
    out: list = [None] * y.shape[1]
    whole = have.all(axis=0)
    for own in [np.flatnonzero(whole), *[np.array([k]) for k in np.flatnonzero(~whole)]]:
        if not len(own):
            continue
        at = have[:, own[0]]
        a, b = design[at], y[np.ix_(at, own)]
        inverse = np.linalg.pinv(a)
        beta = inverse @ b
        left = ((b - a @ beta) ** 2).sum(axis=0)
        free = len(a) - a.shape[1]
        spread = (inverse**2).sum(axis=1)
        centre = ((b - b.mean(axis=0)) ** 2).sum(axis=0) if len(b) else np.zeros(len(own))
        for c, k in enumerate(own):
            se = np.sqrt(spread * left[c] / free) if free > 0 else np.full(len(spread), np.nan)
            out[k] = (len(a), beta[:, c], se, 1 - left[c] / centre[c] if centre[c] > 0 else np.nan)
    return out


_FITS = "cal_i long, ticker string, n_obs long, alpha double, r2 double, slot int, agent string, beta double, se double, t double"


#: agents that one task counts in the windows of the whole calendar at once
AGENTS = 256


def rolling_choice(factors: DataFrame, window: int, last: int, top: int, block: int, agents: int = AGENTS) -> DataFrame:
    """(cal_i, agent, total): for each session the ``top`` agents of most ``n`` in the ``window`` sessions before it,
    ties by name, among those with a row that some window of the session's block sees.

    ``factors`` is (cal_i, agent, n). Agents are dealt over groups of about ``agents``, each of which gives
    its own ``top`` a session, so the ``top`` of all are among them.
    """
    groups = max(1, -(-factors.agg(F.count_distinct("agent")).first()[0] // agents))
    low = factors.agg(F.min("cal_i")).first()[0] or 0

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["agent"]))
        size, begin = len(names), int(low)
        at = pdf["agent"].map({a: k for k, a in enumerate(names)}).to_numpy()
        day = pdf["cal_i"].to_numpy() - begin
        held = np.zeros((max(last + block - begin, 0) + 2, size), np.int64)  # counts of the days before a day, then held sums
        known = np.zeros(held.shape, np.int32)
        ok = day < len(held) - 1
        np.add.at(held, (day[ok] + 1, at[ok]), pdf["n"].to_numpy()[ok])
        np.add.at(known, (day[ok] + 1, at[ok]), 1)
        held, known = held.cumsum(axis=0), known.cumsum(axis=0, dtype=np.int32)
        until = lambda x, t: x[min(max(t - begin, 0), len(x) - 1)]  # noqa: E731  the sum over the sessions before t
        days, chosen, totals = [], [], []
        for t in range(begin + 1, last + 1):
            b = t // block
            seen = np.flatnonzero(until(known, (b + 1) * block - 1) > until(known, b * block - window))
            n = until(held, t)[seen] - until(held, t - window)[seen]
            if len(seen) > top:
                least = np.partition(n, len(n) - top)[len(n) - top]
                seen, n = seen[n >= least], n[n >= least]
            order = np.lexsort((seen, -n))[:top]
            days += [t] * len(order)
            chosen += seen[order].tolist()
            totals += n[order].tolist()
        return pd.DataFrame({"cal_i": np.array(days, np.int64), "agent": [names[k] for k in chosen], "total": np.array(totals, np.int64)})

    told = factors.select(F.col("cal_i").cast("long").alias("cal_i"), "agent", F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n"))
    own = told.groupBy(F.pmod(F.xxhash64("agent"), F.lit(groups))).applyInPandas(one, "cal_i long, agent string, total long")
    rank = F.row_number().over(W.partitionBy("cal_i").orderBy(F.desc("total"), "agent"))
    return own.withColumn("_rank", rank).filter(F.col("_rank") <= top).drop("_rank")


def rolling_regressions(returns: DataFrame, factors: DataFrame, window: int = 252, fixed: Sequence[str] = (), top: int = 6, coverage: float = 0.95, block: int = 63, buckets: int = 16) -> DataFrame:
    """Each session's regressions of each ticker's last ``window`` returns on the sentiment of the agents
    chosen at it: a row a slot, null where the agent's factor doesn't vary.

    ``returns`` is (ticker, cal_i, ret), ``factors`` (cal_i, agent, f, n). Sessions go to tasks in
    blocks, tickers in buckets, so a return is copied window / block + 1 times and a task holds
    window + block sessions of its tickers and of the agents chosen at some session of its block, which are
    block * ``top`` and the ``fixed`` at most. Tickers need ``coverage`` of the window. The first window of
    the calendar has no regressions.
    """
    factors = materialise(factors.select("agent", F.col("cal_i").cast("long").alias("cal_i"), "f", "n"), "factors")  # read four times below
    last = returns.agg(F.max("cal_i")).first()[0]
    choice = rolling_choice(factors.filter(~F.col("agent").isin(*fixed)) if fixed else factors, window, -1 if last is None else int(last), top, block)
    blocks = F.explode(F.sequence(F.floor((F.col("cal_i") + 1) / block), F.floor((F.col("cal_i") + window) / block))).alias("block")
    bucket = F.pmod(F.xxhash64("ticker"), F.lit(buckets)).alias("bucket")
    left = returns.select("ticker", F.col("cal_i").cast("long").alias("cal_i"), "ret", blocks, bucket)
    choice = materialise(choice.select(F.floor(F.col("cal_i") / block).alias("block"), "agent").distinct(), "choice")
    kept = factors.join(choice.select("agent").distinct(), "agent", "left_semi").select("agent", "cal_i", "f", "n", blocks).join(choice, ["block", "agent"], "left_semi")
    right = kept.select("agent", "cal_i", "f", "n", "block")
    if fixed:
        right = right.unionByName(factors.filter(F.col("agent").isin(*fixed)).select("agent", "cal_i", "f", "n", blocks))
    right = right.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"))
    ends = F.broadcast(returns.agg(F.min("cal_i").cast("long").alias("first"), F.max("cal_i").cast("long").alias("last")))  # one row
    left = left.crossJoin(ends)

    def one(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(own):
            b, first, last = int(own["block"].iloc[0]), int(own["first"].iloc[0]), int(own["last"].iloc[0])
            start = max(b * block, first + window)
            days = np.arange(start - window, min((b + 1) * block, last + 1))
            y = own.pivot_table(index="cal_i", columns="ticker", values="ret", aggfunc="first").reindex(days)
            names = sorted(set(told["agent"]))
            grid = lambda c: told.pivot_table(index="cal_i", columns="agent", values=c, aggfunc="sum").reindex(index=days, columns=names).fillna(0).to_numpy()
            f, n = (grid("f"), grid("n")) if names else (np.zeros((len(days), 0)),) * 2
            for at in range(window, len(days)):
                part = slice(at - window, at)
                slots = chosen_agents(n[part].sum(axis=0), names, fixed, top)
                x = f[part][:, slots]
                moves = x.var(axis=0) > 1e-12
                values = y.iloc[part]
                values = values.loc[:, values.notna().mean() >= coverage]
                place = np.cumsum(moves)  # after the constant
                for ticker, fit in zip(values.columns, masked_regressions(values.to_numpy(), x[:, moves])):
                    for s, k in enumerate(slots):
                        beta, se = (fit[1][place[s]], fit[2][place[s]]) if moves[s] else (np.nan, np.nan)
                        rows.append((days[at], ticker, fit[0], fit[1][0], fit[3], s + 1, names[k], beta, se, beta / se if se else np.nan))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in _FITS.split(", ")])
        return out.astype({"cal_i": "int64", "n_obs": "int64", "slot": "int32"})

    fits = left.groupBy("block", "bucket").cogroup(right.groupBy("block", "bucket")).applyInPandas(one, _FITS)
    return fits.replace(float("nan"), None, subset=["r2", "beta", "se", "t"])


def residual_returns(returns: DataFrame) -> DataFrame:
    """``returns`` with what the market doesn't tell as ret, for a panel of residual correlations."""
    return returns.drop("ret").join(market.residuals(returns).withColumnRenamed("resid", "ret"), ["ticker", "date"])


def expanding_fits(panel: DataFrame, date: str, y: str, xs: Sequence[str], train: int, nonnegative: bool = False) -> DataFrame:
    """(date, n, coefs, sse, sst): the pooled regression of y on the xs, both centred within their date, over all
    dates before each, and how far it is from the date's own centred y. Dates with fewer than ``train``
    dates before them have null coefs and sse.

    One aggregation gives each date's moments; what a date learns is a running sum over a row a date.
    """
    from ..kernels.covariance import nonnegative_least_squares

    k = len(xs)
    rows = panel.dropna(subset=[y, *xs])
    n = F.count("*")
    cells = [f"s{i}_{j}" for i in range(k) for j in range(i, k)] + [f"c{i}" for i in range(k)]
    sums = [(n * F.covar_pop(xs[i], xs[j])).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)] + [(n * F.covar_pop(x, y)).alias(f"c{i}") for i, x in enumerate(xs)]
    own = rows.groupBy(F.col(date).alias("date")).agg(*sums, (n * F.var_pop(y)).alias("sst"), n.alias("n"))
    before = W.orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    own = own.withColumns({"dates": F.count("*").over(before), **{f"b{c}": F.sum(c).over(before) for c in cells}})

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                get = lambda p, row=row: (np.array([[getattr(row, f"{p}s{min(i, j)}_{max(i, j)}") for j in range(k)] for i in range(k)], float), np.array([getattr(row, f"{p}c{i}") for i in range(k)], float))
                coefs = sse = None
                if row.dates >= train and row.dates:
                    gram, target = get("b")
                    gram = gram + 1e-9 * np.eye(k)
                    b = nonnegative_least_squares(gram, target) if nonnegative else np.linalg.solve(gram, target)
                    s, c = get("")
                    coefs, sse = b.tolist(), float(row.sst - 2 * b @ c + b @ s @ b)
                out.append((row.date, row.n, coefs, sse, row.sst))
            yield pd.DataFrame(out, columns=["date", "n", "coefs", "sse", "sst"])

    return own.mapInPandas(solve, f"date {own.schema['date'].dataType.simpleString()}, n long, coefs array<double>, sse double, sst double").withColumnRenamed("date", date)


def news_prior(panel: DataFrame, fits: DataFrame, date: str, z: str, xs: Sequence[str]) -> DataFrame:
    """(date, i, j, r): the correlation that a date's mean z and its centred features tell, by the regression
    learnt before it; without one the features tell nothing."""
    means = panel.groupBy(date).agg(F.avg(z).alias("_z"), *[F.avg(x).alias(f"_m{k}") for k, x in enumerate(xs)])
    told = panel.join(F.broadcast(means.join(fits.select(date, "coefs"), date)), date)  # a row a date
    shift = F.lit(0.0)
    for k, x in enumerate(xs):
        shift = shift + F.coalesce(F.col("coefs")[k], F.lit(0.0)) * (F.col(x) - F.col(f"_m{k}"))
    return told.select(date, "i", "j", F.tanh(F.col("_z") + shift).alias("r"))
