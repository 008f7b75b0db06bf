"""Panels, expanding regressions, sentiment and walk-forward studies against loops; the kernels' closed forms."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import walkforward as WF
from tidemark.kernels import covariance as C, portfolio
from tidemark.operators import matrices as MX, panels as P


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(4)
    return rng.normal(0, 0.01, (200, 1)) + rng.normal(0, 0.01, (200, 9))


def test_shrinker_is_shrink_to_corr(x):
    prepared = C.shrinker(x)
    for r in (np.eye(9), np.full((9, 9), 0.3) + 0.7 * np.eye(9), C.to_corr(C.single_factor(x))):
        assert np.allclose(prepared(r), C.shrink_to_corr(x, r), rtol=1e-10)


def test_loadings_and_spans(x):
    top = C.principal_loadings(x, 3)
    assert np.allclose(C.on_loadings(x, np.eye(9)), C.sample(x))
    assert np.allclose(np.diag(C.on_loadings(x, top)), np.diag(C.sample(x)))  # the rest is orthogonal to the factors
    assert np.allclose(C.subspace_cosines(top, top @ np.array([[1.0, 2, 0], [0, 1, 5], [0, 0, 1]])), 1)
    assert np.allclose(C.subspace_cosines(np.eye(9)[:, :2], np.eye(9)[:, 1:3]), [1, 0])
    assert C.principal_loadings(x, 2, np.ones((9, 1))).shape == (9, 3)


def test_smooth_vectors_tell_groups_apart():
    links = np.kron(np.eye(2), np.ones((4, 4))) - 0.2 * np.kron(1 - np.eye(2), np.ones((4, 4)))
    v = C.smooth_vectors(links, 1)[:, 0]
    assert len(set(np.sign(v[:4]))) == 1 and np.sign(v[0]) == -np.sign(v[4])
    assert np.isfinite(C.smooth_vectors(np.eye(3), 2)).all()  # no links at all


def test_group_factors(x):
    f = C.group_factors(x, np.array([0, 0, 0, 1, 1, 2, 2, 2, 2]))
    assert f.shape == (200, 3) and np.allclose(f[:, 1], x[:, :3].mean(axis=1) - x.mean(axis=1))
    assert C.group_factors(x, np.full(9, -1)).shape == (200, 1)
    size = np.r_[np.nan, np.arange(8.0)]
    assert np.linalg.eigvalsh(C.style(x, np.zeros(9, int) - 1, size, np.arange(9.0)))[0] > 0
    assert np.allclose(C.tercile_factor(x, np.arange(9.0)), x[:, 6:].mean(axis=1) - x[:, :3].mean(axis=1))


def test_losses(x):
    realised = x.T @ x / len(x)
    corr = np.corrcoef(x.T)
    got = C.losses(realised, x, np.zeros((9, 9), bool), C.to_corr(realised))
    assert got["frob_cov"] < 1e-20 and got["frob_corr"] < 1e-20 and got["spearman"] == pytest.approx(1) and np.isnan(got["err_linked"])
    linked = np.zeros((9, 9), bool)
    linked[0, 1] = linked[1, 0] = True
    got = C.losses(C.identity(x), x, linked, corr)
    assert got["err_linked"] == pytest.approx((C.to_corr(C.identity(x))[0, 1] - corr[0, 1]) ** 2)
    v = np.array([3.0, 1, 3, 2, 1])
    assert np.allclose(C.rank_average(v), pd.Series(v).rank())


def test_nonnegative_least_squares():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a = rng.normal(size=(12, 4))
        gram, target = a.T @ a, a.T @ rng.normal(size=12)
        best = np.inf
        for keep in itertools.chain.from_iterable(itertools.combinations(range(4), n) for n in range(5)):
            b = np.zeros(4)
            if keep:
                b[list(keep)] = np.linalg.solve(gram[np.ix_(keep, keep)], target[list(keep)])
            if (b >= 0).all():
                best = min(best, b @ gram @ b / 2 - target @ b)
        b = C.nonnegative_least_squares(gram, target)
        assert (b >= 0).all() and b @ gram @ b / 2 - target @ b == pytest.approx(best, abs=1e-9)


def _panel(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"t": np.repeat(np.arange(6), 15), "a": rng.normal(size=90), "b": rng.normal(size=90), "c": 2.0})
    pdf["y"] = 0.5 * pdf["a"] - pdf["b"] + rng.normal(size=90)
    rows = [(int(r.t), float(r.a), float(r.b), float(r.c), float(r.y)) for r in pdf.itertuples()]
    return pdf, spark.createDataFrame(rows + [(0, None, 1.0, 2.0, 3.0)], "t long, a double, b double, c double, y double")


def test_cross_sections_against_least_squares(spark):
    pdf, df = _panel(spark)
    got = {(r.t, r.name): (r.coef, r.r2) for r in P.cross_sections(df, "t", "y", ["a", "b", "c"]).collect()}
    for t, own in pdf.groupby("t"):
        z = (own[["a", "b"]] - own[["a", "b"]].mean()) / own[["a", "b"]].std(ddof=0)
        design = np.column_stack([np.ones(len(own)), z])
        beta = np.linalg.lstsq(design, own["y"], rcond=None)[0]
        r2 = 1 - ((own["y"] - design @ beta) ** 2).sum() / ((own["y"] - own["y"].mean()) ** 2).sum()
        assert np.allclose([got[t, "a"][0], got[t, "b"][0], got[t, "c"][0]], [*beta[1:], 0]) and got[t, "a"][1] == pytest.approx(r2)
    tests = {r.name: r for r in P.fama_macbeth_many(df, "t", "y", ["a", "b"], lags=2).collect()}
    assert tests["a"].n == 6 and tests["b"].mean < 0
    assert P.cross_sections(df.limit(0), "t", "y", ["a"]).count() == 0


@pytest.mark.parametrize("nonnegative", [False, True])
def test_expanding_fits_against_a_loop(spark, nonnegative):
    pdf, df = _panel(spark)
    got = {r.t: r for r in P.expanding_fits(df, "t", "y", ["a", "b"], 2, nonnegative).collect()}
    centred = pdf[["t", "a", "b", "y"]].copy()
    centred[["a", "b", "y"]] -= pdf.groupby("t")[["a", "b", "y"]].transform("mean")
    assert got[1].coefs is None and got[1].sse is None
    for t in range(2, 6):
        past, own = centred[centred.t < t], centred[centred.t == t]
        gram, target = past[["a", "b"]].T @ past[["a", "b"]], past[["a", "b"]].T @ past["y"]
        b = np.linalg.solve(gram, target)
        if nonnegative:
            b = np.array([max(0, target["a"] / gram.loc["a", "a"]), 0.0])
        assert np.allclose(got[t].coefs, b, atol=1e-6)
        assert got[t].sse == pytest.approx(((own["y"] - own[["a", "b"]].to_numpy() @ b) ** 2).sum(), rel=1e-6)


def test_rolling_regressions_against_a_loop(spark):
    rng = np.random.default_rng(2)
    days, names = 45, ["A", "B", "C"]
    y = rng.normal(size=(days, 3))
    y[rng.random(y.shape) < 0.05] = np.nan
    agents = ["p", "q", "r", "z"]
    f, n = rng.normal(size=(days, 4)), rng.integers(0, 3, (days, 4))
    f[n == 0] = 0
    f[:, 3] = 0  # z never moves
    r = spark.createDataFrame([(t, i + 1, float(y[i, k])) for i in range(days) for k, t in enumerate(names) if np.isfinite(y[i, k])], "ticker string, cal_i int, ret double")
    told = spark.createDataFrame([(i + 1, a, float(f[i, k]), int(n[i, k])) for i in range(days) for k, a in enumerate(agents) if n[i, k]], "cal_i int, agent string, f double, n long")
    got = {(g.cal_i, g.ticker, g.agent): g for g in P.rolling_regressions(r, told, 20, ["z"], 2, 0.8, block=7, buckets=2).collect()}
    seen = 0
    for i in range(20, days):
        part = slice(i - 20, i)
        chosen = [3, *sorted(range(3), key=lambda k: (-n[part, k].sum(), agents[k]))[:2]]
        for k, t in enumerate(names):
            ok = np.isfinite(y[part, k])
            if ok.mean() < 0.8:
                continue
            design = np.column_stack([np.ones(20), f[part][:, chosen[1:]]])[ok]
            own = y[part, k][ok]
            beta, rest = np.linalg.lstsq(design, own, rcond=None)[:2]
            se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rest[0] / (len(own) - 3))
            for s, a in enumerate(chosen):
                g = got[i + 1, t, agents[a]]
                seen += 1
                assert g.slot == s + 1 and g.n_obs == len(own) and np.isclose(g.alpha, beta[0])
                assert np.isclose(g.r2, 1 - rest[0] / ((own - own.mean()) ** 2).sum())
                if s:
                    assert np.allclose([g.beta, g.se, g.t], [beta[s], se[s], beta[s] / se[s]])
                else:
                    assert g.beta is None and g.se is None and g.t is None
    assert seen == len(got) > 0


@pytest.mark.parametrize("local", [True, False])
def test_eigenvector_centrality(spark, monkeypatch, local):
    rng = np.random.default_rng(3)
    a = np.triu(rng.random((7, 7)) * (rng.random((7, 7)) < 0.6))
    a[0] = a[0] + 0.5  # connected, with loops
    w = a + np.triu(a, 1).T
    w = np.triu(w) + np.triu(w, 1).T
    links = spark.createDataFrame([(f"n{i}", f"n{j}", float(w[i, j])) for i in range(7) for j in range(i, 7) if w[i, j]], "i string, j string, w double")
    monkeypatch.setattr(MX, "LOCAL_EDGES", MX.LOCAL_EDGES if local else 0)
    tolerance = 1e-10 if local else 1e-2
    got = {r.node: r.centrality for r in MX.eigenvector_centrality(links, tolerance=tolerance).collect()}
    want = np.abs(np.linalg.eigh(w)[1][:, -1])
    assert np.allclose([got[f"n{k}"] for k in range(7)], want, atol=max(1e-6, 3 * tolerance))
    assert MX.eigenvector_centrality(links.limit(0)).count() == 0


def test_share_choice_and_books_against_loops(spark):
    rng = np.random.default_rng(5)
    days = pd.bdate_range("2020-01-01", periods=160)
    ret = rng.normal(0, 0.01, (160, 4)) + rng.normal(0, 0.01, (160, 1))
    r = spark.createDataFrame([(t, d.date(), i + 1, float(ret[i, k])) for i, d in enumerate(days) for k, t in enumerate("ABCD")], "ticker string, date date, cal_i int, ret double")
    cal = r.select("date", "cal_i").distinct()
    at = WF.periods(cal, "month")
    spans = [(x.t0, x.t1) for x in at.orderBy("t0").collect()]
    assert spans[0][0] == 1 and spans[-1][1] == 161 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    target, shares = lambda x: np.eye(x.shape[1]), [0.0, 0.5, 1.0]
    told = WF.share_losses(r, at, target, shares, days=40)
    chosen = {x.rebalance_date: x.share for x in WF.chosen_shares(told, "gmv", 3, 2).collect()}
    dates, lost = [x.rebalance_date for x in at.orderBy("t0").collect()], {}
    for date, (t0, t1) in zip(dates, spans):
        before, after = ret[max(t0 - 41, 0) : t0 - 1], ret[t0 - 1 : t1 - 1]
        if len(before) >= 36:
            y = before - before.mean(axis=0)
            s = y.T @ y / len(y)
            lost[date] = [np.var(after @ portfolio.min_variance_free(q * np.diag(np.diag(s)) + (1 - q) * s)) for q in shares]
    assert set(chosen) == set(lost)
    for k, date in enumerate(sorted(lost)):
        past = [lost[p] for p in sorted(lost)[max(k - 3, 0) : k]]
        assert chosen[date] == (shares[int(np.sum(past, axis=0).argmin())] if len(past) >= 2 else None)
    runs = WF.grid(r, at, ["sample"], ["gmv", "equal_weight"], days=40).cache()
    assert runs.filter("port = 'gmv' AND qlike IS NULL").count() == 0
    book = WF.book(r, runs, at, ["sample"], ["gmv", "equal_weight"]).toPandas()
    first = book[book.port == "equal_weight"].sort_values("date").iloc[0]
    i = list(days.date).index(first["date"])
    assert first["gross"] == pytest.approx(ret[i].mean()) and first["net"] == pytest.approx((1 - 0.001) * (1 + ret[i].mean()) - 1)


def test_groups_agents_and_prior(spark):
    df = spark.createDataFrame([("ma",), ("competition",), ("x",), (None,)], "c string")
    assert [r[0] for r in df.select(P.class_group(F.col("c"))).collect()] == ["control", "rivalry", "other_rel", "other_rel"]
    nodes = [("a", "macro", "GDP", None, 50), ("b", "macro", "GDP", None, 49), ("c", "macro", "Some ADR", None, 99), ("d", "person", "x", None, 99), ("e", "index", "x", "T", 99)]
    assert [r.node for r in P.macro_agents(spark.createDataFrame(nodes, "node string, kind string, label string, ticker string, n_events long")).collect()] == ["a"]
    panel = spark.createDataFrame([(1, "a", "b", 0.2, 1.0), (1, "a", "c", 0.4, 3.0), (2, "a", "b", 0.1, 1.0)], "t int, i string, j string, z double, f double")
    fits = spark.createDataFrame([(1, [0.5]), (2, None)], "t int, coefs array<double>")
    got = {(r.t, r.j): r.r for r in P.news_prior(panel, fits, "t", "z", ["f"]).collect()}
    assert got[1, "b"] == pytest.approx(np.tanh(0.3 - 0.5)) and got[1, "c"] == pytest.approx(np.tanh(0.8)) and got[2, "b"] == pytest.approx(np.tanh(0.1))


@pytest.mark.parametrize("agents, block", [(3, 7), (100, 5)])
def test_agents_are_chosen_before_they_are_copied(spark, agents, block):
    """The most told of each window, whatever group of agents they are counted in."""
    rng = np.random.default_rng(4)
    days, size, window, top = 40, 30, 12, 4
    n = np.where(rng.random((days, size)) < 0.15, rng.integers(1, 4, (days, size)), 0)
    names = [f"a{k:02d}" for k in rng.permutation(size)]
    told = spark.createDataFrame([(i + 3, names[k], int(n[i, k])) for i in range(days) for k in range(size) if n[i, k]], "cal_i int, agent string, n long")
    got = {}
    for r in P.rolling_choice(told, window, days + 2, top, block, agents).collect():
        got.setdefault(r.cal_i, {})[r.agent] = r.total
    for t in range(3 + window, days + 3):
        sums = n[t - 3 - window : t - 3].sum(axis=0)
        want = sorted(range(size), key=lambda k: (-sums[k], names[k]))[:top]
        assert got[t] == {names[k]: sums[k] for k in want}
