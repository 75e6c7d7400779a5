"""Cox models against direct sums over risk sets."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.operators import cox
from lociframe.operators import survival as V


def newton(t, e, x, steps=40):
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        g, h, ll = np.zeros(len(beta)), np.zeros((len(beta), len(beta))), 0.0
        for i in np.flatnonzero(e):
            r = x[t >= t[i]]
            lp = r @ beta
            w = np.exp(lp - lp.max())
            m = w @ r / w.sum()
            g += x[i] - m
            h += (r - m).T @ ((r - m) * (w / w.sum())[:, None])
            ll += x[i] @ beta - lp.max() - np.log(w.sum())
        step = np.linalg.solve(h, g)
        if np.abs(step).max() < 1e-9:
            break
        beta = beta + step
    return beta, np.linalg.inv(h), ll


def people(n=260, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(0, 1, n), rng.normal(2, 3, n), (rng.random(n) < 0.3).astype(float)])
    t = np.ceil(-np.log(rng.random(n)) / np.exp(x @ [0.6, -0.1, 0.4]) * 8)
    t[: n // 3] = np.minimum(t[: n // 3], 5)  # a third of the rows end at one time
    return t, (rng.random(n) < 0.7).astype(int), x


@pytest.fixture(scope="module")
def df(spark):
    t, e, x = people()
    rows = [(i, float(a), int(b), *map(float, c), f"g{i % 7}") for i, (a, b, c) in enumerate(zip(t, e, x))]
    return spark.createDataFrame([*rows, (900, None, 1, 0.0, 0.0, 0.0, "g1"), (901, 3.0, 0, None, 0.0, 0.0, "g1")], "id long, time double, event int, a double, b double, c double, g string").repartition(5)


def test_all_models_in_shared_passes(df):
    t, e, x = people()
    models = [[0], [1], [2], [0, 1, 2], [2, 0]]
    for fit in cox.fit_models(df, ["a", "b", "c"], models):
        beta, cov, ll = newton(t, e, x[:, fit.columns])
        assert fit.converged and np.allclose(fit.beta, beta, atol=1e-6) and np.allclose(fit.covariance, cov, rtol=1e-5)
        assert fit.log_likelihood == pytest.approx(ll)


def test_outliers_and_late_times(spark):
    """A value of 500 would overflow exp(xβ), and the last risk sets are tiny beside the first: both stay finite."""
    t, e, x = people(120, 5)
    x[3, 0] = 500.0
    rows = [(i, float(a), int(b), float(c[0])) for i, (a, b, c) in enumerate(zip(t, e, x))]
    small = spark.createDataFrame(rows, "id long, time double, event int, a double")
    fit = cox.fit_models(small, ["a"], [[0]])[0]
    assert np.isfinite(fit.beta).all() and np.isfinite(fit.log_likelihood)
    ranges, border = cox.risk_ranges(small, ["a"])
    for beta in (-2.0, 2.0):
        ll, grad, info = cox.evaluate(ranges, border, 1, [([0], np.array([beta]))])[0]
        want = 0.0
        for i in np.flatnonzero(e):
            lp = x[t >= t[i], 0] * beta
            want += x[i, 0] * beta - lp.max() - np.log(np.exp(lp - lp.max()).sum())
        assert ll == pytest.approx(want) and np.isfinite(grad).all() and np.isfinite(info).all()


def test_separated_and_singular_models(spark):
    rows = [(i, float(i), 1, float(i < 10), 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, time double, event int, early double, same double")
    early, same = cox.fit_models(df, ["early", "same"], [[0], [1]], max_iter=6)
    assert not early.converged and np.isfinite(early.beta).all()
    assert not same.converged and np.isnan(same.covariance).all()
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        V.cox_fit(df, ["early"], max_iter=3)
    assert any("settled" in str(w.message) for w in caught)


def test_tables(df):
    got = {r["covariate"]: r for r in V.cox_univariate(df, ["a", "b", "c"]).collect()}
    t, e, x = people()
    beta, cov, _ = newton(t, e, x[:, :1])
    assert got["a"]["hr"] == pytest.approx(np.exp(beta[0]), rel=1e-5) and got["a"]["z"] == pytest.approx(beta[0] / np.sqrt(cov[0, 0]), rel=1e-4)
    assert all(r["converged"] for r in got.values())
    assert len(V.cox_multivariate(df, ["a", "b", "c"]).collect()) == 3


def test_schoenfeld_means(df):
    t, e, x = people()
    beta = [0.3, -0.2, 0.1]
    got = {r["time"]: [r["m0"], r["m1"], r["m2"]] for r in cox.risk_means(df, ["a", "b", "c"], beta).collect()}
    assert set(got) == {v for v, d in zip(t, e) if d}
    for v, m in got.items():
        w = np.exp(x[t >= v] @ beta)
        assert np.allclose(m, w @ x[t >= v] / w.sum())


@pytest.mark.parametrize("times", [cox.TIMES, 0])
def test_levels(df, times, monkeypatch):
    """From counts at risk, and as columns where the table of times is too long: both are the univariate models."""
    monkeypatch.setattr(cox, "TIMES", times)
    monkeypatch.setattr(cox, "WIDE", 4)
    t, e, _ = people()
    t, e = np.append(t, 3.0), np.append(e, 0)
    g = np.array([*(i % 7 for i in range(260)), 1])
    got = {r["covariate"]: r for r in cox.level_fits(df, "id", ["g"]).collect()}
    assert sorted(got) == [f"g_g{k}" for k in range(1, 7)]
    for k in range(1, 7):
        beta, cov, _ = newton(t, e, (g == k).astype(float)[:, None])
        assert got[f"g_g{k}"]["beta"] == pytest.approx(beta[0], abs=1e-6) and got[f"g_g{k}"]["se"] == pytest.approx(np.sqrt(cov[0, 0]), rel=1e-5)


def test_ten_thousand_levels(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, float(a), int(b), f"L{i % 10_000}") for i, (a, b) in enumerate(zip(rng.integers(1, 400, 40_000), rng.random(40_000) < 0.5))], "id long, time double, event int, g string")
    out = V.cox_levels(rows, "id", ["g"])
    assert out.count() == 9_999
    assert out.where("not converged").count() < 1500  # levels without an event, or with all of theirs first, have no finite estimate


def test_covariates(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 5.0, None), (4, 3.0, "c")], "id long, v double, g string")
    out, names = V.prepare_covariates(df, ["v", "g"])
    rows = {r["id"]: r for r in out.collect()}
    filled = np.array([1.0, 3.0, 5.0, 3.0])
    z = (filled - filled.mean()) / (filled.std() + 1e-10)
    assert names == ["v_z", "g_b", "g_c"] and [rows[i]["v_z"] for i in range(1, 5)] == pytest.approx(z) and rows[3]["g_b"] == 0.0 and rows[4]["g_c"] == 1.0
    assert out.select(F.sum("g_b")).first()[0] == 1.0
