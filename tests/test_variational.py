"""The variational model against finite differences and plain sums."""

import math

import numpy as np
import pytest

from stylometra.operators import variational as V

SCHEMA = "k long, r string, d double, x array<double>"


def rows(seed=1, n=60):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        r, d = "ab"[k % 2], float(rng.normal(0, 200))
        x = [1.0 + 0.01 * d * (1 if r == "a" else -1) + rng.normal(0, 0.3), 5 + rng.normal(0, 1), None if k % 7 == 0 else float(rng.normal(0, 1)) + 0.02 * d]
        out.append((k, r, d, x))
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([*rows(), (900, None, 1.0, [1.0] * 3), (901, "a", None, [1.0] * 3), (902, "a", 1.0, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def sums(df):
    return V.feature_sums(df, "r", "x", "d")


def test_sums_are_those_of_standardised_rows(sums):
    data = rows()
    x = np.array([[np.nan if v is None else v for v in r[3]] for r in data], float)
    d = np.array([r[2] for r in data])
    z, t = (x - np.nanmean(x, axis=0)) / np.nanstd(x, axis=0, ddof=1), (d - d.mean()) / d.std(ddof=1)
    for i, name in enumerate("ab"):
        own = np.array([r[1] == name for r in data])
        v, m, u = np.nan_to_num(z[own]), ~np.isnan(z[own]), t[own][:, None]
        for got, want in ((sums.n, m), (sums.x, v), (sums.d, m * u), (sums.xx, v * v), (sums.xd, v * u), (sums.dd, m * u * u)):
            assert got[i] == pytest.approx(want.sum(axis=0), abs=1e-8)


def test_gradient_equals_finite_differences(sums):
    rng = np.random.default_rng(3)
    phi = V.start(sums) + rng.normal(0, 0.2, len(V.start(sums)))
    eps = V.noise(rng, 6, sums.n.shape)
    _, slope = V.bound(phi, eps, sums)
    for k in range(len(phi)):
        step = np.zeros(len(phi))
        step[k] = 1e-5
        want = (V.bound(phi + step, eps, sums)[0] - V.bound(phi - step, eps, sums)[0]) / 2e-5
        assert slope[k] == pytest.approx(want, rel=1e-4, abs=1e-5)


def test_bound_is_that_of_rows(sums):
    """The likelihood part from the rows themselves, the divergences term by term."""
    data, rng = rows(), np.random.default_rng(5)
    phi = V.start(sums) + rng.normal(0, 0.1, len(V.start(sums)))
    eps = V.noise(rng, 3, sums.n.shape)
    p = V.parts(phi, sums.n.shape)
    x = (np.array([[np.nan if v is None else v for v in r[3]] for r in data], float) - sums.mean) / sums.sd
    t = (np.array([r[2] for r in data]) - sums.date[0]) / sums.date[1]
    total = 0.0
    kl = lambda m, s, m0, s0: math.log(s0 / s) + (s * s + (m - m0) ** 2) / (2 * s0 * s0) - 0.5
    for s in range(3):
        draw = {k: p[k] + np.exp(p["s" + k]) * eps[k][s] for k in ("a", "b", "l")}
        for i, r in enumerate(data):
            for f in range(3):
                if not np.isnan(x[i, f]):
                    a, b, l = (draw[k]["ab".index(r[1]), f] for k in ("a", "b", "l"))
                    total += (-0.5 * ((x[i, f] - a - b * t[i]) / math.exp(l)) ** 2 - l) / 3
        m, w = p["m"] + np.exp(p["sm"]) * eps["m"][s, 0], math.exp(p["t"][0] + math.exp(p["st"][0]) * eps["t"][s, 0, 0])
        total -= sum(kl(p["b"][j, f], math.exp(p["sb"][j, f]), m[f], w) for j in range(2) for f in range(3)) / 3
    for k, m0, s0 in (("a", 0, 3), ("l", 0, 0.5), ("m", 0, 1), ("t", -1, 0.5)):
        total -= sum(kl(m, math.exp(s), m0, s0) for m, s in zip(p[k].ravel(), p["s" + k].ravel()))
    assert V.bound(phi, eps, sums)[0] == pytest.approx(total, rel=1e-9)


@pytest.fixture(scope="module")
def model(sums):
    return V.fit(sums, 400, 8)


def test_bound_rises_and_lines_are_found(sums, model):
    assert np.mean(model.bounds[-50:]) > np.mean(model.bounds[:10]) + 5
    p = V.parts(model.phi, sums.n.shape)
    slope = 0.01 * sums.date[1] / sums.sd[0]
    assert p["b"][0, 0] == pytest.approx(slope, abs=0.15) and p["b"][1, 0] == pytest.approx(-slope, abs=0.15) and abs(p["b"][0, 1]) < 0.5


def test_dates_by_evidence_equal_a_plain_sum(spark, df, sums, model):
    grid = [float(g) for g in range(-500, 501, 50)]
    got = V.date_densities(df.where("k < 8"), "k", "x", model, grid, samples=20, seed=1).collect()
    draws = V._draws(model, 20, 1)
    for r in got:
        x, j = [row[3] for row in rows() if row[0] == r.k][0], "ab".index(r.register)
        want = []
        for g in grid:
            t, each = (g - sums.date[0]) / sums.date[1], []
            for s in range(20):
                a, b, l = (draws[k][s, j] for k in ("a", "b", "l"))
                each.append(sum(-0.5 * (((v - sums.mean[f]) / sums.sd[f] - a[f] - b[f] * t) / math.exp(l[f])) ** 2 - l[f] for f, v in enumerate(x) if v is not None))
            want.append(math.log(sum(math.exp(e) for e in each) / 20))
        assert r.log_density == pytest.approx(want, rel=1e-7, abs=1e-7) and r.evidence == pytest.approx(math.log(sum(map(math.exp, want))))
    for k in range(8):
        own = [r for r in got if r.k == k]
        assert len(own) == 2 and [r.best for r in own].count(True) == 1 and max(own, key=lambda r: r.evidence).best
    single = V.date_densities(df, "k", "x", model, grid, "r", 20, 1).collect()
    assert {r.k for r in single} == {*range(60), 901} and all(r.register == "ab"[r.k % 2] for r in single if r.k < 60)


def test_priors_reweigh_stored_densities(spark):
    grid = [float(k) for k in range(0, 200)]
    df = spark.createDataFrame([("u", grid, [-0.5 * ((g - 100) / 10) ** 2 for g in grid], 60.0)], "u string, dates array<double>, log_density array<double>, own double")
    from pyspark.sql import functions as F

    out = {r.prior: r for r in V.reweighted(df, [("flat", None, None), ("wide", 100.0, 500.0), ("scholarly", F.col("own"), 10.0)]).collect()}
    assert (out["flat"].point, out["scholarly"].point) == (100.0, 80.0) and out["flat"].sd == pytest.approx(10, abs=1e-6) and out["scholarly"].sd == pytest.approx(10 / math.sqrt(2), abs=1e-6)
    w = np.exp(out_log := np.array([-0.5 * ((g - 100) / 10) ** 2 for g in grid]))
    assert out["flat"].low == grid[int(np.searchsorted(np.cumsum(w / w.sum()), 0.16))] and out["flat"].ess == pytest.approx(1) and len(out_log) == 200
    q = np.exp([-0.5 * ((g - 60) / 10) ** 2 for g in grid])
    assert out["scholarly"].ess == pytest.approx((w * q).sum() ** 2 / w.sum() / (w * q * q).sum()) and out["wide"].ess > 0.99
    verdict = V.prior_verdicts(V.reweighted(df, [("flat", None, None), ("wide", 100.0, 500.0), ("scholarly", F.col("own"), 10.0)]), ["u"], strong=30, mild=10).head()
    assert (verdict.shift, verdict.verdict) == (-20.0, "mildly prior-influenced")
