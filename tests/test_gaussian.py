"""Gaussian models by register against plain loops."""

import math

import numpy as np
import pytest

from stylometra.operators import gaussian as G

GRID = [float(g) for g in range(-3, 9)]
SCHEMA = "k long, r string, y double, x array<double>, w double, s map<string,double>"


def rows():
    rng = np.random.default_rng(6)
    out = []
    for k in range(90):
        r, y = "abc"[k % 3], float(rng.integers(0, 6))
        x = [float(v) for v in np.array([1.0, -0.5, 0.2]) * y * (1 + "abc".index(r)) + rng.normal(0, 0.7, 3)]
        out.append((k, r, y, x, float(rng.choice([0.5, 1.0, 2.0])), {"a": 0.2, "c": 0.8} if k % 2 else {"b": 1.0}))
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([*rows(), (500, "a", 1.0, None, 1.0, None), (501, "zz", None, [1.0, None, 2.0], 1.0, {"zz": 1.0})], SCHEMA).repartition(3)


def plain(register, weighted, relative, absolute):
    own = [r for r in rows() if r[1] == register]
    x, y, w = np.array([r[3] for r in own]), np.array([r[2] for r in own]), np.array([r[4] if weighted else 1.0 for r in own])
    w = w / w.mean()
    a = np.column_stack([np.ones(len(y)), y])
    coef = np.linalg.solve((a * w[:, None]).T @ a, (a * w[:, None]).T @ x)
    e = x - a @ coef
    s = (e * w[:, None]).T @ e / (len(y) - 1)
    return coef[0], coef[1], s + (relative * np.trace(s) / 3 + absolute) * np.eye(3)


@pytest.mark.parametrize("weighted,relative,absolute", [(False, 0.1, 0.0), (True, 0.0, 0.05)])
def test_lines(df, weighted, relative, absolute):
    models = G.register_lines(df.where("k < 500"), "r", "x", "y", relative, absolute, "w" if weighted else None)
    for r in "abc":
        a, b, s = plain(r, weighted, relative, absolute)
        assert models[r].intercept == pytest.approx(a) and models[r].slope == pytest.approx(b) and models[r].covariance == pytest.approx(s)
        assert models[r].condition == pytest.approx(np.linalg.cond(s)) and models[r].n == pytest.approx(30)


def log_lik(x, a, b, p, grid=GRID):
    return [-0.5 * float((x - a - b * g) @ p @ (x - a - b * g)) for g in grid]


def test_own_register_variants_and_mixtures(df):
    models = G.register_lines(df.where("k < 500"), "r", "x", "y", 0.1)
    fits = {r: plain(r, False, 0.1, 0.0) for r in "abc"}
    data = {r[0]: r for r in rows()}
    own = G.densities(df, "k", "x", models, GRID, "r").collect()
    assert len(own) == 90
    for row in own:
        _, r, _, x, _, _ = data[row.k]
        a, b, s = fits[r]
        assert row.form == r and row.log_density == pytest.approx(log_lik(np.array(x), a, b, np.linalg.inv(s)))
    ratios = np.array([0.0, 0.5, 2.0])
    for row in G.densities(df.where("k < 9"), "k", "x", models, GRID, "r", ratios=ratios, mismatch=0.4).collect():
        _, r, _, x, _, _ = data[row.k]
        a, b, s = fits[r]
        w = np.diag(1 / (1 + ratios)) if "B" in row.form else np.eye(3)
        wide = s + np.diag(np.diag(s) * 0.4 * ratios) if "D" in row.form else s
        assert row.log_density == pytest.approx(log_lik(np.array(x), a, b, w @ np.linalg.inv(wide) @ w))
    got = G.densities(df, "k", "x", models, GRID, shares="s").collect()
    assert len(got) == 90
    for row in got:
        _, _, _, x, _, share = data[row.k]
        for g, value in zip(GRID, row.log_density):
            each = sum(p * math.exp(log_lik(np.array(x), fits[r][0], fits[r][1], np.linalg.inv(fits[r][2]), [g])[0] - 0.5 * np.linalg.slogdet(fits[r][2])[1]) for r, p in share.items())
            assert value == pytest.approx(math.log(each), abs=1e-6) if each > 1e-250 else value < -500
    fixed = G.densities(df, "k", "x", models, GRID, shares={"a": 0.2, "c": 0.8}).where("k = 1").head()
    assert fixed.log_density == pytest.approx([r for r in got if r.k == 1][0].log_density)
