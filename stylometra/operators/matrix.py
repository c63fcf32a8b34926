"""Matrix models over vector columns. Every fit starts from sums over groups (one pass, one small row a group); solves are numpy on features squared."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import MOST_CELLS, group_grams


def moments(gram: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, float]:
    """n, means of x, covariance of x, covariance of x with y, mean of y (population form)."""
    n = gram[0, 0]
    m, my = gram[0, 1:-1] / n, gram[0, -1] / n
    return n, m, gram[1:-1, 1:-1] / n - np.outer(m, m), gram[1:-1, -1] / n - m * my, my


def ridge(gram: np.ndarray, lams: list[float]) -> list[np.ndarray]:
    """(constant, slopes) for every lam from one eigendecomposition, on standardised columns; a deviation of 0 counts as 1."""
    n, m, c, cy, my = moments(gram)
    sd = np.sqrt(np.clip(np.diag(c), 0, None))
    sd = np.where(sd > 1e-12, sd, 1.0)
    w, v = np.linalg.eigh(c * n / np.outer(sd, sd))
    out = []
    for lam in lams:
        b = v @ ((v.T @ (cy * n / sd)) / (np.clip(w, 0, None) + lam)) / sd
        out.append(np.concatenate([[my - m @ b], b]))
    return out


def pls(gram: np.ndarray, parts: int) -> np.ndarray:
    """(constant, slopes) of partial least squares with one response, from moments alone (deflation of the cross-products)."""
    _, m, c, cy, my = moments(gram)
    s, a, weights, loads, inner = cy.copy(), c.copy(), [], [], []
    for _ in range(parts):
        norm = np.linalg.norm(s)
        if norm < 1e-12:
            break
        w = s / norm
        t = float(w @ a @ w)
        if t < 1e-12:
            break
        p, q = a @ w / t, float(s @ w) / t
        a, s = a - np.outer(p, p) * t, s - p * q * t
        weights.append(w), loads.append(p), inner.append(q)
    if not weights:
        return np.concatenate([[my], np.zeros(len(m))])
    W, P = np.array(weights).T, np.array(loads).T
    b = W @ np.linalg.solve(P.T @ W, np.array(inner))
    return np.concatenate([[my - m @ b], b])


def squared_error(gram: np.ndarray, beta: np.ndarray) -> float:
    """Sum of squared errors of the rows behind a Gram matrix; the rows aren't read again."""
    e = np.append(-beta, 1.0)
    return float(e @ gram @ e)


def nested_ridge(df: DataFrame, group: str, vector: str, y: str, lams: list[float]) -> DataFrame:
    """(grp, lam, n, mean_truth, mean_pred, sse): each group by the ridge whose lam the other groups choose among themselves, leaving each out in turn."""
    grams = group_grams(df, group, vector, y)
    total, out = sum(grams.values()) if grams else None, []
    for g, own in grams.items():
        rest = total - own
        others = [h for h in grams if h != g]
        cost = np.zeros(len(lams))
        for h in others:
            cost += [squared_error(grams[h], b) for b in ridge(rest - grams[h], lams)] if len(others) > 1 else 0
        best = int(np.argmin(cost))  # the least lam of equal ones
        beta = ridge(rest, lams)[best] if others else np.append(own[0, -1] / own[0, 0], np.zeros(len(own) - 2))
        out.append((g, float(lams[best]), int(round(own[0, 0])), float(own[0, -1] / own[0, 0]), float(own[0, :-1] @ beta / own[0, 0]), squared_error(own, beta)))
    return df.sparkSession.createDataFrame(out, "grp string, lam double, n long, mean_truth double, mean_pred double, sse double")


def scenario_fits(df: DataFrame, group: str, vector: str, y: str, lams: list[float], drops: list[list[str]], columns: list[list[int]] | None = None) -> DataFrame:
    """(scenario, lam, n, rmse): leave-one-group-out ridge for every lam with some groups dropped and some columns kept (jackknife, ablation, specification grid)."""
    grams, out = group_grams(df, group, vector, y), []
    width = len(next(iter(grams.values()))) - 2 if grams else 0
    plans = [(f"drop:{','.join(x)}", set(x), list(range(width))) for x in drops] + [(f"columns:{k}", set(), c) for k, c in enumerate(columns or [])]
    for name, gone, cols in plans:
        at = np.array([0, *[c + 1 for c in cols], width + 1])
        own = {g: v[np.ix_(at, at)] for g, v in grams.items() if g not in gone}
        total = sum(own.values()) if len(own) > 1 else None
        sums = np.zeros(len(lams))
        for g in own if total is not None else []:
            sums += [squared_error(own[g], b) for b in ridge(total - own[g], lams)]
        n = int(round(sum(v[0, 0] for v in own.values())))
        out += [(name, float(lam), n, float(np.sqrt(s / n)) if n else None) for lam, s in zip(lams, sums, strict=True)]
    return df.sparkSession.createDataFrame(out, "scenario string, lam double, n long, rmse double")


def pls_leave_group_out(df: DataFrame, group: str, vector: str, y: str, parts: int) -> DataFrame:
    grams = group_grams(df, group, vector, y)
    total = sum(grams.values()) if grams else None
    rows = [(g, int(round(v[0, 0])), float(np.sqrt(max(squared_error(v, pls(total - v, parts)), 0) / v[0, 0]))) for g, v in grams.items()] if len(grams) > 1 else []
    return df.sparkSession.createDataFrame(rows, "grp string, n long, rmse double")


def filled(df: DataFrame, vector: str, most_null: float = 0.4) -> tuple[DataFrame, list[int]]:
    """(df with the components of vector that are null or NaN in less than that share of rows, unknown ones by the component's median; the components' places). Rows without a vector go."""
    known = df.where(F.col(vector).isNotNull()).withColumn(vector, F.transform(F.col(vector).cast("array<double>"), lambda v: F.when(~F.isnan(v), v)))
    long = known.select(F.posexplode(vector).alias("k", "v"))
    stats = long.groupBy("k").agg((1 - F.count("v") / F.count("*")).alias("none"), F.percentile("v", 0.5).alias("med")).where((F.col("none") < most_null) & F.col("med").isNotNull())
    kept = sorted((r["k"], r["med"]) for r in stats.collect())  # a row for each component
    values = F.array(*[F.coalesce(F.get(vector, F.lit(k)), F.lit(float(m))) for k, m in kept]) if kept else F.array().cast("array<double>")
    return known.withColumn(vector, values), [k for k, _ in kept]


def principal_parts(df: DataFrame, group: str, vector: str, y: str, k: int, most_null: float = 0.4) -> DataFrame:
    """(part, share, loadings): eigenvectors of the correlation matrix, the greatest loading of each positive. Components null in most_null of the rows or more go, other nulls become medians; constant components have no loading."""
    own, _ = filled(df, vector, most_null)
    grams = group_grams(own, group, vector, y)
    if not grams:
        return df.sparkSession.createDataFrame([], "part int, share double, loadings array<double>")
    _, _, c, _, _ = moments(sum(grams.values()))
    sd = np.sqrt(np.clip(np.diag(c), 1e-24, None))
    w, v = np.linalg.eigh(c / np.outer(sd, sd))
    rows = []
    for i, j in enumerate(np.argsort(w)[::-1][:k]):
        x = v[:, j] * np.sign(v[np.argmax(np.abs(v[:, j])), j])
        rows.append((i, float(w[j] / w.sum()), [float(z) for z in x]))
    return df.sparkSession.createDataFrame(rows, "part int, share double, loadings array<double>")


def mvn_posterior(units: DataFrame, group: str, vector: str, y: str, grid: list[float], shrink: float = 0.1, prior: tuple[float, float] | None = None, predictive: bool = False, inflate: float = 1.0) -> DataFrame:
    """(grp, y, point, sd): each group's mean vector placed on the grid by lines and a full residual covariance (shrunk by shrink x trace / K) fitted without it.

    predictive: the covariance at a date is multiplied by 1 + 1/n + (date - mean)^2 / Sxx, with its determinant. inflate: a constant factor of the covariance.
    """
    grams, out = group_grams(units, group, vector, y), []
    for g, own in grams.items() if len(grams) > 1 else []:
        n, m, c, cy, my = moments(sum(v for h, v in grams.items() if h != g))
        vy = sum(v[-1, -1] for h, v in grams.items() if h != g) / n - my * my
        b = cy / vy if vy > 0 else np.zeros_like(cy)
        s = c - np.outer(b, b) * vy
        inv = np.linalg.inv(s + shrink * np.trace(s) / len(s) * np.eye(len(s)))
        x, d = own[0, 1:-1] / own[0, 0], np.array(grid)
        e = x - m - np.outer(d - my, b)
        h = inflate * (1 + 1 / n + (d - my) ** 2 / (n * vy) if predictive and vy > 0 else np.ones(len(d)))
        ll = -0.5 * np.einsum("ij,jk,ik->i", e, inv, e) / h - 0.5 * len(inv) * np.log(h)
        if prior:
            ll = ll - 0.5 * ((d - prior[0]) / prior[1]) ** 2
        p = np.exp(ll - ll.max())
        p /= p.sum()
        mean = float(p @ d)
        out.append((g, float(own[0, -1] / own[0, 0]), float(d[np.argmax(ll)]), float(np.sqrt(max(p @ (d - mean) ** 2, 0)))))
    return units.sparkSession.createDataFrame(out, "grp string, y double, point double, sd double")


def logistic(df: DataFrame, vector: str, target: str, penalty: float = 1.0, steps: int = 12) -> np.ndarray:
    """(constant, slopes) of an L2 logistic fit by Newton steps; each step is one distributed sum of gradients and curvatures."""
    rows = df.where(F.col(vector).isNotNull() & F.col(target).isNotNull()).select(vector, target)
    first = rows.first()
    if first is None:
        return np.zeros(1)
    size = len(first[vector]) + 1
    beta = np.zeros(size)
    for _ in range(steps):

        def run(frames, beta=beta):
            grad, curve = np.zeros(size), np.zeros((size, size))
            for f in frames:
                if len(f):
                    x = np.column_stack([np.ones(len(f)), np.stack(f[vector].to_numpy()).astype(float)])
                    p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
                    grad += x.T @ (f[target].to_numpy(float) - p)
                    curve += (x * (p * (1 - p))[:, None]).T @ x
            yield pd.DataFrame({"k": np.arange(size * (size + 1)), "v": np.concatenate([grad, curve.ravel()])})

        got = rows.mapInPandas(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
        v = np.array([r["v"] for r in got])
        shrink = penalty * np.eye(size)
        shrink[0, 0] = 1e-9
        move = np.linalg.solve(v[size:].reshape(size, size) + shrink, v[:size] - shrink @ beta)
        beta = beta + move
        if np.abs(move).max() < 1e-8:
            break
    return beta


def _logistic_steps(x: np.ndarray, y: np.ndarray, ridge: np.ndarray, beta: np.ndarray, inverse: np.ndarray | None = None, most: int = 200) -> np.ndarray:
    """Newton from beta; with an inverse curvature its first steps take that, and a new one is made where a step doesn't shrink to a quarter of the one before."""
    before = np.inf
    for _ in range(most):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        slope = x.T @ (p - y) + ridge * beta
        if inverse is None:
            inverse = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge))
        step = inverse @ slope
        size = float(np.abs(step).max())
        if size > before / 4 and size > 1e-11:
            inverse = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge))
            step = inverse @ slope
            size = float(np.abs(step).max())
        beta, before = beta - step, size
        if size < 1e-11:
            break
    return beta


def _scaled_ridge(n: float, first: np.ndarray, second: np.ndarray, penalty: float) -> np.ndarray:
    """The penalty of raw slopes that is one of standardised slopes; the constant has next to none."""
    var = second / n - (first / n) ** 2
    return np.concatenate([[1e-12], penalty * np.where(var > 1e-20, var, 1.0)])


#: The most that an expansion may leave out of a unit's linear score, and the columns up to which one is made.
LEAST_SHIFT, MOST_EXPANDED = 1e-10, 24


class _Slope:
    """The slope of an L2 logistic fit about its solution: value, curvature and the next two derivatives, sums over all units.

    With m the greatest change of any unit's linear score, the sigmoid's fourth derivative is at most its first, and that at most e^m times its value at the
    solution; so the terms left out are at most e^m m^3 / 24 of the step, in the norm of the curvature. m is at most that norm of the step by the greatest of a unit.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: np.ndarray, beta: np.ndarray):
        size = x.shape[1]
        self.ridge, self.third = ridge, None
        if size > MOST_EXPANDED:
            return
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        w = p * (1 - p)
        self.value = x.T @ (p - y) + ridge * beta
        self.curve = (x * w[:, None]).T @ x + np.diag(ridge)
        self.second, self.third, far = np.zeros((size, size**2)), np.zeros((size, size**3)), 0.0
        inverse = np.linalg.inv(self.curve)
        block = max(1, 2_000_000 // size**3)
        for a in range(0, len(x), block):
            own, v, q = x[a : a + block], w[a : a + block], p[a : a + block]
            two = (own[:, :, None] * own[:, None, :]).reshape(len(own), -1)
            three = (two[:, :, None] * own[:, None, :]).reshape(len(own), -1)
            self.second += (own * (v * (1 - 2 * q) / 2)[:, None]).T @ two
            self.third += (own * (v * (1 - 6 * v) / 6)[:, None]).T @ three
            far = max(far, float(np.einsum("ij,jk,ik->i", own, inverse, own).max()))
        self.far = math.sqrt(far)

    def without(self, x: np.ndarray, y: float, ridge: np.ndarray, beta: np.ndarray, inverse: np.ndarray) -> np.ndarray | None:
        """The fit without a unit, by Newton steps with the inverse curvature without it; None where the expansion isn't near enough."""
        if self.third is None:
            return None
        move, before = np.zeros(len(x)), np.inf
        for _ in range(60):
            two = np.outer(move, move).ravel()
            p = 1 / (1 + np.exp(-np.clip(x @ (beta + move), -35, 35)))
            slope = self.value + self.curve @ move + self.second @ two + self.third @ np.outer(two, move).ravel() - (p - y) * x + (ridge - self.ridge) * (beta + move)
            step = inverse @ slope
            shift = math.sqrt(max(float(step @ self.curve @ step), 0.0)) * self.far
            move = move - step
            if shift < LEAST_SHIFT / 100 or not shift < before:
                break
            before = shift
        m = math.sqrt(max(float(move @ self.curve @ move), 0.0)) * self.far
        if not (m < 0.5 and shift < LEAST_SHIFT):
            return None
        grown = 1 + float(x @ inverse @ x) / 4  # the curvature without the unit is smaller by the unit's own part
        return beta + move if math.exp(m) * m**4 / 24 * grown <= LEAST_SHIFT else None


def logistic_leave_one_out(units: DataFrame, key: str, vector: str, target: str, penalty: float = 1.0) -> DataFrame:
    """(key, target, score): each unit's probability by the L2 logistic fit of all others, on columns standardised without it. units is a table of units, not of rows: at most MOST_CELLS numbers.

    One fit of all units gives a start and the derivatives of its slope there, up to the third. A unit's fit solves the slope's expansion without the unit, so its cost
    doesn't grow with the others. What the expansion leaves out is bounded (see _Slope); where the bound is above LEAST_SHIFT, as in small tables or for far units,
    steps are taken over all others until they end. Either way scores are those of full refits. Units without a vector or target are left out; where the others have one class alone the score is null.
    """
    known = units.where(F.col(vector).isNotNull() & F.col(target).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("_x"), F.col(target).cast("int").alias("_y"))
    size = known.agg(F.count("*").alias("n"), F.max(F.size("_x")).alias("w")).head()
    if size["n"] * ((size["w"] or 0) + 1) > MOST_CELLS:
        raise ValueError(f"{size['n']} rows are too many to leave each out: more than {MOST_CELLS} numbers")
    kind = dict(units.dtypes)[key]
    schema = f"`{key}` {kind}, target int, score double"
    rows = known.collect()
    if len(rows) < 2:
        return units.sparkSession.createDataFrame([], schema)
    x = np.column_stack([np.ones(len(rows)), np.array([r["_x"] for r in rows])])
    y = np.array([r["_y"] for r in rows], float)
    ridge = _scaled_ridge(len(rows), x[:, 1:].sum(0), (x[:, 1:] ** 2).sum(0), penalty)
    beta = _logistic_steps(x, y, ridge, np.zeros(x.shape[1])) if 0 < y.sum() < len(y) else np.zeros(x.shape[1])
    w = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
    inverse = np.linalg.inv((x * (w * (1 - w))[:, None]).T @ x + np.diag(ridge))
    slope = _Slope(x, y, ridge, beta) if 0 < y.sum() < len(y) else None
    shared = units.sparkSession.sparkContext.broadcast((x, y, beta, inverse, slope))

    def run(frames):
        x, y, beta, inverse, slope = shared.value
        first, second, total = x[:, 1:].sum(0), (x[:, 1:] ** 2).sum(0), y.sum()
        for f in frames:
            out = []
            for i in f["id"]:
                if not 0 < total - y[i] < len(y) - 1:
                    out.append(None)
                    continue
                p = 1 / (1 + np.exp(-np.clip(x[i] @ beta, -35, 35)))
                turned = inverse @ x[i]
                less = inverse + np.outer(turned, turned) * (p * (1 - p) / (1 - p * (1 - p) * (x[i] @ turned)))
                own = _scaled_ridge(len(y) - 1, first - x[i, 1:], second - x[i, 1:] ** 2, penalty)
                fit = slope.without(x[i], y[i], own, beta, less) if slope else None
                if fit is None:
                    fit = _logistic_steps(np.delete(x, i, 0), np.delete(y, i), own, beta, less)
                out.append(float(1 / (1 + np.exp(-np.clip(x[i] @ fit, -35, 35)))))
            yield pd.DataFrame({"id": f["id"], "score": pd.Series(out, dtype="float64")})

    scores = units.sparkSession.range(len(rows)).mapInPandas(run, "id long, score double")
    names = units.sparkSession.createDataFrame([(k, r[key], r["_y"]) for k, r in enumerate(rows)], f"id long, `{key}` {kind}, target int")
    return names.join(scores, "id").select(key, "target", "score")


def topic_factors(df: DataFrame, row: str, column: str, value: str, k: int, steps: int = 15) -> DataFrame:
    """(row, topic, weight) of a non-negative factorisation by multiplicative updates of the column factor; weights of a row sum to 1.

    Columns are a vocabulary of bounded size. Rows meet the column factor as a broadcast of columns x k numbers; sums of k x columns and k x k come back.
    """
    names = [r[0] for r in df.select(column).distinct().orderBy(column).collect()]
    place, h = {n: i for i, n in enumerate(names)}, np.random.default_rng(0).random((k, max(len(names), 1))) + 0.1
    packed = df.groupBy(row).agg(F.collect_list(column).alias("c"), F.collect_list(F.col(value).cast("double")).alias("v"))  # at most the vocabulary a row

    def weights(f, h):
        x = np.zeros((len(f), h.shape[1]))
        for i, (c, v) in enumerate(zip(f["c"], f["v"], strict=True)):
            x[i, [place[n] for n in c]] = v
        w, hh = np.full((len(f), k), 1.0), h @ h.T
        for _ in range(30):
            w *= (x @ h.T) / (w @ hh + 1e-12)
        return x, w

    for _ in range(steps if names else 0):

        def run(frames, h=h):
            a, b = np.zeros(h.shape), np.zeros((k, k))
            for f in frames:
                if len(f):
                    x, w = weights(f, h)
                    a, b = a + w.T @ x, b + w.T @ w
            yield pd.DataFrame({"i": np.arange(a.size + k * k), "v": np.concatenate([a.ravel(), b.ravel()])})

        v = np.array([r["v"] for r in packed.mapInPandas(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()])
        a, b = v[: h.size].reshape(h.shape), v[h.size :].reshape(k, k)
        h = h * a / (b @ h + 1e-12)

    def out(frames):
        for f in frames:
            if len(f):
                _, w = weights(f, h)
                w = w / np.maximum(w.sum(axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({row: np.repeat(f[row].to_numpy(), k), "topic": np.tile(np.arange(k), len(f)), "weight": w.ravel()})

    kind = dict(df.dtypes)[row]
    return packed.mapInPandas(out, f"`{row}` {kind}, topic int, weight double")
