"""A hierarchical model of dated features by variational inference, date posteriors by evidence, and their sensitivity to priors.

Feature f of a text of register r at date d is normal about a[r, f] + b[r, f] d with deviation exp(l[r, f]); slopes b of a feature lie about
m[f] with one deviation exp(t). All have normal posteriors of their own (a mean, the log of a deviation). Priors: a 0 and 3, l 0 and 0.5, m 0 and 1,
t -1 and 0.5. Values and dates are standardised by the moments of the training rows.

The likelihood of any draw of the parameters is a quadratic form of six sums for each register and feature (count, x, d, x x, x d, d d over rows where
the feature is known). One pass of the rows gives these; each step of the fit works on registers x features numbers on the driver,
whatever the number of rows. Dates of rows are found in tasks, from a broadcast of draws of the fitted parameters.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Registers x features that a fit may have.
MOST_CELLS = 2_000_000
_BLOCKS = ("a", "sa", "b", "sb", "l", "sl")


@dataclass
class Sums:
    """Registers x features arrays of the six sums, with what standardises rows."""

    registers: list[str]
    n: np.ndarray
    x: np.ndarray
    d: np.ndarray
    xx: np.ndarray
    xd: np.ndarray
    dd: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    date: tuple[float, float]


def feature_sums(rows: DataFrame, register: str, vector: str, date: str) -> Sums:
    """From rows with a register and a date; null or NaN values of a feature are unknown. Deviations are sample ones; one of 0 counts as 1."""
    ship(rows.sparkSession)
    known = rows.where(F.col(register).isNotNull() & F.col(vector).isNotNull() & F.col(date).isNotNull())
    own = known.select(F.col(register).cast("string").alias("r"), F.col(vector).cast("array<double>").alias("x"), F.col(date).cast("double").alias("d"))
    long = own.select("r", "d", F.posexplode("x").alias("f", "v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    v, d = F.col("v"), F.col("d")
    sums = long.groupBy("r", "f").agg(F.count("*").alias("n"), F.avg(v).alias("mx"), F.avg(d).alias("md"), F.var_pop(v).alias("vx"), F.var_pop(d).alias("vd"), F.covar_pop(v, d).alias("c"))
    got = pd.DataFrame(sums.limit(MOST_CELLS + 1).collect(), columns=["r", "f", "n", "mx", "md", "vx", "vd", "c"])
    if len(got) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} registers x features")
    registers, width = sorted(set(got["r"])), int(got["f"].max()) + 1 if len(got) else 0
    at = (got["r"].map({r: k for k, r in enumerate(registers)}).to_numpy(int), got["f"].to_numpy(int)) if len(got) else ([], [])
    n, mx, md, vx, vd, c = (np.zeros((len(registers), width)) for _ in range(6))
    for target, name in zip((n, mx, md, vx, vd, c), ("n", "mx", "md", "vx", "vd", "c"), strict=True):
        target[at] = got[name].to_numpy(float)
    total = np.maximum(n.sum(axis=0), 1)
    mean = (n * mx).sum(axis=0) / total
    sd = np.sqrt((n * (vx + (mx - mean) ** 2)).sum(axis=0) / np.maximum(total - 1, 1))
    sd = np.where(sd > 0, sd, 1.0)
    m, s = own.agg(F.avg("d"), F.stddev_samp("d")).head()
    middle, scale = float(m or 0), float(s) if s else 1.0
    zx, zd, ex, ed = (mx - mean) / sd, (md - middle) / scale, vx / sd**2, vd / scale**2
    return Sums(registers, n, n * zx, n * zd, n * (ex + zx**2), n * (c / sd / scale + zx * zd), n * (ed + zd**2), mean, sd, (middle, scale))


def start(sums: Sums, least: int = 4) -> np.ndarray:
    """Lines of each register and feature with enough rows as means, small deviations."""
    shape = sums.n.shape
    det = sums.n * sums.dd - sums.d**2
    ok = (sums.n >= least) & (det > 1e-9)
    b = np.where(ok, (sums.n * sums.xd - sums.x * sums.d) / np.where(ok, det, 1), 0)
    a = np.where(ok, (sums.x - b * sums.d) / np.maximum(sums.n, 1), 0)
    low = np.full(a.size, -2.0)
    return np.concatenate([a.ravel(), low, b.ravel(), low, np.zeros(a.size), low, np.zeros(shape[1]), low[: shape[1]], [-1.0, -2.0]])


def parts(phi: np.ndarray, shape: tuple[int, int]) -> dict[str, np.ndarray]:
    """Views of a parameter vector: means a, b, l, m, t and logs of deviations sa, sb, sl, sm, st."""
    size, out, at = shape[0] * shape[1], {}, 0
    for name in _BLOCKS:
        out[name] = phi[at : at + size].reshape(shape)
        at += size
    out["m"], out["sm"], out["t"], out["st"] = phi[at : at + shape[1]], phi[at + shape[1] : at + 2 * shape[1]], phi[-2:-1], phi[-1:]
    return out


def noise(rng: np.random.Generator, samples: int, shape: tuple[int, int]) -> dict[str, np.ndarray]:
    return {"a": rng.standard_normal((samples, *shape)), "b": rng.standard_normal((samples, *shape)), "l": rng.standard_normal((samples, *shape)), "m": rng.standard_normal((samples, 1, shape[1])), "t": rng.standard_normal((samples, 1, 1))}


def bound(phi: np.ndarray, eps: dict[str, np.ndarray], sums: Sums) -> tuple[float, np.ndarray]:
    """The evidence bound for given noise and its gradient: the mean over draws of the log likelihood (without constants), less the divergences from the priors."""
    shape, p, out = sums.n.shape, parts(phi, sums.n.shape), np.zeros_like(phi)
    g, samples = parts(out, shape), len(eps["a"])
    s = {k: np.exp(p["s" + k]) for k in ("a", "b", "l", "m", "t")}
    a, b, l = (p[k] + s[k] * eps[k] for k in ("a", "b", "l"))
    m, t = p["m"] + s["m"] * eps["m"], p["t"] + s["t"] * eps["t"]
    precision = np.exp(-2 * l)
    square = sums.xx - 2 * a * sums.x - 2 * b * sums.xd + a * a * sums.n + 2 * a * b * sums.d + b * b * sums.dd
    value = float((-0.5 * square * precision - sums.n * l).sum() / samples)
    slopes = {"a": (sums.x - a * sums.n - b * sums.d) * precision, "b": (sums.xd - a * sums.d - b * sums.dd) * precision, "l": square * precision - sums.n}
    for k, slope in slopes.items():
        g[k] += slope.mean(axis=0)
        g["s" + k] += (slope * eps[k]).mean(axis=0) * s[k]
    for k, mean, sd in (("a", 0.0, 3.0), ("l", 0.0, 0.5), ("m", 0.0, 1.0), ("t", -1.0, 0.5)):
        value -= float((np.log(sd) - p["s" + k] + (s[k] ** 2 + (p[k] - mean) ** 2) / (2 * sd**2) - 0.5).sum())
        g[k] -= (p[k] - mean) / sd**2
        g["s" + k] -= s[k] ** 2 / sd**2 - 1
    # slopes against their features' means: those are drawn, so the divergence is a mean over draws
    wide, gap = np.exp(-2 * t), p["b"] - m
    value -= float((t - p["sb"] + 0.5 * (s["b"] ** 2 + gap**2) * wide - 0.5).sum() / samples)
    pull = gap * wide
    g["b"] -= pull.mean(axis=0)
    g["sb"] -= (s["b"] ** 2 * wide - 1).mean(axis=0)
    toward = pull.sum(axis=1, keepdims=True)
    g["m"] += toward.mean(axis=0)[0]
    g["sm"] += (toward * eps["m"]).mean(axis=0)[0] * s["m"]
    spread = ((s["b"] ** 2 + gap**2) * wide - 1).sum(axis=(1, 2), keepdims=True)
    g["t"] += spread.mean()
    g["st"] += (spread * eps["t"]).mean() * s["t"]
    return value, out


@dataclass
class Fit:
    sums: Sums
    phi: np.ndarray
    bounds: list[float] = field(default_factory=list)


def fit(sums: Sums, steps: int = 3000, samples: int = 32, rate: float = 0.02, seed: int = 0) -> Fit:
    """Adam on fresh noise at every step; the iterate of the greatest bound seen is kept."""
    phi, rng = start(sums), np.random.default_rng(seed)
    best, top, bounds = phi.copy(), -np.inf, []
    first, second = np.zeros_like(phi), np.zeros_like(phi)
    for k in range(1, steps + 1 if sums.n.size else 1):
        value, slope = bound(phi, noise(rng, samples, sums.n.shape), sums)
        bounds.append(value)
        if value > top:
            best, top = phi.copy(), value
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        phi = phi + rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return Fit(sums, best, bounds)


def log_likelihoods(x: np.ndarray, a: np.ndarray, b: np.ndarray, l: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """rows x grid: log of the mean over draws of the likelihood of each row at each date. x: rows x features, NaN where unknown; a, b, l: draws x features.

    A draw's log likelihood is a parabola in the date, so each row needs three numbers for each draw, not features x grid.
    """
    known = (~np.isnan(x)).astype(float)
    v, w = np.where(np.isnan(x), 0.0, x), np.exp(-2 * l)
    c0 = v * v @ w.T - 2 * v @ (a * w).T + known @ (a * a * w).T
    c1 = v @ (b * w).T - known @ (a * b * w).T
    c2, fixed = known @ (b * b * w).T, known @ l.T
    out = np.empty((len(x), len(grid)))
    for k in range(len(x)):  # draws x grid numbers at once
        each = -0.5 * (c0[k][:, None] - 2 * c1[k][:, None] * grid + c2[k][:, None] * grid**2) - fixed[k][:, None]
        top = each.max(axis=0)
        out[k] = top + np.log(np.exp(each - top).mean(axis=0))
    return out


def _draws(model: Fit, samples: int, seed: int) -> dict[str, np.ndarray]:
    """draws x registers x features of a, b, l."""
    p, rng = parts(model.phi, model.sums.n.shape), np.random.default_rng(seed)
    return {k: p[k] + np.exp(p["s" + k]) * rng.standard_normal((samples, *model.sums.n.shape)) for k in ("a", "b", "l")}


def date_densities(rows: DataFrame, key: str, vector: str, model: Fit, grid: list[float], register: str | None = None, samples: int = 500, seed: int = 42) -> DataFrame:
    """(key, register, evidence, best, dates, log_density): the log likelihood of each row's dates (in the units of the training dates) under each register, or under its own alone where a column names it.

    evidence is the log of the sum over the grid, best the register where it is greatest. Rows without a vector, or of a register that the model
    doesn't know, have no row.
    """
    ship(rows.sparkSession)
    names, (middle, scale) = model.sums.registers, model.sums.date
    shared = rows.sparkSession.sparkContext.broadcast((_draws(model, samples, seed), model.sums.mean, model.sums.sd))
    at = (np.array(grid, float) - middle) / scale
    kind = dict(rows.dtypes)[key]
    columns = [F.col(key), F.col(vector).cast("array<double>").alias("_x"), (F.col(register).cast("string") if register else F.lit(None).cast("string")).alias("_r")]

    def run(frames):
        draws, mean, sd = shared.value
        for f in frames:
            if not len(f):
                continue
            x = (np.array([[np.nan if v is None else v for v in r] for r in f["_x"]], float) - mean) / sd
            each = np.stack([log_likelihoods(x, *(draws[k][:, j] for k in ("a", "b", "l")), at) for j in range(len(names))], axis=1)
            top = each.max(axis=2, keepdims=True)
            evidence = (top + np.log(np.exp(each - top).sum(axis=2, keepdims=True)))[:, :, 0]
            best = evidence.argmax(axis=1)
            keep = np.array([[r is None or n == r for n in names] for r in f["_r"]])
            i, j = np.nonzero(keep)
            yield pd.DataFrame({key: f[key].to_numpy()[i], "register": [names[k] for k in j], "evidence": evidence[i, j], "best": best[i] == j, "dates": [list(grid)] * len(i), "log_density": list(each[i, j])})

    schema = f"`{key}` {kind}, register string, evidence double, best boolean, dates array<double>, log_density array<double>"
    own = rows.where(F.col(vector).isNotNull()).select(*columns)
    return (own.where("_r IS NOT NULL") if register else own).mapInPandas(run, schema)


def reweighted(densities: DataFrame, priors: list[tuple], dates: str = "dates", log_density: str = "log_density") -> DataFrame:
    """Each stored log density under each prior (name, center, width): numbers, columns of densities for a row's own prior, or a width of None, which is flat.

    Adds (prior, point, mean, sd, low, high, ess) in place of the density. low and high bound the middle 68 hundredths; ess is the share of the likelihood's
    mass that the prior leaves effective: (sum of l w)^2 / (sum of l) / (sum of l w^2), for weights w of the prior scaled to at most 1. Nothing is fitted again.
    """
    number = lambda v: v if isinstance(v, Column) else F.lit(v)
    offered = [F.struct(F.lit(n).alias("prior"), number(c).cast("double").alias("center"), number(w).cast("double").alias("width")) for n, c, w in priors]
    met = densities.withColumn("_o", F.explode(F.array(*offered))).select(*densities.columns, "_o.*")
    d, x = F.col(dates), F.col(log_density)
    prior = lambda v: F.when(F.col("width").isNull(), F.lit(0.0)).otherwise(-0.5 * F.pow((v - F.col("center")) / F.col("width"), F.lit(2.0)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    product = lambda a, b: F.zip_with(a, b, lambda u, v: u * v)
    rows = met.withColumn("_w", F.zip_with(x, F.transform(d, prior), lambda a, b: a + b)).withColumn("_w", F.transform("_w", lambda v: F.exp(v - F.array_max("_w")))).withColumn("_l", F.transform(x, lambda v: F.exp(v - F.array_max(x)))).withColumn("_q", F.transform(d, prior))
    rows = rows.withColumn("_q", F.transform("_q", lambda v: F.exp(v - F.array_max("_q")))).withColumn("_s", total(F.col("_w")))
    rows = rows.withColumn("_p", F.transform("_w", lambda v: v / F.col("_s"))).withColumn("mean", total(product(F.col("_p"), d)))
    rows = rows.withColumn("sd", F.sqrt(F.greatest(total(F.zip_with("_p", d, lambda p, v: p * (v - F.col("mean")) * (v - F.col("mean")))), F.lit(0.0))))
    running = F.aggregate("_p", F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("c")), lambda acc, v: F.struct((acc["s"] + v).alias("s"), F.concat(acc["c"], F.array(acc["s"] + v)).alias("c")), lambda acc: acc["c"])
    rows = rows.withColumn("_c", running)
    at = lambda q: F.element_at(d, F.least(F.size(F.filter("_c", lambda v: v < q)) + 1, F.size(d)))
    lw = product(F.col("_l"), F.col("_q"))
    ess = F.pow(total(lw), F.lit(2.0)) / (total(F.col("_l")) * total(product(lw, F.col("_q"))))
    point = F.element_at(d, F.array_position("_w", F.array_max("_w")).cast("int"))
    return rows.select(*[c for c in densities.columns if c not in (dates, log_density)], "prior", point.alias("point"), "mean", "sd", at(0.16).alias("low"), at(0.84).alias("high"), ess.alias("ess"))


def prior_verdicts(summaries: DataFrame, key: list[str], own: str = "scholarly", other: str = "wide", flat: str = "flat", strong: float = 80.0, mild: float = 30.0) -> DataFrame:
    """(key..., point_own, point_other, point_flat, shift, verdict): how far the point moves from the wide prior to the row's own."""
    point = lambda name: F.max(F.when(F.col("prior") == name, F.col("point")))
    wide = summaries.groupBy(*key).agg(point(own).alias("point_own"), point(other).alias("point_other"), point(flat).alias("point_flat"))
    shift = F.col("point_own") - F.col("point_other")
    verdict = F.when(F.abs(shift) > strong, "prior-dominated").when(F.abs(shift) > mild, "mildly prior-influenced").otherwise("data-driven")
    return wide.withColumn("shift", shift).withColumn("verdict", verdict)
