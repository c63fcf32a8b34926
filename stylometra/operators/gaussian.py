"""Gaussian models of feature vectors about lines in the date: by register, weighted, shrunk, deweighted and inflated by genre, and mixtures of registers.

A model is fitted from one Gram matrix of its register (models.group_grams, weighted if asked): lines, and the covariance of what they leave, shrunk by a share of
its mean variance, by an absolute amount, or both. Rows get log densities on a grid of dates in tasks; variational.reweighted reads them under priors, flat ones included.
Rows with an unknown component have no density.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .matrix import moments
from .models import group_grams


@dataclass
class Lines:
    n: float
    intercept: np.ndarray
    slope: np.ndarray
    covariance: np.ndarray

    @property
    def condition(self) -> float:
        return float(np.linalg.cond(self.covariance))


def lines(gram: np.ndarray, relative: float = 0.0, absolute: float = 0.0) -> Lines:
    """Least squares of every component on y, and the sample covariance of the residuals plus (relative x its mean variance + absolute) on the diagonal."""
    n, m, c, cy, my = moments(gram)
    vy = gram[-1, -1] / n - my * my
    b = cy / vy if vy > 1e-12 else np.zeros_like(cy)
    s = (c - np.outer(b, b) * vy) * (n / (n - 1) if n > 1 else 1.0)
    return Lines(float(n), m - b * my, b, s + (relative * np.trace(s) / len(s) + absolute) * np.eye(len(s)))


def register_lines(df: DataFrame, register: str, vector: str, y: str, relative: float = 0.0, absolute: float = 0.0, weight: str | None = None) -> dict[str, Lines]:
    """A model for each register; weight is a column of row weights, scaled in each register so that they sum to its rows."""
    ship(df.sparkSession)
    known = df.where(F.col(register).isNotNull())
    if weight:
        mean = known.where(F.col(vector).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(register).alias("_r")).agg(F.avg(weight).alias("_w"))
        known = known.join(F.broadcast(mean), F.col(register) == F.col("_r")).withColumn("_weight", F.col(weight) / F.col("_w"))  # a row for each register
    return {r: lines(g, relative, absolute) for r, g in group_grams(known, register, vector, y, "_weight" if weight else None).items()}


def variants(model: Lines, ratios: np.ndarray, mismatch: float = 1.0) -> dict[str, np.ndarray]:
    """Precision matrices: plain; B, components weighed by 1 / (1 + ratio of genre to date variance); D, variances inflated by mismatch x ratio; and both."""
    weigh = np.diag(1 / (1 + ratios))
    wide = model.covariance + np.diag(np.diag(model.covariance) * mismatch * ratios)
    plain, inflated = np.linalg.inv(model.covariance), np.linalg.inv(wide)
    return {"Raw": plain, "B": weigh @ plain @ weigh, "D": inflated, "B+D": weigh @ inflated @ weigh}


def log_density(x: np.ndarray, model: Lines, grid: np.ndarray, precision: np.ndarray | None = None, normalised: bool = False) -> np.ndarray:
    """rows x grid: minus half the squared distance to the line at each date, a parabola in the date; normalised adds the log determinant, so that models compare."""
    p = np.linalg.inv(model.covariance) if precision is None else precision
    e = x - model.intercept
    c0, c1, c2 = np.einsum("ij,jk,ik->i", e, p, e), e @ p @ model.slope, float(model.slope @ p @ model.slope)
    out = -0.5 * (c0[:, None] - 2 * c1[:, None] * grid + c2 * grid**2)
    return out + 0.5 * np.linalg.slogdet(p)[1] if normalised else out


def mixture(parts: list[np.ndarray], shares: np.ndarray) -> np.ndarray:
    """Log of the sum of share x density; shares is rows x parts, a share of 0 takes its part out."""
    with np.errstate(divide="ignore"):
        each = np.stack([d + np.log(shares[:, k : k + 1]) for k, d in enumerate(parts)])
    top = each.max(axis=0)
    return top + np.log(np.exp(each - top).sum(axis=0))


def densities(rows: DataFrame, key: str, vector: str, models: dict[str, Lines], grid: list[float], register: str | None = None, shares: str | dict[str, float] | None = None, ratios: np.ndarray | None = None, mismatch: float = 1.0) -> DataFrame:
    """(key, form, dates, log_density). register: a column, each row under its own model; with ratios one row for each of the variants. shares: a column (map of register to share) or
    fixed shares, each row under the mixture of any number of registers. Rows of an unknown register, or whose shares name no known one, have no row."""
    ship(rows.sparkSession)
    names, at = sorted(models), np.array(grid, float)
    shared = rows.sparkSession.sparkContext.broadcast((models, {r: variants(models[r], ratios, mismatch) for r in names} if ratios is not None else None))
    share = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]) if isinstance(shares, dict) else F.col(shares) if shares else F.lit(None).cast("map<string,double>")
    own = rows.where(F.col(vector).isNotNull()).select(F.col(key), F.col(vector).cast("array<double>").alias("_x"), (F.col(register).cast("string") if register else F.lit(None).cast("string")).alias("_r"), F.array(*[F.coalesce(share[n].cast("double"), F.lit(0.0)) for n in names]).alias("_s"))
    own = own.where(~F.exists("_x", lambda v: v.isNull() | F.isnan(v)))
    own = own.where(F.col("_r").isin(*names)) if register else own.where(F.aggregate("_s", F.lit(0.0), lambda a, b: a + b) > 0)

    def run(frames):
        held, other = shared.value
        for f in frames:
            if not len(f):
                continue
            x = np.stack(f["_x"].to_numpy()).astype(float)
            out: list[tuple] = []
            if register:
                for r in sorted(set(f["_r"])):
                    mine = np.flatnonzero((f["_r"] == r).to_numpy())
                    for form, p in (other[r] if other else {r: None}).items():
                        out.append((mine, form, log_density(x[mine], held[r], at, p)))
            else:
                out.append((np.arange(len(f)), "mixture", mixture([log_density(x, held[n], at, None, True) for n in names], np.stack(f["_s"].to_numpy()).astype(float))))
            for mine, form, d in out:
                yield pd.DataFrame({key: f[key].to_numpy()[mine], "form": form, "dates": [list(grid)] * len(mine), "log_density": list(d)})

    return own.mapInPandas(run, f"`{key}` {dict(rows.dtypes)[key]}, form string, dates array<double>, log_density array<double>")
