"""Queries over Gaussian models by register."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import gaussian as G
from ..operators import variational as V
from ..sources.tables import stored, table
from .registry import query, r6

GRID = [k * 0.25 for k in range(-8, 60)]
SHARES = {"r0": 0.5, "r1": 0.3, "r2": 0.2}


def _rows(spark, d):
    return table(spark, d, "embeddings").where("label IS NOT NULL").select("vec_id", F.concat(F.lit("r"), (F.col("label") % 3).cast("string")).alias("register"), F.col("label").cast("double").alias("y"), "embedding", (1 / (1 + F.col("vec_id") % 3)).alias("w"))


def _read(out):
    return out.select("vec_id", "form", "prior", "point", r6("mean", "mean"), r6("sd", "sd"), "low", "high", r6("ess", "ess"))


@query()
def md8_md10_register_models(spark, d):
    """Every vector under its own register's weighted lines with an absolute ridge: the likelihood alone and with a prior."""
    rows = _rows(spark, d)
    models = G.register_lines(rows, "register", "embedding", "y", 0.0, 0.05, "w")
    return _read(V.reweighted(stored(G.densities(rows, "vec_id", "embedding", models, GRID, "register"), "densities"), [("flat", None, None), ("wide", 4.5, 3.0)]))


@query()
def md8_condition_report(spark, d):
    models = G.register_lines(_rows(spark, d), "register", "embedding", "y", 0.1, 0.0, "w")
    return spark.createDataFrame([(r, float(m.n), m.condition) for r, m in models.items()], "register string, rows double, condition double").select("register", r6("rows", "rows"), F.round("condition", 3).alias("condition"))


@query()
def md11_three_registers(spark, d):
    """Every vector under a mixture of three registers."""
    rows = _rows(spark, d)
    models = G.register_lines(rows, "register", "embedding", "y", 0.1)
    return _read(V.reweighted(stored(G.densities(rows, "vec_id", "embedding", models, GRID, shares=SHARES), "densities"), [("flat", None, None), ("wide", 4.5, 3.0)]))


@query()
def md13_genre_variants(spark, d):
    """The four forms of each register's model, by components' ratios of genre to date variance."""
    rows = _rows(spark, d)
    models = G.register_lines(rows, "register", "embedding", "y", 0.1)
    ratios = np.arange(64) % 5 / 4.0
    return _read(V.reweighted(stored(G.densities(rows, "vec_id", "embedding", models, GRID, "register", ratios=ratios, mismatch=0.5), "densities"), [("wide", 4.5, 3.0)]))
