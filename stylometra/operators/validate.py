"""Validation operators: calibration, conformal intervals, jackknife+, posteriors on grids, resampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import running_counts


def variance_match(df: DataFrame, truth: str, pred: str, low: float = 0.5, high: float = 8.0) -> DataFrame:
    """Predictions stretched about their mean to the deviation of the truth; the stretch is clipped."""
    s = df.agg(F.avg(truth).alias("_mt"), F.avg(pred).alias("_mp"), F.stddev_pop(truth).alias("_st"), F.stddev_pop(pred).alias("_sp"))
    scale = F.least(F.greatest(F.try_divide(F.col("_st"), F.col("_sp")), F.lit(low)), F.lit(high))
    return df.crossJoin(F.broadcast(s)).withColumn("calibrated", F.col("_mt") + scale * (F.col(pred) - F.col("_mp"))).drop("_mt", "_mp", "_st", "_sp")


def regression_calibration(df: DataFrame, truth: str, pred: str, low: float = 0.5, high: float = 4.0) -> DataFrame:
    s = df.agg(F.avg(truth).alias("_mt"), F.avg(pred).alias("_mp"), F.try_divide(F.covar_pop(truth, pred), F.var_pop(pred)).alias("_b"))
    slope = F.least(F.greatest("_b", F.lit(low)), F.lit(high))
    return df.crossJoin(F.broadcast(s)).withColumn("calibrated", F.col("_mt") + slope * (F.col(pred) - F.col("_mp"))).drop("_mt", "_mp", "_b")


def conformal(residuals: DataFrame, value: str, levels: list[float], by: list[str] | None = None, clamp: bool = False) -> DataFrame:
    """Half-width of each level: the ceil((n + 1) a)-th least absolute residual, infinite (or the greatest) beyond n.

    Equal residuals are counted before they meet; running counts are taken in blocks of the values' order.
    """
    by = by or []
    known = residuals.where(F.col(value).isNotNull()).select(*by, F.abs(F.col(value)).alias("_r"))
    ran = running_counts(known, by, "_r")
    sizes = known.groupBy(*by).agg(F.count("*").alias("n"), F.max("_r").alias("_top"))
    each = sizes.withColumn("level", F.explode(F.array(*[F.lit(a) for a in levels])))
    each = each.withColumn("k", F.ceil((F.col("n") + 1) * F.col("level") - 1e-9).cast("int")).where("n > 0")
    wanted = each.withColumn("_k", F.least("k", "n"))
    hit = ran.join(wanted, by) if by else ran.crossJoin(F.broadcast(wanted))  # without groups a row for each level
    hit = hit.where((F.col("_k") > F.col("_before")) & (F.col("_k") <= F.col("_before") + F.col("_n")))
    beyond = F.col("_top") if clamp else F.lit(math.inf)
    return hit.select(*by, "level", F.col("n").cast("int").alias("n"), "k", F.when(F.col("k") <= F.col("n"), F.col("_r")).otherwise(beyond).alias("half_width"))


def jackknife_plus(folds: DataFrame, by: list[str], alpha: float) -> DataFrame:
    """folds: (by..., v, r), the prediction without each fold and that fold's absolute residual; one row of limits for each by."""
    s = folds.groupBy(*by).agg(F.array_sort(F.collect_list(F.col("v") - F.col("r"))).alias("lo"), F.array_sort(F.collect_list(F.col("v") + F.col("r"))).alias("hi"))
    n = F.size("lo")
    k_lo, k_hi = F.floor(alpha * (n + 1) + 1e-9).cast("int"), F.ceil((1 - alpha) * (n + 1) - 1e-9).cast("int")
    return s.select(*by, n.alias("n"), F.when(k_lo >= 1, F.try_element_at("lo", F.greatest(k_lo, F.lit(1)))).otherwise(-math.inf).alias("lower"), F.when(k_hi <= n, F.try_element_at("hi", F.least(k_hi, n))).otherwise(math.inf).alias("upper"))


def credible(post: DataFrame, by: list[str], at: str, mass: str, level: float) -> DataFrame:
    """Equal-tailed interval of a discrete posterior: where the running mass first reaches each tail."""
    w = Window.partitionBy(*by).orderBy(at)
    total = F.sum(mass).over(Window.partitionBy(*by))
    c = post.withColumn("_c", F.sum(mass).over(w) / total)
    a = (1 - level) / 2
    return c.groupBy(*by).agg(F.min(F.when(F.col("_c") >= a - 1e-12, F.col(at))).alias("lower"), F.min(F.when(F.col("_c") >= 1 - a - 1e-12, F.col(at))).alias("upper"), F.max_by(F.col(at), F.struct(F.col(mass), -F.col(at))).alias("mode"))


def densest(post: DataFrame, by: list[str], at: str, mass: str, level: float) -> DataFrame:
    """Least and greatest point of the densest set whose running mass stays within the level."""
    w = Window.partitionBy(*by).orderBy(F.desc(mass), at)
    c = post.withColumn("_c", F.sum(mass).over(w) / F.sum(mass).over(Window.partitionBy(*by)))
    return c.where(F.col("_c") <= level + 1e-12).groupBy(*by).agg(F.min(at).alias("lower"), F.max(at).alias("upper"))


def permuted(df: DataFrame, draws: int, label: str, strata: list[str] | None = None, seed: int = 0) -> DataFrame:
    """Each draw deals the labels anew, within strata if given: rows in key order meet labels in the order of a hash."""
    strata, spark = strata or [], df.sparkSession
    d = spark.range(draws).withColumnRenamed("id", "draw")
    base = df.withColumn("_id", F.xxhash64(*df.columns))
    every = base.crossJoin(F.broadcast(d))
    spot = Window.partitionBy("draw", *strata).orderBy("_id")
    deal = Window.partitionBy("draw", *strata).orderBy(F.xxhash64(F.lit(seed), "draw", "_id"))
    a = every.withColumn("_k", F.row_number().over(spot)).drop(label)
    b = every.select("draw", *strata, F.col(label), F.row_number().over(deal).alias("_k"))
    return a.join(b, ["draw", *strata, "_k"]).drop("_k", "_id")


def bootstrap_mean(df: DataFrame, by: list[str], value: str, draws: int, row: list[str], seed: int = 0) -> DataFrame:
    """Poisson bootstrap: every row's weight in a draw is a Poisson(1) number from a hash of its key (the columns row), so no row is moved. Rows of one key are drawn together."""
    d = df.sparkSession.range(draws).withColumnRenamed("id", "draw")
    u = F.pmod(F.xxhash64(F.lit(seed), "draw", *row), F.lit(1 << 40)) / float(1 << 40)
    w, total, term = F.lit(0), 0.0, math.exp(-1)
    for k in range(8):
        total += term
        w = w + (u >= total).cast("int")
        term /= k + 1
    x = df.crossJoin(F.broadcast(d)).withColumn("_w", w)
    return x.groupBy(*by, "draw").agg(F.try_divide(F.sum(F.col("_w") * F.col(value)), F.sum("_w")).alias("mean"))


def subsample(df: DataFrame, by: list[str], n: int, draws: int, row: list[str], seed: int = 0) -> DataFrame:
    """n rows of each group without replacement in each draw, by the least hashes of their keys (the columns row; ties by the key itself)."""
    d = df.sparkSession.range(draws).withColumnRenamed("id", "draw")
    w = Window.partitionBy("draw", *by).orderBy(F.xxhash64(F.lit(seed), "draw", *row), *row)
    return df.crossJoin(F.broadcast(d)).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def p_value(null: DataFrame, observed: Column, statistic: str) -> Column:
    return (F.count(F.when(F.col(statistic) >= observed, 1)) + 1) / (F.count("*") + 1)


def prefix_p(draws: DataFrame, order: str, hit: str, block: int = 1 << 14) -> DataFrame:
    """Adds p, (hits + 1) / (draws + 1) over each prefix in the order of a distinct whole number.

    Running counts are taken within blocks of the order key; only one row a block meets in the window over blocks.
    """
    b = draws.withColumn("_b", F.floor(F.col(order) / block)).withColumn("_h", F.col(hit).cast("long"))
    blocks = b.groupBy("_b").agg(F.sum("_h").alias("h"), F.count("*").alias("n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("_b", F.coalesce(F.sum("h").over(before), F.lit(0)).alias("_h0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n0"))
    w = Window.partitionBy("_b").orderBy(order)
    ran = b.withColumn("_hr", F.sum("_h").over(w)).withColumn("_nr", F.row_number().over(w))
    return ran.join(base, "_b").withColumn("p", (F.col("_h0") + F.col("_hr") + 1) / (F.col("_n0") + F.col("_nr") + 1)).drop("_b", "_h", "_hr", "_nr", "_h0", "_n0")
