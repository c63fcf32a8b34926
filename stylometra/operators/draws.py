"""Monte Carlo bands: every row under every draw of a noise column, folded to sums of draws before anything is ordered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(row: Column, draw: Column) -> Column:
    """Uniform in (0, 1) by hash: the same for a row and draw in every run and partitioning."""
    return (F.pmod(F.xxhash64(row, draw), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def normal(row: Column, draw: Column) -> Column:
    """Standard normal by hash (Box and Muller)."""
    return F.sqrt(-2 * F.ln(uniform(row, draw))) * F.cos(2 * F.pi() * uniform(F.xxhash64(row, F.lit("angle")), draw))


def under_draws(df: DataFrame, draws: int) -> DataFrame:
    return df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))


def bands(draws: DataFrame, by: list[str], value: str, levels: tuple[float, ...] = (0.16, 0.5, 0.84)) -> DataFrame:
    """Interpolated percentiles of a value over draws: one column p16, p50, ... for each level. A group has as many values as draws."""
    return draws.groupBy(*by).agg(*[F.percentile(value, F.lit(x)).alias(f"p{round(100 * x)}") for x in levels])


def perturbed_windows(df: DataFrame, row: str, date: str, sd: str, value: str, width: int, step: int, draws: int, noise: Callable = normal) -> DataFrame:
    """(centre, p16, p50, p84): means of a value in sliding windows of dates (whole widths and steps), each date moved by sd x noise in each draw.

    A row meets only the windows that its moved date is in; nulls in any of the columns leave the row out.
    """
    rows = df.where(F.col(row).isNotNull() & F.col(date).isNotNull() & F.col(sd).isNotNull() & F.col(value).isNotNull())
    moved = under_draws(rows, draws).withColumn("_d", F.col(date) + F.col(sd) * noise(F.col(row), F.col("draw")))
    half = width / 2
    low, high = F.ceil((F.col("_d") - half) / step), F.floor((F.col("_d") + half) / step)
    inside = moved.where(low <= high).withColumn("_c", F.explode(F.sequence(low, high))).withColumn("centre", F.col("_c") * step)
    return bands(inside.groupBy("centre", "draw").agg(F.avg(value).alias("_m")), ["centre"], "_m")


def removed_by_tier(df: DataFrame, by: list[str], row: str, chance: str, value: str, draws: int, noise: Callable = uniform) -> DataFrame:
    """Bands of the mean of what stays when each row is removed with its own chance (null: never) in each draw."""
    u = noise(F.col(row), F.col("draw"))
    kept = under_draws(df.where(F.col(row).isNotNull()), draws).where(u >= F.coalesce(chance, F.lit(0.0)))
    return bands(kept.groupBy(*by, "draw").agg(F.avg(value).alias("_m")), by, "_m")


def calibration_lines(points: DataFrame, row: str, truth: str, sd: str, pred: str, draws: int, noise: Callable = normal) -> DataFrame:
    """(draw, a, b): lines truth = a + b pred through control points, weighted by 1 / sd^2, truths moved by sd x noise."""
    moved = under_draws(points.where((F.col(sd) > 0) & F.col(truth).isNotNull() & F.col(pred).isNotNull()), draws)
    w, x, y = 1 / (F.col(sd) * F.col(sd)), F.col(pred), F.col(truth) + F.col(sd) * noise(F.col(row), F.col("draw"))
    s = moved.groupBy("draw").agg(F.sum(w).alias("n"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * x).alias("xx"), F.sum(w * x * y).alias("xy"))
    s = s.withColumn("b", F.try_divide(F.col("n") * F.col("xy") - F.col("x") * F.col("y"), F.col("n") * F.col("xx") - F.col("x") * F.col("x")))
    return s.select("draw", ((F.col("y") - F.col("b") * F.col("x")) / F.col("n")).alias("a"), "b")


def calibrate(targets: DataFrame, by: list[str], pred: str, lines: DataFrame) -> DataFrame:
    """Bands of a + b pred over the lines. lines has one row a draw and is the small side by the number of draws."""
    return bands(targets.crossJoin(F.broadcast(lines)).withColumn("_c", F.col("a") + F.col("b") * F.col(pred)), by, "_c")


def nested_probability(groups: DataFrame, key: str, x: str, y: str, cut: float) -> DataFrame:
    """(key, pred, n, prob): for each group, the chance that its date is below the cut by residuals of an inner leave-one-out.

    For a group i all others are fitted by a line; each other j is dated by the line without i and j, and j's residual is added
    to i's prediction. Sums of all groups less two terms give each inner line, so a pair costs one expression. One row a group:
    pairs are of groups (books), never of passages.
    """
    g = groups.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    t = g.agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    one = g.crossJoin(F.broadcast(t)).select("k", "x", "y", *[(F.col(a) - b).alias(a) for a, b in (("n", F.lit(1)), ("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") * F.col("x")), ("sxy", F.col("x") * F.col("y")))])

    def at(n, sx, sy, sxx, sxy, where):
        b = F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)
        return (sy - b * sx) / n + b * where

    pred = at(F.col("n"), F.col("sx"), F.col("sy"), F.col("sxx"), F.col("sxy"), F.col("x"))
    other = g.select(F.col("k").alias("k2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = one.withColumn("pred", pred).join(other, F.col("k") != F.col("k2"))
    inner = at(F.col("n") - 1, F.col("sx") - F.col("x2"), F.col("sy") - F.col("y2"), F.col("sxx") - F.col("x2") * F.col("x2"), F.col("sxy") - F.col("x2") * F.col("y2"), F.col("x2"))
    below = (F.col("pred") + F.col("y2") - inner < cut).cast("int")
    return pairs.groupBy(F.col("k").alias(key), "pred").agg(F.count("*").alias("n"), F.avg(below).alias("prob"))


def clip(words: DataFrame, ranges: DataFrame, on: list[str], place: str, low: str, high: str) -> DataFrame:
    """Words whose place is within a range of the same section (equal keys, then a band); a word may be in several ranges."""
    return words.join(ranges, on).where(F.col(place).between(F.col(low), F.col(high)))
