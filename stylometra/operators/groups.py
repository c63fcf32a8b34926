"""Statistics of grouped and paired rows: tests, errors, scores, ledgers, matched pairs, scenario grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import mean_rank
from ..functions.tails import t_p_value


def first_of(df: DataFrame, by: list[str], *order) -> DataFrame:
    """One row of each group: the first in an order that must leave no ties."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


def select_existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that there are, in the wanted order."""
    return df.select(*[F.col(f"`{c}`") for c in wanted if c in df.columns])


def upsert_if_greater(old: DataFrame, new: DataFrame, key: str, size: str, force: bool = False) -> DataFrame:
    """Rows of both; where both have a key the new one wins only if it's greater (or force), with the name of the side kept."""
    a, b = old.select(key, F.col(size).alias("_a")), new.select(key, F.col(size).alias("_b"))
    wins = F.col("_a").isNull() | (F.col("_b") > F.col("_a"))
    wins = F.col("_b").isNotNull() & (F.lit(True) if force else wins)
    return a.join(b, key, "full").select(key, F.when(wins, F.col("_b")).otherwise(F.col("_a")).alias(size), F.when(wins, "new").otherwise("old").alias("side"))


def errors(df: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """n, mean absolute error, bias and root mean square error; null pairs are left out."""
    e = F.col(pred) - F.col(truth)
    return df.where(e.isNotNull()).groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"))


def welch(df: DataFrame, by: list[str], value: str, first: Column) -> DataFrame:
    """t, degrees of freedom and two-sided p of the rows where first holds against the others."""
    x = F.col(value)
    a, b = F.when(first, x), F.when(~first, x)
    s = df.groupBy(*by).agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"))
    q1, q2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    s = s.withColumn("t", F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(q1 + q2))).withColumn("df", F.try_divide((q1 + q2) * (q1 + q2), q1 * q1 / (F.col("n1") - 1) + q2 * q2 / (F.col("n2") - 1)))
    return s.withColumn("p", t_p_value(F.col("t"), F.col("df")))


def signed_ranks(df: DataFrame, by: list[str], difference: str) -> DataFrame:
    """Wilcoxon sums of the ranks of absolute differences by sign; zeros are left out, ties have mean ranks."""
    d = df.where(F.col(difference) != 0).withColumn("_a", F.abs(F.col(difference)))
    r = d.withColumn("_r", mean_rank(by, F.col("_a")))
    up = F.col(difference) > 0
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(up).alias("n_up"), F.coalesce(F.sum(F.when(up, F.col("_r"))), F.lit(0.0)).alias("w_up"), F.coalesce(F.sum(F.when(~up, F.col("_r"))), F.lit(0.0)).alias("w_down"))


def two_predictor_ols(df: DataFrame, by: list[str], y: str, x1: str, x2: str) -> DataFrame:
    """Coefficients of y on two predictors and a constant, from one pass of covariances."""
    c = lambda a, b: F.covar_pop(a, b)
    s = df.groupBy(*by).agg(c(x1, x1).alias("a"), c(x1, x2).alias("b"), c(x2, x2).alias("c"), c(x1, y).alias("d"), c(x2, y).alias("e"), F.avg(y).alias("my"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"))
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    b1, b2 = F.try_divide(F.col("c") * F.col("d") - F.col("b") * F.col("e"), det), F.try_divide(F.col("a") * F.col("e") - F.col("b") * F.col("d"), det)
    return s.select(*by, b1.alias("b1"), b2.alias("b2"), (F.col("my") - b1 * F.col("m1") - b2 * F.col("m2")).alias("b0"))


def share_between(df: DataFrame, group: str, value: str) -> DataFrame:
    """Share of the variance of a value that lies between groups, from counts, means and squares of groups."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count("*")).alias("w"))
    between = F.var_pop("m")
    t = g.agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"), between.alias("v"), F.count("*").alias("k"))
    ssb = F.col("nmm") - F.col("nm") * F.col("nm") / F.col("n")
    return t.select("k", F.try_divide(ssb, ssb + F.col("w")).alias("share"), "v")


def leverage(df: DataFrame, family: Column, value: str) -> DataFrame:
    """For each family: rows, sum, L2 norm and share of the total absolute value."""
    g = df.groupBy(family.alias("family")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"), F.sum(F.abs(F.col(value))).alias("_a"))
    return g.withColumn("share", F.col("_a") / F.sum("_a").over(Window.partitionBy(F.lit(1)))).drop("_a")  # one row a family


def size_audit(sizes: DataFrame, by: list[str], size: str, low: int, high: int) -> DataFrame:
    """Least, median, greatest and mean size, share within a band, and groups of one."""
    x = F.col(size)
    return sizes.groupBy(*by).agg(F.count("*").alias("n"), F.min(x).alias("least"), F.median(x).alias("med"), F.max(x).alias("greatest"), F.avg(x).alias("mean"), F.avg(x.between(low, high).cast("int")).alias("in_band"))


def overlap(objects: DataFrame, chunks: DataFrame, obj: str, member: str, chunk: str) -> DataFrame:
    """For each chunk the objects that it touches, those wholly inside it, and the others. objects: (obj, member); chunks: (chunk, member)."""
    size = objects.groupBy(obj).agg(F.count("*").alias("_size"))
    inside = objects.join(chunks, member).groupBy(chunk, obj).agg(F.count("*").alias("_in"))
    full = (F.col("_in") == F.col("_size")).cast("int")
    return inside.join(size, obj).groupBy(chunk).agg(F.count("*").alias("touched"), F.sum(full).alias("whole"), F.sum(1 - full).alias("part"))


def shortest_interval(post: DataFrame, by: list[str], at: str, mass: str, level: float) -> DataFrame:
    """The narrowest run of grid points that holds the level; of equal widths the lowest. Each start meets its grid, not the rows."""
    w = Window.partitionBy(*by).orderBy(at)
    total = F.sum(mass).over(Window.partitionBy(*by))
    c = post.withColumn("_c", F.sum(mass).over(w) / total).withColumn("_m", F.col(mass) / total)
    grid = c.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("x"), F.col("_c").alias("c")))).alias("_g"))
    ends = c.join(grid, by).withColumn("_e", F.filter("_g", lambda g: g["c"] - (F.col("_c") - F.col("_m")) >= level - 1e-9)).where(F.size("_e") > 0)
    best = F.min(F.struct((F.col("_e")[0]["x"] - F.col(at)).alias("width"), F.col(at).alias("lower"), F.col("_e")[0]["x"].alias("upper")))
    return ends.groupBy(*by).agg(best.alias("b")).select(*by, "b.lower", "b.upper")


def runs(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Adds run_no: 0 for the first run of equal values of each group, one more at each change."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1)).cast("long")
    return df.withColumn("_c", change).withColumn("run_no", F.sum("_c").over(w)).drop("_c")


def percentile_of(reference: DataFrame, points: DataFrame, value: str, at: str, blocks: int = 64) -> DataFrame:
    """Adds ecdf: the share of reference values at most `at`. Distinct values and points are counted within blocks between quantiles; only the blocks' sums meet."""
    c = reference.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    cuts = c.agg(F.percentile_approx("_x", [k / blocks for k in range(1, blocks)], 10000).alias("c")).head()["c"] or []
    edges = F.array(*[F.lit(float(x)) for x in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    own = points.where(F.col(at).isNotNull()).select(F.col(at).cast("double").alias("_x")).distinct()
    marks = c.select("_x", "_n", F.lit(0).alias("_side")).unionByName(own.select("_x", F.lit(0).cast("long").alias("_n"), F.lit(1).alias("_side")))
    marks = marks.withColumn("_b", F.size(F.filter(edges, lambda x: x < F.col("_x"))))
    sums = dict(marks.groupBy("_b").agg(F.sum("_n")).collect())  # at most `blocks` rows
    before = [sum(n for k, n in sums.items() if k < b) for b in range(len(set(cuts)) + 1)]
    inside = F.sum("_n").over(Window.partitionBy("_b").orderBy("_x", "_side"))
    share = F.try_divide(inside + F.element_at(F.array(*[F.lit(n) for n in before]), F.col("_b") + 1), F.lit(sum(sums.values())))
    ranked = marks.withColumn("ecdf", share).where("_side = 1").select("_x", "ecdf")
    return points.join(ranked, F.col(at).cast("double") == F.col("_x"), "left").drop("_x")


def scenarios(df: DataFrame, shifts: list[tuple], value: str, hit) -> DataFrame:
    """Each row under each scenario (name, shift): shifted where hit(name) holds."""
    s = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.when(hit(n), F.lit(float(x))).otherwise(0.0).alias("shift")) for n, x in shifts]))
    return df.withColumn("_s", s).withColumn("scenario", F.col("_s.scenario")).withColumn("shifted", F.col(value) + F.col("_s.shift")).drop("_s")
