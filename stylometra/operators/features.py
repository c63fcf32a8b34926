"""Long feature tables (row, grp, feature, value): filters, imputation, scaling, rank screens, group statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import mean_rank


def usable(long: DataFrame, most_null: float = 0.2, most_zero: float | None = None) -> DataFrame:
    """Features that vary (sample deviation above 0) with fewer nulls, and fewer zeros, than the shares given."""
    nulls, zeros = F.avg(F.col("value").isNull().cast("int")), F.avg((F.col("value") == 0).cast("int"))
    stats = long.groupBy("feature").agg(F.stddev_samp("value").alias("sd"), nulls.alias("null_share"), zeros.alias("zero_share"))
    keep = (F.col("sd") > 0) & (F.col("null_share") < most_null)
    return stats.where(keep if most_zero is None else keep & (F.col("zero_share") < most_zero))


def prevalent(long: DataFrame, least: int) -> DataFrame:
    """Features above 0 in at least so many groups."""
    return long.where("value > 0").groupBy("feature").agg(F.countDistinct("grp").alias("n_groups")).where(F.col("n_groups") >= least)


def impute_median(long: DataFrame, training: Column) -> DataFrame:
    """Nulls become the feature's median over the training rows."""
    med = long.where(training).groupBy("feature").agg(F.median("value").alias("med"))
    return long.join(med, "feature", "left").withColumn("value", F.coalesce("value", "med")).drop("med")


def join_statistics(rows: DataFrame, statistics: DataFrame, by: list[str]) -> DataFrame:
    """rows joined (inner, nulls meet nulls) with a table of statistics by group; Spark sends it to every task where it is small."""
    names = [f"_by{k}" for k in range(len(by))]
    right = statistics.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], *[c for c in statistics.columns if c not in by])
    met = F.lit(True)
    for c, n in zip(by, names, strict=True):
        met = met & F.col(c).eqNullSafe(F.col(n))
    return rows.join(right, met).drop(*names)


def standardise(long: DataFrame, training: Column | None = None) -> DataFrame:
    """z by the population moments of the training rows; a deviation of 0 counts as 1."""
    x = F.col("value") if training is None else F.when(training, F.col("value"))
    moments = long.groupBy("feature").agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_sd"))
    z = (F.col("value") - F.col("_m")) / F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    return join_statistics(long, moments, ["feature"]).withColumn("z", z).drop("_m", "_sd")


def composite(z: DataFrame, directions: DataFrame) -> DataFrame:
    """Mean of signed z of each row over the features of directions (feature, direction)."""
    return z.join(F.broadcast(directions), "feature").groupBy("row").agg(F.avg(F.col("direction") * F.col("z")).alias("score"))


def running_counts(df: DataFrame, by: list[str], value: str, blocks: int = 64) -> DataFrame:
    """(by..., value, _n, _before): how many rows of the group have each value, and how many a lesser one. Nulls are left out.

    Equal values are counted before they meet. Counts run within blocks between quantiles of the value; only the blocks'
    sums meet in one window.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    cuts = counts.agg(F.percentile_approx(F.col(value).cast("double"), [k / blocks for k in range(1, blocks)], 10000).alias("c")).head()["c"] or []
    edges = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    own = counts.withColumn("_b", F.size(F.filter(edges, lambda c: c < F.col(value).cast("double"))))
    sums = own.groupBy(*by, "_b").agg(F.sum("_n").alias("_s"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*by, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ran = own.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return join_statistics(ran, base, [*by, "_b"]).select(*by, value, "_n", (F.col("_base") + F.col("_in")).alias("_before"))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """rho and n in each group of by; ties have mean ranks. Without groups ranks come from running counts of values."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if by:
        ranked = known.select(*by, mean_rank(by, F.col(x)).alias("_x"), mean_rank(by, F.col(y)).alias("_y"))
    else:
        pairs = known.groupBy(F.col(x).alias("_u"), F.col(y).alias("_v")).agg(F.count("*").alias("_c"))
        rank = F.col("_before") + (F.col("_n") + 1) / 2
        ranked = pairs.join(running_counts(known.select(F.col(x).alias("_u")), [], "_u").select("_u", rank.alias("_x")), "_u").join(running_counts(known.select(F.col(y).alias("_v")), [], "_v").select("_v", rank.alias("_y")), "_v")
        s = ranked.agg(F.sum("_c").alias("n"), *[F.sum(F.col("_c") * e).alias(k) for k, e in (("sx", F.col("_x")), ("sy", F.col("_y")), ("sxx", F.col("_x") * F.col("_x")), ("syy", F.col("_y") * F.col("_y")), ("sxy", F.col("_x") * F.col("_y")))])
        n = F.col("n")
        cov, vx, vy = n * F.col("sxy") - F.col("sx") * F.col("sy"), n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
        return s.select(F.try_divide(cov, F.sqrt(vx * vy)).alias("rho"), F.coalesce("n", F.lit(0)).alias("n"))
    return ranked.groupBy(*by).agg(F.corr("_x", "_y").alias("rho"), F.count("*").alias("n"))


def centred(df: DataFrame, by: list[str], value: str, least: int = 1) -> DataFrame:
    """value less its group's mean, in groups of at least so many rows."""
    means = df.groupBy(*by).agg(F.count("*").alias("_n"), F.avg(value).alias("_m")).where(F.col("_n") >= least)
    return join_statistics(df, means, by).withColumn("centred", F.col(value) - F.col("_m")).drop("_n", "_m")


def regression(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Slope, intercept, r and residual deviation (n - 2) of y on x in each group."""
    sxx, syy, sxy = F.regr_sxx(F.col(y), F.col(x)), F.regr_syy(F.col(y), F.col(x)), F.regr_sxy(F.col(y), F.col(x))
    rest = F.greatest(syy - F.try_divide(sxy * sxy, sxx), F.lit(0.0))
    return df.groupBy(*by).agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"), F.corr(x, y).alias("r"), F.sqrt(F.try_divide(rest, F.count("*") - 2)).alias("resid_sd"))


def weighted_line(df: DataFrame, by: list[str], x: str, y: str, w: str) -> DataFrame:
    """Weighted least squares a + b x from weighted sums."""
    W, X, Y = F.col(w), F.col(x), F.col(y)
    s = df.groupBy(*by).agg(F.sum(W).alias("sw"), F.sum(W * X).alias("swx"), F.sum(W * Y).alias("swy"), F.sum(W * X * X).alias("swxx"), F.sum(W * X * Y).alias("swxy"))
    det = F.col("sw") * F.col("swxx") - F.col("swx") * F.col("swx")
    b = F.try_divide(F.col("sw") * F.col("swxy") - F.col("swx") * F.col("swy"), det)
    return s.select(*by, b.alias("b"), ((F.col("swy") - b * F.col("swx")) / F.col("sw")).alias("a"), F.try_divide(F.col("swxx"), det).alias("cov11"))


def icc(long: DataFrame) -> DataFrame:
    """One-way ICC(1) of each feature with unequal groups, design effect and effective n."""
    g = long.where("value IS NOT NULL").groupBy("feature", "grp").agg(F.count("*").alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count("*")).alias("ssw"))
    grand = F.sum(F.col("n") * F.col("m")).over(Window.partitionBy("feature")) / F.sum("n").over(Window.partitionBy("feature"))
    s = g.withColumn("gm", grand).groupBy("feature").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum("ssw").alias("ssw"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), 2)).alias("ssb"))
    n0 = (F.col("n") - F.col("nn") / F.col("n")) / (F.col("k") - 1)
    msb, msw = F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("n") - F.col("k"))
    s = s.withColumn("icc", F.try_divide(msb - msw, msb + (n0 - 1) * msw)).withColumn("n0", n0)
    effect = 1 + (F.col("n") / F.col("k") - 1) * F.greatest("icc", F.lit(0.0))
    return s.select("feature", "k", "n", "n0", "icc", effect.alias("design_effect"), (F.col("n") / effect).alias("n_eff"))


def eta_squared(long: DataFrame) -> DataFrame:
    """Share of each feature's variance between groups."""
    g = long.groupBy("feature", "grp").agg(F.count("value").alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count("value")).alias("ssw"))
    w = Window.partitionBy("feature")
    g = g.withColumn("gm", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    s = g.groupBy("feature").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), 2)).alias("ssb"), F.sum("ssw").alias("ssw"))
    return s.select("feature", F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw")).alias("eta2"))


def leave_one_out_signs(groups: DataFrame, x: str = "value", y: str = "y") -> DataFrame:
    """groups: (feature, grp, value, y), one row a group. Share of leave-one-out correlations with the sign of the whole: the sums of all less those of each group."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    own = groups.where(both).withColumn("_x", F.col(x).cast("double")).withColumn("_y", F.col(y).cast("double"))
    means = own.groupBy("feature").agg(F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"))
    c = join_statistics(own, means, ["feature"]).select("feature", (F.col("_x") - F.col("_mx")).alias("u"), (F.col("_y") - F.col("_my")).alias("v"))
    sums = c.groupBy("feature").agg(F.count("*").alias("n"), F.sum("u").alias("su"), F.sum("v").alias("sv"), F.sum(F.col("u") * F.col("v")).alias("suv"), F.corr("u", "v").alias("r_all"))
    n, a, b = F.col("n") - 1, F.col("su") - F.col("u"), F.col("sv") - F.col("v")
    cov = (F.col("suv") - F.col("u") * F.col("v")) - a * b / n  # a correlation has the sign of its covariance
    signs = join_statistics(c, sums, ["feature"]).where("n > 1").withColumn("_same", (F.signum(cov) == F.signum("r_all")).cast("int"))
    return signs.groupBy("feature").agg(F.first("r_all").alias("r_all"), F.avg("_same").alias("same_sign"))


def global_rank(df: DataFrame, value: str, tie: str, blocks: int = 64) -> DataFrame:
    """Adds rank, 1 for the least (value, tie) of the whole table. Rows are ranked within blocks between quantiles of the value; only counts of blocks meet."""
    cuts = df.agg(F.percentile_approx(value, [k / blocks for k in range(1, blocks)], 10000).alias("c")).first()["c"] or []
    edges = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    b = df.withColumn("_b", F.size(F.filter(edges, lambda c: c < F.col(value))))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = b.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    ranked = b.withColumn("rank", F.row_number().over(Window.partitionBy("_b").orderBy(value, tie)))
    return ranked.join(F.broadcast(base), "_b").withColumn("rank", F.col("rank") + F.col("_n0")).drop("_b", "_n0")  # at most `blocks` rows


def step_up(p: DataFrame, q: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg over (feature, p): adds rank and accepted. The largest accepted rank counts for all below. Null p are left out."""
    known = p.where("p IS NOT NULL")
    m = known.count()
    ranked = global_rank(known, "p", "feature")
    top = ranked.agg(F.coalesce(F.max(F.when(F.col("p") <= F.col("rank") / F.lit(m) * q, F.col("rank"))), F.lit(0)).alias("top"))
    return ranked.crossJoin(F.broadcast(top)).withColumn("accepted", F.col("rank") <= F.col("top")).drop("top")  # top is one row


def auc(df: DataFrame, score: str, positive: Column, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve in rank-sum form. Equal scores are counted before they meet."""
    by = by or []
    p = positive.cast("int")
    rows = df.where(F.col(score).isNotNull() & p.isNotNull()).select(*by, F.col(score).alias("_v"), p.alias("_p"))
    ends = rows.groupBy(*by).agg(F.sum("_p").alias("n_pos"), F.sum(1 - F.col("_p")).alias("n_neg"))
    positives = rows.where("_p = 1").groupBy(*by, "_v").agg(F.count("*").alias("_pos"))
    less = running_counts(rows, by, "_v").join(positives, [*by, "_v"])
    total = F.sum(F.col("_pos") * (F.col("_before") + (F.col("_n") + 1) / 2))
    s = less.groupBy(*by).agg(total.alias("_rs"))
    s = s.join(ends, by) if by else s.crossJoin(F.broadcast(ends))  # one row
    return s.select(*by, "n_pos", "n_neg", F.try_divide(F.col("_rs") - F.col("n_pos") * (F.col("n_pos") + 1) / 2, F.col("n_pos") * F.col("n_neg")).alias("auc"))


def concordance(df: DataFrame, key: str, truth: str, pred: str) -> DataFrame:
    """Share of pairs in the right order; pairs tied in truth are left out, ties in prediction are wrong. For tables of groups."""
    a = df.select(F.col(key).alias("k1"), F.col(truth).alias("t1"), F.col(pred).alias("p1"))
    b = df.select(F.col(key).alias("k2"), F.col(truth).alias("t2"), F.col(pred).alias("p2"))
    pairs = a.join(b, (F.col("k1") < F.col("k2")) & (F.col("t1") != F.col("t2")))
    right = ((F.col("p1") - F.col("p2")) * (F.col("t1") - F.col("t2")) > 0).cast("int")
    return pairs.agg(F.count("*").alias("n_pairs"), F.avg(right).alias("concordance"))


def density_weights(df: DataFrame, value: str, width: float) -> DataFrame:
    """Inverse Gaussian density at each row's own value, scaled to mean 1. Density is summed over distinct values, not rows."""
    points = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    other = points.select(F.col("_v").alias("_u"), F.col("_c").alias("_d"))
    dens = points.join(other).groupBy("_v").agg(F.sum(F.col("_d") * F.exp(-0.5 * F.pow((F.col("_v") - F.col("_u")) / width, 2))).alias("_s"))
    out = df.join(dens, F.col(value) == F.col("_v")).withColumn("weight", 1 / F.greatest("_s", F.lit(1e-9)))
    mean = out.agg(F.avg("weight").alias("_m"))
    return out.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("weight") / F.col("_m")).drop("_m", "_v", "_s")
