"""Queries over the variational model: its fit, dates by evidence, and priors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import variational as V
from ..sources.tables import stored, table
from .registry import DIMS, dims, query, r6

GRID = [k * 0.25 for k in range(-8, 60)]
#: Steps and draws of the fit, draws for dates.
STEPS, SAMPLES, DRAWS = 3000, 32, 500


def _rows(spark, d):
    """Vectors with the label as date; every third label is of one register."""
    return table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("r"), (F.col("label") % 3).cast("string")).alias("register"), F.col("label").cast("double").alias("date"), "embedding")


def _model(spark, d) -> V.Fit:
    return V.fit(V.feature_sums(_rows(spark, d), "register", "embedding", "date"), STEPS, SAMPLES)


@query()
def md15_variational_fit(spark, d):
    """(register, feature, intercept, slope, log deviation), posterior means and deviations."""
    model = _model(spark, d)
    p, shape = V.parts(model.phi, model.sums.n.shape), model.sums.n.shape
    rows = [(r, f, *(float(x) for k in ("a", "b", "l") for x in (p[k][i, f], p["s" + k][i, f]))) for i, r in enumerate(model.sums.registers) for f in range(shape[1])]
    names = "intercept double, log_sd_intercept double, slope double, log_sd_slope double, log_deviation double, log_sd_deviation double"
    out = spark.createDataFrame(rows, f"register string, feature int, {names}")
    return out.select("register", "feature", *[r6(n.split()[0], n.split()[0]) for n in names.split(", ")])


@query()
def md16_date_evidence(spark, d):
    """Every vector's evidence under each register, the best of them, and the likeliest date there."""
    dates = V.date_densities(_rows(spark, d), "vec_id", "embedding", _model(spark, d), GRID, None, DRAWS)
    point = F.element_at("dates", F.array_position("log_density", F.array_max("log_density")).cast("int"))
    return dates.select("vec_id", "register", r6("evidence", "evidence"), "best", point.alias("point"))


PRIORS = "o(prior, center, width) AS (VALUES ('flat', NULL::DOUBLE, NULL::DOUBLE), ('wide', 4.5, 6.0))"


@query(f"WITH {DIMS}, l AS (SELECT feature, regr_slope(value, grp) AS b, regr_intercept(value, grp) AS a, sqrt((regr_syy(value, grp) - regr_sxy(value, grp) ** 2 / regr_sxx(value, grp)) / (count(*) - 2)) AS s FROM dims GROUP BY 1), k AS (SELECT grp, sum(b * b / (s * s)) AS bb, sum((m - a) * b / (s * s)) AS mb FROM (SELECT grp, feature, avg(value) AS m FROM dims GROUP BY 1, 2) JOIN l USING (feature) GROUP BY grp), {PRIORS}, g AS (SELECT grp, range * 0.25::DOUBLE AS d, -0.5 * (bb * (range * 0.25::DOUBLE) ** 2 - 2 * mb * (range * 0.25::DOUBLE)) AS x FROM k, range(-8, 60)), a AS (SELECT grp, d, x, prior, center, width FROM g, o UNION ALL SELECT grp, d, x, 'scholarly', grp, 0.5 FROM g), w AS (SELECT grp, prior, d, x, CASE WHEN width IS NULL THEN 0.0 ELSE -0.5 * ((d - center) / width) ** 2 END AS q FROM a), e AS (SELECT grp, prior, d, exp(x + q - max(x + q) OVER p) AS w, exp(x - max(x) OVER p) AS l, exp(q - max(q) OVER p) AS q FROM w WINDOW p AS (PARTITION BY grp, prior)), c AS (SELECT *, sum(w) OVER (PARTITION BY grp, prior ORDER BY d) / sum(w) OVER (PARTITION BY grp, prior) AS c FROM e) SELECT grp, prior, arg_max(d, w) AS point, round(sum(w * d) / sum(w), 6) AS mean, round(sqrt(greatest(sum(w * d * d) / sum(w) - (sum(w * d) / sum(w)) ** 2, 0)), 5) AS sd, min(d) FILTER (c >= 0.16) AS low, min(d) FILTER (c >= 0.84) AS high, round(sum(l * q) ** 2 / sum(l) / sum(l * q * q), 6) AS ess FROM c GROUP BY 1, 2")
def md17_prior_sensitivity(spark, d):
    """Log densities of groups' dates under lines are stored once, then read under a flat, a wide and the group's own prior."""
    x = dims(spark, d)
    line = X.regression(x, ["feature"], "grp", "value").select("feature", "slope", "intercept", "resid_sd")
    m = x.groupBy("grp", "feature").agg(F.avg("value").alias("m")).join(line, "feature")
    q = F.col("resid_sd") * F.col("resid_sd")
    k = m.groupBy("grp").agg(F.sum(F.col("slope") * F.col("slope") / q).alias("bb"), F.sum(F.col("slope") * (F.col("m") - F.col("intercept")) / q).alias("mb"))
    grid = F.array(*[F.lit(g) for g in GRID])
    densities = stored(k.select("grp", grid.alias("dates"), F.transform(grid, lambda t: -0.5 * (F.col("bb") * t * t - 2 * F.col("mb") * t)).alias("log_density")), "densities")
    out = V.reweighted(densities, [("flat", None, None), ("wide", 4.5, 6.0), ("scholarly", F.col("grp"), 0.5)])
    return out.select("grp", "prior", "point", r6("mean", "mean"), F.round("sd", 5).alias("sd"), "low", "high", r6("ess", "ess"))


@query()
def md17_variational_priors(spark, d):
    """Vectors' stored log densities under their own register, read under three priors, with how far the wide prior moves the point."""
    rows = _rows(spark, d)
    dates = stored(V.date_densities(rows, "vec_id", "embedding", _model(spark, d), GRID, "register", DRAWS), "densities").join(rows.select("vec_id", "date"), "vec_id")
    out = V.reweighted(dates, [("flat", None, None), ("wide", 4.5, 6.0), ("scholarly", F.col("date"), 0.5)])
    return V.prior_verdicts(out, ["vec_id"], strong=2.0, mild=0.5)
