"""Queries over models and resampling: posteriors, nested selection, scenarios, nulls, contrasts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import inference as I
from ..operators import matrix as A
from ..operators import text as T
from ..operators import validate as V
from ..sources.tables import table
from .registry import DIMS, TOK, Y, dims, query, r6, unit_year

LAMS = [0.1, 1.0, 10.0, 100.0]


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("label").alias("g"), "embedding", F.col("label").cast("double").alias("y"))


@query()
def md1_md2_vl2_nested_ridge(spark, d):
    r = A.nested_ridge(_vectors(spark, d), "g", "embedding", "y", LAMS)
    return r.select("grp", "lam", "n", r6("mean_truth", "mean_truth"), r6("mean_pred", "mean_pred"), r6(F.sqrt(F.col("sse") / F.col("n")), "rmse"))


GRID = [k * 0.25 for k in range(-8, 48)]


@query(f"WITH {DIMS}, l AS (SELECT feature, regr_slope(value, grp) AS b, regr_intercept(value, grp) AS a, sqrt((regr_syy(value, grp) - regr_sxy(value, grp) ** 2 / regr_sxx(value, grp)) / (count(*) - 2)) AS s FROM dims GROUP BY 1), k AS (SELECT grp, sum(a * a / (s * s)) AS aa, sum(b * b / (s * s)) AS bb, sum(a * b / (s * s)) AS ab, sum(m * a / (s * s)) AS ma, sum(m * b / (s * s)) AS mb FROM (SELECT grp, feature, avg(value) AS m FROM dims GROUP BY 1, 2) JOIN l USING (feature) GROUP BY grp), p AS (SELECT grp, range * 0.25::DOUBLE AS d, exp(-0.5 * (bb * (range * 0.25) ** 2 - 2 * (mb - ab) * range * 0.25) - 0.5 * (range * 0.25 - 4) ** 2 / 9) AS w FROM k, range(-8, 48)) SELECT grp, round(sum(w * d) / sum(w), 6) AS mean, round(sum(w * d * d) / sum(w) - (sum(w * d) / sum(w)) ** 2, 6) AS variance, round(1 - (sum(w * d * d) / sum(w) - (sum(w * d) / sum(w)) ** 2) / 9, 6) AS data_share FROM p GROUP BY grp")
def md6_posterior(spark, d):
    x = dims(spark, d)
    line = X.regression(x, ["feature"], "grp", "value").select("feature", "slope", "intercept", "resid_sd")
    m = x.groupBy("grp", "feature").agg(F.avg("value").alias("m")).join(line, "feature")
    q = F.col("resid_sd") * F.col("resid_sd")
    k = m.groupBy("grp").agg(F.sum(F.col("slope") * F.col("slope") / q).alias("bb"), F.sum(F.col("slope") * (F.col("m") - F.col("intercept")) / q).alias("mb"))
    # the likelihood is a parabola in the date: two sums a group replace rows x grid
    p = k.withColumn("d", F.explode(F.array(*[F.lit(g) for g in GRID]))).withColumn("w", F.exp(-0.5 * (F.col("bb") * F.col("d") * F.col("d") - 2 * F.col("mb") * F.col("d")) - 0.5 * F.pow(F.col("d") - 4, F.lit(2)) / 9))
    mean = F.sum(F.col("w") * F.col("d")) / F.sum("w")
    var = F.sum(F.col("w") * F.col("d") * F.col("d")) / F.sum("w") - mean * mean
    return p.groupBy("grp").agg(r6(mean, "mean"), r6(var, "variance"), r6(1 - var / 9, "data_share"))


@query()
def md7_md8_mvn(spark, d):
    return A.mvn_posterior(_vectors(spark, d), "g", "embedding", "y", GRID, 0.1, (4.5, 3.0)).select("grp", "y", r6("point", "point"), r6("sd", "sd"))


@query("WITH h AS (SELECT user_id, avg(value) AS m FROM events GROUP BY 1), g AS (SELECT user_id, unnest(range(0, 101)) AS x, m FROM h), l AS (SELECT user_id, x, -0.5 * ((m - x) / 10) ** 2 + ln(0.5) AS a, -0.5 * ((m - 2 * x) / 20) ** 2 + ln(0.5 / 2) AS b FROM g), s AS (SELECT user_id, x, greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS ll FROM l), w AS (SELECT user_id, x, exp(ll - max(ll) OVER (PARTITION BY user_id)) AS w FROM s) SELECT user_id, round(sum(w * x) / sum(w), 6) AS mean FROM w GROUP BY 1")
def md11_mixture(spark, d):
    h = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("m"))
    g = h.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(100))))
    a = -0.5 * F.pow((F.col("m") - F.col("x")) / 10, F.lit(2)) + F.ln(F.lit(0.5))
    b = -0.5 * F.pow((F.col("m") - 2 * F.col("x")) / 20, F.lit(2)) + F.ln(F.lit(0.25))
    top = F.greatest(a, b)
    l = g.select("user_id", "x", (top + F.ln(F.exp(a - top) + F.exp(b - top))).alias("ll"))
    w = l.withColumn("w", F.exp(F.col("ll") - F.max("ll").over(Window.partitionBy("user_id"))))
    return w.groupBy("user_id").agg(r6(F.sum(F.col("w") * F.col("x")) / F.sum("w"), "mean"))


@query("WITH h AS (SELECT user_id, avg(value) AS m, count(*) FILTER (event_type = 'view') AS k, count(*) AS n FROM events GROUP BY 1), j AS (SELECT user_id, a.range AS x, b.range / 20.0 AS q, exp(-0.5 * ((m - a.range * 5) / 10) ** 2 - 0.5 * ((k * 1.0 / n - b.range / 20.0) / 0.1) ** 2) AS w FROM h, range(0, 21) a, range(1, 20) b) SELECT user_id, round(sum(w * x) / sum(w), 6) AS mean_x, round(sum(w * q) / sum(w), 6) AS mean_q FROM j GROUP BY 1")
def md12_joint_posterior(spark, d):
    h = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("m"), (F.count_if(F.col("event_type") == "view") / F.count("*")).alias("r"))
    j = h.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(20)))).withColumn("q", F.explode(F.transform(F.sequence(F.lit(1), F.lit(19)), lambda i: i / 20.0)))
    w = j.withColumn("w", F.exp(-0.5 * F.pow((F.col("m") - F.col("x") * 5) / 10, F.lit(2)) - 0.5 * F.pow((F.col("r") - F.col("q")) / 0.1, F.lit(2))))
    return w.groupBy("user_id").agg(r6(F.sum(F.col("w") * F.col("x")) / F.sum("w"), "mean_x"), r6(F.sum(F.col("w") * F.col("q")) / F.sum("w"), "mean_q"))


@query()
def md18_pls(spark, d):
    return A.pls_leave_group_out(_vectors(spark, d), "g", "embedding", "y", 3).select("grp", "n", r6("rmse", "rmse"))


@query()
def md19_principal_parts(spark, d):
    p = A.principal_parts(_vectors(spark, d), "g", "embedding", "y", 5)
    return p.select("part", r6("share", "share"), r6(F.array_max("loadings"), "greatest"))


@query()
def md20_topics(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_suppkey", F.concat("l_returnflag", "l_linestatus", F.lit(":"), F.floor(F.col("l_quantity") / 10).cast("string")).alias("kind")).agg(F.count("*").alias("n"))
    return A.topic_factors(c, "l_suppkey", "kind", "n", 3).select("l_suppkey", "topic", r6("weight", "weight"))


@query()
def md21_logistic_auc(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("t"), F.pmod(F.xxhash64("vec_id"), F.lit(5)).alias("fold"))
    out = None
    for k in range(5):
        b = A.logistic(e.where(F.col("fold") != k), "embedding", "t")
        x = F.aggregate(F.zip_with("embedding", F.array(*[F.lit(float(v)) for v in b[1:]]), lambda p, q: p.cast("double") * q), F.lit(float(b[0])), lambda s, v: s + v)
        part = e.where(F.col("fold") == k).select("fold", "t", x.alias("score"))
        out = part if out is None else out.unionByName(part)
    return X.auc(out, "score", F.col("t") == 1, ["fold"]).select("fold", "n_pos", "n_neg", r6("auc", "auc"))


@query()
def md21_leave_one_out(spark, d):
    """Suppliers told apart by their lines, each by the fit of all others."""
    li, q = table(spark, d, "lineitem"), F.col("l_quantity")
    parts = [F.avg(q), F.avg("l_discount"), F.avg("l_tax"), F.stddev_pop(q), *[F.avg((F.col("l_returnflag") == f).cast("int")) for f in "ANR"], F.avg((F.col("l_linestatus") == "O").cast("int"))]
    units = li.groupBy("l_suppkey").agg(F.array(*parts).alias("x"), (F.percentile("l_extendedprice", 0.5) > 53000).cast("int").alias("t"))
    return A.logistic_leave_one_out(units, "l_suppkey", "x", "t").select("l_suppkey", "target", r6("score", "score"))


@query()
def md21_leave_one_out_auc(spark, d):
    return X.auc(md21_leave_one_out(spark, d), "score", F.col("target") == 1).select("n_pos", "n_neg", r6("auc", "auc"))


@query(f"WITH {TOK}, c AS (SELECT token, count(*)::DOUBLE AS n FROM tok GROUP BY 1), f AS (SELECT n, count(*) AS types FROM c GROUP BY 1), r AS (SELECT n, types, sum(types) OVER (ORDER BY n DESC) AS rank FROM f) SELECT round(regr_slope(ln(n), ln(rank)), 6) AS exponent, count(*) AS steps FROM r")
def md23_rank_frequency(spark, d):
    c = T.tokens(table(spark, d, "documents"), "doc_id").groupBy("token").agg(F.count("*").cast("double").alias("n"))
    f = c.groupBy("n").agg(F.count("*").alias("types"))
    r = f.withColumn("rank", F.sum("types").over(Window.orderBy(F.desc("n"))))  # one row for each distinct frequency
    return r.agg(r6(F.regr_slope(F.ln("n"), F.ln("rank")), "exponent"), F.count("*").alias("steps"))


@query("WITH s AS (SELECT l_linestatus, sum(w) AS sw, sum(w * q) AS sq, sum(w * x) AS sx, sum(w * q * q) AS sqq, sum(w * q * x) AS sqx FROM (SELECT l_linestatus, 1 / (0.01 + l_discount) ** 2 AS w, l_quantity AS q, l_extendedprice AS x FROM lineitem) GROUP BY 1) SELECT l_linestatus, round((sw * sqx - sq * sx) / (sw * sqq - sq * sq), 3) AS b FROM s")
def md25_weighted_fit(spark, d):
    li = table(spark, d, "lineitem").withColumn("w", 1 / F.pow(0.01 + F.col("l_discount"), F.lit(2)))
    return X.weighted_line(li, ["l_linestatus"], "l_quantity", "l_extendedprice", "w").select("l_linestatus", F.round("b", 3).alias("b"))


@query()
def vl20_scenario_grid(spark, d):
    n = len(table(spark, d, "embeddings").select("embedding").first()[0])
    cols = [list(range(0, n, s)) for s in (1, 2, 4)] + [list(range(n // 2)), list(range(n // 2, n))]
    return A.scenario_fits(_vectors(spark, d), "g", "embedding", "y", LAMS, [[]], cols).select("scenario", "lam", "n", r6("rmse", "rmse"))


@query()
def vl18_vl19_drop_sets(spark, d):
    return A.scenario_fits(_vectors(spark, d), "g", "embedding", "y", [1.0], [[], *[[str(k)] for k in range(10)], ["0", "9"]]).select("scenario", "lam", "n", r6("rmse", "rmse"))


@query()
def vl21_noise_features(spark, d):
    noise = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (F.pmod(F.xxhash64(F.col("vec_id"), i), F.lit(20001)) / 10000.0 - 1).cast("float"))
    e = table(spark, d, "embeddings").select(F.col("label").alias("g"), F.concat("embedding", noise).alias("embedding"), F.col("label").cast("double").alias("y"))
    return A.scenario_fits(e, "g", "embedding", "y", LAMS, [[]]).select("scenario", "lam", "n", r6("rmse", "rmse"))


@query()
def vl23_leave_column_out(spark, d):
    n = len(table(spark, d, "embeddings").select("embedding").first()[0])
    return A.scenario_fits(_vectors(spark, d), "g", "embedding", "y", [1.0], [], [[c for c in range(n) if c != k] for k in range(n)]).select("scenario", "n", r6("rmse", "rmse"))


@query()
def vl13_screening_null(spark, d):
    u = table(spark, d, "documents").groupBy("source", unit_year().alias("y")).agg(F.avg("n_chars").alias("a"), F.stddev_pop("n_chars").alias("b"), F.max("n_chars").cast("double").alias("c"))
    p = V.permuted(u, 100, "y").unpivot(["draw", "source", "y"], ["a", "b", "c"], "feature", "value")
    s = X.spearman(p, ["draw", "feature"], "value", "y")
    hit = F.abs("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho"))) > 2.100922  # 5 % of t with 18 degrees of freedom
    return s.groupBy("draw").agg(F.count_if(hit).alias("kept"))


@query()
def vl14_auc_null(spark, d):
    j = table(spark, d, "labels").select("doc_id", "toxic").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return X.auc(V.permuted(j, 20, "toxic"), "n_chars", F.col("toxic") == 1, ["draw"]).select("draw", r6("auc", "auc"))


@query("SELECT l_shipmode, n, round(p, 6) AS p, round(sqrt(p * (1 - p) / (n + 1)), 6) AS se FROM (SELECT l_returnflag AS l_shipmode, count(*) AS n, (count(*) FILTER (l_quantity >= 48) + 1) / (count(*) + 1) AS p FROM lineitem GROUP BY 1)")
def vl15_p_error(spark, d):
    n = F.count("*")
    s = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("l_shipmode")).agg(n.alias("n"), ((F.count_if(F.col("l_quantity") >= 48) + 1) / (n + 1)).alias("p"))
    return s.select("l_shipmode", "n", r6("p", "p"), r6(F.sqrt(F.col("p") * (1 - F.col("p")) / (F.col("n") + 1)), "se"))


@query("WITH x AS (SELECT s_nationkey, count(*) AS n, avg(s_acctbal) AS a, median(s_acctbal) AS b FROM supplier GROUP BY 1) SELECT count(*) AS n, round(avg(((a > 4500) = (b > 4500))::INT), 6) AS agreement, round(median(abs(a - b)), 4) AS gap FROM x")
def vl27_agreement(spark, d):
    x = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("a"), F.median("s_acctbal").alias("b"))
    return x.agg(F.count("*").alias("n"), r6(F.avg(((F.col("a") > 4500) == (F.col("b") > 4500)).cast("int")), "agreement"), F.round(F.median(F.abs(F.col("a") - F.col("b"))), 4).alias("gap"))


@query("WITH m AS (SELECT lang, avg(n_chars) AS m FROM documents GROUP BY 1), t AS (SELECT avg(n_chars) AS t FROM documents) SELECT doc_id, round(n_chars - m + t, 4) AS adjusted FROM documents JOIN m USING (lang), t")
def vl28_stratum_adjusted(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    s = docs.groupBy("lang").agg(F.sum("n_chars").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1))  # one row a stratum
    m = s.select("lang", (F.sum("s").over(w) / F.sum("n").over(w) - F.col("s") / F.col("n")).alias("shift"))
    return docs.join(m, "lang").select("doc_id", F.round(F.col("n_chars") + F.col("shift"), 4).alias("adjusted"))


@query("WITH j AS (SELECT lang, n_chars, quality FROM documents JOIN labels USING (doc_id)), s AS (SELECT lang, avg(n_chars) FILTER (quality = 1) - avg(n_chars) FILTER (quality = 0) AS c, count(*) AS n FROM j GROUP BY 1) SELECT round(sum(c * n) / sum(n), 4) AS contrast, sum(n)::BIGINT AS n FROM s WHERE c IS NOT NULL")
def vl29_weighted_contrast(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    of = lambda q: F.avg(F.when(F.col("quality") == q, F.col("n_chars")))
    s = j.groupBy("lang").agg((of(1) - of(0)).alias("c"), F.count("*").alias("n")).where("c IS NOT NULL")
    return s.agg(F.round(F.sum(F.col("c") * F.col("n")) / F.sum("n"), 4).alias("contrast"), F.sum("n").alias("n"))


@query()
def vl30_displacement(spark, d):
    grams = A.group_grams(_vectors(spark, d), "g", "embedding", "y")
    held = {g for g in grams if g in ("3", "7")}
    if len(held) == len(grams):
        return spark.createDataFrame([], "grp string, truth double, pred double, shift double")
    beta = A.ridge(sum(v for g, v in grams.items() if g not in held), [1.0])[0]
    rows = [(g, float(grams[g][0, -1] / grams[g][0, 0]), float(grams[g][0, :-1] @ beta / grams[g][0, 0])) for g in sorted(held)]
    return spark.createDataFrame([(g, round(t, 6), round(p, 6), round(p - t, 6)) for g, t, p in rows], "grp string, truth double, pred double, shift double")


@query()
def vl24_power_curve(spark, d):
    """For every nation's number of customers, the share of samples of as many pairs whose rank correlation is significant."""
    sizes = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return I.power_curves(sizes, "c_nationkey", "n", [0.0, 0.3, 0.6, 0.9], [0.01, 0.05, 0.1], 1000).select("c_nationkey", "n", "rho", "alpha", r6("power", "power"))


@query(f"WITH u AS (SELECT source, {Y} AS y, avg(n_chars) AS x FROM documents GROUP BY 1, 2), s AS (SELECT corr(x, y) AS r FROM u) SELECT u.source, round((SELECT corr(v.x, v.y) FROM u v WHERE v.source <> u.source), 6) AS r_without, round(s.r, 6) AS r_all FROM u, s")
def vl18_jackknife_r(spark, d):
    u = table(spark, d, "documents").groupBy("source", unit_year().alias("y")).agg(F.avg("n_chars").alias("x"))
    one = u.withColumn("feature", F.lit(0))
    s = lambda c: F.sum(c).over(Window.partitionBy("feature"))  # noqa: E731, one row a source
    x, y, k = F.col("x"), F.col("y"), F.lit(1.0)

    def r(n, sx, sy, sxx, syy, sxy):
        return (n * sxy - sx * sy) / F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))

    whole, own = [s(c) for c in (k, x, y, x * x, y * y, x * y)], [k, x, y, x * x, y * y, x * y]
    return one.select("source", r6(r(*[a - b for a, b in zip(whole, own, strict=True)]), "r_without"), r6(r(*whole), "r_all"))
