"""Feature, text, validation and model queries of the first wave."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import features as X
from ..operators import groups as G
from ..operators import joins as J
from ..operators import models as M
from ..operators import profiles as P
from ..operators import text as T
from ..operators import validate as V
from ..sources import tables as R
from ..sources.tables import table
from .registry import DIMS, ORACLE_SQL, QUERIES, RANKS, RATES, SENT, TOK, Y, dims, query, r6, rates_by_source, unit_year  # noqa: F401


@query(f"WITH {RATES} SELECT feature, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM {RANKS.format(by='feature', x='v', y='y', t='(SELECT *, round(value, 9) AS v FROM rates)')} GROUP BY feature")
def entry_feature_screen(spark, d):
    rates = rates_by_source(spark, d).withColumn("v", F.round("value", 9))
    return X.spearman(rates, ["feature"], "v", "y").select("feature", r6("rho", "rho"), "n").orderBy(F.desc(F.abs("rho")), "feature")


@query(f"WITH {DIMS} SELECT feature, round(stddev_samp(value), 6) AS sd, round(avg((value = 0)::INT), 6) AS zero_share FROM dims GROUP BY feature HAVING stddev_samp(value) > 0 AND avg((value IS NULL)::INT) < 0.2")
def prj3_usable_features(spark, d):
    return X.usable(dims(spark, d)).select("feature", r6("sd", "sd"), r6("zero_share", "zero_share"))


@query(f"WITH {DIMS} SELECT feature, count(DISTINCT grp) AS n_groups FROM dims WHERE value > 0 GROUP BY feature HAVING count(DISTINCT grp) >= 5")
def prj7_prevalence(spark, d):
    return X.prevalent(dims(spark, d), 5)


@query("WITH j AS (SELECT d.doc_id, l.quality::DOUBLE AS q FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT doc_id, coalesce(q, (SELECT median(q) FROM j)) AS value FROM j")
def prj11_median_impute(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    long = docs.select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.lit("quality").alias("feature"), F.col("quality").cast("double").alias("value"))
    return X.impute_median(long, F.lit(True)).select("doc_id", "value")


@query(f"WITH {DIMS} SELECT row, feature, round((value - avg(value) OVER w) / (CASE WHEN stddev_pop(value) OVER w > 0 THEN stddev_pop(value) OVER w ELSE 1 END), 6) AS z FROM dims WINDOW w AS (PARTITION BY feature)")
def prj13_standardise(spark, d):
    return X.standardise(dims(spark, d)).select("row", "feature", r6("z", "z"))


@query("SELECT l_orderkey, l_linenumber, round(ln(1 + l_quantity), 6) AS log_scale, round(sqrt(l_quantity), 6) AS root_scale, round(ln(least(greatest(l_quantity / 1000, 0.0001), 0.9999) / (1 - least(greatest(l_quantity / 1000, 0.0001), 0.9999))), 6) AS logit_scale FROM lineitem")
def prj14_rescale(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(F.log1p(q), "log_scale"), r6(F.sqrt(q), "root_scale"), r6(S.logit_rate(q), "logit_scale"))


@query("SELECT user_id, round(v / nullif(v + c, 0), 6) AS share, round((v + 0.5) / (v + c + 1), 6) AS smoothed, round((v + 1) / (v + c + 2), 6) AS laplace FROM (SELECT user_id, count(*) FILTER (event_type = 'view')::DOUBLE AS v, count(*) FILTER (event_type = 'click')::DOUBLE AS c FROM events GROUP BY user_id)")
def prj16_prj17_shares(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").cast("double").alias("v"), F.count_if(F.col("event_type") == "click").cast("double").alias("c"))
    return g.select("user_id", r6(S.share(F.col("v"), F.col("c")), "share"), r6(S.smoothed_share(F.col("v"), F.col("c")), "smoothed"), r6(S.laplace_share(F.col("v"), F.col("c")), "laplace"))


@query("SELECT period, o_orderpriority, count(*) AS n FROM (SELECT o_orderpriority, CASE WHEN year(o_orderdate) > 1997 THEN 'late' WHEN year(o_orderdate) > 1994 THEN 'middle' ELSE 'early' END AS period FROM orders) GROUP BY ALL")
def prj19_period_confusion(spark, d):
    return table(spark, d, "orders").select("o_orderpriority", S.bucket(F.year("o_orderdate"), [1997, 1994], ["late", "middle", "early"]).alias("period")).groupBy("period", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN round(c_acctbal / 10) >= 0 THEN round(c_acctbal / 10)::BIGINT || ' BCE' ELSE (-round(c_acctbal / 10))::BIGINT || ' CE' END AS era FROM customer")
def prj21_era(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.era(F.col("c_acctbal") / 10).alias("era"))


@query(f"WITH {DIMS}, z AS (SELECT row, feature, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM dims WINDOW w AS (PARTITION BY feature)) SELECT row, round(avg(z * (CASE WHEN feature % 2 = 0 THEN 1 ELSE -1 END)), 6) AS score FROM z WHERE feature < 10 GROUP BY row")
def prj28_composite(spark, d):
    sign = spark.range(10).select(F.col("id").cast("int").alias("feature"), F.when(F.col("id") % 2 == 0, 1).otherwise(-1).alias("direction"))
    return X.composite(X.standardise(dims(spark, d)), sign).select("row", r6("score", "score"))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.lang, l.quality, l.toxic FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def jn4_full_outer(spark, d):
    w = Window.partitionBy("doc_id").orderBy("quality", "toxic")
    labels = table(spark, d, "labels").withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    return table(spark, d, "documents").select("doc_id", "lang").join(labels, "doc_id", "full").select("doc_id", "lang", "quality", "toxic")


@query("WITH r AS (SELECT c_custkey AS unit, c_custkey * 37 AS lo, c_custkey * 37 + 59 AS hi FROM customer) SELECT unit, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN r ON o_orderkey BETWEEN lo AND hi GROUP BY unit")
def jn7_range_join(spark, d):
    units = table(spark, d, "customer").select(F.col("c_custkey").alias("unit"), (F.col("c_custkey") * 37).alias("lo"), (F.col("c_custkey") * 37 + 59).alias("hi"))
    return J.range_join(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", units, "lo", "hi", 64).groupBy("unit").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("WITH r AS (SELECT conv_id AS unit, conv_id AS c0, 2 AS t0, conv_id + 2 AS c1, 1 AS t1 FROM conversations WHERE turn = 0 GROUP BY 1) SELECT unit, count(*) AS n, min(conv_id * 1000 + turn) AS first, max(conv_id * 1000 + turn) AS last FROM conversations JOIN r ON (conv_id > c0 OR conv_id = c0 AND turn >= t0) AND (conv_id < c1 OR conv_id = c1 AND turn <= t1) GROUP BY 1")
def jn8_struct_range(spark, d):
    """Turns in (chapter, verse)-like intervals that overlap: from the third turn of each conversation to the second of the one after the next."""
    c = table(spark, d, "conversations").select("conv_id", "turn")
    units = c.where("turn = 0").select(F.col("conv_id").alias("unit")).distinct()
    units = units.select("unit", F.col("unit").alias("lo"), (F.col("unit") + 2).alias("hi"))
    met = J.range_join(c, "conv_id", units, "lo", "hi", 4)
    inside = (F.struct("conv_id", F.col("turn").cast("int")) >= F.struct(F.col("lo"), F.lit(2))) & (F.struct("conv_id", F.col("turn").cast("int")) <= F.struct(F.col("hi"), F.lit(1)))
    at = F.col("conv_id") * 1000 + F.col("turn")
    return met.where(inside).groupBy("unit").agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


@query("WITH n AS (SELECT s_nationkey AS k, avg(s_acctbal) AS t, max(s_suppkey) AS p FROM supplier GROUP BY 1) SELECT count(*) AS n_pairs, round(avg(((a.p - b.p) * (a.t - b.t) > 0)::INT), 6) AS concordance FROM n a JOIN n b ON a.k < b.k AND a.t <> b.t")
def jn12_concordance(spark, d):
    n = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("t"), F.max("s_suppkey").alias("p"))
    return X.concordance(n, "k", "t", "p").select("n_pairs", r6("concordance", "concordance"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn14_left_anti(spark, d):
    return R.missing_draws(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'toxic' END, d.lang) AS tag FROM documents d LEFT JOIN labels l USING (doc_id)")
def jn15_overlay(spark, d):
    over = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit("toxic").alias("new"))
    return table(spark, d, "documents").join(over, "doc_id", "left").select("doc_id", F.coalesce("new", "lang").alias("tag"))


@query("SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS wmean FROM lineitem GROUP BY 1")
def ag5_weighted_mean(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_extendedprice")) / F.sum("l_quantity"), 4).alias("wmean"))


@query("SELECT o_orderpriority, count(*) AS n, round(median(o_totalprice), 4) AS med, round(stddev_samp(o_totalprice), 4) AS sd, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) AS iqr, round(avg((o_totalprice < 100000)::INT), 6) AS below FROM orders GROUP BY 1")
def ag7_dispersion(spark, d):
    x = "o_totalprice"
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.median(x), 4).alias("med"), F.round(F.stddev_samp(x), 4).alias("sd"), F.round(F.percentile(x, 0.75) - F.percentile(x, 0.25), 4).alias("iqr"), r6(F.avg((F.col(x) < 100000).cast("int")), "below"))


@query("SELECT source, lang AS common FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS k FROM documents GROUP BY source, lang) WHERE k = 1")
def ag8_mode(spark, d):
    c = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return c.groupBy("source").agg(F.min_by("lang", F.struct(-F.col("n"), F.col("lang"))).alias("common"))


@query(f"WITH {DIMS} SELECT feature, round(regr_slope(value, grp), 6) AS slope, round(regr_intercept(value, grp), 6) AS intercept, round(corr(grp, value), 6) AS r, round(sqrt((regr_syy(value, grp) - regr_sxy(value, grp) ** 2 / regr_sxx(value, grp)) / (count(*) - 2)), 6) AS resid_sd FROM dims GROUP BY feature")
def ag9_regression(spark, d):
    return X.regression(dims(spark, d), ["feature"], "grp", "value").select("feature", *[r6(c, c) for c in ("slope", "intercept", "r", "resid_sd")])


@query("SELECT l_returnflag, round((sw * swxy - swx * swy) / (sw * swxx - swx * swx), 4) AS b, round((swy - (sw * swxy - swx * swy) / (sw * swxx - swx * swx) * swx) / sw, 2) AS a FROM (SELECT l_returnflag, sum(1 + l_tax) AS sw, sum((1 + l_tax) * l_quantity) AS swx, sum((1 + l_tax) * l_extendedprice) AS swy, sum((1 + l_tax) * l_quantity * l_quantity) AS swxx, sum((1 + l_tax) * l_quantity * l_extendedprice) AS swxy FROM lineitem GROUP BY 1)")
def ag10_weighted_line(spark, d):
    li = table(spark, d, "lineitem").withColumn("w", 1 + F.col("l_tax"))
    return X.weighted_line(li, ["l_returnflag"], "l_quantity", "l_extendedprice", "w").select("l_returnflag", F.round("b", 4).alias("b"), F.round("a", 2).alias("a"))


@query(f"SELECT o_orderpriority, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM {RANKS.format(by='o_orderpriority', x='o_totalprice', y='o_custkey', t='orders')} GROUP BY 1")
def ag12_spearman(spark, d):
    return X.spearman(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", "o_custkey").select("o_orderpriority", r6("rho", "rho"), "n")


@query(f"WITH {DIMS}, g AS (SELECT feature, grp, avg(value) AS value, grp::DOUBLE AS y FROM dims GROUP BY feature, grp), w AS (SELECT feature, corr(value, y) AS r FROM g GROUP BY feature), l AS (SELECT a.feature, a.grp, corr(b.value, b.y) AS r FROM g a JOIN g b ON a.feature = b.feature AND a.grp <> b.grp GROUP BY a.feature, a.grp) SELECT w.feature, round(w.r, 6) AS r_all, round(avg((sign(l.r) = sign(w.r))::INT), 6) AS same_sign FROM w JOIN l USING (feature) GROUP BY w.feature, w.r")
def ag14_loo_sign(spark, d):
    g = dims(spark, d).groupBy("feature", "grp").agg(F.avg("value").alias("value")).withColumn("y", F.col("grp").cast("double"))
    return X.leave_one_out_signs(g).select("feature", r6("r_all", "r_all"), r6("same_sign", "same_sign"))


@query("WITH p AS (SELECT p_partkey AS feature, (p_partkey * 37 % 1000) * (p_partkey * 37 % 1000) / 1e6 / 20 AS p FROM part), r AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS rank, count(*) OVER () AS m FROM p) SELECT feature, rank, rank <= (SELECT coalesce(max(rank), 0) FROM r WHERE p <= rank / m * 0.05) AS accepted FROM r")
def ag17_step_up(spark, d):
    x = F.col("p_partkey") * 37 % 1000
    p = table(spark, d, "part").select(F.col("p_partkey").alias("feature"), (x * x / 1e6 / 20).alias("p"))
    return X.step_up(p, 0.05).select("feature", F.col("rank").cast("long").alias("rank"), "accepted")


@query(f"WITH {DIMS}, g AS (SELECT feature, grp, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS ssw FROM dims GROUP BY 1, 2), s AS (SELECT feature, count(*) AS k, sum(n) AS n, sum(n * n) AS nn, sum(ssw) AS ssw, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS ssb FROM g GROUP BY 1), t AS (SELECT *, (n - nn / n) / (k - 1) AS n0, ssb / (k - 1) AS msb, ssw / (n - k) AS msw FROM s), u AS (SELECT *, (msb - msw) / (msb + (n0 - 1) * msw) AS icc FROM t) SELECT feature, round(n0, 6) AS n0, round(icc, 6) AS icc, round(1 + (n / k - 1) * greatest(icc, 0), 6) AS design_effect, round(n / (1 + (n / k - 1) * greatest(icc, 0)), 4) AS n_eff FROM u")
def ag18_icc(spark, d):
    return X.icc(dims(spark, d)).select("feature", r6("n0", "n0"), r6("icc", "icc"), r6("design_effect", "design_effect"), F.round("n_eff", 4).alias("n_eff"))


@query(f"WITH {DIMS}, g AS (SELECT feature, grp, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS ssw FROM dims GROUP BY 1, 2), s AS (SELECT feature, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS ssb, sum(ssw) AS ssw FROM g GROUP BY 1) SELECT feature, round(ssb / (ssb + ssw), 6) AS eta2 FROM s")
def ag20_eta2(spark, d):
    return X.eta_squared(dims(spark, d)).select("feature", r6("eta2", "eta2"))


@query("WITH s AS (SELECT quality::DOUBLE AS y, least(n_chars / 5000.0, 1.0) AS p FROM labels JOIN documents USING (doc_id)) SELECT least(floor(p * 5), 4)::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate, round(avg((p - y) ** 2), 6) AS brier FROM s GROUP BY 1")
def ag25_brier(spark, d):
    s = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.col("quality").cast("double").alias("y"), F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("p"))
    return s.groupBy(F.least(F.floor(F.col("p") * 5), F.lit(4)).cast("long").alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("p"), "mean_p"), r6(F.avg("y"), "rate"), r6(F.avg(F.pow(F.col("p") - F.col("y"), 2)), "brier"))


@query("WITH r AS (SELECT toxic AS p, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM labels JOIN documents USING (doc_id)) SELECT sum(p)::BIGINT AS n_pos, sum(1 - p)::BIGINT AS n_neg, round((sum(r) FILTER (p = 1) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * sum(1 - p)), 6) AS auc FROM r")
def ag26_auc(spark, d):
    s = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return X.auc(s, "n_chars", F.col("toxic") == 1).select("n_pos", "n_neg", r6("auc", "auc"))


@query(f"WITH {TOK}, c AS (SELECT lang, token, count(*) AS n FROM tok GROUP BY 1, 2), p AS (SELECT lang, n / sum(n) OVER (PARTITION BY lang) AS p FROM c) SELECT lang, count(*) AS types, round(sum(-p * ln(p)), 6) AS entropy FROM p GROUP BY lang")
def ag30_entropy(spark, d):
    c = T.token_counts(table(spark, d, "documents"), "lang")
    total = c.groupBy("lang").agg(F.sum("n").alias("t"))
    p = c.join(total, "lang").withColumn("p", F.col("n") / F.col("t"))
    return p.groupBy("lang").agg(F.count("*").alias("types"), r6(F.sum(-F.col("p") * F.ln("p")), "entropy"))


@query("SELECT user_id % 10 AS segment, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def ag37_pivot(spark, d):
    return table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("segment")).pivot("event_type", ["click", "error", "purchase", "signup", "view"]).count().na.fill(0)


@query("SELECT source, round(quantile_cont(n_chars, 0.9), 4) AS p90, round(quantile_cont(n_chars, 0.5), 4) AS p50, round(quantile_cont(n_chars, 0.1), 4) AS p10, list_sum(list_transform(list_sort(list(n_chars))[1:3], lambda x: x))::BIGINT AS least3 FROM documents GROUP BY 1")
def ag39_percentiles(spark, d):
    docs = table(spark, d, "documents")
    k = docs.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("n_chars", "doc_id"))).where("k <= 3").groupBy("source").agg(F.sum("n_chars").alias("least3"))
    p = docs.groupBy("source").agg(*[F.round(F.percentile("n_chars", q), 4).alias(f"p{round(q * 100)}") for q in (0.9, 0.5, 0.1)])
    return p.join(k, "source").select("source", "p90", "p50", "p10", "least3")


@query(f"WITH c AS (SELECT doc_id, lang, {Y} AS y, n_chars - avg(n_chars) OVER (PARTITION BY lang) AS x, count(*) OVER (PARTITION BY lang) AS n FROM documents), q AS (SELECT *, round(x, 6) AS cx FROM c WHERE n >= 4) SELECT lang, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM {RANKS.format(by='lang', x='cx', y='y', t='q')} GROUP BY lang")
def wn1_wn3_centred_rho(spark, d):
    docs = table(spark, d, "documents").withColumn("y", unit_year())
    c = X.centred(docs, ["lang"], "n_chars", 4).withColumn("cx", F.round("centred", 6))
    return X.spearman(c, ["lang"], "cx", "y").select("lang", r6("rho", "rho"), "n")


@query(f"WITH {TOK}, g AS (SELECT token || ' ' || lead(token) OVER (PARTITION BY doc_id, sent_no ORDER BY tok_no) AS gram FROM tok) SELECT gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY gram")
def wn5_bigrams(spark, d):
    return T.ngram_counts(table(spark, d, "documents"), 2)


@query("WITH e AS (SELECT epoch(ts) AS t, value FROM events), c AS (SELECT DISTINCT floor(t / 86400) * 86400 + 43200 AS centre FROM e), x AS (SELECT floor(t / 86400) AS day, count(*) AS n, sum(value) AS s FROM e GROUP BY 1) SELECT centre::BIGINT AS centre, count(*) AS n, round(avg(value), 6) AS mean FROM c JOIN e ON t BETWEEN centre - 43200 AND centre + 43200 - 0.000001 GROUP BY centre")
def wn6_time_window(spark, d):
    # windows of one day about each noon do not overlap: the range join is a group-by
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    day = F.floor(t / 86_400_000_000)
    return table(spark, d, "events").groupBy((day * 86400 + 43200).cast("long").alias("centre")).agg(F.count("*").alias("n"), r6(F.avg("value"), "mean"))


@query("SELECT event_id, round(s / c, 6) AS mean FROM (SELECT event_id, sum(value) OVER w AS s, count(*) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE c = 5")
def wn7_count_window(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(0, 4)
    return table(spark, d, "events").select("event_id", F.sum("value").over(w).alias("s"), F.count("*").over(w).alias("c")).where("c = 5").select("event_id", r6(F.col("s") / F.col("c"), "mean"))


HIST = "h AS (SELECT l_returnflag AS g, l_quantity::BIGINT AS x, count(*)::DOUBLE AS p FROM lineitem GROUP BY 1, 2)"


def _hist(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_quantity").cast("long").alias("x")).agg(F.count("*").cast("double").alias("p"))


@query(f"WITH {HIST}, c AS (SELECT *, sum(p) OVER (PARTITION BY g ORDER BY x) / sum(p) OVER (PARTITION BY g) AS c FROM h) SELECT g, min(x) FILTER (c >= 0.16 - 1e-12) AS lower, min(x) FILTER (c >= 0.84 - 1e-12) AS upper, (SELECT h.x FROM h WHERE h.g = c.g ORDER BY p DESC, h.x LIMIT 1) AS mode FROM c GROUP BY g")
def wn9_credible(spark, d):
    return V.credible(_hist(spark, d), ["g"], "x", "p", 0.68)


@query(f"WITH {HIST}, c AS (SELECT *, sum(p) OVER (PARTITION BY g ORDER BY p DESC, x) / sum(p) OVER (PARTITION BY g) AS c FROM h) SELECT g, min(x) AS lower, max(x) AS upper FROM c WHERE c <= 0.68 + 1e-12 GROUP BY g")
def wn10_densest(spark, d):
    return V.densest(_hist(spark, d), ["g"], "x", "p", 0.68)


CHUNK = SENT + """, sl AS (SELECT doc_id, sent_no, len(list_filter(regexp_split_to_array(sentence, '\\s+'), lambda w: w <> ''))::BIGINT AS n FROM sx),
walk AS (WITH RECURSIVE w(doc_id, sent_no, no, acc) AS (SELECT doc_id, sent_no, 0::BIGINT, n FROM sl WHERE sent_no = 0
 UNION ALL SELECT sl.doc_id, sl.sent_no, w.no + (w.acc >= 100)::INT, CASE WHEN w.acc >= 100 THEN sl.n ELSE w.acc + sl.n END FROM w JOIN sl ON sl.doc_id = w.doc_id AND sl.sent_no = w.sent_no + 1) SELECT * FROM w),
sizes AS (SELECT doc_id, max(no) AS last FROM walk GROUP BY 1), ls AS (SELECT walk.doc_id, last, max(acc) AS words FROM walk JOIN sizes ON walk.doc_id = sizes.doc_id AND no = last GROUP BY 1, 2),
fin AS (SELECT walk.doc_id, sent_no, CASE WHEN no = last AND last > 0 AND words < 50 THEN no - 1 ELSE no END AS chunk FROM walk JOIN ls USING (doc_id))"""


def _chunks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.sentence_array(F.col("text")).alias("ss"))
    n = F.transform("ss", lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")))
    c = docs.select("doc_id", n.alias("ns"), T.chunk_numbers(n, 100).alias("cs"))
    return c.select("doc_id", F.explode(F.arrays_zip("ns", "cs")).alias("x")).select("doc_id", F.col("x.ns").alias("n"), F.col("x.cs").alias("chunk"))


@query(f"WITH {CHUNK} SELECT doc_id, chunk, count(*) AS n_sents, sum(n)::BIGINT AS n_words FROM fin JOIN sl USING (doc_id, sent_no) GROUP BY 1, 2")
def wn13_chunker(spark, d):
    return _chunks(spark, d).groupBy("doc_id", F.col("chunk").cast("long").alias("chunk")).agg(F.count("*").alias("n_sents"), F.sum("n").alias("n_words"))


@query("SELECT event_id, round((sum((value >= 100)::INT) OVER (ORDER BY event_id) + 1) / (row_number() OVER (ORDER BY event_id) + 1), 6) AS p FROM events")
def wn16_prefix_p(spark, d):
    return V.prefix_p(table(spark, d, "events").select("event_id", (F.col("value") >= 100).alias("hit")), "event_id", "hit").select("event_id", r6("p", "p"))


@query("SELECT doc_id, length(strip_accents(text)) AS n, sha256(strip_accents(text)) AS digest FROM documents")
def sc2_strip_diacritics(spark, d):
    plain = S.strip_diacritics(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(plain).cast("long").alias("n"), F.sha2(plain.cast("binary"), 256).alias("digest"))


@query()
def sc8_quote_filter(spark, d):
    ss = T.sentence_array(F.col("text"))
    kept = T.drop_quotes(ss, r"(?i)\b(?:said|dit|sagt|dice)\b", 1)
    return table(spark, d, "documents").select("doc_id", F.size(ss).alias("n_sents"), F.size(kept).alias("n_kept"))


@query("WITH g AS (SELECT doc_id, lang, unnest(list_transform(range(1, length(text) + 1), lambda i: substring(' ' || text || ' ', i, 3))) AS gram FROM documents), c AS (SELECT lang, gram, count(*) AS n FROM g GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS k, sum(n) OVER (PARTITION BY lang) AS t FROM c) SELECT lang, gram, n, round(n * 1000.0 / t, 6) AS rate FROM r WHERE k <= 50")
def sc9_char3(spark, d):
    g = table(spark, d, "documents").select("lang", F.explode(T.char_ngrams(F.col("text"), 3)).alias("gram"))
    c = g.groupBy("lang", "gram").agg(F.count("*").alias("n"))
    total = c.groupBy("lang").agg(F.sum("n").alias("t"))
    top = c.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where("k <= 50")
    return top.join(total, "lang").select("lang", "gram", "n", r6(F.col("n") * 1000.0 / F.col("t"), "rate"))


@query(f"WITH {TOK} SELECT doc_id, count(*) AS n_tok, round(count(*) FILTER (regexp_matches(token, '(?:tion|ment)$')) * 1000.0 / count(*), 6) AS noun, round(count(*) FILTER (regexp_matches(token, '(?:ung|keit|heit)$')) * 1000.0 / count(*), 6) AS abstr, round(count(*) FILTER (token IN ('the','la','el','der','die','das','le')) * 1000.0 / count(*), 6) AS article, round(count(DISTINCT token) / count(*), 6) AS ttr FROM tok GROUP BY doc_id")
def sc14_fx1_detectors(spark, d):
    w, n = F.col("w"), F.size("w")
    docs = table(spark, d, "documents").select("doc_id", T.words_of(F.col("text")).alias("w")).where(n > 0)
    rate = lambda kind, alternatives: P.counted(w, kind, alternatives) * 1000.0 / n
    return docs.select("doc_id", n.cast("long").alias("n_tok"), r6(rate("end", "tion|ment"), "noun"), r6(rate("end", "ung|keit|heit"), "abstr"), r6(rate("word", "the|la|el|der|die|das|le"), "article"), r6(F.size(F.array_distinct(w)) / n, "ttr"))


@query(f"WITH u AS (SELECT source, {Y} AS y FROM documents GROUP BY source), s AS (SELECT a.source, sum(exp(-0.5 * ((a.y - b.y) / 2) ** 2)) AS s FROM u a, u b GROUP BY a.source) SELECT source, round((1 / greatest(s, 1e-9)) / (SELECT avg(1 / greatest(s, 1e-9)) FROM s), 6) AS weight FROM s")
def sc20_density_weights(spark, d):
    u = table(spark, d, "documents").select("source", unit_year().alias("y")).distinct()
    return X.density_weights(u, "y", 2.0).select("source", r6("weight", "weight"))


@query("SELECT event_type, sum(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1))::BIGINT AS total FROM events GROUP BY 1")
def sc23_json(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1))).alias("total"))


@query()
def src6_html_text(spark, d):
    text = table(spark, d, "pages").select("page_id", R.html_text_column("html").alias("text"))
    return text.select("page_id", F.length("text").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("SELECT doc_id, sha256(coalesce(lang, '') || '|' || coalesce(source, '')) AS digest FROM documents")
def snk7_fingerprint(spark, d):
    return R.fingerprint(table(spark, d, "documents"), "doc_id", "lang", "source")


@query(f"WITH {DIMS}, u AS (SELECT grp, grp::DOUBLE AS y, feature, avg(value) AS value FROM dims GROUP BY 1, 2, 3), f AS (SELECT a.grp AS fold, b.feature, regr_slope(b.value, b.y) AS b, regr_intercept(b.value, b.y) AS a, sqrt(greatest(regr_syy(b.value, b.y) - regr_sxy(b.value, b.y) ** 2 / regr_sxx(b.value, b.y), 1e-12) / (count(*) - 2)) AS s FROM (SELECT DISTINCT grp FROM u) a JOIN u b ON a.grp <> b.grp GROUP BY 1, 2), ll AS (SELECT u.grp, u.y, g.range * 0.25::DOUBLE AS d, sum(-ln(f.s) - 0.5 * ((u.value - f.a - f.b * g.range * 0.25::DOUBLE) / f.s) ** 2) AS ll FROM u JOIN f ON u.grp = f.fold AND u.feature = f.feature CROSS JOIN range(-8, 48) g GROUP BY 1, 2, 3) SELECT grp, y, round(arg_max(d, round(ll, 9)), 6) AS pred FROM ll GROUP BY 1, 2")
def md5_generative_loo(spark, d):
    u = dims(spark, d).groupBy("grp", "feature").agg(F.avg("value").alias("value")).withColumn("y", F.col("grp").cast("double"))
    grid = spark.range(-8, 48).select((F.col("id") * 0.25).alias("d"))
    return M.generative_leave_one_out(u, grid).select("grp", "y", r6("pred", "pred"))


@query("WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS k, count(*) FILTER (event_type IN ('view', 'click')) AS n FROM events GROUP BY 1), g AS (SELECT range / 200.0 AS p FROM range(1, 200)), l AS (SELECT user_id, p, k * ln(p) + (n - k) * ln(1 - p) AS ll FROM u, g), m AS (SELECT user_id, p, exp(ll - max(ll) OVER (PARTITION BY user_id)) AS w FROM l) SELECT user_id, round(sum(p * w) / sum(w), 6) AS mean FROM m GROUP BY 1")
def md14_beta_binomial(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("k"), F.count_if(F.col("event_type").isin("view", "click")).alias("n"))
    p = F.explode(F.transform(F.sequence(F.lit(1), F.lit(199)), lambda i: i / 200.0)).alias("p")
    ll = u.select("user_id", "k", "n", p).select("user_id", "p", (F.col("k") * F.ln("p") + (F.col("n") - F.col("k")) * F.ln(1 - F.col("p"))).alias("ll"))
    w = ll.withColumn("w", F.exp(F.col("ll") - F.max("ll").over(Window.partitionBy("user_id"))))
    return w.groupBy("user_id").agg(r6(F.sum(F.col("p") * F.col("w")) / F.sum("w"), "mean"))


@query("WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS a FROM embeddings), c AS (SELECT query, vec_id AS id, round(list_dot_product(a, embedding::DOUBLE[]) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 9) AS cosine FROM q JOIN embeddings ON query <> vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS rank FROM c) SELECT query, id, rank FROM r WHERE rank <= 3")
def md24_cosine_knn(spark, d):
    e = table(spark, d, "embeddings")
    return M.cosine_neighbours(e.select(F.col("vec_id").alias("query"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 3).select("query", "id", F.col("rank").cast("long").alias("rank"))


@query()
def vl2_md3_ridge_logo(spark, d):
    e = table(spark, d, "embeddings").withColumn("y", F.col("label").cast("double"))
    return M.ridge_leave_group_out(e, "label", "embedding", "y", [0.1, 1.0, 10.0]).select("grp", "lam", "n", r6(F.sqrt(F.col("sse") / F.col("n")), "rmse"))


NATION = "t AS (SELECT s_nationkey AS g, avg(s_acctbal) AS truth, 0.3 * avg(s_suppkey) * 100 AS pred FROM supplier GROUP BY 1)"


def _nation(spark, d):
    return table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("g")).agg(F.avg("s_acctbal").alias("truth"), (0.3 * F.avg("s_suppkey") * 100).alias("pred"))


@query(f"WITH {NATION}, s AS (SELECT avg(truth) AS mt, avg(pred) AS mp, least(greatest(stddev_pop(truth) / stddev_pop(pred), 0.5), 8.0) AS k FROM t) SELECT g, round(mt + k * (pred - mp), 4) AS calibrated FROM t, s")
def vl5_variance_match(spark, d):
    return V.variance_match(_nation(spark, d), "truth", "pred").select("g", F.round("calibrated", 4).alias("calibrated"))


@query(f"WITH {NATION}, s AS (SELECT avg(truth) AS mt, avg(pred) AS mp, least(greatest(covar_pop(truth, pred) / var_pop(pred), 0.5), 4.0) AS k FROM t) SELECT g, round(mt + k * (pred - mp), 4) AS calibrated FROM t, s")
def vl6_regression_calibration(spark, d):
    return V.regression_calibration(_nation(spark, d), "truth", "pred").select("g", F.round("calibrated", 4).alias("calibrated"))


@query(f"WITH {NATION}, r AS (SELECT abs(truth - pred) AS r, row_number() OVER (ORDER BY abs(truth - pred)) AS k, count(*) OVER () AS n FROM t), l(level) AS (VALUES (0.68), (0.9)) SELECT level::DOUBLE AS level, n, round(r, 4) AS half_width FROM r JOIN l ON k = ceil((n + 1) * level - 1e-9)")
def vl8_conformal(spark, d):
    res = _nation(spark, d).withColumn("res", F.col("truth") - F.col("pred"))
    return V.conformal(res, "res", [0.68, 0.9]).select("level", F.col("n").cast("long").alias("n"), F.round("half_width", 4).alias("half_width"))


@query("WITH v AS (SELECT s_nationkey AS unit, s_acctbal AS v, s_suppkey * 10.0 AS r, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier), lo AS (SELECT unit, n, v - r AS x, row_number() OVER (PARTITION BY unit ORDER BY v - r) AS k FROM v), hi AS (SELECT unit, n, v + r AS x, row_number() OVER (PARTITION BY unit ORDER BY v + r) AS k FROM v) SELECT u.unit, round(coalesce(lo.x, '-inf'::DOUBLE), 4) AS lower, round(coalesce(hi.x, 'inf'::DOUBLE), 4) AS upper FROM (SELECT DISTINCT unit, n FROM v) u LEFT JOIN lo ON lo.unit = u.unit AND lo.k = floor(0.32 * (u.n + 1) + 1e-9) LEFT JOIN hi ON hi.unit = u.unit AND hi.k = ceil(0.68 * (u.n + 1) - 1e-9)")
def vl9_jackknife_plus(spark, d):
    folds = table(spark, d, "supplier").select(F.col("s_nationkey").alias("unit"), F.col("s_acctbal").alias("v"), (F.col("s_suppkey") * 10.0).alias("r"))
    return V.jackknife_plus(folds, ["unit"], 0.32).select("unit", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


@query(f"WITH {NATION}, r AS (SELECT truth - pred AS e FROM t) SELECT g, round(avg((pred + e > 4000)::INT), 6) AS p_above FROM t, r GROUP BY g")
def vl10_predictive(spark, d):
    t = _nation(spark, d)
    cuts = t.select("g", (4000 - F.col("pred")).alias("cut"))
    return G.percentile_of(t.select((F.col("truth") - F.col("pred")).alias("e")), cuts, "e", "cut").select("g", r6(1 - F.col("ecdf"), "p_above"))


@query()
def vl11_permutation_null(spark, d):
    s = table(spark, d, "documents").groupBy("source").agg(F.avg("n_chars").alias("x")).withColumn("y", unit_year())
    null = X.spearman(V.permuted(s, 200, "y"), ["draw"], "x", "y")
    seen = X.spearman(s.withColumn("draw", F.lit(-1)), ["draw"], "x", "y").select(F.col("rho").alias("seen"))
    return null.crossJoin(F.broadcast(seen)).agg(F.max("seen").alias("rho"), V.p_value(null, F.col("seen"), "rho").alias("p"), F.median("rho").alias("null_median"))


@query()
def vl16_bootstrap(spark, d):
    b = V.bootstrap_mean(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), ["lang"], "n_chars", 50, ["doc_id"])
    return b.groupBy("lang").agg(F.stddev_samp("mean").alias("sd"), F.percentile("mean", 0.16).alias("lo"), F.percentile("mean", 0.84).alias("hi"))


@query()
def vl17_subsample(spark, d):
    s = V.subsample(table(spark, d, "documents").select("doc_id", "source", "n_chars"), ["source"], 5, 20, ["doc_id"])
    return s.groupBy("source", "draw").agg(F.stddev_pop("n_chars").alias("sd")).groupBy("source").agg(F.avg("sd").alias("sd"))
