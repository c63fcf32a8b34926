"""Queries over sources, projections, joins, sets and grouped statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import features as X
from ..operators import groups as G
from ..sources import tables as R
from ..sources.tables import table
from .registry import DIMS, RANKS, dims, query, r6

HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"


def _hosts(spark, d):
    return table(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


@query(f"SELECT {HOST} AS host, row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) AS place, url FROM pages")
def src8_file_index(spark, d):
    return _hosts(spark, d).select("host", F.row_number().over(Window.partitionBy("host").orderBy("page_id")).cast("long").alias("place"), "url")


@query(f"SELECT {HOST} AS host, arg_min(url, (CASE WHEN contains(url, '/fr') THEN 0 WHEN NOT contains(url, '/en') AND NOT contains(url, '/de') THEN 1 ELSE 2 END) * 1000000 + page_id) AS url FROM pages GROUP BY 1")
def src9_preferred_edition(spark, d):
    level = F.when(F.col("url").contains("/fr"), 0).when(~F.col("url").contains("/en") & ~F.col("url").contains("/de"), 1).otherwise(2)
    return _hosts(spark, d).groupBy("host").agg(F.min_by("url", F.struct(level, F.col("page_id"))).alias("url"))


@query("SELECT n_nationkey, coalesce(s.name, c.name, n_name) AS name, CASE WHEN s.name IS NOT NULL THEN 'supplier' WHEN c.name IS NOT NULL THEN 'customer' ELSE 'nation' END AS found FROM nation LEFT JOIN (SELECT s_nationkey AS k, min(s_name) AS name FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON s.k = n_nationkey LEFT JOIN (SELECT c_nationkey AS k, min(c_name) AS name FROM customer GROUP BY 1) c ON c.k = n_nationkey")
def src10_resolution_chain(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_name").alias("a"))
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_name").alias("b"))
    n = table(spark, d, "nation").join(s, "n_nationkey", "left").join(c, "n_nationkey", "left")
    found = F.when(F.col("a").isNotNull(), "supplier").when(F.col("b").isNotNull(), "customer").otherwise("nation")
    return n.select("n_nationkey", F.coalesce("a", "b", "n_name").alias("name"), found.alias("found"))


@query(f"SELECT {HOST} AS host, arg_min(url, length(url) * 1000000 + page_id) AS url, count(*) AS n FROM pages GROUP BY 1")
def src11_shortest_path(spark, d):
    return _hosts(spark, d).groupBy("host").agg(F.min_by("url", F.struct(F.length("url"), F.col("page_id"))).alias("url"), F.count("*").alias("n"))


@query("SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.size IS NULL OR n.size > o.size THEN n.size ELSE o.size END AS size, CASE WHEN n.size IS NOT NULL AND (o.size IS NULL OR n.size > o.size) THEN 'new' ELSE 'old' END AS side FROM (SELECT c_custkey AS k, c_nationkey AS size FROM customer) o FULL JOIN (SELECT p_partkey AS k, p_size AS size FROM part) n ON o.k = n.k")
def src12_replace_if_longer(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("size"))
    return G.upsert_if_greater(old, table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size")), "k", "size")


@query("SELECT s_suppkey, s_name FROM supplier")
def src14_existing_columns(spark, d):
    return G.select_existing(table(spark, d, "supplier"), ["s_suppkey", "s_phone", "s_name"])


@query("SELECT n_nationkey, '{\"k\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS line FROM nation")
def snk2_json_lines(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))).alias("line"))


@query("WITH a AS (SELECT source AS k, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS d0 FROM documents WHERE lang <> 'de' GROUP BY 1), b AS (SELECT source AS k, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS d1 FROM documents WHERE lang <> 'de' OR doc_id >= 100 GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, CASE WHEN d0 IS NULL THEN 'new' WHEN d1 IS NULL THEN 'missing' WHEN d0 = d1 THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.k = b.k")
def snk7_output_diff(spark, d):
    # an output's digest folds the digests of its rows into two sums, so no group is gathered in one row
    def digest(rows):
        h = F.xxhash64("doc_id").cast("decimal(38,0)")
        return rows.groupBy(F.col("source").alias("k")).agg(F.concat_ws(":", F.count("*").cast("string"), F.sum(h).cast("string")).alias("digest"))

    docs = table(spark, d, "documents")
    return R.compare_outputs(digest(docs.where("lang <> 'de'")), digest(docs.where("lang <> 'de' OR doc_id >= 100")), "k")


@query(f"WITH {DIMS} SELECT DISTINCT feature FROM dims WHERE grp < 5 AND value > 0.3 AND feature IN (SELECT feature FROM dims WHERE grp >= 5 AND value > 0.3)")
def prj2_shared_features(spark, d):
    x = dims(spark, d).where("value > 0.3")
    return x.where("grp < 5").select("feature").distinct().join(x.where("grp >= 5").select("feature").distinct(), "feature", "left_semi")


USE = "SELECT feature, count(value) AS n_finite, round(stddev_pop(value), 6) AS sd, round(avg((coalesce(value, 0) <= 0)::INT), 6) AS low_share FROM (SELECT feature, CASE WHEN value > -0.3 THEN value END AS value FROM dims) GROUP BY feature"


@query(f"WITH {DIMS} {USE} HAVING count(value) >= count(*) * 0.8 AND stddev_pop(value) > 1e-12 AND avg((coalesce(value, 0) <= 0)::INT) < 0.7")
def prj4_prj5_prj6_prj8_usable(spark, d):
    x = dims(spark, d).withColumn("value", F.when(F.col("value") > -0.3, F.col("value")))
    s = x.groupBy("feature").agg(F.count("value").alias("n_finite"), F.count("*").alias("n"), F.stddev_pop("value").alias("s"), F.avg((F.coalesce("value", F.lit(0.0)) <= 0).cast("int")).alias("low"))
    return s.where("n_finite >= n * 0.8 AND s > 1e-12 AND low < 0.7").select("feature", "n_finite", r6("s", "sd"), r6("low", "low_share"))


@query("SELECT CASE WHEN p_name LIKE 'small%' OR p_name LIKE 'large%' THEN 'size' WHEN p_name LIKE 'red%' OR p_name LIKE 'blue%' THEN 'colour' ELSE 'other' END AS family, p_type, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part GROUP BY ALL")
def prj9_prj10_families(spark, d):
    n = F.col("p_name")
    family = F.when(n.startswith("small") | n.startswith("large"), "size").when(n.startswith("red") | n.startswith("blue"), "colour").otherwise("other")
    return table(spark, d, "part").groupBy(family.alias("family"), "p_type").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@query("SELECT doc_id, round(coalesce(toxic, avg(toxic) OVER (PARTITION BY lang)), 6) AS by_mean, coalesce(toxic, 0)::INT AS by_zero FROM documents LEFT JOIN labels USING (doc_id)")
def prj12_mean_impute(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    mean = j.groupBy("lang").agg(F.avg("toxic").alias("m"))
    return j.join(mean, "lang").select("doc_id", r6(F.coalesce(F.col("toxic").cast("double"), "m"), "by_mean"), F.coalesce("toxic", F.lit(0)).alias("by_zero"))


@query("SELECT user_id, event_type, n, round(n * 1000.0 / sum(n) OVER (PARTITION BY user_id), 6) AS rate FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)")
def prj15_ag2_rates(spark, d):
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("user_id"))
    return c.select("user_id", "event_type", "n", r6(S.per_thousand(F.col("n"), total), "rate"))


@query("SELECT conv_id, round(sum(length(text)) / greatest(count(*), 1), 6) AS turn_length, round(count(*) FILTER (role = 'user') / greatest(count(*) FILTER (role = 'assistant'), 1), 6) AS user_ratio FROM conversations GROUP BY 1")
def prj18_structural(spark, d):
    n = F.count("*")
    return table(spark, d, "conversations").groupBy("conv_id").agg(r6(S.per_at_least_one(F.sum(F.length("text")), n), "turn_length"), r6(S.per_at_least_one(F.count_if(F.col("role") == "user"), F.count_if(F.col("role") == "assistant")), "user_ratio"))


BINS = [("low", 0, 50000), ("mid", 50000, 200000), ("high", 200000, 400000)]


@query("WITH b(bin, lo, hi) AS (VALUES ('low', 0, 50000), ('mid', 50000, 200000), ('high', 200000, 400000)) SELECT bin, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders JOIN b ON o_totalprice >= lo AND o_totalprice < hi GROUP BY 1")
def prj20_bins(spark, d):
    p, name = F.col("o_totalprice"), F.lit(None).cast("string")
    for n, lo, hi in BINS:  # a projection; no join
        name = F.when((p >= lo) & (p < hi), n).otherwise(name)
    return table(spark, d, "orders").select(name.alias("bin"), p).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("WITH s(scenario, shift) AS (VALUES ('none', 0.0), ('all', 50.0), ('late', -30.0)) SELECT scenario, c_mktsegment, count(*) AS n, round(avg(c_acctbal + CASE WHEN scenario <> 'late' OR c_acctbal > 5000 THEN shift ELSE 0 END), 4) AS mean FROM customer, s GROUP BY ALL")
def prj22_shift_scenarios(spark, d):
    x = G.scenarios(table(spark, d, "customer").select("c_mktsegment", "c_acctbal"), [("none", 0), ("all", 50), ("late", -30)], "c_acctbal", lambda n: F.col("c_acctbal") > 5000 if n == "late" else F.lit(True))
    return x.groupBy("scenario", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg("shifted"), 4).alias("mean"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'holdout' WHEN quality = 0 THEN 'diagnostic' WHEN quality = 1 THEN 'train' ELSE 'target' END AS role, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'fair' ELSE 'long' END AS verdict FROM documents LEFT JOIN labels USING (doc_id)")
def prj23_prj24_roles(spark, d):
    j = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    role = F.when(F.col("toxic") == 1, "holdout").when(F.col("quality") == 0, "diagnostic").when(F.col("quality") == 1, "train").otherwise("target")
    return j.select("doc_id", role.alias("role"), F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "fair").otherwise("long").alias("verdict"))


@query("SELECT source, count(*) AS n FROM documents WHERE lang IN ('fr', 'es') AND n_chars >= 100 AND doc_id IN (SELECT doc_id FROM labels) GROUP BY 1")
def prj25_prj26_prj27_filters(spark, d):
    docs = table(spark, d, "documents").where(F.col("lang").isin("fr", "es") & (F.col("n_chars") >= 100))
    return docs.select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


@query(f"WITH {DIMS}, l AS (SELECT feature, regr_slope(value, grp) AS b, regr_intercept(value, grp) AS a FROM dims GROUP BY 1), p AS (SELECT row, avg((value - (a + b * 2)) / (b * 5)) AS s FROM dims JOIN l USING (feature) WHERE abs(b) > 1e-3 GROUP BY 1) SELECT row, round(s, 4) AS score, CASE WHEN round(s, 4) < 0 THEN 'early' WHEN round(s, 4) < 0.5 THEN 'rather early' WHEN round(s, 4) < 1 THEN 'rather late' ELSE 'late' END AS class FROM p")
def prj29_anchor_position(spark, d):
    x = dims(spark, d)
    line = X.regression(x, ["feature"], "grp", "value").where("abs(slope) > 1e-3").select("feature", "slope", "intercept")
    low, high = F.col("intercept") + F.col("slope") * 2, F.col("intercept") + F.col("slope") * 7
    s = x.join(line, "feature").groupBy("row").agg(F.round(F.avg((F.col("value") - low) / (high - low)), 4).alias("score"))
    c = F.col("score")
    return s.select("row", "score", F.when(c < 0, "early").when(c < 0.5, "rather early").when(c < 1, "rather late").otherwise("late").alias("class"))


@query(f"WITH {DIMS}, r AS (SELECT feature, corr(grp, value) AS r, min(value) AS lo, max(value) AS hi FROM dims WHERE grp < 7 GROUP BY 1 HAVING abs(corr(grp, value)) >= 0.05) SELECT row, round(avg(CASE WHEN r > 0 THEN (value - lo) / (hi - lo) ELSE (hi - value) / (hi - lo) END), 6) AS score FROM dims JOIN r USING (feature) WHERE grp >= 7 GROUP BY 1")
def prj31_range_position(spark, d):
    x, v = dims(spark, d), F.col("value")
    ends = x.where("grp < 7").groupBy("feature").agg(F.corr("grp", "value").alias("r"), F.min(v).alias("lo"), F.max(v).alias("hi")).where("abs(r) >= 0.05")
    span = F.col("hi") - F.col("lo")
    return x.where("grp >= 7").join(ends, "feature").groupBy("row").agg(r6(F.avg(F.when(F.col("r") > 0, (v - F.col("lo")) / span).otherwise((F.col("hi") - v) / span)), "score"))


@query("SELECT event_id, CASE WHEN event_type = 'view' AND left(md5('7:' || event_id), 1) < '4' THEN 'read' ELSE event_type END AS event_type FROM events")
def prj30_override(spark, d):
    drawn = F.left(F.md5(F.concat(F.lit("7:"), F.col("event_id").cast("string"))), F.lit(1)) < "4"  # a quarter, by a hash of the key
    return table(spark, d, "events").select("event_id", F.when((F.col("event_type") == "view") & drawn, "read").otherwise(F.col("event_type")).alias("event_type"))


@query("SELECT user_id, a.mean AS view_mean, b.mean AS click_mean FROM (SELECT user_id, round(avg(value), 6) AS mean FROM events WHERE event_type = 'view' GROUP BY 1) a JOIN (SELECT user_id, round(avg(value), 6) AS mean FROM events WHERE event_type = 'click' GROUP BY 1) b USING (user_id)")
def jn1_jn2_families(spark, d):
    # both sides are aggregates of one scan on one key: a single shuffle serves for the join
    of = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    return table(spark, d, "events").groupBy("user_id").agg(r6(of("view"), "view_mean"), r6(of("click"), "click_mean")).where("view_mean IS NOT NULL AND click_mean IS NOT NULL")


@query("SELECT o_orderkey, c_mktsegment, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def jn3_jn6_dimensions(spark, d):
    o, c = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return o.join(c, o.o_custkey == c.c_custkey, "left").join(n, F.col("c_nationkey") == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("o_orderkey", "c_mktsegment", "n_name", "r_name")


@query("SELECT s_nationkey AS k, round(avg(s_acctbal), 4) AS supplier_mean, c.m AS customer_mean FROM supplier JOIN (SELECT c_nationkey AS k, round(avg(c_acctbal), 4) AS m FROM customer GROUP BY 1) c ON c.k = s_nationkey GROUP BY 1, 3")
def jn5_index_intersection(spark, d):
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.round(F.avg("s_acctbal"), 4).alias("supplier_mean"))
    return s.join(table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.avg("c_acctbal"), 4).alias("customer_mean")), "k")


CHUNKED = "m AS (SELECT l_orderkey AS obj, l_partkey AS member, l_linenumber AS line, (l_partkey % 7)::BIGINT AS chunk FROM lineitem)"


@query("SELECT n_regionkey AS region, count(DISTINCT s_nationkey) AS nations, count(DISTINCT s_suppkey) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def jn10_containment_up(spark, d):
    s, n = table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), table(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).groupBy(F.col("n_regionkey").alias("region")).agg(F.countDistinct("s_nationkey").alias("nations"), F.countDistinct("s_suppkey").alias("suppliers"))


@query("WITH o AS (SELECT DISTINCT l_orderkey AS obj, l_partkey AS member FROM lineitem), c AS (SELECT DISTINCT member, member % 3 AS chunk FROM o), s AS (SELECT obj, count(*) AS size FROM o GROUP BY 1), i AS (SELECT chunk, obj, count(*) AS n FROM o JOIN c USING (member) GROUP BY 1, 2) SELECT chunk, count(*) AS touched, sum((n = size)::INT)::BIGINT AS whole, sum((n <> size)::INT)::BIGINT AS part FROM i JOIN s USING (obj) GROUP BY 1")
def jn11_fx11_overlap(spark, d):
    o = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("obj"), F.col("l_partkey").alias("member")).distinct()
    return G.overlap(o, o.select("member").distinct().withColumn("chunk", F.col("member") % 3), "obj", "member", "chunk")


@query("SELECT lam::DOUBLE AS lam, o_orderpriority, round(avg(o_totalprice / (1 + lam)), 4) AS shrunk FROM orders, (VALUES (0.1), (1.0), (10.0)) l(lam) GROUP BY ALL")
def jn13_grid(spark, d):
    lam = F.explode(F.array(*[F.lit(x) for x in (0.1, 1.0, 10.0)])).alias("lam")
    m = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("m"))
    return m.select("o_orderpriority", "m", lam).select("lam", "o_orderpriority", F.round(F.col("m") / (1 + F.col("lam")), 4).alias("shrunk"))


@query("SELECT conv_id, turn // 2 AS pair, max(length(text)) FILTER (turn % 2 = 0) AS first_chars, max(length(text)) FILTER (turn % 2 = 1) AS second_chars FROM conversations GROUP BY ALL")
def jn16_matched_pairs(spark, d):
    side = lambda k: F.max(F.when(F.col("turn") % 2 == k, F.length("text"))).cast("long")
    return table(spark, d, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 2).alias("pair")).agg(side(0).alias("first_chars"), side(1).alias("second_chars"))


@query("SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, round(avg(n_chars), 6) AS mean, median(n_chars) AS med, quantile_cont(n_chars, 0.75) AS q3, count(*) FILTER (contains(text, '#')) AS marked FROM documents GROUP BY 1")
def ag1_ag3_ag4_ag6_group(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs"), r6(F.avg("n_chars"), "mean"), F.median("n_chars").alias("med"), F.percentile("n_chars", 0.75).alias("q3"), F.count_if(F.col("text").contains("#")).alias("marked"))


@query(f"WITH {DIMS}, g AS (SELECT feature, grp, avg(value) AS value, grp::DOUBLE AS y FROM dims GROUP BY 1, 2), k AS {RANKS.format(by='feature', x='value', y='y', t='g')} SELECT feature, round(corr(rx, ry), 6) AS rho, abs(corr(rx, ry)) * sqrt((count(*) - 2) / (1 - corr(rx, ry) ** 2)) > 2.306004 AS kept FROM k GROUP BY feature")
def ag11_ag13_screen(spark, d):
    g = dims(spark, d).groupBy("feature", "grp").agg(F.avg("value").alias("value")).withColumn("y", F.col("grp").cast("double"))
    rho = X.spearman(g, ["feature"], "value", "y")
    t = F.abs("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))
    return rho.select("feature", r6("rho", "rho"), (t > 2.306004).alias("kept"))  # two-sided 5 % of t with 8 degrees of freedom


@query(f"WITH {DIMS}, g AS (SELECT feature, grp, avg(value) AS v, grp::DOUBLE AS y FROM dims GROUP BY 1, 2), l AS (SELECT a.feature, a.grp, corr(b.v, b.y) AS r FROM g a JOIN g b ON a.feature = b.feature AND a.grp <> b.grp GROUP BY 1, 2) SELECT feature, round(avg((abs(r) * sqrt(7 / (1 - r * r)) > 2.364624)::INT), 6) AS robust, bool_and(r > 0) OR bool_and(r < 0) AS stable FROM l GROUP BY 1")
def ag15_ag16_loo_robustness(spark, d):
    g = dims(spark, d).groupBy("feature", "grp").agg(F.avg("value").alias("v")).withColumn("y", F.col("grp").cast("double"))
    s = lambda c: F.sum(c).over(Window.partitionBy("feature"))
    v, y, one = F.col("v"), F.col("y"), F.lit(1.0)
    # each fold's sums are the totals less its own row: no join of folds with rows
    n, sv, sy, svv, syy, svy = [s(c) - c for c in (one, v, y, v * v, y * y, v * y)]
    r = (n * svy - sv * sy) / F.sqrt((n * svv - sv * sv) * (n * syy - sy * sy))
    folds = g.select("feature", r.alias("r"))
    sure = F.abs("r") * F.sqrt(7 / (1 - F.col("r") * F.col("r"))) > 2.364624
    return folds.groupBy("feature").agg(r6(F.avg(sure.cast("int")), "robust"), (F.bool_and(F.col("r") > 0) | F.bool_and(F.col("r") < 0)).alias("stable"))


@query("WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) * count(*) AS w FROM lineitem GROUP BY 1), t AS (SELECT sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS b, sum(w) AS w, count(*) AS k FROM g) SELECT k, round(b / (b + w), 9) AS share FROM t")
def ag21_ag22_share_between(spark, d):
    return G.share_between(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice").select("k", F.round("share", 9).alias("share"))


@query("WITH j AS (SELECT quality AS t, (n_chars > 1000)::INT AS p FROM documents JOIN labels USING (doc_id)) SELECT count(*) AS n, round(avg((t = p)::INT), 6) AS accuracy, round(greatest(avg(t), 1 - avg(t)), 6) AS majority, count(*) FILTER (t = 1 AND p = 1) AS tp, count(*) FILTER (t = 0 AND p = 1) AS fp FROM j")
def ag23_accuracy(spark, d):
    j = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id").select(F.col("quality").alias("t"), (F.col("n_chars") > 1000).cast("int").alias("p"))
    return j.agg(F.count("*").alias("n"), r6(F.avg((F.col("t") == F.col("p")).cast("int")), "accuracy"), r6(F.greatest(F.avg("t"), 1 - F.avg("t")), "majority"), F.count_if((F.col("t") == 1) & (F.col("p") == 1)).alias("tp"), F.count_if((F.col("t") == 0) & (F.col("p") == 1)).alias("fp"))


@query("SELECT l_linestatus, count(*) AS n, round(avg(abs(l_extendedprice - 1500 * l_quantity)), 4) AS mae, round(avg(1500 * l_quantity - l_extendedprice), 4) AS bias, round(sqrt(avg((l_extendedprice - 1500 * l_quantity) ** 2)), 4) AS rmse FROM lineitem GROUP BY 1")
def ag24_skl1_errors(spark, d):
    x = table(spark, d, "lineitem").select("l_linestatus", "l_extendedprice", (1500 * F.col("l_quantity")).alias("pred"))
    return G.errors(x, "l_extendedprice", "pred", ["l_linestatus"]).select("l_linestatus", "n", *[F.round(c, 4).alias(c) for c in ("mae", "bias", "rmse")])


@query("WITH s AS (SELECT o_orderpriority, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, avg(x) FILTER (f) AS m1, avg(x) FILTER (NOT f) AS m2, var_samp(x) FILTER (f) / count(*) FILTER (f) AS q1, var_samp(x) FILTER (NOT f) / count(*) FILTER (NOT f) AS q2 FROM (SELECT o_orderpriority, o_totalprice AS x, o_orderstatus = 'F' AS f FROM orders) GROUP BY 1) SELECT o_orderpriority, n1, n2, round((m1 - m2) / sqrt(q1 + q2), 6) AS t, round((q1 + q2) ** 2 / (q1 ** 2 / (n1 - 1) + q2 ** 2 / (n2 - 1)), 4) AS df FROM s")
def ag27_welch(spark, d):
    w = G.welch(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", F.col("o_orderstatus") == "F")
    return w.select("o_orderpriority", "n1", "n2", r6("t", "t"), F.round("df", 4).alias("df"))


@query("WITH s AS (SELECT l_returnflag, var_pop(l_quantity) AS a, covar_pop(l_quantity, l_discount) AS b, var_pop(l_discount) AS c, covar_pop(l_quantity, l_extendedprice) AS d, covar_pop(l_discount, l_extendedprice) AS e, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2 FROM lineitem GROUP BY 1), c AS (SELECT *, (c * d - b * e) / (a * c - b * b) AS b1, (a * e - b * d) / (a * c - b * b) AS b2 FROM s) SELECT l_returnflag, round(b1, 3) AS b1, round(b2, 2) AS b2, round(my - b1 * m1 - b2 * m2, 2) AS b0 FROM c")
def ag28_ols(spark, d):
    return G.two_predictor_ols(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", "l_discount").select("l_returnflag", F.round("b1", 3).alias("b1"), F.round("b2", 2).alias("b2"), F.round("b0", 2).alias("b0"))


@query("WITH x AS (SELECT o_orderpriority AS g, o_totalprice - 250000 AS d FROM orders), r AS (SELECT g, d, rank() OVER (PARTITION BY g ORDER BY abs(d)) + (count(*) OVER (PARTITION BY g, abs(d)) - 1) / 2.0 AS r FROM x WHERE d <> 0) SELECT g, count(*) AS n, count(*) FILTER (d > 0) AS n_up, sum(r) FILTER (d > 0) AS w_up, sum(r) FILTER (d < 0) AS w_down FROM r GROUP BY g")
def ag29_signed_ranks(spark, d):
    return G.signed_ranks(table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), (F.col("o_totalprice") - 250000).alias("d")), ["g"], "d")


@query(f"WITH {DIMS}, s AS (SELECT feature, avg(value) FILTER (grp < 3) AS a, avg(value) FILTER (grp BETWEEN 3 AND 6) AS c, avg(value) FILTER (grp > 6) AS k, sqrt((var_samp(value) FILTER (grp < 3) + var_samp(value) FILTER (grp > 6)) / 2) AS sd FROM dims GROUP BY 1) SELECT feature, round((a - c) / nullif(k - c, 0), 4) AS resistance, round((k - a) / sd, 6) AS separation FROM s")
def ag31_resistance(spark, d):
    v, g = F.col("value"), F.col("grp")
    a, c, k = F.when(g < 3, v), F.when(g.between(3, 6), v), F.when(g > 6, v)
    s = dims(spark, d).groupBy("feature").agg(F.avg(a).alias("a"), F.avg(c).alias("c"), F.avg(k).alias("k"), F.sqrt((F.var_samp(a) + F.var_samp(k)) / 2).alias("sd"))
    return s.select("feature", F.round(F.try_divide(F.col("a") - F.col("c"), F.col("k") - F.col("c")), 4).alias("resistance"), r6((F.col("k") - F.col("a")) / F.col("sd"), "separation"))


@query(f"WITH {DIMS}, l AS (SELECT feature, regr_slope(value, grp) AS b, regr_intercept(value, grp) AS a FROM dims GROUP BY 1 HAVING abs(regr_slope(value, grp)) > 1e-3) SELECT row, round(avg((value - a) / b), 4) AS implied, round(stddev_pop((value - a) / b), 4) AS spread, round(quantile_cont((value - a) / b, 0.75) - quantile_cont((value - a) / b, 0.25), 4) AS iqr, count(*) FILTER ((value - a) / b > 9) AS beyond FROM dims JOIN l USING (feature) GROUP BY 1")
def ag32_implied_dates(spark, d):
    x = dims(spark, d)
    line = X.regression(x, ["feature"], "grp", "value").where("abs(slope) > 1e-3").select("feature", "slope", "intercept")
    e = x.join(line, "feature").withColumn("e", (F.col("value") - F.col("intercept")) / F.col("slope"))
    q = lambda p: F.percentile("e", p)
    return e.groupBy("row").agg(F.round(F.avg("e"), 4).alias("implied"), F.round(F.stddev_pop("e"), 4).alias("spread"), F.round(q(0.75) - q(0.25), 4).alias("iqr"), F.count_if(F.col("e") > 9).alias("beyond"))


@query(f"WITH {DIMS} SELECT 'f' || (feature // 16) AS family, count(*) AS n, round(sum(value), 4) AS total, round(sqrt(sum(value * value)), 6) AS norm, round(sum(abs(value)) / (SELECT sum(abs(value)) FROM dims), 6) AS share FROM dims GROUP BY 1")
def ag33_leverage(spark, d):
    return G.leverage(dims(spark, d), F.concat(F.lit("f"), F.floor(F.col("feature") / 16).cast("string")), "value").select("family", "n", F.round("total", 4).alias("total"), r6("norm", "norm"), r6("share", "share"))


@query("SELECT lang, count(*) AS n, min(n_chars) AS least, median(n_chars) AS med, max(n_chars) AS greatest, round(avg(n_chars), 6) AS mean, round(avg((n_chars BETWEEN 500 AND 5000)::INT), 6) AS in_band FROM documents GROUP BY 1")
def ag34_size_audit(spark, d):
    return G.size_audit(table(spark, d, "documents"), ["lang"], "n_chars", 500, 5000).select("lang", "n", "least", "med", "greatest", r6("mean", "mean"), r6("in_band", "in_band"))


@query("SELECT lang, count(DISTINCT source) AS sources, count(*) AS n, count(*) FILTER (n_chars < 1000) AS short FROM documents GROUP BY 1")
def ag35_crosstab(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.countDistinct("source").alias("sources"), F.count("*").alias("n"), F.count_if(F.col("n_chars") < 1000).alias("short"))


@query("WITH p AS (SELECT s_nationkey AS target, unnest(['a', 'b', 'c']) AS spec, unnest([s_acctbal, s_acctbal * 1.1, s_acctbal - 300]) AS x FROM supplier) SELECT target, count(*) AS n, round(max(x) - min(x), 4) AS span, round(stddev_samp(x), 4) AS sd, count(*) FILTER (x BETWEEN 2000 AND 6000) AS inside FROM p GROUP BY 1")
def ag36_ledger(spark, d):
    s = table(spark, d, "supplier").withColumn("x", F.explode(F.array(F.col("s_acctbal"), F.col("s_acctbal") * 1.1, F.col("s_acctbal") - 300)))
    return s.groupBy(F.col("s_nationkey").alias("target")).agg(F.count("*").alias("n"), F.round(F.max("x") - F.min("x"), 4).alias("span"), F.round(F.stddev_samp("x"), 4).alias("sd"), F.count_if(F.col("x").between(2000, 6000)).alias("inside"))


@query(f"WITH {DIMS}, e AS (SELECT feature, max(value) AS top, stddev_pop(value) AS sd FROM dims WHERE grp < 8 GROUP BY 1) SELECT row, round(avg((value - top) / sd), 6) AS mean_over, round(max((value - top) / sd), 6) AS max_over, count(*) FILTER (value > top) AS beyond FROM dims JOIN e USING (feature) WHERE grp >= 8 GROUP BY 1")
def ag38_overshoot(spark, d):
    x = dims(spark, d)
    e = x.where("grp < 8").groupBy("feature").agg(F.max("value").alias("top"), F.stddev_pop("value").alias("sd"))
    over = (F.col("value") - F.col("top")) / F.col("sd")
    return x.where("grp >= 8").join(e, "feature").groupBy("row").agg(r6(F.avg(over), "mean_over"), r6(F.max(over), "max_over"), F.count_if(F.col("value") > F.col("top")).alias("beyond"))


@query(f"WITH {DIMS}, l AS (SELECT feature, avg(value) FILTER (grp % 2 = 0) - avg(value) FILTER (grp % 2 = 1) AS gap, regr_slope(value, grp) * (max(grp) - min(grp)) AS span FROM dims GROUP BY 1) SELECT feature, round(gap * gap / greatest(span * span, 1e-4), 4) AS ratio FROM l")
def ag40_gap_ratio(spark, d):
    v, g = F.col("value"), F.col("grp")
    gap, span = F.avg(F.when(g % 2 == 0, v)) - F.avg(F.when(g % 2 == 1, v)), F.regr_slope(v, g) * (F.max(g) - F.min(g))
    return dims(spark, d).groupBy("feature").agg(F.round(gap * gap / F.greatest(span * span, F.lit(1e-4)), 4).alias("ratio"))


HIST = "h AS (SELECT l_returnflag AS g, l_quantity::BIGINT AS x, count(*)::DOUBLE AS p FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {HIST}, c AS (SELECT g, x, p / sum(p) OVER (PARTITION BY g) AS m, sum(p) OVER (PARTITION BY g ORDER BY x) / sum(p) OVER (PARTITION BY g) AS c FROM h), e AS (SELECT a.g, a.x AS lower, min(b.x) AS upper FROM c a JOIN c b ON a.g = b.g AND b.c - (a.c - a.m) >= 0.68 - 1e-9 AND b.x >= a.x GROUP BY 1, 2) SELECT g, arg_min(lower, (upper - lower) * 1000 + lower) AS lower, arg_min(upper, (upper - lower) * 1000 + lower) AS upper FROM e GROUP BY 1")
def wn11_shortest_interval(spark, d):
    h = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_quantity").cast("long").alias("x")).agg(F.count("*").cast("double").alias("p"))
    return G.shortest_interval(h, ["g"], "x", "p", 0.68)


@query("WITH c AS (SELECT event_id, user_id, event_type, (event_type IS DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1)::INT AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT c.*, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run_no FROM c JOIN events USING (event_id, user_id)) SELECT user_id, run_no::BIGINT AS run_no, any_value(event_type) AS event_type, count(*) AS n FROM r GROUP BY 1, 2")
def wn12_runs(spark, d):
    r = G.runs(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    return r.groupBy("user_id", "run_no").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n"))


@query("SELECT o_orderpriority, o_orderkey, k FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 5")
def wn14_top_n(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("k", F.row_number().over(w).cast("long")).where("k <= 5").select("o_orderpriority", "o_orderkey", "k")


@query("SELECT s_suppkey, round((SELECT avg((c_acctbal <= s_acctbal)::INT) FROM customer), 6) AS ecdf FROM supplier")
def wn15_percentile_of(spark, d):
    return G.percentile_of(table(spark, d, "customer"), table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "c_acctbal", "s_acctbal").select("s_suppkey", r6(F.coalesce("ecdf", F.lit(0.0)), "ecdf"))


@query("SELECT c_mktsegment, arg_max(c_custkey, abs(c_acctbal) * 1e9 - c_custkey) AS extreme, arg_min(c_custkey, abs(c_acctbal) * 1e9 + c_custkey) AS least FROM customer GROUP BY 1")
def wn17_arg_extreme(spark, d):
    a = F.abs("c_acctbal")
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.max_by("c_custkey", F.struct(a, -F.col("c_custkey"))).alias("extreme"), F.min_by("c_custkey", F.struct(a, F.col("c_custkey"))).alias("least"))


@query("SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier UNION ALL SELECT 'total', NULL, round(sum(s_acctbal), 2), NULL FROM supplier")
def st1_st2_union(spark, d):
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(s, allowMissingColumns=True).unionByName(s.agg(F.lit("total").alias("kind"), F.round(F.sum("balance"), 2).alias("balance")), allowMissingColumns=True)


@query("SELECT k, coalesce(max(n) FILTER (side = 's'), 0) AS suppliers, coalesce(max(n) FILTER (side = 'c'), 0) AS customers FROM (SELECT 's' AS side, s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 2 UNION ALL SELECT 'c', c_nationkey, count(*) FROM customer GROUP BY 2) GROUP BY k")
def st3_count_frames(spark, d):
    u = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit(1).alias("s"), F.lit(0).alias("c")).unionByName(table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit(0).alias("s"), F.lit(1).alias("c")))
    return u.groupBy("k").agg(F.sum("s").alias("suppliers"), F.sum("c").alias("customers"))


@query("(SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL (SELECT -1 - k FROM (SELECT p_partkey AS k FROM part INTERSECT SELECT l_partkey FROM lineitem))")
def st4_st5_sets(spark, d):
    no_order = table(spark, d, "customer").select(F.col("c_custkey").alias("k")).join(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k", "left_anti").distinct()
    sold = table(spark, d, "part").select(F.col("p_partkey").alias("k")).intersect(table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")))
    return no_order.unionByName(sold.select((-1 - F.col("k")).alias("k")))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def st6_keep_first(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("WITH u AS (SELECT DISTINCT user_id FROM events), t AS (SELECT DISTINCT event_type FROM events), c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, event_type, coalesce(n, 0) AS n FROM u CROSS JOIN t LEFT JOIN c USING (user_id, event_type)")
def st7_vocabulary_union(spark, d):
    # the vocabulary is the pivot's columns: units never meet the vocabulary in a cross join
    e = table(spark, d, "events")
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # vocabulary of a closed class
    wide = e.groupBy("user_id").pivot("event_type", kinds).count().na.fill(0)
    return wide.unpivot("user_id", kinds, "event_type", "n") if kinds else e.select("user_id", "event_type", F.lit(0).cast("long").alias("n"))
