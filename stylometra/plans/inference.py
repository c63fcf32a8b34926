"""Queries over regressions with tails, nested choices, nulls of a whole fit, and substitution."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import inference as I
from ..operators import text as T
from ..sources.tables import table
from .registry import DIMS, TOK, dims, query, r6, unit_year

LAMS = [0.1, 1.0, 10.0, 100.0]


def _strata(spark, d) -> dict[str, str]:
    """Even and odd labels; a row for each group."""
    return {str(g): "odd" if g % 2 else "even" for (g,) in table(spark, d, "embeddings").where("label IS NOT NULL").select("label").distinct().collect()}


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("label").alias("g"), "embedding", F.col("label").cast("double").alias("y"))


@query(f"WITH {DIMS}, g AS (SELECT feature, row AS grp, value, grp::DOUBLE AS y, ('0x' || substr(md5(row::VARCHAR), 1, 7))::BIGINT % 5 AS f FROM dims), p AS (SELECT feature, f, count(*) AS n, sum(value) AS a, sum(y) AS b, sum(value * y) AS c FROM g GROUP BY 1, 2), w AS (SELECT feature, sum(n) AS n, sum(a) AS a, sum(b) AS b, sum(c) AS c FROM p GROUP BY 1) SELECT feature, count(*) AS folds, round(avg((sign((w.c - p.c) - (w.a - p.a) * (w.b - p.b) / (w.n - p.n)) = sign(w.c - w.a * w.b / w.n))::INT), 6) AS same_sign FROM p JOIN w USING (feature) GROUP BY 1")
def ag16_fold_stability(spark, d):
    g = dims(spark, d).select("feature", F.col("row").alias("grp"), "value", F.col("grp").cast("double").alias("y"))
    return I.fold_stability(g, 5).select("feature", "folds", r6("same_sign", "same_sign"))


@query(f"WITH {DIMS}, x AS (SELECT feature, grp % 3 AS genre, grp AS t, value, row % 7 + 1 AS w FROM dims), m AS (SELECT feature, sum(w * value) / sum(w) AS m, sum(w * t) / sum(w) AS mt, sum(w) AS sw FROM x GROUP BY 1), g AS (SELECT feature, genre, sum(w) AS w, sum(w * value) / sum(w) AS m FROM x GROUP BY 1, 2), b AS (SELECT g.feature, sum(g.w * (g.m - m.m) ** 2) / any_value(sw) AS between FROM g JOIN m USING (feature) GROUP BY 1), s AS (SELECT x.feature, sum(w * (t - mt) * (value - m)) / sum(w * (t - mt) ** 2) AS slope, sum(w * (t - mt) ** 2) / sum(w) AS vt FROM x JOIN m USING (feature) GROUP BY 1) SELECT feature, round(between / greatest(slope * slope * vt, 1e-6), 4) AS ratio FROM b JOIN s USING (feature)")
def ag22_ag40_weighted_ratio(spark, d):
    x = dims(spark, d).select("feature", (F.col("grp") % 3).alias("genre"), F.col("grp").alias("t"), "value", (F.col("row") % 7 + 1).alias("w"))
    s = lambda e, n: F.sum(F.col("w") * e).alias(n)
    v, t = F.col("value"), F.col("t")
    g = x.groupBy("feature", "genre").agg(F.sum("w").alias("w"), F.sum(F.col("w") * v).alias("wv"), s(t, "wt"), s(t * t, "wtt"), s(t * v, "wtv"))
    a = g.groupBy("feature").agg(F.sum("w").alias("w"), F.sum("wv").alias("wv"), F.sum("wt").alias("wt"), F.sum("wtt").alias("wtt"), F.sum("wtv").alias("wtv"), F.sum(F.col("wv") * F.col("wv") / F.col("w")).alias("part"))
    between = (F.col("part") - F.col("wv") * F.col("wv") / F.col("w")) / F.col("w")
    stt, stv = F.col("wtt") - F.col("wt") * F.col("wt") / F.col("w"), F.col("wtv") - F.col("wt") * F.col("wv") / F.col("w")
    temporal = stv / stt * stv / stt * stt / F.col("w")
    return a.select("feature", F.round(between / F.greatest(temporal, F.lit(1e-6)), 4).alias("ratio"))


@query()
def ag28_md25_regression_tails(spark, d):
    li = table(spark, d, "lineitem").withColumn("w", 1 + F.col("l_tax"))
    out = I.ols(li, ["l_returnflag"], "l_extendedprice", ["l_quantity", "l_discount", "l_linenumber"], "w")
    return out.select("l_returnflag", "term", F.round("coef", 3).alias("coef"), F.round("se", 3).alias("se"), F.round("t", 3).alias("t"), r6("p", "p"))


@query("WITH x AS (SELECT o_orderpriority AS g, o_totalprice - 250000 AS d FROM orders WHERE o_totalprice <> 250000), r AS (SELECT g, d, rank() OVER (PARTITION BY g ORDER BY abs(d)) + (count(*) OVER (PARTITION BY g, abs(d)) - 1) / 2.0 AS r FROM x), t AS (SELECT g, sum(k * k * k - k) AS ties FROM (SELECT g, abs(d) AS a, count(*)::DOUBLE AS k FROM x GROUP BY 1, 2) GROUP BY 1), s AS (SELECT g, count(*)::DOUBLE AS n, count(*) FILTER (d > 0) AS n_up, sum(r) FILTER (d > 0) AS w FROM r GROUP BY g) SELECT g, n::BIGINT AS n, n_up, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z, round(least(1.0, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0))) FROM range(least(n_up, n - n_up)::BIGINT + 1) r(i))), 6) AS sign_p FROM s JOIN t USING (g)")
def ag29_paired_tests(spark, d):
    x = table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), (F.col("o_totalprice") - 250000).alias("d"))
    return I.paired_tests(x, ["g"], "d").select("g", "n", "n_up", r6("z", "z"), r6("sign_p", "sign_p"))


@query(f"""WITH RECURSIVE chance(n, d) AS (SELECT 0::BIGINT, [1.0::DOUBLE] UNION ALL SELECT n + 1, list_transform(range((n + 1) * (n + 2) // 2 + 1), lambda w: (CASE WHEN w < len(d) THEN d[w + 1] ELSE 0 END + CASE WHEN w >= n + 1 THEN d[w - n] ELSE 0 END) / 2) FROM chance WHERE n < {I.EXACT_RANKS}),
x AS (SELECT o_custkey AS g, round(o_totalprice - 150000, 2) AS d FROM orders),
b AS (SELECT g FROM x GROUP BY g HAVING count(*) <= {I.EXACT_RANKS} AND count(*) FILTER (d = 0) = 0 AND count(DISTINCT abs(d)) = count(*)),
r AS (SELECT g, d, rank() OVER (PARTITION BY g ORDER BY abs(d)) AS r FROM x SEMI JOIN b USING (g)),
s AS (SELECT g, count(*) AS n, count(*) FILTER (d > 0) AS n_up, coalesce(sum(r) FILTER (d > 0), 0)::BIGINT AS w FROM r GROUP BY g)
SELECT g, s.n, n_up, w::DOUBLE AS w_up, round(least(1.0, 2 * least(list_sum(d[1 : w + 1]), list_sum(d[w + 1 :]))), 6) AS rank_p FROM s JOIN chance ON chance.n = s.n""")
def ag29_exact_signed_rank(spark, d):
    """Customers' orders against a fixed sum, where the exact test applies."""
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("g"), F.round(F.col("o_totalprice") - 150000, 2).alias("d"))
    return I.paired_tests(x, ["g"], "d").where("exact").select("g", "n", "n_up", F.col("w_up").cast("double").alias("w_up"), r6("rank_p", "rank_p"))


@query()
def md4_hat_ridge(spark, d):
    h = I.hat_leave_one_out(_vectors(spark, d), "vec_id", "embedding", "y", 1.0)
    return h.select("vec_id", r6("fitted", "fitted"), r6("leverage", "leverage"), r6("loo", "loo"))


@query()
def vl3_nested_configurations(spark, d):
    r = I.nested_choice(_vectors(spark, d), "g", "embedding", "y", LAMS, {"first": list(range(32)), "second": list(range(32, 64)), "all": list(range(64))})
    return r.select("grp", "choice", "lam", r6("inner_rho", "inner_rho"), "truth", r6("pred", "pred"))


@query()
def vl4_nested_screen(spark, d):
    r = I.nested_choice(_vectors(spark, d), "g", "embedding", "y", LAMS, strata=_strata(spark, d), fractions=[0.25, 0.5, 1.0])
    return r.select("grp", "choice", "lam", r6("inner_rho", "inner_rho"), "truth", r6("pred", "pred"))


@query()
def vl20_specification_curve(spark, d):
    return I.specification_curve(_vectors(spark, d), "g", "embedding", "y", LAMS, [1, 20, 100], _strata(spark, d), [0.25, 0.5, 1.0])


@query()
def vl24_detectable(spark, d):
    n = table(spark, d, "embeddings").groupBy("label").count().count()
    return spark.createDataFrame([(k, float(I.detectable(k))) for k in (n, 25, 42, 100)], "n long, rho double").distinct().select("n", r6("rho", "rho"))


CHANGES = {"the": "le", "der": "la", "el": "les", "de": "of"}
RATES = (0.0, 0.25, 0.5, 1.0)
FORMS = ("the", "der", "el", "de", "le", "la")
_CASE = " ".join(f"WHEN token = '{a}' THEN '{b}'" for a, b in CHANGES.items())


@query(f"WITH {TOK}, n AS (SELECT source, token, CASE {_CASE} END AS other, ('0x' || substr(md5(doc_id || ':' || sent_no || ':' || tok_no), 1, 7))::BIGINT / 268435456.0 AS u FROM tok), r(rate) AS (VALUES {', '.join(f'({r})' for r in RATES)}), x AS (SELECT source, rate::DOUBLE AS rate, CASE WHEN other IS NOT NULL AND u < rate THEN other ELSE token END AS token FROM n, r), c AS (SELECT source, rate, {', '.join(f'''count(*) FILTER (token = '{f}') * 1000.0 / count(*) AS "{f}"''' for f in FORMS)} FROM x GROUP BY 1, 2), l AS (SELECT source, rate, cast(regexp_extract(source, '[0-9]+') AS DOUBLE) AS y, unnest([{', '.join(repr(f) for f in FORMS)}]) AS feature, unnest([{', '.join(f'''"{f}"''' for f in FORMS)}]) AS value FROM c), k AS (SELECT feature, regr_slope(value, y) AS b, regr_intercept(value, y) AS a FROM l WHERE rate = 0 GROUP BY 1) SELECT source, rate, round(avg(value), 6) AS mean_rate, round(avg((value - a) / b), 2) AS implied FROM l JOIN k USING (feature) WHERE abs(b) > 1e-6 GROUP BY 1, 2")
def vl22_substitution(spark, d):
    """Each source's texts with a share of some words replaced, its rates taken again, and the date that lines fitted to the texts as they are imply."""
    toks = T.tokens(table(spark, d, "documents"), "doc_id", "source")
    parts = []
    for rate in RATES:
        own = I.substituted(toks, CHANGES, rate, ["doc_id", "sent_no", "tok_no"])
        parts.append(own.groupBy("source").agg(F.count("*").alias("n"), *[F.count_if(F.col("token") == f).alias(f"f_{f}") for f in FORMS]).withColumn("rate", F.lit(rate)))
    wide = parts[0]
    for p in parts[1:]:
        wide = wide.unionByName(p)
    lists = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(f"f_{f}") * 1000.0 / F.col("n")).alias("value")) for f in FORMS]))
    long = wide.select("source", "rate", unit_year().alias("y"), lists.alias("x")).select("source", "rate", "y", "x.*")
    line = long.where("rate = 0").groupBy("feature").agg(F.regr_slope("value", "y").alias("b"), F.regr_intercept("value", "y").alias("a")).where("abs(b) > 1e-6")
    met = long.join(F.broadcast(line), "feature")  # a row for each form
    return met.groupBy("source", "rate").agg(r6(F.avg("value"), "mean_rate"), F.round(F.avg((F.col("value") - F.col("a")) / F.col("b")), 2).alias("implied"))


@query("SELECT status, count(*) AS n FROM (SELECT doc_id, CASE WHEN quality IS NULL THEN 'open' ELSE 'done' END AS status FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1")
def snk8_guarded_resume(spark, d):
    """Draws that are done under the digest of their inputs, and those that are still open."""
    from ..sources import tables as R

    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    path = R.guarded_draws(spark, R.shared_path(spark, "draws"), [docs], "seed 1")
    R.save_draws(docs.join(labels, "doc_id", "left_semi"), path)
    done = spark.read.parquet(path)
    both = done.select("doc_id", F.lit("done").alias("status")).unionByName(R.missing_draws(docs, done, "doc_id").select("doc_id", F.lit("open").alias("status")))
    return both.groupBy("status").agg(F.count("*").alias("n"))


@query("WITH RECURSIVE s0 AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.;\\n]+'), lambda s: trim(s, ' ')), lambda s: s <> '') AS ss FROM documents), sx AS (SELECT doc_id, generate_subscripts(ss, 1) AS k, regexp_matches(unnest(ss), '(?i)(?:^|[^\\p{L}\\p{N}_])(?:said|dit|sagt|dice|der|la|the)(?:[^\\p{L}\\p{N}_]|$)') AS hit FROM s0), a(after) AS (VALUES (1), (2)), w(doc_id, after, k, skip, kept) AS (SELECT doc_id, after, k, CASE WHEN hit THEN after ELSE 0 END, (NOT hit)::INT FROM sx, a WHERE k = 1 UNION ALL SELECT sx.doc_id, w.after, sx.k, CASE WHEN w.skip > 0 THEN w.skip - 1 WHEN hit THEN w.after ELSE 0 END, (w.skip = 0 AND NOT hit)::INT FROM w JOIN sx ON sx.doc_id = w.doc_id AND sx.k = w.k + 1) SELECT doc_id, count(*) FILTER (after = 1) AS n_sents, sum(kept) FILTER (after = 1)::BIGINT AS n_basic, sum(kept) FILTER (after = 2)::BIGINT AS n_heavy, round(1 - sum(kept) FILTER (after = 2) / count(*) FILTER (after = 2), 6) AS dropped_heavy FROM w GROUP BY 1")
def sc8_quote_forms(spark, d):
    """Sentences left by the basic form (one sentence goes with each that attributes speech) and the heavy one (two go), and the share that the heavy one drops."""
    verbs = r"(?i)(?:^|[^\p{L}\p{N}_])(?:said|dit|sagt|dice|der|la|the)(?:[^\p{L}\p{N}_]|$)"
    docs = table(spark, d, "documents").select("doc_id", T.sentence_array(F.col("text")).alias("ss")).where(F.size("ss") > 0)
    n, kept = F.size("ss").cast("long"), lambda after: F.size(T.drop_quotes(F.col("ss"), verbs, after)).cast("long")
    return docs.select("doc_id", n.alias("n_sents"), kept(1).alias("n_basic"), kept(2).alias("n_heavy"), r6(1 - kept(2) / n, "dropped_heavy"))



@query("WITH t AS (SELECT l_orderkey % 500 AS unit, l_orderkey AS s, l_linenumber AS o, l_returnflag AS flag, l_returnflag || '/' || l_linestatus AS agr, least(l_quantity::BIGINT // 10, 4)::VARCHAR AS size FROM lineitem), p AS (SELECT unit, flag || '|' || lead(flag) OVER (PARTITION BY unit, s ORDER BY o, flag, agr, size) AS item FROM t), i AS (SELECT unit, 'flag' AS family, flag AS item FROM t UNION ALL SELECT unit, 'agr', agr FROM t UNION ALL SELECT unit, 'size', size FROM t UNION ALL SELECT unit, 'flag_bi', item FROM p WHERE item IS NOT NULL), c AS (SELECT unit, family, item, count(*) AS n FROM i GROUP BY ALL), v AS (SELECT family, item, row_number() OVER (PARTITION BY family ORDER BY sum(n) DESC, item) AS k FROM c GROUP BY 1, 2), z AS (SELECT unit, count(*) AS size FROM t GROUP BY 1), l(family, top) AS (VALUES ('flag', 3), ('agr', 2), ('size', 4), ('flag_bi', 5)) SELECT unit, family, item, n, round(n * 1000.0 / size, 6) AS rate FROM c JOIN v USING (family, item) JOIN l ON l.family = v.family AND k <= top JOIN z USING (unit)")
def fx3_fx4_annotated_rates(spark, d):
    """Families over annotated tokens: single tags, agreement of two, bins, and neighbours of a sentence; an order's lines stand for a sentence."""
    li = table(spark, d, "lineitem").withColumn("unit", F.col("l_orderkey") % 500)
    size = F.least(F.floor(F.col("l_quantity").cast("long") / 10), F.lit(4))
    single = {"flag": F.col("l_returnflag"), "agr": F.concat_ws("/", "l_returnflag", "l_linestatus"), "size": size}
    return I.annotated_rates(li, "unit", "l_orderkey", "l_linenumber", single, {"flag_bi": F.col("l_returnflag")}, {"flag": 3, "agr": 2, "size": 4, "flag_bi": 5}).select("unit", "family", "item", "n", r6("rate", "rate"))


@query("WITH c AS (SELECT l_orderkey % 500 AS unit, l_orderkey, max(l_linenumber) FILTER (l_returnflag = 'A') AS s, max(l_linenumber) FILTER (l_returnflag = 'N') AS v, max(l_linenumber) FILTER (l_returnflag = 'R') AS o FROM lineitem GROUP BY 1, 2) SELECT unit, round(avg((s < v)::INT), 6) AS sv, round(avg((o < v)::INT), 6) AS ov, round(avg((s IS NULL)::INT) FILTER (v IS NOT NULL), 6) AS null_subject FROM c GROUP BY 1")
def fx5_clause_order(spark, d):
    li = table(spark, d, "lineitem").withColumn("unit", F.col("l_orderkey") % 500)
    return I.clause_order(li, "unit", "l_orderkey", "l_returnflag", "l_linenumber", "A", "N", "R").select("unit", r6("sv", "sv"), r6("ov", "ov"), r6("null_subject", "null_subject"))


@query()
def vl16_bootstrap_forms(spark, d):
    """Deviations over draws of a stratum's mean, weighted mean and median, and of the difference of two strata's medians."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars").where("lang IS NOT NULL")
    forms = [I.bootstrap(docs, ["lang"], "n_chars", 50, ["doc_id"], s, w).withColumn("form", F.lit(n)) for n, s, w in (("mean", "mean", None), ("weighted", "mean", "n_chars"), ("median", "median", None))]
    both = forms[0].unionByName(forms[1]).unionByName(forms[2])
    gap = forms[2].groupBy("draw").agg((F.max(F.when(F.col("lang") == "en", F.col("value"))) - F.max(F.when(F.col("lang") == "de", F.col("value")))).alias("value"))
    both = both.unionByName(gap.select(F.lit("en-de").alias("lang"), "draw", "value", F.lit("median gap").alias("form")))
    return both.groupBy("form", "lang").agg(F.count("value").alias("draws"), r6(F.avg("value"), "mean"), r6(F.stddev_samp("value"), "sd"))


@query()
def vl19_anchor_shifts(spark, d):
    moves = {"none": {}, "all later": {str(g): 1.0 for g in range(10)}, "odd later": {str(g): 1.0 for g in range(1, 10, 2)}, "first earlier": {"0": -2.0}}
    return I.anchor_shifts(_vectors(spark, d), "g", "embedding", "y", 1.0, moves).select("scenario", "grp", r6("truth", "truth"), r6("pred", "pred"))


@query()
def vl23_random_subsets(spark, d):
    return I.random_subsets(_vectors(spark, d), "g", "embedding", "y", 1.0, 16, 50).select("draw", r6("mae", "mae"), r6("rho", "rho"))


@query("WITH r AS (SELECT doc_id, lang, n_chars - 1500.0 AS res, 1500.0 AS pred FROM documents), m AS (SELECT lang, avg(res) AS off FROM r GROUP BY 1), e AS (SELECT round(res - off, 4) AS e FROM r JOIN m USING (lang)), c AS (SELECT lang, round(2000 - (1500.0 + off), 4) AS cut FROM m) SELECT lang, cut, round(avg((e > cut)::INT), 6) AS p_beyond FROM c, e GROUP BY 1, 2")
def vl28_rescored(spark, d):
    """Predictions moved by their stratum's mean residual, and the share of adjusted residuals that take them beyond a cut: strata meet a count of distinct residuals, not rows."""
    r = table(spark, d, "documents").select("lang", (F.col("n_chars") - 1500.0).alias("res"))
    off = r.groupBy("lang").agg(F.avg("res").alias("off"), F.count("*").alias("n"))
    e = X.join_statistics(r, off.select("lang", "off"), ["lang"]).select(F.round(F.col("res") - F.col("off"), 4).alias("e"))
    ran = X.running_counts(e, [], "e")
    cuts = off.select("lang", F.round(2000 - (1500.0 + F.col("off")), 4).alias("cut"))
    n = e.count()
    # the count of residuals at or below each cut: the last running count there
    below = cuts.join(ran, F.col("e") <= F.col("cut"), "left").groupBy("lang", "cut").agg(F.coalesce(F.max(F.col("_before") + F.col("_n")), F.lit(0)).alias("k"))
    return below.select("lang", "cut", r6(1 - F.col("k") / F.lit(n), "p_beyond"))


@query()
def vl13_false_discovery(spark, d):
    """Features that a screen keeps, those that it keeps when groups' labels are dealt anew, and the share of false ones that this suggests."""
    g = dims(spark, d).groupBy("feature", "grp").agg(F.avg("value").alias("value"))
    y = spark.range(10).select(F.col("id").alias("grp"), F.col("id").cast("double").alias("y"))
    deals = y.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(99))))
    w = Window.partitionBy("draw").orderBy(F.xxhash64("draw", "grp"), "grp")
    deals = deals.withColumn("y", (F.row_number().over(w) - 1).cast("double")).select("grp", "draw", "y").unionByName(y.select("grp", F.lit(-1).alias("draw"), "y"))
    s = X.spearman(g.join(F.broadcast(deals), "grp"), ["draw", "feature"], "value", "y")  # 101 rows a group
    hit = F.abs("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho"))) > 2.306004  # two-sided 5 % of t with 8 degrees of freedom
    kept = s.groupBy("draw").agg(F.count_if(hit).alias("kept"))
    out = kept.agg(F.max(F.when(F.col("draw") == -1, F.col("kept"))).alias("kept"), F.avg(F.when(F.col("draw") >= 0, F.col("kept"))).alias("null_mean"))
    return out.select("kept", r6("null_mean", "null_mean"), r6(F.least(F.try_divide(F.col("null_mean"), F.col("kept")), F.lit(1.0)), "fdp"))
