"""Queries over file formats and their round trips, Monte Carlo bands, nested calibration and library models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import draws as D
from ..operators import matrix as A
from ..operators import models as M
from ..operators import text as T
from ..operators.skipgrams import skip_grams
from ..sources import tables as R
from ..sources.tables import table
from .registry import TOK, query, r6


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def src1_snk1_csv(spark, d):
    path = R.shared_path(spark, "csv")
    R.write_csv(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.col("s_acctbal").cast("double").alias("s_acctbal")), path, 12)
    return R.read_csv(spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


@query("SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_regionkey = 0 THEN 'holdouts' ELSE 'training' END AS grp, n_regionkey = 0 AS is_holdout FROM nation")
def src2_src3_manifest(spark, d):
    # one JSON object of two arrays: a dimension table
    m = F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    one = table(spark, d, "nation").coalesce(1).agg(F.collect_list(F.when(F.col("n_regionkey") != 0, m)).alias("training"), F.collect_list(F.when(F.col("n_regionkey") == 0, m)).alias("holdouts"))
    path = R.shared_path(spark, "manifest")
    one.select(F.to_json(F.struct("training", "holdouts")).alias("value")).write.text(path)
    return R.manifest(spark, path, {"training": False, "holdouts": True}).select("k", "name", "grp", "is_holdout")


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def src4_projected_scan(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), w AS (SELECT list_filter(regexp_split_to_array(line, '[ \\t\\r\\f\\x0B]+'), lambda x: x <> '') AS ws FROM l) SELECT len(ws)::BIGINT AS n_words, count(*) AS n FROM w WHERE len(ws) > 0 GROUP BY 1")
def src5_token_text(spark, d):
    path = R.shared_path(spark, "texts")
    table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("value")).write.option("lineSep", "\n").text(path)
    return R.sentences(spark, path).groupBy(F.size("words").cast("long").alias("n_words")).agg(F.count("*").alias("n"))


@query("SELECT vec_id AS row, round(list_sum(embedding)::DOUBLE, 4) AS total, len(embedding)::BIGINT AS size FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM embeddings)")
def src13_matrix_file(spark, d):
    path = R.shared_path(spark, "matrix")
    R.save_matrix(table(spark, d, "embeddings"), "vec_id", "embedding", path)
    m = R.load_matrix(spark, path)
    return m.select("row", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("vector").cast("long").alias("size"))


@query("SELECT r_regionkey, r_name FROM region")
def src15_path_resolver(spark, d):
    return spark.read.parquet(R.resolve(spark, "region.parquet", [f"{d}/none", d], "STYLOMETRA_DATA")).select("r_regionkey", "r_name")


@query("SELECT n_regionkey AS region, count(*) AS n, min(n_name) AS least FROM (SELECT * FROM nation UNION ALL SELECT * FROM nation) GROUP BY 1")
def snk3_append_json(spark, d):
    path, rows = R.shared_path(spark, "lines"), table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    for _ in range(2):
        R.append_json_lines(rows, path)
    return spark.read.schema(rows.schema).json(path).groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"), F.min("n_name").alias("least"))


@query("SELECT n_nationkey AS k, n_name AS value, n_regionkey AS region FROM nation")
def snk4_entries(spark, d):
    path, rows = R.shared_path(spark, "entries"), table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name", F.col("n_regionkey").alias("region"))
    R.write_entries(rows, "k", "n_name", path)
    texts = spark.read.text(f"{path}/texts").select(F.col("k").cast("long").alias("k"), "value")
    return texts.join(spark.read.schema(rows.drop("n_name").schema).json(f"{path}/meta"), "k")


@query("SELECT o_orderkey % 100 AS unit, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber BETWEEN 1 + o_orderkey % 3 AND 3 + o_orderkey % 3 GROUP BY 1")
def jn9_verse_clip(spark, d):
    ranges = table(spark, d, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 3).alias("lo"), (3 + F.col("o_orderkey") % 3).alias("hi"))
    words = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    inside = D.clip(words, ranges, ["o_orderkey"], "l_linenumber", "lo", "hi")
    return inside.groupBy((F.col("o_orderkey") % 100).alias("unit")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


#: Noise that SQL can repeat; the operators' own noise is by hash.
def _cycle(row, draw):
    return ((row * 7919 + draw * 104729) % 1000) / 1000.0


CYCLE = "(({row} * 7919 + draw * 104729) % 1000) / 1000.0"
BANDS = "round(quantile_cont(m, 0.16), 6) AS p16, round(quantile_cont(m, 0.5), 6) AS p50, round(quantile_cont(m, 0.84), 6) AS p84"


def _bands(df, *by):
    return df.select(*by, *[r6(p, p) for p in ("p16", "p50", "p84")])


@query(f"WITH m AS (SELECT draw, p_size + 3 * {CYCLE.format(row='p_partkey')} AS date, p_retailprice::DOUBLE AS v FROM part, range(20) r(draw)), c AS (SELECT range AS centre FROM range(-20, 80, 5)), w AS (SELECT centre, draw, avg(v) AS m FROM m JOIN c ON date BETWEEN centre - 5 AND centre + 5 GROUP BY 1, 2) SELECT centre, {BANDS} FROM w GROUP BY 1")
def wn8_perturbed_windows(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", F.lit(3.0).alias("sd"), F.col("p_retailprice").cast("double").alias("v"))
    return _bands(D.perturbed_windows(p, "p_partkey", "p_size", "sd", "v", 10, 5, 20, _cycle), F.col("centre").cast("long").alias("centre"))


@query(f"WITH k AS (SELECT lang, draw, avg(n_chars) AS m FROM documents LEFT JOIN labels USING (doc_id), range(20) r(draw) WHERE {CYCLE.format(row='doc_id')} >= CASE WHEN quality IS NULL THEN 0.25 WHEN quality = 0 THEN 0.75 ELSE 0 END GROUP BY 1, 2) SELECT lang, {BANDS} FROM k GROUP BY 1")
def vl25_removal_draws(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    chance = F.when(F.col("quality").isNull(), 0.25).when(F.col("quality") == 0, 0.75).otherwise(0.0)
    return _bands(D.removed_by_tier(j.withColumn("chance", chance), ["lang"], "doc_id", "chance", "n_chars", 20, _cycle), "lang")


@query(f"WITH p AS (SELECT s_suppkey AS k, s_acctbal::DOUBLE AS x, s_nationkey * 10.0 AS t, 1.0 + s_suppkey % 4 AS sd FROM supplier), s AS (SELECT draw, sum(w) AS n, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * x * y) AS xy FROM (SELECT draw, 1 / (sd * sd) AS w, x, t + sd * {CYCLE.format(row='k')} AS y FROM p, range(20) r(draw)) GROUP BY draw), l AS (SELECT draw, (n * xy - x * y) / (n * xx - x * x) AS b, (y - (n * xy - x * y) / (n * xx - x * x) * x) / n AS a FROM s), c AS (SELECT c_custkey, a + b * c_acctbal::DOUBLE AS m FROM customer, l) SELECT c_custkey, {BANDS} FROM c GROUP BY 1")
def vl7_weighted_calibration(spark, d):
    p = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").cast("double").alias("x"), (F.col("s_nationkey") * 10.0).alias("t"), (1.0 + F.col("s_suppkey") % 4).alias("sd"))
    lines = D.calibration_lines(p, "s_suppkey", "t", "sd", "x", 20, _cycle)
    return _bands(D.calibrate(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("x")), ["c_custkey"], "x", lines), "c_custkey")


@query("WITH g AS (SELECT p_brand AS k, avg(p_size) AS x, avg(p_retailprice) AS y FROM part GROUP BY 1), pr AS (SELECT i.k, i.x, j.y - (SELECT regr_intercept(o.y, o.x) + regr_slope(o.y, o.x) * j.x FROM g o WHERE o.k <> i.k AND o.k <> j.k) AS r, (SELECT regr_intercept(o.y, o.x) + regr_slope(o.y, o.x) * i.x FROM g o WHERE o.k <> i.k) AS pred FROM g i JOIN g j ON i.k <> j.k) SELECT k, round(any_value(pred), 4) AS pred, count(*) AS n, round(avg((pred + r < 1400)::INT), 6) AS prob FROM pr GROUP BY k")
def vl26_nested_probability(spark, d):
    g = table(spark, d, "part").groupBy(F.col("p_brand").alias("k")).agg(F.avg("p_size").alias("x"), F.avg(F.col("p_retailprice").cast("double")).alias("y"))
    return D.nested_probability(g, "k", "x", "y", 1400.0).select("k", F.round("pred", 4).alias("pred"), "n", r6("prob", "prob"))


GRID = [k * 0.25 for k in range(-8, 48)]


def _placed(df, variant):
    return df.select(F.lit(variant).alias("variant"), "grp", "y", r6("point", "point"), r6("sd", "sd"))


@query()
def md9_md10_md13_mvn_variants(spark, d):
    # MD9: predictive variance; MD10: one model for each register (here the parity of vec_id); MD13: inflated covariance and both
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("g"), "embedding", F.col("label").cast("double").alias("y"))
    fit = lambda rows, **o: A.mvn_posterior(rows, "g", "embedding", "y", GRID, 0.1, **o)
    parts = [("predictive", fit(e, predictive=True)), ("inflated", fit(e, inflate=2.0)), ("both", fit(e, predictive=True, inflate=2.0))]
    parts += [(f"register {r}", fit(e.where(F.col("vec_id") % 2 == r), predictive=True)) for r in (0, 1)]
    out = _placed(parts[0][1], parts[0][0])
    for name, df in parts[1:]:
        out = out.unionByName(_placed(df, name))
    return out


@query()
def md22_forest(spark, d):
    """Class shares of each row by the forest of the folds that it is not in (five stratified folds), with balanced weights."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = table(spark, d, "embeddings")
    e = M.dealt(M.stratified_folds(rows, "vec_id", "label", 5), rows.count()).select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), (F.col("label") >= 5).cast("double").alias("label"), "fold").cache()
    out = None
    for k in range(5):
        train = e.where(F.col("fold") != k)
        weight = train.groupBy("label").agg((F.lit(1.0) / F.count("*")).alias("w"))
        forest = RandomForestClassifier(numTrees=500, featureSubsetStrategy="sqrt", weightCol="w", seed=1).fit(train.join(F.broadcast(weight), "label"))
        part = forest.transform(e.where(F.col("fold") == k)).select("vec_id", F.col("label").cast("int").alias("truth"), r6(vector_to_array("probability")[1], "prob"))
        out = part if out is None else out.unionByName(part)
    return out


#: Words that one task trains on.
WORDS_OF_A_PART = 1_000_000
#: Different words whose vectors Spark's own model may hold on the driver, and their numbers.
DRIVER_WORDS, DRIVER_NUMBERS = 100_000, 10_000_000


def word_vectors(toks, size: int = 1000, window: int = 15, min_count: int = 1, epochs: int = 100):
    """(word, size, norm, vector) by skip-gram over toks (words); the defaults are the reference's. Tasks train on about WORDS_OF_A_PART words each, and what they learn is averaged after each epoch.

    Spark's model holds all words on the driver; it is for up to DRIVER_WORDS different ones, and vocabularies above that never meet in one place.
    """
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    total = toks.select(F.explode("words").alias("word")).agg(F.count("*").alias("n"), F.approx_count_distinct("word").alias("words")).head()
    parts = max(1, round(total["n"] / WORDS_OF_A_PART))
    if total["words"] <= min(DRIVER_WORDS, DRIVER_NUMBERS // size):
        v = Word2Vec(numPartitions=parts, vectorSize=size, windowSize=window, minCount=min_count, maxIter=epochs, seed=1, inputCol="words", outputCol="v").fit(toks).getVectors().select("word", vector_to_array("vector").alias("v"))
    else:
        tasks = toks.coalesce(max(parts, toks.sparkSession.sparkContext.defaultParallelism))  # no more parts than their size asks for
        v = skip_grams(tasks, size, window, min_count, epochs, WORDS_OF_A_PART).select("word", F.col("v").cast("array<double>").alias("v"))
    return v.select("word", F.size("v").cast("long").alias("size"), r6(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), "norm"), F.col("v").alias("vector"))


@query()
def md23_word_vectors(spark, d):
    """Skip-gram vectors of all words, in fewer dimensions and epochs than the reference's (README.md has the figures)."""
    toks = T.sentences(table(spark, d, "documents")).select(F.split(F.lower("sentence"), r"\s+").alias("words"))
    return word_vectors(toks, size=8, epochs=1)


@query("WITH " + TOK + ", g AS (SELECT token AS a, lead(token) OVER (PARTITION BY doc_id, sent_no ORDER BY tok_no) AS b FROM tok), c AS (SELECT token, count(*) AS n FROM tok GROUP BY 1), p AS (SELECT a, b, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY 1, 2) SELECT a, b, p.n AS n, round((p.n - 5) * (SELECT count(*) FROM c)::DOUBLE / (ca.n::DOUBLE * cb.n), 6) AS score FROM p JOIN c ca ON ca.token = a JOIN c cb ON cb.token = b WHERE p.n >= 5 AND (p.n - 5) * (SELECT count(*) FROM c)::DOUBLE / (ca.n::DOUBLE * cb.n) > 10")
def md23_phrases(spark, d):
    """Pairs of adjacent words whose score (n - 5) x vocabulary / (n_a x n_b) is above 10."""
    docs = table(spark, d, "documents")
    c = T.token_counts(docs)
    pairs = T.ngram_counts(docs, 2).where("n >= 5").select(F.split("gram", " ")[0].alias("a"), F.split("gram", " ")[1].alias("b"), "n")
    j = pairs.join(c.select(F.col("token").alias("a"), F.col("n").alias("na")), "a").join(c.select(F.col("token").alias("b"), F.col("n").alias("nb")), "b")
    s = j.crossJoin(F.broadcast(c.agg(F.count("*").alias("v")))).withColumn("s", (F.col("n") - 5) * F.col("v").cast("double") / (F.col("na").cast("double") * F.col("nb")))
    return s.where("s > 10").select("a", "b", "n", r6("s", "score"))
