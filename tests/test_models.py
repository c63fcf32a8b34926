"""Matrix models and grouped statistics against plain numpy versions and hand-made tables."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stylometra.operators import features, groups, linguistic, matrix, models, validate

rng = np.random.default_rng(3)
X = rng.normal(size=(40, 3))
Y = X @ [2.0, -1.0, 0.0] + rng.normal(size=40) * 0.1 + 5
GROUP = np.arange(40) % 4


@pytest.fixture(scope="module")
def rows(spark):
    data = [(str(g), x.tolist(), float(y)) for g, x, y in zip(GROUP, X, Y)]
    return spark.createDataFrame([*data, ("0", None, 1.0), ("1", [0.0] * 3, None)], "g string, v array<double>, y double")


def refit(train, lam):
    m, sd = X[train].mean(0), X[train].std(0)
    z = (X[train] - m) / sd
    b = np.linalg.solve(z.T @ z + lam * np.eye(3), z.T @ (Y[train] - Y[train].mean())) / sd
    return lambda x: Y[train].mean() + (x - m) @ b


def test_subtracted_grams_equal_a_refit(rows):
    grams = matrix.group_grams(rows, "g", "v", "y")
    for g in range(4):
        rest = sum(v for h, v in grams.items() if h != str(g))
        for lam, beta in zip((0.5, 20.0), matrix.ridge(rest, [0.5, 20.0])):
            own = refit(GROUP != g, lam)(X[GROUP == g])
            assert np.allclose(beta[0] + X[GROUP == g] @ beta[1:], own)
            assert matrix.squared_error(grams[str(g)], beta) == pytest.approx(((own - Y[GROUP == g]) ** 2).sum())


def test_nested_choice_equals_brute_force(rows):
    lams = [0.1, 5.0, 200.0]
    for r in matrix.nested_ridge(rows, "g", "v", "y", lams).collect():
        g, cost = int(r["grp"]), []
        for lam in lams:
            cost.append(sum(((refit((GROUP != g) & (GROUP != h), lam)(X[GROUP == h]) - Y[GROUP == h]) ** 2).sum() for h in range(4) if h != g))
        assert r["lam"] == lams[int(np.argmin(cost))] and r["n"] == 10


def test_pls_with_all_parts_is_least_squares(rows):
    total = sum(matrix.group_grams(rows, "g", "v", "y").values())
    want = np.linalg.lstsq(np.column_stack([np.ones(40), X]), Y, rcond=None)[0]
    assert np.allclose(matrix.pls(total, 3), want)


def test_logistic_has_no_gradient_left(spark):
    t = (Y > 5).astype(int)
    d = spark.createDataFrame([(x.tolist(), int(k)) for x, k in zip(X, t)], "v array<double>, t int")
    b = matrix.logistic(d, "v", "t", 1.0, 30)
    p = 1 / (1 + np.exp(-(b[0] + X @ b[1:])))
    assert np.abs(X.T @ (p - t) + b[1:]).max() < 1e-5


def test_topics_sum_to_one_and_split_blocks(spark):
    d = spark.createDataFrame([(r, f"{'a' if r < 5 else 'b'}{c}", 3.0) for r in range(10) for c in range(4)], "r int, c string, n double")
    w = {}
    for x in matrix.topic_factors(d, "r", "c", "n", 2, 40).collect():
        w.setdefault(x["r"], {})[x["topic"]] = x["weight"]
    assert all(sum(v.values()) == pytest.approx(1) for v in w.values())
    assert max(w[0], key=w[0].get) != max(w[9], key=w[9].get)


def test_empty_tables_have_no_fits(rows):
    e = rows.where("false")
    assert matrix.nested_ridge(e, "g", "v", "y", [1.0]).count() == matrix.pls_leave_group_out(e, "g", "v", "y", 2).count() == 0
    assert matrix.principal_parts(e, "g", "v", "y", 2).count() == matrix.mvn_posterior(e, "g", "v", "y", [0.0]).count() == 0


def test_prefix_counts_over_blocks(spark):
    hits = [int(h) for h in rng.integers(0, 2, 50)]
    d = spark.createDataFrame([(i * 3, bool(h)) for i, h in enumerate(hits)], "k long, hit boolean")
    out = [r["p"] for r in validate.prefix_p(d, "k", "hit", block=7).orderBy("k").collect()]
    assert np.allclose(out, [(sum(hits[: i + 1]) + 1) / (i + 2) for i in range(50)])


def test_global_rank_has_no_gaps(spark):
    v = [float(x) for x in rng.integers(0, 9, 200)]
    d = spark.createDataFrame(list(enumerate(v)), "k long, p double")
    out = {r["k"]: r["rank"] for r in features.global_rank(d, "p", "k", 8).collect()}
    assert [k for k, _ in sorted(out.items(), key=lambda x: x[1])] == [k for k, _ in sorted(enumerate(v), key=lambda x: (x[1], x[0]))] and sorted(out.values()) == list(range(1, 201))
    assert features.step_up(d.where("false").select(F.col("k").alias("feature"), "p")).count() == 0


def test_percentile_of_outside_and_between(spark):
    ref = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,)], "x double")
    at = spark.createDataFrame([(0, 0.0), (1, 1.5), (2, 2.0), (3, 9.0)], "k int, a double")
    assert {r["k"]: r["ecdf"] for r in groups.percentile_of(ref, at, "x", "a").collect()} == {0: 0.0, 1: pytest.approx(1 / 3), 2: 1.0, 3: 1.0}


def test_upsert_keeps_the_greater(spark):
    old, new = (spark.createDataFrame(x, "k int, n int") for x in ([(1, 5), (2, 5), (3, 5)], [(2, 5), (3, 9), (4, 1)]))
    out = {r["k"]: (r["n"], r["side"]) for r in groups.upsert_if_greater(old, new, "k", "n").collect()}
    assert out == {1: (5, "old"), 2: (5, "old"), 3: (9, "new"), 4: (1, "new")}


def test_function_grams_skip_or_compact(spark):
    d = spark.createDataFrame([(0, i, t) for i, t in enumerate(["of", "cat", "the", "of"])], "s int, i int, token string")
    grams = lambda c: sorted(r["gram"] for r in linguistic.joined_grams(d, ["s"], ["i"], ["of", "the"], 2, c).collect())
    assert grams(False) == ["the·of"] and grams(True) == ["of·the", "the·of"]


def test_forest_scores_every_row(spark):
    from stylometra.plans import registry

    rows = registry.QUERIES["md22_forest"](spark, "/root/testdata/sf0.001").select("vec_id").collect()
    want = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id").collect()
    assert sorted(r.vec_id for r in rows) == sorted(r.vec_id for r in want)


def test_folds_of_one_label_leave_no_task_all_rows(spark):
    df = spark.range(4000).select(F.col("id").alias("k"), F.when(F.col("id") < 3900, 1).when(F.col("id") < 3990, 2).alias("g"))
    got = models.dealt(models.stratified_folds(df, "k", "g", 5), 4000)
    row = F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("k"), "k"))
    assert {(r.k, r.fold) for r in got.collect()} == {(r.k, r.fold) for r in df.select("k", F.pmod(row, F.lit(5)).alias("fold")).collect()}
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) < 1.2 * min(sizes)


def test_even_parts_fill_all_cores_in_every_round(spark):
    cores = spark.sparkContext.defaultParallelism
    for rows, rounds in ((0, 1), (models.ROWS_OF_A_PART * cores, 1), (models.ROWS_OF_A_PART * cores + 1, 2)):
        assert models.dealt(spark.range(100), rows).rdd.getNumPartitions() == rounds * cores


def test_forest_passes_rows_in_a_part_for_each_core(spark):
    from stylometra.plans import registry

    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        out = registry.QUERIES["md22_forest"](spark, "/root/testdata/sf0.001")
        assert out.rdd.getNumPartitions() == 5 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_word_vectors_of_words_seen_once(spark):
    from stylometra.plans import sampling

    toks = spark.createDataFrame([(["a", "b", "once"],), (["a", "b"],)], "words array<string>")
    got = {r.word: r for r in sampling.word_vectors(toks, size=8, epochs=1).collect()}
    assert set(got) == {"a", "b", "once"} and all(len(r.vector) == 8 for r in got.values())


def test_logistic_without_each_unit_equals_full_refits(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (60, 4)) * [1, 10, 0.1, 1] + [0, 5, 1, 0]
    x[:, 3] = 2.0  # constant
    y = (x[:, 0] + x[:, 1] / 10 + rng.normal(0, 1, 60) > 0.5).astype(int)
    df = spark.createDataFrame([(k, [float(v) for v in x[k]], int(y[k])) for k in range(60)] + [(99, None, 1), (98, [0.0] * 4, None)], "k long, x array<double>, t int").repartition(3)
    got = {r.k: r for r in matrix.logistic_leave_one_out(df, "k", "x", "t", 2.0).collect()}
    assert sorted(got) == list(range(60))
    for i in range(60):
        a, b = np.delete(x, i, 0), np.delete(y, i)
        sd = np.where(a.std(0) > 1e-10, a.std(0), 1.0)
        z = np.column_stack([np.ones(59), (a - a.mean(0)) / sd])
        beta, ridge = np.zeros(5), np.array([0, 2.0, 2.0, 2.0, 2.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ beta))
            beta = beta - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - b) + ridge * beta)
        want = 1 / (1 + np.exp(-(beta[0] + (x[i] - a.mean(0)) / sd @ beta[1:])))
        assert got[i].score == pytest.approx(want, abs=1e-8) and got[i].target == y[i]
    alone = matrix.logistic_leave_one_out(spark.createDataFrame([(1, [1.0], 1), (2, [2.0], 0), (3, [3.0], 0)], "k long, x array<double>, t int"), "k", "x", "t").collect()
    assert {r.k: r.score is None for r in alone} == {1: True, 2: False, 3: False}


def test_principal_parts_of_vectors_with_nulls(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (80, 4))
    x[:, 1] += x[:, 0]
    rows = [[None if k % 9 == j else float(v) for j, v in enumerate(r)] for k, r in enumerate(x)]
    for k, r in enumerate(rows):
        r[3] = r[3] if k % 2 else float("nan")  # half unknown: goes
    df = spark.createDataFrame([("g", r, 1.0) for r in rows] + [("g", None, 1.0)], "g string, x array<double>, y double")
    table = np.array([[np.nan if v is None else v for v in r[:3]] for r in rows])
    full = np.where(np.isnan(table), np.nanmedian(table, axis=0), table)
    value, vector = np.linalg.eigh(np.corrcoef(full.T))
    got = matrix.principal_parts(df, "g", "x", "y", 2).orderBy("part").collect()
    assert [r.share for r in got] == pytest.approx([value[2] / 3, value[1] / 3])
    assert np.abs(got[0].loadings) == pytest.approx(np.abs(vector[:, 2]))


def test_leaving_out_many_units_does_not_pass_over_all_others(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.column_stack([np.ones(6000), rng.normal(0, 1, (6000, 3))])
    y = (rng.random(6000) < 1 / (1 + np.exp(-x @ [0.2, 0.5, -0.4, 0.1]))).astype(float)
    ridge = matrix._scaled_ridge(6000, x[:, 1:].sum(0), (x[:, 1:] ** 2).sum(0), 1.0)
    beta = matrix._logistic_steps(x, y, ridge, np.zeros(4))
    slope, taken = matrix._Slope(x, y, ridge, beta), 0
    for i in range(300):
        own = matrix._scaled_ridge(5999, x[:, 1:].sum(0) - x[i, 1:], (x[:, 1:] ** 2).sum(0) - x[i, 1:] ** 2, 1.0)
        p = 1 / (1 + np.exp(-x[i] @ beta))
        got = slope.without(x[i], y[i], own, beta, np.linalg.inv(slope.curve - p * (1 - p) * np.outer(x[i], x[i])))
        if got is not None:
            taken += 1
            assert x[i] @ got == pytest.approx(x[i] @ matrix._logistic_steps(np.delete(x, i, 0), np.delete(y, i), own, beta), abs=2e-10)
    assert taken > 250
    # a unit far from the others isn't left to the expansion
    far = x[0] * 300
    assert slope.without(far, float(far @ beta < 0), ridge, beta, np.linalg.inv(slope.curve)) is None


def test_cosine_neighbours_in_blocks(spark, monkeypatch):
    from stylometra.operators import models

    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (300, 6)).round(1)
    x[10], x[40:90] = 0, x[1]  # a zero vector, copies
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(900, None), (None, [1.0] * 6)], "id long, v array<double>")
    monkeypatch.setattr(models, "QUERY_BLOCK", 7)
    monkeypatch.setattr(models, "INDEX_BLOCK", 40)
    monkeypatch.setattr(models, "HELD_COSINES", 100)
    found = models.cosine_neighbours(df.where("id % 10 = 0").withColumnRenamed("id", "query"), df, 3)
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoopJoin" not in found._jdf.queryExecution().toString()
    unit = x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]
    want = {}
    for q in range(0, 300, 10):
        near = sorted((-round(float(unit[q] @ unit[i]), 9), i) for i in range(300) if i not in (q, 10))
        want |= {(q, n + 1): i for n, (_, i) in enumerate(near[:3])} if q != 10 else {}
    assert {(r["query"], r["rank"]): r["id"] for r in found.collect()} == want


def test_word_vectors_are_trained_in_parts(spark, monkeypatch):
    from pyspark.ml import feature

    from stylometra.plans import sampling

    asked, fit = [], feature.Word2Vec.fit
    monkeypatch.setattr(feature.Word2Vec, "fit", lambda self, df: asked.append(self.getNumPartitions()) or fit(self, df))
    toks = spark.createDataFrame([([f"w{k % 7}", "a", "b"],) for k in range(100)], "words array<string>")
    assert {r.word for r in sampling.word_vectors(toks, 3, 2, 1, 1).collect()} == {"a", "b", *(f"w{k}" for k in range(7))}
    monkeypatch.setattr(sampling, "WORDS_OF_A_PART", 60)
    assert all(r.size == 3 and r.norm > 0 for r in sampling.word_vectors(toks, 3, 2, 1, 1).collect())
    assert asked == [1, 5]


def test_cosine_knn_asks_for_every_row(spark, tmp_path):
    import duckdb

    from stylometra.operators import models
    from stylometra.plans import catalog, registry

    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (260, 5)).astype("float32")
    x[100:120] = x[3]
    spark.createDataFrame([(k + 1, [float(v) for v in r], 0) for k, r in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {tuple(r) for r in catalog.md24_cosine_knn(spark, str(tmp_path)).select("query", "id", "rank").collect()}
    assert {q for q, _, _ in got} == set(range(1, 261)) and len(got) == 780  # ids divisible by 50 alone before
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == set(con.sql(registry.ORACLE_SQL["md24_cosine_knn"]).fetchall())
    vectors = spark.read.parquet(f"{tmp_path}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS v")
    block = models._vector_blocks(vectors, "id", 1000, "t")[0].head()
    assert len(block.v) == 4 * 5 * len(block.ids)  # floats stay floats


def test_word_vectors_that_the_driver_does_not_hold(spark, monkeypatch):
    from pyspark.ml import feature

    from stylometra.plans import sampling

    rng = np.random.default_rng(4)
    words = {t: [f"{t}{k}" for k in range(10)] for t in "ab"}
    rows = [([str(w) for w in rng.choice(words["ab"[k % 2]], 12)],) for k in range(3000)] + [(["once", None, ""],), (None,), ([],)]
    toks = spark.createDataFrame(rows, "words array<string>").repartition(3)
    monkeypatch.setattr(feature.Word2Vec, "fit", lambda *a: pytest.fail("all words on the driver"))
    monkeypatch.setattr(sampling, "DRIVER_WORDS", 5)
    monkeypatch.setattr(sampling, "WORDS_OF_A_PART", 4000)
    for least, epochs in ((1, 1), (1, 3), (2, 3)):
        got = {r.word: r for r in sampling.word_vectors(toks, 8, 5, least, epochs).collect()}
        assert set(got) == {*words["a"], *words["b"], *(["once", ""] if least == 1 else [])}
        assert all(r.size == 8 and r.norm == pytest.approx(np.linalg.norm(r.vector), abs=1e-6) for r in got.values())
        unit = {w: np.array(r.vector) / r.norm for w, r in got.items()}
        same = np.mean([unit[x] @ unit[y] for t in "ab" for x in words[t] for y in words[t] if x < y])
        apart = np.mean([unit[x] @ unit[y] for x in words["a"] for y in words["b"]])
        assert same > apart + 0.3
