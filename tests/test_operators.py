import numpy as np
import pytest
from pyspark.sql import functions as F

from stylometra.functions import scalar, tails
from stylometra.operators import features, models, text, validate
from stylometra.sources import tables
from stylometra.streaming import windows


def test_chunks_join_a_last_runt(spark):
    row = spark.range(1).select(text.chunk_numbers(F.array(*map(F.lit, [300, 250, 100, 420, 30])), 500).alias("c")).head()
    assert row["c"] == [0, 0, 1, 1, 1]


def test_quotes(spark):
    s = F.array(*map(F.lit, ["a", "he said", "b", "c", "d", "e"]))
    row = spark.range(1).select(text.drop_quotes(s, "said", 1).alias("basic"), text.drop_quotes(s, "said", 2).alias("heavy")).head()
    assert row["basic"] == ["a", "c", "d", "e"] and row["heavy"] == ["a", "d", "e"]


def test_conformal_beyond_the_sample_is_infinite_or_clamped(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, -2, 3, -4, 5)], "r double")
    out = {round(r["level"], 2): r["half_width"] for r in validate.conformal(df, "r", [0.68, 0.9, 0.99]).collect()}
    assert out == {0.68: 5.0, 0.9: float("inf"), 0.99: float("inf")}
    assert validate.conformal(df, "r", [0.99], clamp=True).head()["half_width"] == 5.0


def test_spearman_has_mean_ranks_for_ties(spark):
    df = spark.createDataFrame([("f", 1.0, 1.0), ("f", 1.0, 2.0), ("f", 2.0, 2.0), ("f", 3.0, 5.0)], "g string, x double, y double")
    want = np.corrcoef([1.5, 1.5, 3, 4], [1, 2.5, 2.5, 4])[0, 1]
    assert features.spearman(df, ["g"], "x", "y").head()["rho"] == pytest.approx(want)


def test_ridge_by_subtraction_equals_refit(spark):
    rng = np.random.default_rng(3)
    x, y, g = rng.normal(size=(40, 3)), rng.normal(size=40), np.repeat(["a", "b", "c", "d"], 10)
    df = spark.createDataFrame([(str(a), [float(v) for v in b], float(c)) for a, b, c in zip(g, x, y)], "g string, v array<double>, y double")
    for r in models.ridge_leave_group_out(df, "g", "v", "y", [2.0]).collect():
        tr, te = g != r["grp"], g == r["grp"]
        A, B = np.column_stack([np.ones(tr.sum()), x[tr]]), np.column_stack([np.ones(te.sum()), x[te]])
        beta = np.linalg.solve(A.T @ A + np.diag([0, 2, 2, 2]), A.T @ y[tr])
        assert r["sse"] == pytest.approx(((y[te] - B @ beta) ** 2).sum(), rel=1e-6)


def test_tails(spark):
    assert tails.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.binomial_two_sided(2, 10) == pytest.approx(0.109375)
    out = spark.range(1).select(tails.normal_cdf(F.lit(1.959963985)).alias("p")).head()
    assert out["p"] == pytest.approx(0.975)


def test_strip_diacritics(spark):
    assert spark.range(1).select(scalar.strip_diacritics(F.lit("éàçñü ἄνθρωπος")).alias("t")).head()["t"] == "eacnu ανθρωπος"


def test_undefined_shares_are_null(spark):
    assert spark.range(1).select(scalar.share(F.lit(0.0), F.lit(0.0)).alias("s")).head()["s"] is None


def test_html_text():
    assert tables.html_text("<p>a<script>x</script>b</p><div>c") == "ab\nc"
    assert tables.html_text(None) is None


def test_permutation_keeps_labels_within_strata(spark):
    df = spark.createDataFrame([(i, i % 2, i * 10) for i in range(10)], "k int, s int, y int")
    out = validate.permuted(df, 3, "y", ["s"])
    assert all(r["y"] // 10 % 2 == r["s"] for r in out.collect())
    assert out.groupBy("draw").agg(F.countDistinct("y").alias("n")).where("n = 10").count() == 3


def test_streaming_windows_equal_batch(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    q = windows.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("w_counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) AS n FROM w_counts").head()["n"] == ev.count()
