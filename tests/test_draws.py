"""Files read back, Monte Carlo bands and nested probabilities against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stylometra.operators import draws
from stylometra.sources import tables


def test_csv_keeps_doubles_nulls_and_names(spark, tmp_path):
    df = spark.createDataFrame([(1, 1 / 3, "a,b"), (2, None, None), (3, 1e-300, 'q"')], "k int, `x y` double, s string")
    tables.write_csv(df, f"file://{tmp_path}/c", 12)
    got = {r[0]: r for r in tables.read_csv(spark, f"file://{tmp_path}/c", "k int, `x y` double, s string").collect()}
    assert got[1][1] == pytest.approx(1 / 3, rel=1e-11) and got[1][2] == "a,b" and got[2][1] is None and got[3][1] == pytest.approx(1e-300)


def test_missing_text_is_empty_and_missing_file_raises(spark, tmp_path):
    assert tables.sentences(spark, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(FileNotFoundError):
        tables.resolve(spark, "x", [f"file://{tmp_path}"])


def test_matrix_is_exact(spark, tmp_path):
    rows = [(1, [0.1, -2.5e-17]), (2, [float(2**60), 3.0])]
    tables.save_matrix(spark.createDataFrame(rows, "r long, v array<double>"), "r", "v", f"file://{tmp_path}/m")
    assert sorted((r.row, list(r.vector)) for r in tables.load_matrix(spark, f"file://{tmp_path}/m").collect()) == rows


def test_noise_is_spread_and_repeats(spark):
    df = spark.range(20000).select(draws.normal(F.col("id"), F.lit(3)).alias("z"), draws.uniform(F.col("id"), F.lit(3)).alias("u"))
    a = np.array(df.collect())
    assert abs(a[:, 0].mean()) < 0.03 and abs(a[:, 0].std() - 1) < 0.03 and abs(a[:, 1].mean() - 0.5) < 0.01
    assert sorted(a[:, 0]) == sorted(r[0] for r in df.repartition(3).collect())


def test_nested_probability(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=9)
    y = 3 * x + rng.normal(size=9)
    got = {r.k: r for r in draws.nested_probability(spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k int, x double, y double"), "k", "x", "y", 0.5).collect()}
    for i in range(9):
        rest = [j for j in range(9) if j != i]
        pred = np.polyval(np.polyfit(x[rest], y[rest], 1), x[i])
        res = []
        for j in rest:
            inner = [m for m in rest if m != j]
            res.append(y[j] - np.polyval(np.polyfit(x[inner], y[inner], 1), x[j]))
        assert got[i].pred == pytest.approx(pred) and got[i].prob == pytest.approx(np.mean(pred + np.array(res) < 0.5))


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "k int, d double, sd double, v double")
    assert draws.perturbed_windows(e, "k", "d", "sd", "v", 10, 5, 4).count() == 0
    assert draws.nested_probability(e, "k", "d", "v", 0.0).count() == 0
