"""Staged selection over sparse counts against dense loops."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stylometra.functions.tails import t_two_sided
from stylometra.operators import selection


def test_gram_counts(spark):
    rows = [("a", "abcab"), ("a", "ab"), ("a", ""), ("b", "ééé€€"), ("b", None), (None, "abc"), ("c", "x" * 50), ("b", "𝒳y𝒳y𝒳")]
    got = Counter({(r.u, r.item): r.n for r in selection.gram_counts(spark.createDataFrame(rows, "u string, t string").repartition(3), "u", "t", (2, 3)).collect()})
    assert got == Counter((u, t[i : i + n]) for u, t in rows if u and t for n in (2, 3) for i in range(len(t) - n + 1))


def test_p_values(spark):
    for n in (3, 4, 9, 20, 63):
        df = spark.createDataFrame([(r,) for r in (0.0, 0.2, -0.7, 0.95)], "r double")
        for r in df.select("r", selection.correlation_p(F.col("r"), n).alias("p")).collect():
            assert r.p == pytest.approx(t_two_sided(r.r * math.sqrt((n - 2) / (1 - r.r**2)), n - 2), abs=1e-9)


def dense(x, y):
    return float(pd.Series(x).rank().corr(pd.Series(y).rank())) if len(set(x)) > 1 else math.nan


@pytest.mark.parametrize("seed", [1, 2])
def test_stages_equal_a_dense_loop(spark, seed):
    rng = np.random.default_rng(seed)
    y = np.array([float(v) for v in rng.integers(0, 9, 14)])
    matrix = np.round(rng.poisson(0.8, (60, 14)) * rng.choice([0.5, 1.0], (60, 14)), 3)
    for k in range(12):
        matrix[k] = np.where(rng.random(14) < 0.8, np.maximum(0, np.round(y * (1 if k % 2 else -1) + rng.normal(4, 1, 14), 0)), 0)
    rates = [(f"u{j:02d}", f"f{k:02d}", float(matrix[k, j])) for k in range(60) for j in range(14) if matrix[k, j]]
    units = [(f"u{j:02d}", float(y[j])) for j in range(14)] + [("none", None)]
    df, table = spark.createDataFrame(rates, "u string, f string, v double").repartition(4), spark.createDataFrame(units, "u string, y double")
    got = {r.item: r for r in selection.select(df, table, "u", "f", "v", 5, 0.3, 0.9, 4).collect()}
    prevalent = [k for k in range(60) if (matrix[k] > 0).sum() >= 5]
    assert set(got) == {f"f{k:02d}" for k in prevalent}
    rho = {k: dense(matrix[k], y) for k in prevalent}
    p = {k: round(t_two_sided(rho[k] * math.sqrt(12 / (1 - rho[k] ** 2)), 12), 12) for k in prevalent if not math.isnan(rho[k])}
    order = sorted(p, key=lambda k: (p[k], k))
    top = max([i + 1 for i, k in enumerate(order) if p[k] <= (i + 1) / len(order) * 0.3], default=0)
    significant, stable = order[:top], []
    for k in significant:
        same = 0
        for j in range(14):
            left = dense(np.delete(matrix[k], j), np.delete(y, j))
            same += not math.isnan(left) and abs(left) > 1e-12 and np.sign(left) == np.sign(rho[k])
        if same / 13 >= 0.9:
            stable.append(k)
    chosen = sorted(stable, key=lambda k: (-round(abs(rho[k]), 12), k))[:4]
    assert significant and chosen
    for k in prevalent:
        r = got[f"f{k:02d}"]
        assert r.units == (matrix[k] > 0).sum() and (r.rho == pytest.approx(rho[k], abs=1e-9) or math.isnan(rho[k]))
        assert r.stage == ("selected" if k in chosen else "stable" if k in stable else "significant" if k in significant else "prevalent")
        assert r.place == (chosen.index(k) + 1 if k in chosen else None)


def test_no_rows(spark):
    none = spark.createDataFrame([], "u string, f string, v double")
    assert selection.select(none, spark.createDataFrame([], "u string, y double"), "u", "f", "v").count() == 0
    assert selection.gram_counts(spark.createDataFrame([], "u string, t string"), "u", "t").count() == 0


def test_texts_are_read_once_for_what_they_hold(spark):
    """Each later stage counted all texts again; rates are now worked out once, before their items are stored."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def watched(v):
        seen.add(1)
        return v

    rng = np.random.default_rng(3)
    rows = [(f"u{j:02d}", f"f{k:02d}", float(j * (k % 3) + rng.integers(1, 9))) for k in range(40) for j in range(12)]
    rates = spark.createDataFrame(rows, "u string, f string, v double").withColumn("v", watched("v"))
    units = spark.createDataFrame([(f"u{j:02d}", float(j)) for j in range(12)], "u string, y double")
    assert len(selection.select(rates, units, "u", "f", "v", 5, 0.3, 0.9, 4).collect()) == 40
    assert seen.value <= 2 * len(rows)  # the test of the value and the value


def test_shares_of_many_items_equal_single_removals():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 6, 13).astype(float)
    x = np.vstack([rng.poisson(1.0, (50, 13)).astype(float), np.eye(13)[:2], np.ones((1, 13))])
    y_rank = pd.Series(y).rank().to_numpy()
    before = selection.HELD_CELLS
    try:
        selection.HELD_CELLS = 2000  # several blocks of units
        got = selection.leave_one_out_shares(x, y_rank, y)
    finally:
        selection.HELD_CELLS = before
    for row, share in zip(x, got, strict=True):
        rank = pd.Series(row).rank().to_numpy()
        sign, same = np.sign(13 * (rank * y_rank).sum() - rank.sum() * y_rank.sum()), 0
        for j in range(13):
            a, b = pd.Series(np.delete(row, j)).rank().to_numpy(), pd.Series(np.delete(y, j)).rank().to_numpy()
            same += a.min() < a.max() and np.sign(12 * (a * b).sum() - a.sum() * b.sum()) == sign
        assert share == same / 12


def test_grams_held_over_batches(spark):
    """Counts go on over batches of text and are let go of when they are many; more different characters than have numbers are counted too."""
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdé€𝒳\x00 "), 40)) for _ in range(60)]
    many = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 300))
    rows = [(f"u{k % 3}", w) for k, w in enumerate(words)] + [("u1", many), ("u2", "a"), ("u2", "b")]
    want = Counter((u, t[i : i + n]) for u, t in rows for n in (3, 4) for i in range(len(t) - n + 1))
    df = spark.createDataFrame(rows, "u string, t string").coalesce(1)
    before = selection.COUNTED_CHARACTERS, selection.HELD_GRAMS, selection.LETTERS
    try:
        for selection.COUNTED_CHARACTERS, selection.HELD_GRAMS, selection.LETTERS in ((90, 50, 1 << 15), (90, 100_000, 1 << 15), before, (90, 100_000, 100)):
            assert Counter({(r.u, r.item): r.n for r in selection.gram_counts(df, "u", "t").collect()}) == want
    finally:
        selection.COUNTED_CHARACTERS, selection.HELD_GRAMS, selection.LETTERS = before
