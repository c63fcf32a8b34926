"""Regressions, nulls, nested choices and texts against plain numpy and Python."""

import math
from statistics import NormalDist
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stylometra.__main__ import main
from stylometra.operators import features, inference, joins, profiles, validate
from stylometra.operators import text as T
from stylometra.sources import tables


def test_regression_with_tails(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in "ab":
        x = rng.normal(50, 9, (60, 3))
        y = 1e5 + x @ [3.0, 0.0, -2.0] + rng.normal(0, 2, 60)
        w = rng.uniform(0.5, 2, 60)
        rows += [(g, *map(float, r), float(v), float(k)) for r, v, k in zip(x, y, w)]
    df = spark.createDataFrame([*rows, ("c", 1.0, 1.0, 1.0, 1.0, 1.0), ("a", None, 1.0, 1.0, 1.0, 1.0)], "g string, x1 double, x2 double, x3 double, y double, w double")
    got = {(r.g, r.term): r for r in inference.ols(df, ["g"], "y", ["x1", "x2", "x3"], "w").collect()}
    for g in "ab":
        own = np.array([r[1:] for r in rows if r[0] == g])
        a, y, w = np.column_stack([np.ones(60), own[:, :3]]), own[:, 3], own[:, 4]
        inv = np.linalg.inv(a.T @ (w[:, None] * a))
        beta = inv @ (a.T @ (w * y))
        se = np.sqrt(np.diag(inv) * (w * (y - a @ beta) ** 2).sum() / 56)
        for k, t in enumerate(("const", "x1", "x2", "x3")):
            r = got[g, t]
            assert (r.coef, r.se, r.t) == (pytest.approx(beta[k], rel=1e-6), pytest.approx(se[k], rel=1e-6), pytest.approx(beta[k] / se[k], rel=1e-6)) and 0 <= r.p <= 1
    assert got["c", "x1"].coef is None


def test_leave_one_out_by_leverage(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3))
    y = x @ [1.0, 2.0, 0.5] + rng.normal(size=40)
    df = spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))], "i long, v array<double>, y double")
    got = {r.i: r for r in inference.hat_leave_one_out(df, "i", "v", "y", 2.0).collect()}
    z = (x - x.mean(0)) / x.std(0)
    for i in (0, 7, 39):
        keep = np.arange(40) != i
        a = np.column_stack([np.ones(39), z[keep]])
        beta = np.linalg.solve(a.T @ a + 2.0 * np.diag([0, 1, 1, 1]), a.T @ y[keep])
        assert got[i].loo == pytest.approx(beta[0] + z[i] @ beta[1:], abs=1e-9)


def _groups(spark, n=8, rows=12):
    rng = np.random.default_rng(3)
    data = []
    for g in range(n):
        for _ in range(rows):
            v = np.append(g + rng.normal(0, 0.5, 2), rng.normal(0, 1, 2))
            data.append((str(g), [float(a) for a in v], float(g)))
    return spark.createDataFrame(data, "g string, v array<double>, y double"), data


def test_nested_choice_takes_the_informative_columns(spark):
    df, _ = _groups(spark)
    got = inference.nested_choice(df, "g", "v", "y", [0.1, 10.0], {"noise": [2, 3], "signal": [0, 1]}).collect()
    assert len(got) == 8 and sum(r.choice == "signal" for r in got) >= 7
    assert np.mean([abs(r.truth - r.pred) for r in got]) < 0.8
    strata = {str(g): "ab"[g % 2] for g in range(8)}
    assert len(inference.nested_choice(df, "g", "v", "y", [1.0], strata=strata, fractions=[0.5, 1.0]).collect()) == 8
    curve = inference.specification_curve(df, "g", "v", "y", [0.1, 1.0], [1, 99], strata, [0.5, 1.0]).collect()
    assert len(curve) == 8 and {r.least_rows for r in curve} == {1}


def test_paired_tests(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, -4, 5, 6, 7, 8, 0)], "g string, d double")
    r = inference.paired_tests(df, ["g"], "d").head()
    assert (r.n, r.n_up, r.w_up) == (8, 7, 32.0) and r.sign_p == pytest.approx(2 * (1 + 8) / 256) and r.z == pytest.approx((32 - 18) / math.sqrt(51))
    assert inference._sign_p(100, 300) == pytest.approx(2 * sum(math.comb(300, k) for k in range(101)) / 2**300, rel=1e-9)


def test_exact_signed_ranks(spark):
    from itertools import product

    d = [1.0, -2.0, 3.0, 4.5, -5.0, 6.0, 7.0]
    sums = [sum(k + 1 for k, up in enumerate(signs) if up) for signs in product((0, 1), repeat=7)]
    w = sum(k + 1 for k, x in enumerate(d) if x > 0)
    want = min(1.0, 2 * min(sum(s <= w for s in sums), sum(s >= w for s in sums)) / 2**7)
    rows = [("a", x) for x in d] + [("b", x) for x in [*d, 0.0]] + [("c", x) for x in [*d, -7.0]] + [(None, x) for x in d]
    got = {r.g: r for r in inference.paired_tests(spark.createDataFrame(rows, "g string, d double"), ["g"], "d").collect()}
    assert got["a"].exact and got["a"].rank_p == pytest.approx(want) and got[None].rank_p == pytest.approx(want)
    assert not got["b"].exact and not got["c"].exact and got["b"].rank_p == pytest.approx(math.erfc(abs(got["b"].z) / math.sqrt(2)))


def test_power_curves(spark):
    assert inference.critical_rho(25, 0.05) == pytest.approx(0.3961, abs=1e-4)
    sizes = spark.createDataFrame([("a", 25), ("b", 25), ("c", 60), ("d", 3), (None, 60)], "g string, n long").repartition(2)
    rows = {(r.g, r.rho, r.alpha): r.power for r in inference.power_curves(sizes, "g", "n", [0.0, 0.4, 0.7], [0.05, 0.2], 2000).collect()}
    assert len(rows) == 4 * 6 and all(rows["a", r, x] == rows["b", r, x] for r in (0.0, 0.4, 0.7) for x in (0.05, 0.2))
    assert abs(rows["c", 0.0, 0.05] - 0.05) < 0.02 and abs(rows["a", 0.0, 0.2] - 0.2) < 0.03
    assert rows["a", 0.4, 0.05] < rows["a", 0.4, 0.2] < rows["a", 0.7, 0.2] and rows["c", 0.4, 0.05] > rows["a", 0.4, 0.05]
    # the normal form of the transformed correlation, whose variance is a little larger for ranks
    want = 1 - NormalDist().cdf(NormalDist().inv_cdf(0.975) - math.atanh(6 / math.pi * math.asin(0.35)) / math.sqrt(1.06 / 22))
    assert rows["a", 0.7, 0.05] == pytest.approx(want, abs=0.05)


def test_least_detectable_correlation():
    assert inference.detectable(25) == pytest.approx(0.53, abs=0.02) and inference.detectable(100) < inference.detectable(25)


def test_substitution_grows_with_the_rate(spark):
    toks = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(400)], "i long, token string")
    sets = [{r.i for r in inference.substituted(toks, {"a": "z"}, rate, ["i"]).where("token = 'z'").collect()} for rate in (0.0, 0.3, 0.6, 1.0)]
    assert not sets[0] and sets[0] <= sets[1] <= sets[2] <= sets[3] and len(sets[3]) == 200 and 40 < len(sets[1]) < 80


def test_profiles_of_greek(spark):
    rows = [(1, "Καὶ λέγει ὁ ἄνθρωπος, μὲν δὲ γάρ. Ἰδοὺ θάλαττα καὶ θάλασσα; εἶπεν ὅτι οὐκ ἐν τῇ πόλει λύσαιμι"), (2, ""), (3, None)]
    got = {r.doc_id: r for r in profiles.grammar_profile(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = 18
    r = got[1]
    assert len(r) == 28
    for name, count in (("kai_rate", 2), ("men_rate", 1), ("de_rate", 1), ("gar_rate", 1), ("idou_rate", 1), ("eipen_rate", 1), ("hoti_rate", 1), ("ou_rate", 1), ("en_rate", 1), ("opt_rate", 1)):
        assert r[name] == pytest.approx(1000 * count / n), name
    assert r.men_de_ratio == r.tt_ss_ratio == 0.5 and r.prep_en_eis_frac == 1.0 and r.kai_sent_initial == pytest.approx(1 / 3) and r.avg_sent_len == 6
    assert all(v == 0 for v in got[2][1:]) and all(v == 0 for v in got[3][1:])
    reg = {r.doc_id: r for r in profiles.register_profile(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(reg[1]) == 15 and reg[1].kai_rate == pytest.approx(2000 / n) and reg[2].avg_sent_len == 0


def test_words_and_grams(spark):
    df = spark.createDataFrame([("Ab, (c-d)  «e».\n 1x ;; f g",), ("",), (None,), ("😀a b",)], "text string")
    t = df.select(T.words_of(F.col("text")).alias("w"), T.char_ngrams(F.col("text"), 3).alias("c"), T.sentence_ngrams(F.col("text"), 2).alias("g")).collect()
    assert t[0].w == ["ab", "c-d", "e", "1x", "f", "g"] and t[0].g == ["ab c-d", "c-d e", "f g"]
    assert t[3].c == [" 😀a", "😀a ", "a b", " b "] and t[1].w == [] and t[2].w is None


def test_html_text():
    for html, text in (
        ("a<br>b<br/>c", "a\nb\nc"),
        ("<p>one<p>two", "one\ntwo"),
        ("<nav>menu<p>text", "menutext"),
        ("<head><title>t</title><body>text</body>", "text"),
        ("x<script>var a = '<p>';</script>y", "xy"),
        ("x<script>never closed", "x"),
        ("a<note>n</note>tail<b>c</b>", "ac"),
        ("<nav><nav>a</nav>b</nav>c", "c"),
    ):
        assert tables.html_text(html) == text, html
    assert tables.html_text(None) is None and tables.html_text("") == ""


def test_range_join(spark):
    rnd = random.Random(1)
    points = [rnd.randint(0, 300) for _ in range(80)]
    ranges = [(k, a := rnd.randint(0, 300), a + rnd.randint(-5, 60)) for k in range(40)]
    p = spark.createDataFrame([(x,) for x in [*points, None]], "x long")
    r = spark.createDataFrame([*ranges, (99, None, 5)], "k long, lo long, hi long")
    got = sorted((m.x, m.k) for m in joins.range_join(p, "x", r, "lo", "hi", 16).collect())
    assert got == sorted((x, k) for x in points for k, lo, hi in ranges if lo <= x <= hi)


def test_ranks_without_groups(spark):
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 9), rnd.random() if k % 3 else 0.5, k % 2) for k in range(200)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1)], "x long, y double, p int")
    with_group = features.spearman(df.withColumn("g", F.lit(1)), ["g"], "x", "y").head()
    alone = features.spearman(df, [], "x", "y").head()
    assert (alone.n, alone.rho) == (with_group.n, pytest.approx(with_group.rho))
    pos, neg = [y for _, y, p in rows if p], [y for _, y, p in rows if not p]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert features.auc(df.where("x IS NOT NULL"), "y", F.col("p") == 1).head().auc == pytest.approx(want)
    assert features.auc(df.where("x IS NOT NULL").withColumn("g", F.lit(1)), "y", F.col("p") == 1, ["g"]).head().auc == pytest.approx(want)


def test_bootstrap_draws_equal_rows_apart(spark):
    df = spark.createDataFrame([(i, float(i % 2)) for i in range(100)], "i long, v double")
    means = [r["mean"] for r in validate.bootstrap_mean(df, [], "v", 50, ["i"]).collect()]
    assert 0.02 < np.std(means) < 0.1
    assert {r.i for r in validate.subsample(df, [], 5, 1, ["i"]).collect()} != set(range(5))


def test_guarded_draws(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "k long, v string"), spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    assert tables.guarded_draws(spark, "p", [a], 1) == tables.guarded_draws(spark, "p", [a.orderBy("k", ascending=False)], 1)
    assert len({tables.guarded_draws(spark, "p", [t], s) for t in (a, b, a.unionAll(a)) for s in (1, 2)}) == 6
    assert inference.feature_columns(a, ["k"]) == ["v"]


def test_command_line(capsys, spark, tmp_path):
    assert main(["list"]) == 0 and "wn5_bigrams *" in capsys.readouterr().out
    assert main(["run", "nothing", "--tables", "x"]) == 2
    assert main(["run", "prj21_era", "--tables", "/root/testdata/sf0.001", "--out", f"file://{tmp_path}/out"]) == 0
    assert spark.read.parquet(f"file://{tmp_path}/out/prj21_era").count() > 0


def test_moved_anchors_and_random_columns(spark):
    df, data = _groups(spark)
    moved = {r.grp: r for r in inference.anchor_shifts(df, "g", "v", "y", 1.0, {"x": {"3": 5.0}}).collect()}
    again = spark.createDataFrame([(g, v, t + 5.0 * (g == "3")) for g, v, t in data], "g string, v array<double>, y double")
    direct = {r.grp: r for r in inference.anchor_shifts(again, "g", "v", "y", 1.0, {"x": {}}).collect()}
    assert moved["3"].truth == pytest.approx(8.0) and all(moved[g].pred == pytest.approx(direct[g].pred) for g in moved)
    subsets = inference.random_subsets(df, "g", "v", "y", 1.0, 2, 20).collect()
    assert len(subsets) == 21 and min(r.mae for r in subsets) <= subsets[0].mae + 1.0 and max(r.mae for r in subsets) > 1.5


def test_bootstrap_forms(spark):
    df = spark.createDataFrame([(i, float(i), 1.0 + i % 3) for i in range(60)] + [(99, None, 1.0)], "i long, v double, w double")
    for statistic, weight in (("mean", None), ("mean", "w"), ("median", None)):
        got = [r["value"] for r in inference.bootstrap(df, [], "v", 40, ["i"], statistic, weight).collect()]
        assert len(got) == 40 and 20 < np.mean(got) < 40 and 0.5 < np.std(got) < 8


def test_annotated_rates_and_clause_order(spark):
    rows = [("u", 1, 1, "a"), ("u", 1, 2, "b"), ("u", 1, 3, None), ("u", 1, 4, "a"), ("u", 2, 1, "b"), ("w", 3, 1, "a")]
    df = spark.createDataFrame(rows, "unit string, s long, o long, tag string")
    got = {(r.unit, r.family, r["item"]): (r.n, r.rate) for r in inference.annotated_rates(df, "unit", "s", "o", {"tag": F.col("tag")}, {"two": F.col("tag")}, {"tag": 2, "two": 5}).collect()}
    assert got == {("u", "tag", "a"): (2, 400.0), ("u", "tag", "b"): (2, 400.0), ("w", "tag", "a"): (1, 1000.0), ("u", "two", "a|b"): (1, 200.0)}
    parts = spark.createDataFrame([("u", 1, "S", 1), ("u", 1, "V", 2), ("u", 2, "V", 1), ("u", 2, "O", 2), ("u", 3, "V", 1), ("u", 3, "S", 2)], "unit string, c long, role string, place long")
    r = inference.clause_order(parts, "unit", "c", "role", "place", "S", "V", "O").head()
    assert (r.sv, r.ov, r.null_subject) == (0.5, 0.0, pytest.approx(1 / 3))


def test_power_curves_deal_large_groups_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(inference, "DRAWN_PAIRS", 1000)
    sizes = spark.createDataFrame([("a", 100), ("b", 5000)], "g string, n long")
    curves = inference.power_curves(sizes, "g", "n", [0.0, 0.05], [0.1], 200)
    rows = {(r.g, r.rho): r.power for r in curves.collect()}
    assert rows["b", 0.05] > 0.9 and abs(rows["a", 0.0] - 0.1) < 0.08 and abs(rows["b", 0.0] - 0.1) < 0.08
    plan = curves._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan  # few bytes, but as many tasks as blocks
