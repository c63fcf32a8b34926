"""The nested fit against a plain loop over rows."""

import numpy as np
import pandas as pd
import pytest

from stylometra.operators import nested

LAMS = (0.5, 5.0, 50.0)
SCHEMA = "g string, x array<double>, y double, kind string"


def table(seed=2, groups=8, columns=5):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(groups):
        date = float(100 * k + rng.integers(0, 40))
        for _ in range(int(rng.integers(3, 30))):
            x = rng.normal(0, 1, columns) + np.arange(columns) * date / 900
            rows.append((f"g{k}", x.tolist(), date, "even" if k % 2 == 0 else "odd"))
    return rows


def plain(rows, labels, alpha, width):
    """(group, lam, raw, sd): every fit from the rows themselves."""
    g = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows])
    names = sorted(set(g))
    y = np.array([labels[a] for a in g])

    def fit(train, w, test, lam):
        mean, sd = x[train].mean(0), x[train].std(0)
        a, b = (x[train] - mean) / sd, (x[test] - mean) / sd
        middle = np.average(y[train], weights=w)
        beta = np.linalg.solve((a * w[:, None]).T @ a + lam * np.eye(a.shape[1]), (a * w[:, None]).T @ (y[train] - middle))
        return b @ beta + middle

    out = []
    for fold in names:
        inner = [n for n in names if n != fold]
        d = np.array([labels[n] for n in inner])
        own = 1 / np.exp(-0.5 * ((d[:, None] - d) / width) ** 2).sum(1) ** 1.0
        weight = dict(zip(inner, own**alpha / (own**alpha).mean()))
        w = np.array([weight.get(a, 0.0) for a in g])
        errors = []
        for lam in LAMS:
            e = []
            for left in inner:
                train = (g != fold) & (g != left)
                e.append(abs(np.median(fit(train, w[train], g == left, lam)) - labels[left]))
            errors.append(np.mean(e))
        lam = LAMS[int(np.argmin(np.round(errors, 9)))]
        p = fit(g != fold, w[g != fold], g == fold, lam)
        out.append((fold, lam, np.median(p), p.std()))
    return out


@pytest.mark.parametrize("rows_in_block", [2000, 4])
def test_nested_fit_equals_a_plain_loop(spark, rows_in_block, monkeypatch):
    monkeypatch.setattr(nested, "BLOCK_ROWS", rows_in_block)
    rows = table()
    df = spark.createDataFrame([*rows, ("g1", None, 1.0, "odd"), (None, [1.0] * 5, 1.0, None)], SCHEMA).repartition(3)
    got = nested.nested_fit(df, "g", "x", "y", LAMS, 0.7, 120.0, draws=2, stratum="kind", seed=4).toPandas()
    truth = {r[0]: r[2] for r in rows}
    kind = {r[0]: r[3] for r in rows}
    for draw in (-1, 0, 1):
        own = got[got["draw"] == draw].sort_values("grp")
        labels = dict(zip(own["grp"], own["truth"]))
        if draw < 0:
            assert labels == truth
        for k in ("even", "odd"):
            assert sorted(labels[g] for g in labels if kind[g] == k) == sorted(truth[g] for g in truth if kind[g] == k)
        want = plain(rows, labels, 0.7, 120.0)
        assert list(own["grp"]) == [w[0] for w in want] and list(own["lam"]) == [w[1] for w in want]
        assert own["raw"].to_numpy() == pytest.approx([w[2] for w in want], rel=1e-7)
        assert own["sd"].to_numpy() == pytest.approx([w[3] for w in want], rel=1e-6)
        t, p = own["truth"].to_numpy(), own["raw"].to_numpy()
        stretch = np.clip(t.std() / p.std(), 0.5, 8)
        assert own["pred"].to_numpy() == pytest.approx(t.mean() + stretch * (p - p.mean()))
    assert [n for n in got[got["draw"] == -1].sort_values("grp")["n"]] == [sum(r[0] == g for r in rows) for g in sorted(truth)]


def test_metrics_and_null(spark):
    fits = spark.createDataFrame([(d, g, float(t), float(p)) for d, ps in ((-1, (1, 2, 3, 5)), (0, (4, 3, 2, 1)), (1, (1, 3, 2, 4))) for g, t, p in zip("abcd", (1, 2, 2, 4), ps)], "draw int, grp string, truth double, pred double")
    m = {r.draw: r for r in nested.fit_metrics(fits).collect()}
    assert (m[-1].pairs, m[-1].pair, m[-1].mae) == (5, 1.0, 0.5) and m[0].pair == 0.0
    a, b = pd.Series([1, 2, 2, 4]).rank(), pd.Series([1, 2, 3, 5]).rank()
    assert m[-1].rho == pytest.approx(np.corrcoef(a, b)[0, 1])
    p = {r.statistic: r for r in nested.null_p_values(nested.fit_metrics(fits)).collect()}
    assert p["pair"].p == pytest.approx(2 / 3) and p["rho"].draws == 2 and p["mae"].observed == 0.5
    strata = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")], "grp string, stratum string")
    got = {r.draw: r.partial for r in nested.stratum_rho(fits, strata).collect()}
    assert got[-1] == pytest.approx(np.corrcoef(pd.Series([-0.5, 0.5, -1, 1]).rank(), pd.Series([-0.5, 0.5, -1, 1]).rank())[0, 1])


def test_few_groups_and_medians_of_large_groups(spark):
    rows = [r for r in table() if r[0] in ("g0", "g1")]
    assert nested.nested_fit(spark.createDataFrame(rows, SCHEMA), "g", "x", "y", LAMS).count() == 0
    assert nested.nested_fit(spark.createDataFrame([], SCHEMA), "g", "x", "y", LAMS).count() == 0
    rng = np.random.default_rng(1)
    values = {"a": rng.normal(0, 1, 501).round(1), "b": rng.normal(0, 1, 20), "c": np.full(40, 2.0), "d": np.array([7.0])}
    df = spark.createDataFrame([(k, float(v)) for k, own in values.items() for v in own] + [("a", None)], "k string, v double").repartition(4)
    for r in nested.exact_medians(df, ["k"], "v").collect():
        assert (r.n, r.med, r.sd) == (len(values[r.k]), pytest.approx(np.median(values[r.k])), pytest.approx(values[r.k].std(), abs=1e-9))


def test_sums_merge_in_levels(spark):
    from stylometra.operators import models

    rows = table(groups=4)
    grams = models.group_grams(spark.createDataFrame(rows, SCHEMA).repartition(40), "g", "x", "y")
    for name, got in grams.items():
        z = np.array([[1, *r[1], r[2]] for r in rows if r[0] == name])
        assert got == pytest.approx(z.T @ z)


def test_scenarios_equal_fits_of_what_they_leave(spark):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    scenarios = nested.grid({"all": None, "two": (0, 3)}, {"none": (), "some": ("g2", "g5")}, {"still": {}, "moved": {"g1": 50.0}}) | {"few": nested.Scenario(drop=tuple(f"g{k}" for k in range(6)))}
    got = nested.nested_scenarios(df, "g", "x", "y", scenarios, LAMS, 1.0, 120.0).toPandas()
    assert set(got["scenario"]) == set(scenarios) - {"few"} and len(scenarios) == 9
    for name in ("all | none | still", "two | some | moved", "two | none | still", "all | some | moved"):
        own = scenarios[name]
        left = [(g, [v for k, v in enumerate(x) if own.columns is None or k in own.columns], y + own.shift.get(g, 0.0), kind) for g, x, y, kind in rows if g not in own.drop]
        want = plain(left, {g: y for g, _, y, _ in left}, 1.0, 120.0)
        mine = got[got["scenario"] == name].sort_values("grp")
        assert list(mine["grp"]) == [w[0] for w in want] and list(mine["lam"]) == [w[1] for w in want]
        assert mine["raw"].to_numpy() == pytest.approx([w[2] for w in want], rel=1e-7)
    assert nested.nested_scenarios(spark.createDataFrame([], SCHEMA), "g", "x", "y", scenarios, LAMS).count() == 0


def test_medians_of_pieces_are_exact_and_few_values_leave_them():
    import pandas as pd

    rng, lams = np.random.default_rng(1), 2
    right = pd.DataFrame({"draw": [0], "fold": [1], "betas": [np.array([[0.0, 1.0], [0.5, -2.0]]).tobytes()], "bounds": [np.tile([[-np.inf], [np.inf]], lams).tobytes()]})
    for pieces in ([rng.normal(0, 1, 2000) for _ in range(20)], [np.sort(rng.normal(k, 1, 1000 + k)) for k in range(9)], [rng.integers(0, 3, 2000).astype(float) for _ in range(4)], [np.ones(1), np.zeros(3)]):
        left = [pd.DataFrame({"grp": ["g"], "n": [len(x)], "x": [x.tobytes()]}) for x in pieces]
        parts = pd.concat([nested._parted(1, lams, False)(b, right) for b in left])
        bounds = nested._bounds(lams)((0, 1, "g"), parts)
        last = pd.concat([nested._parted(1, lams, True)(b, right.assign(bounds=bounds["bounds"])) for b in left])
        every = np.concatenate(pieces)
        for lam, p in enumerate((every, 0.5 - 2 * every)):
            own = nested._middle((0, 1, "g", lam), last[last["lam"] == lam]).iloc[0]
            assert own["med"] == pytest.approx(np.median(p), abs=1e-12) and own["sd"] == pytest.approx(p.std()) and own["n"] == len(p)
        if len(every) > 5000:
            assert sum(map(len, [*parts["values"], *last["values"]])) < 0.12 * 8 * lams * len(every)
