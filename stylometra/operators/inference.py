"""Fits and nulls that need more than one pass of group statistics: regressions with tails, leverage, nested choices, specification curves, nulls of a whole fit, substitution.

Models start from Gram matrices of groups (see matrix): the driver holds groups x features squared numbers, never rows.
"""

from __future__ import annotations

import math
from functools import cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tails import binomial_two_sided, incomplete_beta, t_two_sided
from .groups import signed_ranks
from .matrix import group_grams, moments, ridge


def feature_columns(df: DataFrame, meta: list[str]) -> list[str]:
    """The columns that are not metadata, in their order."""
    return [c for c in df.columns if c not in set(meta)]


def ols(df: DataFrame, by: list[str], y: str, xs: list[str], weight: str | None = None) -> DataFrame:
    """(by..., term, coef, se, t, p): least squares of y on xs and a constant in each group, weighted if asked; rows with a null are left out.

    One pass of sums; groups with no degree of freedom or dependent columns have nulls.
    """
    terms = ["const", *xs]
    known = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [y, *xs, *([weight] if weight else [])]))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in [*xs, y]]]
    k = len(cols)
    # sums about the means of the whole table, so that large values keep their digits
    middle = known.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate([*xs, y])]).head()
    shift = [0.0, *[float(m or 0.0) for m in middle]]
    cols = [c - s if i else c for i, (c, s) in enumerate(zip(cols, shift, strict=True))]
    sums = [F.sum(w * cols[i] * cols[j]).alias(f"_s{i}_{j}") for i in range(k) for j in range(i, k)]
    table = known.groupBy(*by).agg(F.count("*").alias("_n"), *sums)

    def solve(frames):
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                g = np.zeros((k, k))
                for i in range(k):
                    for j in range(i, k):
                        g[i, j] = g[j, i] = r[f"_s{i}_{j}"]
                a, b, n = g[:-1, :-1], g[:-1, -1], r["_n"]
                rest = n - len(terms)
                if rest > 0 and np.linalg.matrix_rank(a) == len(a):
                    inv = np.linalg.inv(a)
                    beta = inv @ b
                    left = max(g[-1, -1] - beta @ b, 0.0)
                    # undo the shift in the constant: y = c + sum beta (x - mx) + my
                    lift = np.zeros(len(terms))
                    lift[0], lift[1:] = 1.0, -np.array(shift[1:-1])
                    coef = beta.copy()
                    coef[0] = lift @ beta + shift[-1]
                    var = inv * left / rest
                    se = np.sqrt(np.append(lift @ var @ lift, np.diag(var)[1:]))
                    rows += [{**{c: r[c] for c in by}, "term": t, "coef": c, "se": s, "t": c / s if s else None, "p": t_two_sided(c / s, rest) if s else None} for t, c, s in zip(terms, coef, se, strict=True)]
                else:
                    rows += [{**{c: r[c] for c in by}, "term": t, "coef": None, "se": None, "t": None, "p": None} for t in terms]
            yield pd.DataFrame(rows, columns=[*by, "term", "coef", "se", "t", "p"])

    kinds = dict(df.dtypes)
    return table.mapInPandas(solve, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "term string, coef double, se double, t double, p double"]))


def _sign_p(k: int, n: int) -> float:
    """Two-sided, exact: a sum for few rows, else the incomplete beta function."""
    if n < 200:
        return binomial_two_sided(k, n)
    low = min(k, n - k)
    return min(1.0, 2 * incomplete_beta(n - low, low + 1, 0.5))


#: Up to so many differences, without ties or zeros, the signed-rank test is exact.
EXACT_RANKS = 50


@cache
def _rank_sums(n: int) -> np.ndarray:
    """Share of all sign patterns of the ranks 1 to n with each sum of positive ranks, by convolution."""
    share = np.ones(1)
    for k in range(1, n + 1):
        more = np.zeros(len(share) + k)
        more[: len(share)] += share / 2
        more[k:] += share / 2
        share = more
    return share


def signed_rank_p(w: float, n: int) -> float:
    """Two-sided, exact, of a sum of positive ranks without ties."""
    share, k = _rank_sums(n), int(round(w))
    return float(min(1.0, 2 * min(share[: k + 1].sum(), share[k:].sum())))


def paired_tests(df: DataFrame, by: list[str], difference: str) -> DataFrame:
    """(by..., n, n_up, w_up, sign_p, z, rank_p, exact): the sign test, and the signed-rank test: exact for at most EXACT_RANKS differences without ties or zeros,
    else by its normal form with the variance less its ties' part. Differences of 0 are left out; nulls in by are a group."""
    r = signed_ranks(df, by, difference)
    sizes = df.where(F.col(difference).isNotNull()).groupBy(*by, F.abs(F.col(difference)).alias("_a")).agg(F.count("*").cast("double").alias("_t"))
    tied = F.when(F.col("_a") != 0, F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t"))
    ties = sizes.groupBy(*by).agg(F.coalesce(F.sum(tied), F.lit(0.0)).alias("_ties"), F.max(F.col("_a") == 0).alias("_zeros"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    z = F.try_divide(F.col("w_up") - n * (n + 1) / 4, F.sqrt(var))
    names = {c: f"_by{k}" for k, c in enumerate(by)}
    same = F.lit(True)
    for c, other in names.items():
        same = same & F.col(c).eqNullSafe(F.col(other))
    out = r.join(ties.withColumnsRenamed(names), same).withColumn("z", z).withColumn("exact", (F.col("n") <= EXACT_RANKS) & (F.col("_ties") == 0) & ~F.col("_zeros"))

    def tails(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([_sign_p(int(a), int(b)) for a, b in zip(k, n, strict=True)], dtype="float64")

    def ranks(exact: pd.Series, w: pd.Series, n: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_p(a, int(b)) if e else None if pd.isna(x) else 2 * NormalDist().cdf(-abs(x)) for e, a, b, x in zip(exact, w, n, z, strict=True)], dtype="float64")

    return out.select(*by, "n", "n_up", "w_up", F.pandas_udf(tails, "double")("n_up", "n").alias("sign_p"), "z", F.pandas_udf(ranks, "double")("exact", "w_up", "n", "z").alias("rank_p"), "exact")


def hat_leave_one_out(df: DataFrame, key: str, vector: str, y: str, lam: float) -> DataFrame:
    """(key, fitted, leverage, loo): ridge on standardised columns with a free constant; loo is the prediction of the fit without the row, from its leverage.

    One pass of sums, one of rows. Standard scales are those of all rows.
    """
    rows = df.where(F.col(vector).isNotNull() & F.col(y).isNotNull())
    grams = group_grams(rows.withColumn("_g", F.lit("all")), "_g", vector, y)
    schema = f"`{key}` {dict(df.dtypes)[key]}, fitted double, leverage double, loo double"
    if not grams:
        return df.sparkSession.createDataFrame([], schema)
    n, m, c, cy, my = moments(grams["all"])
    sd = np.sqrt(np.clip(np.diag(c), 0, None))
    sd = np.where(sd > 1e-12, sd, 1.0)
    inv = np.linalg.inv(c * n / np.outer(sd, sd) + lam * np.eye(len(m)))
    beta = inv @ (cy * n / sd)

    def run(frames):
        for f in frames:
            if len(f):
                x = (np.stack(f[vector].to_numpy()).astype(float) - m) / sd
                fit, h = my + x @ beta, 1 / n + np.einsum("ij,jk,ik->i", x, inv, x)
                left = f[y].to_numpy(float) - fit
                yield pd.DataFrame({key: f[key], "fitted": fit, "leverage": h, "loo": f[y].to_numpy(float) - left / (1 - h)})

    return rows.select(key, vector, y).mapInPandas(run, schema)


def fold_stability(groups: DataFrame, folds: int, x: str = "value", y: str = "y", key: str = "grp") -> DataFrame:
    """groups: (feature, key, x, y). For each feature the share of folds (by a digest of the key) whose correlation without the fold has the sign of the whole."""
    fold = F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 7), 16, 10).cast("long"), F.lit(folds))
    own = groups.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_f", fold)
    u, v = F.col(x).cast("double"), F.col(y).cast("double")
    parts = own.groupBy("feature", "_f").agg(F.count("*").cast("double").alias("n"), F.sum(u).alias("a"), F.sum(v).alias("b"), F.sum(u * v).alias("c"))
    whole = parts.groupBy("feature").agg(*[F.sum(k).alias(f"t{k}") for k in "nabc"])
    cov = lambda n, a, b, c: F.signum(c - F.try_divide(a * b, n))
    met = parts.join(whole, "feature").withColumn("_same", (cov(F.col("tn") - F.col("n"), F.col("ta") - F.col("a"), F.col("tb") - F.col("b"), F.col("tc") - F.col("c")) == cov(F.col("tn"), F.col("ta"), F.col("tb"), F.col("tc"))).cast("int"))
    return met.groupBy("feature").agg(F.count("*").alias("folds"), F.avg("_same").alias("same_sign"))


# ---- fits over groups ---------------------------------------------------------------------------------------------


def spearman_of(a, b) -> float:
    """Rank correlation of two short lists; ties have mean ranks; 0 where one does not vary."""
    ra, rb = (pd.Series(v).rank().to_numpy() for v in (a, b))
    if len(ra) < 2 or ra.std() == 0 or rb.std() == 0:
        return 0.0
    return float(np.corrcoef(ra, rb)[0, 1])


def _cut(gram: np.ndarray, columns: np.ndarray) -> np.ndarray:
    at = np.concatenate([[0], columns + 1, [len(gram) - 1]])
    return gram[np.ix_(at, at)]


def _left_out(grams: dict[str, np.ndarray], lams: list[float]) -> dict[str, np.ndarray]:
    """Mean prediction of each group by the ridge on the others, for each lam."""
    total = sum(grams.values())
    return {g: np.array([own[0, :-1] @ b / own[0, 0] for b in ridge(total - own, lams)]) for g, own in grams.items()}


def _truth(gram: np.ndarray) -> float:
    return float(gram[0, -1] / gram[0, 0])


def screened(grams: dict[str, np.ndarray], strata: dict[str, str], fraction: float) -> np.ndarray:
    """Columns of the least share of variance (of groups' means) between strata: that fraction of all, one at least."""
    means = np.array([g[0, 1:-1] / g[0, 0] for g in grams.values()])
    own = np.array([strata[g] for g in grams])
    total = ((means - means.mean(0)) ** 2).sum(0)
    between = sum((own == s).sum() * (means[own == s].mean(0) - means.mean(0)) ** 2 for s in set(own))
    eta = between / np.where(total > 0, total, 1.0)
    return np.sort(np.argsort(eta, kind="stable")[: max(1, int(round(fraction * len(eta))))])


def nested_choice(df: DataFrame, group: str, vector: str, y: str, lams: list[float], configurations: dict[str, list[int]] | None = None, strata: dict[str, str] | None = None, fractions: list[float] | None = None) -> DataFrame:
    """(grp, choice, lam, inner_rho, truth, pred): each group predicted by the configuration and lam whose leave-one-group-out predictions among the other groups rank best.

    Configurations are named sets of columns; or, with strata, fractions of columns that differ least between strata,
    screened anew among the other groups. Of equal choices the first counts. Fewer than four groups give no row.
    """
    grams, out = group_grams(df, group, vector, y), []
    names = sorted(grams)
    for g in names if len(names) >= 4 else []:
        rest = {h: grams[h] for h in names if h != g}
        offered = {str(f): screened(rest, strata, f) for f in fractions or [1.0]} if strata else {k: np.array(v) for k, v in (configurations or {"all": list(range(len(grams[g]) - 2))}).items()}
        best = None
        for name, columns in offered.items():
            own = {h: _cut(v, columns) for h, v in rest.items()}
            inner = _left_out(own, lams)
            truth = [_truth(v) for v in own.values()]
            for i, lam in enumerate(lams):
                rho = spearman_of([p[i] for p in inner.values()], truth)
                if best is None or rho > best[0] + 1e-12:
                    best = (rho, name, lam, columns)
        rho, name, lam, columns = best
        beta = ridge(sum(_cut(v, columns) for v in rest.values()), [lam])[0]
        own = _cut(grams[g], columns)
        out.append((g, name, float(lam), rho, _truth(own), float(own[0, :-1] @ beta / own[0, 0])))
    return df.sparkSession.createDataFrame(out, "grp string, choice string, lam double, inner_rho double, truth double, pred double")


def specification_curve(df: DataFrame, group: str, vector: str, y: str, lams: list[float], sizes: list[int], strata: dict[str, str], fractions: list[float]) -> DataFrame:
    """(least_rows, fraction, lam, calibration, groups, mae, rho): every way to analyse: groups of enough rows, a screen, a lam, and predictions as they are or stretched to the truth's deviation."""
    grams, out = group_grams(df, group, vector, y), []
    for least in sizes:
        kept = {g: v for g, v in sorted(grams.items()) if v[0, 0] >= least}
        if len(kept) < 3:
            continue
        truth = np.array([_truth(v) for v in kept.values()])
        for fraction in fractions:
            columns = screened(kept, strata, fraction)
            left = _left_out({g: _cut(v, columns) for g, v in kept.items()}, lams)
            for i, lam in enumerate(lams):
                pred = np.array([p[i] for p in left.values()])
                stretch = float(np.clip(truth.std() / pred.std(), 0.5, 8.0)) if pred.std() > 0 else 1.0
                for name, p in (("none", pred), ("variance", truth.mean() + stretch * (pred - pred.mean()))):
                    out.append((least, float(fraction), float(lam), name, len(kept), float(np.abs(p - truth).mean()), spearman_of(p, truth)))
    return df.sparkSession.createDataFrame(out, "least_rows int, fraction double, lam double, calibration string, groups int, mae double, rho double")


def detectable(n: int, alpha: float = 0.05, power: float = 0.8) -> float:
    """The least correlation that n units show with the given power, two-sided, by bisection on the normal form of the transformed correlation."""
    cut, se = NormalDist().inv_cdf(1 - alpha / 2), 1 / math.sqrt(max(n - 3, 1))

    def reached(rho: float) -> float:
        shift = math.atanh(rho) / se
        return NormalDist().cdf(shift - cut) + NormalDist().cdf(-shift - cut)

    low, high = 0.0, 1 - 1e-12
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if reached(middle) < power else (low, middle)
    return high


def critical_rho(n: int, alpha: float) -> float:
    """The rank correlation of n pairs whose two-sided p by t is alpha."""
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        p = t_two_sided(middle * math.sqrt((n - 2) / max(1 - middle * middle, 1e-300)), n - 2)
        low, high = (middle, high) if p > alpha else (low, middle)
    return high


#: Pairs that a block of samples draws at most.
DRAWN_PAIRS = 4_000_000


def power_curves(sizes: DataFrame, key: str, n: str, rhos: list[float], alphas: list[float], samples: int = 2000, seed: int = 0) -> DataFrame:
    """(key, n, rho, alpha, power): the share of samples of n pairs of correlated normals whose rank correlation is significant, for every group's number of units.

    Samples are drawn and ranked in tasks, in blocks seeded by the group's n, the correlation and the block, so groups of equal size share their power. A block has 250 samples, fewer where
    these have more than DRAWN_PAIRS pairs, and blocks are dealt to many tasks. Groups of fewer than 4 units have no row.
    """
    rows = sizes.where(F.col(n) >= 4).select(F.col(n).cast("long").alias("_n")).distinct()
    rows = rows.withColumn("_block", F.greatest(F.lit(1), F.least(F.lit(250), F.floor(F.lit(DRAWN_PAIRS) / F.col("_n")))).cast("int"))
    last = F.greatest(F.lit(1), F.ceil(F.lit(samples) / F.col("_block"))).cast("int") - 1
    todo = rows.withColumn("rho", F.explode(F.array(*[F.lit(float(r)) for r in rhos]))).withColumn("_b", F.explode(F.sequence(F.lit(0), last)))
    pairs = todo.agg(F.sum(F.col("_block") * F.col("_n"))).head()[0] or 0
    parts = max(1, min(-(-pairs // DRAWN_PAIRS), 1024))

    def run(frames):
        for f in frames:
            for size, block, rho, b in zip(f["_n"], f["_block"], f["rho"], f["_b"], strict=True):
                size, block = int(size), int(block)
                rng = np.random.default_rng([seed, size, int(round(rho * 1e6)), int(b)])
                x, e = rng.standard_normal((block, size)), rng.standard_normal((block, size))
                place, middle = np.arange(size) - (size - 1) / 2, np.empty(size)
                r = np.empty(block)
                for k, (own, noise) in enumerate(zip(x, e, strict=True)):
                    middle[own.argsort()] = place
                    r[k] = abs(middle[(rho * own + math.sqrt(1 - rho * rho) * noise).argsort()] @ place) / ((size**3 - size) / 12)
                out = [(size, rho, alpha, block, int((r > critical_rho(size, alpha)).sum())) for alpha in alphas]
                yield pd.DataFrame(out, columns=["_n", "rho", "alpha", "all", "hits"])

    drawn = todo.repartition(parts, "_n", "rho", "_b").mapInPandas(run, "_n long, rho double, alpha double, all long, hits long")  # a number of tasks is kept, few bytes or not
    power = drawn.groupBy("_n", "rho", "alpha").agg((F.sum("hits") / F.sum("all")).alias("power"))
    return sizes.join(power, F.col(n) == F.col("_n")).select(key, n, "rho", "alpha", "power")


def substituted(tokens: DataFrame, changes: dict[str, str], rate: float, place: list[str]) -> DataFrame:
    """tokens (token, place columns...) with a share `rate` of the tokens of changes replaced: those whose digest of their place falls below the rate, so a higher rate replaces these and more."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in place])), 1, 7), 16, 10).cast("long") / float(1 << 28)
    new: Column = F.lit(None).cast("string")
    for old, other in changes.items():
        new = F.when(F.col("token") == old, other).otherwise(new)
    return tokens.withColumn("token", F.when(new.isNotNull() & (draw < rate), new).otherwise(F.col("token")))


def shifted(gram: np.ndarray, delta: float) -> np.ndarray:
    """The Gram matrix of a group whose rows' y are all moved by delta."""
    out = gram.copy()
    out[:-1, -1] = out[-1, :-1] = gram[:-1, -1] + delta * gram[:-1, 0]
    out[-1, -1] = gram[-1, -1] + 2 * delta * gram[0, -1] + delta * delta * gram[0, 0]
    return out


def anchor_shifts(df: DataFrame, group: str, vector: str, y: str, lam: float, scenarios: dict[str, dict[str, float]]) -> DataFrame:
    """(scenario, grp, truth, pred): leave-one-group-out predictions with some groups' y moved; no scenario reads rows again."""
    grams, out = group_grams(df, group, vector, y), []
    for name, moves in scenarios.items() if len(grams) > 1 else []:
        own = {g: shifted(v, moves.get(g, 0.0)) for g, v in grams.items()}
        out += [(name, g, _truth(own[g]), float(p[0])) for g, p in _left_out(own, [lam]).items()]
    return df.sparkSession.createDataFrame(out, "scenario string, grp string, truth double, pred double")


def random_subsets(df: DataFrame, group: str, vector: str, y: str, lam: float, size: int, draws: int, seed: int = 0) -> DataFrame:
    """(draw, mae, rho): leave-one-group-out fits on columns drawn without replacement; draw -1 has all columns."""
    grams, out, rng = group_grams(df, group, vector, y), [], np.random.default_rng(seed)
    width = len(next(iter(grams.values()))) - 2 if grams else 0
    truth = np.array([_truth(v) for v in grams.values()])
    for draw in range(-1, draws if len(grams) > 1 else -1):
        columns = np.arange(width) if draw < 0 else np.sort(rng.permutation(width)[:size])
        pred = np.array([p[0] for p in _left_out({g: _cut(v, columns) for g, v in grams.items()}, [lam]).values()])
        if len(grams) > 1:
            out.append((draw, float(np.abs(pred - truth).mean()), spearman_of(pred, truth)))
    return df.sparkSession.createDataFrame(out, "draw int, mae double, rho double")


def bootstrap(df: DataFrame, by: list[str], value: str, draws: int, row: list[str], statistic: str = "mean", weight: str | None = None, seed: int = 0) -> DataFrame:
    """(by..., draw, value): Poisson bootstrap of the mean (weighted, if asked) or the median; a row's number in a draw comes from a hash of its key."""
    d = df.sparkSession.range(draws).withColumnRenamed("id", "draw")
    u = F.pmod(F.xxhash64(F.lit(seed), "draw", *row), F.lit(1 << 40)) / float(1 << 40)
    times, total, term = F.lit(0), 0.0, math.exp(-1)
    for k in range(8):
        total += term
        times = times + (u >= total).cast("int")
        term /= k + 1
    x = df.crossJoin(F.broadcast(d)).withColumn("_t", times).where("_t > 0")
    w = F.col("_t") * F.col(weight) if weight else F.col("_t")
    made = F.percentile(F.col(value), F.lit(0.5), F.col("_t")) if statistic == "median" else F.try_divide(F.sum(w * F.col(value)), F.sum(F.when(F.col(value).isNotNull(), w)))
    return x.groupBy(*by, "draw").agg(made.alias("value"))


def annotated_rates(tokens: DataFrame, unit: str, sentence: str, order: str, single: dict[str, Column], pairs: dict[str, Column], tops: dict[str, int]) -> DataFrame:
    """(unit, family, item, n, rate) of annotated tokens: single families count an item for each token, pairs one for each two neighbours of a sentence; a null voids it.

    Only the commonest items of each family (ties by item) of all units are kept; rates are per 1000 tokens of the unit.
    Tokens of one place are ordered by their tags. Neighbours are met in the sentence's array of tokens, so the table is grouped by sentence once and never windowed.
    """
    kinds = {**{k: c for k, c in single.items()}, **{f"_{k}": c for k, c in pairs.items()}}
    cells = F.struct(F.col(order).alias("_o"), *[c.cast("string").alias(k) for k, c in kinds.items()])
    own = tokens.groupBy(unit, sentence).agg(F.array_sort(F.collect_list(cells)).alias("_s"))  # the tokens of one sentence
    first, second = (F.slice("_s", F.lit(at), F.greatest(F.size("_s") - 1, F.lit(0))) for at in (1, 2))

    def single_items(k: str) -> Column:
        return F.transform("_s", lambda x: x[k])

    def pair_items(k: str) -> Column:
        return F.zip_with(first, second, lambda a, b: F.concat(a[f"_{k}"], F.lit("|"), b[f"_{k}"]))

    lists = [F.struct(F.lit(k).alias("family"), single_items(k).alias("items")) for k in single]
    lists += [F.struct(F.lit(k).alias("family"), pair_items(k).alias("items")) for k in pairs]
    flat = own.select(unit, F.explode(F.array(*lists)).alias("f")).select(unit, "f.family", F.explode("f.items").alias("item")).where("item IS NOT NULL")
    counts = flat.groupBy(unit, "family", "item").agg(F.count("*").alias("n"))
    whole, kept = counts.groupBy("family", "item").agg(F.sum("n").alias("_all")), None
    for family, k in tops.items():
        part = whole.where(F.col("family") == family).orderBy(F.desc("_all"), "item").limit(k).select("family", "item")
        kept = part if kept is None else kept.unionByName(part)
    size = tokens.groupBy(unit).agg(F.count("*").alias("_size"))
    met = counts.join(F.broadcast(kept), ["family", "item"]).join(size, unit)  # at most sum(tops) rows are sent
    return met.select(unit, "family", "item", "n", (F.col("n") * 1000.0 / F.col("_size")).alias("rate"))


def clause_order(parts: DataFrame, unit: str, clause: str, role: str, place: str, subject: str, verb: str, thing: str) -> DataFrame:
    """(unit, sv, ov, null_subject): of clauses that have both the share whose last subject, or object, stands before the last verb; of those with a verb the share without a subject."""
    at = lambda r: F.max(F.when(F.col(role) == r, F.col(place)))
    own = parts.groupBy(unit, clause).agg(at(subject).alias("s"), at(verb).alias("v"), at(thing).alias("o"))
    share = lambda a, b: F.avg((F.col(a) < F.col(b)).cast("int"))
    return own.groupBy(unit).agg(share("s", "v").alias("sv"), share("o", "v").alias("ov"), F.avg(F.when(F.col("v").isNotNull(), F.col("s").isNull().cast("int"))).alias("null_subject"))
