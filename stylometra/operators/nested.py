"""The nested leave-one-group-out fit: weights made anew in each fold, lambda by the error of medians, calibration, and nulls of the whole of it.

Every group of rows (the passages of a text) has one y. A fold leaves a group out; the ridge on the others weighs groups by the inverse
density of their y. Lambda is the one whose predictions of each inner group, left out in turn, have medians nearest to that group's y; the
fold's prediction is the median over the rows of the group left out. A draw deals the groups' y anew and runs all of it again.

Rows are packed once into blocks of bounded size; sums of outer products of groups come from blocks and are all that the driver holds.
Every (draw, fold) is solved in a task from a broadcast of these sums; coefficients meet blocks by (group, piece), so a group of any size is
scored in pieces. Medians of groups in one piece are taken there; those of larger groups are exact too, from a few values of each piece and those near the middle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.tables import stored
from .models import MOST_CELLS, merged_grams

#: Rows of a block, and bytes of coefficients that meet one block at once.
BLOCK_ROWS, COEFFICIENT_BYTES = 2000, 64_000_000
LAMS = tuple(10.0**k for k in range(1, 7))


def inverse_density(y: np.ndarray, alpha: float = 1.0, width: float = 90.0) -> np.ndarray:
    """Weights of groups: inverse Gaussian density of y at each one's own, to the power alpha, scaled to mean 1."""
    if alpha == 0:
        return np.ones(len(y))
    w = (1 / np.maximum(np.exp(-0.5 * ((y[:, None] - y[None, :]) / width) ** 2).sum(axis=1), 1e-9)) ** alpha
    return w / w.mean()


def weighted_ridge(grams: np.ndarray, y: np.ndarray, w: np.ndarray, lams) -> np.ndarray:
    """(constant, slopes) for each lam. grams: groups x (1, x) squared, y and w one number each.

    Columns are standardised by the rows' own moments, without weights; the constant is the weighted mean of y at their means.
    """
    plain, weighted, toward = grams.sum(axis=0), np.tensordot(w, grams, 1), np.tensordot(w * y, grams[:, 0], 1)
    n, total = plain[0, 0], weighted[0, 0]
    mean = plain[0, 1:] / n
    sd = np.sqrt(np.clip(np.diag(plain)[1:] / n - mean * mean, 0, None))
    sd = np.where(sd > 1e-12, sd, 1.0)
    middle = toward[0] / total
    cross = np.outer(mean, weighted[0, 1:])
    a = (weighted[1:, 1:] - cross - cross.T + total * np.outer(mean, mean)) / np.outer(sd, sd)
    b = (toward[1:] - middle * weighted[0, 1:]) / sd
    value, vector = np.linalg.eigh(a)
    turned = vector.T @ b
    slopes = np.array([vector @ (turned / (np.clip(value, 0, None) + lam)) for lam in lams]) / sd
    return np.column_stack([middle - slopes @ mean, slopes])


def fold_coefficients(grams: np.ndarray, y: np.ndarray, fold: int, lams, alpha: float, width: float, kept=None):
    """(left-out group, coefficients): each inner group by the others but the fold's, and the fold's group by all others. kept: the groups that take part, all by default."""
    inner = np.array([k for k in (range(len(y)) if kept is None else kept) if k != fold])
    w = inverse_density(y[inner], alpha, width)
    for at, k in enumerate(inner if len(inner) > 1 else []):
        rest = np.delete(np.arange(len(inner)), at)
        yield int(k), weighted_ridge(grams[inner[rest]], y[inner[rest]], w[rest], lams)
    yield fold, weighted_ridge(grams[inner], y[inner], w, lams)


def packed(df: DataFrame, group: str, vector: str, y: str) -> tuple[DataFrame, pd.DataFrame]:
    """(blocks (grp, piece, pieces, n, x), groups (grp, n, y, pieces)). Rows with a null group, vector or y are left out."""
    known = df.where(F.col(group).isNotNull() & F.col(vector).isNotNull() & F.col(y).isNotNull())
    rows = known.select(F.col(group).cast("string").alias("grp"), F.col(vector).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"))
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.max(F.size("x")).alias("w"))
    groups = pd.DataFrame(sizes.limit(MOST_CELLS // 9 + 1).collect(), columns=["grp", "n", "y", "w"]).sort_values("grp", ignore_index=True)
    cells = len(groups) * (int(groups["w"].max()) + 1) ** 2 if len(groups) else 0
    if cells > MOST_CELLS:
        raise ValueError(f"{len(groups)} groups are too many for one fit: more than {MOST_CELLS} numbers")
    groups["pieces"] = -(-groups["n"] // BLOCK_ROWS)
    table = df.sparkSession.createDataFrame(groups[["grp", "pieces"]].values.tolist(), "grp string, pieces long")

    def pack(f):
        x = np.stack(f["x"].to_numpy()).astype(float)
        return pd.DataFrame({"grp": f["grp"][:1], "piece": f["piece"][:1], "pieces": f["pieces"][:1], "n": [len(x)], "x": [x.tobytes()]})

    dealt = rows.join(F.broadcast(table), "grp").withColumn("piece", F.pmod(F.monotonically_increasing_id(), F.col("pieces")))  # a row for each group
    return stored(dealt.groupBy("grp", "piece").applyInPandas(pack, "grp string, piece long, pieces long, n long, x binary"), "blocks"), groups


def block_grams(blocks: DataFrame) -> dict[str, np.ndarray]:
    """Each group's sum of outer products of (1, x)."""

    def run(frames):
        sums: dict = {}
        for f in frames:
            for g, n, b in zip(f["grp"], f["n"], f["x"], strict=True):
                x = np.column_stack([np.ones(n), np.frombuffer(b).reshape(n, -1)])
                sums[g] = sums.get(g, 0) + x.T @ x
        if sums:
            yield pd.DataFrame({"grp": list(sums), "gram": [s.tobytes() for s in sums.values()]})

    return merged_grams(blocks.select("grp", "n", "x").mapInPandas(run, "grp string, gram binary"))


def dealt_labels(y: np.ndarray, draws: int, strata: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """(draws + 1) x groups: the true labels, then labels dealt anew, within strata where given. Strata of None keep theirs."""
    out = np.tile(y, (draws + 1, 1))
    for draw in range(draws):
        rng = np.random.default_rng([seed, draw])
        for s in [None] if strata is None else sorted({x for x in strata if x is not None}):
            at = np.arange(len(y)) if strata is None else np.flatnonzero(strata == s)
            out[draw + 1, at] = y[rng.permutation(at)]
    return out


def exact_medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., n, med, sd): medians by rank. Rows are dealt to ranges of (by..., value), so a group of any size is spread; only counts of ranges meet."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.where(F.col(value).isNotNull()).select(*by, value).repartitionByRange(parts, *by, value).withColumn("_p", F.spark_partition_id()), "ranges")
    ranges = dealt.groupBy(*by, "_p").agg(F.count("*").alias("_c"))
    key = Window.partitionBy(*by)
    ranges = ranges.select(*by, "_p", F.sum("_c").over(key).alias("_n"), (F.sum("_c").over(key.orderBy("_p")) - F.col("_c")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*by, "_p").orderBy(value)) + F.col("_before")
    middle = dealt.join(ranges, [*by, "_p"]).withColumn("_r", rank).where((F.col("_r") == F.floor((F.col("_n") + 1) / 2)) | (F.col("_r") == F.floor((F.col("_n") + 2) / 2)))
    spread = dealt.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_pop(value).alias("sd"))
    return middle.groupBy(*by).agg(F.avg(value).alias("med")).join(spread, by).select(*by, "n", "med", "sd")


SCORED = "draw int, fold int, grp string, lam int, n long, value double, sd double"


def _scored(width: int, lams: int):
    def run(left, right):
        out = []
        for _, block in left.iterrows():
            x = np.column_stack([np.ones(block["n"]), np.frombuffer(block["x"]).reshape(block["n"], -1)])
            for draw, fold, b in zip(right["draw"], right["fold"], right["betas"], strict=True):
                p = x @ np.frombuffer(b).reshape(lams, width + 1).T
                out.append(pd.DataFrame({"draw": draw, "fold": fold, "grp": block["grp"], "lam": np.arange(lams), "n": len(p), "value": np.median(p, axis=0), "sd": p.std(axis=0)}))
        names = [c.split()[0] for c in SCORED.split(", ")]
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names)

    return run


#: Values of a sorted run that stand for it, and values of a group that one task gets at most, as far as they differ.
SPLITTERS, MOST_VALUES = 64, 20_000
PARTS = "draw int, fold int, grp string, lam int, n long, below long, mean double, squares double, inside long, values binary, counts binary"


def _places(n: int) -> np.ndarray:
    """Places of the values that stand for n sorted ones, first and last included."""
    return np.arange(n) if n <= SPLITTERS else np.unique(np.linspace(0, n - 1, SPLITTERS).round().astype(int))


def _parted(width: int, lams: int, whole: bool):
    """For each piece and fit: how many predictions lie below its bounds, and of those inside the different ones with their counts (whole) or those that stand for them."""

    def run(left, right):
        rows = []
        if len(left) and len(right):
            betas = np.concatenate([np.frombuffer(b).reshape(lams, width + 1) for b in right["betas"]])
            low, high = np.concatenate([np.frombuffer(b).reshape(2, lams) for b in right["bounds"]], axis=1)
            for n, b, g in zip(left["n"], left["x"], left["grp"], strict=True):
                p = np.column_stack([np.ones(n), np.frombuffer(b).reshape(n, -1)]) @ betas.T
                mean, squares = p.mean(axis=0), ((p - p.mean(axis=0)) ** 2).sum(axis=0)
                p = np.where(np.isnan(p), np.inf, p)
                for k, v in enumerate(p.T):
                    inside = np.sort(v[(v >= low[k]) & (v <= high[k])])
                    values, counts = np.unique(inside, return_counts=True) if whole else (inside[_places(len(inside))], np.empty(0, int))
                    at, lam = divmod(k, lams)
                    rows.append((right["draw"].iat[at], right["fold"].iat[at], g, lam, n, int((v < low[k]).sum()), mean[k], squares[k], len(inside), values.tobytes(), counts.astype(np.int64).tobytes()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PARTS.split(", ")])

    return run


def _bounds(lams: int):
    """(low, high) of each lam between which the middle values lie for certain: ranks of values that stand for others are known but for the gap to the next."""

    def run(key, f):
        out = np.tile([[-np.inf], [np.inf]], lams)
        for lam, own in f.groupby("lam"):
            n, below = own["n"].sum(), own["below"].sum()
            value, least, most = [], [], []
            for inside, b in zip(own["inside"], own["values"], strict=True):
                at = _places(inside)
                value.append(np.frombuffer(b))
                least.append(np.diff(at, prepend=-1))  # values up to this one that are surely there
                most.append(np.diff(at, append=inside))  # values after this one that may lie before the next
            value, least, most = map(np.concatenate, (value, least, most))
            order = np.argsort(value, kind="stable")
            value, least, most = value[order], least[order].cumsum(), most[order].cumsum()
            first, last = (n + 1) // 2 - below, (n + 2) // 2 - below
            before = np.searchsorted(value, value, "left")  # those strictly below
            fewer = np.where(before > 0, most[before - 1], 0)
            out[:, int(lam)] = value[np.flatnonzero(fewer < first).max()], value[np.flatnonzero(least >= last).min()]
        return pd.DataFrame({"draw": [key[0]], "fold": [key[1]], "grp": [key[2]], "bounds": [out.tobytes()]})

    return run


def _middle(key, f):
    n, below = f["n"].sum(), f["below"].sum()
    value, count = (np.concatenate([np.frombuffer(b, t) for b in f[c]]) for c, t in (("values", float), ("counts", np.int64)))
    order = np.argsort(value, kind="stable")
    ends = count[order].cumsum()
    med = np.mean([value[order][np.searchsorted(ends, r - below)] for r in ((n + 1) // 2, (n + 2) // 2)])
    mean = (f["n"] * f["mean"]).sum() / n
    sd = math.sqrt((f["squares"] + f["n"] * (f["mean"] - mean) ** 2).sum() / n)
    return pd.DataFrame({"draw": [key[0]], "fold": [key[1]], "grp": [key[2]], "lam": [key[3]], "n": [n], "med": [med], "sd": [sd]})


def _medians_of_pieces(blocks: DataFrame, right: DataFrame, columns: int, lams: int, largest: int) -> DataFrame:
    """(draw, fold, grp, lam, n, med, sd) of groups in several pieces: a pass over the blocks gives bounds from a few values of each piece, and another gets the values
    between them (after more such passes, if a group is so large that these are still too many). So a small share of the predictions is stored. right: (draw, fold, grp, betas, piece, shard)."""
    everything = np.tile([[-np.inf], [np.inf]], lams).tobytes()
    right = right.withColumn("bounds", F.lit(everything))
    key, fit = ["grp", "piece", "shard"], ["draw", "fold", "grp"]
    left, tasks = blocks.groupBy(*key), 2 * blocks.sparkSession.sparkContext.defaultParallelism  # given, as these rows are few bytes but much work
    while largest > 0:
        parts = stored(left.cogroup(right.groupBy(*key)).applyInPandas(_parted(columns, lams, False), PARTS), "splitters")
        bounds = stored(parts.repartition(tasks, *fit).groupBy(*fit).applyInPandas(_bounds(lams), "draw int, fold int, grp string, bounds binary"), "bounds")
        right = right.drop("bounds").join(bounds, fit)
        largest = largest // (SPLITTERS // 4) if largest > MOST_VALUES * (SPLITTERS // 4) else 0
    parts = stored(left.cogroup(right.groupBy(*key)).applyInPandas(_parted(columns, lams, True), PARTS), "inside")
    return parts.repartition(tasks, *fit, "lam").groupBy(*fit, "lam").applyInPandas(_middle, "draw int, fold int, grp string, lam int, n long, med double, sd double")


def medians(blocks: DataFrame, groups: pd.DataFrame, labels: np.ndarray, lams=LAMS, alpha: float = 1.0, width: float = 90.0, subsets: list[tuple[list[int], list[int]]] | None = None) -> tuple[DataFrame, DataFrame]:
    """((draw, fold, grp, lam, n, med, sd): the median prediction of every group left out, for each lam, within every fold of every draw; their coefficients). labels: draws x groups.

    subsets: for each draw the groups and the columns that take part.
    """
    spark = blocks.sparkSession
    grams = block_grams(blocks)
    names = list(groups["grp"])
    shared = spark.sparkContext.broadcast((np.array([grams[g] for g in names]), labels))
    columns = len(grams[names[0]]) - 1

    def solve(frames):
        sums, y = shared.value
        for f in frames:
            for k in f["id"]:
                draw, fold = divmod(int(k), len(names))
                if subsets is None:
                    got = list(fold_coefficients(sums, y[draw], fold, lams, alpha, width))
                elif fold in subsets[draw][0]:
                    kept, at = subsets[draw][0], np.array([0, *(c + 1 for c in subsets[draw][1])])
                    got = []
                    for g, own in fold_coefficients(sums[:, at[:, None], at], y[draw], fold, lams, alpha, width, kept):
                        whole = np.zeros((len(lams), columns + 1))
                        whole[:, at] = own
                        got.append((g, whole))
                else:
                    continue
                yield pd.DataFrame({"draw": draw - 1, "fold": fold, "grp": [names[g] for g, _ in got], "betas": [b.tobytes() for _, b in got]})

    todo = len(labels) * len(names)
    folds = spark.range(0, todo, 1, min(todo, 4096))
    coefficients = stored(folds.mapInPandas(solve, "draw int, fold int, grp string, betas binary"), "coefficients")
    shards = max(min(len(labels), 8), math.ceil(len(labels) * len(names) * len(lams) * (columns + 1) * 8 / COEFFICIENT_BYTES))
    pieces = spark.createDataFrame(groups[["grp", "pieces"]].values.tolist(), "grp string, pieces long")
    right = coefficients.join(F.broadcast(pieces), "grp").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))  # a row for each group
    right = right.select("draw", "fold", "grp", "betas", "piece", "pieces", F.pmod("draw", F.lit(shards)).alias("shard"))
    left = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    key, out = ["grp", "piece", "shard"], []
    if int(groups["pieces"].min()) == 1:
        scored = left.where("pieces = 1").groupBy(*key).cogroup(right.where("pieces = 1").groupBy(*key)).applyInPandas(_scored(columns, len(lams)), SCORED)
        out.append(stored(scored, "scored").select("draw", "fold", "grp", "lam", "n", F.col("value").alias("med"), "sd"))
    if int(groups["pieces"].max()) > 1:
        out.append(stored(_medians_of_pieces(left.where("pieces > 1"), right.where("pieces > 1").drop("pieces"), columns, len(lams), int(groups["n"].max())), "medians"))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1]), coefficients


def nested_fit(df: DataFrame, group: str, vector: str, y: str, lams=LAMS, alpha: float = 1.0, width: float = 90.0, draws: int = 0, stratum: str | None = None, seed: int = 0) -> DataFrame:
    """(draw, grp, n, truth, lam, raw, sd, pred): each group by the fit without it; draw -1 has the true labels, the others deal them anew (within strata: a column with one value a group).

    raw is the median of the rows' predictions and sd their deviation at the fold's lam; pred is raw stretched about its mean to the truth's
    deviation, by 0.5 to 8. Of equal lams the first counts. Fewer than three groups give no row; equal predictions aren't stretched.
    """
    spark = df.sparkSession
    ship(spark)
    schema = "draw int, grp string, n long, truth double, lam double, raw double, sd double, pred double"
    blocks, groups = packed(df, group, vector, y)
    if len(groups) < 3:
        return spark.createDataFrame([], schema)
    names, truth = list(groups["grp"]), groups["y"].to_numpy(float)
    strata = None
    if stratum:
        found = dict(df.where(F.col(group).isNotNull()).groupBy(F.col(group).cast("string")).agg(F.min(F.col(stratum).cast("string"))).collect())
        strata = np.array([found.get(g) for g in names], object)
    labels = dealt_labels(truth, draws, strata, seed)
    med, _ = medians(blocks, groups, labels, lams, alpha, width)
    return _chosen(med, names, labels, lams)


def _chosen(med: DataFrame, names: list[str], labels: np.ndarray, lams) -> DataFrame:
    """The fits of medians: lam by the inner groups' errors, then the calibrated prediction of each fold's group."""
    spark = med.sparkSession
    dealt = spark.createDataFrame([(k - 1, j, g, float(labels[k, j])) for k in range(len(labels)) for j, g in enumerate(names)], "draw int, own int, grp string, truth double")
    met = med.join(dealt, ["draw", "grp"])
    error = met.where("fold <> own").groupBy("draw", "fold", "lam").agg(F.avg(F.abs(F.col("med") - F.col("truth"))).alias("error"))
    best = error.groupBy("draw", "fold").agg(F.min(F.struct(F.round("error", 9).alias("error"), "lam")).alias("b")).select("draw", F.col("fold").alias("own"), F.col("b.lam").alias("lam"))
    outer = met.where("fold = own").join(best, ["draw", "own", "lam"])
    own = Window.partitionBy("draw")  # a row for each group
    stretch = F.when(F.stddev_pop("med").over(own) > 0, F.least(F.greatest(F.stddev_pop("truth").over(own) / F.stddev_pop("med").over(own), F.lit(0.5)), F.lit(8.0))).otherwise(1.0)
    pred = F.avg("truth").over(own) + stretch * (F.col("med") - F.avg("med").over(own))
    value = F.element_at(F.array(*[F.lit(float(x)) for x in lams]), F.col("lam") + 1)
    return outer.select("draw", "grp", "n", "truth", value.alias("lam"), F.col("med").alias("raw"), "sd", pred.alias("pred"))


@dataclass(frozen=True)
class Scenario:
    """A nested fit on some columns (all by default), without some groups, with some groups' y moved."""

    columns: tuple[int, ...] | None = None
    drop: tuple[str, ...] = ()
    shift: dict[str, float] = field(default_factory=dict)


def grid(columns: dict[str, tuple[int, ...] | None], drops: dict[str, tuple[str, ...]], shifts: dict[str, dict[str, float]] | None = None) -> dict[str, Scenario]:
    """Every combination, named by its parts."""
    return {" | ".join((c, d, *((m,) if shifts else ()))): Scenario(columns[c], drops[d], (shifts or {"": {}})[m]) for c in columns for d in drops for m in (shifts or {"": {}})}


def nested_scenarios(df: DataFrame, group: str, vector: str, y: str, scenarios: dict[str, Scenario], lams=LAMS, alpha: float = 1.0, width: float = 90.0) -> DataFrame:
    """(scenario, draw, grp, n, truth, lam, raw, sd, pred): the whole nested fit under every scenario. Rows are packed and summed once; scenarios are solved in tasks like draws. Those that leave fewer than three groups have no row."""
    spark = df.sparkSession
    ship(spark)
    blocks, groups = packed(df, group, vector, y)
    names, truth = list(groups["grp"]), groups["y"].to_numpy(float)
    size = len(blocks.first()["x"]) // 8 // blocks.first()["n"] if names else 0
    held, labels, subsets = [], [], []
    for name, own in scenarios.items():
        kept = [k for k, g in enumerate(names) if g not in own.drop]
        if len(kept) >= 3:
            held.append(name)
            labels.append(truth + [own.shift.get(g, 0.0) for g in names])
            subsets.append((kept, list(range(size)) if own.columns is None else list(own.columns)))
    if not held:
        return spark.createDataFrame([], "scenario string, draw int, grp string, n long, truth double, lam double, raw double, sd double, pred double")
    med, _ = medians(blocks, groups, np.array(labels), lams, alpha, width, subsets)
    fits = _chosen(med, names, np.array(labels), lams)
    return fits.select(F.element_at(F.array(*[F.lit(n) for n in held]), F.col("draw") + 2).alias("scenario"), *fits.columns)


def fold_models(df: DataFrame, group: str, vector: str, y: str, lams=LAMS, alpha: float = 1.0, width: float = 90.0) -> DataFrame:
    """(grp, lam, beta, stretch, truth, raw): for each group the fit without it: constant and slopes at its lam, and the calibration by the other groups' predictions among themselves: truth + stretch x (prediction - raw)."""
    spark = df.sparkSession
    ship(spark)
    blocks, groups = packed(df, group, vector, y)
    schema = "grp string, lam double, beta array<double>, stretch double, truth double, raw double"
    if len(groups) < 3:
        return spark.createDataFrame([], schema)
    names, truth = list(groups["grp"]), groups["y"].to_numpy(float)
    med, coefficients = medians(blocks, groups, truth[None, :], lams, alpha, width)
    place = {g: k for k, g in enumerate(names)}
    inner = {(r["fold"], r["lam"]): [] for r in med.select("fold", "lam").distinct().collect()}
    for r in med.select("fold", "grp", "lam", "med").collect():  # groups x groups x lams
        if r["fold"] != place[r["grp"]]:
            inner[r["fold"], r["lam"]].append((truth[place[r["grp"]]], r["med"]))
    own = {r["fold"]: np.frombuffer(r["betas"]).reshape(len(lams), -1) for r in coefficients.where(F.element_at(F.array(*[F.lit(g) for g in names]), F.col("fold") + 1) == F.col("grp")).collect()}
    out = []
    for k, g in enumerate(names):
        each = [np.array(inner[k, i]) for i in range(len(lams))]
        lam = int(np.argmin([np.round(np.abs(e[:, 0] - e[:, 1]).mean(), 9) for e in each]))
        t, p = each[lam].T
        stretch = float(np.clip(t.std() / p.std(), 0.5, 8)) if p.std() > 0 else 1.0
        out.append((g, float(lams[lam]), [float(v) for v in own[k][lam]], stretch, float(t.mean()), float(p.mean())))
    return spark.createDataFrame(out, schema)


def fit_metrics(fits: DataFrame) -> DataFrame:
    """(draw, groups, mae, rho, pairs, pair) of nested_fit: rank correlation and the share of pairs of groups of unlike truth that are in order."""

    def run(f):
        t, p = f["truth"].to_numpy(float), f["pred"].to_numpy(float)
        a, b = f["truth"].rank().to_numpy(), f["pred"].rank().to_numpy()
        rho = float(np.corrcoef(a, b)[0, 1]) if a.std() > 0 and b.std() > 0 else 0.0
        i, j = np.triu_indices(len(t), 1)
        apart = t[i] != t[j]
        right = ((p[i] - p[j]) * (t[i] - t[j]) > 0)[apart]
        return pd.DataFrame({"draw": f["draw"][:1], "groups": [len(f)], "mae": [float(np.abs(t - p).mean())], "rho": [rho], "pairs": [int(apart.sum())], "pair": [float(right.mean()) if len(right) else None]})

    return fits.groupBy("draw").applyInPandas(run, "draw int, groups int, mae double, rho double, pairs int, pair double")  # groups of a draw


def null_p_values(metrics: DataFrame) -> DataFrame:
    """(statistic, observed, null_median, draws, p) for rho, pair (larger is better) and mae (smaller is): the share of draws at least as good, the fit itself counted."""
    long = metrics.select("draw", F.explode(F.array(*[F.struct(F.lit(k).alias("statistic"), F.col(k).alias("v"), F.lit(s).alias("s")) for k, s in (("rho", 1), ("pair", 1), ("mae", -1))])).alias("x")).select("draw", "x.*")
    seen = long.where("draw = -1").select("statistic", F.col("v").alias("observed"))
    met = long.where("draw >= 0").join(F.broadcast(seen), "statistic")  # three rows
    good = F.count_if(F.col("s") * F.col("v") >= F.col("s") * F.col("observed"))
    return met.groupBy("statistic").agg(F.first("observed").alias("observed"), F.median("v").alias("null_median"), F.count("*").alias("draws"), ((good + 1) / (F.count("*") + 1)).alias("p"))


def stratum_rho(fits: DataFrame, strata: DataFrame) -> DataFrame:
    """(draw, partial, groups): rank correlation of truth and prediction, both less their stratum's mean. strata: (grp, stratum); groups without one are left out."""
    own = fits.join(F.broadcast(strata.where("stratum IS NOT NULL")), "grp")  # a row for each group
    w = Window.partitionBy("draw", "stratum")
    c = own.select("draw", (F.col("truth") - F.avg("truth").over(w)).alias("t"), (F.col("pred") - F.avg("pred").over(w)).alias("p"))

    def run(f):
        a, b = f["t"].round(9).rank().to_numpy(), f["p"].round(9).rank().to_numpy()
        return pd.DataFrame({"draw": f["draw"][:1], "partial": [float(np.corrcoef(a, b)[0, 1]) if a.std() > 0 and b.std() > 0 else 0.0], "groups": [len(f)]})

    return c.groupBy("draw").applyInPandas(run, "draw int, partial double, groups int")
