"""Grouped model fits: ridge by subtracting groups' Gram matrices, generative inversion on a grid, cosine neighbours."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.tables import stored

#: Numbers that the driver may hold: groups x (columns + 2) squared.
MOST_CELLS = 100_000_000


def merged_grams(parts: DataFrame) -> dict[str, np.ndarray]:
    """parts: (grp, gram), square matrices as bytes, one for each task and group. Sums by group, added up in two levels, so no task holds more than about the root of the number of tasks of them.

    Raises ValueError if the sums have more than MOST_CELLS numbers: too many groups or columns for a fit on the driver.
    """
    parts = stored(parts, "grams")
    shape = parts.groupBy("grp").agg(F.count("*").alias("n"), F.max(F.octet_length("gram")).alias("size")).agg(F.count("*").alias("g"), F.max("size").alias("size"), F.max("n").alias("n")).head()
    if not shape["g"]:
        return {}
    if shape["g"] * shape["size"] > 8 * MOST_CELLS:
        raise ValueError(f"{shape['g']} groups of {shape['size']} bytes are too many for one fit: more than {MOST_CELLS} numbers")
    width = math.isqrt(shape["size"] // 8)

    def add(f):
        return pd.DataFrame({"grp": f["grp"][:1], "gram": [sum(np.frombuffer(b) for b in f["gram"]).tobytes()]})

    level = math.isqrt(shape["n"])
    if level > 2:
        parts = parts.withColumn("_k", F.pmod(F.xxhash64("gram"), F.lit(level))).groupBy("grp", "_k").applyInPandas(add, "grp string, gram binary")
    rows = parts.groupBy("grp").applyInPandas(add, "grp string, gram binary").collect()  # bounded above
    return {r["grp"]: np.frombuffer(bytes(r["gram"])).reshape(width, width).copy() for r in sorted(rows, key=lambda r: r["grp"])}


def group_grams(df: DataFrame, group: str, vector: str, y: str, weight: str | None = None) -> dict[str, np.ndarray]:
    """Each group's sums of outer products of (1, x, y), weighted if asked; rows with a null vector, y or weight are left out. One pass of rows: tasks write a matrix for each group, and these are added up before the driver gets them."""
    known = df.where(F.col(vector).isNotNull() & F.col(y).isNotNull()).select(group, vector, y, (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_weight")).where("_weight IS NOT NULL")

    def run(frames):
        sums: dict = {}
        for f in frames:
            for g, own in f.groupby(group):
                x = np.column_stack([np.ones(len(own)), np.stack(own[vector].to_numpy()).astype(float), own[y].to_numpy(float)])
                sums[g] = sums.get(g, 0) + x.T @ (x * own["_weight"].to_numpy()[:, None])
        if sums:
            yield pd.DataFrame({"grp": [str(g) for g in sums], "gram": [s.tobytes() for s in sums.values()]})

    return merged_grams(known.mapInPandas(run, "grp string, gram binary"))


def ridge_leave_group_out(df: DataFrame, group: str, vector: str, y: str, lams: list[float]) -> DataFrame:
    """(grp, lam, n, sse): each group predicted by the ridge fit on the others, whose Gram is the total less its own."""
    grams = group_grams(df, group, vector, y)
    if not grams:
        return df.sparkSession.createDataFrame([], "grp string, lam double, n long, sse double")
    size = len(next(iter(grams.values())))
    total, out = sum(grams.values()), []
    for g, own in grams.items():
        rest = total - own
        a, b, shrink = rest[:-1, :-1], rest[:-1, -1], np.eye(size - 1)
        shrink[0, 0] = 0
        for lam in lams:
            beta = np.linalg.solve(a + lam * shrink + 1e-12 * np.eye(size - 1), b)
            e = np.append(-beta, 1.0)
            out.append((g, float(lam), int(round(own[0, 0])), float(e @ own @ e)))
    return df.sparkSession.createDataFrame(out, "grp string, lam double, n long, sse double")


def generative_leave_one_out(units: DataFrame, grid: DataFrame) -> DataFrame:
    """units: (grp, y, feature, value), one value each; grid: (d). For each unit the grid point of the greatest likelihood under lines fitted without it."""
    folds = units.select(F.col("grp").alias("fold")).distinct()
    fit = folds.join(units, F.col("fold") != F.col("grp")).groupBy("fold", "feature").agg(
        F.regr_slope("value", "y").alias("b"), F.regr_intercept("value", "y").alias("a"),
        F.sqrt(F.greatest(F.regr_syy("value", "y") - F.pow(F.regr_sxy("value", "y"), 2) / F.regr_sxx("value", "y"), F.lit(1e-12)) / (F.count("*") - 2)).alias("s"),
    )
    own = units.join(fit.withColumnRenamed("fold", "grp"), ["grp", "feature"]).select("grp", "y", "value", "a", "b", "s")
    ll = own.join(F.broadcast(grid)).groupBy("grp", "y", "d").agg(F.sum(-F.ln("s") - 0.5 * F.pow((F.col("value") - F.col("a") - F.col("b") * F.col("d")) / F.col("s"), 2)).alias("ll"))
    return ll.groupBy("grp", "y").agg(F.max_by(F.col("d"), F.struct(F.round("ll", 9), -F.col("d"))).alias("pred"))


#: Vectors of a block of queries or of index rows, bytes of a block at most, and similarities that a task holds at once.
QUERY_BLOCK, INDEX_BLOCK, BLOCK_BYTES, HELD_COSINES = 32_000, 32_000, 16_000_000, 4_000_000
#: Blocks are not made smaller than this to give every core a pair of them.
LEAST_BLOCK = 1_000
#: Tasks that pairs of blocks are dealt to, at most.
MOST_PAIRS = 2_000
#: Similarities of a row of which only the greatest is compared first.
STRIP = 16


def stratified_folds(df: DataFrame, key: str, stratum: str, folds: int) -> DataFrame:
    """df with fold: rows of a stratum numbered in the order of the key's hash, modulo folds. Pieces of the hash's range are numbered apart and begin where the rows before them end, so that no task holds a whole stratum."""
    own = df.withColumn("_hash", F.xxhash64(key)).withColumn("_piece", F.shiftright("_hash", 58))
    ahead = Window.partitionBy("_stratum").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    sizes = own.groupBy(F.col(stratum).alias("_stratum"), F.col("_piece").alias("_from")).agg(F.count("*").alias("_n"))
    before = sizes.select("_stratum", "_from", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    numbered = own.withColumn("_row", F.row_number().over(Window.partitionBy(stratum, "_piece").orderBy("_hash", key)))
    placed = numbered.join(F.broadcast(before), F.col(stratum).eqNullSafe(F.col("_stratum")) & (F.col("_piece") == F.col("_from")))
    return placed.select(*df.columns, F.pmod(F.col("_before") + F.col("_row"), F.lit(folds)).cast("int").alias("fold"))


#: Rows of a part that a task passes for each level of the trees.
ROWS_OF_A_PART = 100_000


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """df in even parts: one for each core, or two, three and so on where they would have over ROWS_OF_A_PART rows. Library models send a table from each part, so that neither a part for each group nor many small ones are wanted."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * max(1, -(-rows // (cores * ROWS_OF_A_PART))))


def _vector_blocks(df: DataFrame, key: str, rows: int, name: str) -> tuple[DataFrame, int]:
    """((b, ids, v), number of blocks): vectors of df (key, v) in blocks of bounded size, ascending by key, without zero vectors; rows without a key or with a null in the vector are left out. Floats stay floats."""
    known = df.where(F.col(key).isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())).select(key, "v").where(F.size("v") > 0)
    kind = np.dtype(_stored_kind(df))
    if kind.itemsize == 8:
        known = known.withColumn("v", F.col("v").cast("array<double>"))
    size = known.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).head()
    count = max(1, -(-size["n"] // max(1, min(rows, BLOCK_BYTES // (kind.itemsize * (size["w"] or 1))))))
    cores = df.sparkSession.sparkContext.defaultParallelism
    count = max(count, min(math.isqrt(4 * cores), size["n"] // LEAST_BLOCK))

    def pack(f):
        f = f.sort_values(key, ignore_index=True)
        x = np.stack(f["v"].to_numpy()).astype(kind)
        with np.errstate(invalid="ignore", over="ignore"):
            kept = ~((x.astype(float) ** 2).sum(axis=1) <= 0)
        return pd.DataFrame({"b": f["b"][:1], "ids": [f[key][kept].tolist()], "v": [x[kept].tobytes()]})

    dealt = known.withColumn("b", F.pmod(F.xxhash64(key, "v"), F.lit(count)))
    return stored(dealt.groupBy("b").applyInPandas(pack, f"b long, ids array<{dict(df.dtypes)[key]}>, v binary"), name), count


def _stored_kind(df: DataFrame) -> str:
    return "float32" if dict(df.dtypes)["v"] == "array<float>" else "float64"


def _unit_rows(v: bytes, kind: str, rows: int) -> np.ndarray:
    """Stored vectors over their norms, as doubles."""
    x = np.frombuffer(v, kind).reshape(rows, -1).astype(float)
    with np.errstate(invalid="ignore", over="ignore"):
        return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _nearest(asked: np.ndarray, a: np.ndarray, ids: np.ndarray, b: np.ndarray, k: int):
    """(places of queries, places of rows, cosines): at least the k best rows of each query that aren't itself, ties by id. ids ascend."""
    low, high = np.searchsorted(ids, asked, "left"), np.searchsorted(ids, asked, "right")
    step, n = max(1, HELD_COSINES // len(ids)), len(ids)
    finite, few = np.isfinite(a).all() and np.isfinite(b).all(), min(k, n)
    strips = n // STRIP
    for at in range(0, len(asked), step):
        c = a[at : at + step] @ b.T
        if not finite:
            c[np.isnan(c)] = np.inf  # as in SQL, what is no number is the greatest
        for r in np.flatnonzero(low[at : at + step] < high[at : at + step]):
            c[r, low[at + r] : high[at + r]] = -np.inf
        # the k-th best of the strips' best is at most the k-th best of all
        top = c[:, : strips * STRIP].reshape(len(c), STRIP, strips).max(axis=1) if strips >= 4 * few else c
        least = np.partition(top, -few, axis=1)[:, -few]
        q, i = np.divmod(np.flatnonzero(c >= np.where(np.isfinite(least), least - 2e-9, least)[:, None]), n)
        if np.isneginf(least).any():
            q, i = q[c[q, i] > -np.inf], i[c[q, i] > -np.inf]
        own = np.round(c[q, i], 9)
        order = np.lexsort((i, -own, q))
        q, i, own = q[order], i[order], own[order]
        first = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
        yield at + q[first], i[first], own[first]


def cosine_neighbours(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(query, id, cosine, rank): the k nearest of index (id, v) to each query (query, v), ties by id; zero vectors have none. Every query meets every row but itself.

    Blocks of queries meet blocks of rows as matrices; only the k best of each query in a block of rows leave a task, and these are ranked.
    """
    ship(index.sparkSession)
    kinds, forms = (dict(queries.dtypes)["query"], dict(index.dtypes)["id"]), (_stored_kind(queries), _stored_kind(index))
    (left, asked), (right, rows) = _vector_blocks(queries.select("query", "v"), "query", QUERY_BLOCK, "queries"), _vector_blocks(index.select("id", "v"), "id", INDEX_BLOCK, "index")
    left = left.select(F.col("b").alias("q"), "ids", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))).alias("i"))
    right = right.select(F.col("b").alias("i"), "ids", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asked - 1).cast("long"))).alias("q"))

    def run(f, g):
        out = []
        for qs, a in zip(f["ids"], f["v"], strict=True):
            for ids, b in zip(g["ids"], g["v"], strict=True):
                if len(qs) and len(ids):
                    qs, ids = np.asarray(qs), np.asarray(ids)
                    for q, i, c in _nearest(qs, _unit_rows(a, forms[0], len(qs)), ids, _unit_rows(b, forms[1], len(ids)), k):
                        out.append(pd.DataFrame({"query": qs[q], "id": ids[i], "cosine": np.where(np.isinf(c), np.nan, c)}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "id": [], "cosine": []})

    # a number of our own, as small blocks that take long must not be put together in few tasks
    left, right = (x.repartition(min(asked * rows, MOST_PAIRS), "q", "i") for x in (left, right))
    best = left.groupBy("q", "i").cogroup(right.groupBy("q", "i")).applyInPandas(run, f"query {kinds[0]}, id {kinds[1]}, cosine double")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "id"))).where(F.col("rank") <= k)
