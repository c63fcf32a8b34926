"""Staged selection among sparse counts: prevalence, rank correlation with the units' dates, step-up, leave-one-out signs, a cap.

Counts are kept as (unit, item, n) of what occurs. A unit without an item counts as 0; these zeros are one group of ties in the ranks, so they
are never rows. Items have at most one row for each unit; units are a small table, whose ranks are sent to every task.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.tables import stored
from .features import step_up

#: Units that a selection may have: their ranks are held by every task.
MOST_UNITS = 20_000


#: Characters of text that are counted at once, and different grams that a task holds (letters of a task have numbers below 2^15).
COUNTED_CHARACTERS, HELD_GRAMS, LETTERS = 4_000_000, 2_000_000, 1 << 15


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers of (numbers, counts) with the sums of their counts."""
    codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts, first)


def gram_counts(docs: DataFrame, unit: str, text: str, sizes: tuple[int, ...] = (3, 4)) -> DataFrame:
    """(unit, item, n) of all character n-grams (n up to 4) of each text; grams don't cross texts. Null texts and units are left out.

    Characters get small numbers and grams are sorted as numbers; a task holds the counts of up to HELD_GRAMS different ones over its batches, so only these become strings.
    """
    if max(sizes) > 4:
        raise ValueError("n-grams of more than 4 characters")
    ship(docs.sparkSession)

    def run(batches):
        place, letters = np.full(0x110000, -1, np.int32), []
        held: dict = {}  # (unit, size) -> [(numbers, counts)]

        def batch_of(key, items, counts):
            return pa.RecordBatch.from_arrays([pa.repeat(key, len(items)), pa.array(items, pa.string()), pa.array(counts, pa.int64())], names=[unit, "item", "n"])

        def add(key, texts):
            points = np.frombuffer("\x00".join(texts).encode("utf-32-le"), np.uint32)
            seen = np.zeros(0x110000, bool)
            seen[points] = True
            new = np.flatnonzero(seen & (place < 0))
            if len(letters) + len(new) > LETTERS:
                yield from made()
                new = np.flatnonzero(seen)
            if len(new) > LETTERS:  # too many different characters for 15 bits
                found = Counter(t[i : i + size] for size in sizes for t in texts for i in range(len(t) - size + 1))
                yield batch_of(key, list(found), list(found.values()))
                return
            place[new] = np.arange(len(letters), len(letters) + len(new))
            letters.extend(new.tolist())
            bits = max(1, (len(letters) - 1).bit_length())
            ends, code = np.cumsum([len(t) + 1 for t in texts])[:-1] - 1, place[points]
            for size in sizes:
                n = len(points) - size + 1
                if n <= 0:
                    continue
                kind = np.uint32 if bits * size <= 32 else np.uint64
                gram, whole = np.zeros(n, kind), np.ones(n, bool)
                for k in range(size):
                    gram = (gram << kind(bits)) + code[k : k + n].astype(kind)
                for k in range(size):  # places that hold the end of a text
                    at = ends - k
                    whole[at[(at >= 0) & (at < n)]] = False
                own, count = np.unique(gram[whole], return_counts=True)
                wide = np.zeros(len(own), np.uint64)
                for k in range(size):  # 15 bits a letter, whatever this text needs
                    wide |= ((own >> kind(bits * k)) & kind((1 << bits) - 1)).astype(np.uint64) << np.uint64(15 * k)
                if len(own):
                    held.setdefault((key, size), []).append((wide, count))

        def made():
            """The counts so far, which are then no longer held."""
            points = np.array(letters, "<u4")
            for (key, size), parts in held.items():
                own, count = _summed(parts)
                whole = np.stack([points[(own >> np.uint64(15 * (size - 1 - k))) & np.uint64(0x7FFF)] for k in range(size)], axis=1).tobytes().decode("utf-32-le")
                yield batch_of(key, [whole[i : i + size] for i in range(0, len(whole), size)], count)
            held.clear(), letters.clear(), place.fill(-1)

        waiting: dict = {}

        def work():
            for key, texts in waiting.items():
                yield from add(key, texts)
            waiting.clear()
            if sum(len(c) for parts in held.values() for c, _ in parts) >= 2 * HELD_GRAMS:
                held.update({k: [_summed(parts)] for k, parts in held.items()})
                if sum(len(parts[0][0]) for parts in held.values()) >= HELD_GRAMS:
                    yield from made()

        size = 0
        for batch in batches:
            for key, t in zip(batch.column(0), batch.column(1), strict=True):
                t = t.as_py()
                waiting.setdefault(key, []).append(t)
                size += len(t)
                if size >= COUNTED_CHARACTERS:
                    yield from work()
                    size = 0
        yield from work()
        yield from made()

    own = docs.where(F.col(unit).isNotNull() & F.col(text).isNotNull()).select(unit, F.col(text).alias("text"))
    return own.mapInArrow(run, f"`{unit}` {dict(docs.dtypes)[unit]}, item string, n long").groupBy(unit, "item").agg(F.sum("n").alias("n"))


def correlation_p(rho: Column, n: int) -> Column:
    """Two-sided p of a correlation of n pairs by t with n - 2 degrees of freedom, as a finite sum; null for fewer than 3."""
    df = n - 2

    def run(r: pd.Series) -> pd.Series:
        a = np.minimum(np.abs(r.to_numpy(float)), 1.0)
        if df < 1:
            return pd.Series(np.full(len(a), np.nan))
        c, term, total = 1 - a * a, np.ones(len(a)), np.zeros(len(a))
        even = df % 2 == 0
        for k in range(df // 2):
            total += term
            term = term * c * ((2 * k + 1) / (2 * k + 2) if even else (2 * k + 2) / (2 * k + 3))
        p = 1 - a * total if even else 1 - 2 / np.pi * (np.arcsin(a) + a * np.sqrt(c) * total)
        return pd.Series(np.clip(p, 0, 1))

    return F.pandas_udf(run, "double")(rho)


#: Numbers that a task holds of a table of items by units, or of items by units by units.
HELD_CELLS = 2_000_000


def leave_one_out_shares(x: np.ndarray, y_rank: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row of x (items by units) the units whose removal leaves the sign of the rank correlation, over one less than the units; a removal that leaves a row constant doesn't count.

    Ranks without a unit are the ranks less one for each greater value and half for each equal one. Ranks are halves, so these sums are exact.
    """
    m, n = x.shape
    rank = pd.DataFrame(x).rank(axis=1).to_numpy()
    sign = np.sign(n * (rank @ y_rank) - rank.sum(axis=1) * y_rank.sum())
    kept, step = np.zeros(m), max(1, HELD_CELLS // max(m * n, 1))
    for at in range(0, n, step):
        gone = np.arange(at, min(at + step, n))
        gap = x[:, gone, None]
        a = rank[:, None, :] - (x[:, None, :] > gap) - (x[:, None, :] == gap) / 2
        b = y_rank - (y > y[gone, None]) - (y == y[gone, None]) / 2
        own = np.arange(len(gone))
        a[:, own, gone], b[own, gone] = np.nan, 0
        differ = np.fmin.reduce(a, axis=2) < np.fmax.reduce(a, axis=2)
        a[:, own, gone] = 0
        kept += (differ & (np.sign((n - 1) * np.einsum("igk,gk->ig", a, b) - a.sum(axis=2) * b.sum(axis=1)) == sign[:, None])).sum(axis=1)
    return kept / (n - 1)


def _dense(batch: pa.RecordBatch, n: int, cells: int):
    """(slice of the batch, its values by units) of rows with lists _k of units and _v of values; a unit that a row lacks has 0."""
    step = max(1, HELD_CELLS // max(cells, 1))
    for at in range(0, batch.num_rows, step):
        own = batch.slice(at, step)
        k, v = own.column("_k"), own.column("_v")
        x = np.zeros((own.num_rows, n))
        x[np.repeat(np.arange(own.num_rows), k.value_lengths().to_numpy()), k.flatten().to_numpy()] = np.nan_to_num(v.flatten().to_numpy(), nan=np.inf, posinf=np.inf)
        yield own, x


def select(rates: DataFrame, units: DataFrame, unit: str, item: str, value: str, least: int = 8, alpha: float = 0.1, stable: float = 0.65, most: int = 120) -> DataFrame:
    """(item, units, rho, p, stage, place): every item in at least so many units, with the last stage it reaches: prevalent, significant, stable, selected; place is its rank among the selected.

    rates: (unit, item, value above 0), one row each; units: (unit, y), all units. Null y leaves a unit out. Equal correlations are ordered by item.
    """
    known = sorted(((r[0], float(r[1])) for r in units.where(F.col(unit).isNotNull() & F.col("y").isNotNull()).select(unit, "y").limit(MOST_UNITS + 1).collect()), key=lambda r: str(r[0]))
    if len(known) > MOST_UNITS:
        raise ValueError(f"more than {MOST_UNITS} units")
    spark, n = rates.sparkSession, len(known)
    ship(spark)
    y = np.array([v for _, v in known])
    y_rank = pd.Series(y).rank().to_numpy() if n else y
    kind = dict(rates.dtypes)[unit]
    table = F.broadcast(spark.createDataFrame([(u, k) for k, (u, _) in enumerate(known)], f"`{unit}` {kind}, _k int"))  # at most MOST_UNITS rows
    own = rates.where(F.col(value) > 0).join(table, unit).select(F.col(item).alias("item"), F.struct("_k", F.col(value).cast("double").alias("_v")).alias("_x"))
    held = own.groupBy("item").agg(F.count("*").alias("units"), F.collect_list("_x").alias("_x")).where(F.col("units") >= least)  # at most one for each unit
    middle = n * ((n + 1) / 2) ** 2
    square = float((y_rank**2).sum()) - middle

    def correlated(batches):
        for batch in batches:
            for part, x in _dense(batch, n, n):
                rank = pd.DataFrame(x).rank(axis=1).to_numpy()
                cross, spread = rank @ y_rank - middle, np.sqrt(((rank * rank).sum(axis=1) - middle) * square)
                rho = np.divide(cross, spread, out=np.zeros(len(x)), where=spread > 0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rho, mask=~(spread > 0))], names=[*part.schema.names, "rho"])

    # one row for each item, stored: texts are counted once, whatever follows
    found = held.select("item", "units", "_x._k", "_x._v").mapInArrow(correlated, f"`item` {dict(own.dtypes)['item']}, units long, _k array<int>, _v array<double>, rho double")
    scored = found.withColumn("rho", F.round("rho", 12))
    scored = stored(scored.withColumn("p", F.round(correlation_p(F.col("rho"), n), 12)), "scored")
    tested = step_up(scored.select(F.col("item").alias("feature"), "p"), alpha).select(F.col("feature").alias("item"), "accepted")
    scored = scored.join(tested, "item", "left")

    def shares(batches):
        for batch in batches:
            for part, x in _dense(batch, n, n * n):
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(leave_one_out_shares(x, y_rank, y))], names=["item", "rho", "share"])

    accepted = scored.where("accepted").select("item", "rho", "_k", "_v").mapInArrow(shares, f"`item` {dict(own.dtypes)['item']}, rho double, share double")
    passed = stored(accepted.where(F.col("share") >= stable), "passed")
    best = passed.orderBy(F.desc(F.abs("rho")), "item").limit(most)  # bounded by most
    chosen = spark.createDataFrame([(r["item"], k + 1) for k, r in enumerate(best.collect())], "item string, place int")
    out = scored.join(passed.select("item", "share"), "item", "left").join(F.broadcast(chosen), "item", "left")
    stage = F.when(F.col("place").isNotNull(), "selected").when(F.col("share").isNotNull(), "stable").when(F.col("accepted"), "significant").otherwise("prevalent")
    return out.select("item", "units", "rho", "p", stage.alias("stage"), "place")
