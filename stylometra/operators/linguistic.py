"""Operators over word and annotated-token tables: cleaning, masks, function-word grams, profiles, feature matrices, removals."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import mean_rank, per_thousand


def nfc(text: Column) -> Column:
    """Canonical composition; Spark has no built-in for it."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def strip_points(text: Column, low: str, high: str) -> Column:
    """Without the characters of one range of code points."""
    return F.regexp_replace(text, f"[{low}-{high}]", "")


def clean_line(text: Column) -> Column:
    """Without (...) and [...]; only what follows the first no-break space, and only up to a closing direction mark."""
    t = F.regexp_replace(text, r"\([^)]*\)|\[[^\]]*\]", "")
    t = F.when(t.contains(" "), F.regexp_replace(t, "^[^ ]* ", "")).otherwise(t)
    return F.trim(F.substring_index(t, "‬", 1))


def words(text: Column) -> Column:
    """White-space parts, lower case, kept with their punctuation."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def mask(token: Column, closed: list[str], other: str = "·") -> Column:
    """Words of a closed class stay; every other word is one mark."""
    return F.when(token.isin(closed), token).otherwise(other)


def joined_grams(toks: DataFrame, by: list[str], order: list[str], closed: list[str], n: int, compact: bool) -> DataFrame:
    """n-grams of closed-class words. compact: other words go first, so that closed ones become neighbours; else a gram with another word is void."""
    own = toks.where(F.col("token").isin(closed)) if compact else toks.withColumn("token", F.when(F.col("token").isin(closed), F.col("token")))
    w = Window.partitionBy(*by).orderBy(*order)
    parts = own.select(*by, *[F.lead("token", k).over(w).alias(f"_{k}") if k else F.col("token").alias("_0") for k in range(n)])
    return parts.where(" AND ".join(f"_{k} IS NOT NULL" for k in range(n))).select(*by, F.concat_ws("·", *[f"_{k}" for k in range(n)]).alias("gram"))


def vocabulary_rates(items: DataFrame, unit: list[str], item: str, top: int) -> DataFrame:
    """(unit..., item, n, rate): counts and rates per 1000 of the `top` commonest items (ties by item) in each unit that has them."""
    counts = items.groupBy(*unit, item).agg(F.count("*").alias("n"))
    vocab = counts.groupBy(item).agg(F.sum("n").alias("_all")).orderBy(F.desc("_all"), item).limit(top).select(item)  # bounded by top
    total = counts.groupBy(*unit).agg(F.sum("n").alias("_t"))
    return counts.join(F.broadcast(vocab), item).join(total, unit).select(*unit, item, "n", per_thousand(F.col("n"), F.col("_t")).alias("rate"))


def select_features(rates: DataFrame, label: str, least_units: int, least_rho: float) -> DataFrame:
    """Of (unit, y, feature, value): features of enough units whose rank correlation with the label is strong enough (rho is rounded to 9 places, so that equal ones fall on one side)."""
    some = rates.groupBy("feature").agg(F.count_if(F.col("value") > 0).alias("units")).where(F.col("units") >= least_units)
    r = rates.join(some, "feature").select("feature", "units", mean_rank(["feature"], F.col("value")).alias("rx"), mean_rank(["feature"], F.col(label)).alias("ry"))
    return r.groupBy("feature", "units").agg(F.round(F.corr("rx", "ry"), 9).alias("rho")).where(F.abs("rho") >= least_rho)


def after_removal(counts: DataFrame, removed: DataFrame, unit: str, part: str, item: str) -> DataFrame:
    """Rates of (unit, item) summed again over the parts (verses, sentences) that are not removed."""
    left = counts.join(removed, [unit, part], "left_anti").groupBy(unit, item).agg(F.sum("n").alias("n"))
    return left.withColumn("rate", per_thousand(F.col("n"), F.sum("n").over(Window.partitionBy(unit))))


def order_shares(parts: DataFrame, clause: list[str], role: str, place: str, first: str, second: str) -> DataFrame:
    """For each clause whether its last part of one role stands before its last of the other; null unless it has both."""
    at = lambda r: F.max(F.when(F.col(role) == r, F.col(place)))
    return parts.groupBy(*clause).agg(at(first).alias("a"), at(second).alias("b")).select(*clause, (F.col("a") < F.col("b")).alias("in_order"), F.col("a").isNull().alias("lacks_first"))


def count_matrix(counts: DataFrame, unit: str, item: str, vocabulary: list[str]) -> DataFrame:
    """Wide: one column for each item of a given vocabulary, 0 where a unit lacks it."""
    return counts.groupBy(unit).pivot(item, vocabulary).agg(F.sum("n")).na.fill(0)
