"""Queries over the nested fit and its nulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..operators import nested as N
from ..operators import substitution as S
from ..sources.tables import stored, table
from .hierarchy import TOKENS
from .hierarchy import _tokens as annotated
from .registry import query, r6

LAMS = (10.0, 100.0, 1000.0, 10000.0)
WIDTH, DRAWS = 2.0, 60


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("label").alias("g"), "embedding", F.col("label").cast("double").alias("y"), (F.col("label") % 2).alias("kind"))


@query()
def vl2_nested_medians(spark, d):
    """Each group by the fit without it: lambda by the error of the inner groups' medians, weights made anew in each fold, predictions stretched to the truth's deviation."""
    fits = N.nested_fit(_vectors(spark, d), "g", "embedding", "y", LAMS, 1.0, WIDTH)
    return fits.select("grp", "n", "truth", "lam", r6("raw", "raw"), r6("sd", "sd"), r6("pred", "pred"))


@query()
def vl11_fit_null(spark, d):
    """Metrics of the whole nested fit with the groups' labels as they are (draw -1) and dealt anew."""
    fits = N.nested_fit(_vectors(spark, d), "g", "embedding", "y", LAMS, 1.0, WIDTH, DRAWS)
    return N.fit_metrics(fits).select("draw", r6("rho", "rho"), r6("pair", "pair"), r6("mae", "mae"))


@query()
def vl11_null_p_values(spark, d):
    fits = N.nested_fit(_vectors(spark, d), "g", "embedding", "y", LAMS, 1.0, WIDTH, DRAWS)
    return N.null_p_values(N.fit_metrics(fits)).select("statistic", r6("observed", "observed"), r6("null_median", "null_median"), "draws", r6("p", "p"))


@query()
def vl12_fit_null_within_strata(spark, d):
    """Labels are dealt within strata; the correlation is that of what is left of truth and prediction without their stratum's mean."""
    vectors = _vectors(spark, d)
    fits = N.nested_fit(vectors, "g", "embedding", "y", LAMS, 1.0, WIDTH, DRAWS, "kind")
    strata = vectors.where("g IS NOT NULL").groupBy(F.col("g").cast("string").alias("grp")).agg(F.min("kind").cast("string").alias("stratum"))
    return N.fit_metrics(fits).join(N.stratum_rho(fits, strata), "draw").select("draw", r6("rho", "rho"), r6("mae", "mae"), r6("partial", "partial"))


COLUMNS = {"all": None, "first half": tuple(range(32)), "even": tuple(range(0, 64, 2)), "last eight": tuple(range(56, 64))}
DROPS = {"none": (), "ends": ("0", "9"), "odd": ("1", "3", "5", "7", "9"), "middle": ("4", "5")}
SHIFTS = {"as they are": {}, "odd later": {str(g): 1.0 for g in range(1, 10, 2)}}


@query()
def vl19_red_team(spark, d):
    """The whole nested fit on every family of columns without every set of groups."""
    fits = N.nested_scenarios(_vectors(spark, d), "g", "embedding", "y", N.grid(COLUMNS, DROPS), LAMS, 1.0, WIDTH)
    names = fits.select("draw", "scenario").distinct()
    return N.fit_metrics(fits.drop("scenario")).join(names, "draw").select("scenario", "groups", r6("mae", "mae"), r6("rho", "rho"), "pairs", r6("pair", "pair"))


@query()
def vl19_anchor_fits(spark, d):
    """Each group's date by the whole nested fit with the groups' dates as they are, and with every other one moved."""
    fits = N.nested_scenarios(_vectors(spark, d), "g", "embedding", "y", N.grid({"all": None}, {"none": ()}, SHIFTS), LAMS, 1.0, WIDTH)
    return fits.select("scenario", "grp", "truth", "lam", r6("raw", "raw"), r6("pred", "pred"))


#: Late forms and what takes their place; the second entry is a new part of speech.
SUBSTITUTIONS = {">NJ": (">NKJ", None), "L>": (">L", "advb"), "QHL/": ("<DH/", None), "C": (">CR", "conj"), "NXNW": (">NXNW", None)}
RATES = [0.0, 0.25, 0.5, 1.0]


def _chunks(spark, d):
    """Annotated tokens by unit and chunk, marked for substitution."""
    by = ["chunk", "grp"]  # what differs most goes first, which makes sorts cheap
    tokens = annotated(spark, d).withColumn("grp", F.col("unit").cast("string")).withColumn("chunk", F.expr("clause div 400"))
    return by, S.marked(tokens.select(*by, "word", "lex", "sp"), by, SUBSTITUTIONS, ["word"])


_SWAP = " ".join(f"WHEN lex = '{a}' THEN '{b}'" for a, (b, _) in SUBSTITUTIONS.items())
_SWAP_SP = " ".join(f"WHEN lex = '{a}' THEN '{b}'" for a, (_, b) in SUBSTITUTIONS.items() if b)


@query(f"WITH {TOKENS}, r(rate) AS (VALUES {', '.join(f'({r}::DOUBLE)' for r in RATES)}), m AS (SELECT unit, clause // 400 AS chunk, word, rate, lex AS l0, sp AS s0, CASE WHEN u < rate THEN coalesce(CASE {_SWAP} END, lex) ELSE lex END AS lex, CASE WHEN u < rate THEN coalesce(CASE {_SWAP_SP} END, sp) ELSE sp END AS sp FROM (SELECT *, ('0x' || substr(md5(word::VARCHAR), 1, 7))::BIGINT / 268435456.0::DOUBLE AS u FROM tokens), r), p AS (SELECT rate, lex, sp, sp || '|' || lead(sp) OVER (PARTITION BY unit, chunk, rate ORDER BY word, l0, s0) AS pb FROM m), i AS (SELECT rate, 'lex' AS family, lex AS item FROM p UNION ALL SELECT rate, 'pos', sp FROM p UNION ALL SELECT rate, 'pb', pb FROM p) SELECT rate, family, item, count(*) AS n FROM i WHERE item IS NOT NULL GROUP BY ALL")
def vl22_counts_at_rates(spark, d):
    """Counts of lexemes, parts of speech and their bigrams with late forms replaced at each rate, from stored counts and what changes."""
    by, tokens = _chunks(spark, d)
    return S.at_rates(S.counts(tokens, by, []), S.deltas(tokens, by, RATES, []), [], RATES).select("rate", "family", "item", "n")


@query()
def vl22_redated(spark, d):
    """Each unit's date by the fit without it, with late forms replaced at each rate."""
    by, tokens = _chunks(spark, d)
    base = stored(S.counts(tokens, by, []), "counts")
    top = H.commonest(base, {"lex": 40, "pos": 10, "pb": 20}).select("family", "item").distinct().orderBy("family", "item").collect()  # at most 70 rows
    words = [(r["family"], r["item"]) for r in top]
    rows = stored(S.rate_vectors(tokens, by, words, RATES), "vectors")
    models = N.fold_models(rows.where(F.col("rate") == 0).withColumn("y", F.col("grp").cast("double")), "grp", "x", "y", LAMS, 1.0, 4.0)
    return S.redated(rows.select("grp", "rate", "x"), ["grp", "rate"], models).select("grp", "rate", "n", r6("raw", "raw"), r6("pred", "pred"))
