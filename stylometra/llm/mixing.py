"""Mixing sources to target weights with soft membership, by DataFrame operations alone.

A naive Bayes classifier over hashed words, fitted on a table of labelled documents, gives each document a posterior
over domains. Projected-gradient least squares then finds nonnegative document rates whose expected tokens by domain
match the targets: each round is one aggregation over the table of posteriors, and a document's rate is recomputed from
the (few) errors of the rounds so far, so nothing of the size of the corpus is sent or held.

Fitting takes at most `sample` labelled rows, those of the least hash of doc_id. Null labels are no labels; null and
empty texts have no tokens: their posterior is that of the labels, their rate 1 at most changes nothing. Rows of one
doc_id are one document; rows without one are, if their texts are equal. A domain of the targets that no labelled row has cannot be met and is left out. Other columns
are not read; an empty table, or no labels, gives an empty result.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, materialize, texts, without_keys

BUCKETS, SAMPLE, EVIDENCE = 4096, 3000, 50


def words(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep..., bucket): a row for each word; null for texts without words."""
    plain = F.translate(F.lower("text"), "\t\n\v\f\r.,;:", "         ")
    found = docs.select(*keep, F.explode(F.split(plain, " ")).alias("w"))
    return found.select(*keep, F.when(F.col("w") != "", F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int")).alias("bucket"))


def fit(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """labelled: (doc_id, domain). Log-probability of each bucket in each domain: (bucket, l0, l1, ...), with the log prior in bucket -1."""
    known = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("domain").alias("domain"))
    drawn = F.broadcast(known.orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id").limit(sample))  # at most `sample` rows
    own = words(texts(docs).join(drawn, "doc_id"), "domain").where("bucket IS NOT NULL")
    counts = own.groupBy("bucket").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(f"c{k}") for k, d in enumerate(domains)])
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").na.fill(0)
    full = materialize(full, "domain-counts")
    sums = full.agg(*[F.sum(f"c{k}").alias(f"s{k}") for k in range(len(domains))]).head()
    table = full.select("bucket", *[F.log((F.col(f"c{k}") + 0.5) / F.lit(float(sums[f"s{k}"] or 0) + 0.5 * BUCKETS)).alias(f"l{k}") for k in range(len(domains))])
    n = known.agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{k}") for k, d in enumerate(domains)], F.count("*").alias("n"))
    prior = n.select(F.lit(-1).alias("bucket"), *[F.log((F.col(f"n{k}") + 0.5) / (F.col("n") + 0.5 * len(domains))).alias(f"l{k}") for k in range(len(domains))])
    return materialize(table.unionByName(prior), "domain-words")


def posteriors(docs: DataFrame, model: DataFrame, domains: list[str], evidence: int = EVIDENCE) -> DataFrame:
    """(doc_id, n_tokens, p: array), a null doc_id replaced by a key. The mean log-likelihood of a word counts as that of `evidence` words at most, which keeps memberships soft."""
    ks = range(len(domains))
    table = F.broadcast(model.where("bucket >= 0"))  # BUCKETS rows
    prior = model.where("bucket = -1").head()
    scored = words(keyed_texts(docs), "doc_id").join(table, "bucket", "left").groupBy("doc_id").agg(F.count("bucket").alias("n_tokens"), *[F.sum(f"l{k}").alias(f"t{k}") for k in ks])
    weight = F.least(F.col("n_tokens"), F.lit(evidence)) / F.greatest(F.col("n_tokens"), F.lit(1))
    logits = scored.select("doc_id", "n_tokens", F.array(*[F.lit(prior[f"l{k}"]) + F.coalesce(F.col(f"t{k}") * weight, F.lit(0.0)) for k in ks]).alias("z"))
    shifted = logits.select("doc_id", "n_tokens", F.transform("z", lambda x: F.exp(x - F.array_max("z"))).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return shifted.select("doc_id", "n_tokens", F.transform("e", lambda x: x / total).alias("p"))


def _rate(errors: list[list[float]], pull: float) -> Column:
    """A document's rate after a step for each list of errors by domain, from 1."""
    if not errors:
        return F.lit(1.0)
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in e]) for e in errors])

    def step(rate, e):
        slope = F.aggregate(F.zip_with("p", e, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return F.greatest(F.lit(0.0), rate - slope - F.lit(pull) * (rate - 1))

    return F.aggregate(steps, F.lit(1.0), step)


def rates(table: DataFrame, weights: list[float], total: float | None = None, rounds: int = 40, pull: float = 1e-4, tolerance: float = 1e-4) -> DataFrame:
    """table: (doc_id, n_tokens, p). Adds rate.

    weights: the share of tokens each domain is to have. total: expected tokens in all; None: the least at which no
    domain loses tokens. pull: how strongly rates are held at 1, relative to the match.
    """
    ks, n = range(len(weights)), F.col("n_tokens").cast("double")
    first = table.agg(F.sum(n).alias("n"), *[F.sum(n * F.col("p")[k]).alias(f"s{k}") for k in ks], *[F.sum(n * F.col("p")[k] * F.col("p")[k]).alias(f"g{k}") for k in ks]).head()
    tokens = first["n"] or 0.0
    if not tokens:
        return table.withColumn("rate", F.lit(1.0))
    share = sum(weights)
    weights = [w / share for w in weights]
    if total is None:
        total = max([first[f"s{k}"] / weights[k] for k in ks if weights[k] > 0], default=tokens)
    scale = [max(first[f"g{k}"], 1e-9 * tokens) for k in ks]  # the Hessian's diagonal
    sums, errors = [first[f"s{k}"] for k in ks], []
    for _ in range(rounds):
        gap = [s - w * total for s, w in zip(sums, weights, strict=True)]
        if max(map(abs, gap)) <= tolerance * total:
            break
        errors.append([g / h for g, h in zip(gap, scale, strict=True)])
        made = table.select("n_tokens", "p", _rate(errors, pull).alias("rate"))
        row = made.agg(*[F.sum(n * F.col("rate") * F.col("p")[k]).alias(f"s{k}") for k in ks]).head()
        after = [row[f"s{k}"] for k in ks]
        if _miss(after, weights, total) > _miss(sums, weights, total):  # too far: half the step
            scale = [2 * h for h in scale]
            errors.pop()
            continue
        sums = after
    else:
        warnings.warn(f"after {rounds} rounds the tokens of a domain miss their target by {max(abs(s / total - w) for s, w in zip(sums, weights, strict=True)):.2g} of all", stacklevel=2)
    return table.withColumn("rate", _rate(errors, pull))


def _miss(sums: list[float], weights: list[float], total: float) -> float:
    return sum((s - w * total) ** 2 for s, w in zip(sums, weights, strict=True))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """(doc_id, n_tokens, domain, p, rate, copies): the likeliest domain, its posteriors (targets in order of name), the rate, and whole copies drawn by a hash of doc_id whose mean is the rate."""
    wanted = sorted(targets)
    domains = [r[0] for r in labelled.where(F.col("domain").isin(wanted)).select("domain").distinct().orderBy("domain").collect()]
    if not domains:
        empty = texts(docs).where("false").select("doc_id")
        return empty.selectExpr("doc_id", "0L AS n_tokens", "'' AS domain", "array(0D) AS p", "0D AS rate", "0L AS copies")
    table = materialize(posteriors(docs, fit(docs, labelled, domains, sample, seed), domains), "posteriors")
    rated = rates(table, [targets[d] for d in domains], total)
    best = F.element_at(F.array(*[F.lit(d) for d in domains]), F.array_position("p", F.array_max("p")).cast("int"))
    draw = F.pmod(F.xxhash64(F.lit("copies"), F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return without_keys(rated.select("doc_id", "n_tokens", best.alias("domain"), "p", "rate", copies.alias("copies")))
