"""Counts by what changed against counts of the changed tokens, and dates against a plain fit."""

import random

import numpy as np
import pytest

from stylometra.operators import nested, substitution

SCHEMA = "grp string, chunk long, word long, lex string, sp string"
CHANGES = {"a": ("b", None), "c": ("d", "adv"), "e": ("a", "noun")}
BY = ["grp", "chunk"]


@pytest.fixture(scope="module")
def tokens(spark):
    rng = random.Random(4)
    rows = [(f"g{k % 6}", k // 6 % 3, k, rng.choice("abcdefgh"), rng.choice(["noun", "verb", "prep"])) for k in range(900)]
    return substitution.marked(spark.createDataFrame(rows, SCHEMA).repartition(3), BY, CHANGES, ["word"]).cache()


def table(df):
    return {tuple(r[c] for c in (*BY, "family", "item")): r.n for r in df.collect()}


def test_changes_give_the_counts_of_changed_tokens(tokens):
    rates = [0.0, 0.3, 1.0]
    got = substitution.at_rates(substitution.counts(tokens, BY), substitution.deltas(tokens, BY, rates), BY, rates).cache()
    for rate in rates:
        assert table(got.where(f"rate = {rate}")) == table(substitution.counts(substitution.changed(tokens, rate), BY))
    some = {rate: substitution.changed(tokens, rate).where("lex IN ('a', 'c', 'e')").count() for rate in rates}
    assert some[0.0] > some[0.3] > some[1.0]
    assert substitution.changed(tokens, 1.0).where("lex = 'c'").count() == 0


def test_dates_of_changed_rows(spark):
    rng = np.random.default_rng(7)
    data = [(f"g{k}", [float(v) for v in rng.normal(0, 1, 3) + k], float(10 * k)) for k in range(6) for _ in range(9)]
    df = spark.createDataFrame(data, "grp string, x array<double>, y double")
    fits = {r.grp: r for r in nested.nested_fit(df, "grp", "x", "y", (1.0, 10.0), 1.0, 20.0).collect()}
    models = nested.fold_models(df, "grp", "x", "y", (1.0, 10.0), 1.0, 20.0).cache()
    for m in models.collect():
        assert m.lam == fits[m.grp].lam
    for r in substitution.redated(df.select("grp", "x"), ["grp"], models).collect():
        m = models.where(f"grp = '{r.grp}'").head()
        own = np.array([x for g, x, _ in data if g == r.grp])
        want = np.median(m.beta[0] + own @ np.array(m.beta[1:]))
        assert r.raw == pytest.approx(want) == pytest.approx(fits[r.grp].raw) and r.n == 9
        assert r.pred == pytest.approx(m.truth + m.stretch * (want - m.raw))


def test_vectors_have_a_place_for_each_word(spark, tokens):
    from pyspark.sql import functions as F

    sizes = tokens.groupBy(*BY).agg(F.count("*").alias("words"))
    rows = substitution.vectors(substitution.counts(tokens, BY), BY, [("lex", "a"), ("lex", "nowhere"), ("pos", "verb")], sizes).collect()
    counts, words = table(substitution.counts(tokens, BY)), {(r.grp, r.chunk): r.words for r in sizes.collect()}
    assert len(rows) == 18
    for r in rows:
        n = words[r.grp, r.chunk]
        assert r.x == pytest.approx([counts.get((r.grp, r.chunk, "lex", "a"), 0) * 1000 / n, 0, counts[r.grp, r.chunk, "pos", "verb"] * 1000 / n])


def test_vectors_at_rates_from_tokens(spark, tokens):
    """Batches of a few rows, so that chunks go on over batches; the plain way has a row for each item."""
    from pyspark.sql import functions as F

    rates, words = [0.0, 0.3, 1.0], [("lex", "a"), ("lex", "b"), ("pos", "verb"), ("pb", "noun|adv"), ("pb", "nowhere")]
    sizes = tokens.groupBy(*BY).agg(F.count("*").alias("words")).withColumn("rate", F.explode(F.array(*[F.lit(r) for r in rates])))
    plain = substitution.vectors(substitution.at_rates(substitution.counts(tokens, BY), substitution.deltas(tokens, BY, rates), BY, rates), [*BY, "rate"], words, sizes)
    want = {(r.grp, r.chunk, r.rate): list(r.x) for r in plain.collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", before):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            rows = substitution.rate_vectors(tokens, BY, words, rates).collect()
            assert len(rows) == len(want) == 54
            for r in rows:
                assert r.x == pytest.approx(want[r.grp, r.chunk, r.rate]) and r.words == 50
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_counts_of_everything_are_the_sums_of_chunks(tokens):
    rates, whole = [0.0, 0.3, 1.0], {}
    for r in substitution.at_rates(substitution.counts(tokens, BY), substitution.deltas(tokens, BY, rates), BY, rates).collect():
        whole[r.rate, r.family, r.item] = whole.get((r.rate, r.family, r.item), 0) + r.n
    got = substitution.at_rates(substitution.counts(tokens, BY, []), substitution.deltas(tokens, BY, rates, []), [], rates)
    assert {(r.rate, r.family, r.item): r.n for r in got.collect()} == whole


def test_vectors_need_no_row_for_each_item(spark, tokens):
    """Items of chunks were rows, exploded and shuffled for each rate."""
    plan = substitution.rate_vectors(tokens, BY, [("lex", "a")], [0.0, 1.0])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
