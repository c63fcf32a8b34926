"""Words replaced at several rates, features taken again by what changed, and dates by the fit without the unit.

Tokens are rows (by..., word, lex, sp): lexemes, parts of speech and bigrams of these are counted once. A rate changes the tokens whose hash lies below it,
so a higher rate changes these and more; only changed tokens and their neighbours make rows, -1 for what goes and +1 for what comes, and a
rate's counts are the stored counts plus these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .nested import exact_medians


def marked(tokens: DataFrame, by: list[str], changes: dict[str, tuple[str, str | None]], place: list[str]) -> DataFrame:
    """Adds lex2 and sp2, what a changed token becomes, draw, the rate from which on it changes (null: never), and the same of its next neighbour. changes: lexeme to (lexeme, part of speech or None)."""
    pick = lambda k: F.coalesce(*[F.when(F.col("lex") == old, F.lit(new[k])) for old, new in changes.items()], F.lit(None).cast("string"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in place])), 1, 7), 16, 10).cast("long") / float(1 << 28)
    own = tokens.withColumn("lex2", pick(0)).withColumn("sp2", F.coalesce(pick(1), "sp")).withColumn("draw", F.when(F.col("lex2").isNotNull(), draw))
    w = Window.partitionBy(*by).orderBy("word", "lex", "sp")
    return own.withColumns({f"next_{c}": F.lead(c).over(w) for c in ("sp", "sp2", "draw")})


def changed(tokens: DataFrame, rate: float) -> DataFrame:
    """The tokens as they are at a rate. tokens: marked."""
    hit = F.coalesce(F.col("draw") < rate, F.lit(False))
    return tokens.withColumn("lex", F.when(hit, F.col("lex2")).otherwise(F.col("lex"))).withColumn("sp", F.when(hit, F.col("sp2")).otherwise(F.col("sp")))


def _pair(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit("|"), b)


def counts(tokens: DataFrame, by: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep..., family, item, n) of lexemes, parts of speech and bigrams of these within by; keep: those of by that counts are told apart by, all by default."""
    keep = by if keep is None else keep
    follow = F.lead("sp").over(Window.partitionBy(*by).orderBy("word", "lex", "sp"))
    own = tokens.select(*by, "lex", "sp", follow.alias("_f"), F.lit(1).cast("long").alias("_n"))
    if keep != by:  # equal tokens meet before they become items
        own = own.groupBy(*keep, "lex", "sp", "_f").agg(F.sum("_n").alias("_n"))
    items = F.array(*[F.struct(F.lit(f).alias("family"), e.alias("item")) for f, e in (("lex", F.col("lex")), ("pos", F.col("sp")), ("pb", _pair(F.col("sp"), F.col("_f"))))])
    return own.select(*keep, "_n", F.explode(items).alias("x")).select(*keep, "_n", "x.*").where("item IS NOT NULL").groupBy(*keep, "family", "item").agg(F.sum("_n").alias("n"))


def deltas(tokens: DataFrame, by: list[str], rates: list[float], keep: list[str] | None = None) -> DataFrame:
    """(keep..., rate, family, item, n): what each rate adds to or takes from the counts. tokens: marked; keep: those of by that counts are told apart by, all by default."""
    keep = by if keep is None else keep
    near = tokens.where("draw IS NOT NULL OR next_draw IS NOT NULL").withColumn("_n", F.lit(1).cast("long"))
    # of the rates only how many a draw isn't below matters, so that equal tokens can meet
    step = lambda c: F.when(F.col(c).isNotNull(), sum((F.col(c) >= float(r)).cast("int") for r in rates))
    near = near.withColumns({"_a": step("draw"), "_b": step("next_draw")})
    if keep != by:
        near = near.groupBy(*keep, "lex", "lex2", "sp", "sp2", "next_sp", "next_sp2", "_a", "_b").agg(F.sum("_n").alias("_n"))
    near = near.withColumn("_r", F.explode(F.array(*[F.struct(F.lit(float(r)).alias("rate"), F.lit(sum(q <= r for q in rates)).alias("at")) for r in rates]))).withColumn("rate", F.col("_r.rate"))
    a, b = (F.coalesce(F.col(c) < F.col("_r.at"), F.lit(False)) for c in ("_a", "_b"))
    sp, follow = F.when(a, F.col("sp2")).otherwise(F.col("sp")), F.when(b, F.col("next_sp2")).otherwise(F.col("next_sp"))
    x = lambda family, item, n: F.struct(F.lit(family).alias("family"), item.alias("item"), F.lit(n).cast("long").alias("n"))
    items = [x("lex", F.when(a, F.col("lex")), -1), x("lex", F.when(a, F.col("lex2")), 1), x("pos", F.when(a, F.col("sp")), -1), x("pos", F.when(a, F.col("sp2")), 1)]
    items += [x("pb", F.when(a | b, _pair(F.col("sp"), F.col("next_sp"))), -1), x("pb", F.when(a | b, _pair(sp, follow)), 1)]
    long = near.select(*keep, "rate", "_n", F.explode(F.array(*items)).alias("x")).select(*keep, "rate", "_n", "x.*").where("item IS NOT NULL")
    return long.groupBy(*keep, "rate", "family", "item").agg(F.sum(F.col("n") * F.col("_n")).alias("n")).where("n <> 0")


def at_rates(base: DataFrame, changes: DataFrame, by: list[str], rates: list[float]) -> DataFrame:
    """(by..., rate, family, item, n): stored counts with each rate's changes; what is no longer there goes."""
    every = base.withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates]))).select(*by, "rate", "family", "item", "n")
    return every.unionByName(changes).groupBy(*by, "rate", "family", "item").agg(F.sum("n").alias("n")).where("n <> 0")


def vectors(items: DataFrame, by: list[str], vocabulary: list[tuple[str, str]], sizes: DataFrame) -> DataFrame:
    """(by..., x): per 1000 words in the order of the vocabulary (family, item), 0 where an item is missing. sizes: (by..., words), one row for each row of the result."""
    table = F.broadcast(items.sparkSession.createDataFrame([(f, i, k) for k, (f, i) in enumerate(vocabulary)], "family string, item string, _k int"))  # the vocabulary is bounded by its caller
    held = items.join(table, ["family", "item"]).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_k", "n"))).alias("_m"))  # at most the vocabulary
    met = sizes.join(held, by, "left")
    value = lambda k: F.coalesce(F.col("_m")[k], F.lit(0)) * 1000.0 / F.col("words")
    return met.select(*by, F.transform(F.sequence(F.lit(0), F.lit(len(vocabulary) - 1)), value).alias("x"))


def rate_vectors(tokens: DataFrame, by: list[str], vocabulary: list[tuple[str, str]], rates: list[float]) -> DataFrame:
    """(by..., rate, words, x): the vectors of each of by at each rate, straight from its tokens. tokens: marked.

    Tokens lie in order behind the window, so a task counts them batch by batch and holds only the last one of by, which may go on in the next batch.
    """
    ship(tokens.sparkSession)
    schema = {f.name: f for f in tokens.schema}
    width, kinds, names = len(vocabulary), ", ".join(f"`{c}` {schema[c].dataType.simpleString()}" for c in by), [*by, "rate", "words", "x"]
    known = {f: [(i, k) for k, (g, i) in enumerate(vocabulary) if g == f] for f in ("lex", "pos", "pb")}

    def run(batches):
        items = {f: pa.array([i for i, _ in own], pa.string()) for f, own in known.items()}
        places = {f: np.array([*(k for _, k in own), width]) for f, own in known.items()}  # the last: not in the vocabulary

        def code(family, values):
            return places[family][pc.index_in(values, value_set=items[family]).fill_null(-1).to_numpy()]

        def pair(a, b):
            return code("pb", pc.binary_join_element_wise(a, b, "|"))

        def summed(own, codes, n):
            return np.bincount(own * (width + 1) + codes, minlength=n * (width + 1)).reshape(n, width + 1)

        def counted(batch, own, n):
            """Counts of each one of by at each rate."""
            c = dict(zip(batch.schema.names, batch.columns, strict=True))
            base = summed(own, code("lex", c["lex"]), n) + summed(own, code("pos", c["sp"]), n) + summed(own, pair(c["sp"], c["next_sp"]), n)
            draws = [c[d].to_numpy(zero_copy_only=False).astype(float) for d in ("draw", "next_draw")]  # null: never below a rate
            at = np.flatnonzero(~np.isnan(draws[0]) | ~np.isnan(draws[1]))
            c, own, (draw, after) = {k: v.take(pa.array(at)) for k, v in c.items()}, own[at], (d[at] for d in draws)
            lex, pos = [code("lex", c[k]) for k in ("lex", "lex2")], [code("pos", c[k]) for k in ("sp", "sp2")]
            pairs = np.array([[pair(c[a], c[b]) for b in ("next_sp", "next_sp2")] for a in ("sp", "sp2")])
            out = np.empty((n, len(rates), width), np.int64)
            for k, rate in enumerate(rates):
                a, b = draw < rate, after < rate
                both, row = a | b, np.arange(len(at))
                come = summed(own[a], lex[1][a], n) + summed(own[a], pos[1][a], n) + summed(own[both], pairs[a.astype(int), b.astype(int), row][both], n)
                go = summed(own[a], lex[0][a], n) + summed(own[a], pos[0][a], n) + summed(own[both], pairs[0, 0][both], n)
                out[:, k] = (base + come - go)[:, :width]
            return out

        def made(keys, counts, words):
            repeat = pa.array(np.repeat(np.arange(len(words)), len(rates)))
            x = (counts * 1000.0 / words[:, None, None]).reshape(-1)
            offsets = pa.array(np.arange(0, len(x) + 1, width) if width else np.zeros(len(repeat) + 1), pa.int32())
            return pa.RecordBatch.from_arrays([*(k.take(repeat) for k in keys), pa.array(np.tile(rates, len(words)), pa.float64()), pa.array(np.repeat(words, len(rates)), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(x))], names=names)

        held = None  # the last one of by so far: its key, counts and words
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k) for k in range(len(by))]
            new = np.zeros(batch.num_rows, bool)
            for column in columns:
                codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            own = new.cumsum()
            first = np.concatenate([[0], np.flatnonzero(new)])
            counts, words = counted(batch, own, len(first)), np.bincount(own)
            keys = [column.take(pa.array(first)) for column in columns]
            if held:
                if [k[0].as_py() for k in held[0]] == [k[0].as_py() for k in keys]:
                    counts[0] += held[1][0]
                    words[0] += held[2][0]
                else:
                    yield made(*held)
            if len(first) > 1:
                yield made([k[:-1] for k in keys], counts[:-1], words[:-1])
            held = [k[-1:] for k in keys], counts[-1:], words[-1:]
        if held:
            yield made(*held)

    own = tokens.select(*by, "lex", "sp", "lex2", "sp2", "draw", "next_sp", "next_sp2", "next_draw")
    return own.mapInArrow(run, f"{kinds}, rate double, words long, x array<double>")


def redated(rows: DataFrame, by: list[str], models: DataFrame, group: str = "grp") -> DataFrame:
    """(by..., n, raw, pred): medians of the rows' predictions by their group's model (see nested.fold_models), raw and calibrated. rows: (by... with group, x)."""
    ship(rows.sparkSession)
    models = models.select(F.col(group).cast("string").alias("_g"), "beta", "stretch", "truth", F.col("raw").alias("_raw"))
    betas = {r["_g"]: np.array(r["beta"], float) for r in models.collect()}  # a row for each group
    shared = rows.sparkSession.sparkContext.broadcast((list(betas), np.array(list(betas.values()))))

    def run(batches):
        names, beta = shared.value
        for batch in batches:
            if batch.num_rows:
                at = pc.index_in(batch.column(len(by)), value_set=pa.array(names, pa.string())).to_numpy()
                x = batch.column(len(by) + 1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), -1)
                p = beta[at, 0] + np.einsum("ij,ij->i", x, beta[at, 1:])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], pa.array(p)], names=[*by, "p"])

    kinds = dict(rows.dtypes)
    own = rows.select(*by, F.col(group).cast("string").alias("_g"), "x").where(F.col("_g").isin(list(betas)) & F.col("x").isNotNull())
    med = exact_medians(own.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", p double"), by, "p")
    out = med.join(F.broadcast(models.drop("beta")), F.col(group).cast("string") == F.col("_g"))
    return out.select(*by, "n", F.col("med").alias("raw"), (F.col("truth") + F.col("stretch") * (F.col("med") - F.col("_raw"))).alias("pred"))
