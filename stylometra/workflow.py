"""Named stages over stored tables: each writes its outputs as Parquet, later ones read them; runs start at any stage and are compared with a snapshot.

A stage takes (spark, tables, read, parameters), where read gives an output of an earlier stage, and returns its outputs by name. An output's digest is its number of rows
and a sum of row hashes, which doesn't depend on the order of rows or files; doubles count to PLACES digits. Models, transforms and scenarios have names as well,
so that a parameter can choose them.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar
from .operators import features, hierarchy, nested, selection, substitution
from .plans import hierarchy as annotated
from .plans.nested import SUBSTITUTIONS
from .plans.registry import unit_year
from .sources import tables as T

PLACES = 6

#: How a rate enters a model.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {"raw": lambda x: x, "log1p": F.log1p, "sqrt": F.sqrt, "logit": scalar.logit_rate}
#: How units' dates are moved before a fit.
SCENARIOS: dict[str, Callable[[Column], Column]] = {"none": lambda y: y, "all later": lambda y: y + 2, "early half earlier": lambda y: F.when(y < 10, y - 2).otherwise(y), "compressed": lambda y: y / 2}
#: Fits of (grp, x, y, kind): tables of (draw, grp, n, truth, lam, raw, sd, pred).
MODELS: dict[str, Callable[..., DataFrame]] = {
    "nested": lambda df, p: nested.nested_fit(df, "grp", "x", "y", p["lams"], p["alpha"], p["width"], p["draws"]),
    "nested within strata": lambda df, p: nested.nested_fit(df, "grp", "x", "y", p["lams"], p["alpha"], p["width"], p["draws"], "kind"),
    "unweighted": lambda df, p: nested.nested_fit(df, "grp", "x", "y", p["lams"], 0.0, p["width"], p["draws"]),
}

BY = ["grp", "chunk"]


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[..., dict[str, DataFrame]]
    outputs: tuple[str, ...]
    parameters: dict = field(default_factory=dict)


def _extract(spark, tables, read, p):
    tokens = annotated._tokens(spark, tables).withColumn("grp", F.col("unit").cast("string")).withColumn("chunk", F.expr(f"clause div {int(p['target'])}"))
    tokens = substitution.marked(tokens.select(*BY, "word", "lex", "sp"), BY, SUBSTITUTIONS, ["word"])
    return {"tokens": tokens, "counts": substitution.counts(tokens, BY), "sizes": tokens.groupBy(*BY).agg(F.count("*").alias("words"))}


def _matrix(spark, tables, read, p):
    top = hierarchy.commonest(read("counts"), {"lex": int(p["klex"]), "pos": int(p["kpos"]), "pb": int(p["kpairs"])}).select("family", "item").distinct()
    words = sorted(tuple(r) for r in top.collect())  # bounded by the parameters
    rows = substitution.vectors(read("counts"), BY, words, read("sizes"))
    change = TRANSFORMS[p["transform"]]
    y = SCENARIOS[p["scenario"]](F.col("grp").cast("double"))
    rows = rows.select(*BY, F.transform("x", change).alias("x"), y.alias("y"), (F.col("grp").cast("int") % 2).alias("kind"))
    return {"vocabulary": spark.createDataFrame([(k, f, i) for k, (f, i) in enumerate(words)], "place int, family string, item string"), "matrix": rows}


def _audit(spark, tables, read, p):
    long = read("matrix").select(F.col("grp"), F.posexplode("x").alias("feature", "value"))
    return {"features": features.usable(long), "chunks": read("sizes").groupBy("grp").agg(F.count("*").alias("chunks"), F.sum("words").alias("words"), F.percentile("words", 0.5).alias("median"))}


def _fit(spark, tables, read, p):
    fits = T.stored(MODELS[p["model"]](read("matrix"), p), "fits")
    metrics = nested.fit_metrics(fits)
    return {"fits": fits, "metrics": metrics, "null": nested.null_p_values(metrics)}


def _redate(spark, tables, read, p):
    words = [(r["family"], r["item"]) for r in read("vocabulary").orderBy("place").collect()]
    rates = [float(r) for r in p["rates"]]
    each = read("sizes").withColumn("rate", F.explode(F.array(*[F.lit(r) for r in rates])))
    rows = substitution.vectors(substitution.at_rates(read("counts"), substitution.deltas(read("tokens"), BY, rates), BY, rates), [*BY, "rate"], words, each)
    models = T.stored(nested.fold_models(read("matrix"), "grp", "x", "y", p["lams"], p["alpha"], p["width"]), "models")
    rows = rows.select("grp", "rate", F.transform("x", TRANSFORMS[p["transform"]]).alias("x"))
    return {"models": models, "redated": substitution.redated(rows, ["grp", "rate"], models)}


def _select(spark, tables, read, p):
    docs = T.table(spark, tables, "documents")
    units = docs.groupBy("source").agg(F.sum(F.length("text")).alias("chars")).withColumn("y", unit_year())
    rates = selection.gram_counts(docs, "source", "text", tuple(int(s) for s in p["sizes"])).join(F.broadcast(units), "source").select("source", "item", (F.col("n") * 1000.0 / F.col("chars")).alias("value"))  # a row for each source
    return {"grams": selection.select(rates, units.select("source", "y"), "source", "item", "value", int(p["least"]), p["alpha"], p["stable"], int(p["most"]))}


_FIT = {"lams": [10.0, 100.0, 1000.0, 10000.0], "alpha": 1.0, "width": 4.0}
STAGES = (
    Stage("extract", _extract, ("tokens", "counts", "sizes"), {"target": 400}),
    Stage("matrix", _matrix, ("vocabulary", "matrix"), {"klex": 40, "kpos": 10, "kpairs": 20, "transform": "raw", "scenario": "none"}),
    Stage("audit", _audit, ("features", "chunks")),
    Stage("fit", _fit, ("fits", "metrics", "null"), {**_FIT, "model": "nested", "draws": 20}),
    Stage("redate", _redate, ("models", "redated"), {**_FIT, "transform": "raw", "rates": [0.0, 0.25, 0.5, 1.0]}),
    Stage("select", _select, ("grams",), {"sizes": [3, 4], "least": 8, "alpha": 0.1, "stable": 0.65, "most": 120}),
)
SNAPSHOT = "_snapshot"


def digest(df: DataFrame) -> str:
    """Rows and a sum of row hashes."""
    def plain(kind: str, c: Column) -> Column:
        if kind in ("double", "float"):
            return F.round(c, PLACES)
        return F.transform(c, lambda v: F.round(v, PLACES)) if kind == "array<double>" else c

    columns = [plain(kind, F.col(f"`{c}`")) for c, kind in sorted(df.dtypes)]
    got = df.select(F.xxhash64(*columns).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).alias("h")).head()
    return f"{got['n']}:{got['h']}"


def settings(stage: Stage, given: dict) -> dict:
    """The stage's parameters with those given in their place; a list or number is read in the type of what it replaces. ValueError for a name or choice that isn't there."""
    out = dict(stage.parameters)
    for name, value in given.items():
        if name not in out:
            raise ValueError(f"{stage.name} has no parameter {name}: {', '.join(out) or 'none'}")
        old = out[name]
        if isinstance(old, list):
            value = [type(old[0])(v) for v in (value.split(",") if isinstance(value, str) else value)]
        elif isinstance(value, str) and not isinstance(old, str):
            value = type(old)(float(value)) if isinstance(old, int) else type(old)(value)
        known = {"model": MODELS, "transform": TRANSFORMS, "scenario": SCENARIOS}.get(name)
        if known is not None and value not in known:
            raise ValueError(f"no {name} is named {value}: {', '.join(known)}")
        out[name] = value
    return out


def run(spark: SparkSession, tables: str, folder: str, start: int = 1, stop: int | None = None, given: dict[str, dict] | None = None, tell: Callable[[str], None] = print) -> list[str]:
    """Run stages start to stop (from 1); outputs go to folder/NAME and replace what is there. Gives the names of the outputs written. An error ends the run, as later outputs would be stale."""
    folder, given, written = folder.rstrip("/"), given or {}, []
    if unknown := set(given) - {s.name for s in STAGES}:
        raise ValueError(f"no stage is named {', '.join(sorted(unknown))}")
    plans = [(s, settings(s, given.get(s.name, {}))) for s in STAGES]
    for k, (stage, parameters) in enumerate(plans, 1):
        if not start <= k <= (stop or len(STAGES)):
            tell(f"[{k}/{len(STAGES)}] {stage.name}: skipped")
            continue
        begin = time.time()
        outputs = stage.run(spark, tables, lambda name: spark.read.parquet(f"{folder}/{name}"), parameters)
        for name in stage.outputs:
            outputs[name].write.mode("overwrite").parquet(f"{folder}/{name}")
            written.append(name)
        tell(f"[{k}/{len(STAGES)}] {stage.name}: {time.time() - begin:.1f} s")
    return written


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(output, digest) of all outputs that the folder has."""
    folder = folder.rstrip("/")
    found = [(n, digest(spark.read.parquet(f"{folder}/{n}"))) for s in STAGES for n in s.outputs if T.exists(spark, f"{folder}/{n}")]
    return spark.createDataFrame(found, "output string, digest string")


def snapshot(spark: SparkSession, folder: str) -> int:
    """Record the outputs' digests; gives how many there are."""
    now = digests(spark, folder)
    now.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{SNAPSHOT}")
    return now.count()


def compared(spark: SparkSession, folder: str) -> DataFrame:
    """(output, status): same, changed, new or missing against the snapshot; FileNotFoundError if there is none."""
    path = f"{folder.rstrip('/')}/{SNAPSHOT}"
    if not T.exists(spark, path):
        raise FileNotFoundError(f"no snapshot in {folder}")
    return T.compare_outputs(spark.read.parquet(path), digests(spark, folder), "output")
