"""Scans and sinks: Parquet tables, JSON manifests, token text, HTML text, resumable result tables."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir (shared by all executors); a folder of our own only where that is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = f"file://{tempfile.mkdtemp(prefix='stylometra-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/stylometra/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: what follows reads these rows and doesn't work them out again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def resolve(spark: SparkSession, name: str, folders: list[str], variable: str | None = None) -> str:
    """The path of name in the first folder that has it; a folder in the environment variable goes first; FileNotFoundError if none has it."""
    own = os.environ.get(variable) if variable else None
    for folder in ([own] if own else []) + folders:
        if exists(spark, f"{folder.rstrip('/')}/{name}"):
            return f"{folder.rstrip('/')}/{name}"
    raise FileNotFoundError(f"{name} is in none of {folders}")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header. Without a schema the types are inferred, which reads the files twice."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str, digits: int | None = None) -> None:
    """CSV with a header, one file for each partition; digits: significant digits of doubles and floats, else the shortest exact form."""
    form = lambda f: F.format_string(f"%.{digits - 1}e", F.col(f"`{f.name}`").cast("double"))
    real = lambda f: digits and f.dataType.typeName() in ("double", "float")
    df.select(*[F.when(F.col(f"`{f.name}`").isNotNull(), form(f)).alias(f.name) if real(f) else F.col(f"`{f.name}`") for f in df.schema]).write.option("header", True).csv(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_entries(df: DataFrame, key: str, text: str, path: str) -> None:
    """Texts as text files in one folder for each key (path/texts/key=...), all other columns as JSON lines in path/meta. For tables of works, not of passages."""
    df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("value")).repartition(key).write.partitionBy(key).text(f"{path}/texts")
    df.drop(text).write.json(f"{path}/meta")


def save_matrix(df: DataFrame, row: str, vector: str, path: str) -> None:
    """One line for each row: its key, then its numbers, between blanks; doubles are exact."""
    df.select(F.concat_ws(" ", F.col(row).cast("string"), F.array_join(F.transform(vector, lambda x: x.cast("double").cast("string")), " ")).alias("value")).write.text(path)


def load_matrix(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", " ")
    return spark.read.text(path).select(parts[0].cast("long").alias("row"), F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda x: x.cast("double")).alias("vector"))


def manifest(spark: SparkSession, path: str, groups: dict[str, bool]) -> DataFrame:
    """A JSON object of arrays: one row for each object of each group, with the group and its holdout flag."""
    whole = spark.read.option("multiLine", True).json(path)
    parts = [whole.select(F.explode(g).alias("m"), F.lit(g).alias("grp"), F.lit(flag).alias("is_holdout")).select("m.*", "grp", "is_holdout") for g, flag in groups.items() if g in whole.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def sentences(spark: SparkSession, path: str) -> DataFrame:
    """One sentence a line, words between white space; empty lines are dropped; a missing path has no sentences."""
    if not exists(spark, path):
        return spark.createDataFrame([], "words array<string>")
    return spark.read.text(path).select(F.filter(F.split("value", r"\s+"), lambda w: w != "").alias("words")).where(F.size("words") > 0)


#: Elements whose content vanishes, and those after which the text up to the next tag goes too; elements that end a line; of these, those without an end tag.
VOID = frozenset({"script", "style", "head", "nav", "footer"})
DROP = frozenset({"note"})
BLOCK = frozenset({"p", "div", "li", "br", "hr", "h1", "h2", "h3", "h4", "tr", "section", "article"})
EMPTY = frozenset({"br", "hr"})


class _Text(HTMLParser):
    """Text of a page. An element that is never closed hides nothing (but code), and a new p, li or tr ends an open one."""

    def __init__(self, void, drop, block):
        super().__init__(convert_charrefs=True)
        self.void, self.drop, self.block = void, drop, block
        self.parts: list[str] = []
        self.hidden: list[str] = []  # text since the outermost hiding element began
        self.open: list[str] = []  # hiding elements
        self.tail = False
        self.implied: set[str] = set()

    def _add(self, text: str) -> None:
        (self.hidden if self.open else self.parts).append(text)

    def handle_starttag(self, tag, attrs):
        self.tail = False
        if tag == "body" and "head" in self.open:
            self.handle_endtag("head")
        if tag in self.void or tag in self.drop:
            self.open.append(tag)
        elif tag in self.block and (tag in EMPTY or tag in self.implied):
            self._add("\n")
        if tag in ("p", "li", "tr"):
            self.implied.add(tag)

    def handle_startendtag(self, tag, attrs):
        self.tail = tag in self.drop
        if tag in self.block:
            self._add("\n")

    def handle_endtag(self, tag):
        self.tail = False
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]
            if not self.open:
                self.hidden.clear()
                self.tail = tag in self.drop
        elif tag in self.block and tag not in EMPTY:
            self._add("\n")
            self.implied.discard(tag)

    def handle_data(self, data):
        if not self.tail:
            self._add(data)

    def close(self):
        super().close()
        if self.open and self.open[0] not in self.CDATA_CONTENT_ELEMENTS:
            self.parts += self.hidden


def html_text(html: str | None, void: frozenset = VOID, drop: frozenset = DROP, block: frozenset = BLOCK) -> str | None:
    if html is None:
        return None
    p = _Text(void, drop, block)
    p.feed(html)
    p.close()
    return "".join(p.parts)


def html_text_column(html: str) -> Column:
    return F.pandas_udf(lambda s: s.map(html_text), "string")(html)


def save_draws(df: DataFrame, path: str) -> None:
    """Append finished draws of a resampling run."""
    df.write.mode("append").parquet(path)


def missing_draws(wanted: DataFrame, done: DataFrame, key: str = "draw") -> DataFrame:
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def inputs_digest(tables: list[DataFrame], *extra) -> str:
    """One digest of the rows of the tables (in any order; repeats count) and of settings."""
    parts = []
    for t in tables:
        row = F.xxhash64(*[F.col(f"`{c}`") for c in t.columns]).cast("decimal(38,0)")
        other = F.hash(*[F.col(f"`{c}`") for c in t.columns]).cast("decimal(38,0)")
        got = t.agg(F.count("*"), F.sum(row), F.sum(row * other % F.lit(10**15).cast("decimal(38,0)"))).head()
        parts.append(f"{t.schema.simpleString()} {tuple(map(str, got))}")
    return hashlib.sha256("|".join([*parts, *map(repr, extra)]).encode()).hexdigest()


def guarded_draws(spark: SparkSession, path: str, tables: list[DataFrame], *extra) -> str:
    """The folder below path for draws made from these inputs and settings: runs on the same inputs go on there, others never meet their draws, which stay aside."""
    return f"{path.rstrip('/')}/{inputs_digest(tables, *extra)[:16]}"


def fingerprint(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, digest): SHA-256 over the named columns, for telling changed outputs from equal ones."""
    return df.select(key, F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256).alias("digest"))


def compare_outputs(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, status): same, changed, new or missing."""
    a, b = old.select(key, F.col("digest").alias("d0")), new.select(key, F.col("digest").alias("d1"))
    status = F.when(F.col("d0").isNull(), "new").when(F.col("d1").isNull(), "missing").when(F.col("d0") == F.col("d1"), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, status.alias("status"))
