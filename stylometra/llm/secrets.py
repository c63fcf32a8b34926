"""Secret scans with an incremental blob ledger.

Every version of a text is a blob, addressed by the SHA-256 of its content. Only pairs of blob and rule version that the
ledger does not hold are scanned; findings are joined back to every path (here: doc_id) that holds the blob.

Null texts count as empty, which have no finding; copies are scanned once; a path with several versions has one row for
each; other columns than doc_id and text are not read; an empty table gives empty results.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import materialize, texts

RULE_VERSION, INCREMENTS = "2025.1", 2
#: Kind, pattern, group whose length counts, its least length; in the order of equal starts.
RULES = (
    ("assign", re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]*PRIVATE KEY-----|(?:\s*(?:Proc-Type|DEK-Info):[^\n]*)*[A-Za-z0-9+/=\s]*)"), 0, 1),
    ("forge", re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})"), 0, 1),
    ("chat", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}"), 0, 1),
    ("jwt", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"), 0, 1),
    ("url", re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]*:[^\s/]{3,}@"), 0, 1),
)
BASE = ("assign", "access", "hex")
_HINTS = {"pem": "PRIVATE KEY", "access": "AKIA", "chat": "xox", "jwt": "eyJ", "url": "://"}


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then by the order of the rules."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(RULES):
        hint = _HINTS.get(kind)
        if hint and hint not in text:
            continue
        found += [(m.start(), order, m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


def joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


FOUND = "blob binary, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scanned(version: str):
    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for t in batch.column(1):
                spans = scan(t.as_py())
                base = [s for s in spans if s[2] in BASE]
                for column, v in zip(out, (*(sum(s[2] == k for s in base) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([version] * batch.num_rows, pa.string()), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.string())],
                names=["blob", "rule_version", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return run


def addressed(docs: DataFrame) -> DataFrame:
    """(doc_id, blob, text)."""
    return texts(docs).select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("blob"), "text")


def scan_unseen(docs: DataFrame, seen: DataFrame | None = None, version: str = RULE_VERSION) -> DataFrame:
    """Rows to add to the ledger: the findings of blobs that it does not hold under this rule version."""
    blobs = addressed(docs).select("blob", "text").dropDuplicates(["blob"])
    if seen is not None:
        blobs = blobs.join(seen.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    return materialize(blobs.mapInArrow(_scanned(version), FOUND), "secret-ledger")


def grown(docs: DataFrame, seen: DataFrame | None = None, version: str = RULE_VERSION, increments: int = INCREMENTS) -> DataFrame:
    """The ledger after docs came in so many increments (by a hash of doc_id), each scanned against the ledger of those before."""
    for k in range(increments):
        own = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(increments)) == k)
        new = scan_unseen(own, seen, version)
        seen = new if seen is None else seen.select(new.columns).unionByName(new)
    return seen


def findings(docs: DataFrame, seen: DataFrame | None = None, version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(one row for each path with the findings of its blob, the grown ledger)."""
    ledger = grown(docs, seen, version)
    now = ledger.where(F.col("rule_version") == version).drop("rule_version")
    return addressed(docs).select("doc_id", "blob").join(now, "blob").drop("blob"), ledger


# ---- versions over time and a ledger that lasts ---------------------------------------------------------------------


def ledger_at(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger in a folder, empty where there is none yet: a row for each pair of blob and rule version that was ever scanned."""
    there = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], FOUND)
    return spark.read.schema(FOUND).parquet(folder).dropDuplicates(["blob", "rule_version"])  # runs at the same time may scan a blob twice


def history_findings(history: DataFrame, folder: str, version: str = RULE_VERSION) -> DataFrame:
    """Scan the versions of paths (path, at, text) whose blobs the ledger in the folder lacks under this rule version, append these to it, and give every version's findings.

    (path, at, blob, n_assign, n_access, n_hex, spans, first_seen, current): first_seen is when the path first had this blob, current whether it is the path's latest version (of equal times
    the greater blob). A blob that comes back under another path or later is not scanned again; a new rule version scans all blobs once more. Null texts count as empty; rows that repeat
    path, time and text are one version; a null path is a path of its own; versions without a time come first.
    """
    spark = history.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    named = history.select("path", "at", F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"), text.alias("text"))
    known = ledger_at(spark, folder).where(F.col("rule_version") == version).select("blob")
    blobs = named.select("blob", "text").dropDuplicates(["blob"]).join(known, "blob", "left_anti")
    new = materialize(blobs.mapInArrow(_scanned(version), FOUND), "secret-ledger")
    new.write.mode("append").parquet(folder)
    found = ledger_at(spark, folder).where(F.col("rule_version") == version).select("blob", "n_assign", "n_access", "n_hex", "spans")
    versions = named.select("path", "at", "blob").distinct()
    path = Window.partitionBy("path")  # the versions of one path
    dated = versions.withColumn("first_seen", F.min("at").over(Window.partitionBy("path", "blob"))).withColumn("current", F.row_number().over(path.orderBy(F.desc_nulls_last("at"), F.desc("blob"))) == 1)
    return dated.join(found, "blob").select("path", "at", "blob", "n_assign", "n_access", "n_hex", "spans", "first_seen", "current")


def leaks(findings: DataFrame) -> DataFrame:
    """(path, spans, since, until, current): runs of findings of history_findings that hold a secret: since when a path's text had them, until which version, and whether the latest one still does."""
    held = findings.where("spans <> ''")
    return held.groupBy("path", "spans").agg(F.min("at").alias("since"), F.max("at").alias("until"), F.max("current").alias("current"))


def redact(text: str, spans: str, mark: str = "[SECRET]") -> str:
    """The text with each span (overlapping ones together) replaced by mark."""
    out, at = [], 0
    ends = [(int(a), int(b)) for _, a, b in (s.split(":") for s in spans.split(",") if s)]
    for a, b in ends:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])
