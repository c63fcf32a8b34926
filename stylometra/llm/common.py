"""Shared plumbing: reading tables, shared-folder tables, shipping code, null-safe columns."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of our own if all runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='stylometra-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stylometra/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, wherever the shared folder is."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only, a null text as the empty one: extra columns never reach an operator."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


#: Bytes of text that a task which keeps a range of documents together should have at most.
RANGE_BYTES = 128_000_000


def parts_for(docs: DataFrame, size: int = RANGE_BYTES) -> int:
    """Ranges to cut docs into: enough for about `size` bytes of text each, and where those are few as many as a shuffle has, of a megabyte at least.

    The size is that of the first rows times the number of rows: it only shapes files and tasks, so no pass over all texts is spent on it.
    """
    seen = texts(docs).select(F.octet_length("text").alias("n")).limit(2000).agg(F.avg("n")).head()[0] or 0
    total = int(seen * docs.count())
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-total // size), min(usual, -(-total // 1_000_000)))


#: Keys up to this one stand for documents without a doc_id.
NO_ID = -(1 << 62)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """texts(docs) with a key in place of a null doc_id, made from the text: equal texts share it, others don't. Own doc_ids must be above NO_ID."""
    made = F.lit(NO_ID) - F.pmod(F.xxhash64("text"), F.lit(1 << 61))
    return texts(docs).withColumn("doc_id", F.coalesce("doc_id", made))


def without_keys(df: DataFrame) -> DataFrame:
    """Null again for the keys that keyed_texts made."""
    return df.withColumn("doc_id", F.when(F.col("doc_id") > NO_ID, F.col("doc_id")))


def environment_path(name: str) -> str:
    """Path of a public tokenizer file; STYLOMETRA_TOKENIZERS overrides the folder."""
    folder = os.environ.get("STYLOMETRA_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Polynomial:
    """Hashes of any slice of a symbol array: sums of symbol times power, modulo 2**64, shifted back by the inverse power."""

    BASE = 0x9E3779B97F4A7C15 | 1
    _pow = np.ones(1, np.uint64)
    _inv = np.ones(1, np.uint64)

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._pow) <= n:
            size = max(n + 1, 1 << 16)
            for name, base in (("_pow", cls.BASE), ("_inv", pow(cls.BASE, -1, 1 << 64))):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(cls, name, np.cumprod(powers, dtype=np.uint64))

    def __init__(self, values: np.ndarray):
        n = len(values)
        self._grow(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self._pow[:n], dtype=np.uint64, out=self.sums[1:])

    def slices(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * self._inv[start] + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def chunks(batches, limit: int):
    """(doc_ids, texts as bytes) of at most about limit bytes each, whole documents, from Arrow batches of (doc_id, text)."""
    ids: list[int] = []
    blobs: list[bytes] = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            b = t.as_py()
            b = b.encode() if isinstance(b, str) else (b or b"")
            ids.append(i)
            blobs.append(b)
            size += len(b)
            if size >= limit:
                yield ids, blobs
                ids, blobs, size = [], [], 0
    if ids:
        yield ids, blobs


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes other than 0x20 and 0x09-0x0D."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def repeated_keys(key: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order] = same[:-1] | same[1:]
    return out
