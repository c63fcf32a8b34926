"""Vector codes by product quantisation: Lloyd's rounds that shuffle only what changed.

Vectors become integers, cut into equal parts; each part has a code book of its own. The vectors are written once, bucketed by
row. A round joins them with the assignments of the round before, bucketed alike, so that neither moves; it writes the new
assignments and, for parts that changed their entry alone, what to take from the old entry's sum and add to the new one's, summed within
the task. The driver keeps the running sums of the code books, entries x components numbers, and adds what the rounds changed.
A round in which nothing changes is the last that matters.

Rows whose vector is null, or has a null, NaN or infinite component, are dropped. Components must be within LARGEST, so that squared distances
stay exact: beyond it the job fails and says so. The dimension is the length that most vectors have (of
equals the larger); vectors of another length, empty ones included, are dropped as well, since they can't be cut alike, and a dimension
that the parts don't divide is an error. A null vec_id comes last in the order of ids; rows that repeat one are ordered by vector, and all are coded.
With fewer vectors than entries, code books have as many entries as vectors. Equal labels, nulls together, share label_error.
Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import discard, materialize, shared_dir
from .repeats import joined_by_key

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest size of a component before scaling: squared distances of parts of up to 128 components stay below 2**63.
LARGEST = 32768
#: Bytes of integers in a bucket of vectors, and numbers of one block of differences.
BUCKET_BYTES, BLOCK = 128_000_000, 2_000_000

STATE = "row long, codes binary, part int, entry int, n long, sums array<long>"


class Bucketed:
    """Tables in the shared folder bucketed by row, all in the same number of buckets, gone when dropped."""

    def __init__(self, spark, buckets: int):
        self.spark, self.buckets, self.held = spark, buckets, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        full = f"stylometra_{name}_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/stylometra/{full}"
        df.write.bucketBy(self.buckets, "row").option("path", path).saveAsTable(full)
        self.held[name] = (full, path)
        return self.spark.table(full)

    def drop(self, *names: str) -> None:
        for full, path in [self.held.pop(n) for n in names or list(self.held)]:
            self.spark.sql(f"DROP TABLE {full}")
            discard(self.spark, path)


def integers(vectors: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, x): the rows that are kept, components as integers."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    known = vectors.select(F.col("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias(vector)).where(F.col(vector).isNotNull() & finite)
    whole = lambda v: F.when(F.abs(v) <= LARGEST, F.floor(SCALE * v).cast("int")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST}")).cast("int"))
    return known.select("vec_id", "label", F.transform(vector, whole).alias("x"))


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every part: x is rows x components, books parts x entries x components of a part."""
    parts, entries, width = books.shape
    codes, errors = np.zeros((len(x), parts), np.uint8), np.zeros((len(x), parts), np.int64)
    step = max(1, BLOCK // max(1, entries * width))
    for at in range(0, len(x), step):
        for p in range(parts):
            own = x[at : at + step, None, p * width : (p + 1) * width] - books[p][None]
            distance = np.einsum("ijk,ijk->ij", own, own)
            codes[at : at + step, p] = best = distance.argmin(axis=1)
            errors[at : at + step, p] = np.take_along_axis(distance, best[:, None], 1)[:, 0]
    return codes, errors


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _round(books: np.ndarray, first: bool):
    """From (row, x, codes) to rows of STATE: an assignment for each row, and a sum for each entry that gained or lost parts in this task."""
    parts, entries, width = books.shape

    def run(batches):
        sums, counts, rows = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64), np.int64(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), parts * width)
            codes, _ = nearest(x, books)
            old = None if first else np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                moved = slice(None) if first else np.flatnonzero(codes[:, p] != old[:, p])
                own = x[moved, p * width : (p + 1) * width]
                np.add.at(sums[p], codes[moved, p], own)
                np.add.at(counts[p], codes[moved, p], 1)
                if not first:
                    np.subtract.at(sums[p], old[moved, p], own)
                    np.subtract.at(counts[p], old[moved, p], 1)
            rows += len(x)
            k, none = len(x), lambda t: pa.nulls(len(x), t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codes[i].tobytes() for i in range(k)], pa.binary()), none(pa.int32()), none(pa.int32()), none(pa.int64()), none(pa.list_(pa.int64()))], names=["row", "codes", "part", "entry", "n", "sums"])
        part, entry = np.nonzero((counts != 0) | (sums != 0).any(axis=2))
        k = len(part)
        if k:
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))], names=["row", "codes", "part", "entry", "n", "sums"])

    return run


def _changes(state: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts to add to those of the code books: no more rows than these have numbers."""
    sums, counts = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
    added = [F.sum("n"), *[F.sum(F.col("sums")[k]) for k in range(shape[2])]]
    for part, entry, n, *values in state.where("row IS NULL").groupBy("part", "entry").agg(*added).collect():
        counts[part, entry], sums[part, entry] = n, values
    return sums, counts


def _coded(books: np.ndarray):
    parts, _, width = books.shape

    def run(batches):
        for batch in batches:
            codes, errors = nearest(_matrix(batch.column(2), parts * width), books)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([codes[i].tobytes().hex() for i in range(len(codes))], pa.string()), pa.array(errors.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return run


def fit(vectors: DataFrame, tables: Bucketed, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The code books after the rounds. vectors: (row, vec_id, x), bucketed by row."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "x", "row").limit(entries).select("x").collect()
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2).copy()
    sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
    state = None
    for k in range(rounds):
        if state is None:
            met = vectors.select("row", "x")
        else:
            met = vectors.select("row", "x").join(state.where("row IS NOT NULL").select("row", "codes").hint("shuffle_hash"), "row")
        state = tables.write(met.mapInArrow(_round(books, state is None), STATE), f"state{k}")
        if k:
            tables.drop(f"state{k - 1}")
        more, n = _changes(state, books.shape)
        if not more.any() and not n.any():
            break
        sums, counts = sums + more, counts + n
        used = counts > 0
        books[used] = sums[used] // counts[used][:, None]
    return books


def compress(vectors: DataFrame, vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error), code books): two hex digits for each part, and the squared distance to what the code stands for."""
    spark = vectors.sparkSession
    ship(spark)
    whole = integers(vectors, vector, label)
    kinds = {c: whole.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    sizes = whole.groupBy(F.size("x").alias("dim")).count().where("dim > 0").orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    dim, n = sizes[0]
    if dim % parts:
        raise ValueError(f"{dim} components can't be cut into {parts} equal parts")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-4 * n * dim // BUCKET_BYTES))
    tables = Bucketed(spark, buckets)
    # ids of rows follow files and places in them, so a task that runs again gives the same ones
    named = whole.where(F.size("x") == dim).withColumn("row", F.monotonically_increasing_id())
    held = tables.write(materialize(named, "vectors").repartition(buckets, "row"), "vectors")
    books = fit(held, tables, dim, parts, entries, rounds)
    coded = materialize(held.select("vec_id", "label", "x").mapInArrow(_coded(books), schema), "codes")
    tables.drop()
    return coded, books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error: labels that many rows share meet these rows by broadcast."""
    keyed = coded.withColumn("_none", F.col("label").isNull()).withColumn("_label", F.coalesce(F.col("label").cast("string"), F.lit("")))
    sums = keyed.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    return joined_by_key(keyed, sums, ["_none", "_label"], "_n", coded.count()).drop("_none", "_label", "_n")
