"""Importance resampling towards a target distribution, from hashed n-grams counted by DuckDB within each partition.

Every task opens a DuckDB connection of one thread and bounded memory, with two registered functions: the zlib CRC-32 of a
string, and the CRC of two strings joined, from theirs. SQL unnests the words of about a megabyte of text, takes runs of one to three with
window functions, and counts buckets by document and in all. Spark writes these counts as Parquet, merges them over tasks, and scores
documents. Each distinct word's CRC is taken once in a batch; those of runs are joined, as a CRC of a joined string
follows from both parts and the length of the second.

Texts longer than PIECE are counted in pieces cut between words, each with the two words that follow it, so memory is
bounded by the batch and the longest word. A null text has no word; its weight is 0. A null doc_id draws the noise of the empty
name. Repeated rows are documents of their own; their order in the ranking follows doc_id (nulls last), then their place in
the table. Other columns are not read. An empty table gives an empty result; without a benchmark text every target count is 0.
"""

from __future__ import annotations

import re
import tempfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, texts

BUCKETS = 10_000
#: Bytes of a text that are counted at once, and of all texts of a batch.
PIECE, BATCH = 1_000_000, 1_000_000
#: Bucket counts that are weighed at once, or those of one row.
WEIGHED = 500_000
#: Rows of one block of the ranking, at most about so many.
BLOCK_ROWS = 1_000_000
LEAST_WORDS, PERCENT, SEED = 20, 5, 42

#: ASCII capitals in lower case, every other ASCII sign but digits and letters a space.
_PLAIN = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


def _moved(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The CRCs after the zero bytes that table (4 x 256) stands for."""
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


class Shifts:
    """What a CRC becomes when so many bytes follow: a table for each length below 64, and one for each power of two from there."""

    def __init__(self):
        step, own = _byte_table(), np.zeros((65, 4, 256), np.uint32)
        own[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        for n in range(64):
            own[n + 1] = (own[n] >> 8) ^ step[own[n] & 255]
        self.low, self.high = own[:64].reshape(-1), [own[64]]
        while len(self.high) < 25:
            self.high.append(np.stack([_moved(column, self.high[-1]) for column in self.high[-1]]))

    def joined(self, first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
        """CRC of a + b from that of a, that of b, and the bytes of b."""
        at = (length & 63) * 1024
        out = self.low[at + (first & 255)] ^ self.low[at + 256 + ((first >> 8) & 255)] ^ self.low[at + 512 + ((first >> 16) & 255)] ^ self.low[at + 768 + (first >> 24)]
        for k, table in enumerate(self.high):
            far = np.flatnonzero((length >> (6 + k)) & 1)
            if len(far):
                out[far] = _moved(out[far], table)
        return out.astype(np.int64) ^ second


def _flat(a) -> pa.Array:
    return a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a


def _crc(words) -> pa.Array:
    words = _flat(words).cast(pa.binary())
    return pa.array(np.fromiter(map(zlib.crc32, words.to_pylist()), np.int64, len(words)))


def connection(folder: str):
    """A DuckDB connection of one thread, which spills to the folder, with the functions crc and crc_joined."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": folder})
    shifts = Shifts()

    def joined(a, b, n):
        return pa.array(shifts.joined(*(_flat(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b, n))))

    con.create_function("crc", _crc, ["VARCHAR"], "BIGINT", type="arrow")
    con.create_function("crc_joined", joined, ["BIGINT", "BIGINT", "BIGINT"], "BIGINT", type="arrow")
    return con


#: Buckets of all runs of one to three words that start in the body of a piece; the tail has the words that follow.
COUNTS = f"""
CREATE OR REPLACE TEMP TABLE counts AS
WITH lists AS (SELECT seq, list_filter(string_split(body, ' '), lambda x: x <> '') AS own, list_filter(string_split(tail, ' '), lambda x: x <> '') AS more FROM texts),
words AS (SELECT seq, len(own) AS n_own, generate_subscripts(own || more, 1) AS i, unnest(own || more) AS w FROM lists),
names AS (SELECT w, crc(w) AS c, strlen(w)::BIGINT AS n FROM (SELECT DISTINCT w FROM words)),
spaced AS (SELECT w, c, crc_joined({zlib.crc32(b" ")}::BIGINT, c, n) AS sc, n + 1 AS n FROM names),
runs AS (SELECT seq, n_own, i, c, lead(sc) OVER doc AS sc2, lead(n) OVER doc AS n2, lead(sc, 2) OVER doc AS sc3, lead(n, 2) OVER doc AS n3
         FROM words JOIN spaced USING (w) WINDOW doc AS (PARTITION BY seq ORDER BY i)),
two AS (SELECT seq, c, sc3, n3, CASE WHEN sc2 IS NOT NULL THEN crc_joined(c, sc2, n2) END AS c2 FROM runs WHERE i <= n_own),
three AS (SELECT seq, unnest([c, c2, CASE WHEN sc3 IS NOT NULL THEN crc_joined(c2, sc3, n3) END]) AS c FROM two)
SELECT seq, (c % {BUCKETS})::SMALLINT AS bucket, count(*)::INTEGER AS n FROM three WHERE c IS NOT NULL GROUP BY ALL"""
BY_TEXT = "SELECT seq, list(bucket) AS buckets, list(n) AS counts FROM counts GROUP BY seq"
TOTALS = "SELECT list(bucket) AS buckets, list(n) AS counts FROM (SELECT bucket, sum(n)::INTEGER AS n FROM counts GROUP BY bucket)"
WORDS = "SELECT seq, len(list_filter(string_split(body, ' '), lambda x: x <> ''))::BIGINT AS n_words FROM texts"

SPILLED = "place long, doc_id long, n_words long, buckets array<smallint>, counts array<int>"
_LISTS = [("buckets", pa.list_(pa.int16())), ("counts", pa.list_(pa.int32()))]
_OUT = pa.schema([("place", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), *_LISTS])
_NEXT = re.compile(rb"[^ ]+")


def pieces(text: bytes, size: int | None = None):
    """(body, tail) of a plain text: bodies of about size bytes that end between words, with the two words that follow each."""
    size, at = size or PIECE, 0
    while len(text) - at > size:
        cut = text.find(b" ", at + size)
        if cut < 0:
            break
        after, tail = cut, []
        while len(tail) < 2 and (m := _NEXT.search(text, after)):
            tail.append(m[0])
            after = m.end()
        yield text[at:cut], b" ".join(tail)
        at = cut
    yield text[at:], b""


def _spilled(batches):
    """Rows of SPILLED: one for each piece, and for each batch of pieces one without a place that has its totals."""
    top, number = TaskContext.get().partitionId() << 40, 0
    with tempfile.TemporaryDirectory() as folder:
        con = connection(folder)

        def counted(held):
            column = lambda k: pa.array([x[k] for x in held], pa.binary()).cast(pa.string())
            con.register("texts", pa.table({"seq": pa.array(range(len(held)), pa.int32()), "body": column(2), "tail": column(3)}))
            con.execute(COUNTS)
            lists = con.sql(f"SELECT seq, n_words, buckets, counts FROM ({WORDS}) LEFT JOIN ({BY_TEXT}) USING (seq)").to_arrow_table()
            seq = lists["seq"].to_pylist()
            yield from pa.table([pa.array([held[k][0] for k in seq], pa.int64()), pa.array([held[k][1] for k in seq], pa.int64()), lists["n_words"], *(lists[c].cast(t) for c, t in _LISTS)], schema=_OUT).to_batches()
            sums = con.sql(TOTALS).to_arrow_table()
            yield from pa.table([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *(sums[c].cast(t) for c, t in _LISTS)], schema=_OUT).to_batches()

        held, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for body, tail in pieces((text.as_py() or "").encode().translate(_PLAIN)):
                    held.append((top + number, doc_id, body, tail))
                    size += len(body)
                    if size >= BATCH:
                        yield from counted(held)
                        held, size = [], 0
                number += 1
        if held:
            yield from counted(held)
        con.close()


def spilled(docs: DataFrame) -> DataFrame:
    """Bucket counts of every piece of text, and totals of batches, written as Parquet in the shared folder."""
    return materialize(texts(docs).mapInArrow(_spilled, SPILLED), "bucket-counts")


def totals(counts: DataFrame) -> DataFrame:
    """(bucket, n) over all tasks: a row for each bucket that occurs."""
    pairs = counts.where("place IS NULL").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return pairs.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum(F.col("x.counts").cast("long")).alias("n"))


def gains(source: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) of every bucket: thousands of the smoothed log ratio of target to source, rounded down."""
    both = source.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    for side, name in ((source, "s"), (target, "t")):
        both = both.join(F.broadcast(side.select(F.col("bucket").cast("int").alias("bucket"), F.col("n").alias(name))), "bucket", "left")  # BUCKETS rows at most
    both = both.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + BUCKETS) / ((F.col("s") + 1) * (F.col("all_t") + BUCKETS))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))  # sums: one row


def _weighed(batch: pa.RecordBatch, gain: np.ndarray):
    """Batches with n_features and weight in place of the lists, from slices of about WEIGHED list values: an Arrow batch may have many millions."""
    ends = np.cumsum(batch.column(3).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WEIGHED, "right")))
        part = batch.slice(at, stop - at)
        buckets, n = part.column(3), part.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        end = ends[at:stop] - (ends[at - 1] if at else 0)
        out = []
        for values in (n, gain[buckets.flatten().to_numpy(zero_copy_only=False)] * n):
            sums = np.zeros(len(values) + 1, np.int64)
            np.cumsum(values, out=sums[1:])
            out.append(pa.array(np.diff(sums[end], prepend=0)))
        yield pa.RecordBatch.from_arrays([*part.columns[:3], *out], names=["place", "doc_id", "n_words", "n_features", "weight"])
        at = stop


def weighed(counts: DataFrame, gain: DataFrame) -> DataFrame:
    """(place, doc_id, n_words, n_features, weight) of every document."""
    shared = np.zeros(BUCKETS, np.int64)
    for row in gain.collect():  # BUCKETS rows
        shared[row["bucket"]] = row["gain"]
    shared = counts.sparkSession.sparkContext.broadcast(shared)

    def run(batches):
        for batch in batches:
            yield from _weighed(batch, shared.value)

    parts = counts.where("place IS NOT NULL").mapInArrow(run, "place long, doc_id long, n_words long, n_features long, weight long")
    return parts.groupBy("place", "doc_id").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")])


def scored(weights: DataFrame, seed: int = SEED) -> DataFrame:
    """With score: the weight and Gumbel noise drawn from the seed and the doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return weights.withColumn("score", F.col("weight") + noise)


def drawn(scores: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(place, rank) of the highest scores among documents of enough words: ranges of scores are ranked apart and moved by what lies before."""
    spark = scores.sparkSession
    long_enough = scores.where(F.col("n_words") >= least_words)
    n = long_enough.count()
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BLOCK_ROWS))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place")]
    dealt = long_enough.select("place", "doc_id", "score").repartitionByRange(blocks, *order).withColumn("block", F.spark_partition_id())
    dealt = materialize(dealt, "score-blocks")
    take, before, offsets = percent * n // 100, 0, []
    for block, size in sorted(dealt.groupBy("block").count().collect()):  # a row for each block
        if before < take:
            offsets.append((block, before))
        before += size
    known = F.broadcast(spark.createDataFrame(offsets, "block int, before long"))
    place = F.row_number().over(Window.partitionBy("block").orderBy(*order)) + F.col("before")
    return dealt.join(known, "block").select("place", place.cast("long").alias("rank")).where(F.col("rank") <= take)


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): every document; rank is null where it isn't drawn. docs and target have a column text, docs a doc_id."""
    counts, wanted = spilled(docs), spilled(target.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    scores = materialize(scored(weighed(counts, gains(totals(counts), totals(wanted)))), "scores")
    return scores.join(drawn(scores), "place", "left").select("doc_id", "n_features", "weight", "score", "rank")
