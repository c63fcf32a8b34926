"""Document fingerprints by locally consistent parsing.

A text's bytes are level 0. On each level equal neighbours form one block; between them deterministic coin tossing (the
lowest bit in which a name differs from its left neighbour, and that bit's value, three times) gives small labels, and
phrases begin at their local maxima. A phrase is named by a hash of its parts. Where a phrase begins depends on a few
names on either side only, so equal substrings get equal names inside, at any offset. The fingerprint is the least
hashed names of one level (all, if few): equal texts have equal fingerprints, and the likeness of two fingerprints
estimates the Jaccard likeness of the texts' phrases.

Null texts count as empty (fingerprint of the empty set; likeness of two empty sets: 1); documents without a doc_id come
first; ties of doc_id are ordered by text; repeated rows are documents of their own; the document after the last is the first, which for a single row is
itself; an empty table gives an empty result; other columns than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, materialize, mix64, parts_for, texts

#: Names in a fingerprint, and the level they are from.
KEEP, LEVEL = 64, 2
#: Ranges of doc_id at most: their bounds stand in one expression. Larger ranges only run longer, as tasks hold a few megabytes at a time.
MOST_PARTS = 10_000


def _low_bit(x: np.ndarray) -> np.ndarray:
    """Index of the lowest set bit of nonzero numbers."""
    low = (x & (~x + np.uint64(1))).astype(np.float64)
    return (np.log2(low) + 0.5).astype(np.uint64)


_TOSS = np.zeros((256, 256), np.uint8)
for _d in range(1, 256):
    _k = (_d & -_d).bit_length() - 1
    _a = np.arange(256)
    _TOSS[_a, _a ^ _d] = 2 * _k + (_a >> _k & 1)
_TOSS = _TOSS.ravel()


def _toss(x: np.ndarray) -> np.ndarray:
    pair = x[1:].astype(np.uint16)
    pair <<= 8
    pair |= x[:-1]
    return _TOSS.take(pair)


def phrase_starts(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases begin. names: neighbours within a text differ; first: marks each text's first name."""
    n = len(names)
    label = np.zeros(n, np.uint8)
    if names.dtype == np.uint8:
        label[1:] = _toss(names)
    elif n > 1:
        differ = names[1:] ^ names[:-1]
        differ[differ == 0] = 1
        k = _low_bit(differ)
        label[1:] = (2 * k + (names[1:] >> k & np.uint64(1))).astype(np.uint8)
    label[first] = 0
    for _ in range(2):
        again = np.zeros(n, np.uint8)
        again[1:] = _toss(label)
        again[first] = 0
        label = again
    begin = np.zeros(n, bool)
    if n > 2:
        begin[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
        begin[:-1] &= ~first[1:]  # a text's last name begins no phrase, nor does its second
        begin[1:] &= ~first[:-1]
    return begin | first


def parse_level(names: np.ndarray, values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the next level and marks of each text's first. values: 64-bit hashes of names."""
    n = len(names)
    head = np.ones(n, bool)
    head[1:] = (names[1:] != names[:-1]) | first[1:]
    at = np.flatnonzero(head)
    runs = np.diff(np.append(at, n))
    names, values, first = names[at], values[at], first[at]
    long = runs > 1
    values = values.copy()
    values[long] = mix64(values[long] ^ (runs[long].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
    begin = np.flatnonzero(phrase_starts(names if names.dtype == np.uint8 else values, first))
    place = np.arange(len(values)) - np.repeat(begin, np.diff(np.append(begin, len(values))))
    with np.errstate(over="ignore"):
        weighted = values * (np.uint64(2) * place.astype(np.uint64) + np.uint64(0xD1342543DE82EF95))
        made = mix64(np.add.reduceat(weighted, begin) if len(begin) else weighted[:0])
    return made, first[begin]


def phrase_names(blobs: list[bytes], level: int = LEVEL) -> list[np.ndarray]:
    """Distinct phrase names of each text on a level."""
    lengths = np.array([len(b) for b in blobs], np.int64)
    names: np.ndarray = np.frombuffer(b"".join(blobs), np.uint8)
    first = np.zeros(len(names), bool)
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    first[starts] = True
    values = BYTE_VALUES[names]
    for _ in range(level):
        names, first = parse_level(names, values, first)
        values = names
    cut = np.append(np.flatnonzero(first), len(names))
    out, k = [], 0
    for n in lengths.tolist():
        if n:
            out.append(names[cut[k] : cut[k + 1]])
            k += 1
        else:
            out.append(names[:0].astype(np.uint64))
    return out


def sketches(blobs: list[bytes], keep: int = KEEP, level: int = LEVEL) -> list[np.ndarray]:
    """The least keep names (their upper 32 bits) of each text, ascending."""
    out = []
    for own in phrase_names(blobs, level):
        short = np.unique((own >> np.uint64(32)).astype(np.uint32)) if len(own) <= 4 * keep else None
        if short is None:
            limit = max(4 * keep, 1)
            top = (own >> np.uint64(32)).astype(np.uint32)
            short = np.unique(np.partition(top, limit - 1)[:limit])
            if len(short) < keep:
                short = np.unique(top)
        out.append(short[:keep])
    return out


def text_of(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, keep: int = KEEP) -> float:
    """Estimated Jaccard likeness: of the least names of both together, the share that both have."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:keep]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum()) / len(union)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprint(docs: DataFrame, keep: int = KEEP, level: int = LEVEL) -> DataFrame:
    """(doc_id, fingerprint): hexadecimal, eight digits for each name."""

    def run(batches):
        for batch in batches:
            blobs = [(x.as_py() or "").encode() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_of(s) for s in sketches(blobs, keep, level)], pa.string())], names=["doc_id", "fingerprint"])

    return texts(docs).mapInArrow(run, "doc_id long, fingerprint string")


def with_following(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (part, doc_id, text, mark), sorted by doc_id within each part, each part closed by a copy (mark 1) of the first row of the next part; the last by that of the first."""
    spark = docs.sparkSession
    parts = parts or min(parts_for(docs), MOST_PARTS)
    base = texts(docs).withColumn("place", F.coalesce("doc_id", F.lit(-(1 << 63))))  # documents without a doc_id come first
    cuts = base.select(F.percentile_approx("place", [k / parts for k in range(1, parts)], 10000).alias("c")).head()["c"] if parts > 1 else None
    cuts = sorted({int(c) for c in cuts or ()})
    part = F.expr(f"size(filter(array({','.join(f'{c}L' if c > -(1 << 63) else f'({c + 1}L - 1L)' for c in cuts)}), c -> c < place))") if cuts else F.lit(0)
    own = base.withColumn("part", part.cast("int"))
    # one row for each part: its first place, and of equal places the least text
    heads = materialize(own.select("part", "place").groupBy("part").agg(F.min("place").alias("place")), "heads")
    order = [(r[0], r[1]) for r in heads.orderBy("part").collect()]  # one row for each part
    columns = ["part", "doc_id", "text", "mark"]
    if not order:
        return own.withColumn("mark", F.lit(0)).select(columns)
    target = F.create_map(*[F.lit(x) for k, (p, _) in enumerate(order) for x in (p, order[k - 1][0])])
    first = F.broadcast(heads.select(F.col("place").alias("_place"), F.col("part").alias("_part")))
    closing = own.join(first, (F.col("place") == F.col("_place")) & (F.col("part") == F.col("_part"))).groupBy("part", "place").agg(F.min("text").alias("text"))
    closing = closing.select(target[F.col("part")].alias("part"), F.lit(None).cast("long").alias("doc_id"), "text", "place", F.lit(1).alias("mark"))
    both = own.select("part", "doc_id", "text", "place", F.lit(0).alias("mark")).unionByName(closing)
    return both.repartition(len(order), "part").sortWithinPartitions("part", "mark", "place", "text").select(columns)


def _compared(keep: int, level: int):
    def flush(rows):
        """rows: consecutive (part, doc_id, text, mark); gives all but the last."""
        blobs = [r[2].encode() for r in rows]
        own = sketches(blobs, keep, level)
        use = [k for k, r in enumerate(rows[:-1]) if not r[3]]
        changed = [edited(rows[k][2], rows[k + 1][2]).encode() for k in use]
        other = sketches(changed, keep, level)
        cols = [
            pa.array([rows[k][1] for k in use], pa.int64()),
            pa.array([len(rows[k][2]) for k in use], pa.int64()),
            pa.array([hashlib.sha256(b).hexdigest() for b in changed], pa.string()),
            pa.array([text_of(own[k]) for k in use], pa.string()),
            pa.array([text_of(s) for s in other], pa.string()),
            pa.array([likeness(own[k], s, keep) for k, s in zip(use, other, strict=True)], pa.float64()),
            pa.array([likeness(own[k], own[k + 1], keep) for k in use], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=COMPARED.split())

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            d = batch.to_pydict()
            for row in zip(d["part"], d["doc_id"], d["text"], d["mark"], strict=True):
                rows.append(row)
                size += len(row[2])
                if size >= 4_000_000 and len(rows) > 1:
                    yield flush(rows)
                    rows, size = [row], len(row[2])
        if len(rows) > 1:
            yield flush(rows)

    return run


COMPARED = "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next"


def compare_edited(docs: DataFrame, keep: int = KEEP, level: int = LEVEL) -> DataFrame:
    """Each text against its edited text and the next document in ascending doc_id order."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_following(docs).mapInArrow(_compared(keep, level), schema)
