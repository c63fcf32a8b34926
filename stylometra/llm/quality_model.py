"""Quality classifier from supervised subword embeddings.

Words, character 3- and 4-grams of words (spaces at both ends included) and, over the coarse alphabet of classes of
characters, 4- and 8-grams of the text are hashed to buckets with a learned vector each. A
document is the average of its features' vectors, a softmax layer gives its class; both are trained by stochastic
gradient descent in numpy, one document at a time. A score needs only the average over features of a bucket's vector
times the difference of the output vectors, so scoring gathers one number for each feature.

Training takes at most `sample` labelled rows, those of the least hash of doc_id, whole texts, in one task; everything
else covers all rows. Null labels are no labels. Null and empty texts have no feature: their score is the bias alone. Ties of
doc_id in the labels: the least label counts. Other columns are not read; without a label of both classes every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, Polynomial, chunks, texts, word_bounds
from .repeats import joined

BITS = 18
#: Classes of characters: sentence marks 0, capitals 1, small letters and all beyond ASCII 2, digits 3, other signs 4, white space 5, line ends 6.
_CLASS = np.full(129, 4, np.uint8)
_CLASS[list(b".,;:'\"()-?")], _CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 0, 5, 6
_CLASS[65:91], _CLASS[97:123], _CLASS[128], _CLASS[48:58] = 1, 2, 2, 3
#: Bytes of text that are scored at once.
SCORED_BYTES = 500_000
#: Lengths of n-grams of classes: powers of two, the last at most 8.
COARSE = (4, 8)
SAMPLE = 3000


def features(blobs: list[bytes], bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature the buckets of all texts in order, and how many each text has."""
    data, starts, ends = joined(blobs)
    a, b = word_bounds(data)
    first, last = np.searchsorted(a, starts), np.searchsorted(a, ends)
    shift = np.uint64(64 - bits)
    out = [((Polynomial(BYTE_VALUES[data]).slices(a, b) >> shift).astype(np.int32), last - first)]
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    starts, ends = lead[starts], lead[ends]

    def add(code: np.ndarray, ok: np.ndarray) -> None:
        place = np.zeros(len(ok) + 1, np.int64)
        np.cumsum(ok, out=place[1:])
        code = code[ok]
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        out.append(((code >> shift).astype(np.int32), place[np.minimum(ends, len(ok))] - place[np.minimum(starts, len(ok))]))

    if len(points) >= 4:  # n-grams inside words or with the white space at their ends
        space = (points == 32) | ((points >= 9) & (points <= 13))
        plain = np.where(space, np.uint32(32), points).astype(np.uint64)
        inside = ~space[1:-1]
        three = plain[:-2] + (plain[1:-1] << np.uint64(21)) + (plain[2:] << np.uint64(42))
        add(three * np.uint64(0x9E3779B97F4A7C15), inside)
        add((three[:-1] ^ plain[3:] * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x165667B19E3779F9), inside[:-1] & inside[1:])
    kinds = _CLASS[np.minimum(points, 128)].astype(np.uint32)
    edges = np.zeros(len(points) + 1, np.int32)  # line feeds that end texts, before each place: no n-gram holds one
    edges[ends + 1] = 1
    edges = np.cumsum(edges)
    code, n = kinds, 1
    while 2 * n <= COARSE[-1] and len(code) > n:  # an n-gram of classes from its halves, three bits a class
        code, n = (code[:-n] << np.uint32(3 * n)) + code[n:], 2 * n
        if n in COARSE:
            free = edges[n : n + len(code)] == edges[: len(code)]
            place = np.zeros(len(free) + 1, np.int64)
            np.cumsum(free, out=place[1:])
            own = (code[free] + np.uint32(n)) * np.uint32(0x9E3779B1)
            own ^= own >> np.uint32(15)
            own *= np.uint32(0x85EBCA6B)
            out.append(((own >> np.uint32(32 - bits)).astype(np.int32), place[np.minimum(ends, len(free))] - place[np.minimum(starts, len(free))]))
    return out


@dataclass
class Model:
    vectors: np.ndarray  # bucket x dimension
    output: np.ndarray  # dimension x 2
    bias: np.ndarray  # 2

    def weights(self) -> np.ndarray:
        """One number for each bucket: its vector times the difference of the output vectors."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float32)

    def folded(self) -> Model:
        """The same scores from vectors of one dimension, the weights."""
        return Model(self.weights()[:, None], np.array([[0, 1]], np.float32), self.bias)

    @property
    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def score(blobs: list[bytes], weights: np.ndarray, offset: float, bits: int = BITS) -> np.ndarray:
    total, n = np.zeros(len(blobs)), np.zeros(len(blobs), np.int64)
    for bucket, count in features(blobs, bits):
        sums = np.zeros(len(bucket) + 1)
        np.cumsum(weights[bucket], dtype=np.float64, out=sums[1:])
        end = np.cumsum(count)
        total += sums[end] - sums[end - count]
        n += count
    return 1 / (1 + np.exp(-(total / np.maximum(n, 1) + offset)))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int = BITS, dim: int = 10, epochs: int = 6, rate: float = 3.0, least: int = 5, smooth: float = 0.01, seed: int = 7) -> Model:
    """rows: (label, distinct buckets, their shares of the text's features, which sum to 1).

    Buckets in fewer than `least` rows keep a vector of zeros: they could only memorise single documents. They are taken
    out of the list rows itself.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.01, 0.01, (1 << bits, dim)).astype(np.float32)
    output, bias = rng.uniform(-1, 1, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    held = np.zeros(1 << bits, np.int64)
    for _, b, _ in rows:
        held[b] += 1
    vectors[held < least] = 0
    for k, (y, b, w) in enumerate(rows):  # in place: no need to hold both lists
        rows[k] = (y, b[held[b] >= least], w[held[b] >= least])
    if len({r[0] for r in rows}) < 2:
        return Model(vectors, output, bias)
    steps, total, squares = 0, epochs * len(rows), np.zeros(1 << bits, np.float32)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            label, bucket, share = rows[k]
            lr = rate * (1 - steps / total)
            steps += 1
            own = vectors[bucket]
            hidden = share @ own
            logit = hidden @ output + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[label] -= 1
            back = output @ p
            output -= lr * np.outer(hidden, p)
            bias -= 0.1 * lr * p
            # a bucket's steps shrink with the squares of its gradients so far, so that its scale doesn't matter
            squares[bucket] += share * share * np.float32(back @ back)
            vectors[bucket] = own - lr * np.outer(share / np.sqrt(squares[bucket] + np.float32(smooth)), back)
    return Model(vectors, output, bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, bits: int = BITS, seed: int = 7) -> Model:
    """labels: (doc_id, label 0 or 1)."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label"))
    drawn = known.orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id").limit(sample)

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for t, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                bucket = np.concatenate([own for own, _ in features([t.as_py().encode()], bits)])
                if len(bucket):
                    bucket, n = np.unique(bucket, return_counts=True)
                    for column, v in zip(out, (y, bucket.astype("<i4").tobytes(), (n / n.sum()).astype("<f4").tobytes()), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["label", "bucket", "share"])

    def trained(batches):
        got = [(y.as_py(), np.frombuffer(b.as_py(), "<i4"), np.frombuffer(w.as_py(), "<f4")) for batch in batches for y, b, w in zip(*batch.columns, strict=True)]
        got.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
        model = train(got, bits, seed=seed).folded()
        yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f4").tobytes()], pa.binary()) for x in (model.vectors, model.bias)], names=["weights", "bias"])

    # at most `sample` rows are sent to every task: of rows that repeat a doc_id the least text counts
    met = texts(docs).join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = met.select("text", "label").mapInArrow(run, "label int, bucket binary, share binary")
    # one task trains on the sample, so that the driver gets a number for each bucket and no features
    found = rows.repartition(1).mapInArrow(trained, "weights binary, bias binary").collect()
    if not found:  # no row, so Spark may run no task
        return train([], bits, seed=seed).folded()
    ((weights, bias),) = found
    return Model(np.frombuffer(weights, "<f4")[:, None], np.array([[0, 1]], np.float32), np.frombuffer(bias, "<f4"))


def predict(docs: DataFrame, model: Model, threshold: float = 0.3, bits: int = BITS) -> DataFrame:
    """(doc_id, score, predicted)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights(), model.offset))

    def run(batches):
        for ids, blobs in chunks(batches, SCORED_BYTES):
            weights, offset = shared.value
            s = score(blobs, weights, offset, bits)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(doc_id: str):
    """crc32 of the id's text mod 5 is 0; an id that is null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0
