"""Language identification by prediction by partial matching.

For each language a byte context tree of variable order, at most ORDER bytes deep, holds how often each byte followed each context in
the sample. Texts are coded in lower case, with one space for each run of ASCII signs other than letters: how loud a text is says nothing about
its language. A byte costs its share at the deepest context in which it was seen, and an escape at each deeper context that
knows other bytes only; the share of a byte seen c times is c / (n + d), that of the escape d / (n + d), where n bytes, d of them
different, followed the context. Below the empty context all 256 bytes are alike. Statistics are frozen: what a text has taught nothing is updated by it.
The language whose code for the whole text is shortest wins, of equals the lesser name; score is its share of 2 ** -length over all languages.

What a language pays for a byte depends on the deepest context alone, so costs of all languages are worked out once for every run of bytes
that any of them knows, and for escapes likewise: scoring looks each position's longest run up, and only where no language knows it
a shorter one. Lengths are exact, equal to a walk down each tree (see the tests).

The sample of a language: whole texts in order of a hash of doc_id, as long as they stay within SAMPLE_BYTES together and SAMPLE_ROWS
in number; a text longer than that is not part of the sample. Everything else covers all rows and whole texts. Null languages teach
nothing, null and empty texts neither. A text that is null or has no letter gets `und` and score 0, as do all texts where no language was
learned. Rows that repeat a doc_id are texts of their own. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
ORDER = 4
SAMPLE_BYTES, SAMPLE_ROWS = 300_000, 2000
#: Bytes of text that are scored at once.
SCORED_BYTES = 500_000
UNKNOWN = "und"


_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def plain(text: str) -> bytes:
    """The bytes that are coded."""
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


def runs(data: np.ndarray, order: int):
    """For k from 0 to order: a number for each position's byte and the k before it; data begins with `order` padding bytes."""
    code = data[order:].astype(np.uint64)
    yield code
    for k in range(1, order + 1):
        code = code + (data[order - k : len(data) - k].astype(np.uint64) << np.uint64(8 * k))
        yield code


class Table:
    """Numbers below 2**63 to rows, by open addressing in arrays at most a quarter full."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.keys, self.rows = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        place, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[place[left]] < 0
            own = left[free]
            self.keys[place[own]] = keys[own].astype(np.int64)  # of those that meet in a slot one stays
            self.rows[place[own]] = own
            left = left[self.keys[place[left]] != keys[left].astype(np.int64)]
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it isn't there."""
        place = self._slots(keys)
        want, there = keys.view(np.int64), self.keys[place]
        out = np.where(there == want, self.rows[place], -1)
        left = np.flatnonzero((there != want) & (there >= 0))
        while len(left):
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[place[left]]
            hit = there == want[left]
            out[left[hit]] = self.rows[place[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


@dataclass
class Model:
    """Costs in bits, a column for each language: of known runs of k + 1 bytes, and of the escape from known contexts of k bytes."""

    names: list[str]
    order: int
    runs: list[Table]
    costs: list[np.ndarray]
    contexts: list[Table]
    escapes: list[np.ndarray]

    def bits(self, blobs: list[bytes]) -> np.ndarray:
        """Code length of each text under each language."""
        pad = b"\x00" * self.order
        data = np.frombuffer(pad + pad.join(blobs), np.uint8)
        size = np.array([len(b) for b in blobs])
        start = np.cumsum(size + self.order) - size - self.order
        total = np.zeros((len(blobs), len(self.names)))
        for at in range(0, len(data) - self.order, SCORED_BYTES):
            cost = self._costs(data[at : at + SCORED_BYTES + self.order])
            sums = np.zeros((len(cost) + 1, len(self.names)))
            np.cumsum(cost, axis=0, dtype=np.float64, out=sums[1:])
            total += sums[np.clip(start + size - at, 0, len(cost))] - sums[np.clip(start - at, 0, len(cost))]
        return total

    def _costs(self, data: np.ndarray) -> np.ndarray:
        """Bits for each byte after the first `order`, under each language."""
        codes = list(runs(data, self.order))
        found = self.runs[-1].find(codes[-1])
        cost = self.costs[-1][found]
        left = np.flatnonzero(found < 0)
        cost[left] = 0
        for k in range(self.order, -1, -1):
            context = self.contexts[k].find(codes[k][left] >> np.uint64(8))
            seen = context >= 0
            cost[left[seen]] += self.escapes[k][context[seen]]
            if not k:
                break
            found = self.runs[k - 1].find(codes[k - 1][left])
            known = found >= 0
            cost[left[known]] += self.costs[k - 1][found[known]]
            left = left[~known]
        cost[left] += np.float32(8)  # below the empty context
        return cost


def build(counts: list[tuple[str, int, int, int]], order: int = ORDER) -> Model:
    """counts: (language, k, run of k + 1 bytes, how often)."""
    names = sorted({c[0] for c in counts})
    number = {x: i for i, x in enumerate(names)}
    held: list[tuple] = [([], [], []) for _ in range(order + 1)]
    for name, k, code, n in counts:
        for column, v in zip(held[k], (number[name], code, n), strict=True):
            column.append(v)
    model = Model(names, order, [], [], [], [])
    for k in range(order + 1):
        own, code, n = np.array(held[k][0], np.int64), np.array(held[k][1], np.uint64), np.array(held[k][2], np.float64)
        run, at = np.unique(code, return_inverse=True)
        context, up = np.unique(run >> np.uint64(8), return_inverse=True)
        often = np.zeros((len(run), len(names)))
        often[at, own] = n
        total, kinds = np.zeros((len(context), len(names))), np.zeros((len(context), len(names)))
        np.add.at(total, up, often)
        np.add.at(kinds, up, often > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
            cost = -np.log2(often / (total + kinds)[up])
        if k:  # where a language lacks a run it escapes, if it knows the context, and pays for the shorter run
            place = model.runs[k - 1].find(run & np.uint64((1 << (8 * k)) - 1))
            lower = model.costs[k - 1][place]
        else:
            lower = np.full((len(run), len(names)), 8.0)
        cost = np.where(often > 0, cost, escape[up] + lower)
        model.runs.append(Table(run))
        model.costs.append(cost.astype(np.float32))
        model.contexts.append(Table(context))
        model.escapes.append(escape.astype(np.float32))
    return model


def _counted(order: int):
    def run(batches):
        held: dict[str, list[bytes]] = {}
        for batch in batches:  # the sample of a few languages
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(name, []).append(plain(text))
        for name in sorted(held):
            own = [runs(np.frombuffer(b"\x00" * order + b, np.uint8), order) for b in held[name] if b]
            for k, codes in enumerate(zip(*own, strict=True)):
                code, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(np.full(len(code), k, np.int32)), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "k", "code", "n"])

    return run


def sample(docs: DataFrame, training: Column, most_bytes: int = SAMPLE_BYTES, most_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, text) of the sample: at most so many rows and bytes a language, drawn by a hash of doc_id among rows where training holds; equal rows count once."""
    size = F.octet_length("text").cast("long")
    known = docs.where(training & F.col("lang").isNotNull() & (size > 0) & (size <= most_bytes))
    named = known.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", F.lit(11)).alias("draw"), F.xxhash64("text").alias("name"), "text")
    w = Window.partitionBy("lang").orderBy("draw", "name")
    # names alone are ranked, and those beyond most_rows go in each task before the shuffle
    first = named.select("lang", "draw", "name", F.octet_length("text").cast("long").alias("size")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= most_rows)
    drawn = first.withColumn("sum", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("sum") <= most_bytes)
    key = ["lang", "draw", "name"]
    return named.join(F.broadcast(drawn.select(*key).distinct()), key).groupBy(*key).agg(F.first("text").alias("text")).select("lang", "text")  # at most most_rows a language are sent

def fit(docs: DataFrame, training: Column, order: int = ORDER, most_bytes: int = SAMPLE_BYTES, most_rows: int = SAMPLE_ROWS) -> Model:
    """Runs are counted in a task for each language's sample; the driver gets at most (order + 1) x most_bytes of them for each language."""
    ship(docs.sparkSession)
    found = sample(docs, training, most_bytes, most_rows).repartition("lang").mapInArrow(_counted(order), "lang string, k int, code long, n long")
    got = found.toArrow()
    return build(list(zip(*(got[c].to_pylist() for c in ("lang", "k", "code", "n")), strict=True)), order)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(ids, blobs, letters):
        names, out = shared.value.names, ([], [])
        bits = shared.value.bits(blobs) if names else None
        for k, letter in enumerate(letters):
            if not letter or not names:
                out[0].append(UNKNOWN)
                out[1].append(0.0)
            else:
                best = int(bits[k].argmin())
                out[0].append(names[best])
                out[1].append(float(1 / np.exp2(np.maximum(bits[k][best] - bits[k], -1000)).sum()))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out[0], pa.string()), pa.array(out[1], pa.float64())], names=["doc_id", "lang_pred", "score"])

    def run(batches):
        ids, blobs, letters, size = [], [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = t.as_py() or ""
                ids.append(i)
                letters.append(has_letter(text))
                blobs.append(plain(text) if letters[-1] else b"")
                size += len(blobs[-1]) + 1
                if size >= SCORED_BYTES:
                    yield scored(ids, blobs, letters)
                    ids, blobs, letters, size = [], [], [], 0
        if ids:
            yield scored(ids, blobs, letters)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str) -> Column:
    """crc32 of the id's text mod 4 is 2; an id that is null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2
