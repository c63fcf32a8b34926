"""Suffix-array dedup by a run-length index.

RunIndex is a run-compressed Burrows-Wheeler transform: the symbol and length of each run, and the text positions of
run ends with what their suffixes share with the neighbour across the end. The suffix order that it is built from is not
kept. Matching statistics are streamed over the text from those samples: inside a run, the match of a suffix with its
neighbour in the suffix order is that of the suffix one symbol earlier, less one, so only run ends carry news.
Positions that match for the asked length start a repeated string. Blocks are dealt by seed (see repeats), so every
string that repeats is in one block with its copies. Steps from a suffix to the one before it (lf) and backward search
(occurrences) use the runs alone.

Nulls and empty texts have no bytes; texts shorter than the length are kept whole; repeated rows count as copies; an
empty table gives an empty result; other columns than doc_id and text are not read.
Every row is a document, also one without a doc_id or with the doc_id of another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Scheme, covered, named_texts, repeated_windows, same_row


class RunIndex:
    """Over byte strings; matches never cross from one into the next."""

    def __init__(self, strings: list[np.ndarray]):
        k = len(strings)
        parts = []
        for i, s in enumerate(strings):  # a separator of its own ends each string
            parts += [np.asarray(s, np.int64) + k, np.array([i], np.int64)]
        text = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.starts = np.cumsum([0, *(len(s) + 1 for s in strings)])[:-1]
        self.n, self.separators = len(text), k
        order, levels = suffix_order(text)
        before = text[order - 1]
        heads = np.flatnonzero(np.append(True, before[1:] != before[:-1])) if self.n else np.zeros(0, np.int64)
        self.run_symbols, self.run_lengths = before[heads], np.diff(np.append(heads, self.n))
        inner = heads[heads > 0]
        above, below = order[inner - 1], order[inner]  # the suffixes on both sides of a run's end
        shared = common_prefix(levels, self.n, above, below)
        at, n = np.concatenate([above, below]), np.tile(shared, 2)
        self.sampled = np.unique(at)
        self.shared = np.zeros(len(self.sampled), np.int64)
        np.maximum.at(self.shared, np.searchsorted(self.sampled, at), n)

    def matching(self) -> np.ndarray:
        """For each text position the longest match with another position, streamed from the samples."""
        reach = np.zeros(self.n, np.int64)  # where the longest match seen so far ends
        reach[self.sampled] = self.sampled + self.shared
        return np.maximum(np.maximum.accumulate(reach) - np.arange(self.n), 0) if self.n else reach

    def _less(self) -> tuple[np.ndarray, np.ndarray]:
        """The runs' symbols in ascending order, and how many symbols of the text are less than each."""
        names, at = np.unique(self.run_symbols, return_inverse=True)
        held = np.bincount(at, self.run_lengths, len(names)).astype(np.int64)
        return names, np.cumsum(held) - held

    def rank(self, symbol: int, place: int) -> int:
        """How often the symbol stands before a place of the transform."""
        begin = np.cumsum(self.run_lengths) - self.run_lengths
        own = self.run_symbols == symbol
        return int(np.clip(place - begin[own], 0, self.run_lengths[own]).sum())

    def lf(self, place: int) -> int:
        """The place of the suffix one symbol earlier."""
        symbol = self.run_symbols[np.searchsorted(np.cumsum(self.run_lengths), place, "right")]
        names, less = self._less()
        return int(less[np.searchsorted(names, symbol)]) + self.rank(symbol, place)

    def occurrences(self, pattern: bytes) -> int:
        """How often the pattern occurs, by backward search."""
        names, less = self._less()
        lo, hi = 0, self.n
        for c in reversed(pattern):
            k = np.searchsorted(names, c + self.separators)
            if k == len(names) or names[k] != c + self.separators:
                return 0
            lo, hi = (int(less[k]) + self.rank(c + self.separators, x) for x in (lo, hi))
            if lo >= hi:
                return 0
        return hi - lo


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The suffixes in order, by prefix doubling from packed symbols, and (length, rank by so many first symbols) of each doubling."""
    n = len(text)
    levels: list[tuple[int, np.ndarray]] = [(1, text.astype(np.int32))]
    if not n:
        return np.zeros(0, np.int64), levels
    bits = int(text.max() + 1).bit_length()
    h = max(1, 62 // bits)
    padded = np.concatenate([text + 1, np.zeros(h, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(h):
        key = key << bits | padded[k : n + k]
    while True:
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(False, key[1:] != key[:-1]))
        top = int(rank[order[-1]]) + 2
        if top > n:
            return order, levels
        levels.append((h, rank.astype(np.int32)))
        key = rank * top
        key[: max(0, n - h)] += rank[h:] + 1
        h *= 2


def common_prefix(levels: list[tuple[int, np.ndarray]], n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b."""
    a, b = a.copy(), b.copy()
    length = np.zeros(len(a), np.int64)
    first = levels[1][0] if len(levels) > 1 else 62
    for h, rank in reversed(levels):
        for _ in range(first if h == 1 else 1):
            ok = (a < n) & (b < n)
            same = np.zeros(len(a), bool)
            same[ok] = rank[a[ok]] == rank[b[ok]]
            if not same.any():
                break
            a, b, length = a + h * same, b + h * same, length + h * same
    return length


def resolve(blocks: list[np.ndarray], window: int) -> list[list[tuple[int, int]]]:
    index = RunIndex(blocks)
    long = index.matching() >= window
    edge = np.diff(np.concatenate([[False], long, [False]]).astype(np.int8))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    out: list[list[tuple[int, int]]] = [[] for _ in blocks]
    for lo, hi, k in zip(a.tolist(), b.tolist(), (np.searchsorted(index.starts, a, "right") - 1).tolist(), strict=True):
        out[k].append((lo - int(index.starts[k]), hi - int(index.starts[k])))
    return out


def scheme(length: int = 400) -> Scheme:
    gram = max(1, min(16, length // 4))
    return Scheme("byte", length, max(1, min(200, length - gram + 1)), gram)


def duplicate_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, tag, spans: array of (lo, hi)): first and last byte offsets at which strings of so many bytes start that start elsewhere too."""
    return repeated_windows(named_texts(docs), scheme(length), resolve)


def _kept(length: int):
    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i in range(batch.num_rows):
                blob, spans = batch.column(1)[i].as_py().encode(), batch.column(2)[i].as_py()
                keep, runs = blob, 0
                if spans:
                    gone = covered(len(blob), spans, length)
                    keep = np.frombuffer(blob, np.uint8)[~gone].tobytes()
                    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                for column, v in zip(out, (batch.column(0)[i].as_py(), len(blob), len(blob) - len(keep), runs, keep), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def without_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept is the bytes in no repeated string."""
    base, found = named_texts(docs), duplicate_spans(docs, length)
    met = base.join(found, same_row(base, found), "left").select(base["doc_id"], "text", "spans")
    return met.mapInArrow(_kept(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
