"""Substring dedup by relative Lempel-Ziv parsing.

A document is factored greedily against an index of reference blocks; factors of at least `window` words are duplicate
spans. A greedy factor hides windows that cross its end, so parsing resumes window - 1 words before the end of each
factor and every boundary is checked. Blocks are dealt by seed (see repeats), so each document meets every block that
can hold one of its windows.

Nulls and empty texts have no words and lose nothing; texts shorter than a window are kept whole; repeated rows count as
copies; an empty table gives an empty result; other columns than doc_id and text are not read.
Every row is a document, also one without a doc_id or with the doc_id of another.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Polynomial
from .repeats import Scheme, covered, named_texts, repeated_windows, same_row


class RelativeParser:
    """Index of reference blocks (arrays of symbols); parse gives the factors of an array."""

    def __init__(self, blocks: list[np.ndarray], window: int):
        self.window, self.blocks = window, blocks
        self.places: dict[int, list[tuple[int, int]]] = {}
        for k, block in enumerate(blocks):
            for at, h in enumerate(self.hashes(block)):
                self.places.setdefault(h, []).append((k, at))

    def hashes(self, block: np.ndarray) -> list[int]:
        at = np.arange(max(0, len(block) - self.window + 1))
        return Polynomial(block).slices(at, at + self.window).tolist()

    def parse(self, text: np.ndarray, own: int | None = None) -> list[tuple[int, int, int, int]]:
        """(start, length, block, place in block) of the long factors; own: block that is no source of this text."""
        keys, at, out = self.hashes(text), 0, []
        while at < len(keys):
            places = self.places.get(keys[at], ())
            source = next((p for p in places[:2] if p[0] != own), None) or next((p for p in places if p[0] != own), None)
            if source is None:
                at += 1
                continue
            block, place = source
            rest = min(len(text) - at, len(self.blocks[block]) - place)
            differ = np.flatnonzero(text[at : at + rest] != self.blocks[block][place : place + rest])
            length = int(differ[0]) if len(differ) else rest
            if length < self.window:  # another text of the same hash
                at += 1
                continue
            out.append((at, length, block, place))
            at += length - self.window + 1
        return out


def resolve(blocks: list[np.ndarray], window: int) -> list[list[tuple[int, int]]]:
    parser = RelativeParser(blocks, window)
    return [[(at, at + length - window) for at, length, _, _ in parser.parse(b, own=k)] for k, b in enumerate(blocks)]


def scheme(window: int = 35) -> Scheme:
    gram = max(1, min(3, window // 4))
    return Scheme("word", window, max(1, min(24, window - gram + 1)), gram)


def duplicate_spans(docs: DataFrame, window: int = 35) -> DataFrame:
    """(doc_id, tag, spans: array of (lo, hi)): starts of windows of so many words that start elsewhere in docs too."""
    return repeated_windows(named_texts(docs), scheme(window), resolve)


def _kept(window: int):
    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i in range(batch.num_rows):
                words = batch.column(1)[i].as_py().encode().split()
                spans = batch.column(2)[i].as_py()
                keep = words
                if spans:
                    gone = covered(len(words), spans, window)
                    keep = list(compress(words, (~gone).tolist()))
                for column, v in zip(out, (batch.column(0)[i].as_py(), len(words), len(words) - len(keep), b" ".join(keep).decode()), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def without_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the words in no repeated window, joined by one space."""
    base, found = named_texts(docs), duplicate_spans(docs, window)
    met = base.join(found, same_row(base, found), "left").select(base["doc_id"], "text", "spans")
    return met.mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept string")
