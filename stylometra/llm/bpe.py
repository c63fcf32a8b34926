"""BPE encoding and decoding by a pair occurrence index.

New pieces of a partition are laid out as one array of symbols with links to the next and previous one. The index maps
the rank of each adjacent pair to all its positions; active ranks are applied in ascending order, each to all its
positions from left to right, and the lists of pairs that a merge makes are extended. Pieces seen before in a worker
keep their ids (up to a bound), so the work grows with new pieces, not with the text.

The vocabulary file is a parameter; its special tokens are taken from texts as the tokenizers library takes them. Null
texts count as empty, which have no ids; ill-formed bytes decode to U+FFFD; other columns than doc_id and text are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import environment_path, texts
from .pretokens import Pieces


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files: printable bytes stand for themselves, others follow U+0100 in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class PairIndex:
    """Merges of a byte-level BPE vocabulary (JSON text of the tokenizers library)."""

    #: Lists up to this length are merged by Python, longer ones by numpy.
    SHORT = 24

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.of_byte = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * n
        for token, i in vocab.items():
            self.bytes_of[i] = token.encode() if token in self.special else bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.n = n
        key = self.left * n + self.right
        self.by_key = np.argsort(key, kind="stable")
        self.keys = key[self.by_key]
        self.rank_of = dict(zip(key.tolist(), range(len(key)), strict=True))
        self.parts = (self.left.tolist(), self.right.tolist(), self.merged.tolist())

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is none."""
        key = left * self.n + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.by_key[at], -1) if len(self.keys) else np.full(len(key), -1)

    def encode(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and how many each has."""
        raw = [s.encode() for s in items]
        sizes = np.array([len(b) for b in raw], np.int64)
        symbol = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)].astype(np.int64)
        n = len(symbol)
        owner = np.repeat(np.arange(len(raw)), sizes)
        follow, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        if n:
            last = np.append(owner[1:] != owner[:-1], True)
            follow[last] = n
            before[np.append(True, last[:-1])] = -1
        symbol = np.append(symbol, -1)  # at n: beyond the end
        occurrences: dict[int, list] = {}
        active: list[int] = []

        def put(ranks: np.ndarray, places: np.ndarray) -> None:
            keep = ranks >= 0
            ranks, places = ranks[keep], places[keep]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cut = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1]))
            for r, a, b in zip(ranks[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(ranks)], strict=True):
                if r in occurrences:
                    occurrences[r].append(places[a:b])
                else:
                    occurrences[r] = [places[a:b]]
                    heapq.heappush(active, r)

        at = np.flatnonzero(follow < n)
        put(self.ranks(symbol[at], symbol[follow[at]]), at)
        lefts, rights, news = self.parts
        while active:
            r = heapq.heappop(active)
            a, b, new = lefts[r], rights[r], news[r]
            lists = occurrences.pop(r)
            place = np.concatenate([np.atleast_1d(x) for x in lists]) if len(lists) > 1 else np.atleast_1d(lists[0])
            if len(place) <= self.SHORT:
                self._few(sorted(set(place.tolist())), a, b, new, symbol, follow, before, n, occurrences, active)
                continue
            place = np.unique(place)
            place = place[(symbol[place] == a) & (symbol[follow[place]] == b)]
            if a == b and len(place) > 1:  # of overlapping pairs every second one, from the left
                chained = np.append(False, follow[place[:-1]] == place[1:])
                head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(place))))
                place = place[(np.arange(len(place)) - head) % 2 == 0]
            if not len(place):
                continue
            gone = follow[place]
            after = follow[gone]
            symbol[place], symbol[gone] = new, -2
            follow[place] = after
            inside = after < n
            before[after[inside]] = place[inside]
            prior = before[place]
            some = prior >= 0
            put(
                np.concatenate([self.ranks(symbol[prior[some]], symbol[place[some]]), self.ranks(symbol[place[inside]], symbol[after[inside]])]),
                np.concatenate([prior[some], place[inside]]),
            )
        alive = symbol[:n] >= 0
        return symbol[:n][alive].astype(np.int32), np.bincount(owner[alive], minlength=len(raw))

    def _few(self, places, a, b, new, symbol, follow, before, n, occurrences, active) -> None:
        get, width = self.rank_of.get, self.n
        for p in places:
            if symbol[p] != a or (q := int(follow[p])) >= n or symbol[q] != b:
                continue
            after = int(follow[q])
            symbol[p], symbol[q], follow[p] = new, -2, after
            fresh = []
            if after < n:
                before[after] = p
                fresh.append((get(new * width + int(symbol[after])), p))
            if (prior := int(before[p])) >= 0:
                fresh.append((get(int(symbol[prior]) * width + new), prior))
            for r, place in fresh:
                if r is not None:
                    if r in occurrences:
                        occurrences[r].append(place)
                    else:
                        occurrences[r] = [place]
                        heapq.heappush(active, r)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join([self.bytes_of[i] for i in ids.tolist()]).decode("utf-8", "replace")


#: Characters encoded at once: bounds a worker's memory.
GROUP_CHARS = 3_000_000
_WORKER: dict[str, tuple[PairIndex, Pieces]] = {}


def coder(vocabulary: str) -> tuple[PairIndex, Pieces]:
    """One index for each vocabulary in each worker."""
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _WORKER:
        index = PairIndex(vocabulary)
        _WORKER[key] = index, Pieces(index.encode, index.special)
    return _WORKER[key]


def read_vocabulary(path: str | None = None) -> str:
    with open(path or environment_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def groups(batches, limit: int):
    """(doc_ids, texts) of about limit characters each."""
    ids, out, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = t.as_py() or ""
            ids.append(i)
            out.append(t)
            size += len(t)
            if size >= limit:
                yield ids, out
                ids, out, size = [], [], 0
    if ids:
        yield ids, out


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or read_vocabulary())

    def run(batches):
        _, ids_of = coder(shared.value)
        for ids, own in groups(batches, GROUP_CHARS):
            found = ids_of(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, text) of what encode returns."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary or read_vocabulary())

    def run(batches):
        index, _ = coder(shared.value)
        for batch in batches:
            out = [index.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=["doc_id", "n_tokens", "ids", "text"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, text) of decode(encode(docs)), by one Python worker for each task."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or read_vocabulary())

    def run(batches):
        index, ids_of = coder(shared.value)
        for ids, own in groups(batches, GROUP_CHARS):
            found = ids_of(own)
            back = [index.decode(x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in found], pa.binary()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids", "text"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the encoded and decoded texts."""
    return round_trip(docs, vocabulary).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
