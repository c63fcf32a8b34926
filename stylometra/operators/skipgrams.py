"""Skip-gram word vectors for vocabularies that the driver can't hold: parts of the corpus are trained in tasks, and what they learn is averaged by word.

No table of words is ever whole in one place. A part holds the words that occur in it; a word's first vector follows from the word alone, so that parts begin alike; after an epoch vectors are means over parts,
weighted by occurrences. Loss: negative sampling, as the reference's library has by default, with noise from the part's own counts to the power 0.75.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.tables import stored

#: Numbers of vectors that a part holds: its words x dimensions x 2.
HELD_NUMBERS = 40_000_000
#: Words in the middle of windows that are trained at once, noise words that they share, noise words for each pair, first step.
STEP_WORDS, NOISE, NOISE_EACH, RATE = 128, 64, 5, 0.025
#: Rows of words that leave a task at once.
SENT_ROWS = 50_000


def _first_vectors(words, size: int) -> np.ndarray:
    """A vector for each word, from the word alone, as even as random numbers within 1 / (2 size)."""
    seeds = np.frombuffer(b"".join(hashlib.blake2b(w.encode(), digest_size=8).digest() for w in words), np.uint64)
    out = np.empty((len(seeds), size), np.float32)
    for k in range(size):  # the mixing of splitmix64
        z = seeds + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = (((z ^ (z >> np.uint64(31))) >> np.uint64(40)).astype(np.float64) / 2**24 - 0.5) / size
    return out


def _trained(ids: np.ndarray, sent: np.ndarray, v: np.ndarray, u: np.ndarray, window: int, begin: float, end: float, rng) -> None:
    """One pass over a part: ids of its words and their sentences in order. v (words in windows) and u (words in the middle and noise) change in place; the step falls from begin to end."""
    n, noise = len(ids), np.cumsum(np.bincount(ids, minlength=len(v)) ** 0.75)
    reach, often = rng.integers(1, window + 1, n), np.zeros(len(v), np.int32)
    for at in range(0, n, STEP_WORDS):
        if at % (1000 * STEP_WORDS) == 0:
            drawn = np.minimum(np.searchsorted(noise, rng.random((1000, NOISE)) * noise[-1], "right"), len(v) - 1)
        rate = np.float32(begin + (end - begin) * at / n)
        to, low = min(n, at + STEP_WORDS), max(0, at - window)
        high = min(n, to + window)
        apart = np.abs(np.arange(low, high) - np.arange(at, to)[:, None])
        pairs = (apart <= reach[at:to, None]) & (apart > 0) & (sent[low:high] == sent[at:to, None])
        around, middle, other = ids[low:high], ids[at:to], drawn[at // STEP_WORDS % 1000]
        x, y, z = v[around], u[middle], u[other]
        pull = pairs / (1 + np.exp(np.clip(y @ x.T, -30, 30))) * rate
        push = (pairs.sum(axis=0) * (rate * NOISE_EACH / NOISE))[:, None] / (1 + np.exp(-np.clip(x @ z.T, -30, 30)))
        pull, push = pull.astype(np.float32), push.astype(np.float32)
        # a word that stands many times in one step moves by the mean of four places
        for table, rows, change in ((v, around, pull.T @ y - push @ z), (u, middle, pull @ x), (u, other, -(push.T @ x))):
            np.add.at(often, rows, 1)
            many = often[rows] > 4
            if many.any():
                change[many] *= (4 / often[rows[many]])[:, None]
            often[rows] = 0
            np.add.at(table, rows, change)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _parts(batches, words_of_a_part: int, size: int):
    """Arrow batches of one row (part, words, ids, sent): the different words of some sentences, and the places of all in them."""
    own, ids, sent, held, sents, no = {}, [], [], 0, 0, 0

    def made():
        return pa.RecordBatch.from_arrays(
            [pa.array([(TaskContext.get().partitionId() << 24) + no], pa.int64()), pa.array([list(own)], pa.list_(pa.string())), *(pa.array([np.concatenate(x).astype(np.int32).tobytes()], pa.binary()) for x in (ids, sent))],
            names=["part", "words", "ids", "sent"],
        )

    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            column = whole.column(0).slice(at, 1000)
            number = np.repeat(np.arange(sents, sents + len(column)), column.value_lengths().fill_null(0).to_numpy())
            flat = column.flatten()
            number, flat = number[flat.is_valid().to_numpy(zero_copy_only=False)], flat.drop_null().dictionary_encode()
            if not len(flat):
                continue
            place = np.array([own.setdefault(w, len(own)) for w in flat.dictionary.to_pylist()], np.int32)
            ids.append(place[flat.indices.to_numpy()])
            sent.append(number)
            held, sents = held + len(number), sents + len(column)
            if held >= words_of_a_part or 2 * size * len(own) >= HELD_NUMBERS:
                yield made()
                own, ids, sent, held, sents, no = {}, [], [], 0, 0, no + 1
    if held:
        yield made()


def _merged(rows: DataFrame, size: int, outer: bool) -> DataFrame:
    """(word, n, v, u) with one row for each word: means by n. Rows of a word lie together, so only the last word of an Arrow batch is held."""

    def run(batches):
        last = None

        def made(words, n, *tables):
            means = [(t / n[:, None]).astype(np.float32) for t in tables]
            return pa.RecordBatch.from_arrays([words, pa.array(n), *(_lists(m) for m in means)], names=["word", "n", "v", "u"][: 2 + len(means)])

        for batch in batches:
            if not batch.num_rows:
                continue
            words, n = batch.column(0), batch.column(1).to_numpy()
            tables = [batch.column(k).flatten().to_numpy().reshape(len(n), size) * n[:, None].astype(float) for k in range(2, batch.num_columns)]
            first = np.flatnonzero(np.concatenate([[True], pa.compute.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)]))
            words, n, tables = words.take(pa.array(first)), np.add.reduceat(n, first), [np.add.reduceat(t, first, axis=0) for t in tables]
            if last is not None and last[0][0].as_py() == words[0].as_py():
                n[0] += last[1][0]
                for t, own in zip(tables, last[2:], strict=True):
                    t[0] += own[0]
            elif last is not None:
                yield made(*last)
            if len(n) > 1:
                yield made(words[:-1], n[:-1], *(t[:-1] for t in tables))
            last = (words[-1:], n[-1:].copy(), *(t[-1:].copy() for t in tables))
        if last is not None:
            yield made(*last)

    schema = "word string, n long, v array<float>" + (", u array<float>" if outer else "")
    return rows.repartition("word").sortWithinPartitions("word").mapInArrow(run, schema)


def skip_grams(toks: DataFrame, size: int, window: int, min_count: int, epochs: int, words_of_a_part: int, seed: int = 1) -> DataFrame:
    """(word, v) of every word of toks (words: array of strings) that occurs min_count times or more."""
    ship(toks.sparkSession)

    def learned(part, words, ids, sent, known, epoch, outer):
        """Arrow batches (word, n, v, and u if outer). known: (words kept, their v, their u), or None for first vectors of all."""
        rng, kept = np.random.default_rng([seed, epoch, part]), np.arange(len(words))
        v, u = _first_vectors(words, size), np.zeros((len(words), size), np.float32)
        if known is not None:
            at = {w: k for k, w in enumerate(words)}
            kept = np.array([at[w] for w in known[0]], np.int64)
            for table, own in ((v, known[1]), (u, known[2])):
                if own is not None:
                    table[kept] = own
        place = np.full(len(words), -1, np.int64)
        place[kept] = np.arange(len(kept))
        ids, v, u = place[ids], v[kept], u[kept]
        sent, ids = sent[ids >= 0], ids[ids >= 0]
        if len(ids):
            fall = lambda e: RATE * max(1 - e / epochs, 1e-4)
            _trained(ids, sent, v, u, window, fall(epoch), fall(epoch + 1), rng)
        n = np.bincount(ids, minlength=len(kept))
        for k in range(0, len(kept), SENT_ROWS):
            own = slice(k, k + SENT_ROWS)
            columns = [pa.array([words[j] for j in kept[own]], pa.string()), pa.array(n[own].astype(np.int64)), _lists(v[own]), *([_lists(u[own])] if outer else [])]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "v", "u"][: len(columns)])

    def unpacked(row):
        return row["part"], row["words"], np.frombuffer(row["ids"], np.int32), np.frombuffer(row["sent"], np.int32)

    def first(outer):
        def run(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    yield from learned(*unpacked({c: batch.column(c)[k].as_py() for c in batch.schema.names}), None, 0, outer)

        return run

    def later(epoch, outer):
        def run(part, state):
            if not len(state) or not len(part):
                return pd.DataFrame({c: [] for c in names})
            vectors = [np.stack(state[c].to_numpy()) if state[c].notna().all() else None for c in ("v", "u")]
            found = learned(*unpacked(part.iloc[0]), (state["word"].tolist(), *vectors), epoch, outer)
            return pa.Table.from_batches(found).to_pandas()

        names = ["word", "n", "v", "u"][: 4 if outer else 3]
        return run

    form = "word string, n long, v array<float>"
    pack = lambda batches: _parts(batches, words_of_a_part, size)
    state = None
    if epochs == 1 and min_count <= 1:  # parts are needed once
        return _merged(toks.select("words").mapInArrow(lambda batches: first(False)(pack(batches)), form), size, False).select("word", "v")
    parts = stored(toks.select("words").mapInArrow(pack, "part long, words array<string>, ids binary, sent binary"), "parts")
    if min_count > 1:
        nothing = F.lit(None).cast("array<float>")
        counts = toks.select(F.explode("words").alias("word")).where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
        state = stored(counts.select("word", "n", nothing.alias("v"), nothing.alias("u")), "words")
    for epoch in range(epochs):
        outer = epoch + 1 < epochs
        schema = form + (", u array<float>" if outer else "")
        if state is None:
            got = parts.mapInArrow(first(outer), schema)
        else:
            wanted = parts.select(F.col("part").alias("p"), F.explode("words").alias("word")).join(state.select("word", "v", "u"), "word")
            got = parts.groupBy("part").cogroup(wanted.groupBy("p")).applyInPandas(later(epoch, outer), schema)
        state = _merged(got, size, outer)
        if outer:
            state = stored(state, "vectors")
    return state.select("word", "v")
