"""MinHash near-dedup by Order MinHash.

Each of `samples` sketches takes the `length` least hashed k-mers (k words; the n-th occurrence of a k-mer in a text is
a k-mer of its own) and keeps them in the order of the text, so sketches agree where texts are close in edit distance,
not only in content. Texts that share a sketch are candidates; a candidate pair is a link if banded alignment of the
words (diagonals within the greatest distance allowed) finds an edit similarity, 1 - distance / longer text's words, of
at least `similarity`. Classes are the connected components of links.

Texts of at least LONG_FROM words are sketched by k-mers of k words, texts of at most SHORT_TO words (also) by pairs of
words; a pair within the threshold has both its texts in one of the two families.

A text's marks decide which candidates are aligned: a byte of the first name of each sketch (pairs of which fewer than
`agreeing` are equal are out), and for each of BINS parts of hash space a byte of the least word there, again by
occurrence. Texts within the threshold share similarity / (2 - similarity) of all their words; pairs whose bins show
less than that by three deviations are out.

Equal texts are one node, so copies meet no alignment. In each group of a sketch (large ones in blocks) each text is
first led to the text that agrees best with all of the block, and aligned with the best of its leaders; again with one
text of each component that came of it. What one component of links holds needs no more alignment. In the groups that
still have texts of several components all pairs across them are compared by their marks (large groups in blocks, over
many tasks); what passes ties texts to regions, of which only the ties of a spanning forest are written. Each region's
texts then meet once (large regions in blocks): the pairs that pass are aligned, the most alike first, unless links
found by then hold both. So a pair is left out only if its texts share no sketch or too few marks; README.md has the
measured share.

Null texts count as empty; empty texts are copies of each other; texts of fewer than k words have one k-mer, all their
words; words are compared in lower case. Every row is a document: documents without a doc_id and rows that repeat a
doc_id take part by their text. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, NO_ID, Polynomial, chunks, materialize, mix64, texts, word_bounds
from .components import components
from .repeats import joined

WORDS, SIMILARITY, SAMPLES, LENGTH, AGREEING, BINS = 3, 0.8, 48, 2, 5, 128
#: Words of texts in the family of long and of short texts; LONG_FROM is at most SIMILARITY times SHORT_TO + 1.
LONG_FROM, SHORT_TO, SHORT_WORDS = 32, 40, 2
#: Rows of a group of texts that are compared in one piece, and bytes of their texts where those are aligned.
BLOCK, BLOCK_BYTES = 1000, 8_000_000
#: Blocks that a region of up to SPREAD times BLOCK texts may be cut into, so that many tasks share it.
SPREAD = 6
#: Rows of a piece that are compared with all of it at once.
STRIPE = 256
#: Bytes of text that are sketched at once: arrays of their words stay in a processor's cache.
SKETCHED_BYTES = 400_000


def occurrences(names: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How often each name came before in the text that owns it."""
    key = names ^ mix64(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order][1:] != key[order][:-1])
    place = np.arange(len(order))
    out = np.empty(len(order), np.uint64)
    out[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return out


def sketches(blobs: list[bytes], k: int = WORDS, samples: int = SAMPLES, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit sketch for each sample (column) of each text (row), the texts' marks, and their words."""
    data, starts, ends = joined(blobs)
    a, b = word_bounds(data)
    words = Polynomial(BYTE_VALUES[data]).slices(a, b)
    first, last = np.searchsorted(a, starts), np.searchsorted(a, ends)
    out, marks = np.zeros((len(blobs), samples), np.uint64), np.zeros((len(blobs), samples + BINS), np.uint8)
    some = np.flatnonzero(last > first)
    if not len(some):
        return out, marks, last - first
    owner = np.repeat(np.arange(len(blobs)), last - first)
    labelled = mix64(words + occurrences(words, owner) * np.uint64(0x9E3779B97F4A7C15))
    least = np.full(len(blobs) * BINS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    np.minimum.at(least, owner * BINS + (labelled >> np.uint64(40)).astype(np.int64) % BINS, labelled)
    tags = (least % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    tags[least == np.uint64(0xFFFFFFFFFFFFFFFF)] = 0
    marks[:, samples:] = tags.reshape(len(blobs), BINS)

    count = np.maximum(last - first - k + 1, 1)[some]  # k-mers of each text
    begin = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(some)), count)
    at = np.repeat(first[some] - begin, count) + np.arange(int(count.sum()))
    grams = Polynomial(words).slices(at, np.minimum(at + k, last[some][owner]))
    grams = mix64(grams + occurrences(grams, owner) * np.uint64(0x9E3779B97F4A7C15))
    # the place of a k-mer stands in the low bits of its hash, so a least hash tells where it is
    low = np.uint64((1 << max(1, int(len(grams) - 1).bit_length())) - 1)
    place = np.arange(len(grams), dtype=np.uint64)
    salts = mix64(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
    h, worst = np.empty_like(grams), np.uint64(0xFFFFFFFFFFFFFFFF)
    for s in range(samples):
        np.multiply(grams, salts[s], out=h)
        h &= ~low
        h |= place
        where = np.empty((length, len(some)), np.int64)
        for row in where:
            row[:] = np.minimum.reduceat(h, begin) & low
            row[count < len(where)] = np.minimum(row, begin + count - 1)[count < len(where)]  # all k-mers of the text are taken
            h[row] = worst
        marks[some, s] = grams[where[0]] & np.uint64(255)
        where.sort(axis=0)
        value = np.full(len(some), s + 1, np.uint64)
        for row in where:
            value = mix64(value * np.uint64(0x100000001B3) ^ grams[row])
        out[some, s] = value
    return out, marks, last - first


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance (insert, delete, replace) of two symbol arrays if it is at most `most`, else most + 1.

    Only diagonals within `most` are kept: for each number of edits the furthest place on each diagonal.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    shared = min(n, m)

    def run(i: int, j: int) -> int:
        """Equal symbols from a[i] and b[j] on."""
        step, done = 16, 0
        while True:
            size = min(step, n - i - done, m - j - done)
            if size <= 0:
                return done
            differ = a[i + done : i + done + size] != b[j + done : j + done + size]
            k = int(differ.argmax())
            if differ[k]:
                return done + k
            done += size
            step *= 4

    goal = m - n
    furthest = {0: run(0, 0)}  # by diagonal j - i: the place in a
    if goal == 0 and furthest[0] >= shared:
        return 0
    for d in range(1, most + 1):
        now = {}
        for diagonal in range(-d, d + 1):
            if abs(diagonal) > most:
                continue
            i = max(furthest.get(diagonal, -2) + 1, furthest.get(diagonal - 1, -2), furthest.get(diagonal + 1, -2) + 1)
            if i < 0:
                continue
            i = min(i, n, m - diagonal)
            if i < 0 or i + diagonal < 0:
                continue
            i += run(i, i + diagonal)
            now[diagonal] = i
            if diagonal == goal and i >= n:
                return d
        furthest = now
    return most + 1


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """banded_distance by bit vectors of a column of the alignment (Myers, Hyyrö): for wide bands."""
    n, m = len(a), len(b)
    if abs(n - m) > most or not n or not m:
        return min(max(n, m), most + 1)
    places: dict = {}
    for i, x in enumerate(a.tolist()):
        places.setdefault(x, []).append(i)
    equal = {x: sum(1 << i for i in at) for x, at in places.items()}
    whole, last = (1 << n) - 1, 1 << (n - 1)
    up, down, score, left = whole, 0, n, m
    for y in b.tolist():
        e = equal.get(y, 0)
        v = e | down
        h = (((e & up) + up) ^ up) | e
        more, less = (down | ~(h | up)) & whole, up & h
        score += 1 if more & last else -1 if less & last else 0
        left -= 1
        if score - left > most:
            return most + 1
        more, less = (more << 1) | 1, less << 1
        up, down = (less | ~(v | more)) & whole, more & v & whole
    return score


def symbols_of(text: str) -> np.ndarray:
    data, _, _ = joined([text.lower().encode()])
    a, b = word_bounds(data)
    return Polynomial(BYTE_VALUES[data]).slices(a, b)


def anchored_distance(a: np.ndarray, b: np.ndarray, k: int = WORDS) -> int:
    """An upper bound of the edit distance: the alignment through k-mers that occur once in either, in rising order on both sides."""
    n, m = len(a), len(b)
    whole = max(n, m)
    if min(n, m) < k:
        return whole
    x, y = (Polynomial(v).slices(np.arange(len(v) - k + 1), np.arange(k, len(v) + 1)) for v in (a, b))
    (ux, px, cx), (uy, py, cy) = (np.unique(v, return_index=True, return_counts=True) for v in (x, y))
    _, ix, iy = np.intersect1d(ux[cx == 1], uy[cy == 1], assume_unique=True, return_indices=True)
    if not len(ix):
        return whole
    pa_, pb_ = px[cx == 1][ix], py[cy == 1][iy]
    order = np.argsort(pa_)
    pa_, pb_ = pa_[order], pb_[order]
    rising = pb_ > np.maximum.accumulate(np.append(-1, pb_))[:-1]  # drop what falls back behind
    pa_, pb_ = np.append(pa_[rising], n), np.append(pb_[rising], m)
    da, db = np.diff(pa_), np.diff(pb_)
    cost = np.maximum(da, db) - np.minimum(np.minimum(da, db), k)  # the first k words of a gap agree
    even = np.flatnonzero((da == db) & (cost > 0))
    if len(even):  # gaps of equal length: words that differ place by place
        lengths = da[even]
        place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        wrong = a[np.repeat(pa_[even], lengths) + place] != b[np.repeat(pb_[even], lengths) + place]
        cost[even] = np.add.reduceat(wrong, np.cumsum(lengths) - lengths)
    return int(max(pa_[0], pb_[0]) + cost.sum())


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY, k: int = WORDS) -> bool:
    """Whether the edit similarity reaches the threshold.

    Two cheap bounds decide most pairs: words without a partner from below, an alignment through common k-mers from above.
    """
    longer = max(len(a), len(b))
    most = int(np.floor((1 - similarity) * longer + 1e-9))
    if abs(len(a) - len(b)) > most or longer - _common(a, b) > most:
        return False
    return anchored_distance(a, b, k) <= most or (banded_distance if most < 8 else edit_distance)(a, b, most) <= most


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Words that both have, as often as both have them."""
    both = np.concatenate([a, b])
    side = np.zeros(len(both), np.int64)
    side[: len(a)] = 1
    order = np.argsort(both)
    both, side = both[order], side[order]
    first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(both)))
    from_a = np.add.reduceat(side, first) if len(first) else n
    return int(np.minimum(from_a, n - from_a).sum())


def _sketched(k: int, samples: int, length: int):
    """(doc_id, text) to a row for each family of each text; of equal texts that meet in a task only the first is sketched."""

    def run(batches):
        seen: set[bytes] = set()
        for _, blobs in chunks(batches, SKETCHED_BYTES):
            fresh = {}
            for x in blobs:
                h = hashlib.sha256(x).digest()
                if h not in seen:
                    seen.add(h)
                    fresh[h] = x.decode().lower().encode()
            lower, digests = list(fresh.values()), np.array(list(fresh), object)
            n = np.array([len(x.split()) for x in lower], np.int64)
            for family, own in enumerate((n >= LONG_FROM, n <= SHORT_TO)):
                at = np.flatnonzero(own)
                if not len(at):
                    continue
                flat, marks, words = sketches([lower[i] for i in at], SHORT_WORDS if family else k, samples, length)
                flat[flat != 0] ^= np.uint64(family)  # the families share no group
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, samples, dtype=np.int32)), pa.array(flat.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(digests[at].tolist(), pa.binary()), pa.array(np.full(len(at), family, np.int32)), pa.array(words.astype(np.int32)), rows, pa.array([x.tobytes() for x in marks], pa.binary())], names=["digest", "family", "words", "sketch", "marks"])

    return run


def _verified(similarity: float, k: int):
    def run(batches):
        for batch in batches:
            last, kept = None, None
            a, b, ok = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for y, t, u in zip(b, batch.column(2), batch.column(3), strict=True):
                if y != last:
                    last, kept = y, symbols_of(u.as_py())
                ok.append(similar(symbols_of(t.as_py()), kept, similarity, k))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ok, pa.bool_())], names=["b", "a", "same"])

    return run


def alike(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, samples: int, similarity: float, agreeing: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of marks (rows) with their words: the indices of those that may reach the similarity, and how well they agree."""
    at = np.flatnonzero(np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9)
    agree = (x[at, :samples] == y[at, :samples]).sum(axis=1)
    at, agree = at[agree >= agreeing], agree[agree >= agreeing]
    p, q = x[at, samples:], y[at, samples:]
    used = ((p | q) != 0).sum(axis=1)
    same = ((p == q) & (p != 0)).sum(axis=1)
    share = similarity / (2 - similarity)
    ok = same >= used * share - 3 * np.sqrt(used * share * (1 - share))
    return at[ok], (agree[ok] * 1000 + same[ok] * 1000 // np.maximum(used[ok], 1)).astype(np.int32)


def _pieces(samples: int):
    """Rows sorted by (bucket, piece) to lists of columns, whole pieces only: bucket, piece, block, node, root, words, marks."""

    def run(batches):
        rows = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            now.append(np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(batch.num_rows, -1))
            differs = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = int(differs[-1]) + 1 if len(differs) else 0  # the last piece may go on in the next batch
            if rows and (rows[-1][0][-1] != now[0][0] or rows[-1][1][-1] != now[1][0]):
                yield [np.concatenate(c) for c in zip(*rows, strict=True)]
                rows = []
            if cut:
                yield [np.concatenate(c) for c in zip(*rows, [c[:cut] for c in now], strict=True)]
                rows = []
            rows.append([c[cut:] for c in now])
        if rows:
            yield [np.concatenate(c) for c in zip(*rows, strict=True)]

    return run


def _pair_batch(x: np.ndarray, y: np.ndarray, agree: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(agree)], names=["a", "b", "agree"])


def _bounds(bucket: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (piece[1:] != piece[:-1])))
    return new, np.diff(np.append(new, len(bucket)))


def _led(samples: int, similarity: float, agreeing: int):
    """Of each piece the pairs of its leader, the text whose marks agree most with all of the piece, and another."""

    def run(batches):
        for bucket, piece, _, node, _, words, marks in _pieces(samples)(batches):
            new, size = _bounds(bucket, piece)
            lead = new.copy()
            for g in np.flatnonzero(size > 2).tolist():
                own = marks[new[g] : new[g] + size[g], :samples]
                held = np.zeros((256, samples), np.int32)
                np.add.at(held, (own, np.arange(samples)), 1)
                lead[g] += int(np.take_along_axis(held, own.astype(np.int64), axis=0).sum(axis=1).argmax())
            lead = np.repeat(lead, size)
            i = np.flatnonzero(node != node[lead])
            j = lead[i]
            at, agree = alike(marks[i], marks[j], words[i], words[j], samples, similarity, agreeing)
            yield _pair_batch(node[i[at]], node[j[at]], agree)

    return run


def compatible(block: np.ndarray, root: np.ndarray, words: np.ndarray, marks: np.ndarray, whole: bool, samples: int, similarity: float, agreeing: int):
    """Pairs of rows of different roots that may reach the similarity, by stripes: (rows, rows, how well they agree). Not whole: only pairs of different blocks."""
    names, at, n = np.unique(root, return_inverse=True, return_counts=True)
    rows = np.flatnonzero(at != n.argmax()) if len(names) > 1 else at[:0]  # pairs within the largest root are not needed
    columns = np.ascontiguousarray(marks[:, :samples].T)
    for start in range(0, len(rows), STRIPE):
        own = rows[start : start + STRIPE]
        agree = np.zeros((len(own), len(root)), np.uint8)
        for column in columns:
            agree += column[own][:, None] == column
        x, y = np.nonzero(agree >= agreeing)
        x = own[x]
        ok = (root[x] != root[y]) & ((x < y) | (at[y] == n.argmax()))
        if not whole:
            ok &= block[x] != block[y]
        x, y = x[ok], y[ok]
        kept, score = alike(marks[x], marks[y], words[x], words[y], samples, similarity, agreeing)
        yield x[kept], y[kept], score


def is_whole(piece: int) -> bool:
    return piece % PIECES == piece // PIECES


def _tied(samples: int, similarity: float, agreeing: int):
    """Of each piece a spanning forest of the pairs of different roots that may reach the similarity."""

    def run(batches):
        for bucket, piece, block, node, root, words, marks in _pieces(samples)(batches):
            for lo, n in zip(*(v.tolist() for v in _bounds(bucket, piece)), strict=True):
                cut = slice(lo, lo + n)
                label = np.arange(n)
                for x, y, _ in compatible(block[cut], root[cut], words[cut], marks[cut], is_whole(int(piece[lo])), samples, similarity, agreeing):
                    while len(x):
                        a, b = label[x], label[y]
                        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                        while (label[label] != label).any():
                            label = label[label]
                        left = label[x] != label[y]
                        x, y = x[left], y[left]
                other = np.flatnonzero(label != np.arange(n))
                if len(other):
                    yield pa.RecordBatch.from_arrays([pa.array(node[cut][label[other]]), pa.array(node[cut][other])], names=["a", "b"])

    return run


def _linked(k: int, samples: int, length: int, similarity: float, agreeing: int):
    """Rows (region, piece, block, node, root, text) in order of (region, piece) to the links (a, b) that join different roots of a piece."""

    def links_of(rows):
        piece, block, node, root = rows[0][1], np.array([r[2] for r in rows]), [r[3] for r in rows], np.array([r[4] for r in rows])
        lower = [r[5].lower().encode() for r in rows]
        n = np.array([len(x.split()) for x in lower])
        found: list = []
        for family, own in enumerate((n >= LONG_FROM, n <= SHORT_TO)):
            at = np.flatnonzero(own)
            if len(at):
                _, marks, words = sketches([lower[i] for i in at], SHORT_WORDS if family else k, samples, length)
                found += [(at[x], at[y], score) for x, y, score in compatible(block[at], root[at], words, marks, is_whole(piece), samples, similarity, agreeing)]
        if not found:
            return
        x, y, score = (np.concatenate(c) for c in zip(*found, strict=True))
        top, held = {r: r for r in set(root.tolist())}, {}

        def head(r):
            while top[r] != r:
                top[r] = top[top[r]]
                r = top[r]
            return r

        def symbols(i):
            if i not in held:
                held[i] = symbols_of(rows[i][5])
            return held[i]

        order = np.argsort(-score, kind="stable")
        roots = root.tolist()
        for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
            a, b = head(roots[i]), head(roots[j])
            if a != b and similar(symbols(i), symbols(j), similarity, k):
                top[max(a, b)] = min(a, b)
                yield min(node[i], node[j]), max(node[i], node[j])

    def batch(pairs):
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches):
        rows: list = []
        for one in batches:
            for row in zip(*(c.to_pylist() for c in one.columns), strict=True):
                if rows and rows[-1][:2] != row[:2]:
                    yield batch(list(links_of(rows)))
                    rows = []
                rows.append(row)
        if rows:
            yield batch(list(links_of(rows)))

    return run


#: Factor of the first block in the number of a piece.
PIECES = 1 << 20
PAIRS = "a long, b long, agree int"


def leaders(sketched: DataFrame, members: DataFrame, samples: int = SAMPLES, similarity: float = SIMILARITY, agreeing: int = AGREEING) -> DataFrame:
    """(a, b, agree), a < b: of the candidates between a node and a leader of its groups the best of each node."""
    blocks = members.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    laid = members.join(blocks, "bucket").withColumn("piece", F.pmod(F.xxhash64("node"), "blocks"))
    laid = laid.join(sketched.select("node", "family", "words", "marks"), ["node", "family"]).select("bucket", "piece", F.col("piece").alias("block"), "node", F.col("node").alias("root"), "words", "marks")
    found = laid.repartition("bucket", "piece").sortWithinPartitions("bucket", "piece", "node").mapInArrow(_led(samples, similarity, agreeing), PAIRS)
    found = materialize(found.groupBy("a", "b").agg(F.max("agree").alias("agree")), "led")
    ends = found.select(F.col("a").alias("node"), F.struct("agree", "a", "b").alias("x")).unionByName(found.select(F.col("b").alias("node"), F.struct("agree", "a", "b").alias("x")))
    return ends.groupBy("node").agg(F.max("x").alias("x")).select("x.a", "x.b", "x.agree").distinct()


def ties(sketched: DataFrame, members: DataFrame, roots: DataFrame, samples: int = SAMPLES, similarity: float = SIMILARITY, agreeing: int = AGREEING) -> DataFrame:
    """(a, b): a spanning forest, piece by piece, of the candidates that share a group and have different roots."""
    rooted = members.join(roots, "node", "left").select("bucket", "family", "node", F.coalesce("root", "node").alias("root"))
    several = rooted.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("r"), F.max("root").alias("t")).where("r <> t").select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    own = rooted.join(several, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).join(sketched.select("node", "family", "words", "marks"), ["node", "family"])
    lay = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.least("block", o) * PIECES + F.greatest("block", o))
    laid = own.withColumn("piece", F.explode(lay)).select("bucket", "piece", "block", "node", "root", "words", "marks")
    return laid.repartition("bucket", "piece").sortWithinPartitions("bucket", "piece").mapInArrow(_tied(samples, similarity, agreeing), "a long, b long").distinct()


def region_links(tied: DataFrame, roots: DataFrame, bodies: DataFrame, k: int, samples: int, length: int, similarity: float, agreeing: int) -> DataFrame:
    """(a, b): links that join the roots of each region of ties. Texts of a region's largest root are only met by the others."""
    regions = components(tied).select(F.col("id").alias("node"), F.col("root").alias("region"))
    own = regions.join(roots, "node", "left").select("region", "node", F.coalesce("root", "node").alias("root")).join(bodies, "node")
    own = materialize(own, "regions")
    parts = own.groupBy("region", "root").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    # regions of a few hundred texts are cut too, into at most SPREAD blocks, as their pairs are many to align
    need = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES), F.least(F.ceil(n * 5 / BLOCK), F.lit(SPREAD)))
    most = F.max(F.struct("n", "size", "root")).alias("m")
    shape = parts.groupBy("region").agg(most, F.sum("n").alias("n"), F.sum("size").alias("size"))
    one = need(F.col("n"), F.col("size")) <= 1
    rest = F.greatest(need(F.col("n") - F.col("m.n"), F.col("size") - F.col("m.size")), F.lit(1))
    shape = shape.select("region", F.when(~one, F.col("m.root")).alias("largest"), F.when(one, 1).otherwise(rest).alias("rest"), F.when(one, 0).otherwise(need(F.col("m.n"), F.col("m.size"))).alias("large"))
    big, h = F.col("root") == F.coalesce("largest", F.lit(None).cast("long")), F.xxhash64("node")
    block = F.when(big, F.col("rest") + F.pmod(h, F.greatest("large", F.lit(1)))).otherwise(F.pmod(h, "rest"))
    laid = own.join(shape, "region").withColumn("block", block).withColumn("last", F.when(F.col("block") >= F.col("rest"), F.col("rest")).otherwise(F.col("rest") + F.col("large")) - 1)
    lay = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda o: F.least("block", o) * PIECES + F.greatest("block", o))
    laid = laid.withColumn("piece", F.explode(lay)).select("region", "piece", "block", "node", "root", "text")
    return laid.repartition("region", "piece").sortWithinPartitions("region", "piece").mapInArrow(_linked(k, samples, length, similarity, agreeing), "a long, b long")


def aligned(pairs: DataFrame, bodies: DataFrame, similarity: float, k: int) -> DataFrame:
    """(b, a, same) of pairs (a, b) of bodies (node, text)."""
    left = bodies.select(F.col("node").alias("a"), F.col("text").alias("t"))
    right = bodies.select(F.col("node").alias("b"), F.col("text").alias("u"))
    return materialize(pairs.select("a", "b").join(right, "b").join(left, "a").select("b", "a", "u", "t").mapInArrow(_verified(similarity, k), "b long, a long, same boolean"), "aligned")


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row."""
    return texts(docs).select("doc_id", _digest())


def _digest():
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")


def nodes_of(rows: DataFrame) -> DataFrame:
    """(digest, least, node) of each text: its least doc_id, and a key: that doc_id, or a number made from the digest where it has none or another text has the same."""
    each = rows.groupBy("digest").agg(F.min("doc_id").alias("least"))
    named, bare = each.where("least IS NOT NULL"), each.where("least IS NULL")
    shared = named.groupBy("least").agg(F.count("*").alias("n"))
    made = F.lit(NO_ID) - F.pmod(F.xxhash64("digest"), F.lit(1 << 61))
    odd = (F.col("n") > 1) | (F.col("least") <= NO_ID)
    known = named.join(shared, "least").select("digest", "least", F.when(odd, made).otherwise(F.col("least")).alias("node"))
    return known.unionByName(bare.select("digest", "least", made.alias("node")))  # texts without an id never meet by it

def links(docs: DataFrame, nodes: DataFrame, k: int = WORDS, similarity: float = SIMILARITY, samples: int = SAMPLES, length: int = LENGTH, agreeing: int = AGREEING) -> DataFrame:
    """(a, b): verified links of nodes (digest, node) of docs. They join all components; within one not every link is there."""
    marked = texts(docs).mapInArrow(_sketched(k, samples, length), "digest binary, family int, words int, sketch array<long>, marks binary")
    marked = marked.join(nodes.select("digest", "node"), "digest").dropDuplicates(["digest", "family"])
    sketched = materialize(marked, "sketched")
    every = sketched.select("node", "family", F.explode("sketch").alias("bucket")).where("bucket <> 0")
    shared = every.groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("bucket")
    members = materialize(every.join(shared, "bucket").select("bucket", "node", "family"), "members")
    wanted = members.select("node").distinct().join(nodes, "node").select("digest", "node", "least")
    # of each wanted text one row: its digest and least doc_id; repeated rows and rows without an id meet in the aggregate
    own = texts(docs).select("doc_id", _digest().alias("own"), "text")
    bodies = own.join(wanted, (F.col("own") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("least"))).groupBy("node").agg(F.first("text").alias("text"))
    bodies = materialize(bodies, "bodies")
    largest = members.groupBy("bucket").agg(F.count("*").alias("n")).agg(F.max("n")).head()[0] or 0
    found, level, levels = None, members, 2
    while largest > BLOCK**levels:  # a level leaves a block of a group at most one root more than its texts that no leader met
        levels += 1
    for _ in range(levels):
        checked = aligned(leaders(sketched, level, samples, similarity, agreeing), bodies, similarity, k)
        new = checked.where("same").select("a", "b")
        found = new if found is None else materialize(found.unionByName(new), "verified")
        roots = components(found).withColumnRenamed("id", "node")
        level = members.join(roots, "node").groupBy("bucket", "root").agg(F.min(F.struct("node", "family")).alias("x")).select("bucket", "x.node", "x.family")
    tied = ties(sketched, members, roots, samples, similarity, agreeing)
    new = region_links(tied, roots, bodies, k, samples, length, similarity, agreeing)
    return materialize(found.unionByName(new), "verified")


def grouped(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """((doc_id, digest) of every row, (digest, least, class_id, root) of each text)."""
    rows = materialize(_named(docs), "copies")
    nodes = materialize(nodes_of(rows), "nodes")
    roots = components(links(docs, nodes, **options)).select(F.col("id").alias("node"), "root")
    named = nodes.join(roots, "node", "left").select("digest", "least", "node", F.coalesce("root", "node").alias("root"))
    named = materialize(named, "rooted")
    ids = named.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("least").alias("class_id"))
    return rows, named.join(ids, "root", "left").select("digest", "least", F.coalesce("class_id", "least", "root").alias("class_id"), "root")


def classes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id), a row for each row of docs: class_id is the least doc_id of the class, or a number below NO_ID where none of it has a doc_id.

    Options: those of links.
    """
    rows, named = grouped(docs, **options)
    return rows.join(named.select("digest", "class_id"), "digest").select("doc_id", "class_id")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """Of the rows of docs one of each class: that of its least doc_id (rows that have one first; then of the least text by digest); of equal such rows one."""
    rows, named = grouped(docs, **options)
    first = F.min(F.struct(F.col("least").isNull().alias("bare"), "least", "digest")).alias("x")
    chosen = named.groupBy("root").agg(first).select(F.col("x.digest").alias("d"), F.col("x.least").alias("i"), F.lit(True).alias("chosen"))
    counts = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    fate = counts.join(chosen, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("i")), "left").where("chosen IS NULL OR n > 1")
    fate = materialize(fate.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__text"), F.col("chosen").isNotNull().alias("__several")), "fates")
    body = F.coalesce(docs["text"], F.lit("")).cast("binary")
    here = (F.unhex(F.sha2(body, 256)) == F.col("__text")) & docs["doc_id"].cast("long").eqNullSafe(F.col("__id"))
    met = docs.join(fate, here, "left")
    one = met.where("__several").groupBy("__id", "__text").agg(F.min(F.struct(*[docs[c] for c in docs.columns])).alias("__row")).select("__row.*")
    return met.where("__several IS NULL").select(*[docs[c] for c in docs.columns]).unionByName(one)
