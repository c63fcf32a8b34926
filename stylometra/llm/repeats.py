"""Exact search for windows (runs of symbols of fixed length) that start at two or more places of a corpus.

Every window is assigned one anchor inside it, the least hashed gram among its first positions, so equal windows have
equal anchors at equal offsets. An anchor carries the hash of the symbols after it that all its windows contain (seed)
and of everything its windows cover (context). Only anchors whose seed repeats go on; if the whole context repeats, all
windows of the anchor do. Contexts that differ around one seed are compared by a resolver (an index built per block):
the contexts of a seed lie in one block if they fit; those of a seed with more are dealt by reference. A context's
references are, for each of its windows that another context has, the first context that has it; a block holds one
reference and some of the contexts that refer to it, and again the resolver finds what they share.

Keys that hold a large part of all rows are joined by broadcast (there are at most HOT of them) and aggregated before
they are shuffled, so none is gathered in one task. Rows are named by doc_id (null is a name like others) and a hash of
the text, so rows that repeat a doc_id with another text are documents of their own.

Repeated contexts are told by 128 bits: 64 of the seed's polynomial, 64 of another hash of the whole context.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, Polynomial, materialize, texts, word_bounds

#: Different contexts of one seed that one block may hold (3 MB of bytes, 250 MB in a resolver), and contexts of one reference in a piece.
BLOCK_CONTEXTS, PIECE_CONTEXTS = 5000, 500
#: Symbols of contexts in one resolver block (a suffix order of so many stays in a processor's cache), and bytes of text handled at once.
BLOCK_SYMBOLS = 100_000
CHUNK_BYTES = 4_000_000
#: A key is hot if it holds more than one row in so many.
HOT = 4096


@dataclass(frozen=True)
class Scheme:
    """What a symbol is (byte or word), window: symbols of a window, reach: positions an anchor is chosen from, gram: symbols an anchor hashes."""

    symbol: str
    window: int
    reach: int
    gram: int

    def __post_init__(self):
        if self.window < 1 or self.reach < 1 or self.gram < 1 or self.reach + self.gram > self.window + 1:
            raise ValueError("a window must contain all grams that its anchor is chosen from")


def joined(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array, a line feed after each; where each begins and ends."""
    lengths = np.array([len(b) for b in blobs], np.int64)
    data = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
    ends = np.cumsum(lengths + 1) - 1
    return data, ends - lengths, ends


def symbols(scheme: Scheme, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each symbol (a byte, or a word's hash), its 64-bit value, and each document's first and last (exclusive) symbol."""
    data, starts, ends = joined(blobs)
    if scheme.symbol == "byte":
        return data, BYTE_VALUES[data], starts, ends
    a, b = word_bounds(data)
    values = Polynomial(BYTE_VALUES[data]).slices(a, b)
    return values, values, np.searchsorted(a, starts), np.searchsorted(a, ends)


def sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """Least of each width consecutive keys."""
    n, span = len(key), 1
    if n < width:
        return key[:0]
    while span * 2 <= width:
        key = np.minimum(key[: len(key) - span], key[span:])
        span *= 2
    count = n - width + 1
    return key[:count] if span == width else np.minimum(key[:count], key[width - span : width - span + count])


def _content_hashes(raw: np.ndarray, lo: np.ndarray, stop: np.ndarray, place: np.ndarray) -> np.ndarray:
    """64-bit hash of each slice of symbols and of the anchor's place in it."""
    view, width = memoryview(raw).cast("B"), raw.itemsize
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(view[a:b], p) for a, b, p in zip((lo * width).tolist(), (stop * width).tolist(), place.tolist(), strict=True)], np.uint64).view(np.int64)


def anchors(scheme: Scheme, raw: np.ndarray, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> dict[str, np.ndarray]:
    """One row per anchor: doc (index), lo and hi (first and last window start), seed, context. raw: the symbols, values: their 64-bit values."""
    poly, n, w = Polynomial(values), len(values), scheme.window
    none = {k: np.zeros(0, np.int64) for k in ("doc", "lo", "hi", "seed", "context")}
    if n < w:
        return none
    at = np.arange(n - scheme.gram + 1)
    low = np.uint64((1 << 26) - 1)
    if n > int(low):
        raise ValueError("a chunk may have at most 2**26 symbols")
    grams = poly.slices(at, at + scheme.gram)
    least = sliding_min((grams & ~low) | at.astype(np.uint64), scheme.reach)
    valid = np.zeros(n + 1, np.int32)  # documents that have a window: its starts
    long = last - first >= w
    np.add.at(valid, first[long], 1)
    np.add.at(valid, last[long] - w + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(starts):
        return none
    anchor = (least[starts] & low).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    begin = np.flatnonzero(new)
    lo, hi, c = starts[begin], starts[np.append(begin[1:], len(starts)) - 1], anchor[begin]
    doc = np.searchsorted(first, lo, "right") - 1
    seed = poly.slices(c, c + w - scheme.reach + 1)
    base = first[doc]
    return {"doc": doc, "lo": lo - base, "hi": hi - base, "seed": seed.view(np.int64), "context": _content_hashes(raw, lo, hi + w, c - lo)}


KEY = "doc_id long, tag long"
ANCHOR_SCHEMA = f"{KEY}, lo int, hi int, seed long, context long"
SPAN_SCHEMA = f"{KEY}, lo int, hi int"
CONTENT_SCHEMA = f"seed long, k long, n long, {KEY}, lo int, content binary"


def named_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, text): the tag is a hash of the text."""
    return texts(docs).select("doc_id", F.xxhash64("text").alias("tag"), "text")


def same_row(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["tag"] == b["tag"])


def _batch(columns, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _anchor_rows(scheme: Scheme):
    def rows(ids, tags, blobs):
        found = anchors(scheme, *symbols(scheme, blobs))
        at = pa.array(found["doc"])
        return _batch([pa.array(ids, pa.int64()).take(at), pa.array(tags, pa.int64()).take(at), found["lo"].astype(np.int32), found["hi"].astype(np.int32), found["seed"], found["context"]], ANCHOR_SCHEMA)

    def run(batches):
        ids, tags, blobs, size = [], [], [], 0
        for batch in batches:
            for i, t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids.append(i)
                tags.append(t)
                blobs.append(x.as_py().encode())
                size += len(blobs[-1])
                if size >= CHUNK_BYTES:
                    yield rows(ids, tags, blobs)
                    ids, tags, blobs, size = [], [], [], 0
        if ids:
            yield rows(ids, tags, blobs)

    return run


def _content_rows(scheme: Scheme):
    """(doc_id, tag, text, wanted: list of seed, k, n, lo, hi) to the symbols of each wanted context."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for i in range(batch.num_rows):
                doc, tag, blob, wanted = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py().encode(), batch.column(3)[i].as_py()
                values = None if scheme.symbol == "byte" else symbols(scheme, [blob])[0]
                for x in wanted:
                    a, b = x["lo"], x["hi"] + scheme.window
                    content = blob[a:b] if values is None else values[a:b].tobytes()
                    for column, v in zip(out, (x["seed"], x["k"], x["n"], doc, tag, a, content), strict=True):
                        column.append(v)
            yield _batch(out, CONTENT_SCHEMA)

    return run


GROUP = f"group long, head boolean, n long, {KEY}, lo int, content binary"


def _resolved(scheme: Scheme, resolver: Callable[[list[np.ndarray], int], list[list[tuple[int, int]]]]):
    """Rows of GROUP in order of their group, heads first, to spans of windows that another context of the block has too. Groups with heads may be cut; each piece has the heads."""
    width = 1 if scheme.symbol == "byte" else 8

    def spans(rows):
        found = resolver([np.frombuffer(r[4], np.uint8 if width == 1 else np.uint64) for r in rows], scheme.window)
        flat = [(r[1], r[2], r[3] + a, r[3] + b) for r, own in zip(rows, found, strict=True) if r[0] == 1 for a, b in own]
        return _batch(list(zip(*flat, strict=True)) if flat else [[], [], [], []], SPAN_SCHEMA)

    def run(batches):
        rows, heads, size, group = {}, {}, 0, None  # by name: a context that is in several groups stands once in a block
        for batch in batches:
            d = batch.to_pydict()
            for g, head, *row in zip(*(d[c.split()[0]] for c in GROUP.split(", ")), strict=True):
                name = tuple(row[1:4])
                if size >= BLOCK_SYMBOLS * width and (g != group or heads):
                    yield spans(list(rows.values()))
                    rows = dict(heads) if g == group else {}
                    size = sum(len(r[4]) for r in rows.values())
                if g != group:
                    heads, group = {}, g
                if head:
                    heads[name] = row
                if name not in rows:
                    rows[name] = row
                    size += len(row[4])
        if rows:
            yield spans(list(rows.values()))

    return run


WINDOW_SCHEMA = f"seed long, win long, {KEY}, lo int"


def _window_rows(scheme: Scheme):
    """A row for each window of each context: the context's name and the window's hash."""

    def run(batches):
        for batch in batches:
            wins, at = [], []
            for i, x in enumerate(batch.column(4)):
                content = x.as_py()
                v = BYTE_VALUES[np.frombuffer(content, np.uint8)] if scheme.symbol == "byte" else np.frombuffer(content, np.uint64)
                place = np.arange(len(v) - scheme.window + 1)
                wins.append(Polynomial(v).slices(place, place + scheme.window).view(np.int64))
                at.append(np.full(len(place), i))
            if wins:
                own = pa.array(np.concatenate(at))
                yield _batch([batch.column(0).take(own), np.concatenate(wins), *(batch.column(c).take(own) for c in (1, 2, 3))], WINDOW_SCHEMA)

    return run


def joined_by_key(rows: DataFrame, keys: DataFrame, names: list[str], count: str, total: int) -> DataFrame:
    """rows joined with keys (a row for each), whose column count says how many of about total rows each key has: those with more than one in HOT, at most HOT of them, by broadcast."""
    often = F.col(count) * HOT > total
    hot = F.broadcast(keys.where(often))
    rest = rows.join(hot.select(*names), names, "left_anti").join(keys.where(~often), names)
    return rows.join(hot, names).unionByName(rest)


def repeated_windows(docs: DataFrame, scheme: Scheme, resolver, most: int | None = None) -> DataFrame:
    """(doc_id, tag, spans: array of (lo, hi)), the first and last start, in symbols, of runs of windows that start elsewhere too.

    docs: named_texts. Documents with no such window have no row. most: contexts of one seed in a block.
    """
    most = most or BLOCK_CONTEXTS
    rows = materialize(docs.mapInArrow(_anchor_rows(scheme), ANCHOR_SCHEMA), "anchors")
    seeds = materialize(rows.groupBy("seed").agg(F.count("*").alias("n_seed")).where("n_seed > 1"), "seeds")
    found = materialize(joined_by_key(rows, seeds, ["seed"], "n_seed", rows.count()).drop("n_seed"), "candidates")
    total = found.count()
    contexts = materialize(found.groupBy("seed", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tag", "lo", "hi")).alias("rep")), "contexts")
    spans = joined_by_key(found, contexts.where("n > 1").select("seed", "context", "n"), ["seed", "context"], "n", total).select("doc_id", "tag", "lo", "hi")
    several = contexts.groupBy("seed").agg(F.count("*").alias("k")).where("k > 1")
    wanted = joined_by_key(contexts, several, ["seed"], "k", total).select("rep.doc_id", "rep.tag", F.struct("seed", "n", "rep.lo", "rep.hi", "k").alias("x"))
    wanted = wanted.groupBy("doc_id", "tag").agg(F.collect_list("x").alias("wanted"))  # anchors of one text
    content = docs.join(wanted, same_row(docs, wanted)).select(docs["doc_id"], docs["tag"], "text", "wanted").mapInArrow(_content_rows(scheme), CONTENT_SCHEMA)
    content = materialize(content, "contents")
    light = content.where(F.col("k") <= most).select(F.col("seed").alias("group"), F.lit(False).alias("head"), "n", "doc_id", "tag", "lo", "content")
    blocks = light.unionByName(_by_reference(content.where(F.col("k") > most), scheme))
    compared = blocks.repartition("group").sortWithinPartitions("group", F.desc("head")).mapInArrow(_resolved(scheme, resolver), SPAN_SCHEMA).distinct()
    return spans.unionByName(compared).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))  # rows that are equal share their spans


def _by_reference(content: DataFrame, scheme: Scheme) -> DataFrame:
    """Rows of GROUP: the contexts of seeds that have too many for one block, in groups of a reference and contexts that share a window with it."""
    own = content.select("seed", "doc_id", "tag", "lo", "content").repartition(F.xxhash64("doc_id", "tag", "lo"))
    windows = materialize(own.mapInArrow(_window_rows(scheme), WINDOW_SCHEMA), "windows")
    name = F.struct("doc_id", "tag", "lo")
    first = windows.groupBy("seed", "win").agg(F.count("*").alias("m"), F.min(name).alias("ref")).where("m > 1")
    pairs = joined_by_key(windows, first, ["seed", "win"], "m", windows.count()).select("seed", name.alias("own"), "ref").where("NOT (own <=> ref)").distinct()
    pairs = materialize(pairs, "references")
    sizes = pairs.groupBy("seed", "ref").agg(F.ceil(F.count("*") / PIECE_CONTEXTS).alias("pieces"))
    # a member is spread by its own name, its reference is repeated for each piece
    members = joined_by_key(pairs, sizes.withColumn("m", F.col("pieces") * PIECE_CONTEXTS), ["seed", "ref"], "m", windows.count()).withColumn("piece", F.pmod(F.xxhash64("own"), "pieces"))
    asked = members.select("seed", F.xxhash64("seed", "ref", "piece").alias("group"), F.lit(False).alias("head"), "own")
    asked = asked.unionByName(sizes.select("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), F.col("ref").alias("own")).select("seed", F.xxhash64("seed", "own", "piece").alias("group"), F.lit(True).alias("head"), "own"))
    asked = asked.select(F.col("seed").alias("s"), "group", "head", F.col("own.doc_id").alias("i"), F.col("own.tag").alias("t"), F.col("own.lo").alias("l"))
    here = (F.col("seed") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("tag") == F.col("t")) & (F.col("lo") == F.col("l"))
    return content.join(asked, here).select("group", "head", "n", "doc_id", "tag", "lo", "content")


def covered(n: int, spans, window: int) -> np.ndarray:
    """Mask of the n symbols that lie in a window starting in one of the spans."""
    edge = np.zeros(n + 1, np.int32)
    for x in spans or ():
        edge[x["lo"]] += 1
        edge[min(n, x["hi"] + window)] -= 1
    return np.cumsum(edge[:-1]) > 0
