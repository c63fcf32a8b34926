"""Token ids on disk: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Format of a file, all integers little-endian: magic "STK1"; then blocks, each of
  u32 documents, u32 ids, u32 distinct ids, u32 bytes of data
  i64 doc_id and u32 length of each document
  u32 id of each rank, the most frequent first (ties: the smaller id first)
  control bytes: two bits for each id, its bytes less one, four ids to a byte
  data bytes: the ranks, 1 to 4 bytes each.
Files hold the documents in ascending doc_id order. A task writes a range of documents, to a further file whenever one has FILE_IDS ids. Files have
names of their attempt, and only those in the list that Spark commits are read, so a task may run again.

Null texts count as empty (only the end id); equal doc_ids are ordered by text (by its hash first); documents without
a doc_id come first, under the least i64; other columns than doc_id and text
are not read; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_letters, groups, read_vocabulary
from .common import materialize, parts_for, shared_dir, texts
from .pretokens import Pieces

NO_DOC = -(1 << 63)
MAGIC = b"STK1"
#: Ids in a block, and from how many on a file is closed: a file is read as one row.
BLOCK_IDS, FILE_IDS = 2_000_000, 64_000_000
#: Bytes of each of the four values of a control byte.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    ranks = np.asarray(ranks, np.uint32)
    code = ((ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    padded = np.zeros(-len(code) % 4 + len(code), np.uint8)
    padded[: len(code)] = code
    control = padded[0::4] | padded[1::4] << 2 | padded[2::4] << 4 | padded[3::4] << 6
    used = np.arange(4, dtype=np.uint8)[None, :] <= code[:, None]
    return control.tobytes(), ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    out = raw[ends - lengths].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        if len(more):
            out[more] |= raw[ends[more] - lengths[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack_block(doc_ids: list[int], ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    count = np.bincount(flat) if len(flat) else np.zeros(0, np.int64)
    present = np.flatnonzero(count)
    by_rank = present[np.argsort(-count[present], kind="stable")]
    rank_of = np.zeros(len(count), np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    control, data = pack_ranks(rank_of[flat])
    return b"".join([
        struct.pack("<4I", len(doc_ids), len(flat), len(by_rank), len(data)),
        np.array(doc_ids, "<i8").tobytes(),
        np.array([len(x) for x in ids], "<u4").tobytes(),
        by_rank.astype("<u4").tobytes(),
        control,
        data,
    ])


def read_blocks(content: bytes):
    """(doc_ids, lengths, ids) of each block of a file."""
    if content[:4] != MAGIC:
        raise ValueError("not a token file")
    at = 4
    while at < len(content):
        docs, n, distinct, size = struct.unpack_from("<4I", content, at)
        at += 16
        doc_ids = np.frombuffer(content, "<i8", docs, at)
        lengths = np.frombuffer(content, "<u4", docs, at + 8 * docs)
        at += 12 * docs
        by_rank = np.frombuffer(content, "<u4", distinct, at)
        at += 4 * distinct
        controls = -(-n // 4)
        ranks = unpack_ranks(content[at : at + controls], content[at + controls : at + controls + size], n)
        at += controls + size
        yield doc_ids, lengths, by_rank[ranks] if n else np.zeros(0, np.uint32)


_WORKER: dict[int, Pieces] = {}


def library_pieces(vocabulary: str) -> Pieces:
    """Ids of texts from the tokenizers library, which sees each new piece once in a worker."""
    key = zlib.crc32(vocabulary.encode())
    if key not in _WORKER:
        from tokenizers import Tokenizer

        coder = Tokenizer.from_str(vocabulary)
        coder.no_padding()
        coder.no_truncation()
        special = {t.content: i for i, t in coder.get_added_tokens_decoder().items()}

        model, letters = coder.model, {b: c for c, b in byte_letters().items()}
        stand_in = [letters[b] for b in range(256)]

        def encode(items: list[str]):
            ids, sizes = [], []
            # no UTF-8 text has the byte FF
            for x in b"\xff".join(map(str.encode, items)).decode("latin-1").translate(stand_in).split(stand_in[0xFF]):
                found = model.tokenize(x)
                ids += [t.id for t in found]
                sizes.append(len(found))
            return np.array(ids, np.int32), sizes

        _WORKER[key] = Pieces(encode, special)
    return _WORKER[key]


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 0, parts: int | None = None) -> DataFrame:
    """Write files to folder (a URI) and return their list: (file, first_doc_id, documents, ids)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary or read_vocabulary())
    parts = parts or parts_for(docs)

    def run(batches):
        from pyarrow import fs

        ids_of, number = library_pieces(shared.value), TaskContext.get().partitionId()
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        out, name, files, first, docs_in, ids_in = None, None, 0, None, 0, 0
        held_ids, held, size = [], [], 0

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), pa.array([docs_in], pa.int64()), pa.array([ids_in], pa.int64())], names=["file", "first_doc_id", "documents", "ids"])

        for doc_ids, own in groups(batches, 4_000_000):
            for i, x in zip(doc_ids, ids_of(own), strict=True):
                if out is None:  # a name of its own for each attempt: only files in the list that Spark commits are read
                    name, first, docs_in, ids_in = f"part-{number:06d}-{files:06d}-{uuid.uuid4().hex}.stk", i, 0, 0
                    out = store.open_output_stream(f"{top}/{name}")
                    out.write(MAGIC)
                held_ids.append(i)
                held.append(np.append(x, np.int32(end_id)))
                size += len(x) + 1
                ids_in += len(x) + 1
                docs_in += 1
                if size >= BLOCK_IDS:
                    out.write(pack_block(held_ids, held))
                    held_ids, held, size = [], [], 0
                    if ids_in >= FILE_IDS:
                        yield closed()
                        out, files = None, files + 1
        if out is not None:
            if held_ids:
                out.write(pack_block(held_ids, held))
            yield closed()

    # equal and missing ids are told apart by text, so no range holds all of them
    own = texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_DOC))).withColumn("name", F.xxhash64("text"))
    ordered = own.repartitionByRange(parts, "doc_id", "name").sortWithinPartitions("doc_id", "name", "text").select("doc_id", "text")
    return materialize(ordered.mapInArrow(run, "file string, first_doc_id long, documents long, ids long"), "token-files")


def read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files of the list; start: ids before the document, in the order of the files."""
    base, at = {}, 0
    for r in files.orderBy("file").collect():  # one row for each file
        base[r["file"]] = at
        at += r["ids"]

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = base[path.rsplit("/", 1)[1]]
                for doc_ids, lengths, ids in read_blocks(content.as_py()):
                    ends = np.cumsum(lengths, dtype=np.int64)
                    own = [ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids), pa.array(start + ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(own, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                    start += len(ids)

    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not base:
        return spark.createDataFrame([], schema)
    rows = spark.read.format("binaryFile").load([f"{folder}/{f}" for f in base]).select("path", "content").mapInArrow(run, schema)
    return rows.withColumn("doc_id", F.when(F.col("doc_id") != NO_DOC, F.col("doc_id")))


def round_trip(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read from files written to the shared folder."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/stylometra/token-files-{uuid.uuid4().hex}"
    files = write(docs, folder, vocabulary, end_id)
    return read(spark, folder, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
