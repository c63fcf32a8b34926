"""A corpus pipeline of five stages over the table of documents; each stage's rows are written and read again by the next.

A stage takes (spark, docs, sf_dir) and returns rows with the columns of documents; the last returns encoded documents.

In every stage a null text counts as empty, repeated rows are documents of their own, columns beside those of documents
are dropped, and an empty table gives an empty one. Empty texts get the score of the bias; they are copies of each other,
so one of them stays; they hold no secret; they are not repeated; they have no token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylometra.llm import bpe, mixing, order_minhash, quality_model, secrets
from stylometra.llm.common import materialize, table
from stylometra.llm.queries import TARGETS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(c) for c in COLUMNS if c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score below 0.3) go. Learned from the labels that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~quality_model.held_out("doc_id"))
    kept = _scored(docs, quality_model.fit(docs, labels))
    return kept.where("predicted = 1").select(*[c for c in COLUMNS if c in docs.columns])


def _scored(docs: DataFrame, model: quality_model.Model) -> DataFrame:
    """docs with the column predicted, in one pass."""
    import numpy as np
    import pyarrow as pa

    own = _columns(docs)
    names, place = own.columns, own.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast((model.weights(), model.offset))

    def run(batches):
        weights, offset = shared.value
        for batch in batches:
            at, blobs, size = 0, [], 0
            for k, x in enumerate(batch.column(place)):
                blobs.append((x.as_py() or "").encode())
                size += len(blobs[-1])
                if size >= quality_model.SCORED_BYTES or k == batch.num_rows - 1:
                    s = quality_model.score(blobs, weights, offset)
                    yield pa.RecordBatch.from_arrays([*batch.slice(at, len(blobs)).columns, pa.array((s >= 0.3).astype(np.int32))], names=[*names, "predicted"])
                    at, blobs, size = k + 1, [], 0

    return own.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema), "predicted int"]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least doc_id stays; where no document of it has one, that of the least text by hash."""
    return _columns(order_minhash.representatives(docs))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by [SECRET]; every document stays. Spans meet texts by their content, so null and repeated doc_ids are safe."""
    import pyarrow as pa

    own = _columns(docs)
    names, place = own.columns, own.columns.index("text")
    found = secrets.findings(docs)[1].where("spans <> ''").select("blob", "spans")  # one row for each text that has a secret
    blob = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    joined = own.withColumn("blob", blob).join(found, "blob", "left").select(*names, "spans")

    def run(batches):
        for batch in batches:
            cleaned = [t.as_py() if s.as_py() is None else secrets.redact(t.as_py(), s.as_py()) for t, s in zip(batch.column(place), batch.column(len(names)), strict=True)]
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(cleaned, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    out = joined.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated (copies have the same doc_id) until tokens by language are in the target shares; none goes."""
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("lang").alias("domain"))
    mixed = mixing.mix(docs, labelled, TARGETS).select("doc_id", F.greatest("copies", F.lit(1)).cast("int").alias("copies"))
    own = _columns(docs).join(mixed, "doc_id", "left")
    return own.withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1))))).select(*[c for c in COLUMNS if c in docs.columns])


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, n_chars): BPE ids, and the length of the text that they decode to."""
    return bpe.round_trip(docs).select("doc_id", "n_tokens", "ids", F.length("text").cast("long").alias("n_chars"))


STAGES = [("quality_classifier", quality), ("minhash_near_dedup", near_duplicates), ("secret_scans", secret_spans), ("mix_sources", mixture), ("bpe_coding", encoding)]

#: The stages learn models and use hashes that SQL cannot express; tests/llm holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


