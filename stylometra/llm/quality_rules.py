"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger stores the measurements and one bit for each rule that
fails. A policy is a versioned mask of rules: applying it, or finding what each rule alone would drop (ablation), reads
the ledger only and never the texts.

Null and empty texts have no words, which fails min_words. Repeated rows are judged alike; other columns than doc_id and
text are not read; an empty table gives an empty ledger.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, Polynomial, chunks, materialize, mix64, repeated_keys, texts, word_bounds
from .repeats import joined

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts")

#: Bit of each rule (in this order) and when it fails, over the measurements.
RULES: dict[str, str] = {
    "min_words": "n_words < 50",
    "repeat_words": "100 * n_repeat_words > 50 * n_words",
    "symbol_ratio": "100 * n_symbols > 20 * n_words",
    "dup_lines": "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "shouting": "100 * n_shouts > 30 * n_words",
}
#: Rules of each version of the policy.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("min_words", "repeat_words"),
    "v1": tuple(RULES),
}


def mask_of(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy])


def measure(blobs: list[bytes]) -> dict[str, np.ndarray]:
    data, starts, ends = joined(blobs)
    poly = Polynomial(BYTE_VALUES[data])
    a, b = word_bounds(data)
    first, last = np.searchsorted(a, starts), np.searchsorted(a, ends)
    salt = mix64(np.arange(len(blobs), dtype=np.uint64) + np.uint64(1))

    def per_doc(mask: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[hi] - total[lo]

    space = (data == 32) | ((data >= 9) & (data <= 13))
    kinds = np.zeros(256, bool)
    kinds[list(SYMBOLS)] = True
    n_words = last - first
    out = {"n_words": n_words, "word_chars": per_doc(~space & ((data & 0xC0) != 0x80), starts, ends), "n_symbols": per_doc(kinds[data], starts, ends), "n_shouts": per_doc(data == 33, starts, ends)}

    owner = np.repeat(np.arange(len(blobs)), n_words)
    words = poly.slices(a, b)
    repeated = np.zeros(len(words), bool)
    if len(words) > 2:
        at = np.flatnonzero(owner[2:] == owner[:-2])
        hit = at[repeated_keys(Polynomial(words).slices(at, at + 3) ^ salt[owner[at]])]
        for k in range(3):
            repeated[hit + k] = True
    out["n_repeat_words"] = per_doc(repeated, first, last)

    stop = np.flatnonzero(data == 10)  # the end of each line; a text's end is one too
    begin = np.append(0, stop[:-1] + 1)
    worded = np.searchsorted(a, stop) > np.searchsorted(a, begin)
    begin, stop = begin[worded], stop[worded]
    line_owner = np.searchsorted(ends, begin)
    key = poly.slices(begin, stop) ^ salt[line_owner] if len(begin) else np.zeros(0, np.uint64)
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order][1:] == key[order][:-1]
    out["n_dup_lines"] = np.bincount(line_owner[again], minlength=len(blobs))
    out["n_lines"] = np.bincount(line_owner, minlength=len(blobs))
    return out


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and failed: the bits of the rules that fail."""

    def run(batches):
        for ids, blobs in chunks(batches, 4_000_000):
            m = measure(blobs)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(m[k].astype(np.int64)) for k in MEASURES)], names=["doc_id", *MEASURES])

    measured = texts(docs).mapInArrow(run, ", ".join(["doc_id long", *(f"{k} long" for k in MEASURES)]))
    bits = [f"CASE WHEN {rule} THEN {1 << k}L ELSE 0L END" for k, rule in enumerate(RULES.values())]
    return measured.withColumn("failed", F.expr(" | ".join(f"({b})" for b in bits)))


def stored_ledger(docs: DataFrame) -> DataFrame:
    """The ledger, written to the shared folder and read back: policies and ablations then cost no pass over texts."""
    return materialize(ledger(docs), "rule-ledger")


def apply_policy(table: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with kept: no rule of the policy fails."""
    return table.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask_of(policy))) == 0)


def ablation(table: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that the policy would keep without it."""
    mask, names = mask_of(policy), list(RULES)
    counts = table.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]]))
    each = counts.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.lit(mask) - F.col("bit")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
