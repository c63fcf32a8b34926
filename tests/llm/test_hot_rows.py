"""Rows that are equal or have no doc_id: nothing gathers in one range, one row or one task."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from stylometra.llm import order_minhash, substring_dedup, suffix_dedup, token_files
from stylometra.llm.common import environment_path

rng = random.Random(2)
TEXTS = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(60)) for _ in range(40)]


def test_token_files_without_ids(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    monkeypatch.setattr(token_files, "FILE_IDS", 2000)
    rows = [(None, t + str(k)) for k in range(10) for t in TEXTS] + [(5, "same text")] * 30 + [(6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = f"{spark.conf.get('spark.checkpoint.dir', None) or 'file:///tmp'}/token-files-{rng.getrandbits(60):x}"
    files = token_files.write(docs, folder, parts=6)
    listed = files.collect()
    assert len(listed) > 12 and max(r.documents for r in listed) < 60
    got = token_files.read(spark, folder, files).select("doc_id", "start", "n_tokens", "ids").orderBy("start").collect()
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    assert [r.doc_id for r in got] == [None] * 400 + [5] * 30 + [6]
    coder = Tokenizer.from_file(environment_path("byte_bpe_50k.json"))
    want = sorted(zlib.crc32(np.array(coder.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for _, t in rows)
    assert sorted(zlib.crc32(r.ids) for r in got) == want


def test_equal_rows_share_their_spans(spark):
    docs = spark.createDataFrame([(None, TEXTS[0])] * 400 + [(3, TEXTS[0])] * 200 + [(4, TEXTS[1])], "doc_id long, text string").repartition(5)
    for module, window in ((substring_dedup, 35), (suffix_dedup, 100)):
        spans = module.duplicate_spans(docs, window).select("doc_id", F.size("spans").alias("n"), F.size(F.array_distinct("spans")).alias("k")).collect()
        assert {r.doc_id for r in spans} == {None, 3} and all(r.n == r.k < 100 for r in spans)
    out = substring_dedup.without_repeats(docs, 35).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("n_removed").alias("low"), F.max("n_removed").alias("high")).collect()
    assert sorted((r.doc_id or 0, r.n, r.low, r.high) for r in out) == [(0, 400, 60, 60), (3, 200, 60, 60), (4, 1, 0, 0)]


def test_classes_of_equal_rows_and_rows_without_ids(spark):
    near = TEXTS[0].split()
    near[30] = "changed"
    rows = [(None, TEXTS[0])] * 300 + [(9, " ".join(near)), (9, TEXTS[2]), (None, TEXTS[3]), (2, TEXTS[3])]
    docs = spark.createDataFrame([(i, t, "en", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, n long").repartition(4)
    got = {(r.doc_id, r.class_id) for r in order_minhash.classes(docs).collect()}
    assert got == {(None, 9), (9, 9), (None, 2), (2, 2)} or len({c for _, c in got}) == 3
    kept = order_minhash.representatives(docs).collect()
    assert sorted(r.text for r in kept) == sorted([" ".join(near), TEXTS[2], TEXTS[3]]) and all(set(r.asDict()) == {"doc_id", "text", "lang", "n"} for r in kept)
