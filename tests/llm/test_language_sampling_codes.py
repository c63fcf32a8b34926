"""Language identification, importance resampling and vector codes against plain versions."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stylometra.llm import importance, language_id, queries, vector_codes

DOCS = "doc_id long, text string, lang string, n long"
rng = random.Random(3)


# ---- op11 ---------------------------------------------------------------------------------------------------------


def plain_bits(training: list[bytes], text: bytes, order: int) -> float:
    """A walk down the tree for each byte."""
    tree = defaultdict(Counter)
    for t in training:
        padded = b"\x00" * order + t
        for i in range(order, len(padded)):
            for k in range(order + 1):
                tree[padded[i - k : i]][padded[i]] += 1
    padded, bits = b"\x00" * order + text, 0.0
    for i in range(order, len(padded)):
        for k in range(order, -1, -1):
            own = tree.get(padded[i - k : i])
            if own is None:
                continue
            whole = sum(own.values()) + len(own)
            if padded[i] in own:
                bits -= math.log2(own[padded[i]] / whole)
                break
            bits -= math.log2(len(own) / whole)
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("step", [500_000, 7])
def test_code_lengths_equal_a_walk_down_the_trees(spark, step, monkeypatch):
    monkeypatch.setattr(language_id, "SCORED_BYTES", step)
    words = {"x": ["abra", "cada", "bra", "éa"], "y": ["ba", "caba", "rab", "ß"], "z": ["zz"]}
    rows = [(k, " ".join(rng.choice(words[g]) for _ in range(rng.randint(1, 30))), g, 0) for k, g in enumerate("xyxyxyz")]
    model = language_id.fit(spark.createDataFrame(rows, DOCS), F.lit(True))
    assert model.names == ["x", "y", "z"]
    texts = [b"", b"abra ba", "ßé zz".encode(), b"qqq w", b"rab caba" * 5]
    got = model.bits(texts)
    for i, t in enumerate(texts):
        for j, g in enumerate(model.names):
            assert got[i][j] == pytest.approx(plain_bits([r[1].encode() for r in rows if r[2] == g], t, language_id.ORDER), rel=1e-5, abs=1e-4)


def test_plain_text():
    assert language_id.plain("  Ab!! cD\n9é_É.") == "ab cd é é".encode()


def test_languages_of_odd_rows(spark):
    rows = [(1, "un deux trois", "fr", 0), (1, "un deux trois", "fr", 0), (2, "one two three", "en", 0), (3, None, "en", 0), (4, "12 !?", "en", 0), (5, "", None, 0), (None, "deux un", None, 0), (6, "un deux " * 50_000, None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.fit(docs, F.lit(True))
    got = Counter((r.doc_id, r.lang_pred) for r in language_id.predict(docs, model).collect())
    assert got == Counter({(1, "fr"): 2, (2, "en"): 1, (3, "und"): 1, (4, "und"): 1, (5, "und"): 1, (None, "fr"): 1, (6, "fr"): 1})
    untaught = language_id.predict(docs, language_id.fit(docs, F.lit(False))).collect()
    assert {(r.lang_pred, r.score) for r in untaught} == {("und", 0.0)} and len(untaught) == len(rows)
    assert language_id.predict(docs.where("false"), model).count() == 0


def test_sample_is_bounded_and_keeps_whole_texts(spark):
    rows = [(k, "ab " * (k % 7 + 1), "en" if k % 3 else "fr", 0) for k in range(200)] + [(999, "long " * 1000, "en", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = language_id.sample(docs, F.lit(True), 300, 20).groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("k")).collect()
    assert {r.lang for r in got} == {"en", "fr"} and all(r.n <= 300 and 5 < r.k <= 20 for r in got)
    assert language_id.sample(docs, F.lit(True), 300, 20).join(docs.select("text").distinct(), "text", "left_anti").count() == 0


def test_languages_of_held_out_documents(spark):
    where = "/root/testdata/sf0.01"
    out = queries.QUERIES["op11_language_id"](spark, where).join(spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held) and all(0 <= r.score <= 1 for r in out)


# ---- op12 ---------------------------------------------------------------------------------------------------------

_WORD, _LOW = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text):
    w = _WORD.findall((text or "").translate(_LOW))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % importance.BUCKETS for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_resample(rows, target):
    own = [plain_features(t) for _, t in rows]
    s, t = Counter(), Counter()
    for _, f in own:
        s.update(f)
    for text in target:
        t.update(plain_features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (all_s + 10000) / ((s[k] + 1) * (all_t + 10000)))) for k in range(10000)]
    out = []
    for (i, _), (n, f) in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[k] for k in f)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(able[: 5 * len(able) // 100]):
        x[4] = k + 1
    return Counter(tuple(x[:5]) for x in out)


@pytest.mark.parametrize("piece,batch", [(1_000_000, 3_000_000), (40, 300)])
def test_resampling(spark, piece, batch, monkeypatch):
    monkeypatch.setattr(importance, "PIECE", piece)
    monkeypatch.setattr(importance, "BATCH", batch)
    words = ["Ab", "c9", "déjà", "É", "x" * 70, "y" * 5000, "a", "the", " z", "İ"]
    text = lambda n: "".join(rng.choice(words) + rng.choice(" \n\x00-_.@[`{~") for _ in range(n))
    rows = [(k, text(rng.randint(0, 60))) for k in range(150)] + [(200, None), (201, ""), (202, " .,"), (203, "one"), (204, "one two"), (None, text(30)), (7, text(40)), (205, text(3000))]
    rows += [(300, "a b c " * 10)] * 3
    target = [text(20), None, "a a a", ""]
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in rows], "doc_id long, text string, place string, n_words long").repartition(3)
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert Counter(tuple(r) for r in got) == plain_resample(rows, target)
    assert sum(r["rank"] is not None for r in got) > 3


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 20), (2, None)], "doc_id long, text string")
    assert importance.resample(docs.where("false"), docs).count() == 0
    assert Counter(tuple(r) for r in importance.resample(docs, docs.where("false")).collect()) == plain_resample([(1, "a b " * 20), (2, None)], [])


def test_weighing_is_bounded():
    sizes = np.full(6000, 1000)
    sizes[[0, 5, 6, 5999]] = 0
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    buckets, counts = (np.random.default_rng(k).integers(0, 10_000, first[-1]) for k in (1, 2))
    nulls = pa.array([k == 5 for k in range(6000)])
    lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(v, t), mask=nulls) for v, t in ((buckets, pa.int16()), (counts, pa.int32()))]
    ids = pa.array(np.arange(6000))
    batch = pa.RecordBatch.from_arrays([ids, ids, ids, *lists], names=["place", "doc_id", "n_words", "buckets", "counts"]).slice(2, 5997)
    gain = np.arange(10_000) - 5000
    tracemalloc.start()
    got = pa.Table.from_batches(importance._weighed(batch, gain))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    parts = [slice(a, b) for a, b in zip(first[2:-2], first[3:-1], strict=True)]
    assert got["place"].to_pylist() == list(range(2, 5999))
    assert got["n_features"].to_pylist() == [counts[p].sum() for p in parts]
    assert got["weight"].to_pylist() == [(gain[buckets[p]] * counts[p]).sum() for p in parts]
    assert peak < 40_000_000  # 6 million values: 144 MB when all are weighed at once


def test_counting_takes_a_megabyte_at_once(spark):
    docs = spark.createDataFrame([(k, f"{k} " + "word " * 20_000) for k in range(30)], "doc_id long, text string").coalesce(1)
    counts = importance.spilled(docs)
    assert counts.where("place IS NULL").count() == 3  # rows of totals: one for each batch
    assert counts.where("place IS NOT NULL").count() == 30


def test_joined_crcs():
    shifts = importance.Shifts()
    parts = [(rng.randbytes(rng.randint(0, 90)), rng.randbytes(n)) for n in (0, 1, 5, 63, 64, 65, 128, 1000, 70_001)]
    a, b, n = (np.array(x, np.int64) for x in zip(*((zlib.crc32(x), zlib.crc32(y), len(y)) for x, y in parts)))
    assert shifts.joined(a, b, n).tolist() == [zlib.crc32(x + y) for x, y in parts]


# ---- op13 ---------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, row long, x int"


def plain_codes(rows, dim):
    """rows: (vec_id, vector, label), those that are kept, in order of vec_id and vector."""
    x = np.floor(4096 * np.array([np.array(v, np.float32) for _, v, _ in rows], np.float64)).astype(np.int64).reshape(-1, dim)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, x[k].tolist()))
    d, codes, error, books = dim // 8, [], np.zeros(len(x), np.int64), []
    for p in range(8):
        y = x[:, p * d : (p + 1) * d]
        c = y[order[:16]].copy()
        for k in range(7):
            dist = ((y[:, None] - c[None]) ** 2).sum(axis=2)
            a = dist.argmin(axis=1)
            if k < 6:
                for e in range(len(c)):
                    if (a == e).any():
                        c[e] = y[a == e].sum(axis=0) // (a == e).sum()
        codes.append(a)
        error += dist.min(axis=1)
        books.append(c)
    return Counter((r[0], "".join(f"{c[k]:02x}" for c in codes), int(error[k]), int(sum(error[j] for j in range(len(rows)) if rows[j][2] == r[2]))) for k, r in enumerate(rows)), np.array(books)


@pytest.mark.parametrize("n", [300, 9])
def test_codes(spark, n):
    draw = np.random.default_rng(4)
    vector = lambda: draw.normal(0, 1, 16).round(2).tolist()
    good = [(k * 3, vector(), int(k % 4)) for k in range(n)]
    good += [(None, vector(), None), (None, vector(), 1), (3, vector(), None), (3, good[1][1], 1), (5000, [0.0] * 16, 2)] + [(6000 + k, good[0][1], 9) for k in range(n)]
    odd = [(1, None, 1), (2, [None] + [0.0] * 15, 1), (4, [float("nan")] * 16, 1), (7, [float("inf")] + [0.0] * 15, 1), (8, [1.0] * 8, 1), (10, [], 1)]
    df = spark.createDataFrame([(*r, 1, 2) for r in good + odd], VECTORS).repartition(4)
    coded, books = vector_codes.compress(df)
    got = Counter((r.vec_id, r.code, r.error, r.label_error) for r in vector_codes.with_label_errors(coded).collect())
    want, want_books = plain_codes(good, 16)
    assert got == want and np.array_equal(books, want_books)


def test_codes_of_odd_tables(spark):
    empty, books = vector_codes.compress(spark.createDataFrame([], VECTORS))
    assert vector_codes.with_label_errors(empty).count() == 0 and books.size == 0
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 9, 1, 1, 1)], VECTORS))
    with pytest.raises(Exception, match="beyond"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9] * 8, 1, 1, 1)], VECTORS))


def test_rounds_shuffle_only_what_changed(spark, monkeypatch):
    """After the first round, sums that move are of parts whose entry is another one, and vectors aren't shuffled."""
    states = []
    write = vector_codes.Bucketed.write

    def watched(self, df, name):
        if name.startswith("state"):
            states.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(self, df, name)

    monkeypatch.setattr(vector_codes.Bucketed, "write", watched)
    vector_codes.compress(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    assert len(states) > 1 and not any("hashpartitioning" in plan for _, plan in states)
