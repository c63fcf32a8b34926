"""Operators and pipeline stages against plain versions that share no code with them but hash constants."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from stylometra.llm import bpe, fingerprints, mixing, quality_model, queries, secrets
from test_llm_operators import brute_classes

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
MASK = (1 << 64) - 1


# ---- op1 ----------------------------------------------------------------------------------------------------------


def plain_words(text):
    low = "".join(c.lower() for c in text or "")
    for c in "\t\n\v\f\r.,;:":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def bucket(word):
    return xxhash.xxh64(word.encode(), seed=42).intdigest() % mixing.BUCKETS if word else None


def signed_bucket(word):
    h = xxhash.xxh64(word.encode(), seed=42).intdigest()
    return (h - (1 << 64) if h >> 63 else h) % mixing.BUCKETS


def test_mixing_equals_plain_naive_bayes_and_meets_the_targets(spark):
    draw = random.Random(6)
    vocabulary = {"a": [f"red{k}" for k in range(30)], "b": [f"blue{k}" for k in range(30)], "c": [f"green{k}" for k in range(30)]}
    rows = []
    for i in range(240):
        kind = "aaaabc"[i % 6]
        words = [draw.choice(vocabulary[kind] if draw.random() < 0.8 else vocabulary[draw.choice("abc")]) for _ in range(draw.randint(1, 80))]
        rows.append((i, " ".join(words) + draw.choice([".", "", "\n"])))
    rows += [(900, ""), (901, None)]
    labels = [(i, "aaaabc"[i % 6]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    targets = {"a": 0.4, "b": 0.35, "c": 0.25}
    got = {r.doc_id: r for r in mixing.mix(docs, spark.createDataFrame(labels, "doc_id long, domain string"), targets).collect()}
    count = {d: Counter() for d in "abc"}
    for i, d in labels:
        count[d].update(signed_bucket(w) for w in plain_words(rows[i][1]))
    total = {d: sum(c.values()) for d, c in count.items()}
    prior = {d: (sum(x == d for _, x in labels) + 0.5) / (len(labels) + 1.5) for d in "abc"}
    for i, text in rows:
        words = [signed_bucket(w) for w in plain_words(text)]
        z = {}
        for d in "abc":
            own = sum(math.log((count[d][b] + 0.5) / (total[d] + 0.5 * mixing.BUCKETS)) for b in words)
            z[d] = math.log(prior[d]) + own * min(len(words), mixing.EVIDENCE) / max(len(words), 1)
        top = max(z.values())
        e = {d: math.exp(v - top) for d, v in z.items()}
        assert got[i].n_tokens == len(words)
        assert got[i].p == pytest.approx([e[d] / sum(e.values()) for d in "abc"], abs=1e-9)
    tokens = [sum(r.rate * r.n_tokens * r.p[k] for r in got.values()) for k in range(3)]
    assert [t / sum(tokens) for t in tokens] == pytest.approx([0.4, 0.35, 0.25], abs=1e-3)
    assert all(r.rate >= 0 and r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in got.values())


# ---- op2 ----------------------------------------------------------------------------------------------------------


def test_quality_of_held_out_documents(spark):
    out = queries.QUERIES["op2_quality_classifier"](spark, MIDDLE).alias("s")
    rows = out.join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    share = sum((a > b) + (a == b) / 2 for a in good for b in bad) / len(good) / len(bad)
    assert share >= 0.95 and all(r.predicted == (r.score >= 0.3) for r in rows)


# ---- op7 ----------------------------------------------------------------------------------------------------------


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def tossed(x):
    """The first label is 0; each other tells the lowest bit in which it differs from its left neighbour."""
    out = [0]
    for a, b in zip(x, x[1:]):
        d = a ^ b
        k = (d & -d).bit_length() - 1 if d else None
        out.append(0 if k is None else 2 * k + (b >> k & 1))
    return out


def plain_level(names, values):
    heads = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
    runs = [b - a for a, b in zip(heads, [*heads[1:], len(names)])]
    names = [names[i] for i in heads]
    values = [mix(values[i] ^ n * 0x9FB21C651E98DF25 & MASK) if n > 1 else values[i] for i, n in zip(heads, runs)]
    label = tossed(tossed(tossed(names if max(names, default=0) < 256 else values)))
    begin = [i for i in range(len(names)) if not i or 1 < i < len(names) - 1 and label[i - 1] < label[i] > label[i + 1]]
    made = []
    for a, b in zip(begin, [*begin[1:], len(names)]):
        made.append(mix(sum(values[j] * (2 * (j - a) + 0xD1342543DE82EF95) for j in range(a, b)) & MASK))
    return made


def plain_names(text):
    names = list(text.encode())
    values = [mix((b + 1) * 0x9E3779B97F4A7C15 & MASK) for b in names]
    for _ in range(fingerprints.LEVEL):
        names = plain_level(names, values)
        values = names
    return {n >> 32 for n in names}


def plain_likeness(x, y):
    union = sorted(x | y)[: fingerprints.KEEP]
    return len(set(union) & x & y) / len(union) if union else 1.0


def test_fingerprints_equal_plain_parsing(spark):
    draw = random.Random(7)
    base = "".join(draw.choice("abcdef é\n") for _ in range(900))
    texts = [base, "zz" + base, base[:500] + "XYZ" + base[500:], base, "", None, "a", "aa", "aaaaaaab", "ab" * 300, base[::-1], base * 12, "é" * 50]
    rows = list(zip([5, 2, None, 9, 11, 4, 7, 7, 8, 1, 30, 31, 32], texts))
    got = fingerprints.compare_edited(spark.createDataFrame(rows, "doc_id long, text string"), ).collect()
    order = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    by_text = {}
    seen = Counter()
    for k, (known, i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][2]
        n = len(t) // 4
        edited = t[: len(t) - n] + following[:n]
        own, changed, nxt = plain_names(t), plain_names(edited), plain_names(following)
        as_text = lambda s: "".join(f"{x:08x}" for x in sorted(s)[: fingerprints.KEEP])
        seen[(i if known else None, len(t), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(changed), round(plain_likeness(own, changed), 9), round(plain_likeness(own, nxt), 9))] += 1
        by_text.setdefault(t, set()).add(as_text(own))
    assert all(len(v) == 1 for v in by_text.values())
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == seen


# ---- pipeline -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


def rows_of(df):
    return Counter(tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect())


def test_stage_quality(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where(~quality_model.held_out("doc_id"))
    model = quality_model.fit(docs, labels)
    scores = quality_model.score([(r.text or "").encode() for r in docs.collect()], model.weights(), model.offset)
    want = {r.doc_id for r, s in zip(docs.collect(), scores) if s >= 0.3}
    kept = corpus_pipeline.quality(spark, docs, SMALL)
    assert {r.doc_id for r in kept.collect()} == want and 0 < len(want) < docs.count()
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert np.mean([i in want for i, q in quality.items() if q == 1]) > 0.95


def test_stage_near_duplicates(spark, docs):
    classes = brute_classes([(r.doc_id, r.text or "") for r in docs.collect()])
    kept = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert rows_of(kept) == rows_of(docs.where(F.col("doc_id").isin(sorted(set(classes.values())))))


def test_stage_secrets(spark, docs):
    want = Counter()
    for r in docs.collect():
        text = None if r.text is None else secrets.redact(r.text, secrets.joined(secrets.scan(r.text)))
        want[(r.doc_id, text, r.lang, r.source, None if text is None else len(text))] += 1
    assert rows_of(corpus_pipeline.secret_spans(spark, docs, SMALL)) == want


def test_stage_mixture(spark, docs):
    out = rows_of(corpus_pipeline.mixture(spark, docs, SMALL))
    assert set(out) == set(rows_of(docs)) and sum(out.values()) >= docs.count()
    labelled = docs.join(spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("lang").alias("domain"))
    copies = {r.doc_id: max(r.copies, 1) for r in mixing.mix(docs, labelled, queries.TARGETS).collect()}
    assert {row[0]: n for row, n in out.items()} == copies


def test_stage_encoding(spark, docs):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_str(bpe.read_vocabulary())
    got = {r.doc_id: r for r in corpus_pipeline.encoding(spark, docs, SMALL).collect()}
    for r in docs.collect():
        ids = coder.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(got[r.doc_id].ids, "<u4").tolist() == ids and got[r.doc_id].n_chars == len(coder.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_an_empty_table(spark, docs, name, stage):
    out = stage(spark, docs.where("false"), SMALL)
    assert out.count() == 0 and (name == "bpe_coding" or out.columns == corpus_pipeline.COLUMNS)
