"""Counts within batches against the column functions."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from stylometra.operators import text as T


@pytest.mark.parametrize("size", [8_000_000, 10])
def test_counts_equal_exploded_tokens(spark, size, monkeypatch):
    monkeypatch.setattr(T, "COUNTED_BYTES", size)
    texts = ["The cat, the CAT; ¡the dog! (3rd) --", "", None, "a\tb\nc d e\x0bf. g h;;i", "ΟΔΟΣ ΣΑΣ. «éa» x-y ... 'tis n.o", "one\r\ntwo. Three", "²x ½ ٣ İstanbul"]
    docs = spark.createDataFrame([(k % 2, t) for k, t in enumerate(texts)] * 3, "g int, text string").repartition(3)
    want = Counter((r.g, r.token) for r in T.tokens(docs, "g").collect())
    assert {(r.g, r.token): r.n for r in T.token_counts(docs, "g").collect()} == want
    for n in (2, 3):
        grams = docs.where("text IS NOT NULL").select(F.explode(T.sentence_ngrams(F.col("text"), n)).alias("gram"))
        assert {r.gram: r.n for r in T.ngram_counts(docs, n).collect()} == Counter(r.gram for r in grams.collect())
    assert T.token_counts(docs.where("false"), "g").count() == 0


def test_family_counts_leave_tasks_in_parts(spark, monkeypatch):
    from stylometra.operators import profiles as P

    source = spark.createDataFrame([(k, 0, [["a", "b", f"w{k}"]]) for k in range(50)], "doc_id long, chunk int, sents array<array<string>>")
    monkeypatch.setattr(P, "COUNTED_ROWS", 40)
    got = P.families(source, ["a"])
    assert {(r.doc_id, r.family, r.item, r.n) for r in got.where("family = 'w'").collect()} == {(k, "w", w, 1) for k in range(50) for w in ("a", "b", f"w{k}")}
    assert [(r.doc_id, r.family, r.item) for r in P.family_rates(source.limit(1), ["a"], {"w": 1}).collect()] == [(0, "w", "a")]
    run = []
    monkeypatch.setattr(type(source), "mapInArrow", lambda df, f, schema: run.append(f) or df)
    P.families(source, ["a"])
    batch = P.pa.RecordBatch.from_pylist([{"doc_id": k, "chunk": 0, "sents": [["a", "b", f"w{k}"]]} for k in range(50)])
    sizes = [b.num_rows for b in run[0]([batch])]
    assert len(sizes) > 5 and max(sizes) < 80


def test_words_are_judged_once_and_null_texts_have_zeros(spark):
    from stylometra.operators import profiles as P

    known, judged = P._Words(P._marks()[0], P.GREEK), []
    known.tests = [lambda w, t=t: judged.append(w) or t(w) for t in known.tests]
    assert [known[w.encode()][0] for w in ["(Καὶ", "(Καὶ", "--", "(Καὶ"]] == ["και", "και", "", "και"]
    assert len(judged) == len(P.GREEK)
    docs = spark.createDataFrame([(1, "Καὶ ὁ λόγος; καὶ ἦν\nοὐκ"), (2, None), (3, "")], "doc_id int, text string")
    rows = {r.doc_id: r for r in P.register_profile(docs).collect()}
    assert all(v == 0 for k in (2, 3) for v in rows[k][1:])  # the null text had 10 words a sentence
    assert (rows[1].avg_sent_len, round(rows[1].kai_sent_initial, 6)) == (2.5, 1.0)
    assert P.grammar_profile(docs.where("doc_id = 1")).head().avg_sent_len == 2.0
    assert P._chunk_numbers([60, 50, 100, 20], 100) == [0, 0, 1, 1]


def test_token_profile_of_single_and_several_texts(spark):
    from stylometra.operators import profiles as P

    docs = spark.createDataFrame([(1, "The cat. The dog; a (bird)\n--"), (2, "a b"), (2, "b c. d"), (None, "x y"), (None, "x"), (4, None), (5, " . ")], "doc_id int, text string")
    rows = {r.doc_id: tuple(r)[1:] for r in P.token_profile(docs, ["the", "a"]).collect()}
    want = {}
    for key, toks in {1: ["the cat", "the dog", "a bird"], 2: ["a b", "b c", "d"], None: ["x y", "x"]}.items():
        w = " ".join(toks).split()
        want[key] = (sum(map(len, w)) / len(w), 1000 * sum(x in ("the", "a") for x in w) / len(w), len(set(w)) / len(w), len(w) / {1: 3, 2: 2, None: 1}[key])
    assert {k: [round(x, 9) for x in v] for k, v in rows.items()} == {k: [round(x, 9) for x in v] for k, v in want.items()}


@pytest.mark.parametrize("small", [False, True])
def test_family_sums_equal_plain_counts(spark, small, monkeypatch):
    from stylometra.operators import profiles as P

    if small:
        for name, value in (("COUNTED_ROWS", 5), ("COUNTED_CHARACTERS", 30), ("HELD_GRAMS", 40), ("LETTERS", 12)):
            monkeypatch.setattr(P, name, value)
    texts = ["the cat and the dog. The end; a 😀x 😀y, z\nand-so the (the) x_y", "", None, "a b", "Éa é'a «the» the the. " * 9 + "last one", ". ; \n", "İx ΟΔΟΣ ΟΔΟΣ.α xσ\x0bx"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    closed, tops = ["the", "a", "and"], {"w": 4, "c3": 9, "c4": 7, "bg": 2, "m3": 3}
    chunks, marks = [], P._marks()
    for k, t in enumerate(texts):
        known = P._Words(marks[0])
        sents = [[w for w in (known[x][0] for x in s) if w] for s in P._sentences((t or "").encode(), marks[1], (b";", b"\n"))]
        sents = [s for s in sents if s]
        for no, s in zip(P._chunk_numbers([len(s) for s in sents], 10), sents, strict=True):
            chunks += [(k, no, [])] if not chunks or chunks[-1][:2] != (k, no) else []
            chunks[-1][2].append(s)
    made = P.chunked(docs, 10).cache()
    assert {(r.doc_id, r.chunk): r.text for r in made.collect()} == {(k, no): "\n".join(map(" ".join, s)) for k, no, s in chunks}
    own = [(k, no, f, Counter(items)) for k, no, s in chunks for f, items in P._family_items(s, frozenset(closed))]
    whole: dict = {f: Counter() for f in tops}
    for _, _, f, items in own:
        whole[f].update(items)
    best = {f: {i for i, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: tops[f]]} for f, c in whole.items()}
    want = {}
    for k, no, f, items in own:
        rates = [n * 1000 / items.total() for i, n in items.items() if i in best[f]]
        want |= {(k, no, f): (len(rates), round(sum(rates), 6), round(max(rates), 6))} if rates else {}
    assert {(r.doc_id, r.chunk, r.family): (r.features, round(r.rates, 6), round(r.greatest, 6)) for r in P.family_sums(made, closed, tops).collect()} == want


def test_chunk_families_pass_no_counts_of_single_chunks(spark):
    """The second reading once sent a row for each chunk and item to the shuffle."""
    from stylometra.plans import composites

    plan = composites.fx2_fx6_chunk_families(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "item" not in plan and "features" in plan
