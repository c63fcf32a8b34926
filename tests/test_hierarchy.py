"""Profiles of a small annotated text, worked out by hand."""

import pytest

from stylometra.operators import hierarchy as H

SCHEMA = "unit string, sentence long, clause long, phrase long, word long, lex string, sp string, vt string, vs string, st string, nu string, gn string, prs string, function string, ptyp string, ctyp string, rela string"


def word(unit, clause, phrase, at, lex, sp, function, ctyp, vt=None, vs=None, st=None, nu=None, gn=None, prs="NA"):
    return (unit, clause // 2, clause, phrase, at, lex, sp, vt, vs, st, nu, gn, prs, function, "VP" if function == "Pred" else "NP", ctyp, "NA")


ROWS = [
    word("u", 1, 1, 1, "W", "conj", "Conj", "Way0"), word("u", 1, 2, 2, ">MR[", "verb", "Pred", "Way0", "wayq", "qal"), word("u", 1, 3, 3, "MLK/", "subs", "Subj", "Way0", st="c", nu="sg", gn="m"), word("u", 1, 3, 4, "MLKWT/", "subs", "Subj", "Way0", st="a", nu="pl", gn="f", prs="W"),
    word("u", 2, 4, 5, ">NJ", "prps", "Subj", "xQt0"), word("u", 2, 5, 6, "HLK[", "verb", "Pred", "xQt0", "perf", "piel"), word("u", 2, 6, 7, ">NKJ", "prps", "Subj", "xQt0"),
    word("u", 3, 7, 8, "BJT/", "subs", "PreC", "NmCl", st="a", nu="sg", gn="m"), word("u", 4, 8, 9, "HJ", "intj", "Intj", "Voct"), word("u", 5, 9, 10, ">NJ", "prps", "Objc", "WQt0"), word("u", 5, 10, 11, "HLK[", "verb", "Pred", "WQt0", "perf", "qal"),
    word("v", 9, 1, 1, "W", "conj", "Conj", "CPen"),
]


def test_profile_of_a_unit(spark):
    got = {r.unit: r for r in H.profiles(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).collect()}
    u, v = got["u"], got["v"]
    assert len(H.FEATURES) == len(set(H.FEATURES)) == 64 and (u.n_words, v.n_words) == (11, 1)
    rate = 1000 / 11
    assert (u.rate_ani, u.rate_anochi, u.rate_wayyiqtol, u.rate_qatal) == (2 * rate, rate, rate, 2 * rate)
    assert u.frac_ani == 2 / 3 and u.frac_she is None and u.frac_halak_piel == 0.5 and u.frac_niphal == 0 and u.frac_zaqaq is None
    assert (u.rate_const, u.rate_prs, u.rate_pl_noun, u.rate_f_noun, u.rate_ut_nouns) == (rate,) * 5
    # four clauses count, Voct doesn't; the last subject of clause 2 follows its verb
    assert (u.frac_nmcl, u.frac_fronted, u.frac_cpen) == (0.25, 0.25, 0) and u.frac_sv == 0 and u.frac_ov == 1
    assert u.frac_wqtl_wayq is None and u.frac_null_subj is None and v.frac_cpen == 1 and v.rate_cpen_1k == 1000


def test_families_and_structure(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(2)
    rows = {(r.unit, r.family, r.item): r for r in H.families(df, ["unit"]).collect()}
    assert rows["u", "pb", "conj|verb"].n == 1 and rows["u", "pt", "conj|verb|subs"].n == 1 and rows["u", "lb", "W|·"].n == 1 and ("u", "lb", "·|·") not in rows
    assert rows["u", "vx", "perf|qal"].value == 1 / 3 and rows["u", "fun", "Pred"].value == 3 / 10 and rows["u", "cb", "Way0|xQt0"].value == 1 / 5 and rows["u", "rt", "NA|NA|NA"].n == 3
    assert rows["v", "ctyp", "CPen"].value == 1 and not any(k[0] == "v" and k[1] in ("pb", "fb", "cb", "vtf") for k in rows)
    assert rows["u", "lex", ">NJ"].value == pytest.approx(2 * 1000 / 11)
    kept = {(r.family, r.item) for r in H.commonest(H.families(df, ["unit"]), {"lex": 2, "pos": 1}).collect()}
    assert kept == {("lex", ">NJ"), ("lex", "HLK["), ("pos", "prps")} or kept == {("lex", ">NJ"), ("lex", "HLK["), ("pos", "subs")}
    s = {r.unit: r for r in H.structure(df, ["unit"]).collect()}["u"]
    assert (s.phrase_len, s.clause_len, s.cl_per_sent, s.ph_per_clause, s.sent_len) == (1.1, 2.2, 5 / 3, 2, 11 / 3)
    assert H.profiles(df.where("false")).count() == 0


def test_families_are_counted_once_over_batches(spark):
    """Chunks go on over batches of a few rows; the items of each token were exploded and all of it was worked out twice."""
    from collections import Counter

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = [(f"c{k // 7 % 5}" if k % 70 else None, k, "abcd"[k % 4], None if k % 9 == 0 else "xy"[k % 2]) for k in range(400)]
    df = spark.createDataFrame(rows, "c string, k long, p string, q string").repartition(3)
    own = df.withColumn("_n", F.lead("p").over(Window.partitionBy("c").orderBy("k")))
    items = [("p", F.col("p")), ("q", F.col("q")), ("none", F.lit(None).cast("string"))]
    want = Counter((c, f, i) for c, _, p, q in rows for f, i in (("p", p), ("q", q)) if i)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "13", before):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = H._counted(own, ["c"], [*items, ("next", F.col("_n"))]).collect()
            told = [r for r in got if r.family != "next"]
            assert len(told) == len(want) and {(r.c, r.family, r.item): r.n for r in told} == want
            assert sum(r.n for r in got if r.family == "next") == 400 - len({c for c, *_ in rows})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_profiles_sort_no_words(spark):
    """Strings kept as greatest ones made every word go through sorts with all counts beside it; a clause's type is the last by name, a phrase's function too."""
    names = "unit clause phrase lex sp vt vs st nu gn prs function ptyp ctyp rela".split()
    word = dict(zip(names, ["u", 1, 1, "GM", "verb", "perf", "qal", "c", "sg", "m", "NA", "Subj", "NP", "Way0", "NA"], strict=True))
    rows = []
    for k in range(12):  # a subject before a verb, types Way0 and then one that is unknown or greater
        rows += [word | {"clause": k, "phrase": 1, "function": "Subj"}, word | {"clause": k, "phrase": 1, "function": "Adju"}, word | {"clause": k, "phrase": 2, "function": "Pred"}]
        rows.append(word | {"clause": k, "phrase": 3, "function": "Subj" if k % 2 else None, "ctyp": ["Way0", "A", None, "Zzzz"][k % 4]})
        rows.append(word | {"clause": k, "phrase": 3, "function": "Zero" if k % 4 == 1 else None})
    rows.append(word | {"unit": None})
    df = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], "unit string, clause long, phrase long, " + ", ".join(f"{c} string" for c in names[3:]))
    out = H.profiles(df)
    got = {r.unit: r for r in out.collect()}
    assert set(got) == {"u", None} and got["u"].n_words == 60 and got[None].n_words == 1
    # clauses 3, 7, 11 end as Zzzz, which isn't verbal; of the other nine 1, 5, 9 hide the last subject behind Zero, and all have the subject first
    assert got["u"].frac_sv == 1.0 and got["u"].frac_nmcl == 0.0 and got["u"].frac_null_subj is None
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
