"""Features of annotated tokens in a hierarchy: words in phrases, clauses and sentences, of units or of their chunks.

Tokens are rows (unit, clause, phrase, word, lex, sp, vt, vs, st, nu, gn, prs, function, ptyp, ctyp, rela), the order of words, phrases and clauses being that of their
numbers. Profiles come from one roll-up: counts go from tokens to phrases to clauses to units, dealt once by (unit, clause); a clause keeps the last phrase
of each function. Families count items of every level and keep the corpus's commonest.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.tables import stored

# ---- fixed values: lexemes, forms and clause types in the corpus's own notation -----------------------------------

LEXEMES = {
    "rate_anochi": ">NKJ", "rate_ani": ">NJ", "rate_asher": ">CR", "rate_neg_al": ">L", "rate_neg_lo": "L>", "rate_ki": "KJ", "rate_gam": "GM", "rate_lakhen": "LKN",
    "rate_hinne": "HNH", "rate_atta": "<TH", "rate_az": ">Z", "rate_af": ">P/", "rate_baqash": "BQC[", "rate_shaal": "C>L[", "rate_hayah": "HJH[", "rate_amar": ">MR[",
    "rate_natan": "NTN[", "rate_halak": "HLK[", "rate_pen": "PN", "rate_terem": "TRM", "rate_na": "N>",
}
TENSES = {"rate_wayyiqtol": "wayq", "rate_qatal": "perf", "rate_yiqtol": "impf", "rate_ptca": "ptca", "rate_ptcp": "ptcp", "rate_inf_abs": "infa", "rate_inf_con": "infc", "rate_impv": "impv", "rate_jussive": "juss", "rate_cohort": "coht"}
STEMS = {"rate_qal": "qal", "rate_hiphil": "hif", "rate_piel": "piel", "rate_niphal": "nif", "rate_hithpael": "hit", "rate_hophal": "hof"}
#: Share of the first lexeme among both.
PAIRS = {"frac_ani": (">NJ", ">NKJ"), "frac_she": ("C", ">CR"), "frac_ein": (">JN/", "L>"), "frac_neg_al": (">L", "L>"), "frac_baqash": ("BQC[", "C>L["), "frac_qahal": ("QHL/", "<DH/"), "frac_anachnu": (">NXNW", "NXNW")}
#: Share of a verb's uses that have the stem.
STEM_SHARES = {"frac_halak_piel": ("HLK[", "piel"), "frac_ysf_qal": ("JSP[", "qal"), "frac_yld_nif": ("JLD[", "nif")}
WAYQ, WQTL = ("Way0", "WayX", "WaYX"), ("WQt0", "WQtX", "WxQ0", "WxQX")
FRONT = ("xQt0", "xYq0", "xQtX", "xYqX", "xIm0", "WxY0", "WxQ0", "WxQX", "WxYX", "WxI0", "XQtl", "XYqt")
VERBAL = (*WAYQ, *WQTL, *FRONT, "ZQt0", "ZQtX", "ZYq0", "ZYqX", "ZIm0", "WYq0", "WYqX", "WIm0", "WXYq", "WXQt")
SKIPPED = ("Ellp", "Voct", "MSyn", "InfA")
NOMINAL, OPEN, PARTICIPLE, INFINITIVE = ("NmCl", "AjCl"), ("CPen",), ("Ptcp",), ("InfC",)
CLOSED = ("prep", "conj", "art", "nega", "intj", "advb", "prin", "prde", "prps", "inrg")

#: The 64 features in their order.
FEATURES = (
    "frac_ani rate_anochi rate_ani frac_she rate_asher frac_ein rate_neg_al frac_neg_al rate_neg_lo rate_ki rate_gam rate_lakhen rate_hinne rate_atta rate_az rate_af "
    "rate_wayyiqtol rate_qatal rate_yiqtol rate_ptca rate_ptcp rate_inf_abs rate_inf_con rate_impv rate_jussive rate_cohort rate_qal rate_hiphil rate_piel rate_niphal "
    "rate_hithpael rate_hophal frac_baqash rate_baqash rate_shaal frac_qahal rate_hayah rate_amar rate_natan rate_halak rate_const rate_prs rate_pl_noun rate_f_noun "
    "frac_anachnu rate_pen rate_terem rate_na frac_halak_piel frac_ysf_qal frac_niphal frac_yld_nif frac_zaqaq rate_ut_nouns "
    "frac_nmcl frac_fronted frac_cpen frac_ptcp_cl frac_infc frac_wqtl_wayq rate_cpen_1k frac_sv frac_null_subj frac_ov"
).split()


def _token_counts() -> dict[str, Column]:
    """What is counted among the words of a phrase."""
    verb, noun, lex = F.col("sp") == "verb", F.col("sp") == "subs", F.col("lex")
    out = {f"lex:{x}": lex == x for x in {*LEXEMES.values(), *(x for pair in PAIRS.values() for x in pair), *(x for x, _ in STEM_SHARES.values())}}
    out |= {f"vt:{x}": verb & (F.col("vt") == x) for x in TENSES.values()} | {f"vs:{x}": verb & (F.col("vs") == x) for x in STEMS.values()}
    out |= {f"stem:{n}": verb & (lex == x) & (F.col("vs") == s) for n, (x, s) in STEM_SHARES.items()}
    out |= {"verbs": verb, "const": noun & (F.col("st") == "c"), "prs": F.col("prs") != "NA", "plural": noun & (F.col("nu") == "pl"), "feminine": noun & (F.col("gn") == "f")}
    return out | {"ut": lex.endswith("WT/") | lex.endswith("WT")}


#: Types that a feature asks for, in order.
KNOWN_TYPES = sorted({*WAYQ, *WQTL, *FRONT, *VERBAL, *SKIPPED, *NOMINAL, *OPEN, *PARTICIPLE, *INFINITIVE})


def _type_number(ctyp: Column) -> Column:
    """A number in the order of clause types: odd for a known one, else the even one between its known neighbours."""
    known = F.coalesce(*[F.when(ctyp == t, F.lit(2 * k + 1)) for k, t in enumerate(KNOWN_TYPES)])
    return F.when(ctyp.isNotNull(), F.coalesce(known, 2 * sum((ctyp > t).cast("int") for t in KNOWN_TYPES)))


def profiles(tokens: DataFrame, unit: str = "unit") -> DataFrame:
    """(unit, n_words, the 64 features) of each unit. A share without a case is null, the last three shares of clauses also where cases are few; one feature is always null, being too rare."""
    counts = _token_counts()
    key = {name: f"_{k}" for k, name in enumerate(counts)}
    # what is counted among words needs no clauses: sums of each unit leave a task
    words = tokens.groupBy(F.col(unit).alias("_unit")).agg(F.count("*").alias("n_words"), *[F.count_if(c).alias(key[name]) for name, c in counts.items()])
    # of a phrase's functions and a clause's types the last by name counts; as numbers they need no sort
    of_phrase = {c: F.max(F.when(F.col("function") > f, 2).when(F.col("function") == f, 1)).alias(c) for c, f in (("s", "Subj"), ("v", "Pred"), ("o", "Objc"))}
    dealt = tokens.select(unit, "clause", "phrase", "function", _type_number(F.col("ctyp")).alias("typ")).repartition(unit, "clause")  # once: every level below is inside a clause
    phrases = dealt.groupBy(unit, "clause", "phrase").agg(F.max("typ").alias("typ"), *of_phrase.values())
    clauses = phrases.groupBy(unit, "clause").agg(F.max("typ").alias("typ"), *[F.max(F.when(F.col(c) == 1, F.col("phrase"))).alias(c) for c in of_phrase])
    among = lambda types: F.col("typ").isin([2 * KNOWN_TYPES.index(t) + 1 for t in types])
    used = F.col("clause").isNotNull() & ~F.coalesce(among(SKIPPED), F.lit(False))
    of = lambda *types: used & among(types)
    verbal = of(*VERBAL)
    tests = {"clauses": used, "nominal": of(*NOMINAL), "front": of(*FRONT), "open": of(*OPEN), "participle": of(*PARTICIPLE), "infinitive": of(*INFINITIVE), "wqtl": of(*WQTL), "narrative": of(*WAYQ, *WQTL), "verbal": verbal}
    tests |= {"null": verbal & F.col("s").isNull(), "sv_all": verbal & F.col("s").isNotNull() & F.col("v").isNotNull(), "sv": verbal & (F.col("s") < F.col("v")), "ov_all": verbal & F.col("o").isNotNull() & F.col("v").isNotNull(), "ov": verbal & (F.col("o") < F.col("v"))}
    whole = clauses.groupBy(unit).agg(*[F.count_if(c).alias(name) for name, c in tests.items()])
    whole = whole.join(words, F.col(unit).eqNullSafe(F.col("_unit"))).drop("_unit")
    n = F.col("n_words")
    rate = lambda c: F.col(c) * 1000.0 / n
    of_lex = lambda x: F.col(key[f"lex:{x}"])
    divide = lambda a, b, least=0: F.when(b > least, a / b)
    out = {name: rate(key[f"lex:{x}"]) for name, x in LEXEMES.items()} | {name: rate(key[f"vt:{x}"]) for name, x in TENSES.items()} | {name: rate(key[f"vs:{x}"]) for name, x in STEMS.items()}
    out |= {name: divide(of_lex(a), of_lex(a) + of_lex(b)) for name, (a, b) in PAIRS.items()}
    out |= {name: divide(F.col(key[f"stem:{name}"]), of_lex(x)) for name, (x, _) in STEM_SHARES.items()}
    out |= {"rate_const": rate(key["const"]), "rate_prs": rate(key["prs"]), "rate_pl_noun": rate(key["plural"]), "rate_f_noun": rate(key["feminine"]), "rate_ut_nouns": rate(key["ut"])}
    out |= {"frac_niphal": divide(F.col(key["vs:nif"]), F.col(key["verbs"])), "frac_zaqaq": F.lit(None).cast("double"), "rate_cpen_1k": rate("open")}
    out |= {name: divide(F.col(c), F.col("clauses")) for name, c in (("frac_nmcl", "nominal"), ("frac_fronted", "front"), ("frac_cpen", "open"), ("frac_ptcp_cl", "participle"), ("frac_infc", "infinitive"))}
    out |= {"frac_wqtl_wayq": divide(F.col("wqtl"), F.col("narrative"), 5), "frac_sv": divide(F.col("sv"), F.col("sv_all")), "frac_null_subj": divide(F.col("null"), F.col("verbal"), 10), "frac_ov": divide(F.col("ov"), F.col("ov_all"))}
    return whole.select(unit, "n_words", *[out[name].alias(name) for name in FEATURES])


def _counted(df: DataFrame, by: list[str], items: list[tuple[str, Column]]) -> DataFrame:
    """(by..., family, item, n): how often each item that isn't null occurs. Rows of one of by lie together, as they do behind a window over it.

    Items are counted batch by batch; a task holds the counts of the last one of by only, which may go on in the next batch.
    """
    ship(df.sparkSession)
    names, kinds, labels = [*by, "family", "item", "n"], dict(df.dtypes), [f for f, _ in items]

    def run(batches):
        key, open_counts = None, Counter()

        def made(keys, families, values, counts):
            return pa.RecordBatch.from_arrays([*keys, families, values, pa.array(counts, pa.int64())], names=names)

        def closed():
            if open_counts:
                at = pa.array(np.zeros(len(open_counts), np.int64))
                yield made([k.take(at) for k in key], pa.array([f for f, _ in open_counts], pa.string()), pa.array([i for _, i in open_counts], pa.string()), list(open_counts.values()))
                open_counts.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            columns, new = [batch.column(k) for k in range(len(by))], np.zeros(batch.num_rows, bool)
            for column in columns:
                codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            own, first = new.cumsum(), np.concatenate([[0], np.flatnonzero(new)])
            last = len(first) - 1
            goes_on = key is not None and [k[0].as_py() for k in key] == [c[0].as_py() for c in columns]
            if not goes_on:
                yield from closed()
            ending, out = [], []
            for k, family in enumerate(labels):
                encoded = batch.column(len(by) + k).dictionary_encode()
                codes = encoded.indices.fill_null(-1).to_numpy()
                some, size = codes >= 0, max(1, len(encoded.dictionary))
                found, n = np.unique(own[some] * size + codes[some], return_counts=True)
                place, code = found // size, found % size
                begun = (place == 0) & (goes_on or last == 0)
                if begun.any():
                    open_counts.update(dict(zip(((family, i) for i in encoded.dictionary.take(pa.array(code[begun])).to_pylist()), n[begun].tolist(), strict=True)))
                ends = (place == last) & (last > 0)
                ending.append((family, encoded.dictionary.take(pa.array(code[ends])).to_pylist(), n[ends].tolist()))
                rest = ~begun & ~ends
                out.append((family, first[place[rest]], encoded.dictionary.take(pa.array(code[rest])), n[rest]))
            if last > 0:
                if goes_on:
                    yield from closed()
                at = pa.array(np.concatenate([a for _, a, _, _ in out]))
                yield made([c.take(at) for c in columns], pa.concat_arrays([pa.repeat(pa.scalar(f, pa.string()), len(a)) for f, a, _, _ in out]), pa.concat_arrays([i for _, _, i, _ in out]), np.concatenate([n for *_, n in out]))
                for family, values, n in ending:
                    open_counts.update(dict(zip(((family, i) for i in values), n, strict=True)))
            if last > 0 or not goes_on:
                key = [c.slice(int(first[-1]), 1) for c in columns]
        yield from closed()

    own = df.select(*by, *[value.cast("string").alias(f"_i{k}") for k, (_, value) in enumerate(items)])
    return own.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", family string, item string, n long")


def families(tokens: DataFrame, by: list[str]) -> DataFrame:
    """(by..., family, item, n, value) of chunks (by): words per 1000 words (lex, pos, pos bigrams pb and trigrams pt, closed-class bigrams lb, state, number, gender, suffix), verbs' forms by verbs
    (vtf, vsf, vx), phrases' types, functions and bigrams of functions (typ, fun, fb) by phrases, clauses' relations, types, bigrams of types and trigrams of relations (rela, ctyp, cb, rt) by clauses.

    Neighbours don't cross chunks, and a chunk is of bounded size. A bigram lb of two open words doesn't count.
    """
    word, clause, phrase = Window.partitionBy(*by).orderBy("word", "lex", "sp"), Window.partitionBy(*by).orderBy("clause"), Window.partitionBy(*by).orderBy("clause", "phrase")
    gram = lambda *parts: F.concat(*[p if k == 0 else F.concat(F.lit("|"), p) for k, p in enumerate(parts)])  # noqa: E731  (null where a part is)
    sp, lex = F.col("sp"), F.when(F.col("sp").isin(*CLOSED), F.col("lex")).otherwise("·")
    verb = sp == "verb"
    own = tokens.withColumns({"_s2": F.lead("sp", 1).over(word), "_s3": F.lead("sp", 2).over(word), "_l": lex}).withColumn("_l2", F.lead("_l", 1).over(word))
    lb = F.when((F.col("_l") != "·") | (F.col("_l2") != "·"), gram(F.col("_l"), F.col("_l2")))
    items = [("lex", F.col("lex")), ("pos", sp), ("pb", gram(sp, F.col("_s2"))), ("pt", gram(sp, F.col("_s2"), F.col("_s3"))), ("lb", lb), ("st", F.col("st")), ("nu", F.col("nu")), ("gn", F.col("gn")), ("prs", F.col("prs"))]
    items += [("vtf", F.when(verb, F.col("vt"))), ("vsf", F.when(verb, F.col("vs"))), ("vx", F.when(verb, gram(F.col("vt"), F.col("vs"))))]
    phrases = tokens.groupBy(*by, "clause", "phrase").agg(F.max("ptyp").alias("ptyp"), F.max("function").alias("function")).withColumn("_f2", F.lead("function", 1).over(phrase))
    clauses = tokens.groupBy(*by, "clause").agg(F.max("ctyp").alias("ctyp"), F.max("rela").alias("rela"))
    clauses = clauses.withColumns({"_c2": F.lead("ctyp", 1).over(clause), "_r2": F.lead("rela", 1).over(clause), "_r3": F.lead("rela", 2).over(clause)})
    # sizes are counted along as families of one item
    every = _counted(own, by, [*items, ("_words", F.lit("")), ("_verbs", F.when(verb, ""))])
    every = every.unionByName(_counted(phrases, by, [("typ", F.col("ptyp")), ("fun", F.col("function")), ("fb", gram(F.col("function"), F.col("_f2"))), ("_phrases", F.lit(""))]))
    every = every.unionByName(_counted(clauses, by, [("rela", F.col("rela")), ("ctyp", F.col("ctyp")), ("cb", gram(F.col("ctyp"), F.col("_c2"))), ("rt", gram(F.col("rela"), F.col("_r2"), F.col("_r3"))), ("_clauses", F.lit(""))]))
    every = stored(every, "families")  # what follows needs the counts twice
    family = F.col("family")
    of = ["_words", "_verbs", "_phrases", "_clauses"]
    sizes = every.where(family.isin(of)).groupBy(*by).agg(*[F.max(F.when(family == f, F.col("n"))).alias(f) for f in of])
    size = F.when(family.isin("vtf", "vsf", "vx"), F.col("_verbs")).when(family.isin("typ", "fun", "fb"), F.col("_phrases")).when(family.isin("rela", "ctyp", "cb", "rt"), F.col("_clauses")).otherwise(F.col("_words") / 1000.0)
    return every.where(~family.isin(of)).join(sizes, by).select(*by, "family", "item", "n", (F.col("n") / size).alias("value"))


def commonest(items: DataFrame, tops: dict[str, int]) -> DataFrame:
    """Of rows (family, item, n, ...) those of each family's commonest items of the whole corpus (ties by item); other families go."""
    whole = items.groupBy("family", "item").agg(F.sum("n").alias("_all"))
    limit = F.create_map(*[F.lit(x) for kv in tops.items() for x in kv])
    place = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("_all"), "item"))
    kept = whole.where(F.col("family").isin(*tops)).withColumn("_k", place).where(F.col("_k") <= max(tops.values())).where(F.col("_k") <= limit[F.col("family")]).select("family", "item")
    return items.join(F.broadcast(kept), ["family", "item"])  # at most sum(tops) rows


def structure(tokens: DataFrame, by: list[str]) -> DataFrame:
    """(by..., phrase_len, clause_len, cl_per_sent, ph_per_clause, sent_len) of chunks."""
    phrases = tokens.groupBy(*by, "sentence", "clause", "phrase").agg(F.count("*").alias("_n"))
    clauses = phrases.groupBy(*by, "sentence", "clause").agg(F.sum("_n").alias("_n"), F.count("*").alias("_p"))
    sents = clauses.groupBy(*by, "sentence").agg(F.sum("_n").alias("_n"), F.sum("_p").alias("_p"), F.count("*").alias("_c"))
    whole = sents.groupBy(*by).agg(F.sum("_n").alias("_n"), F.sum("_p").alias("_p"), F.sum("_c").alias("_c"), F.count("*").alias("_s"))
    ratio = lambda a, b, name: (F.col(a) / F.col(b)).alias(name)
    return whole.select(*by, ratio("_n", "_p", "phrase_len"), ratio("_n", "_c", "clause_len"), ratio("_c", "_s", "cl_per_sent"), ratio("_p", "_c", "ph_per_clause"), ratio("_n", "_s", "sent_len"))
