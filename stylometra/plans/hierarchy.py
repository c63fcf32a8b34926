"""Profiles and families of annotated tokens; an order stands for a clause, its lines for words, a supplier group for a unit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..sources.tables import table
from .registry import query, r6

_LEX = sorted({*H.LEXEMES.values(), *(x for pair in H.PAIRS.values() for x in pair), *(x for x, _ in H.STEM_SHARES.values()), "MLKWT/", "BJT/"})
_TYPES = ["Way0", "WQt0", "xQt0", "NmCl", "CPen", "Ptcp", "InfC", "Ellp", "ZYq0", "WayX", "Zim0"]
#: Column: (choices, the number that picks one); all derived from lines of orders.
_CHOSEN = {
    "lex": (_LEX, "l_partkey"), "vt": (list(H.TENSES.values()), "l_suppkey"), "vs": (list(H.STEMS.values()), "l_partkey + l_suppkey"), "st": (["a", "c", "e"], "l_partkey"),
    "nu": (["sg", "pl", "du"], "l_suppkey"), "gn": (["m", "f"], "l_partkey + l_linenumber"), "prs": (["NA", "W", "NA", "J"], "l_suppkey + l_linenumber"),
    "function": (["Subj", "Pred", "Objc", "Cmpl", "Pred"], "l_orderkey * 3 + (l_linenumber + 1) // 2 * 7"), "ptyp": (["NP", "VP", "PP"], "l_orderkey + (l_linenumber + 1) // 2"),
    "ctyp": (_TYPES, "l_orderkey"), "rela": (["NA", "Adju", "Attr"], "l_orderkey + l_orderkey // 7"),
}
_NOUNS = ["subs", "prep", "conj", "advb", "adjv"]


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


TOKENS = f"""k AS (SELECT l_suppkey % 20 AS unit, l_orderkey // 40 AS chunk, l_orderkey // 8 AS sentence, l_orderkey AS clause, (l_linenumber + 1) // 2 AS phrase, ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey % 100000) * 1000 + l_suppkey % 1000 AS word, l_quantity::BIGINT AS q,
{', '.join(f'{_list(v)}[(({e}) % {len(v)}) + 1] AS {c}' for c, (v, e) in _CHOSEN.items())} FROM lineitem),
tokens AS (SELECT *, CASE WHEN lex LIKE '%[' THEN 'verb' ELSE {_list(_NOUNS)}[(q % {len(_NOUNS)}) + 1] END AS sp FROM k)"""


def _tokens(spark, d):
    line = table(spark, d, "lineitem").withColumns({c: F.col(c).cast("long") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")})
    pick = lambda values, e: F.element_at(F.array(*[F.lit(v) for v in values]), (F.expr(f"({e.replace('//', 'div')}) % {len(values)}") + 1).cast("int"))
    places = {"unit": "l_suppkey % 20", "chunk": "l_orderkey div 40", "sentence": "l_orderkey div 8", "clause": "l_orderkey", "phrase": "(l_linenumber + 1) div 2", "word": "((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey % 100000) * 1000 + l_suppkey % 1000"}
    own = line.select(*[F.expr(e).alias(c) for c, e in places.items()], F.col("l_quantity").alias("q"), *[pick(v, e).alias(c) for c, (v, e) in _CHOSEN.items()])
    return own.withColumn("sp", F.when(F.col("lex").endswith("["), "verb").otherwise(pick(_NOUNS, "q")))


def _profile_sql() -> str:
    n = "count(*)"
    out = {f: f"count(*) FILTER (lex = '{x}') * 1000.0 / {n}" for f, x in H.LEXEMES.items()}
    out |= {f: f"count(*) FILTER (sp = 'verb' AND vt = '{x}') * 1000.0 / {n}" for f, x in H.TENSES.items()} | {f: f"count(*) FILTER (sp = 'verb' AND vs = '{x}') * 1000.0 / {n}" for f, x in H.STEMS.items()}
    out |= {f: f"count(*) FILTER (lex = '{a}') / nullif(count(*) FILTER (lex IN ('{a}', '{b}')), 0)" for f, (a, b) in H.PAIRS.items()}
    out |= {f: f"count(*) FILTER (sp = 'verb' AND lex = '{x}' AND vs = '{s}') / nullif(count(*) FILTER (lex = '{x}'), 0)" for f, (x, s) in H.STEM_SHARES.items()}
    out |= {f: f"count(*) FILTER ({c}) * 1000.0 / {n}" for f, c in (("rate_const", "sp = 'subs' AND st = 'c'"), ("rate_prs", "prs <> 'NA'"), ("rate_pl_noun", "sp = 'subs' AND nu = 'pl'"), ("rate_f_noun", "sp = 'subs' AND gn = 'f'"), ("rate_ut_nouns", "lex LIKE '%WT/' OR lex LIKE '%WT'"))}
    out |= {"frac_niphal": "count(*) FILTER (sp = 'verb' AND vs = 'nif') / nullif(count(*) FILTER (sp = 'verb'), 0)", "frac_zaqaq": "NULL::DOUBLE"}
    of = lambda types: "typ IN (" + ", ".join(f"'{t}'" for t in types) + ")"
    share = lambda a, b="TRUE", least=0: f"count(*) FILTER ({a}) / CASE WHEN count(*) FILTER ({b}) > {least} THEN count(*) FILTER ({b}) END"
    verbal = of(H.VERBAL)
    clause = {"frac_nmcl": share(of(H.NOMINAL)), "frac_fronted": share(of(H.FRONT)), "frac_cpen": share(of(H.OPEN)), "frac_ptcp_cl": share(of(H.PARTICIPLE)), "frac_infc": share(of(H.INFINITIVE)), "frac_wqtl_wayq": share(of(H.WQTL), of((*H.WAYQ, *H.WQTL)), 5)}
    clause |= {"frac_sv": share(f"{verbal} AND s < v", f"{verbal} AND s IS NOT NULL AND v IS NOT NULL"), "frac_null_subj": share(f"{verbal} AND s IS NULL", verbal, 10), "frac_ov": share(f"{verbal} AND o < v", f"{verbal} AND o IS NOT NULL AND v IS NOT NULL")}
    last = ", ".join(f"max(phrase) FILTER (function = '{f}') AS {c}" for f, c in (("Subj", "s"), ("Pred", "v"), ("Objc", "o")))
    columns = ", ".join(f"round({'w' if f in out else 'c'}.{f}, 6) AS {f}" if f != "rate_cpen_1k" else "round(c.n_open * 1000.0 / w.n_words, 6) AS rate_cpen_1k" for f in H.FEATURES)
    return f"""WITH {TOKENS}, w AS (SELECT unit, count(*) AS n_words, {', '.join(f'{e} AS {f}' for f, e in out.items())} FROM tokens GROUP BY 1),
l AS (SELECT unit, clause, any_value(ctyp) AS typ, {last} FROM tokens GROUP BY 1, 2), c AS (SELECT unit, count(*) FILTER ({of(H.OPEN)}) AS n_open, {', '.join(f'{e} AS {f}' for f, e in clause.items())} FROM l WHERE NOT {of(H.SKIPPED)} GROUP BY 1)
SELECT w.unit, n_words, {columns} FROM w JOIN c USING (unit)"""


@query(_profile_sql())
def fx4_unit_profiles(spark, d):
    """The 64 features of every unit."""
    return H.profiles(_tokens(spark, d)).select("unit", "n_words", *[r6(f, f) for f in H.FEATURES])


#: Families and how many of their items are kept.
TOPS = {"lex": 40, "pos": 14, "pb": 36, "pt": 60, "lb": 40, "st": 3, "nu": 3, "gn": 2, "prs": 8, "vtf": 8, "vsf": 10, "vx": 20, "typ": 12, "fun": 20, "fb": 60, "rela": 10, "ctyp": 10, "cb": 36, "rt": 40}
_CLOSED = ", ".join(f"'{x}'" for x in H.CLOSED)
_SIZE = {f: "verbs" for f in ("vtf", "vsf", "vx")} | {f: "phrases" for f in ("typ", "fun", "fb")} | {f: "clauses" for f in ("rela", "ctyp", "cb", "rt")}


def _families_sql() -> str:
    pick = lambda source, items: " UNION ALL ".join(f"SELECT chunk, '{f}' AS family, {e} AS item FROM {source}" for f, e in items)
    words = pick("t", [("lex", "lex"), ("pos", "sp"), ("pb", "sp || '|' || s2"), ("pt", "sp || '|' || s2 || '|' || s3"), ("lb", "CASE WHEN l <> '·' OR l2 <> '·' THEN l || '|' || l2 END"), ("st", "st"), ("nu", "nu"), ("gn", "gn"), ("prs", "prs"), *[(f, f"CASE WHEN sp = 'verb' THEN {e} END") for f, e in (("vtf", "vt"), ("vsf", "vs"), ("vx", "vt || '|' || vs"))]])
    return f"""WITH {TOKENS}, t0 AS (SELECT *, CASE WHEN sp IN ({_CLOSED}) THEN lex ELSE '·' END AS l FROM tokens), t AS (SELECT *, lead(sp) OVER o AS s2, lead(sp, 2) OVER o AS s3, lead(l) OVER o AS l2 FROM t0 WINDOW o AS (PARTITION BY chunk ORDER BY word, lex, sp)),
p AS (SELECT chunk, clause, phrase, ptyp, function, lead(function) OVER (PARTITION BY chunk ORDER BY clause, phrase) AS f2 FROM (SELECT DISTINCT chunk, clause, phrase, ptyp, function FROM tokens)),
c AS (SELECT chunk, ctyp, rela, lead(ctyp) OVER o AS c2, lead(rela) OVER o AS r2, lead(rela, 2) OVER o AS r3 FROM (SELECT DISTINCT chunk, clause, ctyp, rela FROM tokens) WINDOW o AS (PARTITION BY chunk ORDER BY clause)),
i AS ({words} UNION ALL {pick("p", [("typ", "ptyp"), ("fun", "function"), ("fb", "function || '|' || f2")])} UNION ALL {pick("c", [("rela", "rela"), ("ctyp", "ctyp"), ("cb", "ctyp || '|' || c2"), ("rt", "rela || '|' || r2 || '|' || r3")])}),
n AS (SELECT chunk, family, item, count(*) AS n FROM i WHERE item IS NOT NULL GROUP BY ALL), a AS (SELECT family, item, row_number() OVER (PARTITION BY family ORDER BY sum(n) DESC, item) AS k FROM n GROUP BY family, item),
m(family, top, size) AS (VALUES {', '.join(f"('{f}', {k}, '{_SIZE.get(f, 'words')}')" for f, k in TOPS.items())}),
z AS (SELECT chunk, count(*) / 1000.0 AS words, count(*) FILTER (sp = 'verb') AS verbs, count(DISTINCT (clause, phrase)) AS phrases, count(DISTINCT clause) AS clauses FROM tokens GROUP BY 1)
SELECT chunk, family, item, n, round(n / CASE size WHEN 'words' THEN words WHEN 'verbs' THEN verbs WHEN 'phrases' THEN phrases ELSE clauses END, 6) AS value FROM n JOIN a USING (family, item) JOIN m USING (family) JOIN z USING (chunk) WHERE k <= top"""


@query(_families_sql())
def fx3_fx6_chunk_families(spark, d):
    """Counts and rates of every chunk over words, verbs, phrases and clauses, for the commonest items of each family."""
    return H.commonest(H.families(_tokens(spark, d), ["chunk"]), TOPS).select("chunk", "family", "item", "n", r6("value", "value"))


@query(f"WITH {TOKENS}, z AS (SELECT chunk, count(*) AS w, count(DISTINCT (clause, phrase)) AS p, count(DISTINCT clause) AS c, count(DISTINCT sentence) AS s FROM tokens GROUP BY 1) SELECT chunk, round(w / p, 6) AS phrase_len, round(w / c, 6) AS clause_len, round(c / s, 6) AS cl_per_sent, round(p / c, 6) AS ph_per_clause, round(w / s, 6) AS sent_len FROM z")
def fx3_chunk_structure(spark, d):
    return H.structure(_tokens(spark, d), ["chunk"]).select("chunk", *[r6(c, c) for c in ("phrase_len", "clause_len", "cl_per_sent", "ph_per_clause", "sent_len")])
