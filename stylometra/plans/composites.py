"""Queries over full feature composites. The texts are spelt with Greek letters first, so that the detectors meet words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiles as P
from ..sources.tables import stored, table
from .linguistic import CLOSED
from .registry import query, r6

LATIN, GREEK = "abcdefghiklmnoprstuwxyz", "αβκδεφγηικλμνοπρστυωξψζ"
CLOSED_GREEK = [w.translate(str.maketrans(LATIN, GREEK)) for w in CLOSED]


def _spelt(spark, d):
    return table(spark, d, "documents").select("doc_id", F.translate(F.lower("text"), LATIN, GREEK).alias("text"))


def _tokens(marks: str, s: str, t: str) -> str:
    """CTEs: s (doc_id, sent_no, sentence) and t (doc_id, sent_no, tok_no, token)."""
    split = f"list_filter(list_transform(regexp_split_to_array(strip_accents(translate(lower(text), '{LATIN}', '{GREEK}')), '{marks}'), lambda s: trim(s, ' ')), lambda s: s <> '')"
    words = r"list_filter(list_transform(regexp_split_to_array(sentence, '\s+'), lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda w: w <> '')"
    return (
        f"{s}0 AS (SELECT doc_id, {split} AS ss FROM documents), {s} AS (SELECT doc_id, generate_subscripts(ss, 1) AS sent_no, unnest(ss) AS sentence FROM {s}0), "
        f"{t}0 AS (SELECT doc_id, sent_no, {words} AS ws FROM {s}), {t} AS (SELECT doc_id, sent_no, generate_subscripts(ws, 1) AS tok_no, unnest(ws) AS token FROM {t}0)"
    )


def _count(kind: str, alternatives: str) -> str:
    size = "length(token) >= 4 AND " if kind == "suffix" else ""
    return f"count(*) FILTER ({size}regexp_matches(token, '{P.WORD_PATTERNS[kind] % alternatives}'))"


def _sums(detectors) -> str:
    return ", ".join(f"{_count(kind, alt)} AS {name}" for name, kind, alt in detectors)


_RATES = ", ".join(f"round(coalesce({n} * 1000.0 / n, 0), 6) AS {n}" for n, _, _ in P.GREEK if n not in ("tt", "ss"))
_SHARES = ", ".join(f"round(CASE WHEN n IS NULL THEN 0 ELSE {a} / nullif({a} + {b}, 0) END, 6) AS {n}" for n, a, b in P.GREEK_SHARES)


@query(f"WITH {_tokens('[.;' + chr(92) + 'n]+', 's', 't')}, c AS (SELECT doc_id, count(*) AS n, count(DISTINCT token) AS types, {_sums(P.GREEK)} FROM t GROUP BY 1), f AS (SELECT doc_id, sent_no, min_by(token, tok_no) AS first FROM t GROUP BY 1, 2), b AS (SELECT doc_id, count(*) AS sents, count(*) FILTER (first = 'και') AS begun FROM f GROUP BY 1) SELECT doc_id, {_RATES}, {_SHARES}, round(coalesce(n / sents, 0), 6) AS avg_sent_len, round(coalesce(begun / sents, 0), 6) AS kai_sent_initial, round(coalesce(types / n, 0), 6) AS type_token_ratio FROM (SELECT doc_id FROM documents) d LEFT JOIN c USING (doc_id) LEFT JOIN b USING (doc_id)")
def fx1_sc14_grammar_profile(spark, d):
    p = P.grammar_profile(_spelt(spark, d))
    return p.select("doc_id", *[r6(c, c) for c in p.columns if c != "doc_id"])


_REGISTER_RATES = ", ".join(f"round(coalesce({n} * 1000.0 / n, 0), 6) AS {n}" for n, _, _ in P.REGISTER if n not in ("tt", "ss"))


@query(f"WITH {_tokens('[.;' + chr(92) + 'n]+', 's', 't')}, {_tokens('[.;·?!' + chr(92) + 'n]+', 'x', 'y')}, c AS (SELECT doc_id, count(*) AS n, {_sums(P.REGISTER)} FROM t GROUP BY 1), f AS (SELECT doc_id, sent_no, min_by(token, tok_no) AS first, count(*) AS k FROM y GROUP BY 1, 2 HAVING count(*) >= 2), b AS (SELECT doc_id, count(*) AS sents, sum(k) AS long, count(*) FILTER (first = 'και') AS begun FROM f GROUP BY 1) SELECT doc_id, {_REGISTER_RATES}, round(coalesce(tt / (tt + ss + 1e-9), 0), 6) AS tt_ss_ratio, round(CASE WHEN n IS NULL THEN 0 ELSE coalesce(long / sents, 10) END, 6) AS avg_sent_len, round(coalesce(begun / (sents + 1e-9), 0), 6) AS kai_sent_initial FROM (SELECT doc_id FROM documents) d LEFT JOIN c USING (doc_id) LEFT JOIN b USING (doc_id)")
def fx10_register_features(spark, d):
    p = P.register_profile(_spelt(spark, d))
    return p.select("doc_id", *[r6(c, c) for c in p.columns if c != "doc_id"])


TOPS = {"w": 250, "c3": 200, "c4": 150, "bg": 120, "m3": 60}
_CLOSED = "(" + ", ".join(f"'{w}'" for w in CLOSED_GREEK) + ")"
_CHUNKS = """st AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sent_no) - 1 AS k, ws, len(ws) AS n FROM t0 WHERE len(ws) > 0),
w AS (WITH RECURSIVE r(doc_id, k, no, acc) AS (SELECT doc_id, k, 0::BIGINT, n FROM st WHERE k = 0
 UNION ALL SELECT st.doc_id, st.k, r.no + (r.acc >= 100)::INT, CASE WHEN r.acc >= 100 THEN st.n ELSE r.acc + st.n END FROM r JOIN st ON st.doc_id = r.doc_id AND st.k = r.k + 1) SELECT * FROM r),
z AS (SELECT doc_id, max(no) AS last FROM w GROUP BY 1), e AS (SELECT w.doc_id, last, max(acc) AS words FROM w JOIN z ON w.doc_id = z.doc_id AND no = last GROUP BY 1, 2),
ch AS (SELECT w.doc_id, w.k, CASE WHEN no = last AND last > 0 AND words < 50 THEN no - 1 ELSE no END AS chunk, ws FROM w JOIN e USING (doc_id) JOIN st USING (doc_id, k)),
txt AS (SELECT doc_id, chunk, ' ' || string_agg(array_to_string(ws, ' '), ' ' ORDER BY k) || ' ' AS x FROM ch GROUP BY 1, 2)"""
_MASKED = f"list_transform(ws, lambda x: CASE WHEN x IN {_CLOSED} THEN x ELSE '·' END)"
_ITEMS = f"""it AS (SELECT doc_id, chunk, 'w' AS family, unnest(ws) AS item FROM ch
 UNION ALL SELECT doc_id, chunk, 'c3', unnest(list_transform(range(1, length(x) - 1), lambda i: substring(x, i, 3))) FROM txt
 UNION ALL SELECT doc_id, chunk, 'c4', unnest(list_transform(range(1, length(x) - 2), lambda i: substring(x, i, 4))) FROM txt
 UNION ALL SELECT doc_id, chunk, 'bg', item FROM (SELECT doc_id, chunk, unnest(list_transform(range(1, len(ws)), lambda i: CASE WHEN ws[i] IN {_CLOSED} AND ws[i + 1] IN {_CLOSED} THEN ws[i] || '_' || ws[i + 1] END)) AS item FROM ch) WHERE item IS NOT NULL
 UNION ALL SELECT doc_id, chunk, 'm3', unnest(list_transform(range(1, len(ws) - 1), lambda i: m[i] || '·' || m[i + 1] || '·' || m[i + 2])) FROM (SELECT doc_id, chunk, ws, {_MASKED} AS m FROM ch))"""


@query(f"WITH {_tokens('[.;' + chr(92) + 'n]+', 's', 't')}, {_CHUNKS}, {_ITEMS}, c AS (SELECT doc_id, chunk, family, item, count(*) AS n FROM it GROUP BY ALL), tot AS (SELECT doc_id, chunk, family, sum(n) AS total FROM c GROUP BY ALL), v AS (SELECT family, item, row_number() OVER (PARTITION BY family ORDER BY sum(n) DESC, item) AS k FROM c GROUP BY 1, 2), l(family, top) AS (VALUES {', '.join(str(x) for x in TOPS.items())}) SELECT doc_id, chunk::BIGINT AS chunk, family, count(*) AS features, round(sum(n * 1000.0 / total), 4) AS rates, round(max(n * 1000.0 / total), 4) AS greatest FROM c JOIN v USING (family, item) JOIN l ON l.family = v.family AND k <= top JOIN tot USING (doc_id, chunk, family) GROUP BY ALL")
def fx2_fx6_chunk_families(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    chunks = P.chunked(docs, 100, spelling=dict(zip(map(ord, LATIN), GREEK, strict=True)))  # each word is spelt once
    r = P.family_sums(stored(chunks, "chunks"), CLOSED_GREEK, TOPS)  # read twice
    return r.groupBy("doc_id", F.col("chunk").cast("long").alias("chunk"), "family").agg(F.sum("features").alias("features"), F.round(F.sum("rates"), 4).alias("rates"), F.round(F.max("greatest"), 4).alias("greatest"))
