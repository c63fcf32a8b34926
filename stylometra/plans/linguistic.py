"""Queries over text: cleaning, tokens, masks, n-gram families, feature composites."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tails
from ..operators import linguistic as L
from ..operators import profiles as P
from ..operators import text as T
from ..operators.features import step_up
from ..sources.tables import table
from .registry import RANKS, SENT, TOK, Y, query, r6, unit_year

CLOSED = ["the", "and", "of", "to", "der", "die", "das", "und", "le", "la", "les", "de", "el", "los", "que", "y"]
CLOSED_SQL = "(" + ", ".join(f"'{w}'" for w in CLOSED) + ")"


def _docs(spark, d):
    return table(spark, d, "documents")


def _tok(spark, d, *keep):
    return T.tokens(_docs(spark, d), *keep)


@query("SELECT conv_id, turn, sha256(nfc_normalize(text)) AS digest FROM conversations")
def sc1_nfc(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(L.nfc(F.col("text")).cast("binary"), 256).alias("digest"))


@query("SELECT conv_id, turn, length(regexp_replace(text, '[à-ö]', '', 'g')) AS n FROM conversations")
def sc3_strip_points(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.length(L.strip_points(F.col("text"), "à", "ö")).cast("long").alias("n"))


@query("SELECT o_orderkey, trim(regexp_replace(regexp_replace(t, '\\([^)]*\\)|\\[[^\\]]*\\]', '', 'g'), '^[^|]*\\|', '')) AS line FROM (SELECT o_orderkey, o_orderpriority || '(' || o_custkey || ')|[' || o_orderstatus || '] ' || o_custkey AS t FROM orders)")
def sc4_clean_line(spark, d):
    o = table(spark, d, "orders")
    t = F.concat("o_orderpriority", F.lit("("), F.col("o_custkey").cast("string"), F.lit(") ["), "o_orderstatus", F.lit("] "), F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", L.clean_line(t).alias("line"))


@query(f"WITH {SENT} SELECT doc_id, count(*) AS n_sents, max(length(sentence)) AS longest, sum(length(sentence))::BIGINT AS chars FROM sx GROUP BY 1")
def sc5_sentences(spark, d):
    n = F.length("sentence").cast("long")
    return T.sentences(_docs(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n_sents"), F.max(n).alias("longest"), F.sum(n).alias("chars"))


@query(f"WITH {SENT}, w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(sentence), '\\s+'), lambda w: regexp_matches(w, '^[^\\p{{L}}\\p{{N}}]*\\p{{L}}+[^\\p{{L}}\\p{{N}}]*$')) AS ws FROM sx) SELECT doc_id, count(*) AS n_sents, sum(len(ws))::BIGINT AS n_words, sum(list_sum(list_transform(ws, lambda w: length(w))))::BIGINT AS chars FROM w WHERE len(ws) >= 3 GROUP BY 1")
def sc6_tokenise_kept(spark, d):
    s = T.sentences(_docs(spark, d))
    ws = F.filter(F.split(F.lower("sentence"), r"\s+"), lambda w: w.rlike(r"^[^\p{L}\p{N}]*\p{L}+[^\p{L}\p{N}]*$"))
    kept = s.select("doc_id", ws.alias("ws")).where(F.size("ws") >= 3)
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_sents"), F.sum(F.size("ws")).alias("n_words"), F.sum(F.aggregate("ws", F.lit(0), lambda a, w: a + F.length(w))).alias("chars"))


@query(f"WITH {TOK} SELECT lang, token, count(*) AS n FROM tok GROUP BY 1, 2")
def sc7_tokens(spark, d):
    return _tok(spark, d, "lang").groupBy("lang", "token").agg(F.count("*").alias("n"))


@query(f"WITH {TOK}, f AS (SELECT doc_id, sent_no, tok_no, CASE WHEN token IN {CLOSED_SQL} THEN token END AS t FROM tok), g AS (SELECT t AS a, lead(t) OVER w AS b FROM f WINDOW w AS (PARTITION BY doc_id, sent_no ORDER BY tok_no)), f2 AS (SELECT * FROM f WHERE t IS NOT NULL), g2 AS (SELECT t AS a, lead(t) OVER w AS b FROM f2 WINDOW w AS (PARTITION BY doc_id, sent_no ORDER BY tok_no)) SELECT 'skip' AS mode, a || '·' || b AS gram, count(*) AS n FROM g WHERE a || b IS NOT NULL GROUP BY 2 UNION ALL SELECT 'compact', a || '·' || b, count(*) FROM g2 WHERE a || b IS NOT NULL GROUP BY 2")
def sc10_function_grams(spark, d):
    toks = _tok(spark, d, "doc_id")
    both = [L.joined_grams(toks, ["doc_id", "sent_no"], ["tok_no"], CLOSED, 2, c).groupBy("gram").agg(F.count("*").alias("n")).select(F.lit(m).alias("mode"), "gram", "n") for m, c in (("skip", False), ("compact", True))]
    return both[0].unionByName(both[1])


@query(f"WITH {TOK}, m AS (SELECT lang, CASE WHEN token IN {CLOSED_SQL} THEN token ELSE '·' END AS t FROM tok) SELECT lang, t, count(*) AS n, round(count(*) * 1000.0 / any_value(s), 6) AS rate FROM m JOIN (SELECT lang, count(*) AS s FROM m GROUP BY 1) USING (lang) GROUP BY 1, 2")
def sc11_sc12_masked_rates(spark, d):
    c = _tok(spark, d, "lang").groupBy("lang", L.mask(F.col("token"), CLOSED).alias("t")).agg(F.count("*").alias("n"))
    return c.select("lang", "t", "n", r6(F.col("n") * 1000.0 / F.sum("n").over(Window.partitionBy("lang")), "rate"))


@query("SELECT user_id, CASE WHEN event_type = 'view' THEN 'view_' || (CASE WHEN value > 50 THEN 'high' ELSE 'low' END) ELSE event_type END AS tag, count(*) AS n FROM events GROUP BY ALL")
def sc13_tag_with_detail(spark, d):
    t = F.col("event_type")
    tag = F.when(t == "view", F.concat(F.lit("view_"), F.when(F.col("value") > 50, "high").otherwise("low"))).otherwise(t)
    return table(spark, d, "events").groupBy("user_id", tag.alias("tag")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[#*$%&|<>.,;:!?]', '', 'g'), '\\s+'), lambda w: w <> '')) AS n_words, ends_with(trim(text), '.') AS full_stop, contains(lower(text), 'license') AS has_word, length(replace(text, '\n', '')) AS n_plain FROM documents")
def sc15_sc16_sc17_strings(spark, d):
    t = F.col("text")
    n = F.size(F.filter(F.split(F.translate(F.lower(t), "#*$%&|<>.,;:!?", ""), r"\s+"), lambda w: w != "")).cast("long")
    return _docs(spark, d).select("doc_id", n.alias("n_words"), F.trim(t).endswith(".").alias("full_stop"), F.lower(t).contains("license").alias("has_word"), F.length(F.replace(t, F.lit("\n"), F.lit(""))).cast("long").alias("n_plain"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, round(exp(-l_discount), 6) AS e, round(ln(l_extendedprice), 6) AS l, ceil(l_extendedprice / 7)::BIGINT AS c, floor(l_extendedprice / 7)::BIGINT AS f, sign(l_quantity - 25)::INT AS s, least(greatest(l_quantity, 10), 40) AS clipped, round(abs(l_quantity - 25) ** 1.5, 6) AS p FROM lineitem")
def sc18_math(spark, d):
    q, x = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", r6(F.exp(-F.col("l_discount")), "e"), r6(F.ln(x), "l"), F.ceil(x / 7).alias("c"), F.floor(x / 7).alias("f"), F.signum(q - 25).cast("int").alias("s"), F.least(F.greatest(q, F.lit(10.0)), F.lit(40.0)).alias("clipped"), r6(F.pow(F.abs(q - 25), F.lit(1.5)), "p"))


@query("SELECT user_id, round(max(value) + ln(sum(exp(value - m))), 6) AS lse FROM (SELECT user_id, value, max(value) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id")
def sc19_log_sum_exp(spark, d):
    e = table(spark, d, "events").select("user_id", "value")
    m = e.withColumn("m", F.max("value").over(Window.partitionBy("user_id")))
    return m.groupBy("user_id").agg(r6(F.max("m") + F.ln(F.sum(F.exp(F.col("value") - F.col("m")))), "lse"))


@query()
def sc21_normal_tails(spark, d):
    z = (F.col("l_quantity") - 25) / 14
    x = table(spark, d, "lineitem").select("l_quantity").distinct().withColumn("p", tails.normal_cdf(z))
    return x.select("l_quantity", r6("p", "p"), r6(tails.normal_quantile(F.col("p")), "z"))


@query("SELECT n_regionkey, sha256(string_agg(n_name, ',' ORDER BY n_name)) AS digest FROM nation GROUP BY 1")
def sc22_digest(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("n_name"))), 256).alias("digest"))  # a dimension of fixed size


@query("SELECT vec_id, round(embedding[1]::DOUBLE + coalesce(embedding[65]::DOUBLE, 0), 6) AS head, len(embedding[2:5]) AS part, round(list_sum(list_transform(embedding[2:5], lambda x: x::DOUBLE)), 6) AS part_sum FROM embeddings")
def sc24_arrays(spark, d):
    e, part = F.col("embedding"), F.slice("embedding", 2, 4)
    head = e[0].cast("double") + F.coalesce(F.try_element_at("embedding", F.lit(65)).cast("double"), F.lit(0.0))
    return table(spark, d, "embeddings").select("vec_id", r6(head, "head"), F.size(part).cast("long").alias("part"), r6(F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double")), "part_sum"))


@query(f"WITH {TOK}, c AS (SELECT source, token, count(*) AS n FROM tok GROUP BY 1, 2), v AS (SELECT token FROM c GROUP BY 1 ORDER BY sum(n) DESC, token LIMIT 100), s AS (SELECT source, sum(n) AS t FROM c GROUP BY 1) SELECT source, token, n, round(n * 1000.0 / t, 6) AS rate FROM c JOIN v USING (token) JOIN s USING (source)")
def fx2_form_rates(spark, d):
    return L.vocabulary_rates(_tok(spark, d, "source"), ["source"], "token", 100).select("source", "token", "n", r6("rate", "rate"))


@query("SELECT o_custkey AS unit, count(*) AS n, round(avg((o_orderstatus = 'F')::INT), 6) AS f_share, round(count(*) FILTER (o_orderstatus = 'O') / nullif(count(*) FILTER (o_orderstatus IN ('O', 'P')), 0), 6) AS o_share, round(count(*) FILTER (o_orderpriority LIKE '1%') * 1000.0 / count(*), 6) AS urgent, count(DISTINCT o_orderpriority) AS kinds, round(count(DISTINCT o_orderpriority) / count(*), 6) AS type_ratio FROM orders GROUP BY 1")
def fx3_fx4_profile(spark, d):
    s, n = F.col("o_orderstatus"), F.count("*")
    o = F.count_if(s == "O")
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("unit")).agg(n.alias("n"), r6(F.avg((s == "F").cast("int")), "f_share"), r6(F.try_divide(o, F.count_if(s.isin("O", "P"))), "o_share"), r6(F.count_if(F.col("o_orderpriority").startswith("1")) * 1000.0 / n, "urgent"), F.countDistinct("o_orderpriority").alias("kinds"), r6(F.countDistinct("o_orderpriority") / n, "type_ratio"))


@query("WITH c AS (SELECT conv_id, max(turn) FILTER (role = 'user') AS a, max(turn) FILTER (role = 'assistant') AS b FROM conversations GROUP BY 1) SELECT conv_id, a < b AS in_order, a IS NULL AS lacks_first FROM c")
def fx5_part_order(spark, d):
    return L.order_shares(table(spark, d, "conversations"), ["conv_id"], "role", "turn", "user", "assistant")


GRAM3 = "SELECT lang, source, token || '·' || lead(token) OVER w || '·' || lead(token, 2) OVER w AS gram FROM m WINDOW w AS (PARTITION BY doc_id, sent_no ORDER BY tok_no)"


@query(f"WITH {TOK}, m AS (SELECT doc_id, lang, source, sent_no, tok_no, CASE WHEN token IN {CLOSED_SQL} THEN token ELSE '·' END AS token FROM tok), g AS ({GRAM3}), c AS (SELECT lang, gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY 1, 2), v AS (SELECT gram FROM c GROUP BY 1 ORDER BY sum(n) DESC, gram LIMIT 200), s AS (SELECT lang, sum(n) AS t FROM c GROUP BY 1) SELECT lang, gram, n, round(n * 1000.0 / t, 6) AS rate FROM c JOIN v USING (gram) JOIN s USING (lang)")
def fx6_masked_trigrams(spark, d):
    m = _tok(spark, d, "doc_id", "lang").withColumn("token", L.mask(F.col("token"), CLOSED))
    g = T.token_ngrams(m, ["doc_id", "lang", "sent_no"], ["tok_no"], 3, "·")
    return L.vocabulary_rates(g, ["lang"], "gram", 200).select("lang", "gram", "n", r6("rate", "rate"))


@query("WITH r(unit, lo, hi, label) AS (VALUES ('a', 0, 39, 1), ('b', 30, 70, 2), ('c', 60, 2000000000, 3)) SELECT unit, label, count(*) AS turns, count(DISTINCT conv_id) AS convs, sum(length(text))::BIGINT AS chars FROM conversations JOIN r ON conv_id BETWEEN lo AND hi GROUP BY 1, 2")
def fx7_units(spark, d):
    ranges = [("a", 0, 39, 1), ("b", 30, 70, 2), ("c", 60, 2_000_000_000, 3)]
    inside = F.filter(F.array(*[F.struct(F.lit(u).alias("unit"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(k).alias("label")) for u, lo, hi, k in ranges]), lambda r: F.col("conv_id").between(r["lo"], r["hi"]))
    x = table(spark, d, "conversations").select("conv_id", F.length("text").alias("n"), F.explode(inside).alias("r")).select("conv_id", "n", "r.unit", "r.label")
    return x.groupBy("unit", "label").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("convs"), F.sum("n").alias("chars"))


@query(f"WITH {TOK}, c AS (SELECT source, {Y} AS y, token AS feature, count(*) AS n FROM tok GROUP BY ALL), r AS (SELECT source, y, feature, round(n * 1000.0 / sum(n) OVER (PARTITION BY source), 9) AS value FROM c), p AS (SELECT feature, count(*) AS units FROM r GROUP BY 1 HAVING count(*) >= 15), k AS {RANKS.format(by='feature', x='value', y='y', t='(SELECT r.* FROM r JOIN p USING (feature))')} SELECT feature, count(*) AS units, round(corr(rx, ry), 6) AS rho FROM k GROUP BY 1 HAVING abs(round(corr(rx, ry), 9)) >= 0.3")
def fx8_select_features(spark, d):
    c = _tok(spark, d, "source").groupBy("source", unit_year().alias("y"), F.col("token").alias("feature")).agg(F.count("*").alias("n"))
    t = c.groupBy("source").agg(F.sum("n").alias("t"))
    r = c.join(t, "source").withColumn("value", F.round(F.col("n") * 1000.0 / F.col("t"), 9))
    return L.select_features(r, "y", 15, 0.3).select("feature", "units", r6("rho", "rho"))


@query("SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS A, count(*) FILTER (l_returnflag = 'N') AS N, count(*) FILTER (l_returnflag = 'R') AS R FROM lineitem GROUP BY 1")
def fx9_count_matrix(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return L.count_matrix(c, "l_suppkey", "l_returnflag", ["A", "N", "R"])


@query(f"WITH {TOK}, w AS (SELECT doc_id, count(*) AS n, count(DISTINCT token) AS types, round(avg(length(token)), 6) AS token_length, round(count(*) FILTER (token IN {CLOSED_SQL}) * 1000.0 / count(*), 6) AS closed, count(DISTINCT sent_no) AS sents FROM tok GROUP BY 1) SELECT doc_id, token_length, closed, round(types / n, 6) AS ttr, round(n / sents, 6) AS sentence_length FROM w")
def fx10_register_profile(spark, d):
    return P.token_profile(_docs(spark, d), CLOSED).select("doc_id", r6("token_length", "token_length"), r6("closed", "closed"), r6("ttr", "ttr"), r6("sentence_length", "sentence_length"))


@query("WITH c AS (SELECT user_id, extract(hour FROM ts)::INT AS hour, event_type, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT * FROM c WHERE NOT (hour < 6 AND user_id % 3 = 0)) SELECT user_id, event_type, sum(n)::BIGINT AS n, round(sum(n) * 1000.0 / any_value(t), 6) AS rate FROM k JOIN (SELECT user_id, sum(n) AS t FROM k GROUP BY 1) USING (user_id) GROUP BY 1, 2")
def fx12_after_removal(spark, d):
    c = table(spark, d, "events").groupBy("user_id", F.hour(F.col("ts").cast("timestamp")).alias("hour"), "event_type").agg(F.count("*").alias("n"))
    removed = c.select("user_id", "hour").distinct().where("hour < 6 AND user_id % 3 = 0")
    return L.after_removal(c, removed, "user_id", "hour", "event_type").select("user_id", "event_type", "n", r6("rate", "rate"))


@query("WITH p AS (SELECT p_partkey AS feature, (p_partkey * 91 % 1000) / 1000.0 / (1 + p_size) AS p FROM part), r AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS rank, count(*) OVER () AS m FROM p) SELECT count(*) FILTER (p <= rank / m * 0.1) AS pointwise, coalesce(max(rank) FILTER (p <= rank / m * 0.1), 0) AS step_up FROM r")
def ag17_pointwise(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("feature"), (F.col("p_partkey") * 91 % 1000 / 1000.0 / (1 + F.col("p_size"))).alias("p"))
    r, m = step_up(p, 0.1), p.count()
    return r.agg(F.count_if(F.col("p") <= F.col("rank") / F.lit(m) * 0.1).alias("pointwise"), F.count_if("accepted").alias("step_up"))
