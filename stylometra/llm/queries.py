"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, importance, language_id, mixing, order_minhash, quality_model, quality_rules, secrets, substring_dedup, suffix_dedup, token_files, vector_codes
from .common import table

#: Target shares of tokens by language.
TARGETS = {"de": 0.16, "en": 0.52, "es": 0.16, "fr": 0.16}


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain): the language of documents in the table of labels."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("lang").alias("domain"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), labelled_domains(spark, sf_dir), TARGETS)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_model.fit(docs, labels.where(~quality_model.held_out("doc_id")))
    return quality_model.predict(docs, model).select("doc_id", quality_model.held_out("doc_id").alias("held_out"), "score", "predicted")


def op3_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_rules.apply_policy(quality_rules.stored_ledger(table(spark, sf_dir, "documents")))
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.mask_of("base"))) != 0
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


def quality_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the ledger of op5: for each rule the documents that fail it, that fail it alone, and that would be kept without it."""
    return quality_rules.ablation(quality_rules.stored_ledger(table(spark, sf_dir, "documents")))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(table(spark, sf_dir, "documents"))[0]


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.without_repeats(table(spark, sf_dir, "documents"), 35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), 400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, ~language_id.held_out("doc_id"))
    return language_id.predict(docs, model).select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_quality_classifier, op3_bpe_coding, op4_order_minhash, op5_quality_rules, op6_token_files, op7_fingerprints, op8_secret_scan, op9_substring_dedup, op10_suffix_dedup, op11_language_id, op12_importance_resampling, op13_vector_codes, quality_rule_ablation)}

_SPACE = "[\\x20\\x09-\\x0D]+"

_BITS = ", ".join(f"('{rule}', {1 << k})" for k, rule in enumerate(quality_rules.RULES))

#: DuckDB SQL over the whole tables, where SQL can express the operator.
ORACLE_SQL = {
    "op5_quality_rules": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda x: x <> '') AS ws,
             string_split(text, chr(10)) AS ls FROM t),
grams AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 1, 1))) AS i, ws FROM w),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM grams),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(3) r(k) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(ls) AS l FROM w),
dl AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS d FROM ln WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(d, 0)::BIGINT AS n_dup_lines,
             coalesce(cover.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
             length(regexp_replace(text, '[^!]', '', 'g')) AS n_shouts
      FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN dl USING (doc_id)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END) + (CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
             + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)
             + (CASE WHEN 100 * n_shouts > 30 * n_words THEN 64 ELSE 0 END) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed::BIGINT AS failed FROM f""",
    "op9_substring_dedup": f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 33, 1))) AS i, ws FROM w),
g AS (SELECT doc_id, i, sha256(array_to_string(ws[i : i + 34], ' ')) AS h FROM s WHERE len(ws) >= 35),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM g) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM rep, range(35) r(k)),
words AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.i) FILTER (WHERE gone.i IS NULL) AS t, count(gone.i) AS n_removed
         FROM words LEFT JOIN gone USING (doc_id, i) GROUP BY words.doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
}
ORACLE_SQL["quality_rule_ablation"] = f"""
WITH ledger AS ({ORACLE_SQL["op5_quality_rules"]}), r(rule, bit) AS (VALUES {_BITS}), kept AS (SELECT failed & {quality_rules.mask_of("v1")} AS bits FROM ledger)
SELECT rule, count(*) FILTER (bits & bit <> 0) AS n_failed, count(*) FILTER (bits = bit) AS n_only, count(*) FILTER (bits & ({quality_rules.mask_of("v1")} - bit) = 0) AS n_kept_without FROM kept, r GROUP BY rule"""


def _lloyd_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    """Whole passes of the rounds, with nothing kept between them."""
    q = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda v: floor(4096 * v::DOUBLE)::BIGINT) AS x, len(embedding) // {parts} AS d
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
p AS MATERIALIZED (SELECT r, part, x[part * d + 1 : (part + 1) * d] AS x FROM kept, range({parts}) t(part)),
b0 AS MATERIALIZED (SELECT part, e, x AS c FROM (SELECT r, row_number() OVER (ORDER BY vec_id, x) - 1 AS e FROM kept ORDER BY vec_id, x LIMIT {entries}) JOIN p USING (r))"""
    for k in range(rounds + 1):
        q += f""",
a{k} AS MATERIALIZED (SELECT r, part, min([list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e]) AS best FROM p JOIN b{k} USING (part) GROUP BY r, part)"""
        if k < rounds:
            q += f""",
s{k} AS (SELECT part, best[2] AS e, i, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT part, best, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{k} JOIN p USING (r, part)) GROUP BY ALL),
m{k} AS (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{k} GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT part, e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (part, e))"""
    return q + f""",
f AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN f USING (r), h"""


ORACLE_SQL["op13_vector_codes"] = _lloyd_sql()
#: The CRC by its byte table, made from the polynomial and applied byte after byte.
ORACLE_SQL["op12_importance_resampling"] = """
WITH RECURSIVE tab(i, k, v) AS (SELECT range::BIGINT, 0, range::BIGINT FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM tab WHERE k < 8),
t AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM tab WHERE k = 8),
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
lists AS (SELECT side, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM texts),
words AS (SELECT side, id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM lists),
runs AS (SELECT side, id, w, lead(w) OVER x AS w2, lead(w, 2) OVER x AS w3 FROM words WINDOW x AS (PARTITION BY side, id ORDER BY i)),
grams AS MATERIALIZED (SELECT side, id, f, count(*) AS n FROM (SELECT side, id, unnest([w, w || ' ' || w2, w || ' ' || w2 || ' ' || w3]) AS f FROM runs) WHERE f IS NOT NULL GROUP BY ALL),
crcs AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(f)), lambda j: ('0x' || substr(hex(encode(f)), 2 * j + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT f FROM grams), t),
c AS MATERIALIZED (SELECT side, id, bucket, sum(n) AS n FROM grams JOIN crcs USING (f) GROUP BY ALL),
b AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM c GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM b) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM b) + 10000)::DOUBLE)))::BIGINT AS gain FROM b),
w AS (SELECT id AS doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM c JOIN g USING (bucket) WHERE side = 'd' GROUP BY 1),
s AS (SELECT id AS doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM lists LEFT JOIN w ON id = doc_id WHERE side = 'd'),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM s LEFT JOIN r USING (doc_id)"""
