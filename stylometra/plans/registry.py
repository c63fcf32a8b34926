"""The registry of queries with their DuckDB SQL, and the inputs that queries share. Doubles are rounded to 6 places on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import text as T
from ..sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r6(c, name: str):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def dims(spark: SparkSession, d: str) -> DataFrame:
    """(row, grp, feature, value) of embeddings."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.col("label").alias("grp"), F.posexplode("embedding").alias("feature", "v")).select("row", "grp", "feature", F.col("v").cast("double").alias("value"))


DIMS = "dims AS (SELECT vec_id AS row, label AS grp, generate_subscripts(embedding, 1) - 1 AS feature, unnest(embedding)::DOUBLE AS value FROM embeddings)"
SENT = "sents AS (SELECT doc_id, source, lang, list_filter(list_transform(regexp_split_to_array(text, '[.;\\n]+'), lambda s: trim(s, ' ')), lambda s: s <> '') AS ss FROM documents), sx AS (SELECT doc_id, source, lang, generate_subscripts(ss, 1) - 1 AS sent_no, unnest(ss) AS sentence FROM sents)"
TOK = SENT + ", tw AS (SELECT doc_id, source, lang, sent_no, list_filter(list_transform(regexp_split_to_array(lower(sentence), '\\s+'), lambda w: regexp_replace(w, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')), lambda w: w <> '') AS ws FROM sx), tok AS (SELECT doc_id, source, lang, sent_no, generate_subscripts(ws, 1) - 1 AS tok_no, unnest(ws) AS token FROM tw)"
Y = "cast(regexp_extract(source, '[0-9]+') AS DOUBLE)"


def unit_year():
    return F.regexp_extract("source", "[0-9]+", 0).cast("double")


def rates_by_source(spark, d):
    """(grp, y, feature, value): rates per 1000 tokens of each source."""
    n, t = F.col("n"), F.col("token")
    some = lambda c, name: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).alias(name)
    c = T.token_counts(table(spark, d, "documents"), "source").groupBy("source").agg(F.sum(n).alias("n"), F.count("*").alias("types"), F.sum(n * F.length(t)).alias("chars"), some(F.length(t) <= 3, "short"), some(t.rlike("(?:tion|ung|ment|aux)$"), "suffix"))
    f = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), e.alias("value")) for k, e in (("short_rate", F.col("short") * 1000.0 / F.col("n")), ("suffix_rate", F.col("suffix") * 1000.0 / F.col("n")), ("token_length", F.col("chars") / F.col("n")), ("type_share", F.col("types") / F.col("n")))]))
    return c.select(F.col("source").alias("grp"), unit_year().alias("y"), f.alias("f")).select("grp", "y", "f.*")


RATES = TOK + f", c AS (SELECT source, count(*) AS n, count(DISTINCT token) AS types, sum(length(token)) AS chars, count(*) FILTER (length(token) <= 3) AS short, count(*) FILTER (regexp_matches(token, '(?:tion|ung|ment|aux)$')) AS suffix FROM tok GROUP BY source), rates AS (SELECT source AS grp, {Y} AS y, unnest(['short_rate','suffix_rate','token_length','type_share']) AS feature, unnest([short * 1000.0 / n, suffix * 1000.0 / n, chars / n, types / n]) AS value FROM c)"
RANKS = "(SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY {by} ORDER BY {y}) + (count(*) OVER (PARTITION BY {by}, {y}) - 1) / 2.0 AS ry FROM {t})"
