"""Staged selection of character n-grams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selection as S
from ..sources.tables import table
from .registry import Y, query, r6, unit_year

SIZES, LEAST, ALPHA, STABLE, MOST = (3, 4), 8, 0.1, 0.65, 120

_GRAMS = " UNION ALL ".join(f"SELECT source, unnest(list_transform(range(1, length(text) - {n - 2}), lambda i: substring(text, i, {n}))) AS item FROM documents WHERE length(text) >= {n}" for n in SIZES)
#: Two-sided p of r by t with an even number of degrees of freedom, as a finite sum.
_P = "greatest(0, 1 - abs(rho) * coalesce(list_sum(list_transform(range((n - 2) // 2), lambda k: exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - 2 * k * ln(2.0)) * (1 - rho * rho) ** k)), 0))"


@query(f"""WITH g AS ({_GRAMS}), c AS (SELECT source, item, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT source, {Y} AS y, sum(length(text)) AS chars FROM documents GROUP BY ALL), u AS (SELECT *, count(*) OVER () AS n, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM t),
r AS (SELECT source, item, round(c.n * 1000.0 / chars, 9) AS value FROM c JOIN t USING (source)),
h AS (SELECT item, count(*) AS units FROM r GROUP BY 1 HAVING count(*) >= {LEAST}),
d AS MATERIALIZED (SELECT h.item, h.units, u.source, u.n, u.y, u.ry, coalesce(r.value, 0) AS value FROM h CROSS JOIN u LEFT JOIN r ON r.item = h.item AND r.source = u.source),
k AS (SELECT *, rank() OVER (PARTITION BY item ORDER BY value) + (count(*) OVER (PARTITION BY item, value) - 1) / 2.0 AS rx FROM d),
s AS (SELECT item, any_value(units) AS units, any_value(n) AS n, round((any_value(n) * sum(rx * ry) - sum(rx) * sum(ry)) / sqrt((any_value(n) * sum(rx * rx) - sum(rx) ** 2) * (any_value(n) * sum(ry * ry) - sum(ry) ** 2)), 12) AS rho FROM k GROUP BY 1),
p AS MATERIALIZED (SELECT *, round({_P}, 12) AS p FROM s WHERE NOT isnan(rho)),
b AS (SELECT *, row_number() OVER (ORDER BY p, item) AS place, count(*) OVER () AS m FROM p), a AS MATERIALIZED (SELECT item, rho FROM b WHERE place <= coalesce((SELECT max(place) FROM b WHERE p <= place / m * {ALPHA}), 0)),
e AS (SELECT x.item, rho, j.source AS gone, x.value, x.y, x.n - 1 AS n FROM a JOIN d x USING (item) JOIN u j ON j.source <> x.source),
f AS (SELECT item, rho, gone, n, rank() OVER (PARTITION BY item, gone ORDER BY value) + (count(*) OVER (PARTITION BY item, gone, value) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY item, gone ORDER BY y) + (count(*) OVER (PARTITION BY item, gone, y) - 1) / 2.0 AS ry FROM e),
l AS (SELECT item, rho, gone, any_value(n) AS n, min(rx) < max(rx) AND sign(any_value(n) * sum(rx * ry) - sum(rx) * sum(ry)) = sign(rho) AS same FROM f GROUP BY item, rho, gone),
z AS (SELECT item, rho FROM l GROUP BY item, rho HAVING sum(same::INT) / any_value(n) >= {STABLE}), q AS (SELECT item, row_number() OVER (ORDER BY abs(rho) DESC, item) AS place FROM z)
SELECT s.item, s.units, round(s.rho, 6) AS rho, round(p.p, 6) AS p, CASE WHEN q.place <= {MOST} THEN 'selected' WHEN q.place IS NOT NULL THEN 'stable' WHEN a.item IS NOT NULL THEN 'significant' ELSE 'prevalent' END AS stage, CASE WHEN q.place <= {MOST} THEN q.place END AS place
FROM s LEFT JOIN p USING (item) LEFT JOIN a USING (item) LEFT JOIN q USING (item)""")
def fx8_staged_selection(spark, d):
    """Every character 3- and 4-gram of at least 8 sources with the last stage that it reaches against the sources' numbers."""
    docs = table(spark, d, "documents")
    units = docs.groupBy("source").agg(F.sum(F.length("text")).alias("chars")).withColumn("y", unit_year())
    rates = S.gram_counts(docs, "source", "text", SIZES).join(F.broadcast(units), "source").select("source", "item", F.round(F.col("n") * 1000.0 / F.col("chars"), 9).alias("value"))  # a row for each source
    return S.select(rates, units.select("source", "y"), "source", "item", "value", LEAST, ALPHA, STABLE, MOST).select("item", "units", r6("rho", "rho"), r6("p", "p"), "stage", "place")
