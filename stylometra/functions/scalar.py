"""Column expressions: shares, rates, scales, eras, rank statistics."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def share(a: Column, b: Column) -> Column:
    """a / (a + b), null when both are 0."""
    return F.try_divide(a, a + b)


def smoothed_share(a: Column, b: Column) -> Column:
    return (a + 0.5) / (a + b + 1)


def laplace_share(a: Column, b: Column) -> Column:
    return (a + 1) / (a + b + 2)


def per_thousand(count: Column, n: Column) -> Column:
    return F.try_divide(count * 1000.0, n)


def per_at_least_one(a: Column, n: Column) -> Column:
    return a / F.greatest(n, F.lit(1))


def clipped(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def logit_rate(x: Column, eps: float = 1e-4) -> Column:
    """Logit of a rate per 1000."""
    p = clipped(x / 1000, eps, 1 - eps)
    return F.ln(p / (1 - p))


def bucket(x: Column, cuts: list[float], names: list[str]) -> Column:
    """names[k] for cuts[k-1] >= x > cuts[k] (falling cuts); the last name below all."""
    out = F.when(x > cuts[0], names[0])
    for c, n in zip(cuts[1:], names[1:], strict=False):
        out = out.when(x > c, n)
    return out.otherwise(names[-1])


def era(year: Column) -> Column:
    """Positive years are BCE."""
    y = F.round(year).cast("long")
    return F.when(y >= 0, F.concat(y.cast("string"), F.lit(" BCE"))).otherwise(F.concat((-y).cast("string"), F.lit(" CE")))


def mean_rank(by: list, value) -> Column:
    """Rank within by; ties have the mean of their ranks."""
    ranked = Window.partitionBy(*by).orderBy(value)
    tied = Window.partitionBy(*by, value)
    return F.rank().over(ranked) + (F.count(F.lit(1)).over(tied) - 1) / 2.0


def half_even(x: Column, places: int = 0) -> Column:
    return F.bround(x, places)


def accents() -> tuple[str, str]:
    """Letters whose canonical decomposition is one base character and marks, and their bases."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x1E00, 0x2000)]:
        base = [c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and base[0] != chr(code):
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_diacritics(text: Column) -> Column:
    """Letters without their marks; loose combining marks go too."""
    source, target = accents()
    return F.regexp_replace(F.translate(text, source, target), r"\p{Mn}", "")
