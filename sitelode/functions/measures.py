"""Small measures of readings, texts and checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters a token, tokens a page may have, characters a billed unit.
CHARS_PER_TOKEN, TOKEN_BUDGET, CHARS_PER_UNIT = 4, 30_000, 1_000


def largest_part(parts: dict[str, Column]) -> Column:
    """The name of the largest of several parts, the first of equals; null unless all are known."""
    known = F.lit(True)
    for c in parts.values():
        known = known & c.isNotNull()
    out, most = F.lit(None).cast("string"), F.greatest(*parts.values())
    for name, c in reversed(parts.items()):
        out = F.when(c == most, name).otherwise(out)
    return F.when(known, out)


def hit_share(hit: Column, miss: Column) -> Column:
    """Null if either is, or both are zero."""
    return F.try_divide(hit, hit + miss)


def billing_units(text: Column) -> Column:
    return F.ceil(F.length(text) / CHARS_PER_UNIT)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / CHARS_PER_TOKEN)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def stored(x: Column) -> Column:
    """Two decimals; null for what is no finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), half_up(x * 100) / 100)


def earned(points: Column, met: Column, total: Column) -> Column:
    """Points in proportion to what is met; null where nothing was to be met."""
    return half_up(F.try_divide(points * met, total))


def rounded_median(x: Column) -> Column:
    """An aggregate: the median, halves up."""
    return half_up(F.median(x))
