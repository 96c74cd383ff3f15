"""Column helpers that operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_where(condition: Column) -> Column:
    """Rows for which the condition holds; null counts as not."""
    return F.count_if(condition).cast("long")


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """100 * part / whole as a double, null if the whole is 0."""
    return F.round(F.try_divide(F.lit(100.0).cast("double") * part.cast("double"), whole.cast("double")), digits)


def mean(column: Column, digits: int = 4) -> Column:
    return F.round(F.avg(column), digits)


def buckets(value: Column, *bounds: tuple[float, str], rest: str) -> Column:
    """The label of the first bound above the value."""
    out = F
    for bound, label in bounds:
        out = out.when(value < bound, label)
    return out.otherwise(rest)
