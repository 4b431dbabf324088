"""Column expressions on arrays of doubles; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, fn) -> Column:
    """fn of a value that is computed once a row, also where fn uses it inside a lambda function."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def settled(rows: DataFrame, *names: str) -> DataFrame:
    """The same rows; the columns are computed here, once, and not again within what uses them (Python functions can't read an expression with lambdas)."""
    for name in names:
        rows = rows.withColumn(name, F.explode(F.array(name)))
    return rows


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def centred(x: Column) -> Column:
    """x minus its mean."""
    return let(mean(x), lambda m: F.transform(x, lambda v: v - m))


def variance(x: Column) -> Column:
    return let(centred(x), lambda c: F.when(F.size(c) > 1, dot(c, c) / (F.size(c) - 1)))


def lagged(x: Column, k: int) -> tuple[Column, Column]:
    """(x without its last k, x without its first k)."""
    n = F.greatest(F.size(x) - k, F.lit(0))
    return F.slice(x, F.lit(1), n), F.slice(x, F.lit(k + 1), n)


def diff(x: Column, k: int = 1) -> Column:
    a, b = lagged(x, k)
    return F.zip_with(a, b, lambda p, q: q - p)


def acf(c: Column, k: int) -> Column:
    """Autocorrelation at lag k of an array that is centred already; null for a constant array."""
    a, b = lagged(c, k)
    power = dot(c, c)
    return F.when(power > 0, dot(a, b) / power)
