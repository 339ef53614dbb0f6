"""Double arithmetic with IEEE results.

Spark raises on division by zero in ANSI mode, gives null for ln(0) and orders NaN above all numbers. Metrics need
infinities and NaN, and comparisons with NaN must be false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inf() -> Column:
    return F.lit(float("inf"))


def nan() -> Column:
    return F.lit(float("nan"))


def _double(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def div(num, den) -> Column:
    """num / den: x/0 is a signed infinity, 0/0 and anything with NaN is NaN; null stays null."""
    n, d = _double(num), _double(den)
    return F.when(d != 0, n / d).when(F.isnan(n) | (n == 0), nan()).when(n > 0, inf()).when(n < 0, -inf())


def ln(x) -> Column:
    """Natural logarithm: -inf at 0, NaN below."""
    x = _double(x)
    return F.when(F.isnan(x), nan()).when(x > 0, F.ln(x)).when(x == 0, -inf()).when(x < 0, nan())


def sqrt(x) -> Column:
    x = _double(x)
    return F.when(F.isnan(x) | (x >= 0), F.sqrt(x)).when(x < 0, nan())


def larger(a, b) -> Column:
    """Maximum that ignores NaN."""
    a, b = _double(a), _double(b)
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))


def gt(a, b) -> Column:
    """a > b, false if either is NaN."""
    a, b = _double(a), _double(b)
    return ~F.isnan(a) & ~F.isnan(b) & (a > b)


def ge(a, b) -> Column:
    """a >= b, false if either is NaN."""
    a, b = _double(a), _double(b)
    return ~F.isnan(a) & ~F.isnan(b) & (a >= b)


def lt(a, b) -> Column:
    return gt(b, a)
