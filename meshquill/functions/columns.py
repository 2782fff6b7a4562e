"""Column expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; NULL where either is missing or b is 0."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.try_divide(a.cast("double"), b.cast("double"))


def known(c: Column | str) -> Column:
    """NaN and infinities as NULL: unavailable."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def skewness(c: str) -> Column:
    """Population skewness as an aggregate; 0 for constants, where Spark's own raises."""
    m, s = F.avg(c), F.stddev_pop(c)
    third = F.avg(F.pow(F.col(c), 3)) - 3 * m * F.avg(F.pow(F.col(c), 2)) + 2 * F.pow(m, 3)
    return F.coalesce(F.try_divide(third, F.pow(s, 3)), F.lit(0.0))
