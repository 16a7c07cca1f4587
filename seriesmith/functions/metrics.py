"""Error metrics as aggregates over the columns of original and generated values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def mse(a: Column, b: Column) -> Column:
    return F.avg((a - b) * (a - b))


def nmse(a: Column, b: Column) -> Column:
    """Squared error by squared signal; null for a signal of zeros, where the engine would divide by zero."""
    return F.try_divide(F.sum((b - a) * (b - a)), F.sum(a * a))


def mae(a: Column, b: Column) -> Column:
    return F.avg(F.abs(b - a))


def ape(a: Column, b: Column) -> Column:
    """|b - a| / |a|, infinite for an original of zero, NaN where both are."""
    at_zero = F.when(b == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return F.when(a == 0, at_zero).otherwise(F.abs(F.try_divide(b - a, a)))


def mape(a: Column, b: Column) -> Column:
    return F.avg(ape(a, b))


def smape(a: Column, b: Column) -> Column:
    """Sum of differences by sum of sizes, by the number of pairs once more; pairs of zeros add nothing."""
    return F.try_divide(F.sum(F.abs(b - a)), F.sum(F.abs(a) + F.abs(b))) / F.count(F.lit(1))


METRICS: dict[str, Callable[[Column, Column], Column]] = {"mse": mse, "nmse": nmse, "mae": mae, "mape": mape, "smape": smape}


def error_of(method: str, a: Column, b: Column) -> Column:
    """A metric by its name; a pair with a missing side fails the query."""
    paired = F.assert_true(a.isNotNull() & b.isNotNull(), F.lit("original and generated series differ in length"))
    return F.when(F.count(paired) >= 0, METRICS[method](a, b))
