"""Array expressions: one value per document from its tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keeps denominators off zero.
EPS = 1e-12
#: Decimals of document scores before they are compared with anything.
DECIMALS = 10


def number(values: Column) -> Column:
    return values.cast("array<double>")


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def finite(values: Column) -> Column:
    """The finite elements."""
    return F.filter(values, is_finite)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    """Mean of the finite elements; null if there are none."""
    own = finite(values)
    return F.when(F.size(own) > 0, total(own) / F.size(own))


def at_least(values: Column, lower: Column) -> Column:
    """Elements below ``lower`` raised to it; a null bound changes nothing."""
    return F.transform(values, lambda x: F.when(is_finite(x), F.greatest(x, lower)))


def at_most(values: Column, upper: Column) -> Column:
    """Elements above ``upper`` lowered to it; a null bound changes nothing."""
    return F.transform(values, lambda x: F.when(is_finite(x), F.least(x, upper)))


def clip(values: Column, lower: Column | None = None, upper: Column | None = None) -> Column:
    if lower is not None:
        values = at_least(values, lower)
    return at_most(values, upper) if upper is not None else values


def negate(values: Column) -> Column:
    return F.transform(values, lambda x: -x)


def minus(a: Column, b: Column) -> Column:
    """Differences by position; positions that one array lacks are null."""
    return F.zip_with(a, b, lambda x, y: x - y)


def settled(score: Column) -> Column:
    """A score rounded for comparisons, so that the order of summation doesn't decide ties."""
    return F.round(score, DECIMALS)
