"""Names, ratios and paths in one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two ratios are the same if they differ by less.
SAME_RATIO = 1e-12


def dataset_name(dataset: Column) -> Column:
    """Lower case without blanks, ``_`` and ``-``."""
    return F.regexp_replace(F.lower(dataset), r"[\s_\-]+", "")


def ratio_of(ratio: Column) -> Column:
    """Ratio without floating-point noise; null is 0."""
    return F.round(F.coalesce(ratio, F.lit(0.0)), 6)


def same_ratio(ratio: Column, value: float) -> Column:
    return F.abs(F.coalesce(ratio, F.lit(0.0)) - value) < SAME_RATIO


def path_name(model: Column) -> Column:
    """Model id as one path component."""
    return F.replace(model, F.lit("/"), F.lit("__"))


def stable_hash(key: Column, seed: int = 0) -> Column:
    """Position of an integer key in a seeded order that any engine can compute: a multiplicative hash below 2^31."""
    return F.pmod((F.pmod(key, F.lit(2147483647)) + 1) * F.lit(1103515245) + F.lit(12345 + 7919 * seed), F.lit(2147483647))
