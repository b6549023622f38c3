"""Exact quantiles of very large groups without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.runtime import Scratch

#: Buckets for each doubling of a value.
PER_DOUBLING = 16


def _bucket(value: Column) -> Column:
    """A number that never falls as the value rises: sign and logarithm, cut finely."""
    size = F.floor(F.log2(F.greatest(F.abs(value), F.lit(1e-300))) * PER_DOUBLING) + F.lit(100_000)
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0).cast("bigint"))


#: Equal parts of a bucket's range in which its values are ordered.
PARTS = 1024


def _part(value: Column, low: Column, high: Column) -> Column:
    """Which of the equal parts of [low, high] a value lies in."""
    return F.when(high > low, F.least(F.floor((value - low) / (high - low) * PARTS), F.lit(PARTS - 1))).otherwise(F.lit(0).cast("bigint"))


def _same(names: Sequence[str]) -> list[Column]:
    """Join conditions of columns with those that ``_other`` renamed."""
    return [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in names]


def _other(frame: DataFrame, names: Sequence[str]) -> DataFrame:
    return frame.withColumnsRenamed({c: f"_o_{c}" for c in names})


def quantiles(rows: DataFrame, by: Sequence[str], value: str, at: Sequence[float], decimals: int | None = None) -> DataFrame:
    """(*by, q, n, quantile): exact quantiles with linear interpolation between neighbours.

    Values are first counted in buckets of value ranges, combined before the
    shuffle; only values of buckets that hold a wanted position are shuffled,
    equal ones as one row.  These are counted in parts of their bucket, and only
    parts that hold a wanted position are ordered by value, so no task sorts a
    whole group, however hot or narrow.  Null, NaN and infinite values are left
    out; groups without others have no row.
    """
    by = list(by)
    x = F.col(value).cast("double")
    good = rows.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = good.select(*by, F.when(x == 0, F.lit(0.0)).otherwise(x).alias("_x")).withColumn("_b", _bucket(F.col("_x")))
    buckets = good.groupBy(*by, "_b").agg(F.count("*").alias("_in"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    upto = W.partitionBy(*by).orderBy("_b") if by else W.orderBy("_b")
    buckets = buckets.withColumn("_before", F.sum("_in").over(upto.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_in"))
    buckets = buckets.withColumn("_n", F.sum("_in").over(W.partitionBy(*by)))
    spots = F.array(*(F.struct(F.lit(float(q)).alias("q"), (F.col("_n") - 1).cast("double").alias("_last")) for q in at))
    wanted = buckets.select("*", F.inline(spots)).withColumn("_pos", F.col("q") * F.col("_last"))
    wanted = wanted.withColumn("_lo", F.floor("_pos")).withColumn("_hi", F.ceil("_pos"))

    def holds(begin: Column, many: Column) -> Column:
        return (F.col("_hi") >= begin) & (F.col("_lo") < begin + many)

    wanted = wanted.filter(holds(F.col("_before"), F.col("_in")))
    # Saved, so that its size is known and a small one makes no shuffle of the values.
    wanted = Scratch(rows.sparkSession, "quantiles").save(wanted.select(*by, "_b", "_low", "_high", "_before", "_n", "q", "_pos", "_lo", "_hi"))
    key = [*by, "_b"]
    own = _other(wanted.select(*key, "_low", "_high", "_before").distinct(), key)
    near = good.join(own, _same(key)).groupBy(*key, "_low", "_high", "_before", "_x").agg(F.count("*").alias("_c"))
    near = near.withColumn("_p", _part(F.col("_x"), F.col("_low"), F.col("_high")))
    parts = near.groupBy(*key, "_p", "_before").agg(F.sum("_c").alias("_many"))
    earlier = F.sum("_many").over(W.partitionBy(*key).orderBy("_p").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_many")
    parts = parts.select(*key, "_p", "_many", (F.col("_before") + earlier).alias("_begins"))
    spots = _other(wanted.select(*key, "_n", "q", "_pos", "_lo", "_hi"), key)
    spots = parts.join(spots, _same(key)).filter(holds(F.col("_begins"), F.col("_many"))).select(*key, "_p", "_begins", "_n", "q", "_pos", "_lo", "_hi")
    place = [*key, "_p"]
    inside = near.join(_other(spots.select(*place, "_begins").distinct(), place), _same(place))
    order = W.partitionBy(*place).orderBy("_x").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = inside.select(*place, "_x", "_c", (F.col("_begins") + F.sum("_c").over(order)).alias("_end"))
    hit = placed.join(_other(spots.drop("_begins"), place), _same(place))
    at_value = lambda p: (F.col(p) >= F.col("_end") - F.col("_c")) & (F.col(p) < F.col("_end"))
    ends = hit.groupBy(*by, "q").agg(F.max("_n").alias("n"), F.max("_pos").alias("_pos"), F.max(F.when(at_value("_lo"), F.col("_x"))).alias("_a"), F.max(F.when(at_value("_hi"), F.col("_x"))).alias("_z"))
    result = F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_pos") - F.floor("_pos"))
    if decimals is not None:
        result = F.round(result, decimals)
    return ends.select(*by, "q", "n", result.alias("quantile"))
