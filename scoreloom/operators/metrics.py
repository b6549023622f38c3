"""Orientation, true-positive rate at a false-positive rate, and AUROC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions.arrays import settled
from scoreloom.operators.quantiles import _bucket, _other, _part, _same, quantiles
from scoreloom.runtime import Scratch

# False-positive rates of the curve.
CURVE = (1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05, 0.03, 0.02, 0.01, 0.005, 0.003, 0.001)


def orientation(scores: DataFrame, by: Sequence[str], human: Column, llm: Column, score: str = "score") -> DataFrame:
    """(*by, mean_human, mean_llm, direction): +1 if machine texts score at least as high on average, else -1."""
    means = scores.groupBy(*by).agg(F.avg(F.when(human, F.col(score))).alias("mean_human"), F.avg(F.when(llm, F.col(score))).alias("mean_llm"))
    means = means.withColumns({c: F.round(c, 9) for c in ("mean_human", "mean_llm")})
    return means.withColumn("direction", F.when(F.col("mean_llm") >= F.col("mean_human"), 1).otherwise(-1))


def tpr_at_fpr(human: DataFrame, llm: DataFrame, by: Sequence[str], fprs: Sequence[float], more: Sequence[str] = (), score: str = "score") -> DataFrame:
    """(*by, *more, fpr, threshold, tpr, n_human, n_llm).

    The threshold is the (1 - fpr) quantile of the human scores of each group
    ``by``; the rate is the share of machine scores of each group (*by, *more)
    that reach it.  Groups without scores on one side have a null rate.
    """
    by, more = list(by), list(more)
    limits = quantiles(human, by, score, [round(1.0 - f, 12) for f in fprs], decimals=9)
    at = lambda f: F.max(F.when(F.abs(F.col("q") - round(1.0 - f, 12)) < 1e-12, F.col("quantile")))
    limits = limits.groupBy(*by).agg(F.max("n").alias("n_human"), F.array(*(at(f) for f in fprs)).alias("_limits"))
    # One row for each group; saved, so that its size is known and a small one makes no shuffle of the scores.
    limits = Scratch(human.sparkSession, "limits").save(limits)
    groups = llm.select(*by, *more, F.round(score, 9).alias("_s"))
    both = groups.join(limits.withColumnsRenamed({b: f"_{b}" for b in by}), [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by] or F.lit(True), "left")
    reach = [F.avg((F.col("_s") >= F.get("_limits", F.lit(i))).cast("double")) for i in range(len(fprs))]
    each = both.groupBy(*by, *more).agg(F.max("n_human").alias("n_human"), F.count("_s").alias("n_llm"), F.max("_limits").alias("_limits"), F.array(*reach).alias("_rates"))
    rows = [F.struct(F.lit(float(f)).alias("fpr"), F.get("_limits", F.lit(i)).alias("threshold"), F.round(F.get("_rates", F.lit(i)), 9).alias("tpr")) for i, f in enumerate(fprs)]
    return each.select(*by, *more, "n_human", "n_llm", F.inline(F.array(*rows))).select(*by, *more, "fpr", "threshold", "n_human", "tpr", "n_llm")


def auroc(scores: DataFrame, by: Sequence[str], llm: Column, score: str = "score") -> DataFrame:
    """(*by, auroc, n_human, n_llm): chance that a machine score lies above a human one, ties half.

    Scores are counted by value before they are ordered, and ordered in equal
    parts of value ranges, so no pair is formed and no task orders a whole
    group.  Groups without scores on one side have a null value.
    """
    by = list(by)
    x = settled(F.col(score))
    known = scores.filter(F.col(score).isNotNull() & ~F.isnan(score)).select(*by, x.alias("_x"), llm.alias("_llm")).withColumn("_b", _bucket(F.col("_x")))
    key = [*by, "_b"]
    ranges = Scratch(scores.sparkSession, "auroc").save(known.groupBy(*key).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high")))
    each = known.join(_other(ranges, key), _same(key)).withColumn("_p", _part(F.col("_x"), F.col("_low"), F.col("_high")))
    each = each.groupBy(*key, "_p", "_x").agg(F.sum((~F.col("_llm")).cast("long")).alias("_h"), F.sum(F.col("_llm").cast("long")).alias("_m"))
    parts = each.groupBy(*key, "_p").agg(F.sum("_h").alias("_hp"))
    # First within buckets, then over buckets: neither holds more rows than there are parts or buckets.
    inner = F.sum("_hp").over(W.partitionBy(*key).orderBy("_p").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_hp")
    parts = parts.withColumn("_inner", inner)
    whole = parts.groupBy(*key).agg(F.sum("_hp").alias("_hb"))
    before = F.sum("_hb").over(W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_hb")
    whole = _other(whole.select(*key, before.alias("_outer")), key)
    place = [*key, "_p"]
    parts = _other(parts.join(whole, _same(key)).select(*place, (F.col("_outer") + F.col("_inner")).alias("_before")), place)
    below = F.sum("_h").over(W.partitionBy(*place).orderBy("_x").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_h")
    each = each.withColumn("_below", below).join(parts, _same(place))
    wins = F.sum(F.col("_m") * (F.col("_before") + F.col("_below") + F.col("_h") / 2))
    return each.groupBy(*by).agg(F.sum("_h").alias("n_human"), F.sum("_m").alias("n_llm"), wins.alias("_w")).select(
        *by, F.round(F.try_divide("_w", F.col("n_human") * F.col("n_llm").cast("double")), 9).alias("auroc"), "n_human", "n_llm"
    )
