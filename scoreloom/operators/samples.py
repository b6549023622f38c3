"""Scored rows: the last scoring of each text, split halves, subsets, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions.names import dataset_name, ratio_of, same_ratio, stable_hash

KEY = ("sample_id", "label", "contamination_mode", "ratio")


def with_ratio(rows: DataFrame) -> DataFrame:
    """Adds ``ratio``: null as 0, noise rounded away; and ``dataset_key``."""
    return rows.withColumn("ratio", ratio_of(F.col("contamination_ratio"))).withColumn("dataset_key", dataset_name(F.col("dataset")))


def last_scored(rows: DataFrame) -> DataFrame:
    """Of each text row and pair of scoring models, the last scoring.

    Minima and maxima are taken before the shuffle, so a text scored very often
    sends one row per task; the rows themselves are then picked by score_id.
    """
    last = rows.groupBy("row_id", "scoring_observer_model", "scoring_reference_model").agg(F.max(F.struct("scored_at", "score_id")).alias("_last"))
    return rows.join(last.select(F.col("_last.score_id").alias("score_id")), "score_id", "left_semi")


def sources(rows: DataFrame) -> DataFrame:
    """Adds ``score_source``: rows scored with a reference model serve Binoculars, all others the remaining methods."""
    return rows.withColumn("score_source", F.when(F.col("scoring_reference_model").isNotNull(), "binoculars").otherwise("primary"))


def is_clean(label: str) -> Column:
    return (F.col("label") == label) & (F.col("contamination_mode") == "none")


def contaminated_subset(rows: DataFrame, mode: str, ratio: float) -> DataFrame:
    return rows.filter((F.col("contamination_mode") == mode) & same_ratio(F.col("ratio"), ratio))


def split_half(rows: DataFrame, seed: int = 0) -> DataFrame:
    """(sample_id, split): one half of the samples that have clean rows to tune on, the other to test.

    Samples are ordered by a seeded hash that depends on nothing but the id.
    The first half, but at least one sample, is for tuning; a single sample is
    for both.  Positions come from counts by hash range, so no task orders all
    samples.
    """
    ids = rows.filter(F.col("contamination_mode") == "none").select("sample_id").filter("sample_id is not null").distinct()
    ids = ids.withColumn("_h", stable_hash(F.col("sample_id"), seed)).withColumn("_b", F.shiftright("_h", 17))
    ranges = ids.groupBy("_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")
    ranges = ranges.select("_b", before.alias("_before"), F.sum("_n").over(W.partitionBy()).alias("_all"))
    placed = ids.join(ranges, "_b").withColumn("_pos", F.col("_before") + F.row_number().over(W.partitionBy("_b").orderBy("_h", "sample_id")))
    half = F.greatest(F.lit(1), F.floor(F.col("_all") / 2))
    kinds = F.when(F.col("_all") == 1, F.array(F.lit("tune"), F.lit("test"))).when(F.col("_pos") <= half, F.array(F.lit("tune"))).otherwise(F.array(F.lit("test")))
    return placed.select("sample_id", F.explode(kinds).alias("split"))


def tuning_ratio(rows: DataFrame, wanted: float = 0.25) -> DataFrame:
    """(contamination_mode, tuning_ratio): the wanted ratio where it occurs, else the middle of the sorted distinct ones."""
    seen = rows.filter(F.col("contamination_mode") != "none").groupBy("contamination_mode").agg(F.sort_array(F.collect_set("ratio")).alias("_r"))
    middle = F.element_at("_r", F.floor(F.size("_r") / 2).cast("int") + 1)
    return seen.select("contamination_mode", F.when(F.exists("_r", lambda r: F.abs(r - wanted) < 1e-12), F.lit(wanted)).otherwise(middle).alias("tuning_ratio"))


def key_differences(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """(side, *key): keys that only one of two score sets has; as sets, so repeated keys don't matter."""
    key = list(KEY)
    a, b = primary.select(key).distinct(), secondary.select(key).distinct()
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    missing = a.alias("a").join(b.alias("b"), same, "left_anti").select(F.lit("missing").alias("side"), *key)
    extra = b.alias("a").join(a.alias("b"), same, "left_anti").select(F.lit("extra").alias("side"), *key)
    return missing.unionByName(extra)


def require_same_keys(primary: DataFrame, secondary: DataFrame, shown: int = 5) -> None:
    """Raises ValueError, with a few examples, if two score sets differ in their keys."""
    diff = key_differences(primary, secondary)
    found = {side: [tuple(r)[1:] for r in diff.filter(F.col("side") == side).limit(shown).collect()] for side in ("missing", "extra")}
    if found["missing"] or found["extra"]:
        raise ValueError(f"score sets differ: missing {found['missing']}, extra {found['extra']}")


def require_rows(rows: DataFrame, what: str) -> DataFrame:
    """Raises ValueError if there are no rows."""
    if not rows.head(1):
        raise ValueError(f"no rows: {what}")
    return rows
