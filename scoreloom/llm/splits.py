"""Splits that keep related records together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.components import components
from scoreloom.llm.names import article_id, dataset_key
from scoreloom.operators.synthetic import uniform
from scoreloom.runtime import Scratch

SHARES = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def sample_groups(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(sample_id, group_sample_id) of every sample that is tied to another one.

    Samples are tied when rows of theirs name the same article; ties chain.  An
    article becomes a star around its smallest sample, so an article of very
    many rows gives one edge per sample, never pairs.  Rows with null dataset,
    example_id or sample_id, or a blank example_id, tie nothing.
    """
    named = rows.select(
        "sample_id", dataset_key(F.col("dataset")).alias("d"), article_id(F.col("dataset"), F.col("example_id")).alias("e")
    ).filter("sample_id is not null and d is not null and e is not null")
    once = scratch.save(named.groupBy("d", "e", "sample_id").count().drop("count"))
    least = once.groupBy("d", "e").agg(F.min("sample_id").alias("v"), F.count("*").alias("n")).filter("n > 1")
    edges = once.join(least, ["d", "e"]).filter("sample_id <> v").select(F.col("sample_id").alias("u"), "v")
    return components(edges, scratch).select(F.col("node").alias("sample_id"), F.col("component").alias("group_sample_id"))


def tied_samples(rows: DataFrame) -> DataFrame:
    """(group_sample_id, sample_id): each sample but the smallest of its group."""
    groups = sample_groups(rows, Scratch(rows.sparkSession, "splits"))
    return groups.filter("sample_id <> group_sample_id").select("group_sample_id", "sample_id")


def split_rows(rows: DataFrame, shares: Sequence[tuple[str, float]] = SHARES, seed: int = 0, pinned: Mapping[int, str] | None = None) -> DataFrame:
    """(row_id, sample_id, group_sample_id, contamination_ratio, split) of every row.

    Rows tied by sample_id or article, directly or through others, get one
    split.  The hash of the component's smallest sample falls into fixed ranges
    of the given shares, so the result depends on neither order nor
    partitioning nor on rows of other components, and holds within each
    contamination_ratio too, which the hash ignores.  A component too large for
    its split can be given another one by ``pinned`` (a short list, see
    ``large_groups``).  A null ratio is 0.0 and noise is rounded away; a row
    with a null sample_id and an article goes by that article, one with neither
    by its row_id.  An empty table gives no rows.
    """
    scratch = Scratch(rows.sparkSession, "splits")
    d, e = dataset_key(F.col("dataset")), article_id(F.col("dataset"), F.col("example_id"))
    own = F.coalesce(F.col("sample_id"), -1 - F.abs(F.when(d.isNotNull() & e.isNotNull(), F.xxhash64(d, e)).otherwise(F.xxhash64("row_id")) % (1 << 62)))
    base = rows.select(
        "row_id", own.alias("sample_id"), "dataset", "example_id",
        F.round(F.coalesce(F.when(~F.isnan("contamination_ratio"), F.col("contamination_ratio")), F.lit(0.0)), 6).alias("contamination_ratio"),
    )
    groups = scratch.save(sample_groups(base, scratch))
    tied = base.drop("dataset", "example_id").join(groups, "sample_id", "left")
    tied = tied.withColumn("group_sample_id", F.coalesce("group_sample_id", "sample_id"))
    at = uniform(seed, F.pmod("group_sample_id", F.lit((1 << 31) - 1)))
    split, upto = F.lit(shares[-1][0]), 0.0
    for name, bound in reversed([(name, upto := upto + share) for name, share in shares[:-1]]):
        split = F.when(at < round(bound, 12), F.lit(name)).otherwise(split)
    for group, name in (pinned or {}).items():
        split = F.when(F.col("group_sample_id") == group, F.lit(name)).otherwise(split)
    return tied.select("row_id", "sample_id", "group_sample_id", "contamination_ratio", split.alias("split"))


def large_groups(split: DataFrame, share: float = 0.01) -> DataFrame:
    """(group_sample_id, split, n_rows) of the components with at least this share of all rows of ``split_rows``, for review and ``pinned``."""
    sizes = split.groupBy("group_sample_id", "split").agg(F.count("*").alias("n_rows"))
    return sizes.filter(F.col("n_rows") >= share * split.count())
