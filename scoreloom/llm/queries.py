"""Queries of the operators for training data, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scoreloom.llm import abuse, leakage, nearcopies, pairs, quantiles, repetition, splits, tokenize
from scoreloom.llm.oracle import oracle_sql  # noqa: F401
from scoreloom.runtime import Scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def _on(name: str, fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(table(spark, sf_dir, name))


def _leaks(fn: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


#: Where the machine of each application and data directory is saved, so that its three queries fit once.
_machines: dict[tuple[str, str], str] = {}


def _abuse(fn: Callable[..., DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        path = _machines.setdefault(key, Scratch(spark, "machine").path())
        return fn(*(table(spark, sf_dir, t) for t in ("documents", "abuse_reviews", "abuse_terms")), path=path)

    return query


def queries() -> dict[str, Query]:
    return {
        "p1_found": _on("clean", pairs.broken_pairs),
        "p1_defect_rates": _on("clean", pairs.defect_rates),
        "p2_found": _on("clean", splits.tied_samples),
        "p2_splits": _on("clean", splits.split_rows),
        "p3_found": _on("clean", repetition.repetitive),
        "p3_repetition": _on("clean", repetition.repetition),
        "p3_generators": _on("clean", repetition.generator_means),
        "p4_found": _on("clean", nearcopies.near_copy_pairs),
        "p4_groups": _on("clean", nearcopies.near_copies),
        "p5_percentiles": _on("score_real_text", quantiles.all_percentiles),
        "p5_errors": _on("score_real_text", quantiles.beyond_error),
        "p6_ids": _on("documents", tokenize.encode),
        "p6_round_trip": _on("documents", tokenize.round_trip),
        "p7_found": _leaks(leakage.leaked_pairs),
        "p7_items": _leaks(leakage.item_report),
        "p8_found": _abuse(abuse.abusive_docs),
        "p8_scores": _abuse(abuse.scored),
        "p8_sources": _abuse(abuse.source_rates),
    }
