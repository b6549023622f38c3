"""Document scores: one number from a document's tokens, raw or with one-sided clipping."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.arrays import EPS, at_least, at_most, mean, minus, negate, number, settled

#: Methods that average one feature.
SINGLE = {"log_likelihood": "logp_a", "rank": "rank_a", "log_rank": "logrank_a", "entropy": "entropy_a"}
METHODS = ("log_likelihood", "rank", "log_rank", "lrr", "entropy", "entropy_gap", "binoculars")
#: Names for reports.
LABELS = {"log_likelihood": "LogLik", "rank": "Rank", "log_rank": "LogRank", "lrr": "LRR", "entropy": "Entropy", "entropy_gap": "Entropy-gap", "binoculars": "Binoculars"}
MATRIX_METHODS = ("log_likelihood", "log_rank", "lrr_both", "likelihood_ratio", "binoculars", "entropy_gap")
BOUNDS = ("lower", "nll_upper", "logrank_upper")

Spec = Mapping[str, Column | float]


def feature(name: str, tokens: str = "token_features") -> Column:
    """A token array as doubles."""
    return number(F.col(tokens)[name])


def _bound(spec: Spec, name: str) -> Column:
    value = spec.get(name)
    return value if isinstance(value, Column) else F.lit(value).cast("double")


def raw_score(method: str, tokens: str = "token_features") -> Column:
    """Score without clipping; an unknown method is a KeyError.

    Null, NaN and infinite tokens are left out; a document without finite
    tokens has a null score.
    """
    nll = negate(feature("logp_a", tokens))
    if method in SINGLE:
        return mean(feature(SINGLE[method], tokens))
    if method == "entropy_gap":
        return mean(minus(nll, feature("entropy_a", tokens)))
    if method == "lrr":
        return mean(nll) / (mean(feature("logrank_a", tokens)) + EPS)
    if method == "binoculars":
        return mean(nll) / (mean(feature("cross_entropy_ba", tokens)) + EPS)
    if method == "likelihood_ratio":
        return mean(minus(feature("logp_a", tokens), feature("logp_b", tokens)))
    raise KeyError(method)


def clipped_score(method: str, direction: Column, spec: Spec, tokens: str = "token_features") -> Column:
    """Oriented score whose tokens are clipped on one side; null bounds clip nothing.

    Single features are clipped after they are multiplied by the direction.
    """
    nll = negate(feature("logp_a", tokens))
    upper = _bound(spec, "nll_upper")
    if method in SINGLE:
        oriented = F.transform(feature(SINGLE[method], tokens), lambda x: x * direction)
        return mean(at_least(oriented, _bound(spec, "lower")))
    if method == "entropy_gap":
        return direction * mean(minus(at_most(nll, upper), feature("entropy_a", tokens)))
    if method == "lrr":
        ranks = at_most(feature("logrank_a", tokens), _bound(spec, "logrank_upper"))
        return direction * mean(at_most(nll, upper)) / (mean(ranks) + EPS)
    if method == "binoculars":
        return direction * mean(at_most(nll, upper)) / (mean(feature("cross_entropy_ba", tokens)) + EPS)
    raise KeyError(method)


def raw_scores(rows: DataFrame, methods: tuple[str, ...] = METHODS, tokens: str = "token_features") -> DataFrame:
    """The rows with one column for each method, rounded for comparisons."""
    return rows.withColumns({m: settled(raw_score(m, tokens)) for m in methods})


def long_scores(scored: DataFrame, keep: tuple[str, ...], methods: tuple[str, ...] = METHODS) -> DataFrame:
    """(*keep, method, score): methods as rows; null and NaN scores are left out."""
    pairs = F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in methods))
    return scored.select(*keep, F.inline(pairs)).filter(F.col("score").isNotNull() & ~F.isnan("score"))


def available_methods(rows: DataFrame) -> tuple[str, ...]:
    """Binoculars takes part only if the reference model's feature is there."""
    has = rows.filter(F.col("token_features.cross_entropy_ba").isNotNull()).limit(1).count() > 0
    return METHODS if has else tuple(m for m in METHODS if m != "binoculars")
