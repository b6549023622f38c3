"""Scores of every document under every candidate's bounds, in Arrow batches.

Array expressions are interpreted element by element, which a grid of fifty
candidates multiplies; here each clipped mean is one pass over the batch's
tokens, and candidates that share a mean share its computation.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.arrays import DECIMALS, EPS
from scoreloom.operators.scores import SINGLE

FEATURES = ("logp_a", "rank_a", "logrank_a", "entropy_a", "logp_b", "cross_entropy_ba")
#: Features of the methods that take two.
TWO = {"entropy_gap": ("logp_a", "entropy_a"), "lrr": ("logp_a", "logrank_a"), "binoculars": ("logp_a", "cross_entropy_ba"), "likelihood_ratio": ("logp_a", "logp_b")}


class Tokens:
    """The token arrays of a batch, flat, with the number of tokens of each document."""

    def __init__(self, columns: Mapping[str, pa.Array]):
        self.flat, self.ends = {}, {}
        for name, lists in columns.items():
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            self.flat[name] = pc.cast(lists.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
            self.ends[name] = np.concatenate([[0], np.cumsum(size)])
        self.known: dict[tuple, np.ndarray] = {}

    def _mean(self, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        good = np.isfinite(values)
        n = np.diff(np.concatenate([[0], np.cumsum(good)])[ends])
        # Sums run within a document only, so large values elsewhere cost no digits.
        filled = np.append(np.where(good, values, 0.0), 0.0)
        total = np.where(np.diff(ends) > 0, np.add.reduceat(filled, np.minimum(ends[:-1], len(filled) - 1)), 0.0)
        return np.where(n > 0, total / np.maximum(n, 1), np.nan)

    def mean(self, kind: str, direction: int = 1, lower: float | None = None, upper: float | None = None) -> np.ndarray:
        """Mean of ``direction`` times a feature, or of nll or nll minus entropy, clipped; finite tokens only."""
        key = (kind, direction, lower, upper)
        if key not in self.known:
            name = {"nll": "logp_a", "gap": "logp_a", "ratio": "logp_a"}.get(kind, kind)
            values, ends = self.flat[name] * (-1 if kind in ("nll", "gap") else direction), self.ends[name]
            if lower is not None:
                values = np.where(np.isfinite(values), np.maximum(values, lower), values)
            if upper is not None:
                values = np.where(np.isfinite(values), np.minimum(values, upper), values)
            if kind in ("gap", "ratio"):
                less = "entropy_a" if kind == "gap" else "logp_b"
                own, other = np.diff(ends), np.diff(self.ends[less])
                both = np.minimum(own, other)
                place = np.arange(int(both.sum())) - np.repeat(np.cumsum(both) - both, both)
                values = values[np.repeat(ends[:-1], both) + place] - self.flat[less][np.repeat(self.ends[less][:-1], both) + place]
                ends = np.concatenate([[0], np.cumsum(both)])
            self.known[key] = self._mean(values, ends)
        return self.known[key]

    def score(self, method: str, direction: int, spec: Mapping[str, float]) -> np.ndarray:
        upper = spec.get("nll_upper")
        if method in SINGLE:
            return self.mean(SINGLE[method], direction, lower=spec.get("lower"))
        if method == "entropy_gap":
            return direction * self.mean("gap", upper=upper)
        if method == "lrr":
            return direction * self.mean("nll", upper=upper) / (self.mean("logrank_a", upper=spec.get("logrank_upper")) + EPS)
        if method == "binoculars":
            return direction * self.mean("nll", upper=upper) / (self.mean("cross_entropy_ba") + EPS)
        if method == "likelihood_ratio":
            return direction * self.mean("ratio")
        raise KeyError(method)


def _features(methods: Iterable[str]) -> list[str]:
    """The features that the methods need; an unknown method is a KeyError."""
    need: set[str] = set()
    for m in methods:
        need |= {SINGLE[m]} if m in SINGLE else set(TWO[m])
    return [f for f in FEATURES if f in need]


def wide_scores(rows: DataFrame, keep: Sequence[str], specs: Mapping[str, tuple[str, int, Mapping[str, float]]]) -> DataFrame:
    """(*keep, one column for each name of ``specs``): scores by method, direction and bounds; null without finite tokens."""
    names = _features(m for m, _, _ in specs.values())
    small = rows.select(*(F.col(k) for k in keep), *(F.col("token_features")[f].alias(f"_{f}") for f in names))
    types, width = dict(small.dtypes), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                tokens = Tokens({f: batch.column(width + i) for i, f in enumerate(names)})
                found = [tokens.score(m, d, s) for m, d, s in specs.values()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *(pa.array(x, mask=np.isnan(x)) for x in found)], names=[*keep, *specs])

    return small.mapInArrow(run, ", ".join([*(f"{k} {types[k]}" for k in keep), *(f"{n} double" for n in specs)]))


def grid_scores(rows: DataFrame, keep: Sequence[str], specs: Mapping[str, Sequence[Mapping[str, float]]], directions: Mapping[str, int]) -> DataFrame:
    """(*keep, method, cand, score) of every document and candidate; null scores are left out.

    ``score`` is rounded for comparisons.  Only the features that the methods
    need are read.
    """
    names = _features(specs)
    small = rows.select(*(F.col(k) for k in keep), *(F.col("token_features")[f].alias(f"_{f}") for f in names))
    types = dict(small.dtypes)
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = Tokens({f: batch.column(width + i) for i, f in enumerate(names)})
            for method, tries in specs.items():
                table = np.round(np.stack([tokens.score(method, directions[method], s) for s in tries]), DECIMALS)
                cand, doc = np.nonzero(np.isfinite(table))
                if len(doc):
                    take = pa.array(doc)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(i).take(take) for i in range(width)), pa.array([method] * len(doc)), pa.array(cand, pa.int32()), pa.array(table[cand, doc])],
                        names=[*keep, "method", "cand", "score"],
                    )

    schema = ", ".join([*(f"{k} {types[k]}" for k in keep), "method string", "cand int", "score double"])
    return small.mapInArrow(run, schema)
