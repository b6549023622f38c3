"""Tuning of clipping bounds on one half of the samples and evaluation on the other.

Methods, candidates, modes and ratios are rows of one plan; only what the
configuration bounds (directions, bounds of candidates, chosen candidates)
passes through the driver.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.operators.grid import grid_scores
from scoreloom.operators.metrics import orientation, tpr_at_fpr
from scoreloom.operators.quantiles import quantiles
from scoreloom.operators.samples import is_clean, tuning_ratio
from scoreloom.operators.scores import METHODS, SINGLE, feature
from scoreloom.runtime import Scratch

LOWER = (0.001, 0.005, 0.01, 0.025, 0.05, 0.10, 0.15)
UPPER = (0.85, 0.90, 0.95, 0.975, 0.99, 0.995, 0.999)
#: Weights of the objective: contaminated at 5 %, at 1 %, clean at 5 %.
WEIGHTS = (0.50, 0.35, 0.15)


def pooled_quantiles(rows: DataFrame, directions: dict[str, int]) -> dict[tuple[str, float], float]:
    """Quantiles of the pooled tokens of all rows: of each oriented single feature, of nll and of logrank."""
    values = {m: (feature(f), directions.get(m, 1), LOWER) for m, f in SINGLE.items()}
    values |= {"nll": (feature("logp_a"), -1, UPPER), "logrank": (feature("logrank_a"), 1, UPPER)}

    def tag(name: str, direction: int, array: Column) -> Column:
        return F.transform(array, lambda x: F.struct(F.lit(name).alias("name"), (x * direction).alias("x")))

    tagged = [tag(n, d, a) for n, (a, d, _) in values.items()]
    tagged = [F.coalesce(t, F.array().cast("array<struct<name:string,x:double>>")) for t in tagged]
    long = rows.select(F.inline(F.concat(*tagged)))
    found = quantiles(long, ["name"], "x", sorted({*LOWER, *UPPER}), decimals=9).collect()
    return {(r.name, q): r.quantile for r in found for q in values[r.name][2] if abs(q - r.q) < 1e-9}


def candidates(method: str, pooled: dict[tuple[str, float], float]) -> list[dict[str, float]]:
    """Bounds to try; the first is none."""
    out: list[dict[str, float]] = [{}]
    if method in SINGLE:
        out += [{"lower": pooled[method, q]} for q in LOWER if (method, q) in pooled]
    elif method == "lrr":
        out += [{"nll_upper": pooled["nll", a], "logrank_upper": pooled["logrank", b]} for a in UPPER for b in UPPER if ("nll", a) in pooled]
    else:
        out += [{"nll_upper": pooled["nll", q]} for q in UPPER if ("nll", q) in pooled]
    return out


def _of_source(method: str) -> str:
    return "binoculars" if method == "binoculars" else "primary"


def _scores(rows: DataFrame, keep: Sequence[str], specs: dict[str, list[dict[str, float]]], directions: dict[str, int]) -> DataFrame:
    """(*keep, method, cand, score) of every document and candidate; each method sees the rows of its source."""
    parts = []
    for source in ("primary", "binoculars"):
        own = [m for m in specs if _of_source(m) == source]
        if own:
            own_specs = {m: specs[m] for m in own}
            parts.append(grid_scores(rows.filter(F.col("score_source") == source), keep, own_specs, directions))
    return reduce(DataFrame.unionByName, parts)


def directions_of(rows: DataFrame, methods: Sequence[str]) -> dict[str, int]:
    """Direction of each method from the clean rows of its source; +1 where a side is missing."""
    long = _scores(rows, ("label", "contamination_mode"), {m: [{}] for m in methods}, {m: 1 for m in methods})
    return {m: 1 for m in methods} | {r.method: r.direction if r.mean_human is not None and r.mean_llm is not None else 1 for r in orientation(long, ["method"], is_clean("human"), is_clean("llm")).collect()}


def objective(scores: DataFrame, ratios: dict[str, float]) -> DataFrame:
    """(method, mode, cand, objective, n_contaminated) of each candidate, on tuning rows."""
    human = scores.filter(is_clean("human"))
    modes = F.array(*(F.lit(m) for m in ratios))
    clean = scores.filter(is_clean("llm")).select("method", "cand", "score", F.explode(modes).alias("mode"), F.lit("clean").alias("kind"))
    wanted = reduce(lambda a, b: a | b, ((F.col("contamination_mode") == m) & (F.abs(F.col("ratio") - r) < 1e-12) for m, r in ratios.items()))
    dirty = scores.filter(wanted).select("method", "cand", "score", F.col("contamination_mode").alias("mode"), F.lit("contaminated").alias("kind"))
    rates = tpr_at_fpr(human, clean.unionByName(dirty), ["method", "cand"], [0.05, 0.01], ["mode", "kind"])

    def rate(kind: str, fpr: float) -> Column:
        return F.max(F.when((F.col("kind") == kind) & (F.col("fpr") == fpr), F.col("tpr")))

    parts = (rate("contaminated", 0.05), rate("contaminated", 0.01), rate("clean", 0.05))
    value = F.round(sum((F.coalesce(p, F.lit(0.0)) * w for p, w in zip(parts, WEIGHTS)), F.lit(0.0)), 9)
    count = F.coalesce(F.max(F.when(F.col("kind") == "contaminated", F.col("n_llm"))), F.lit(0))
    return rates.groupBy("method", "mode", "cand").agg(value.alias("objective"), count.alias("n_contaminated"))


def best(values: DataFrame) -> DataFrame:
    """(method, mode, cand, objective): the best candidate, the first of equals; none without contaminated rows."""
    pick = F.max_by(F.struct("cand", "objective"), F.struct("objective", -F.col("cand")))
    return values.filter("n_contaminated > 0").groupBy("method", "mode").agg(pick.alias("_b")).select("method", "mode", "_b.cand", "_b.objective")


def spec_text(spec: dict[str, float]) -> str:
    return json.dumps(spec)


def tune(rows: DataFrame, methods: Sequence[str] = METHODS, scratch: Scratch | None = None) -> tuple[dict[str, int], dict[str, list[dict[str, float]]], DataFrame]:
    """(directions, candidates, values of all candidates) from the tuning rows.

    ``rows`` need label, contamination_mode, ratio, score_source and token_features.
    """
    directions = directions_of(rows, methods)
    clean = rows.filter(is_clean("human") | is_clean("llm"))
    specs: dict[str, list[dict[str, float]]] = {}
    for source in ("primary", "binoculars"):
        own = [m for m in methods if _of_source(m) == source]
        if own:
            pooled = pooled_quantiles(clean.filter(F.col("score_source") == source), directions)
            specs |= {m: candidates(m, pooled) for m in own}
    ratios = {r.contamination_mode: r.tuning_ratio for r in tuning_ratio(rows).orderBy("contamination_mode").collect()} or {"random": 0.0, "tail": 0.0}
    scores = _scores(rows, ("label", "contamination_mode", "ratio"), specs, directions)
    if scratch is not None:
        scores = scratch.save(scores)
    return directions, specs, objective(scores, ratios)


def evaluate(rows: DataFrame, split: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """(mode, method, ratio, direction, score_source, clip_spec, four rates, n_test_human, n_test_llm).

    Rows whose sample is in no half drop out, as do null scores.  Thresholds
    come from clean human test rows.  An empty table gives no rows.
    """
    scratch = Scratch(rows.sparkSession, "evaluate")
    parted = scratch.save(
        rows.join(split, "sample_id").select("split", "label", "contamination_mode", "ratio", "score_source", "token_features")
    )
    directions, specs, values = tune(parted.filter("split = 'tune'"), methods, scratch)
    chosen = {(r.mode, r.method): specs[r.method][r.cand] for r in best(values).collect()}
    modes = sorted({r.contamination_mode for r in parted.filter("contamination_mode <> 'none'").select("contamination_mode").distinct().collect()})
    # Candidate 0 is the raw score, candidate 1 + i the chosen one of mode i.
    tried = {m: [{}, *(chosen.get((mode, m), {}) for mode in modes)] for m in methods}
    test = scratch.save(_scores(parted.filter("split = 'test'"), ("label", "contamination_mode", "ratio"), tried, directions))
    human = test.filter(is_clean("human"))
    number = F.element_at(F.create_map(*(F.lit(x) for i, m in enumerate(modes) for x in (m, i + 1))), F.col("contamination_mode")) if modes else F.lit(0)
    dirty = test.filter("contamination_mode <> 'none'").withColumn("_own", number).filter("cand = 0 or cand = _own")
    rates = tpr_at_fpr(human, dirty, ["method", "cand"], [0.01, 0.05], ["contamination_mode", "ratio"])

    def rate(raw: bool, fpr: float) -> Column:
        return F.max(F.when(((F.col("cand") == 0) == F.lit(raw)) & (F.col("fpr") == fpr), F.col("tpr")))

    out = rates.groupBy(F.col("contamination_mode").alias("mode"), "method", "ratio").agg(
        rate(True, 0.01).alias("raw_tpr_at_1_fpr"), rate(False, 0.01).alias("clipped_tpr_at_1_fpr"),
        rate(True, 0.05).alias("raw_tpr_at_5_fpr"), rate(False, 0.05).alias("clipped_tpr_at_5_fpr"),
        F.max(F.when(F.col("cand") == 0, F.col("n_human"))).alias("n_test_human"), F.max(F.when(F.col("cand") == 0, F.col("n_llm"))).alias("n_test_llm"),
    )
    facts = [(mode, m, directions[m], _of_source(m), spec_text(chosen.get((mode, m), {}))) for mode in modes for m in methods]
    if not facts:
        facts = [("", "", 0, "", "")]
    named = rows.sparkSession.createDataFrame(facts, "mode string, method string, direction int, score_source string, clip_spec string")
    return out.join(F.broadcast(named), ["mode", "method"]).select(
        "mode", "method", "ratio", "direction", "score_source", "clip_spec", "raw_tpr_at_1_fpr", "clipped_tpr_at_1_fpr",
        "raw_tpr_at_5_fpr", "clipped_tpr_at_5_fpr", "n_test_human", "n_test_llm",
    )
