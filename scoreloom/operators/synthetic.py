"""Heavy-tailed token matrices, their contamination, and Monte-Carlo curves with the trial as a column."""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.arrays import EPS
from scoreloom.operators.scores import MATRIX_METHODS

ARRAYS = ("logp_a", "logp_b", "logrank_a", "xent_ab", "entropy_a")
# Base, tail index and scale of each feature, by source.
TAILS = {
    "llm": {"nll_a": (1.55, 3.8, 0.55), "nll_b": (1.95, 3.4, 0.55), "logrank_a": (0.85, 3.7, 0.55), "xent_ab": (2.05, 3.8, 0.35)},
    "human": {"nll_a": (2.10, 2.2, 0.70), "nll_b": (1.75, 2.6, 0.60), "logrank_a": (1.35, 2.2, 0.75), "xent_ab": (2.12, 2.7, 0.40)},
}
N_TOKENS, MIN_TOKENS, MAX_TOKENS = 80, 25, 80
# Candidates of the synthetic grid, quantiles of pooled tokens.
LOW = (0.001, 0.005, 0.01, 0.025, 0.05, 0.10, 0.15)
HIGH = (0.85, 0.90, 0.95, 0.975, 0.99, 0.995, 0.999)
# Axes of the curves, shares of human tokens and false-positive rates.
SHARES = (0.0, 0.02, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50)
FPRS = (1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05, 0.03, 0.02, 0.01, 0.005, 0.003, 0.001)
# Weights of the objective, TPR at 5 %, AUROC contaminated, AUROC clean.
WEIGHTS = (0.60, 0.25, 0.15)


# Spread of the style noise of a document and of its parts, what of it the second model sees, and base, tail index, scale and weights of the entropy.
STYLE, STYLE_RANK, STYLE_XENT, STYLE_B, SHARED = 0.35, 0.35, 0.25, 0.20, 0.65
ENTROPY_BASE, ENTROPY_TAIL, ENTROPY_SCALE, ENTROPY_NOISE, ENTROPY_STYLE = 1.70, 3.4, 0.55, 0.5, 0.1

#: Moduli, multipliers and masks of the draws, used in turn: congruences after an exclusive or, which any engine can compute; two more keys stir the last one in.
MODULI, FACTORS, MASKS, STIR = (2147483647, 2147483629, 2147483587), (1103515245, 1812433253, 1566083941), (0x2545F491, 0x5BD1E995, 0x1B873593), (362436, 521288)
#: Numbers of the named draws.
DRAWS = {x: i + 1 for i, x in enumerate(("human", "llm", "style", "rank", "xent", "b", "length", "nll_a", "nll_b", "logrank_a", "xent_ab", "entropy", "noise", "mix"))}


def state(*keys: Column | int | str) -> Column:
    """A number below 2^31 that depends on the keys only, whole numbers from 0 on or names of draws; it may be a key again."""
    out = F.lit(88172645).cast("bigint")
    for i, k in enumerate(keys):
        own = k if isinstance(k, Column) else F.lit(DRAWS[k] if isinstance(k, str) else k)
        out = F.pmod((out + own.cast("bigint")).bitwiseXOR(F.lit(MASKS[i % 3]).cast("bigint")) * F.lit(FACTORS[i % 3]), F.lit(MODULI[i % 3]))
    return out


def uniform(*keys: Column | int | str) -> Column:
    """Uniform in (0, 1) by the keys: the same on any number of partitions and in any engine."""
    return (state(*keys, *STIR) + 0.5) / float(max(MODULI))


def normal(*keys: Column | int | str) -> Column:
    return F.sqrt(-2 * F.log(uniform(*keys, 1))) * F.cos(2 * math.pi * uniform(*keys, 2))


def power_law(alpha: float, scale: float, *keys: Column | int | str) -> Column:
    """Lomax noise: scale * ((1 - u)^(-1/alpha) - 1)."""
    return scale * (F.pow(1 - uniform(*keys), F.lit(-1 / alpha)) - 1)


def sample_tokens(spark: SparkSession, source: str, trials: int, n_docs: int, n_tokens: int = N_TOKENS, seed: int = 7, lengths: tuple[int, int] | None = (MIN_TOKENS, MAX_TOKENS)) -> DataFrame:
    """(trial, doc, length, five arrays) of ``n_docs`` documents in each trial.

    An unknown source is a ValueError.  Style noise is drawn for documents and
    shared by their tokens.  Arrays keep all tokens; ``length`` tells how many
    are active.
    """
    return _drawn(_trial_docs(spark, trials, n_docs), source, F.lit(seed), n_tokens, lengths)


def _trial_docs(spark: SparkSession, trials: int, n_docs: int) -> DataFrame:
    return spark.range(trials * n_docs).select((F.col("id") % trials).alias("trial"), F.floor(F.col("id") / trials).alias("doc"))


def _drawn(base: DataFrame, source: str, seed: Column, n_tokens: int = N_TOKENS, lengths: tuple[int, int] | None = (MIN_TOKENS, MAX_TOKENS)) -> DataFrame:
    """(*base, length, five arrays): a document for each row, drawn from its trial and doc."""
    if source not in TAILS:
        raise ValueError(f"unknown source: {source}")
    kept = base.columns
    who = "_w"
    base = base.withColumn(who, state(seed, source, F.col("trial"), F.col("doc")))
    w = F.col(who)
    base = base.withColumns({"_s": STYLE * normal(w, "style"), "_r": STYLE_RANK * normal(w, "rank"), "_x": STYLE_XENT * normal(w, "xent"), "_b": STYLE_B * normal(w, "b")})

    def draw(name: str, i: Column) -> Column:
        start, alpha, scale = TAILS[source][name]
        return start + power_law(alpha, scale, w, i, name)

    def over(fn) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n_tokens - 1)), fn)

    if lengths:
        low, high = lengths
        length = (F.floor(uniform(w, "length") * (high - low + 1)) + low).cast("int")
    else:
        length = F.lit(n_tokens)
    return base.select(
        *kept, length.alias("length"),
        over(lambda i: F.least(-(draw("nll_a", i) + F.col("_s")), F.lit(-EPS))).alias("logp_a"),
        over(lambda i: F.least(-(draw("nll_b", i) + SHARED * F.col("_s") + F.col("_b")), F.lit(-EPS))).alias("logp_b"),
        over(lambda i: F.greatest(draw("logrank_a", i) + F.col("_r"), F.lit(EPS))).alias("logrank_a"),
        over(lambda i: F.greatest(draw("xent_ab", i) + F.col("_x"), F.lit(EPS))).alias("xent_ab"),
        over(
            lambda i: F.greatest(ENTROPY_BASE + 0.5 * power_law(ENTROPY_TAIL, ENTROPY_SCALE, w, i, "entropy") + ENTROPY_STYLE * F.col("_s") + ENTROPY_NOISE * normal(w, i, "noise"), F.lit(EPS))
        ).alias("entropy_a"),
    )


def matrix_scores(batch: DataFrame, specs: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """(trial, doc, one column for each matrix method) of documents as ``sample_tokens`` gives them, clipped by the bounds of ``specs``.

    Means divide by the length plus a tiny number; ``lrr_both`` is a ratio of
    sums, not of means.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                docs = Docs(part.to_pandas())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(docs.score(m, (specs or {}).get(m, {}))) for m in MATRIX_METHODS)], names=["trial", "doc", *MATRIX_METHODS])

    return batch.select("trial", "doc", "length", *ARRAYS).mapInArrow(run, "trial bigint, doc bigint, " + ", ".join(f"{m} double" for m in MATRIX_METHODS))


def active(batch: DataFrame) -> DataFrame:
    """Arrays cut to their active length."""
    return batch.withColumns({a: F.slice(F.col(a), F.lit(1), F.col("length")) for a in ARRAYS})


def contaminate(llm: DataFrame, human: DataFrame, share: Column, mode: str, seed: int = 0) -> DataFrame:
    """Replaces tokens of machine documents by those of the human document at the same place.

    ``random``: each active token with the chance ``share``.  ``tail``: the
    round(length * share) active places where the human token does most harm
    (nll + logrank + what b likes better than a); of equal harm the first.  The
    human document's own length doesn't matter.
    """
    if mode not in ("random", "tail"):
        raise ValueError(f"unknown contamination mode: {mode}")
    pair = llm.join(human.select("trial", "doc", *(F.col(a).alias(f"_{a}") for a in ARRAYS)), ["trial", "doc"])
    return _contaminated(pair, share, mode, seed).select(*llm.columns)


def _contaminated(pair: DataFrame, share: Column, mode: str, seed: int) -> DataFrame:
    """``contaminate`` of rows that hold the human arrays, too, with an underscore before their names."""
    pair = pair.withColumn("_share", share)
    places = F.sequence(F.lit(0), F.col("length") - 1)
    if mode == "random":
        hit = F.transform(places, lambda i: uniform(seed, "mix", F.col("trial"), F.col("doc"), i) < F.col("_share"))
    else:
        k = F.bround(F.col("length") * F.col("_share")).cast("int")
        harm = F.transform(places, lambda i: F.struct((F.get("_logp_a", i) - F.get("_logrank_a", i) - F.greatest(F.get("_logp_b", i) - F.get("_logp_a", i), F.lit(0.0))).alias("h"), i.alias("i")))
        top = F.transform(F.slice(F.array_sort(harm), F.lit(1), F.greatest(k, F.lit(0))), lambda x: x["i"])
        # Bound as the only element of an array, else the optimizer sorts again for each place.
        hit = F.get(F.transform(F.array(top), lambda t: F.transform(places, lambda i: F.array_contains(t, i))), F.lit(0))
    pair = pair.withColumn("_hit", hit)
    return pair.withColumns({a: _mixed(a) for a in ARRAYS})


def contaminated_batch(spark: SparkSession, share: float, mode: str, trials: int, n_docs: int, seeds: tuple[int, int] = (0, 1)) -> DataFrame:
    """``contaminate`` of machine and human documents as ``sample_tokens`` draws them, both in one row from the start, so without a join."""
    both = _drawn(_trial_docs(spark, trials, n_docs), "human", F.lit(seeds[1])).select("trial", "doc", *(F.col(a).alias(f"_{a}") for a in ARRAYS))
    pair = _drawn(both, "llm", F.lit(seeds[0]))
    return _contaminated(pair, F.lit(share), mode, 0).select("trial", "doc", "length", *ARRAYS)


def _mixed(name: str) -> Column:
    return F.transform(F.col(name), lambda x, i: F.when(F.coalesce(F.get("_hit", i), F.lit(False)), F.get(f"_{name}", i)).otherwise(x))


def _bounds_of(values: dict[str, np.ndarray]) -> dict[str, list[dict[str, float]]]:
    low = lambda x: [None, *np.quantile(x, LOW)]
    high = lambda x: [None, *np.quantile(x, HIGH)]
    p, r = low(values["logp_a"]), high(values["logrank_a"])
    return {
        "log_likelihood": [{"logp_lower": b} for b in p], "log_rank": [{"logrank_upper": b} for b in r],
        "lrr_both": [{"logp_lower": a, "logrank_upper": b} for a in p for b in r],
        "likelihood_ratio": [{"lrt_lower": b} for b in low(values["logp_a"] - values["logp_b"])],
        "binoculars": [{"nll_upper": b} for b in high(-values["logp_a"])], "entropy_gap": [{"nll_upper": b} for b in high(-values["logp_a"])],
    }


class Docs:
    """Scores of the documents of one trial, from flat active tokens."""

    def __init__(self, rows: pd.DataFrame):
        self.n = rows["length"].to_numpy(dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.n)[:-1]])
        self.v = {a: np.concatenate([np.asarray(x)[:k] for x, k in zip(rows[a], self.n)]) for a in ARRAYS}

    def mixed(self, other: Docs, hit: np.ndarray) -> Docs:
        """These documents with the other ones' tokens where ``hit``."""
        out = copy.copy(self)
        out.v = {a: np.where(hit, other.v[a], self.v[a]) for a in ARRAYS}
        return out

    def total(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.at)

    def score(self, method: str, spec: dict[str, float]) -> np.ndarray:
        v, n = self.v, self.n + EPS
        low = lambda x, b: x if b is None else np.maximum(x, b)
        high = lambda x, b: x if b is None else np.minimum(x, b)
        if method == "log_likelihood":
            return self.total(low(v["logp_a"], spec.get("logp_lower"))) / n
        if method == "log_rank":
            return self.total(high(v["logrank_a"], spec.get("logrank_upper"))) / n
        if method == "lrr_both":
            return -self.total(low(v["logp_a"], spec.get("logp_lower"))) / (self.total(high(v["logrank_a"], spec.get("logrank_upper"))) + EPS)
        if method == "likelihood_ratio":
            return self.total(low(v["logp_a"] - v["logp_b"], spec.get("lrt_lower"))) / n
        nll = high(-v["logp_a"], spec.get("nll_upper"))
        if method == "binoculars":
            return (self.total(nll) / n) / (self.total(v["xent_ab"]) / n + EPS)
        return self.total(nll - v["entropy_a"]) / n


def _rank_auroc(h: np.ndarray, m: np.ndarray) -> float:
    h = np.sort(h)
    return float((np.searchsorted(h, m, "left") + np.searchsorted(h, m, "right")).mean() / 2 / len(h))


def _worth(h: np.ndarray, clean: np.ndarray, dirty: np.ndarray) -> float:
    """Objective of one candidate, oriented by its own clean scores."""
    d = 1 if clean.mean() >= h.mean() else -1
    h, clean, dirty = d * h, d * clean, d * dirty
    tpr = float((dirty >= np.quantile(h, 0.95)).mean())
    return WEIGHTS[0] * tpr + WEIGHTS[1] * _rank_auroc(h, dirty) + WEIGHTS[2] * _rank_auroc(h, clean)


def tuned_bounds(human: Docs, llm: Docs, mixed: Docs) -> dict[str, dict[str, float]]:
    """The best of the 104 candidates for each method, the first of equals."""
    out = {}
    for method, specs in _bounds_of({a: np.concatenate([human.v[a], llm.v[a]]) for a in ARRAYS}).items():
        worth = [_worth(*(d.score(method, s) for d in (human, llm, mixed))) for s in specs]
        out[method] = {k: float(b) for k, b in specs[int(np.argmax(np.round(worth, 12)))].items() if b is not None}
    return out


def _hits(llm: Docs, other: Docs, mode: str, mix: np.ndarray) -> Callable[[float], np.ndarray]:
    """From a share to the tokens that ``contaminate`` replaces; ``mix`` are the chances of the random mode."""
    if mode == "random":
        return lambda share: mix < share
    doc = np.repeat(np.arange(len(llm.n)), llm.n)
    a, b = other.v["logp_a"], other.v["logp_b"]
    order = np.lexsort((a - other.v["logrank_a"] - np.maximum(b - a, 0.0), doc))
    place = np.empty(len(doc), dtype=np.int64)
    place[order] = np.arange(len(doc)) - llm.at[doc]
    return lambda share: place < np.rint(llm.n * share)[doc]


def _trial_documents(spark: SparkSession, trials: int, n_tune: int, n_test: int, seed: int) -> DataFrame:
    """(trial, doc, test, mix, human, llm, other): a trial in each partition, so that nothing is shuffled."""
    n = n_tune + n_test
    docs = spark.range(0, trials * n, 1, trials).select(F.floor(F.col("id") / n).alias("trial"), (F.col("id") % n).alias("_k"))
    docs = docs.select("trial", F.when(F.col("_k") < n_tune, F.col("_k")).otherwise(F.col("_k") - n_tune).alias("doc"), (F.col("_k") >= n_tune).alias("test"))
    of = lambda tune, test: F.when(F.col("test"), F.lit(test)).otherwise(F.lit(tune))
    places = F.sequence(F.lit(0), F.lit(N_TOKENS - 1))
    docs = docs.withColumn("mix", F.transform(places, lambda i: uniform(of(seed, seed + 1), "mix", F.col("trial"), F.col("doc"), i)))
    for i, (name, source) in enumerate((("human", "human"), ("llm", "llm"), ("other", "human"))):
        kept = docs.columns
        docs = _drawn(docs, source, of(seed + i, seed + 10 + i)).select(*kept, F.struct("length", *ARRAYS).alias(name))
    return docs


def _rates(human: Docs, llm: Docs, mixed: dict[float, Docs], method: str, spec: dict[str, float], fpr: Sequence[float]) -> Iterator[tuple[float, float, float, float]]:
    """(share, fpr, tpr, auroc) of one method, oriented by the clean scores."""
    h = human.score(method, spec)
    d = 1 if llm.score(method, spec).mean() >= h.mean() else -1
    h = np.round(d * h, 9)
    limits = np.round(np.quantile(h, [1.0 - f for f in fpr]), 9)
    for share, docs in mixed.items():
        m = np.round(d * docs.score(method, spec), 9)
        area = round(_rank_auroc(h, m), 9)
        for f, limit in zip(fpr, limits):
            yield share, f, float((m >= limit).mean()), area


_CURVES = "mode string, trial bigint, method string, clipped boolean, share double, fpr double, tpr double, auroc double"


def trial_rates(spark: SparkSession, modes: Sequence[str], trials: int, n_tune: int, n_test: int, shares: Sequence[float], fpr: Sequence[float], tuned_at: float, seed: int) -> DataFrame:
    """(mode, trial, method, clipped, share, fpr, tpr, auroc) of every trial, each tuned and tested on its own documents.

    A trial is a bounded matrix, so each is drawn, tuned and tested in one
    task; all modes and shares mix the same documents.
    """
    for mode in modes:
        if mode not in ("random", "tail"):
            raise ValueError(f"unknown contamination mode: {mode}")
    names = [c.split()[0] for c in _CURVES.split(", ")]

    def sets(rows: pa.Table) -> tuple[Docs, Docs, Docs, np.ndarray]:
        frames = {k: pd.DataFrame({c: rows[k].combine_chunks().field(c).to_pandas() for c in ("length", *ARRAYS)}) for k in ("human", "llm", "other")}
        n = frames["llm"]["length"]
        mix = np.concatenate([np.asarray(x)[:k] for x, k in zip(rows["mix"].to_pandas(), n)])
        return Docs(frames["human"]), Docs(frames["llm"]), Docs(frames["other"].assign(length=n)), mix

    def curves(rows: pa.Table, trial: int) -> Iterator[tuple]:
        human, llm, other, mix = sets(rows.filter(pc.invert(rows["test"])))
        human_t, llm_t, other_t, mix_t = sets(rows.filter(rows["test"]))
        if (len(human.n), len(human_t.n)) != (n_tune, n_test):
            raise RuntimeError(f"trial {trial} is not whole")
        for mode in modes:
            bounds = tuned_bounds(human, llm, llm.mixed(other, _hits(llm, other, mode, mix)(tuned_at)))
            hits = _hits(llm_t, other_t, mode, mix_t)
            mixed = {float(s): llm_t.mixed(other_t, hits(s)) for s in shares}
            for method in MATRIX_METHODS:
                for clipped, spec in ((False, {}), (True, bounds[method])):
                    yield from ((mode, trial, method, clipped, *x) for x in _rates(human_t, llm_t, mixed, method, spec, fpr))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if not sum(map(len, found)):
            return
        rows = pa.Table.from_batches(found)
        for trial in pc.unique(rows["trial"]).to_pylist():
            own = rows.filter(pc.equal(rows["trial"], trial))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(list(curves(own, trial)), columns=names), preserve_index=False)

    return _trial_documents(spark, trials, n_tune, n_test, seed).mapInArrow(run, _CURVES)


def curves_by_mode(
    spark: SparkSession, modes: Sequence[str] = ("random", "tail"), trials: int = 100, n_tune: int = 1000, n_test: int = 2000, shares: Sequence[float] = SHARES, fpr: Sequence[float] = FPRS, tuned_at: float = 0.25, seed: int = 11,
) -> DataFrame:
    """(method, clipped, share, fpr, tpr, auroc, mode): means over the trials, each tuned and tested on its own documents."""
    each = trial_rates(spark, modes, trials, n_tune, n_test, shares, fpr, tuned_at, seed)
    means = each.groupBy("method", "clipped", "share", "fpr", "mode").agg(F.round(F.avg("tpr"), 6).alias("tpr"), F.round(F.avg("auroc"), 6).alias("auroc"))
    return means.select("method", "clipped", "share", "fpr", "tpr", "auroc", "mode")


def trial_curves(spark: SparkSession, mode: str, trials: int = 100, n_tune: int = 1000, n_test: int = 2000, shares: Sequence[float] = SHARES, fpr: Sequence[float] = FPRS, tuned_at: float = 0.25, seed: int = 11) -> DataFrame:
    """``curves_by_mode`` of one mode, without the mode."""
    return curves_by_mode(spark, (mode,), trials, n_tune, n_test, shares, fpr, tuned_at, seed).drop("mode")
