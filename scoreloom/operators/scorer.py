"""Scoring with language models, one load per worker, behind an interface that any model can fill."""

from __future__ import annotations

import importlib
import math
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.text import sentences

PROBES = ("Hello world.", "The quick brown fox", "a b c")


class Model(Protocol):
    """A causal model: token ids of a text, and logits (positions x vocabulary) for each next token."""

    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: Sequence[int]) -> str: ...

    def logits(self, ids: Sequence[int]) -> np.ndarray: ...


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def span(n_prompt: int, n_text: int) -> tuple[int, int]:
    """Rows of the logits that predict the text's tokens; without a prompt the first token has no prediction."""
    start = max(n_prompt - 1, 0)
    return start, start + n_text - (n_prompt == 0)


def same_tokens(a: Model, b: Model, probes: Sequence[str] = PROBES) -> None:
    """Raises ValueError if two models cut the probes differently."""
    for p in probes:
        if a.encode(p) != b.encode(p):
            raise ValueError(f"the models' tokens differ for {p!r}")


def score_text(a: Model, b: Model | None, prompt: str, text: str) -> dict[str, list | None]:
    """Token features of a text after its prompt; an empty text is a ValueError."""
    p, t = a.encode(prompt), a.encode(text)
    if not t:
        raise ValueError("nothing to score")
    start, end = span(len(p), len(t))
    target = np.array((p + t)[start + 1 : end + 1], dtype=np.int64)
    la = log_softmax(np.asarray(a.logits(p + t), dtype=np.float64)[start:end])
    own = la[np.arange(len(target)), target]
    rank = (la > own[:, None]).sum(axis=1) + 1
    out: dict[str, list | None] = {
        "logp_a": own.tolist(), "rank_a": rank.tolist(), "logrank_a": np.log(rank).tolist(), "entropy_a": (-(np.exp(la) * la).sum(axis=1)).tolist(), "logp_b": None, "cross_entropy_ba": None,
    }
    if b is not None:
        lb = log_softmax(np.asarray(b.logits(p + t), dtype=np.float64)[start:end])
        out["logp_b"] = lb[np.arange(len(target)), target].tolist()
        out["cross_entropy_ba"] = (-(np.exp(lb) * la).sum(axis=1)).tolist()
    return out


def mean_cost(model: Model, prefix: str, text: str) -> float:
    """Mean negative log probability of a text after a prefix; minus infinity for an empty text."""
    if not model.encode(text):
        return -math.inf
    return float(-np.mean(score_text(model, None, prefix, text)["logp_a"]))


def generate(model: Model, prompt: str, max_new_tokens: int, temperature: float = 0.8, top_p: float = 0.95, seed: int = 0, end: int | None = None) -> str:
    """A continuation by nucleus sampling, or the likeliest token each time for a temperature of 0 or less."""
    rng = np.random.default_rng(seed)
    ids = list(model.encode(prompt))
    begin = len(ids)
    for _ in range(max_new_tokens):
        last = np.asarray(model.logits(ids), dtype=np.float64)[-1]
        if temperature <= 0:
            token = int(last.argmax())
        else:
            p = np.exp(log_softmax(last / temperature))
            order = np.argsort(-p)
            kept = order[: int(np.searchsorted(np.cumsum(p[order]), top_p)) + 1]
            token = int(rng.choice(kept, p=p[kept] / p[kept].sum()))
        if token == end:
            break
        ids.append(token)
    return model.decode(ids[begin:]).strip()


_FEATURES = "token_features struct<logp_a:array<double>,rank_a:array<bigint>,logrank_a:array<double>,entropy_a:array<double>,logp_b:array<double>,cross_entropy_ba:array<double>>"
_loaded: dict[str, object] = {}


def _models(load: Callable[[], tuple[Model, Model | None]], key: str) -> tuple[Model, Model | None]:
    """The models of this worker, loaded once; two models must cut texts alike."""
    if key not in _loaded:
        a, b = load()
        if b is not None and b is not a:
            same_tokens(a, b)
        _loaded[key] = (a, b)
    return _loaded[key]  # type: ignore[return-value]


def named_models(name: str) -> Callable[[], tuple[Model, Model | None]]:
    """The function ``module:function`` that loads (first model, second model or None), looked up on the worker."""

    def load() -> tuple[Model, Model | None]:
        module, function = name.split(":")
        return getattr(importlib.import_module(module), function)()

    return load


def generate_rows(rows: DataFrame, load: Callable[[], tuple[Model, Model | None]], max_new_tokens: int, temperature: float = 0.8, top_p: float = 0.95, seed: int = 0, end: int | None = None, id_col: str = "sample_id", key: str = "models") -> DataFrame:
    """(id, llm_continuation) of rows with a prompt, by the first model; a row's seed comes from its id, so the result depends on no partitioning.

    A null prompt is an empty one.
    """
    small = rows.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce("prompt", F.lit("")).alias("_p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, _ = _models(load, key)
        for batch in batches:
            ids, prompts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [generate(a, p, max_new_tokens, temperature, top_p, (seed * 1_000_003 + (i or 0)) % (1 << 63), end) for i, p in zip(ids, prompts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_id", "llm_continuation"])

    return small.mapInArrow(run, "_id bigint, llm_continuation string").withColumnRenamed("_id", id_col)


def sentence_costs(examples: DataFrame, load: Callable[[], tuple[Model, Model | None]], key: str = "models") -> DataFrame:
    """(sample_id, costs) of (sample_id, prompt, human_continuation): the mean cost of each human sentence to the first model, after the prompt and all sentences before it."""
    small = examples.select(F.col("sample_id").cast("bigint").alias("sample_id"), F.coalesce("prompt", F.lit("")).alias("_p"), sentences(F.col("human_continuation")).alias("_s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, _ = _models(load, key)
        for batch in batches:
            prompts, each = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            costs = [[mean_cost(a, " ".join([prompt, *parts[:k]]).strip(), part) for k, part in enumerate(parts or [])] for prompt, parts in zip(prompts, each)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.list_(pa.float64()))], names=["sample_id", "costs"])

    return small.mapInArrow(run, "sample_id bigint, costs array<double>")


def score_rows(rows: DataFrame, load: Callable[[], tuple[Model, Model | None]], id_col: str = "row_id", key: str = "models") -> DataFrame:
    """(id, num_scored_tokens, token_features) of rows with prompt and text, by models that each worker loads once.

    Null or empty texts have null features and no tokens.
    """
    small = rows.select(F.col(id_col).alias("_id"), F.coalesce("prompt", F.lit("")).alias("_p"), F.coalesce("text", F.lit("")).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _models(load, key)
        for batch in batches:
            found = [score_text(a, b, p, t) if a.encode(t) else None for p, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            kind = pa.struct([(n, pa.list_(pa.int64() if n == "rank_a" else pa.float64())) for n in ("logp_a", "rank_a", "logrank_a", "entropy_a", "logp_b", "cross_entropy_ba")])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(f["logp_a"]) if f else 0 for f in found], pa.int32()), pa.array(found, kind)], names=["_id", "num_scored_tokens", "token_features"])

    out = small.mapInArrow(run, f"_id {dict(small.dtypes)['_id']}, num_scored_tokens int, {_FEATURES}")
    return out.withColumnRenamed("_id", id_col)
