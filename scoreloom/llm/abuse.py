"""Abusive, hateful or sexual content."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm.arrowmap import arrow_map, string_list
from scoreloom.llm.folding import fold
from scoreloom.llm.stringkernel import CHUNK, DIMENSIONS, Landmarks, features, fit_svm, scores, whiten
from scoreloom.llm.wordhash import slices
from scoreloom.runtime import Scratch
from scoreloom.sources.records import exists

#: Bounds of the training sample: reviewed documents of either verdict, sentences and symbols of one of them, and sentences of either kind in one fit.
POSITIVE_DOCS, NEGATIVE_DOCS, DOC_SENTENCES, DOC_SYMBOLS, FIT_SENTENCES = 2500, 5000, 300, 20_000, 4500
#: Landmarks of the rounds of fitting; the word list's terms come on top.
LANDMARKS = (250, 400, 800)
COST = 1.0
#: Thresholds tried over the whole range of the crossed margins.
TRIED = 2001
#: Code points handled at a time: what the caches hold.
SLICE = 150_000
#: Slope of the reported score, 1 / (1 + exp(-SLOPE * (margin - threshold))).
SLOPE = 4.0


@dataclass
class Model:
    """Weights over subsequences and a bias: the compiled machine; margins above the threshold are cases."""

    vector: np.ndarray
    bias: float
    threshold: float = 0.0
    #: Crossed margins and verdicts of the reviewed documents, from which the threshold is chosen.
    crossed: np.ndarray = field(default_factory=lambda: np.empty(0))
    cases: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=bool))

    def margins(self, s: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sliced_scores(s, offsets, self.vector) + self.bias


def sliced_scores(s: np.ndarray, offsets: np.ndarray, vector: np.ndarray, step: int = 4000) -> np.ndarray:
    """``scores`` for some thousand sentences at a time."""
    parts = [scores(s[offsets[a] : offsets[min(a + step, len(offsets) - 1)]], offsets[a : a + step + 1] - offsets[a], vector) for a in range(0, len(offsets) - 1, step)]
    return np.concatenate(parts) if parts else np.empty(0)


def pick(s: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given sentences, one after another."""
    size = np.diff(offsets)[rows]
    ends = np.cumsum(size)
    take = np.repeat(offsets[:-1][rows] - (ends - size), size) + np.arange(int(size.sum()))
    return s[take], np.concatenate([[0], ends])


def _odds(s: np.ndarray, offsets: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Log odds of each slot between two kinds of sentences."""
    counts = []
    for kind in (True, False):
        n = np.zeros(DIMENSIONS, dtype=np.int64)
        own = np.flatnonzero(positive == kind)
        for a in range(0, len(own), CHUNK):
            n += np.bincount(features(*pick(s, offsets, own[a : a + CHUNK]))[1], minlength=DIMENSIONS)
        counts.append(np.log((n + 0.5) / (n.sum() + 0.5 * DIMENSIONS)))
    return (counts[0] - counts[1]).astype(np.float32)


def fit(s: np.ndarray, offsets: np.ndarray, doc: np.ndarray, verdict: np.ndarray, terms: list[str], seed: int = 0) -> Model:
    """The machine from sentences of reviewed documents.

    ``doc`` is the document of each sentence and ``verdict`` that document's.  A
    positive verdict says that at least one sentence is a case, not which: the
    first round takes from every positive document the sentence with the
    highest log odds, later ones the highest margin, the last also those with a
    clear margin.  What is learnt from one half of the documents chooses the
    sentences of the other half, so that an odd sentence doesn't vouch for
    itself.  Negative sentences are drawn at random and from those nearest to
    the other side.  Without verdicts of both kinds no text is a case.
    """
    rng = np.random.default_rng(seed)
    yes, no = np.flatnonzero(verdict), np.flatnonzero(~verdict)
    if not len(yes) or not len(no):
        return Model(np.zeros(DIMENSIONS, dtype=np.float32), -1.0)
    key = np.array([hash(s[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])])
    fresh = yes[~np.isin(key[yes], key[no])]
    # Positive documents may hold nothing but sentences that negative ones have, too.
    yes = fresh if len(fresh) else yes
    term_s, term_at, _ = fold(terms) if terms else (np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64), None)
    side = np.random.default_rng(seed + 1).integers(0, 2, int(doc.max()) + 1)[doc]

    def machine(yes: np.ndarray, no: np.ndarray, margin: np.ndarray, size: int, extra: float) -> Model:
        order = yes[np.argsort(-margin[yes], kind="stable")]
        best = order[np.sort(np.unique(doc[order], return_index=True)[1])]
        positive = _draw(rng, np.union1d(best, order[margin[order] > extra]), FIT_SENTENCES)
        near = no[np.argsort(-margin[no], kind="stable")[: FIT_SENTENCES // 2]]
        negative = np.union1d(near, _draw(rng, no, FIT_SENTENCES // 2))
        marks_s, marks_at = pick(s, offsets, np.concatenate([_draw(rng, positive, size // 2), _draw(rng, negative, size // 2)]))
        marks_at = np.concatenate([marks_at, marks_at[-1] + term_at[1:]])
        marks = Landmarks(np.concatenate([marks_s, term_s]), marks_at)
        root = whiten(marks.kernel(np.concatenate([marks_s, term_s]), marks_at))
        rows = np.concatenate([positive, negative])
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        w, bias = fit_svm(marks.kernel(*pick(s, offsets, rows)) @ root, y, np.full(len(y), COST))
        return Model(marks.compiled(root @ w), bias)

    def crossed(judge: Callable[[np.ndarray, np.ndarray], Callable]) -> np.ndarray:
        """Margins of each half of the documents by what was learnt from the other half."""
        out = np.zeros(len(doc))
        for half in (0, 1):
            a, b = yes[side[yes] != half], no[side[no] != half]
            if not len(a) or not len(b):
                a, b = yes, no
            own = np.flatnonzero(side == half)
            out[own] = judge(a, b)(*pick(s, offsets, own))
        return out

    def by_odds(a: np.ndarray, b: np.ndarray) -> Callable:
        some = np.sort(np.concatenate([_draw(rng, a, FIT_SENTENCES), _draw(rng, b, FIT_SENTENCES)]))
        odds = _odds(*pick(s, offsets, some), verdict[some])
        return lambda s, at: sliced_scores(s, at, odds)

    margin = crossed(by_odds)
    for size in LANDMARKS[:-1]:
        extra = np.inf if size == LANDMARKS[0] else 0.3
        margin = crossed(lambda a, b: machine(a, b, margin, size, extra).margins)
    last = machine(yes, no, margin, LANDMARKS[-1], 0.3)
    worst = np.full(int(doc.max()) + 1, -np.inf)
    np.maximum.at(worst, doc, margin)
    known = np.isfinite(worst)
    case = np.zeros(len(worst), dtype=bool)
    case[doc] = verdict
    last.crossed, last.cases = worst[known], case[known]
    return last


def split_point(margin: np.ndarray, case: np.ndarray) -> float:
    """The margin that tells cases from others best when both weigh the same."""
    at = np.linspace(margin.min(), margin.max(), TRIED)
    gain = _above(margin[case], at) - _above(margin[~case], at)
    return float(at[gain >= gain.max() - 1e-9].mean())


def _above(margin: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Share of the margins above each threshold."""
    return 1 - np.searchsorted(np.sort(margin), at, side="right") / max(len(margin), 1)


def best_threshold(margin: np.ndarray, case: np.ndarray, share: float) -> float:
    """The threshold nearest to 0, the machine's own border, whose F1 among all documents is within a standard error of the best.

    Crossed margins come from machines that saw half of the documents, so they
    tell the border's place only roughly.  Reviews are no random sample, so cases and others are weighed by what they
    make up among all documents.  ``share`` is the share of all documents above
    ``split_point``; the share of cases follows from it and from how many
    reviewed documents of either kind are above that point.
    """
    hit, wrong = (float(_above(margin[kind], np.array([split_point(margin, case)]))[0]) for kind in (case, ~case))
    cases = float(np.clip((share - wrong) / max(hit - wrong, 1e-9), 1 / (len(margin) + 1), 1 - 1 / (len(margin) + 1)))
    at = np.linspace(margin.min(), margin.max(), TRIED)
    found, false = cases * _above(margin[case], at), (1 - cases) * _above(margin[~case], at)
    f1 = 2 * found / (found + false + cases)
    near = at[f1 >= f1.max() - math.sqrt(f1.max() * (1 - f1.max()) / case.sum())]
    return float(near[np.argmin(np.abs(near))])


def _draw(rng: np.random.Generator, rows: np.ndarray, n: int) -> np.ndarray:
    return rows if len(rows) <= n else rng.choice(rows, n, replace=False)


def verdicts(reviews: DataFrame) -> DataFrame:
    """(doc_id, abusive): the prevailing verdict; undecided reviews do not count, and ties drop the document."""
    each = reviews.filter("abusive is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("abusive").alias("share"))
    return each.filter("share <> 0.5").select("doc_id", (F.col("share") > 0.5).alias("abusive"))


_SENTENCES = "_id bigint, abusive boolean, body binary"
_MODEL = "vector binary, bias double, crossed binary, cases binary"


def _sentences(seed: int) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    """The folded sentences of each document, within DOC_SENTENCES and DOC_SYMBOLS a draw of them."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, verdict = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        texts = string_list(batch, "_text")
        for a, b in slices(texts):
            s, at, row = fold(texts[a:b])
            out: tuple[list, list, list] = ([], [], [])
            for r in np.unique(row):
                own = np.flatnonzero(row == r)
                size = np.diff(at)[own]
                if len(own) > DOC_SENTENCES or size.sum() > DOC_SYMBOLS:
                    order = np.random.default_rng(seed).permutation(len(own))[:DOC_SENTENCES]
                    order = order[np.cumsum(size[order]) <= DOC_SYMBOLS]
                    own = np.sort(own[order])
                    if not len(own):
                        continue
                body, ends = pick(s, at, own)
                out[0].append(ids[a + r])
                out[1].append(verdict[a + r])
                out[2].append(len(ends).to_bytes(8, "little") + ends.tobytes() + body.tobytes())
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.binary())], names=["_id", "abusive", "body"])

    return run


def _fit_rows(rows: list[tuple[int, bool, bytes]], terms: list[str], seed: int) -> Model:
    symbols, ends, doc, verdict, done = [], [np.zeros(1, dtype=np.int64)], [], [], 0
    for i, (_, abusive, body) in enumerate(sorted(rows)):
        n = int.from_bytes(body[:8], "little")
        at = np.frombuffer(body, dtype=np.int64, count=n, offset=8)
        symbols.append(np.frombuffer(body, dtype=np.uint8, offset=8 + 8 * n))
        ends.append(at[1:] + done)
        done += int(at[-1])
        doc.append(np.full(n - 1, i))
        verdict.append(np.full(n - 1, abusive, dtype=bool))
    return fit(np.concatenate(symbols), np.concatenate(ends), np.concatenate(doc), np.concatenate(verdict), terms, seed)


def train(docs: DataFrame, reviews: DataFrame, terms: DataFrame, seed: int = 0) -> Model:
    """Fits the machine on a bounded sample of reviewed documents, drawn by a hash of their ids.

    The sample goes to one task, which fits and gives back the machine: a
    vector of fixed size and a margin for each document of the sample.
    """
    decided = verdicts(reviews).withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    sample = decided.filter("abusive").orderBy("_h").limit(POSITIVE_DOCS).unionByName(decided.filter("not abusive").orderBy("_h").limit(NEGATIVE_DOCS)).drop("_h")
    labelled = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).join(F.broadcast(sample.withColumnRenamed("doc_id", "_id")), "_id")
    words = [r.term for r in terms.filter("term is not null").select("term").distinct().orderBy("term").collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
        if rows:
            m = _fit_rows(rows, words, seed)
            own = (m.vector.astype("<f4").tobytes(), m.bias, m.crossed.astype("<f8").tobytes(), m.cases.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in own], names=["vector", "bias", "crossed", "cases"])

    found = arrow_map(labelled.select("_id", "_text", "abusive"), _sentences(seed), _SENTENCES).repartition(1).mapInArrow(run, _MODEL).collect()
    if not found:
        return Model(np.zeros(DIMENSIONS, dtype=np.float32), -1.0)
    r = found[0]
    return Model(np.frombuffer(r.vector, dtype="<f4"), r.bias, 0.0, np.frombuffer(r.crossed, dtype="<f8"), np.frombuffer(r.cases, dtype=np.uint8) > 0)


def save_model(model: Model, spark: SparkSession, path: str) -> None:
    """Writes a machine, threshold included, as one Parquet row."""
    row = (bytearray(model.vector.astype("<f4").tobytes()), float(model.bias), float(model.threshold), bytearray(model.crossed.astype("<f8").tobytes()), bytearray(model.cases.astype(np.uint8).tobytes()))
    spark.createDataFrame([row], "vector binary, bias double, threshold double, crossed binary, cases binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> Model:
    r = spark.read.parquet(path).first()
    return Model(np.frombuffer(r.vector, dtype="<f4"), r.bias, r.threshold, np.frombuffer(r.crossed, dtype="<f8"), np.frombuffer(r.cases, dtype=np.uint8) > 0)


def margins(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, margin) of every document: that of its worst sentence.

    Whole texts are scored, in one pass without a shuffle.  Null, empty and
    letterless texts have a null margin; copies get the same one under their
    own ids.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.vector, model.bias))
    names = ["doc_id", *keep, "margin"]
    small = docs.select("doc_id", *(F.col(k) for k in keep), F.col("text").alias("_text"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        texts = string_list(batch, "_text")
        for a, b in slices(texts, SLICE):
            s, at, row = fold(texts[a:b])
            worst = np.full(b - a, -np.inf)
            np.maximum.at(worst, row, own.margins(s, at))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(1 + len(keep))), pa.array(worst, mask=~np.isfinite(worst))], names=names)

    types = dict(small.dtypes)
    return arrow_map(small, run, ", ".join([*(f"{k} {types[k]}" for k in ("doc_id", *keep)), "margin double"]))


def with_threshold(model: Model, every: DataFrame) -> Model:
    """The machine with the threshold that suits all documents, of their ``margins``."""
    if not len(model.crossed) or model.cases.all() or not model.cases.any():
        return model
    at = split_point(model.crossed, model.cases)
    share = every.agg(F.avg((F.coalesce("margin", F.lit(-99.0)) > at).cast("double"))).first()[0]
    return replace(model, threshold=best_threshold(model.crossed, model.cases, share or 0.0))


def judged(every: DataFrame, model: Model) -> DataFrame:
    """``margins`` with (score, abusive): 0.0 and no case without a margin."""
    far = F.coalesce("margin", F.lit(-99.0)) - F.lit(model.threshold)
    return every.withColumn("score", F.when(F.col("margin").isNull(), 0.0).otherwise(1 / (1 + F.exp(-SLOPE * far)))).withColumn("abusive", far > 0)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, margin, score, abusive) of every document, by a machine that has its threshold."""
    return judged(margins(docs, model, keep), model)


def scored(docs: DataFrame, reviews: DataFrame, terms: DataFrame, keep: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """``score`` of every document by a machine fitted on the reviews, its threshold chosen by the margins of all documents.

    With a path, a machine saved there is used, and a new one saved there.
    """
    spark = docs.sparkSession
    if path and exists(spark, path):
        return score(docs, load_model(spark, path), keep)
    fitted = train(docs, reviews, terms)
    every = Scratch(spark, "abuse").save(margins(docs, fitted, keep))
    model = with_threshold(fitted, every)
    if path:
        save_model(model, spark, path)
    return judged(every, model)


def abusive_docs(docs: DataFrame, reviews: DataFrame, terms: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id) of the cases."""
    return scored(docs, reviews, terms, path=path).filter("abusive").select("doc_id")


def source_rates(docs: DataFrame, reviews: DataFrame, terms: DataFrame, path: str | None = None) -> DataFrame:
    """(source, n_docs, n_abusive, rate, mean_score); a null source is a group of its own."""
    each = scored(docs, reviews, terms, keep=("source",), path=path)
    return each.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("abusive").cast("long")).alias("n_abusive"),
        F.round(F.avg(F.col("abusive").cast("double")), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"),
    )
