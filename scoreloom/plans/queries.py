"""Queries of the scoring pipeline over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.arrays import at_least, mean, number
from scoreloom.functions.text import join_sentences, sentences, word_count
from scoreloom.operators import evaluate as E
from scoreloom.operators import metrics as M
from scoreloom.operators import ngram as N
from scoreloom.operators import prepare as P
from scoreloom.operators import samples as S
from scoreloom.operators import synthetic as Y
from scoreloom.operators.grid import wide_scores
from scoreloom.operators.quantiles import quantiles
from scoreloom.operators.scores import METHODS, SINGLE, available_methods, feature, raw_score
from scoreloom.runtime import Scratch, table
from scoreloom.sources import records as R
from scoreloom.sources import reports as T

Query = Callable[[SparkSession, str], DataFrame]
#: Directions and bounds of the fixed-bounds query.
FIXED = {
    "log_likelihood": (1, {"lower": -6.0}), "rank": (-1, {"lower": -50.0}), "log_rank": (-1, {"lower": -3.0}), "entropy": (-1, {"lower": -4.0}),
    "entropy_gap": (-1, {"nll_upper": 6.0}), "binoculars": (-1, {"nll_upper": 6.0}), "lrr": (1, {"nll_upper": 6.0, "logrank_upper": 3.0}),
}
SINGLE_BOUND = (*SINGLE, "entropy_gap", "binoculars")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows with ratio, dataset_key and score_source."""
    return S.sources(S.with_ratio(table(spark, sf_dir, "score_real_text")))


def evaluation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last scoring of each text row."""
    return S.last_scored(scored(spark, sf_dir))


def oriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, contamination_mode, ratio, dataset_key, method, score): raw scores of each method's source, larger for machine texts."""
    keep = ("label", "contamination_mode", "ratio", "dataset_key")
    long = Scratch(spark, "oriented").save(E._scores(scored(spark, sf_dir), keep, {m: [{}] for m in METHODS}, {m: 1 for m in METHODS}))
    directions = M.orientation(long, ["method"], S.is_clean("human"), S.is_clean("llm")).select("method", "direction")
    return long.join(F.broadcast(directions), "method").select(*keep, "method", (F.col("score") * F.col("direction")).alias("score"))


def shown(score: Column) -> Column:
    """A score with six decimals, ties raised whatever the last bit."""
    return F.floor(score * 1e6 + 0.500001) / 1e6


def first_text_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.corpus_texts(table(spark, sf_dir, "clean"), "row_id", ("prompt", "text"))
    return found.select(F.col("id").alias("row_id"), "field", word_count(F.col("text")).alias("n_words"))


def dedupe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "clean").filter("text is not null").select(F.col("row_id").alias("id"), "text")
    return P.dedupe_prefix(texts).select(F.col("id").alias("row_id"), "order")


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sentences(F.col("text"))
    return table(spark, sf_dir, "clean").filter("text is not null").select(
        "row_id", F.size(s).alias("n_sentences"), F.get(s, F.lit(0)).alias("first_sentence"), F.length(join_sentences(s)).alias("joined_chars")
    )


def prompt_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return P.prompt_and_continuation(texts).withColumnRenamed("id", "doc_id")


def pair_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.clean_rows(P.base_examples(table(spark, sf_dir, "clean")))


def expand_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = P.grid(P.base_examples(table(spark, sf_dir, "clean")))
    n = F.size("llm_sentences")
    return cells.select("sample_id", "mode", "ratio", n.alias("n_sentences"), F.when((n == 0) | (F.col("ratio") <= 0), 0).otherwise(P._k(n, F.col("ratio"))).alias("k"))


def contaminate_random_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = P.grid(P.base_examples(table(spark, sf_dir, "clean")), modes=("random",))
    return P.contaminate_random(cells).select("sample_id", "ratio", "k", "n_sentences", "text")


def contaminate_tail_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = table(spark, sf_dir, "clean")
    examples = P.base_examples(clean)
    costs = P.sentence_costs(examples, P.unigram_costs(clean.filter("text is not null")))
    return P.contaminate_tail(P.grid(examples, modes=("tail",)), costs).select("sample_id", "ratio", "k", "n_sentences", "text")


def ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "clean").filter("text is not null and label in ('human', 'llm')")
    found = Scratch(spark, "ngram").save(N.token_features(rows, rows.filter("label = 'llm'"), rows.filter("label = 'human'")))
    return found.select("row_id", "num_scored_tokens", *(F.round(raw_score(m), 6).alias(m) for m in METHODS))


def doc_scores_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (*METHODS, "likelihood_ratio")
    found = wide_scores(table(spark, sf_dir, "score_real_text"), ("score_id",), {m: (m, 1, {}) for m in names})
    return found.select("score_id", *(shown(F.col(m)).alias(m) for m in names))


def doc_scores_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wide_scores(table(spark, sf_dir, "score_real_text"), ("score_id",), {m: (m, d, spec) for m, (d, spec) in FIXED.items()})
    return found.select("score_id", *(shown(F.col(m)).alias(m) for m in FIXED))


def stored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per method: how many stored scores there are, and how many differ from what the tokens give."""
    kept = ("log_likelihood", "rank", "log_rank", "entropy", "entropy_gap", "binoculars")
    rows = wide_scores(table(spark, sf_dir, "score_real_text"), ("doc_scores",), {m: (m, 1, {}) for m in kept})
    each = rows.select(F.inline(F.array(*(F.struct(F.lit(m).alias("method"), F.col("doc_scores")[m].alias("stored"), F.round(m, 10).alias("score")) for m in kept))))
    far = F.abs(F.col("stored") - F.col("score")) > 0.01
    return each.groupBy("method").agg(F.count("stored").alias("n_stored"), F.count("score").alias("n_scored"), F.count(F.when(far, 1)).alias("n_differ"))


def stale_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.with_ratio(table(spark, sf_dir, "score_real_text")).withColumn("n", F.size(feature("logp_a")))
    return rows.groupBy("dataset_key").agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("n") >= 0, 1)).alias("n_with_tokens"), F.count(F.when((F.col("n") >= 0) & (F.col("n") != F.col("num_scored_tokens")), 1)).alias("n_stale"))


def last_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation_rows(spark, sf_dir).select("score_id", "row_id", "score_source")


def method_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    names = available_methods(rows)
    each = rows.select("score_source", F.explode(F.array(*(F.lit(m) for m in names))).alias("method"))
    own = F.when(F.col("method") == "binoculars", "binoculars").otherwise("primary")
    return each.filter(F.col("score_source") == own).groupBy("method", "score_source").agg(F.count("*").alias("n_rows"))


def split_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_half(scored(spark, sf_dir))


def orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ("label", "contamination_mode")
    long = E._scores(scored(spark, sf_dir), keep, {m: [{}] for m in METHODS}, {m: 1 for m in METHODS})
    return M.orientation(long, ["method"], S.is_clean("human"), S.is_clean("llm"))


def pooled_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).filter(S.is_clean("human") | S.is_clean("llm"))
    names = [*SINGLE.values(), "cross_entropy_ba"]
    kind = "array<struct<feature:string,x:double>>"

    def tagged(name: str) -> Column:
        return F.coalesce(F.transform(feature(name), lambda x: F.struct(F.lit(name).alias("feature"), x.alias("x"))).cast(kind), F.array().cast(kind))

    every = rows.select("dataset_key", F.inline(F.concat(*map(tagged, names))))
    return quantiles(every, ["dataset_key", "feature"], "x", sorted({*E.LOWER, *E.UPPER}), decimals=9)


def tpr_at_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = oriented(spark, sf_dir)
    return M.tpr_at_fpr(rows.filter(S.is_clean("human")), rows.filter("contamination_mode <> 'none'"), ["method"], (0.01, 0.05), ["contamination_mode", "ratio"])


def tpr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = oriented(spark, sf_dir)
    return M.tpr_at_fpr(rows.filter(S.is_clean("human")), rows.filter(S.is_clean("llm")), ["method"], M.CURVE)


def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = oriented(spark, sf_dir).filter(S.is_clean("human") | S.is_clean("llm"))
    return M.auroc(rows, ["method", "dataset_key"], F.col("label") == "llm")


def subset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.with_ratio(table(spark, sf_dir, "contaminated"))
    parts = [S.contaminated_subset(rows, m, r).select(F.lit(m).alias("mode"), F.lit(float(r)).alias("ratio"), "sample_id") for m in P.MODES for r in P.RATIOS]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("mode", "ratio").agg(F.count("*").alias("n_rows"), F.countDistinct("sample_id").alias("n_samples"))


def ratio_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tuning_ratio(S.with_ratio(table(spark, sf_dir, "contaminated")))


def key_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    return S.key_differences(rows.filter("score_source = 'primary'"), rows.filter("score_source = 'binoculars'"))


def _tuning_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    return rows.join(S.split_half(rows).filter("split = 'tune'"), "sample_id")


def tune_single_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tune(_tuning_rows(spark, sf_dir), SINGLE_BOUND)[2]


def tune_lrr_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tune(_tuning_rows(spark, sf_dir), ("lrr",))[2]


def evaluate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation_rows(spark, sf_dir)
    return E.evaluate(rows, S.split_half(rows))


def array_clip_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = number(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.round(mean(x), 9).alias("raw_mean"), F.round(mean(at_least(x, F.lit(-0.05))), 9).alias("clipped_mean"))


def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", (0.01, 0.05, 0.5, 0.95, 0.99), decimals=6)


def event_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("odd", F.col("user_id") % 2 == 1)
    return M.auroc(events, ["event_type"], F.col("odd"), "value")


def job_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of the registered corpora and of the models in the table; models are few by nature."""
    models = [r.generator_model for r in table(spark, sf_dir, "clean").select("generator_model").filter("generator_model is not null").distinct().collect()]
    return R.job_matrix(spark, sorted(R.CORPORA), sorted(models))


def synthetic_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test documents of 100 trials, a quarter of their tokens replaced."""
    return Y.active(Y.contaminated_batch(spark, 0.25, "tail", 100, 2000))


def trial_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both modes with the operator's defaults: 100 trials of 1,000 documents to tune on and 2,000 to test, 13 rates and 10 shares."""
    return Y.curves_by_mode(spark, P.MODES)


def first_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the trials of ``trial_curves`` by itself, at its whole size: what the means are taken of."""
    rows = Y.trial_rates(spark, P.MODES, 1, 1000, 2000, Y.SHARES, Y.FPRS, 0.25, 11)
    return rows.select("mode", "method", "clipped", "share", "fpr", F.round("tpr", 6).alias("tpr"), F.round("auroc", 6).alias("auroc"))


def trial_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUROC and rates of the first trial, raw beside clipped, at the share its bounds were tuned at."""
    return T.comparison(Y.trial_rates(spark, P.MODES, 1, 1000, 2000, (0.25,), (0.05, 0.01), 0.25, 11))


def _metrics(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(table(spark, sf_dir, "metric_rows"))


def queries() -> dict[str, Query]:
    own = (
        tpr_at_fpr, first_text_field, dedupe_prefix, sentence_counts, prompt_continuation, pair_unpivot, expand_grid, contaminate_random_sentences, contaminate_tail_sentences,
        ngram_scores, doc_scores_raw, doc_scores_clipped, stored_scores, stale_counts, last_scored, method_sources, split_half, orientation, pooled_quantiles,
        tpr_curve, auroc, subset_counts, ratio_fallback, key_differences, tune_single_bound, tune_lrr_grid, evaluate_grid, array_clip_mean, price_quantiles,
        event_auroc, job_matrix, synthetic_batch, first_trial, trial_report, trial_curves,
    )
    reports = {"metric_mean_rates": T.mean_rates, "metric_clipping_gain": T.clipping_gain, "metric_broken_rows": T.broken_metrics, "metric_console_table": T.console_table}
    return {f.__name__: f for f in own} | {k: _metrics(f) for k, f in reports.items()}
