"""Command line: prepare texts, score them, evaluate scores, run a registered query, print and plot synthetic curves.

    python -m scoreloom.cli prepare --dataset xsum --corpus CORPUS.parquet --models my_models:load --out DIR
    python -m scoreloom.cli score --rows DIR/clean.jsonl --models my_models:load --out DIR/clean_scores.jsonl
    python -m scoreloom.cli evaluate --scores SCORES.parquet [--binoculars-scores OTHER.parquet] --out DIR

``--models module:function`` names a function that loads the models on each
worker; see ``operators.scorer``.  A finished result is left as it is unless
``--force`` is given.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.operators import evaluate as E
from scoreloom.operators import prepare as P
from scoreloom.operators import samples as S
from scoreloom.operators import scorer
from scoreloom.operators import synthetic as Y
from scoreloom.runtime import Scratch, session
from scoreloom.sources import records as R
from scoreloom.sources import reports as T


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="scoreloom")
    top.add_argument("--master", default="local[*]")
    sub = top.add_subparsers(dest="command", required=True)
    one = sub.add_parser("prepare", help="clean and contaminated rows from a corpus, or from paired texts")
    one.add_argument("--examples", help="Parquet with sample_id, dataset, example_id, prompt, human_continuation, llm_continuation")
    one.add_argument("--dataset", choices=sorted(R.CORPORA))
    one.add_argument("--corpus", help="files of that corpus")
    one.add_argument("--split", default=R.SPLIT)
    one.add_argument("--models", help="module:function that loads the generator (and None)")
    one.add_argument("--generator-name")
    one.add_argument("--max-new-tokens", type=int, default=P.CONTINUATION_TOKENS)
    one.add_argument("--temperature", type=float, default=0.8)
    one.add_argument("--top-p", type=float, default=0.95)
    one.add_argument("--out", required=True)
    one.add_argument("--n-samples", type=int)
    one.add_argument("--ratios", type=float, nargs="+", default=list(P.RATIOS))
    one.add_argument("--seed", type=int, default=13)
    one.add_argument("--force", action="store_true")
    one = sub.add_parser("score", help="token features and scores of text rows")
    one.add_argument("--rows", required=True, help="JSON Lines of text rows")
    one.add_argument("--models", required=True, help="module:function that loads (observer, reference or None)")
    one.add_argument("--observer-name", default="observer")
    one.add_argument("--reference-name")
    one.add_argument("--limit", type=int, help="only the first rows, in file order")
    one.add_argument("--out", required=True)
    one.add_argument("--force", action="store_true")
    one = sub.add_parser("evaluate", help="tune bounds on half of the samples, test on the other half")
    one.add_argument("--scores", required=True, help="Parquet, or JSON Lines ending in .jsonl, of scored rows")
    one.add_argument("--binoculars-scores", help="a second set of scores of the same rows, from which Binoculars is taken")
    one.add_argument("--out", required=True)
    one.add_argument("--seed", type=int, default=0)
    one = sub.add_parser("trials", help="synthetic curves")
    one.add_argument("--mode", choices=P.MODES, default="tail")
    one.add_argument("--trials", type=int, default=100)
    one.add_argument("--out", required=True)
    one.add_argument("--plot", help="also a chart over the shares, or with --over-fpr over the false-positive rates")
    one.add_argument("--over-fpr", action="store_true")
    one = sub.add_parser("plot", help="chart of the metrics that evaluate wrote")
    one.add_argument("--metrics", required=True)
    one.add_argument("--out", required=True)
    one = sub.add_parser("query", help="a registered query of the pipeline")
    one.add_argument("name")
    one.add_argument("--data", required=True)
    one.add_argument("--out", required=True)
    return top


def _scored(spark: SparkSession, path: str) -> DataFrame:
    rows = R.read_jsonl(spark, path, R.SCORED_ROW) if path.rstrip("/").endswith(".jsonl") else spark.read.parquet(path)
    return S.with_ratio(S.require_rows(rows, path))


def prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    scratch = Scratch(spark, "prepare")
    load = scorer.named_models(a.models) if a.models else None
    if a.examples:
        examples = spark.read.parquet(a.examples)
    else:
        if not (a.dataset and a.corpus and load and a.n_samples):
            raise SystemExit("prepare needs --examples, or --dataset, --corpus, --models and --n-samples")
        corpus = R.read_corpus(spark, a.dataset, a.corpus, a.split)
        fields = [f for f in R.CORPORA[a.dataset] if f in corpus.columns]
        if "id" not in corpus.columns:
            corpus = corpus.withColumn("id", F.xxhash64(*fields))
        number = F.coalesce(F.expr("try_cast(id AS bigint)"), F.xxhash64(F.col("id").cast("string")))
        texts = P.corpus_texts(corpus.withColumn("_id", number), "_id", fields)
        human = scratch.save(S.require_rows(P.corpus_examples(texts, a.dataset, a.n_samples, a.seed), a.corpus))
        written = scorer.generate_rows(human, load, a.max_new_tokens, a.temperature, a.top_p, a.seed, key=a.models)
        examples = human.join(written, "sample_id")
    examples = scratch.save(examples)
    kept = scratch.save(S.require_rows(P.keep_first(examples, a.n_samples) if a.n_samples else examples, a.examples or a.corpus))
    named = lambda rows: rows.withColumns({"generator_model": F.lit(a.generator_name), "evaluator_model": F.lit(a.generator_name)})
    R.write_jsonl(named(P.clean_rows(kept)), f"{a.out}/clean.jsonl")
    costs = scorer.sentence_costs(kept, load, a.models) if load else P.sentence_costs(kept, P.unigram_costs(kept, "human_continuation"))
    dirty = P.contaminate_random(P.grid(kept, a.ratios, ("random",)), a.seed).unionByName(P.contaminate_tail(P.grid(kept, a.ratios, ("tail",)), scratch.save(costs)))
    rows = dirty.select(
        "dataset", "example_id", "sample_id", "prompt", F.lit("llm").alias("label"), "text", F.lit("llm_contaminated").alias("source"),
        F.col("mode").alias("contamination_mode"), F.col("ratio").alias("contamination_ratio"),
    )
    R.write_jsonl(named(rows), f"{a.out}/contaminated.jsonl")


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = R.read_jsonl(spark, a.rows)
    rows = R.first_rows(rows, a.limit) if a.limit else rows
    rows = Scratch(spark, "score").save(S.require_rows(rows, a.rows).withColumn("_row", F.monotonically_increasing_id()))
    found = scorer.score_rows(rows, scorer.named_models(a.models), "_row", a.models)
    from scoreloom.operators.scores import raw_score

    kept = ("log_likelihood", "rank", "log_rank", "entropy", "entropy_gap", "binoculars")
    out = rows.join(found, "_row").withColumns({
        "scoring_observer_model": F.lit(a.observer_name), "scoring_reference_model": F.lit(a.reference_name).cast("string"), "doc_scores": F.struct(*(raw_score(m).alias(m) for m in kept)),
    })
    R.write_jsonl(out.drop("_row"), a.out)


def main(args: Sequence[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = session(a.master)
    done = {"prepare": f"{a.out}/contaminated.jsonl", "score": a.out}.get(a.command)
    if done and not a.force and R.exists(spark, done):
        print(f"{done} is there already")
    elif a.command == "prepare":
        prepare(spark, a)
    elif a.command == "score":
        score(spark, a)
    elif a.command == "evaluate":
        rows = _scored(spark, a.scores)
        if a.binoculars_scores:
            other = _scored(spark, a.binoculars_scores)
            S.require_same_keys(rows, other)
            rows = rows.withColumn("score_source", F.lit("primary")).unionByName(other.withColumn("score_source", F.lit("binoculars")), allowMissingColumns=True)
        else:
            rows = S.sources(rows)
        R.write_csv(E.evaluate(rows, S.split_half(rows, a.seed)).orderBy("mode", "method", "ratio"), f"{a.out}/metrics.csv")
    elif a.command == "trials":
        found = Scratch(spark, "trials").save(Y.trial_curves(spark, a.mode, a.trials))
        R.write_csv(found.orderBy("method", "share", "fpr", "clipped"), a.out)
        if a.plot:
            part = found.filter("share = 0.25") if a.over_fpr else found.filter("fpr = 0.05")
            T.plot_curves(part, a.plot, "fpr" if a.over_fpr else "share", ("tpr", "auroc"), a.over_fpr, "clipped") or print("no plotting library is installed")
    elif a.command == "plot":
        metrics = spark.read.option("header", True).option("inferSchema", True).option("escape", '"').csv(a.metrics)
        T.plot_curves(metrics, a.out, y=T.RATES) or print("no plotting library is installed")
    else:
        from scoreloom.plans.queries import queries

        queries()[a.name](spark, a.data).write.mode("overwrite").parquet(a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
