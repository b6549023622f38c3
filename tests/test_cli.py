import pytest
from pyspark.sql import functions as F

from scoreloom import cli
from scoreloom.operators import prepare as P
from scoreloom.sources import records as R


def test_prepare_and_evaluate(spark, small, tmp_path):
    P.base_examples(spark.read.parquet(f"{small}/clean.parquet")).write.parquet(str(tmp_path / "examples"))
    assert cli.main(["prepare", "--examples", str(tmp_path / "examples"), "--out", str(tmp_path / "out"), "--n-samples", "5"]) == 0
    assert spark.read.json(str(tmp_path / "out/clean.jsonl")).count() == 10
    assert spark.read.json(str(tmp_path / "out/contaminated.jsonl")).count() == 70
    assert cli.main(["evaluate", "--scores", f"{small}/score_real_text.parquet", "--out", str(tmp_path / "eval")]) == 0
    metrics = spark.read.option("header", True).csv(str(tmp_path / "eval/metrics.csv"))
    assert metrics.count() > 0 and "clip_spec" in metrics.columns


def test_from_corpus_to_scores(spark, tmp_path):
    """A CSV corpus with line ends and quotation marks in its texts, cut, continued, mixed and scored by a toy model."""
    texts = [(i, f'Text {i} says "so".\n' + " ".join(f"word{i} and {k}." if k % 9 == 0 else f"w{i}x{k}" for k in range(260)), "validation" if i % 2 else "train") for i in range(40)]
    spark.createDataFrame(texts, "id bigint, document string, split string").write.option("header", True).option("escape", '"').csv(str(tmp_path / "corpus.csv"))
    out = str(tmp_path / "out")
    args = ["prepare", "--dataset", "xsum", "--corpus", str(tmp_path / "corpus.csv"), "--models", "tests.toymodel:load_one", "--n-samples", "4", "--max-new-tokens", "60", "--temperature", "0", "--ratios", "0", "0.5", "--out", out]
    assert cli.main(args) == 0
    clean = R.read_jsonl(spark, f"{out}/clean.jsonl").collect()
    assert len(clean) == 8 and {r.label for r in clean} == {"human", "llm"} and all(int(r.example_id) % 2 for r in clean)
    assert all("One went home." in r.text or "Two came late." in r.text for r in clean if r.label == "llm")
    assert R.read_jsonl(spark, f"{out}/contaminated.jsonl").count() == 16
    for name, models in (("a", "load_one"), ("b", "load")):
        assert cli.main(["score", "--rows", f"{out}/clean.jsonl", "--models", f"tests.toymodel:{models}", "--out", f"{out}/{name}.jsonl"]) == 0
    scored = R.read_jsonl(spark, f"{out}/b.jsonl", R.SCORED_ROW).collect()
    assert len(scored) == 8 and all(r.num_scored_tokens == len(r.token_features.logp_a) > 0 and r.doc_scores.binoculars is not None for r in scored)
    assert all(r.doc_scores.binoculars is None for r in R.read_jsonl(spark, f"{out}/a.jsonl", R.SCORED_ROW).collect())
    assert cli.main(["score", "--rows", f"{out}/clean.jsonl", "--models", "tests.toymodel:load_one", "--limit", "3", "--out", f"{out}/few.jsonl"]) == 0
    assert R.read_jsonl(spark, f"{out}/few.jsonl", R.SCORED_ROW).count() == 3
    with pytest.raises(ValueError, match="differ"):
        cli.main(["evaluate", "--scores", f"{out}/a.jsonl", "--binoculars-scores", f"{out}/few.jsonl", "--out", f"{out}/eval"])


def test_two_sets_of_scores(spark, small, tmp_path):
    rows = spark.read.parquet(f"{small}/score_real_text.parquet").filter("scoring_reference_model is not null")
    rows.withColumn("scoring_reference_model", F.lit(None).cast("string")).write.parquet(str(tmp_path / "primary.parquet"))
    rows.write.parquet(str(tmp_path / "binoculars.parquet"))
    assert cli.main(["evaluate", "--scores", str(tmp_path / "primary.parquet"), "--binoculars-scores", str(tmp_path / "binoculars.parquet"), "--out", str(tmp_path / "eval")]) == 0
    metrics = spark.read.option("header", True).csv(str(tmp_path / "eval/metrics.csv")).collect()
    assert {(r.method, r.score_source) for r in metrics} >= {("binoculars", "binoculars"), ("lrr", "primary")}


def test_first_rows_in_file_order(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part{k}.jsonl").write_text("".join(f'{{"sample_id": {100 * k + i}, "text": "{"x" * (3 - k) * 50}"}}\n' for i in range(50)))
    rows = R.read_jsonl(spark, str(tmp_path / "*.jsonl"))
    assert [r.sample_id for r in R.first_rows(rows, 60).collect()] == [*range(50), *range(100, 110)]


def test_finished_results_only(spark, tmp_path):
    """A folder whose write broke off is made again; a finished one is kept, unless forced."""
    path = str(tmp_path / "r")
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "part-0.parquet").write_bytes(b"half")
    assert not R.exists(spark, path)
    assert [r.id for r in R.materialize(spark, path, lambda: spark.range(1)).collect()] == [0]
    assert [r.id for r in R.materialize(spark, path, lambda: spark.range(5, 6)).collect()] == [0]
    assert [r.id for r in R.materialize(spark, path, lambda: spark.range(5, 6), force=True).collect()] == [5]


def test_query(spark, small, tmp_path):
    cli.main(["query", "ratio_fallback", "--data", small, "--out", str(tmp_path / "q")])
    assert spark.read.parquet(str(tmp_path / "q")).count() == 2
