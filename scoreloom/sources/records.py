"""Record schemas, JSON Lines and CSV, and where results are laid out."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.names import path_name

TEXT_ROW = (
    "dataset string, example_id string, sample_id bigint, prompt string, label string, text string, source string, "
    "contamination_mode string, contamination_ratio double, generator_model string, evaluator_model string"
)
SCORED_ROW = (
    "dataset string, example_id string, sample_id bigint, prompt string, label string, text string, source string, "
    "contamination_mode string, contamination_ratio double, generator_model string, evaluator_model string, "
    "scoring_observer_model string, scoring_reference_model string, num_scored_tokens int, "
    "doc_scores struct<log_likelihood:double,rank:double,log_rank:double,entropy:double,entropy_gap:double,binoculars:double>, "
    "token_features struct<logp_a:array<double>,rank_a:array<bigint>,logrank_a:array<double>,entropy_a:array<double>,logp_b:array<double>,cross_entropy_ba:array<double>>, "
    "scored_token_ids array<bigint>, scored_tokens array<string>"
)
# Corpora by name, with the text fields in order of preference, and the split that is read.
CORPORA = {"xsum": ("document",), "squad": ("context",), "writingprompts": ("story", "text", "completion")}
SPLIT = "validation"


def read_jsonl(spark: SparkSession, path: str, schema: str = TEXT_ROW) -> DataFrame:
    """One JSON object a line; blank lines are skipped and a bad line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    """The first rows in the order of the files' names and of their lines, of a frame read from files."""
    place = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    marked = rows.select("*", place[0].alias("_file"), place[1].alias("_block"), F.monotonically_increasing_id().alias("_line"))
    return marked.orderBy("_file", "_block", "_line").limit(n).drop("_file", "_block", "_line")


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line, non-ASCII as it is; replaces what is there."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(rows: DataFrame, path: str) -> bool:
    """One CSV file with a header; nothing is written for no rows.  Returns whether a file was written.

    For small results, such as metric rows.
    """
    if not rows.head(1):
        return False
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return True


def read_corpus(spark: SparkSession, name: str, path: str, split: str | None = None) -> DataFrame:
    """A registered corpus from Parquet, JSON Lines or CSV files, by the path's ending.

    With a split, of rows with a column ``split`` those of that split; a corpus
    laid out by split is read from the split's own path.  CSV fields may hold
    line ends and doubled quotation marks.
    """
    if name not in CORPORA:
        raise KeyError(name)
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    reader = spark.read
    if kind == "csv":
        rows = reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    else:
        rows = reader.json(path) if kind in ("json", "jsonl") else reader.parquet(path)
    return rows.filter(F.col("split") == split) if split and "split" in rows.columns else rows


def write_partitioned(rows: DataFrame, path: str) -> None:
    """Parquet by dataset and generator model, the model's ``/`` as ``__``."""
    rows.withColumn("model", path_name(F.col("generator_model"))).write.mode("overwrite").partitionBy("dataset", "model").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished, non-empty result is there: a folder whose write came to its end, or a file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p) or fs.getContentSummary(p).getLength() == 0:
        return False
    return not fs.getFileStatus(p).isDirectory() or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))


def materialize(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The result at a path; made and written first if it isn't there, or if forced."""
    if force or not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def job_matrix(spark: SparkSession, datasets: Iterable[str], models: Iterable[str], out: str = "out") -> DataFrame:
    """(dataset, model, path): one job for each dataset and model."""
    jobs = [(d, m) for d in datasets for m in models]
    frame = spark.createDataFrame(jobs or [("", "")], "dataset string, model string").filter("dataset <> ''")
    return frame.withColumn("path", F.concat_ws("/", F.lit(out), F.col("dataset"), path_name(F.col("model"))))
