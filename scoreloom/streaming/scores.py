"""Document scores of rows as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scoreloom.operators.scores import METHODS, raw_scores


def scored_stream(spark: SparkSession, path: str, schema, max_files: int = 16) -> DataFrame:
    """New Parquet files of scored rows with one column for each method; no state is kept."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    return raw_scores(rows, METHODS).drop("token_features")


def hourly_means(scored: DataFrame, late: str = "7 days") -> DataFrame:
    """(window, label, n, mean_log_likelihood) by the hour of scoring; rows later than the watermark are left out."""
    return scored.withWatermark("scored_at", late).groupBy(F.window("scored_at", "1 hour"), "label").agg(F.count("*").alias("n"), F.avg("log_likelihood").alias("mean_log_likelihood"))


def write_stream(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what has arrived so far as Parquet, exactly once, and stops."""
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
