"""Reports of metric rows: tables for the console, and line charts where a plotting library is at hand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.operators.scores import LABELS

RATES = ("raw_tpr_at_1_fpr", "clipped_tpr_at_1_fpr", "raw_tpr_at_5_fpr", "clipped_tpr_at_5_fpr")


def distinct_metrics(metrics: DataFrame) -> DataFrame:
    """Metric rows once each, NaN rates as null."""
    return metrics.distinct().withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in RATES})


def mean_rates(metrics: DataFrame, by: Sequence[str] = ("dataset", "generator_model", "mode", "method")) -> DataFrame:
    """Mean of the rates over the ratios; NaN rates are left out."""
    each = distinct_metrics(metrics)
    return each.groupBy(*by).agg(F.count("*").alias("n_rows"), *(F.round(F.avg(c), 6).alias(c) for c in RATES))


def clipping_gain(metrics: DataFrame) -> DataFrame:
    """(mode, method, ratio, gain_at_1, gain_at_5): what clipping adds to the rates, on average."""
    each = distinct_metrics(metrics)
    gain = [F.round(F.avg(F.col(f"clipped_tpr_at_{p}_fpr") - F.col(f"raw_tpr_at_{p}_fpr")), 6).alias(f"gain_at_{p}") for p in (1, 5)]
    return each.groupBy("mode", "method", F.round("ratio", 6).alias("ratio")).agg(F.count("*").alias("n_rows"), *gain)


def broken_metrics(metrics: DataFrame) -> DataFrame:
    """Rows against what must hold: a rate at 5 % below that at 1 %, or clipped unlike raw without bounds."""
    each = distinct_metrics(metrics)
    order = (F.col("raw_tpr_at_5_fpr") < F.col("raw_tpr_at_1_fpr")) | (F.col("clipped_tpr_at_5_fpr") < F.col("clipped_tpr_at_1_fpr"))
    same = (F.col("raw_tpr_at_1_fpr") != F.col("clipped_tpr_at_1_fpr")) | (F.col("raw_tpr_at_5_fpr") != F.col("clipped_tpr_at_5_fpr"))
    reason = F.when(order, "order").when((F.col("clip_spec") == "{}") & same, "unclipped")
    return each.withColumn("reason", reason).filter("reason is not null").select("dataset", "generator_model", "mode", "method", "ratio", "reason")


def console_table(metrics: DataFrame, rate: str = "clipped_tpr_at_5_fpr") -> DataFrame:
    """Methods as rows, modes as columns: the mean rate over all ratios."""
    modes = ("random", "tail")
    names = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    each = distinct_metrics(metrics).groupBy("method").agg(*(F.round(F.avg(F.when(F.col("mode") == m, F.col(rate))), 6).alias(m) for m in modes))
    return each.select("method", F.coalesce(names[F.col("method")], F.col("method")).alias("label"), *modes)


def comparison(rates: DataFrame, fprs: Sequence[float] = (0.05, 0.01)) -> DataFrame:
    """(mode, method, label, raw_auroc, clipped_auroc, and raw and clipped rates at each false-positive rate) of (mode, method, clipped, fpr, tpr, auroc)."""
    names = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))

    def value(column: str, clipped: bool, fpr: float | None = None) -> Column:
        wanted = F.col("clipped") == F.lit(clipped)
        return F.round(F.avg(F.when(wanted if fpr is None else wanted & (F.abs(F.col("fpr") - fpr) < 1e-12), F.col(column))), 6)

    both = (("raw", False), ("clipped", True))
    out = [value("auroc", c).alias(f"{n}_auroc") for n, c in both] + [value("tpr", c, f).alias(f"{n}_tpr_at_{round(100 * f)}_fpr") for f in fprs for n, c in both]
    return rates.groupBy("mode", "method").agg(*out).withColumn("label", F.coalesce(names[F.col("method")], F.col("method")))


def plot_curves(metrics: DataFrame, path: str, x: str = "ratio", y: Sequence[str] = ("raw_tpr_at_5_fpr", "clipped_tpr_at_5_fpr"), log_x: bool = False, panels: str | None = "mode") -> bool:
    """A line chart of a small result, with a panel for each value of ``panels`` and each column; returns False where no plotting library is installed."""
    try:
        import matplotlib
    except ImportError:
        return False
    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    rows = metrics.toPandas().sort_values(x)
    parts = list(rows.groupby(panels)) if panels in rows.columns else [("", rows)]
    fig, axes = plt.subplots(len(parts), len(y), squeeze=False, figsize=(6 * len(y), 4 * len(parts)))
    for (name, part), line in zip(parts, axes):
        for column, axis in zip(y, line):
            for method, own in part.groupby("method"):
                axis.plot(own[x], own[column], label=LABELS.get(method, method))
            axis.set_title(f"{name} {column}".strip())
            axis.set_xlabel(x)
            if log_x:
                axis.set_xscale("log")
            axis.legend()
    fig.tight_layout()
    fig.savefig(path)
    plt.close(fig)
    return True
