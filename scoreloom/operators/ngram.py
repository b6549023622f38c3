"""Token features from count models: a stand-in for a pair of language models.

Words are tokens and the context is the lower-case first character of the word
before.  The features have the schema and formulas of a causal model's; their
values are not a model's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions.text import words
from scoreloom.runtime import Scratch

ALPHA = 0.1


def tokens(rows: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, pos, word, ctx): words with their contexts; the first word has an empty context."""
    each = rows.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("_w"))
    first = F.concat(F.array(F.lit("")), F.transform("_w", lambda w: F.lower(F.substring(w, 1, 1))))
    return each.select("id", F.posexplode(F.zip_with("_w", first, lambda w, c: F.struct(w.alias("word"), c.alias("ctx"))))).filter("col.word is not null").select("id", "pos", "col.word", "col.ctx")


def counts(token_rows: DataFrame) -> DataFrame:
    """(ctx, word, n): pre-aggregated in each task."""
    return token_rows.groupBy("ctx", "word").agg(F.count("*").alias("n"))


def model_tables(a: DataFrame, b: DataFrame, alpha: float = ALPHA) -> tuple[DataFrame, DataFrame]:
    """(per context and word, per context) of two count models over their common vocabulary.

    Words: log probability under both and the rank under a.  Contexts: entropy
    of a, cross entropy of a under b's distribution, and what words unseen by
    both get, whose mass has a closed form.
    """
    both = a.withColumnRenamed("n", "na").join(b.withColumnRenamed("n", "nb"), ["ctx", "word"], "full").na.fill(0, ["na", "nb"])
    size = both.agg(F.countDistinct("word").alias("v"))
    totals = both.groupBy("ctx").agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"), F.count("*").alias("seen"))
    totals = totals.crossJoin(F.broadcast(size))  # one row
    whole = both.join(totals, "ctx")

    def p(n: Column, t: str) -> Column:
        return (n + alpha) / (F.col(t) + alpha * F.col("v"))

    pa, pb = p(F.col("na"), "ta"), p(F.col("nb"), "tb")
    by_count = whole.groupBy("ctx", "na").agg(F.count("*").alias("_k"))
    above = F.sum("_k").over(W.partitionBy("ctx").orderBy(F.col("na").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_k")
    ranks = by_count.select("ctx", "na", (above + 1).alias("rank_a"))
    table = whole.join(ranks, ["ctx", "na"]).select("ctx", "word", F.log(pa).alias("logp_a"), F.log(pb).alias("logp_b"), F.col("rank_a"))
    zero_a, zero_b = p(F.lit(0), "ta"), p(F.lit(0), "tb")
    sums = whole.groupBy("ctx", "ta", "tb", "seen", "v").agg(F.sum(pa * F.log(pa)).alias("_s"), F.sum(pb * F.log(pa)).alias("_x"))
    rest = F.col("v") - F.col("seen")
    contexts = sums.select(
        "ctx", (-(F.col("_s") + rest * zero_a * F.log(zero_a))).alias("entropy_a"), (-(F.col("_x") + rest * zero_b * F.log(zero_a))).alias("cross_entropy_ba")
    )
    return table, contexts


def token_features(rows: DataFrame, a_rows: DataFrame, b_rows: DataFrame, id_col: str = "row_id", text_col: str = "text", alpha: float = ALPHA) -> DataFrame:
    """(id, num_scored_tokens, token_features) of every row whose text has words, scored by models of the two row sets.

    The scored rows must be among the rows of the models.
    """
    scratch = Scratch(rows.sparkSession, "ngram")
    a, b = (scratch.save(counts(tokens(r, id_col, text_col))) for r in (a_rows, b_rows))
    table, contexts = (scratch.save(t) for t in model_tables(a, b, alpha))
    each = tokens(rows, id_col, text_col).join(table, ["ctx", "word"]).join(contexts, "ctx")
    one = F.struct("pos", "logp_a", "rank_a", F.log("rank_a").alias("logrank_a"), "entropy_a", "logp_b", "cross_entropy_ba")
    packed = each.groupBy("id").agg(F.sort_array(F.collect_list(one)).alias("_t"))
    names = ("logp_a", "rank_a", "logrank_a", "entropy_a", "logp_b", "cross_entropy_ba")
    return packed.select(F.col("id").alias(id_col), F.size("_t").alias("num_scored_tokens"), F.struct(*(F.col("_t")[n].alias(n) for n in names)).alias("token_features"))
