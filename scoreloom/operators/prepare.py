"""Text preparation: corpus dedupe, length gates, prompt cuts, clean and contaminated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions.names import stable_hash
from scoreloom.functions.text import LEAST_WORDS, first_long_field, first_long_text, join_sentences, prefix_key, sentences, token_slice, words

RATIOS = (0.0, 0.05, 0.10, 0.20, 0.30, 0.40, 0.50)
MODES = ("random", "tail")
PROMPT_TOKENS, CONTINUATION_TOKENS = 30, 220
# Texts read for each sample wanted.
SPARE = 4
#: Least tokens behind the prompt, and least sentences of a continuation.
LEAST_CONTINUATION, LEAST_SENTENCES = 40, 2


def corpus_texts(rows: DataFrame, id_col: str, fields: Sequence[str], least: int = LEAST_WORDS) -> DataFrame:
    """(id, field, text) of rows with a long enough text in one of the fields, the first that qualifies."""
    found = rows.select(F.col(id_col).alias("id"), first_long_field(fields, least).alias("field"), first_long_text(fields, least).alias("text"))
    return found.filter("text is not null")


def dedupe_prefix(texts: DataFrame, seed: int = 0, n_needed: int | None = None) -> DataFrame:
    """(id, text, order): texts in a seeded order, the first of those whose beginnings are the same.

    The beginning is the first 500 characters with white space collapsed.  Of a
    group, however large, each task sends one candidate.  ``n_needed`` keeps
    only the first so many.
    """
    order = stable_hash(F.col("id"), seed)
    keyed = texts.select("id", "text", F.xxhash64(prefix_key(F.col("text"))).alias("_k1"), F.sha1(prefix_key(F.col("text"))).alias("_k2"), order.alias("order"))
    first = keyed.groupBy("_k1", "_k2").agg(F.min(F.struct("order", "id")).alias("_f")).select(F.col("_f.id").alias("id"))
    out = keyed.join(first, "id", "left_semi").select("id", "text", "order")
    return out.orderBy("order", "id").limit(n_needed) if n_needed is not None else out


def prompt_and_continuation(texts: DataFrame, prompt_tokens: int = PROMPT_TOKENS, continuation_tokens: int = CONTINUATION_TOKENS) -> DataFrame:
    """(id, prompt, continuation) of texts long enough to be cut; tokens are words here.

    A text needs the prompt and ``max(40, continuation_tokens // 2)`` tokens
    more, and its continuation two sentences.
    """
    cut = texts.withColumn("_t", words(F.col("text"))).filter(F.size("_t") >= prompt_tokens + max(LEAST_CONTINUATION, continuation_tokens // 2))
    cut = cut.select("id", token_slice(F.col("_t"), 0, prompt_tokens).alias("prompt"), token_slice(F.col("_t"), prompt_tokens, prompt_tokens + continuation_tokens).alias("continuation"))
    return cut.filter(F.size(sentences(F.col("continuation"))) >= LEAST_SENTENCES)


def corpus_examples(texts: DataFrame, dataset: str, n_samples: int, seed: int = 0) -> DataFrame:
    """(sample_id, dataset, example_id, prompt, human_continuation) from the texts (id, text) of a corpus.

    Texts come in a seeded order without repeated beginnings, SPARE times as
    many as samples are wanted, as some are too short to be cut; samples are
    numbered in that order.
    """
    first = dedupe_prefix(texts, seed, SPARE * n_samples)
    cut = prompt_and_continuation(first.select("id", "text")).join(first.select("id", "order"), "id")
    number = F.row_number().over(W.orderBy("order", "id")) - 1  # of SPARE * n_samples rows at most
    return cut.select(number.cast("bigint").alias("sample_id"), F.lit(dataset).alias("dataset"), F.col("id").cast("string").alias("example_id"), "prompt", F.col("continuation").alias("human_continuation"))


def base_examples(rows: DataFrame) -> DataFrame:
    """(sample_id, dataset, example_id, prompt, human_continuation, llm_continuation): one wide row for each sample with clean texts of both labels.

    Of several clean rows of a label, the one with the least row_id counts.
    """
    own = rows.filter("contamination_mode = 'none' and text is not null and sample_id is not null and label in ('human', 'llm')")

    def first(label: str, *columns: str) -> Column:
        mine = F.col("label") == label
        return F.min_by(F.struct(*columns), F.when(mine, F.col("row_id")))

    both = own.groupBy("sample_id").agg(
        first("human", "dataset", "example_id", "prompt", "text").alias("h"), first("llm", "text").alias("m"),
        F.count(F.when(F.col("label") == "human", 1)).alias("_nh"), F.count(F.when(F.col("label") == "llm", 1)).alias("_nm"),
    )
    return both.filter("_nh > 0 and _nm > 0").select("sample_id", "h.dataset", "h.example_id", "h.prompt", F.col("h.text").alias("human_continuation"), F.col("m.text").alias("llm_continuation"))


def keep_first(examples: DataFrame, n_samples: int) -> DataFrame:
    """The first samples, by id, whose generated text has two sentences."""
    return examples.filter(F.size(sentences(F.col("llm_continuation"))) >= LEAST_SENTENCES).orderBy("sample_id").limit(n_samples)


def clean_rows(examples: DataFrame) -> DataFrame:
    """Two rows for each example: its human and its generated text."""
    def row(label: str, text: str, source: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.col(text).alias("text"), F.lit(source).alias("source"), F.lit("none").alias("contamination_mode"), F.lit(0.0).alias("contamination_ratio"))

    both = F.array(row("human", "human_continuation", "human_clean"), row("llm", "llm_continuation", "llm_clean"))
    return examples.select("sample_id", "dataset", "example_id", "prompt", F.inline(both))


def grid(examples: DataFrame, ratios: Sequence[float] = RATIOS, modes: Sequence[str] = MODES) -> DataFrame:
    """One row for each example, ratio and mode, with the sentences of both texts.

    Sentences are cut once an example; the configuration is inlined, so nothing is joined.
    """
    cut = examples.withColumn("llm_sentences", sentences(F.col("llm_continuation"))).withColumn("human_sentences", sentences(F.col("human_continuation")))
    cells = F.array(*(F.struct(F.lit(i).alias("ratio_index"), F.lit(float(r)).alias("ratio"), F.lit(m).alias("mode")) for i, r in enumerate(ratios) for m in modes))
    return cut.select("*", F.inline(cells))


def _k(n: Column, ratio: Column) -> Column:
    return F.least(n, F.greatest(F.lit(1), F.bround(n * ratio).cast("int")))


def contaminate_random(grid_rows: DataFrame, seed: int = 0) -> DataFrame:
    """Replaces k sentences at random places by human ones drawn with replacement.

    k is the ratio of the machine text's sentences, rounded half to even, at
    least one and at most all; a ratio of 0 or a text without sentences stays
    as it is.  Places and draws come from hashes of sample, ratio and slot.
    """
    n, m = F.size("llm_sentences"), F.size("human_sentences")
    place = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(stable_hash(F.col("sample_id") * 100_003 + F.col("ratio_index") * 1_009 + i, seed).alias("h"), i.alias("i")))
    chosen = F.transform(F.slice(F.array_sort(place), F.lit(1), F.col("k")), lambda x: x["i"])
    mixed = F.transform(
        F.col("llm_sentences"),
        lambda s, i: F.when(F.array_contains("_at", i), F.element_at("human_sentences", (F.pmod(stable_hash(F.col("sample_id") * 99_991 + F.col("ratio_index") * 997 + i, seed + 1), m) + 1).cast("int"))).otherwise(s),
    )
    off = (n == 0) | (m == 0) | (F.col("ratio") <= 0)
    own = grid_rows.withColumn("k", F.when(off, 0).otherwise(_k(n, F.col("ratio")))).withColumn("_at", F.when(F.col("k") > 0, chosen))
    text = F.when(F.col("k") == 0, F.col("llm_continuation")).otherwise(join_sentences(mixed))
    return own.withColumn("text", text).withColumn("n_sentences", n).drop("llm_sentences", "human_sentences", "_at")


def unigram_costs(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, cost): negative log share of each word in the texts, a stand-in for a model's cost."""
    each = texts.select(F.explode(words(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = each.agg(F.sum("n").alias("_all"))
    return each.crossJoin(F.broadcast(total)).select("word", F.round(-F.log(F.col("n") / F.col("_all")), 9).alias("cost"))  # one row


def sentence_costs(examples: DataFrame, costs: DataFrame) -> DataFrame:
    """(sample_id, costs): mean cost of the words of each human sentence, in order."""
    each = examples.select("sample_id", F.posexplode(sentences(F.col("human_continuation"))).alias("idx", "s"))
    each = each.select("sample_id", "idx", F.explode(words(F.col("s"))).alias("word"))
    each = each.join(costs, "word").groupBy("sample_id", "idx").agg(F.round(F.sum(F.col("cost").cast("decimal(20,9)")).cast("double") / F.count("*"), 9).alias("cost"))
    return each.groupBy("sample_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "cost"))), lambda x: x["cost"]).alias("costs"))


def contaminate_tail(grid_rows: DataFrame, costs: DataFrame) -> DataFrame:
    """Puts the k costliest human sentences at evenly spaced places of the machine text.

    ``costs`` has (sample_id, costs), one cost for each human sentence; of
    equal costs the later sentence comes first.
    """
    own = grid_rows.join(costs, "sample_id", "left")
    n, m = F.size("llm_sentences"), F.size("human_sentences")
    off = (n == 0) | (m == 0) | (F.col("ratio") <= 0)
    own = own.withColumn("k", F.when(off, 0).otherwise(F.least(m, _k(n, F.col("ratio")))))
    ranked = F.reverse(F.array_sort(F.zip_with("costs", F.sequence(F.lit(0), m - 1), lambda c, i: F.struct(c.alias("c"), i.alias("i")))))
    own = own.withColumn("_top", F.when(F.col("k") > 0, F.transform(F.slice(ranked, F.lit(1), F.col("k")), lambda x: x["i"])))
    spot = F.transform(F.sequence(F.lit(0), F.greatest(F.col("k") - 1, F.lit(0))), lambda j: F.least(n - 1, F.floor((j + 0.5) * n / F.col("k")).cast("int")))
    own = own.withColumn("_spot", F.when(F.col("k") > 0, spot))
    mixed = F.transform(
        F.col("llm_sentences"),
        lambda s, i: F.when(F.array_contains("_spot", i), F.element_at("human_sentences", F.element_at("_top", F.array_position("_spot", i).cast("int")) + 1)).otherwise(s),
    )
    text = F.when(F.col("k") == 0, F.col("llm_continuation")).otherwise(join_sentences(mixed))
    return own.withColumn("text", text).withColumn("n_sentences", n).drop("llm_sentences", "human_sentences", "_top", "_spot", "costs")
