"""Repetition inside a single document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.arrowmap import arrow_map, string_list
from scoreloom.llm.wordhash import U64, gram_rows, grams, hash_words, slices

WORDS = 4
MIN_WORDS = 30
MIN_SHARE = 0.4


def repeated_words(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(words, repeated words) of each text.

    A word is repeated when a stretch of ``words`` or more words around it
    stood earlier in the same text; the first occurrence does not count.
    """
    return repeated(*hash_words(texts), words)


def repeated(h: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """``repeated_words`` of texts whose words are hashed already."""
    n = np.diff(offsets)
    row, at = gram_rows(offsets, words)
    g = grams(h, words)[at] ^ (row.astype(U64) * U64(0x9E3779B97F4A7C15))
    later = np.ones(len(g), dtype=bool)
    later[np.unique(g, return_index=True)[1]] = False
    mark = np.zeros(len(h) + 1, dtype=np.int32)
    np.add.at(mark, at[later], 1)
    np.add.at(mark, at[later] + words, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(mark[:-1]) > 0)])
    return n, covered[offsets[1:]] - covered[offsets[:-1]]


def repetition(rows: DataFrame, id_col: str = "row_id", text_col: str = "text", keep: tuple[str, ...] = (), words: int = WORDS) -> DataFrame:
    """(id, *keep, n_words, repeated_words, repeated_share) of every row.

    One pass without a shuffle.  Null, empty and wordless texts have 0 words
    and the share 0.0; texts of fewer than ``words`` words repeat nothing;
    repeated rows give repeated results; an empty table gives no rows.
    """
    kept = [F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keep))]
    small = rows.select(*kept)

    def measure(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = string_list(batch, "_text")
        for a, b in slices(texts):
            n, again = repeated_words(texts[a:b], words)
            share = again / np.maximum(n, 1)
            others = [c.slice(a, b - a) for i, c in enumerate(batch.columns) if i != 1]
            yield pa.RecordBatch.from_arrays([*others, pa.array(n, pa.int64()), pa.array(again, pa.int64()), pa.array(share)], names=names)

    names = ["_id", *(f"_k{i}" for i in range(len(keep))), "n_words", "repeated_words", "repeated_share"]
    types = dict(small.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in names[:-3]), "n_words bigint", "repeated_words bigint", "repeated_share double"])
    return arrow_map(small, measure, schema).toDF(id_col, *keep, *names[-3:])


def repetitive(rows: DataFrame, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """(row_id) of texts with at least ``min_words`` words of which at least ``min_share`` are repeated."""
    found = repetition(rows).filter((F.col("n_words") >= min_words) & (F.col("repeated_words") >= min_share * F.col("n_words") - 1e-9))
    return found.select("row_id")


def generator_means(rows: DataFrame) -> DataFrame:
    """(generator_model, n_rows, mean_repeated_share, repetitive_rows); a null model is a group of its own."""
    each = repetition(rows, keep=("generator_model",))
    hit = (F.col("n_words") >= MIN_WORDS) & (F.col("repeated_words") >= MIN_SHARE * F.col("n_words") - 1e-9)
    return each.groupBy("generator_model").agg(
        F.count("*").alias("n_rows"),
        F.round(F.avg("repeated_share"), 9).alias("mean_repeated_share"),
        F.sum(hit.cast("long")).alias("repetitive_rows"),
    )
