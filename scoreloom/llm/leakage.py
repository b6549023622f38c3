"""Evaluation texts inside training text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.arrowmap import arrow_map, string_list
from scoreloom.llm.wordhash import U64, gram_rows, grams, hash_words, mix, slices
from scoreloom.runtime import Scratch

#: Every shared stretch of STRETCH words is found: fingerprints are the least hash of each WINDOW consecutive K-grams, and K + WINDOW - 1 = STRETCH.
STRETCH = 6
K = 4
WINDOW = STRETCH - K + 1
MIN_SHARE = 0.4
#: Bits of the map of the items' fingerprints that keeps others out of the join: what an executor holds, whatever the number of items.
MAP_BITS = 1 << 25
#: A fingerprint of more documents is cut by document; the number grows with the data, so that at most FREQUENT fingerprints are.
MOST, FREQUENT = 100_000, 50_000


def winnow(h: np.ndarray, offsets: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word position, hash) of the fingerprints: the least k-gram hash of each window, rightmost on ties."""
    row, at = gram_rows(offsets, k)
    g = grams(h, k)[at]
    if len(g) < window:
        return row[:0], at[:0], g[:0]
    view = np.lib.stride_tricks.sliding_window_view(g, window)
    inside = row[: len(view)] == row[window - 1 :]
    pick = window - 1 - np.argmin(view[:, ::-1], axis=1)
    chosen = np.unique((np.arange(len(view)) + pick)[inside])
    return row[chosen], at[chosen], g[chosen]


def _fingerprints(rows: DataFrame, kept: np.ndarray | None) -> DataFrame:
    """(key, print) of the texts (key, text): each distinct fingerprint of a text once, or without a map each of its places; only those in the map."""
    sent = rows.sparkSession.sparkContext.broadcast(kept) if kept is not None else None

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = string_list(batch, "text")
        for a, b in slices(texts):
            row, _, g = winnow(*hash_words(texts[a:b]))
            if sent is not None:
                bit = (g % U64(MAP_BITS)).astype(np.int64)
                hit = (sent.value[bit >> 3] >> (bit & 7)) & 1 > 0
                row, g = row[hit], g[hit]
                order = np.lexsort((g, row))
                row, g = row[order], g[order]
                new = np.ones(len(g), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (g[1:] != g[:-1])
                row, g = row[new], g[new]
            if len(g):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + a)), pa.array(g.view(np.int64))], names=["key", "print"])

    return arrow_map(rows.select("key", "text"), run, "key bigint, print bigint")


def _counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts = string_list(batch, "item_text")
    for a, b in slices(texts):
        words = np.diff(hash_words(texts[a:b])[1])
        yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(words)], names=[*batch.schema.names, "item_words"])


def _print_map(prints: DataFrame) -> np.ndarray:
    """A bit for each fingerprint of the items, modulo MAP_BITS: of fixed size, and more items only set more bits."""
    place = F.pmod(F.col("print"), F.lit(MAP_BITS))
    marks = prints.groupBy(F.bitmap_bucket_number(place + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("bits")).collect()
    out = np.zeros(MAP_BITS // 8, dtype=np.uint8)
    for r in marks:
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


def _hits(docs: DataFrame, items: DataFrame, most: int) -> DataFrame:
    """(key, item_key, n): how many places of an item have a fingerprint that the document has, too.

    A fingerprint of more than ``most`` documents is cut by document, and the
    item's side repeated for each cut; ``most`` grows with the data, so at most
    FREQUENT fingerprints are.
    """
    total = docs.count()
    most = max(most, total // FREQUENT)
    often = docs.groupBy("print").count().filter(F.col("count") > most)
    often = docs.sparkSession.createDataFrame([tuple(r) for r in often.collect()], "print bigint, n bigint").select("print", F.ceil(F.col("n") / most).cast("int").alias("cuts"))
    cuts = F.coalesce("cuts", F.lit(1))
    left = docs.join(F.broadcast(often), "print", "left").select("key", "print", F.pmod(F.xxhash64("key"), cuts).cast("int").alias("cut"))
    right = items.join(F.broadcast(often), "print", "left").select(F.col("key").alias("item_key"), "print", F.explode(F.sequence(F.lit(0), cuts - 1)).alias("cut"))
    return left.join(right, ["print", "cut"]).groupBy("key", "item_key").agg(F.count("*").alias("n"))


def _extend(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Words of the item in stretches that the document has, for each candidate."""
    bodies, asked = string_list(batch, "text"), string_list(batch, "item_text")
    for a, b in slices(bodies):
        texts = {t: i for i, t in enumerate(dict.fromkeys(bodies[a:b]))}
        whose = np.array([texts[t] for t in bodies[a:b]], dtype=np.int64)
        h, at = hash_words(list(texts))
        row, place = gram_rows(at, STRETCH)
        there = np.unique(mix(row.astype(U64)) ^ grams(h, STRETCH)[place])
        h, at = hash_words(asked[a:b])
        row, place = gram_rows(at, STRETCH)
        own = mix(whose[row].astype(U64)) ^ grams(h, STRETCH)[place]
        start = place[np.isin(own, there)]
        mark = np.zeros(len(h) + 1, dtype=np.int64)
        np.add.at(mark, start, 1)
        np.add.at(mark, start + STRETCH, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(mark[:-1]) > 0)])
        shared, words = covered[at[1:]] - covered[at[:-1]], np.diff(at)
        yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (0, 1)), pa.array(shared), pa.array(words)], names=["doc_id", "item_id", "shared_words", "item_words"])


_FOUND = "doc_id bigint, item_id bigint, shared_words bigint, item_words bigint"


def leaks(docs: DataFrame, items: DataFrame, min_share: float = MIN_SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, item_id, shared_words, item_words) of each document that holds enough of an item.

    At least ``min_share`` of the item's words stand in the document in
    stretches of six or more words.  Fingerprints of both sides are joined, and
    the pairs with enough of them are extended on whole texts.  Documents are
    read twice, whatever the number of items: once for fingerprints, of which
    those in a map of fixed size go on, and once for the texts of candidates.
    Null and wordless texts match nothing; repeated document rows give repeated
    results, repeated items one; copies are cases of their own.
    """
    scratch = Scratch(docs.sparkSession, "leakage")
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").withColumn("key", F.xxhash64("doc_id", "text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).filter("item_id is not null and item_text is not null").distinct()
    asked = scratch.save(arrow_map(asked.withColumn("item_key", F.xxhash64("item_id", "item_text")), _counted, "item_id bigint, item_text string, item_key bigint, item_words bigint"))
    wanted = scratch.save(_fingerprints(asked.select(F.col("item_key").alias("key"), F.col("item_text").alias("text")), None))
    held = scratch.save(_fingerprints(body, _print_map(wanted)))
    # A shared stretch of n words has a fingerprint in each window, and one serves WINDOW windows at most.
    least = min_share / (STRETCH + WINDOW - 1)
    near = _hits(held, wanted, most).join(asked, "item_key")
    near = scratch.save(near.filter(F.col("n") >= least * F.col("item_words") - 1e-9).select("key", "item_id", "item_text"))
    whole = body.join(near, "key").select("doc_id", "item_id", "text", "item_text")
    found = arrow_map(whole, _extend, _FOUND)
    return found.filter((F.col("shared_words") > 0) & (F.col("shared_words") >= min_share * F.col("item_words") - 1e-9))


def leaked_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id)."""
    return leaks(docs, items).select("doc_id", "item_id")


def item_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, n_docs, max_share) of the items that leaked."""
    found = leaks(docs, items)
    return found.groupBy("item_id").agg(
        F.countDistinct("doc_id").alias("n_docs"), F.round(F.max(F.col("shared_words") / F.col("item_words")), 6).alias("max_share")
    )
