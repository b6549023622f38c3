"""Broken prompt and response pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.llm import pairrules as R
from scoreloom.llm.arrowmap import arrow_map, string_list
from scoreloom.llm.repetition import repeated
from scoreloom.llm.wordhash import hash_words, slices
from scoreloom.runtime import Scratch

#: A word whose end rate is below this ends no sentence; at a length limit the looser rate holds.
NEVER_ENDS, SELDOM_ENDS = 0.001, 0.05
#: Ends that are added to those counted, so that a rate is low only on evidence: by the counts alone a word without ends needs 200 occurrences.
DOUBT = 0.2
#: Occurrences without an end that grammar vouches for in words that can't end a sentence; counted ends outweigh them.
VOUCHED = 400
#: A length is a limit if surely SPIKE times as many of a generator's texts have it as the mean of the SIDE lengths on either side, surely meaning by SURE deviations of both counts.
SPIKE, SIDE, SURE = 5.0, 8, 3.0
#: Shorter texts are prefixes of others by chance, so only longer texts that answer the same prompt count for them.
PREFIX_WORDS = 5
#: Share of repeated words from which the last word tells nothing: a loop ends anywhere.
LOOP = 0.4


def _digits_alike(text: str | None) -> str:
    return R.re.sub(r"\d", "0", text) if text else ""


def _last_words(texts: list[str]) -> list[str]:
    """The last word of each whole text, however much stands behind it."""
    out = []
    for t in texts:
        end = len(t)
        while end and not t[end - 1].isalnum():
            end -= 1
        begin = end
        while begin and t[begin - 1].isalnum():
            begin -= 1
        out.append(_digits_alike(t[begin:end].lower()))
    return out


def word_ends(rows: DataFrame) -> DataFrame:
    """(word, n, ends): how often each frequent word stands in the texts, and how often it ends a sentence that is not the last.

    Counts are over all texts, digits alike; each batch sends one row per word.
    """

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = string_list(batch, "text")
        for a, b in slices(texts):
            n: R.Counter = R.Counter()
            ends: R.Counter = R.Counter()
            for t in texts[a:b]:
                if t:
                    low = _digits_alike(t.lower())
                    n.update(R.WORD.findall(low))
                    ends.update(_ENDING.findall(low))
            if n:
                words = list(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words), pa.array([n[w] for w in words], pa.int64()), pa.array([ends[w] for w in words], pa.int64())], names=["word", "n", "ends"]
                )

    each = arrow_map(rows.select("text"), count, "word string, n bigint, ends bigint")
    return each.groupBy("word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))


_ENDING = R.re.compile(r"([^\W_]+)[.!?…]+[\"'»”’)\]]*(?=\s+\S)")


def end_rates(counted: DataFrame) -> DataFrame:
    """(last, end_rate) of the words that seldom end a sentence, from (word, n, ends) and from grammar.

    Words that grammar vouches for are there whether they were counted or not.
    """
    known = counted.sparkSession.createDataFrame([(w,) for w in sorted(R.ENDLESS)], "known string")
    every = counted.join(F.broadcast(known), F.col("word") == F.col("known"), "full")
    n = F.coalesce("n", F.lit(0)) + F.when(F.col("known").isNotNull(), F.lit(VOUCHED)).otherwise(F.lit(0))
    rate = (F.coalesce("ends", F.lit(0)) + F.lit(DOUBT)) / n
    return every.select(F.coalesce("word", "known").alias("last"), rate.alias("end_rate")).filter(F.col("end_rate") < SELDOM_ENDS)


_JUDGED = "row_id bigint, generator_model string, n_words bigint, defect string, last string, code bigint, asked bigint, key string"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[tuple[int | None, int]] = set()
    for batch in batches:
        ids, models = batch.column(0), batch.column(3)
        texts, prompts = string_list(batch, "text"), string_list(batch, "prompt")
        for a, b in slices(texts):
            own, asked = texts[a:b], prompts[a:b]
            h, at = hash_words(own)
            words = np.diff(at)
            asked_h, asked_at = hash_words(asked)
            asked_words = np.diff(asked_at)
            votes, asked_votes = R.language_votes(h, at), R.language_votes(asked_h, asked_at)
            short = (words >= 0.5 * asked_words) & (3 * words <= 4 * asked_words + 6)
            loops = repeated(h, at)[1] >= LOOP * np.maximum(words, 1)
            last = [None if loop or not w else w for w, loop in zip(_last_words([t or "" for t in own]), loops)]
            defect: list[str | None] = []
            keys: list[str | None] = []
            for i, (t, p) in enumerate(zip(own, asked)):
                kind = key = None
                if R.is_empty(t):
                    kind = "empty"
                elif R.is_refusal(t, p):
                    kind = "refusal"
                elif short[i] and R.is_copy(t, p):
                    kind = "copied_prompt"
                elif p and _other_language(t, votes[i], p, asked_votes[i]):
                    kind = "other_language"
                elif R.stops_openly(t):
                    kind = "truncated"
                if kind != "empty":
                    key = R.without_end(t)
                defect.append(kind)
                keys.append(key or None)
            whose = [_code(p) if p and k else None for p, k in zip(asked, keys)]
            codes = [None if not k else _code(k) if w >= PREFIX_WORDS else _code(_answer(q, k)) if q is not None else None for k, w, q in zip(keys, words, whose)]
            # A task sends each key once for each prompt.
            fresh = [k if c is not None and not ((q, c) in seen or seen.add((q, c))) else None for q, c, k in zip(whose, codes, keys)]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(a, b - a), models.slice(a, b - a), pa.array(words, pa.int64()), pa.array(defect, pa.string()), pa.array(last, pa.string()),
                    pa.array(codes, pa.int64()), pa.array(whose, pa.int64()), pa.array(fresh, pa.string()),
                ],
                names=[c.split()[0] for c in _JUDGED.split(", ")],
            )


def _code(key: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _answer(asked: int, key: str) -> str:
    """A key that only answers to the same prompt have as their beginning."""
    return f"{asked} {key}"


def _other_language(text: str, votes: np.ndarray, prompt: str, asked: np.ndarray) -> bool:
    """Most of the text is in another language than the prompt."""
    here, n = R.language(votes, R.script_of(text))
    there, m = R.language(asked, R.script_of(prompt))
    if here is None or there is None or here == there:
        return False
    names = R.language_table()[0]
    same = int(votes[names.index(there)]) if there in names else 0
    return n >= 3 and n > 1.2 * same


_NEIGHBOURS = "code bigint, key string"


class Open:
    """The keys that may still be carried on, as sorted keys stream by.

    Keys that begin with a key stand right behind it, so those carried on by
    the present key are on a stack.  A key leaves it when one goes on inside
    its sentence, or when the keys that begin with it have gone by.
    """

    def __init__(self) -> None:
        self.stack: list[str] = []
        self.before: str | None = None

    def pass_by(self, key: str) -> list[str]:
        """The keys on the stack that this one carries on inside a sentence."""
        if key == self.before:
            return []
        while self.stack and not key.startswith(self.stack[-1]):
            self.stack.pop()
        found = [k for k in self.stack if R.goes_on(key[len(k) :])]
        if found:
            self.stack = [k for k in self.stack if k not in found]
        self.stack.append(key)
        self.before = key
        return found


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of keys in sorted order, the codes of those that a later key carries on inside a sentence.

    Keys needed for the seams go along: those still open at the end of the
    partition, and of those at its beginning enough to tell whether one carries
    a key of an earlier partition on.  The latter begin with the same letters
    as the first key; for each length of that common beginning, the first key
    and the first that goes on behind it tell.
    """
    own = Open()
    first: str | None = None
    length = 0
    gone = True
    names = [c.split()[0] for c in _NEIGHBOURS.split(", ")]
    for batch in batches:
        found: list[str] = []
        seams: list[str] = []
        for key in batch.column(0).to_pylist():
            if key == own.before:
                continue
            found += own.pass_by(key)
            if first is None:
                first, length = key, len(key)
                seams.append(key)
            elif length:
                now = min(length, _common(first, key))
                on = R.goes_on(key[now:])
                if now and (now < length or (on and not gone)):
                    seams.append(key)
                    gone = on
                length = now
        if found or seams:
            codes = [_code(k) for k in found]
            yield pa.RecordBatch.from_arrays([pa.array(codes + [None] * len(seams), pa.int64()), pa.array([None] * len(codes) + seams, pa.string())], names=names)
    if own.stack:
        yield pa.RecordBatch.from_arrays([pa.array([None] * len(own.stack), pa.int64()), pa.array(own.stack, pa.string())], names=names)


def _compare_seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = Open()
    for batch in batches:
        found = [_code(k) for key in batch.column(0).to_pylist() for k in own.pass_by(key)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["code"])


def shortened(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(code) of the keys that are the beginning of a longer one which goes on inside the sentence.

    Keys are sorted by ranges over the whole table and compared as they stream
    by.  The keys at the seams, a few of each partition, are compared the same
    way afterwards; one task streams them and holds only keys that are open.
    """
    parts = max(keys.rdd.getNumPartitions(), int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = keys.repartitionByRange(parts, "key").sortWithinPartitions("key")
    near = scratch.save(ordered.mapInArrow(_compare_neighbours, _NEIGHBOURS))
    seams = near.filter("key is not null").select("key").repartition(1).sortWithinPartitions("key")
    return near.filter("code is not null").select("code").unionByName(seams.mapInArrow(_compare_seams, "code bigint")).distinct()


def length_limits(judged: DataFrame) -> DataFrame:
    """(generator_model, n_words) at which a generator's texts pile up."""
    each = judged.filter("n_words > 0").groupBy("generator_model", "n_words").agg(F.count("*").alias("n"))
    near = W.partitionBy("generator_model").orderBy("n_words").rangeBetween(-SIDE, SIDE)
    beside = F.sum("n").over(near) - F.col("n")
    most = (beside + F.lit(SURE) * F.sqrt(beside + 1)) / F.lit(2 * SIDE)
    return each.withColumn("most", most).filter(F.col("n") - F.lit(SURE) * F.sqrt("n") >= SPIKE * F.col("most")).select("generator_model", "n_words")


def judge(rows: DataFrame) -> DataFrame:
    """(row_id, generator_model, defect) of every row; defect is null for usable pairs.

    In order of precedence: ``empty``, ``refusal``, ``copied_prompt``,
    ``other_language``, ``truncated``.  A null prompt is no defect and hides
    only the copy and language rules; a null text is empty; copies under other
    row_ids get the same result; an empty table gives no rows.  A text is
    truncated if it ends without an end mark or after an abbreviation, if its
    last word ends no sentences elsewhere, if a longer text carries it on
    inside the sentence (for texts of fewer than PREFIX_WORDS words one that
    answers the same prompt), or if it stops at a generator's length limit with a
    word that seldom ends sentences.
    """
    scratch = Scratch(rows.sparkSession, "pairs")
    small = rows.select("row_id", "text", "prompt", "generator_model")
    rates = scratch.save(end_rates(word_ends(small)))
    judged = scratch.save(small.mapInArrow(_judge, _JUDGED))
    keys = judged.filter("key is not null")
    # Saved, so that its size is known and a small one makes no shuffle of the keys.
    few = scratch.save(judged.filter((F.col("n_words") < PREFIX_WORDS) & F.col("code").isNotNull()).select("asked").distinct())
    answers = keys.join(few, "asked", "left_semi").select(F.concat_ws(" ", F.col("asked").cast("string"), "key").alias("key"))
    short = scratch.save(shortened(keys.select("key").unionByName(answers), scratch)).withColumn("short", F.lit(True))
    limits = scratch.save(length_limits(judged)).withColumnsRenamed({"generator_model": "_model", "n_words": "_words"}).withColumn("limit", F.lit(True))
    # Rows without a code or a last word get keys of their own that match nothing, else they would meet in one task.
    apart = F.xxhash64("row_id", "n_words")
    open_rows = judged.drop("key", "asked").withColumn("code", F.coalesce("code", apart)).withColumn("last", F.coalesce("last", F.concat(F.lit(" "), apart.cast("string"))))
    joined = open_rows.join(short, "code", "left").join(rates, "last", "left").join(
        limits, F.col("generator_model").eqNullSafe(F.col("_model")) & (F.col("n_words") == F.col("_words")), "left"
    )
    cut = F.col("short") | (F.col("end_rate") < NEVER_ENDS) | (F.col("limit") & (F.col("end_rate") < SELDOM_ENDS))
    return joined.select("row_id", "generator_model", F.coalesce("defect", F.when(cut, F.lit("truncated"))).alias("defect"))


def broken_pairs(rows: DataFrame) -> DataFrame:
    """(row_id, defect) of the rows whose text is no usable continuation."""
    return judge(rows).filter("defect is not null").select("row_id", "defect")


def defect_rates(rows: DataFrame) -> DataFrame:
    """(generator_model, defect, n_rows, share): defects by generator, ``none`` among them; shares are of the generator's rows."""
    each = judge(rows).groupBy("generator_model", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count("*").alias("n_rows"))
    whole = F.sum("n_rows").over(W.partitionBy("generator_model"))
    return each.withColumn("share", F.round(F.col("n_rows") / whole, 6))
