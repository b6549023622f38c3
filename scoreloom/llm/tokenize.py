"""Encoding of the whole corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import sys
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm.arrowmap import arrow_map, string_list
from scoreloom.llm.wordhash import code_points, slices

#: Place of the vocabulary files; the environment variable or the parameter of ``encode`` overrides it.
TOKENIZERS = os.environ.get("SCORELOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
#: Distinct pieces a worker remembers before it starts its memory afresh.
REMEMBERED = 400_000

# Classes of code points.
EDGE, LETTER, NUMBER, SPACE, OTHER, QUOTE, BLANK = range(7)
#: The white space of the pattern's \s, without U+0020.
WHITE = (0x9, 0xA, 0xB, 0xC, 0xD, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Endings that are cut off after an apostrophe.
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter(
        (kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), dtype=np.uint8, count=sys.maxunicode + 1
    )
    out[list(WHITE)] = SPACE
    out[0x20] = BLANK
    out[0x27] = QUOTE
    return out


@lru_cache(maxsize=1)
def step_table() -> np.ndarray:
    """1 where a piece begins, by the classes of the previous, this and the next code point.

    The pattern's automaton forgets all but the last class, so the transition
    function of every code point is constant in the state before it: the
    associative scan over their compositions is this one table look-up.  Only
    apostrophe endings reach further and are set afterwards.
    """
    out = np.zeros((7, 7, 7), dtype=bool)
    white, kind = {SPACE, BLANK}, {QUOTE: OTHER}
    for before in range(7):
        for this in range(7):
            for after in range(7):
                a, b, c = (kind.get(x, x) for x in (before, this, after))
                if a == EDGE:
                    begin = True
                elif b in white:
                    # A run of white space is one piece but for its last character before other text.
                    begin = a not in white or (c not in white and c != EDGE)
                else:
                    # One U+0020 goes with the run that follows it.
                    begin = a != BLANK and a != b
                out[before, this, after] = begin
    return out.reshape(-1)


def piece_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places where pieces begin; ``first`` holds the places where non-empty texts begin."""
    n = len(cp)
    kind = class_table()[cp]
    before = np.empty(n, dtype=np.uint16)
    before[0] = EDGE
    before[1:] = kind[:-1]
    before[first] = EDGE
    after = np.empty(n, dtype=np.uint16)
    after[-1] = EDGE
    after[:-1] = kind[1:]
    after[first[1:] - 1] = EDGE
    begin = step_table()[(before * 7 + kind) * 7 + after]
    # An apostrophe that begins a piece takes an ending with it, and the letters after that begin a new piece.
    quote = np.flatnonzero((kind == QUOTE) & begin)
    if len(quote):
        is_first = np.zeros(n + 3, dtype=bool)
        is_first[first] = True
        is_first[n:] = True
        tail = np.concatenate([cp, np.zeros(3, dtype=cp.dtype)])
        one, two = tail[quote + 1], tail[quote + 2]
        free = ~is_first[quote + 1]
        short = free & np.isin(one, [ord(c) for c in SHORT_ENDINGS])
        long = np.zeros(len(quote), dtype=bool)
        for a, b in LONG_ENDINGS:
            long |= free & ~is_first[quote + 2] & (one == ord(a)) & (two == ord(b))
        for hit, size in ((short, 1), (long, 2)):
            q = quote[hit]
            begin[q + 1] = False
            end = q + 1 + size
            end = end[(end < n)]
            begin[end[~is_first[end] & (kind[end] == LETTER)]] = True
    return np.flatnonzero(begin)


@lru_cache(maxsize=1)
def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in the vocabulary file: printable Latin-1 stands for itself, the rest goes from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


class Encoder:
    """Pieces to ids by cached pair merging, and back."""

    def __init__(self, vocabulary: bytes):
        model = json.loads(vocabulary)["model"]
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        raw = lambda s: bytes(byte_of[c] for c in s)
        self.ids = {raw(t): i for t, i in model["vocab"].items() if all(c in byte_of for c in t)}
        self.bytes = {i: t for t, i in self.ids.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat: list[int] = []
        self.offset: list[int] = [0]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the pair of least rank is merged first, the leftmost of equals; n log n for n bytes."""
        ids = [self.single[b] for b in piece]
        n = len(ids)
        if n == 1:
            return ids
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*self.merges[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
        heap = [(rank, i, new, ids[i], ids[i + 1]) for rank, new, i in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if found := self.merges.get((new, ids[k])):
                    heapq.heappush(heap, (found[0], i, found[1], new, ids[k]))
            if (h := left[i]) >= 0 and (found := self.merges.get((ids[h], new))):
                heapq.heappush(heap, (found[0], h, found[1], ids[h], new))
        return [x for x in ids if x >= 0]

    def _learn(self, piece: str) -> int:
        self.flat.extend(self.merge(piece.encode("utf-8", "surrogatepass")))
        self.offset.append(len(self.flat))
        self.slot[piece] = n = len(self.offset) - 2
        return n

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, id offsets of the texts, first code point of each piece, piece offsets of the texts)."""
        parts = [t or "" for t in texts]
        joined = "".join(parts)
        ends = np.cumsum([len(p) for p in parts]) if parts else np.zeros(0, dtype=np.int64)
        if not joined:
            none = np.zeros(len(parts) + 1, dtype=np.int64)
            return np.zeros(0, dtype=np.int32), none, np.zeros(0, dtype=np.int64), none
        begins = np.concatenate([[0], ends[:-1]])
        starts = piece_starts(code_points(joined), np.unique(begins[begins < ends]))
        if len(self.slot) > REMEMBERED:
            self.forget()
        at = starts.tolist()
        pieces = [joined[a:b] for a, b in zip(at, [*at[1:], len(joined)])]
        get, learn = self.slot.get, self._learn
        slots = [get(p) for p in pieces]
        if None in slots:
            slots = [learn(p) if (s := get(p)) is None else s for p in pieces]
        slot = np.array(slots, dtype=np.int64)
        offset, flat = np.array(self.offset, dtype=np.int64), np.array(self.flat, dtype=np.int32)
        size = offset[slot + 1] - offset[slot]
        done = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(offset[slot] - done[:-1], size) + np.arange(done[-1])]
        piece_at = np.concatenate([np.searchsorted(starts, begins), [len(starts)]])
        return ids, done[piece_at], starts - np.repeat(begins, np.diff(piece_at)), piece_at

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file on this machine."""
    with open(path, "rb") as f:
        return Encoder(f.read())


_loaded: dict[str, Encoder] = {}


def _shipped(spark: SparkSession, path: str) -> Callable[[], Encoder]:
    """Gives each worker one encoder of a vocabulary file that only the driver has to have; the file, of some megabytes, travels with the job."""
    with open(path, "rb") as f:
        body = f.read()
    name, sent = hashlib.sha1(body).hexdigest(), spark.sparkContext.broadcast(body)

    def get() -> Encoder:
        if name not in _loaded:
            _loaded[name] = Encoder(sent.value)
        return _loaded[name]

    return get


def vocabulary_path(folder: str | None = None, name: str = VOCABULARY) -> str:
    return os.path.join(folder or TOKENIZERS, name)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, offsets: bool = False) -> DataFrame:
    """(id, ids[, piece_starts]) of every row: ids without special tokens.

    An empty and a null text give an empty list; strings that look like special
    tokens are ordinary text.  ``piece_starts`` are the code points at which the
    pre-tokenised pieces begin.  One pass, no shuffle; texts are whole, and
    batches are cut into slices of bounded size, so long texts need no more
    memory than their own.  Repeated rows give repeated results.
    """
    get = _shipped(docs.sparkSession, path or vocabulary_path())
    small = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = get()
        texts = string_list(batch, "_text")
        for a, b in slices(texts):
            ids, id_at, starts, piece_at = own.encode(texts[a:b])
            out = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(id_at, pa.int32()), pa.array(ids, pa.int32()))]
            if offsets:
                out.append(pa.ListArray.from_arrays(pa.array(piece_at, pa.int32()), pa.array(starts, pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=["_id", "ids", "piece_starts"][: len(out)])

    schema = f"_id {dict(small.dtypes)['_id']}, ids array<int>" + ", piece_starts array<int>" * offsets
    return arrow_map(small, run, schema).withColumnRenamed("_id", id_col)


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text): the exact text of each list of ids; null ids give a null text."""
    get = _shipped(rows.sparkSession, path or vocabulary_path())
    small = rows.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = get()
        texts = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_id", "text"])

    return arrow_map(small, run, f"_id {dict(small.dtypes)['_id']}, text string").withColumnRenamed("_id", id_col)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(n_docs, n_same): documents, and those whose ids give the text back, a null text as an empty one."""
    back = decode(encode(docs, path=path), path=path).withColumnsRenamed({"doc_id": "_id", "text": "_back"})
    both = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(back, F.col("doc_id") == F.col("_id"))
    return both.agg(F.count("*").alias("n_docs"), F.sum((F.col("text") == F.col("_back")).cast("long")).alias("n_same"))
