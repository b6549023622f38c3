"""Vectorised word hashing shared by the text operators.

A batch of texts is one array of code points; words (runs of letters and
digits, case ignored, canonical composition applied) are found by comparing a
class array with its neighbour, and every word gets a 64-bit hash from one
segmented sum.  Nothing here runs per character in Python.
"""

from __future__ import annotations

import ctypes
import sys
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

U64 = np.uint64
#: Odd multiplier of the polynomial and of the finaliser.
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Texts are handled in slices of about this many code points, so that a batch
#: of very long texts needs no more memory than one of short ones.
SLICE_CHARS = 1_500_000


def keep_freed_memory() -> None:
    """Lets the C library keep freed arrays instead of giving them back and faulting every page in anew; a no-op elsewhere."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
        mallopt(-3, 1 << 29)  # M_MMAP_THRESHOLD
        mallopt(-1, 1 << 29)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        pass


keep_freed_memory()


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: a bijection whose output bits all depend on all input bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xA0761D6478BD642F)
    x ^= x >> U64(32)
    return x


@lru_cache(maxsize=1)
def word_table() -> np.ndarray:
    """1 for each code point that is a letter or a digit."""
    return np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), dtype=np.bool_, count=sys.maxunicode + 1)


@lru_cache(maxsize=1)
def _code_values() -> np.ndarray:
    return mix(np.arange(1, sys.maxunicode + 2, dtype=U64) * U64(_BASE))


@lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    out = np.empty(n, dtype=U64)
    x = 1
    for i in range(n):
        out[i] = x
        x = x * _BASE & _MASK
    return out


def normal(text: str | None) -> str:
    """The form in which words are compared: NFC, case folded to lower; null is empty."""
    if not text:
        return ""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).lower())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def slices(texts: Sequence[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` characters together (one row at least)."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def hash_words(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets): the words of text i are hashes[offsets[i]:offsets[i+1]].

    A null, empty or word-free text has no words.
    """
    parts = [normal(t) for t in texts]
    cp = code_points("\n".join(parts) + "\n")
    starts_text = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts_text[1:])
    inside = word_table()[cp]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[0::2], edge[1::2]
    if not len(begin):
        return np.empty(0, dtype=U64), np.zeros(len(parts) + 1, dtype=np.int64)
    size = end - begin
    at = np.flatnonzero(inside)
    first = np.zeros(len(begin), dtype=np.int64)
    np.cumsum(size[:-1], out=first[1:])
    inner = np.arange(len(at), dtype=np.int64) - np.repeat(first, size)
    longest = int(size.max())
    power = _powers(1 << max(6, (longest - 1).bit_length()))
    value = _code_values()[cp[at]] * power[inner]
    h = mix(np.add.reduceat(value, first) ^ (size.astype(U64) << U64(48)))
    return h, np.searchsorted(begin, starts_text)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words; entry i covers words i..i+n-1 (texts are not separated here)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, dtype=U64)
    out = h[:m].copy()
    for k in range(1, n):
        out = out * U64(0x9FB21C651E98DF25) + h[k : k + m]
    return mix(out)


def gram_rows(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index into ``grams``) of the n-grams that lie inside one text."""
    count = np.maximum(np.diff(offsets) - n + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    before = np.zeros(len(count), dtype=np.int64)
    np.cumsum(count[:-1], out=before[1:])
    return row, offsets[:-1][row] + np.arange(len(row)) - before[row]
