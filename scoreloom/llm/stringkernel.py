"""Support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two sentences sums, over the subsequences of three to six symbols
that both have, the product of their weights; a subsequence with a gap inside
counts GAP as much as one without, so an inserted or missing character costs
little.  Sentences are scaled by the root of their length.

The feature space is finite (subsequences hashed to DIMENSIONS slots), so the
machine's decision, a weighted sum of kernels with the landmarks, is itself one
vector of weights over subsequences.  ``compiled`` gives that vector: scoring a
sentence takes one look-up per subsequence, whatever the number of landmarks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

DIMENSIONS = 1 << 18
GAP = 0.6
#: Sentences whose features are held at a time while a machine is fitted.
CHUNK = 1000
#: The subsequences, as places of their symbols.
SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4), (0, 1, 2, 3, 4), (0, 1, 2, 3, 4, 5))
PAD = SHAPES[-1][-1]
#: Odd multipliers, one for each length, so that subsequences of different lengths share slots by chance only.
_ODD = {3: np.uint32(0x9E3779B1), 4: np.uint32(0x85EBCA77), 5: np.uint32(0xC2B2AE3D), 6: np.uint32(0x27D4EB2F)}
_SHIFT = np.uint32(32 - 18)


def weight(shape: tuple[int, ...]) -> float:
    return 1.0 if shape[-1] == len(shape) - 1 else GAP


def padded(s: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols with PAD blanks behind each sentence, beginnings): no subsequence of a sentence reaches into the next one."""
    count = len(offsets) - 1
    out = np.zeros(len(s) + PAD * (count + 1), dtype=np.uint32)
    begin = offsets[:-1] + PAD * np.arange(count)
    out[np.arange(len(s)) + np.repeat(PAD * np.arange(count), np.diff(offsets))] = s
    return out, begin


def all_slots(x: np.ndarray) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """(shape, slot of the subsequence of this shape at every place but the last PAD); prefixes are shared."""
    n = len(x) - PAD
    five = np.uint32(5)
    known: dict[tuple[int, ...], np.ndarray] = {(0,): x[:n]}
    for shape in SHAPES:
        for k in range(2, len(shape) + 1):
            if shape[:k] not in known:
                y = known[shape[: k - 1]] << five
                y |= x[shape[k - 1] : shape[k - 1] + n]
                known[shape[:k]] = y
        slot = known[shape] * _ODD[len(shape)]
        slot >>= _SHIFT
        yield shape, slot


def features(s: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, slot, value), one entry for each slot a sentence has; values are scaled."""
    size = np.diff(offsets)
    if not len(s):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.float32)
    x, begin = padded(s, offsets)
    row = np.repeat(np.arange(len(size)), size)
    own = np.arange(len(s)) + PAD * row
    key = np.concatenate([(row << 18) | slot[own] for _, slot in all_slots(x)])
    value = np.repeat(np.array([weight(shape) for shape in SHAPES], dtype=np.float32), len(s))
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    value = np.add.reduceat(value, first)
    key = key[first]
    own = key >> 18
    return own, key & (DIMENSIONS - 1), (value / np.sqrt(size[own])).astype(np.float32)


def scores(s: np.ndarray, offsets: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Product of every sentence with a vector over slots."""
    size = np.diff(offsets)
    if not len(size):
        return np.empty(0)
    x, begin = padded(s, offsets)
    n = len(x) - PAD
    place, gapped, found = np.zeros(n, dtype=np.float32), np.zeros(n, dtype=np.float32), np.empty(n, dtype=np.float32)
    at = np.empty(n, dtype=np.intp)
    for shape, slot in all_slots(x):
        np.copyto(at, slot)
        np.take(vector, at, mode="clip", out=found)
        total = place if weight(shape) == 1.0 else gapped
        np.add(total, found, out=total)
    gapped *= np.float32(GAP)
    place += gapped
    done = np.zeros(n + 1)
    np.cumsum(place, dtype=np.float64, out=done[1:])
    return (done[begin + size] - done[begin]) / np.sqrt(size)


class Landmarks:
    """Features of the landmarks, arranged by slot for products with many sentences."""

    def __init__(self, s: np.ndarray, offsets: np.ndarray):
        self.n = len(offsets) - 1
        row, slot, value = features(s, offsets)
        order = np.argsort(slot, kind="stable")
        self.row, self.slot, self.value = row[order], slot[order], value[order]
        self.at = np.searchsorted(self.slot, np.arange(DIMENSIONS + 1))

    def kernel(self, s: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Kernel of each sentence with each landmark, CHUNK sentences at a time."""
        out = np.zeros((len(offsets) - 1, self.n), dtype=np.float64)
        for a in range(0, len(out), CHUNK):
            b = min(a + CHUNK, len(out))
            self._fill(out[a:b], s[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        return out

    def _fill(self, out: np.ndarray, s: np.ndarray, offsets: np.ndarray) -> None:
        row, slot, value = features(s, offsets)
        many = self.at[slot + 1] - self.at[slot]
        done = np.concatenate([[0], np.cumsum(many)])
        begin = 0
        while begin < len(row):
            end = max(begin + 1, int(np.searchsorted(done, done[begin] + 1_000_000, side="right")) - 1)
            m = many[begin:end]
            which = np.repeat(self.at[slot[begin:end]] - (done[begin:end] - done[begin]), m) + np.arange(int(m.sum()))
            cell = np.repeat(row[begin:end], m) * self.n + self.row[which]
            base = int(row[begin]) * self.n
            part = np.bincount(cell - base, weights=np.repeat(value[begin:end], m) * self.value[which])
            out.reshape(-1)[base : base + len(part)] += part
            begin = end

    def compiled(self, beta: np.ndarray) -> np.ndarray:
        """The vector whose product with a sentence is the beta-weighted sum of its kernels with the landmarks."""
        return np.bincount(self.slot, weights=self.value * beta[self.row], minlength=DIMENSIONS).astype(np.float32)


def whiten(k: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """K to the power -1/2."""
    w, u = np.linalg.eigh((k + k.T) / 2 + ridge * np.eye(len(k)))
    return (u / np.sqrt(np.maximum(w, ridge))) @ u.T


def fit_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 25) -> tuple[np.ndarray, float]:
    """(weights, bias) of the squared-hinge machine: minimises |w|^2 / 2 + sum of cost * max(0, 1 - y f)^2, by Newton steps on the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    reg = np.eye(x.shape[1])
    reg[-1, -1] = 1e-6
    active = None
    for _ in range(steps):
        now = y * (x @ w) < 1
        if active is not None and (now == active).all():
            break
        active = now
        xa, c = x[active], cost[active]
        w = np.linalg.solve(reg + 2 * (xa * c[:, None]).T @ xa, 2 * xa.T @ (c * y[active]))
    return w[:-1], float(w[-1])
