"""Near-duplicate records with small edits.

Rows become sets of hashed word sequences.  Two sets with a Jaccard similarity
of t or more must share one of their first n - ceil(t n) + 1 members under any
common order of all members.  With rare members first, those prefixes rarely
meet by chance.  The order comes from a count sketch of fixed size over all
rows, so nothing that grows with the data is broadcast.  It keeps two counts of
each member and takes what they exceed the background of their cells by, so
rare members stay apart from frequent ones when every cell is full; it only
steers cost, never the result.

Of a frequent member's list, first only the pairs with an anchor are compared;
what that links is one component.  What is left is cut by a second member:
alike sets that share two members or more also share a pair of members of
their prefixes, made longer by one.  Frequent members stand last in a prefix,
so they have few such pairs.  Candidates are verified on whole sets, and links
are chained by connected components.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.arrowmap import arrow_map, string_list
from scoreloom.llm.components import components
from scoreloom.llm.names import dataset_key
from scoreloom.llm.wordhash import U64, gram_rows, grams, hash_words, mix, slices
from scoreloom.runtime import Scratch

WORDS, SIMILARITY = 5, 0.8
#: Bits of a member; it is kept in BYTES bytes.
BITS, BYTES = 40, 5
#: Cells of the count sketch, half of them for each count: its size in bytes on an executor, at any size of the data.
CELLS = 1 << 22
CHUNKS = 16
#: Grades for each doubling of an excess: 255 grades reach 2^42.
GRADES = 6
#: Lists of members with a greater excess, and of more than NOISE deviations of the background, are cut by a second member.
HOT, NOISE = 256, 4
#: Entries of lists that are compared at a time, of one task, of one shipment of a task, and of a block of a list still long after that; and pairs held at a time.
BUCKET, TASK, SHIPMENT, BLOCK = 400_000, 3_200_000, 1_000_000, 20_000
PAIRS_HELD = 2_000_000
#: Rows of a group that are paired with the whole group in one place.
PAIR_BLOCK = 2000
#: Bits of the map that keeps sets without candidates out of the verification.
MAP_BITS = 1 << 23
_TOKEN = U64((1 << BITS) - 1)


def pack(tokens: np.ndarray) -> np.ndarray:
    """Members as BYTES bytes each."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES]).reshape(-1)


def unpack(body: np.ndarray) -> np.ndarray:
    out = np.zeros((len(body) // BYTES, 8), dtype=np.uint8)
    out[:, :BYTES] = body.reshape(-1, BYTES)
    return out.view("<u8").reshape(-1)


def _binary(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, offsets) of a binary column without nulls."""
    column = batch.column(i)
    if pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary())
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def _binaries(body: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(body)])


def members(texts: list[str | None], salt: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct members of all texts, offsets); the salt keeps texts of different kinds apart."""
    h, offsets = hash_words(texts)
    row, at = gram_rows(offsets, words)
    token = mix(grams(h, words)[at] ^ salt[row]) & _TOKEN
    out, ends = [], np.zeros(len(texts) + 1, dtype=np.int64)
    for a in range(0, len(texts), 1 << 16):
        b = min(a + (1 << 16), len(texts))
        lo, hi = np.searchsorted(row, [a, b])
        key = np.unique(((row[lo:hi] - a).astype(U64) << U64(BITS)) | token[lo:hi])
        ends[a + 1 : b + 1] = np.bincount((key >> U64(BITS)).astype(np.int64), minlength=b - a)
        out.append(key & _TOKEN)
    return np.concatenate(out) if out else np.empty(0, dtype=U64), np.cumsum(ends)


_SETS = "kind int, id bigint, sig bigint, n bigint, body binary"
_SETS_NAMES = ["kind", "id", "sig", "n", "body"]
_SETS_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _make_sets(words: int, least: int, cells: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of kind 0 with their set (null if this batch has it already), and at the end of a task its part of the sketch as rows of kind 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, dtype=np.uint32)
        for batch in batches:
            texts, keys = string_list(batch, "text"), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            for a, b in slices(texts):
                token, at = members(texts[a:b], keys[a:b], words)
                size = np.diff(at)
                keep = size >= max(least, 1)
                if not keep.any():
                    continue
                inside = np.repeat(keep, size)
                token, size = token[inside], size[keep]
                at = np.concatenate([[0], np.cumsum(size)])
                for part, at_cell in zip(np.split(counts, 2), cells_of(token, cells)):
                    part += np.bincount(at_cell, minlength=cells // 2).astype(np.uint32)
                begin = at[:-1]
                sig = mix(np.add.reduceat(mix(token + U64(1)), begin) ^ (keys[a:b][keep] * U64(3))).view(np.int64)
                new = np.zeros(len(sig), dtype=bool)
                new[np.unique(sig, return_index=True)[1]] = True
                body_at = np.concatenate([[0], np.cumsum(np.where(new, size, 0) * BYTES)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.zeros(len(sig), dtype=np.int32)), batch.column(0).slice(a, b - a).filter(pa.array(keep)), pa.array(sig),
                        pa.array(size), _binaries(pack(token[np.repeat(new, size)]), body_at),
                    ],
                    names=_SETS_NAMES,
                )
        if counts.any():
            for i, part in enumerate(np.split(counts, CHUNKS)):
                body = pa.compress(part.tobytes(), "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((1, i, None, None, body), _SETS_TYPES)], names=_SETS_NAMES)

    return run


def cells_of(token: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each member, both counted from 0 in a half of the sketch of their own."""
    half = U64(cells // 2)
    return (token % half).astype(np.int64), ((token >> U64(19)) % half).astype(np.int64)


def _sum_sketch(cells: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, body, noise): adds up the parts of each chunk as they stream by, and brings counts to one byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        size = cells // CHUNKS
        for batch in batches:
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(pa.decompress(body, size * 4, "zstd"), dtype=np.uint32)
                total[i] = total[i] + part if i in total else part.astype(np.uint64)
        for i, x in total.items():
            grades, noise = to_grades(x)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([grades.tobytes()], pa.binary()), pa.array([noise])], names=["id", "body", "noise"])

    return run


def grade_of(excess: np.ndarray | float) -> np.ndarray:
    return np.minimum(255, 1 + np.floor(GRADES * np.log2(1 + np.asarray(excess, dtype=np.float64)))).astype(np.uint8)


def to_grades(count: np.ndarray) -> tuple[np.ndarray, float]:
    """(grades, deviation of the background): 0 for members that no other row has, else by the excess over the median cell."""
    count = count.astype(np.float64)
    low, middle = np.quantile(count, [0.16, 0.5])
    return np.where(count < 2, 0, grade_of(np.maximum(count - middle, 0.0))).astype(np.uint8), float(middle - low)


def grades(token: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The lesser of the two grades of each member."""
    a, b = np.split(sketch, 2)
    i, j = cells_of(token, len(sketch))
    return np.minimum(a[i], b[j])


def _prefix(n: np.ndarray, share: float) -> np.ndarray:
    return (n - np.ceil(share * n - 1e-9) + 1).astype(np.int64)


def _ordered(sets: np.ndarray, at: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first set, sizes, set, member, rank in the common order, grade) of some thousand sets at a time."""
    token = unpack(sets)
    at = at // BYTES
    for a in range(0, len(at) - 1, 1 << 15):
        b = min(a + (1 << 15), len(at) - 1)
        own = token[at[a] : at[b]]
        size = np.diff(at[a : b + 1])
        row = np.repeat(np.arange(b - a), size)
        key = np.sort((row.astype(U64) << U64(48)) | (grades(own, sketch).astype(U64) << U64(BITS)) | own)
        rank = np.arange(len(key)) - np.repeat(at[a:b] - at[a], size)
        yield a, size, row, key & _TOKEN, rank, ((key >> U64(BITS)) & U64(0xFF)).astype(np.int64)


def _joined(outs: list[tuple[np.ndarray, ...]], width: int) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*outs)) if outs else (np.empty(0, dtype=np.int64),) * width


def _postings(sets: np.ndarray, at: np.ndarray, sketch: np.ndarray, t: float) -> tuple[np.ndarray, ...]:
    """(set, member, rank in the common order, grade) of the members in each set's prefix that others may have too."""
    outs = []
    for first, size, row, token, rank, g in _ordered(sets, at, sketch):
        keep = (rank < np.repeat(_prefix(size, t), size)) & (g > 0)
        outs.append((row[keep] + first, token[keep], rank[keep], g[keep]))
    return _joined(outs, 4)


def _second_members(sets: np.ndarray, at: np.ndarray, sketch: np.ndarray, t: float, hot: int) -> tuple[np.ndarray, ...]:
    """(set, key, rank) of the frequent members in each set's prefix, cut by a second member.

    Let w be the first member that two alike sets share, at rank k of one of n
    members.  At least ceil(t n) - 1 of the n - k - 1 members behind it are
    shared, too, so one of the next n - ceil(t n) + 1 - k is, if any must be.
    Sets that may be alike by w alone have it as a key of its own.
    """
    outs = []
    for first, size, row, token, rank, g in _ordered(sets, at, sketch):
        upto = _prefix(size, t)
        i = np.flatnonzero((rank < np.repeat(upto, size)) & (g > hot))
        more = np.minimum(upto, size - 1)[row[i]] - rank[i]
        j = np.repeat(i + 1, more) + np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
        w = np.repeat(i, more)
        outs.append((row[w] + first, mix(token[w] * U64(0x9E3779B97F4A7C15) ^ token[j]), rank[w]))
        alone = i[(size - upto + 1)[row[i]] <= 1]
        outs.append((row[alone] + first, mix(token[alone] * U64(0x9E3779B97F4A7C15)), rank[alone]))
    return _joined(outs, 3)


_LISTS = "bucket bigint, body binary"


def _send(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket: its entries, column by column."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist() + [len(bucket)]
    columns = [c[order] for c in columns]
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        planes = [np.ascontiguousarray(c[a:b].astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
        rows.append((int(bucket[a]), (b - a).to_bytes(8, "little") + pa.compress(b"".join(planes), "zstd", asbytes=True)))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary()))], names=["bucket", "body"])


def _receive(body: bytes, columns: int) -> list[np.ndarray]:
    n = int.from_bytes(body[:8], "little")
    planes = np.frombuffer(pa.decompress(body[8:], n * 8 * columns, "zstd"), dtype=np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(p.T).view("<u8").reshape(-1) for p in planes]


def _per_bucket(columns: int, fn: Callable[[int, list[np.ndarray]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Calls ``fn`` with the entries of one bucket after another of rows sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for bucket, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != now and parts:
                    yield from fn(now, [np.concatenate(c) for c in zip(*parts)])
                    parts = []
                now = bucket
                parts.append(_receive(body, columns))
        if parts:
            yield from fn(now, [np.concatenate(c) for c in zip(*parts)])

    return run


_PAIRS = "a bigint, b bigint"


def _pairs_out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _possible(n1: np.ndarray, k1: np.ndarray, n2: np.ndarray, k2: np.ndarray, t: float) -> np.ndarray:
    """Whether sets of these sizes whose first common member has these ranks can be alike."""
    swap = n1 > n2
    ns, ks, nl, kl = np.where(swap, n2, n1), np.where(swap, k2, k1), np.where(swap, n1, n2), np.where(swap, k1, k2)
    need = np.ceil(t / (1 + t) * (ns + nl) - 1e-9)
    return (ns >= t * nl - 1e-9) & (ks < _prefix(ns, 2 * t / (1 + t))) & (kl < _prefix(nl, t)) & (np.minimum(ns - ks, nl - kl) >= need)


def _compare(t: float, star: bool, merged: bool = False) -> Callable[[int, list[np.ndarray]], Iterator[pa.RecordBatch]]:
    """Candidates among the entries of a bucket that share a member.

    ``star``: of each list, only pairs with its anchor, the entry of least
    size.  ``merged``: only pairs of different components, and if ``bucket`` is
    1, of different blocks.
    """

    def run(bucket: int, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, sig, n, k = columns[0], columns[1].view(np.int64), columns[2].astype(np.int64), columns[3].astype(np.int64)
        comp, own = (columns[4], columns[5]) if merged else (sig, None)
        order = np.lexsort((n, comp, token) if merged else (sig, n, token))
        token, sig, n, k, comp = token[order], sig[order], n[order], k[order], comp[order]
        first = np.flatnonzero(np.diff(token, prepend=~token[:1]) != 0)
        size = np.diff(np.append(first, len(token)))
        if star:
            i, j = np.repeat(first, size), np.arange(len(token))
            hit = (i != j) & (sig[i] != sig[j])
            i, j = i[hit], j[hit]
            hit = _possible(n[i], k[i], n[j], k[j], t)
            if hit.any():
                yield _pairs_out(sig[i[hit]], sig[j[hit]])
            return
        # Partners of an entry are those behind it in its list, or behind its component there.
        after = np.arange(1, len(token) + 1)
        if merged:
            own = own[order]
            run_at = np.flatnonzero((np.diff(token, prepend=~token[:1]) != 0) | (np.diff(comp, prepend=comp[:1]) != 0))
            run_size = np.diff(np.append(run_at, len(token)))
            after = np.repeat(run_at + run_size, run_size)
        left = np.repeat(first + size, size) - after
        done = np.concatenate([[0], np.cumsum(left)])
        begin = 0
        while begin < len(token):
            end = max(begin + 1, int(np.searchsorted(done, done[begin] + PAIRS_HELD, side="right")) - 1)
            many = left[begin:end]
            i = np.repeat(np.arange(begin, end), many)
            j = np.repeat(after[begin:end], many) + np.arange(len(i)) - np.repeat(done[begin:end] - done[begin], many)
            hit = sig[i] != sig[j]
            if merged and bucket:
                hit &= own[i] != own[j]
            i, j = i[hit], j[hit]
            hit = _possible(n[i], k[i], n[j], k[j], t)
            if hit.any():
                pair = np.unique(np.stack([np.minimum(sig[i[hit]], sig[j[hit]]), np.maximum(sig[i[hit]], sig[j[hit]])], axis=1), axis=0)
                yield _pairs_out(pair[:, 0], pair[:, 1])
            begin = end

    return run


def _verify(t: float) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        (x, xa), (y, ya) = _binary(batch, 2), _binary(batch, 3)
        pairs = batch.num_rows
        for a in range(0, pairs, 2000):
            b = min(a + 2000, pairs)
            nx, ny = np.diff(xa[a : b + 1]) // BYTES, np.diff(ya[a : b + 1]) // BYTES
            key = [
                (np.repeat(np.arange(b - a, dtype=U64), n) << U64(BITS)) | unpack(body[at[a] : at[b]])
                for n, body, at in ((nx, x, xa), (ny, y, ya))
            ]
            both = np.sort(np.concatenate(key))
            same = both[1:][both[1:] == both[:-1]]
            shared = np.bincount((same >> U64(BITS)).astype(np.int64), minlength=b - a)
            alike = shared >= t * (nx + ny - shared) - 1e-9
            if alike.any():
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a).filter(pa.array(alike)) for c in (0, 1)], names=["a", "b"])

    return run


class NearCopies:
    """Groups of near copies; see the module's text.

    Rows with a null key or fewer than ``least`` distinct members are alike to
    none.  Equal sets are one node from the first shuffle on.
    """

    def __init__(self, rows: DataFrame, key: F.Column, words: int = WORDS, similarity: float = SIMILARITY, least: int = 1, id_col: str = "row_id", text_col: str = "text", cells: int = CELLS, hot: int = HOT, block: int = BLOCK):
        self.scratch = Scratch(rows.sparkSession, "nearcopies")
        self.t, self.cells, self.hot, self.block = similarity, cells, hot, block
        self.spark = rows.sparkSession
        source = rows.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(key).alias("key"), F.col(text_col).alias("text")).filter(key.isNotNull() & F.col(text_col).isNotNull())
        self.all = self.scratch.save(source.mapInArrow(_make_sets(words, least, cells), _SETS), compression="uncompressed")
        self.rows = self.all.filter("kind = 0").select("id", "sig")
        self.sets = self.all.filter("kind = 0 and length(body) > 0").select("sig", "n", "body")

    def _sketch(self) -> tuple[np.ndarray, int]:
        """(grades of all cells, the grade above which a member is frequent): ``cells`` bytes, whatever the data's size."""
        parts = self.all.filter("kind = 1").select("id", "body").repartition(CHUNKS, "id").mapInArrow(_sum_sketch(self.cells), "id bigint, body binary, noise double")
        out, noise = np.zeros(self.cells, dtype=np.uint8).reshape(CHUNKS, -1), 0.0
        for r in parts.collect():
            out[r.id] = np.frombuffer(r.body, dtype=np.uint8)
            noise = max(noise, r.noise)
        return out.reshape(-1), int(grade_of(max(self.hot, NOISE * noise)))

    def _lists(self, sent: Broadcast, hot: int, buckets: int) -> DataFrame:
        t = self.t

        def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            body, at = _binary(batch, 2)
            row, token, rank, g = _postings(body, at, sent.value, t)
            sig, n = batch.column(0).to_numpy().view(U64), batch.column(1).to_numpy().astype(U64)
            bucket = (token % U64(buckets)).astype(np.int64)
            # A frequent member's list is cut into blocks, in buckets of their own, each with an anchor.
            blocks = np.maximum(1, np.ceil(np.exp2((g - 1) / GRADES) / BUCKET * 4)).astype(U64)
            block = (sig[row] % blocks).astype(np.int64) if len(row) else row
            bucket = np.where(g > hot, -1 - (bucket + (mix(token ^ U64(7)) % U64(1 << 20)).astype(np.int64) * block), bucket)
            return bucket, token, sig[row] if len(row) else row.astype(U64), n[row] if len(row) else row.astype(U64), rank.astype(U64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, ...]] = []
            size = 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                held.append(entries(batch))
                size += len(held[-1][0])
                if size >= SHIPMENT:
                    bucket, *columns = (np.concatenate(c) for c in zip(*held))
                    yield from _send(bucket, columns)
                    held, size = [], 0
            if size:
                bucket, *columns = (np.concatenate(c) for c in zip(*held))
                yield from _send(bucket, columns)

        return self.sets.mapInArrow(run, _LISTS)

    def candidates_hot(self, sent: Broadcast, hot: int, comps: DataFrame) -> DataFrame:
        """Candidates of frequent members' lists between different components.

        Lists are counted before they meet: those of one component or one entry
        drop out, those of more than ``block`` entries are cut into blocks, and
        two blocks meet in a place of their own.
        """
        t = self.t

        def explode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            body, at = _binary(batch, 2)
            row, key, rank = _second_members(body, at, sent.value, t, hot)
            for a in range(0, len(row), SHIPMENT):
                of = pa.array(row[a : a + SHIPMENT])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[a : a + SHIPMENT].view(np.int64)), batch.column(0).take(of), batch.column(1).take(of), pa.array(rank[a : a + SHIPMENT])], names=["key", "sig", "n", "k"]
                )

        entries = arrow_map(self.sets, explode, "key bigint, sig bigint, n bigint, k bigint").join(comps, F.col("sig") == F.col("node"), "left")
        entries = self.scratch.save(entries.select("key", "sig", "n", "k", F.coalesce("component", "sig").alias("comp")).dropDuplicates(["key", "sig"]))
        lists = entries.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("_a"), F.max("comp").alias("_z")).filter("_a < _z")
        blocks = F.ceil(F.col("size") / F.lit(self.block)).cast("int")
        cut = entries.join(lists.select("key", blocks.alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = cut.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "key", "sig", "n", "k", "comp", "own")
        compare = _compare(t, star=False, merged=True)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, parts = None, []

            def done() -> Iterator[pa.RecordBatch]:
                _, key, sig, n, k, comp, own = (np.concatenate(c) for c in zip(*parts))
                if comp.min() != comp.max():
                    yield from compare(int(own.min() != own.max()), [key.view(U64), sig.view(U64), n.view(U64), k.view(U64), comp, own])

            for batch in batches:
                columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
                if not batch.num_rows:
                    continue
                # Whole cells of a batch are compared together; the last one may go on in the next batch.
                last = int(np.searchsorted(columns[0], columns[0][-1]))
                if parts and columns[0][0] != now:
                    yield from done()
                    parts = []
                if last and columns[0][0] == now and parts:
                    end = int(np.searchsorted(columns[0], now, side="right"))
                    parts.append([c[:end] for c in columns])
                    yield from done()
                    parts = []
                    columns = [c[end:] for c in columns]
                    last -= end
                if last:
                    cells_, key, sig, n, k, comp, own = (c[:last] for c in columns)
                    for split in (False, True):
                        # Cells of one block hold all pairs, those of two only pairs between them.
                        of, at = np.unique(cells_, return_index=True)
                        two = np.repeat(np.maximum.reduceat(own, at) != np.minimum.reduceat(own, at), np.diff(np.append(at, last)))
                        pick = two == split
                        if pick.any():
                            yield from compare(int(split), [mix(key[pick].view(U64) ^ mix(cells_[pick].view(U64))), sig[pick].view(U64), n[pick].view(U64), k[pick].view(U64), comp[pick], own[pick]])
                now = columns[0][-1]
                parts.append([c[last:] for c in columns])
            if parts:
                yield from done()

        return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, _PAIRS)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of the candidates that are alike, by their whole sets."""
        pairs = self.scratch.save(pairs.filter("a <> b").distinct())
        node = F.pmod(F.col("s"), F.lit(MAP_BITS - 1)) + 1
        marks = (
            pairs.select(F.explode(F.array("a", "b")).alias("s")).groupBy(F.bitmap_bucket_number(node).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(node)).alias("bits")).collect()
        )
        bits = np.zeros(MAP_BITS // 8 + 4096, dtype=np.uint8)
        for r in marks:
            bits[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, dtype=np.uint8)
        sent = self.spark.sparkContext.broadcast(bits)

        def wanted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            # bitmap_bucket_number gives 1 + (s - 1) / 32768 and bitmap_bit_position the remainder, for s above 0.
            s = np.mod(batch.column(0).to_numpy(), MAP_BITS - 1)
            hit = (sent.value[s // 8] >> (s % 8)) & 1 > 0
            if hit.any():
                yield batch.filter(pa.array(hit))

        some = arrow_map(self.sets.select("sig", "body"), wanted, "sig bigint, body binary").groupBy("sig").agg(F.min("body").alias("body"))
        some = self.scratch.save(some, compression="uncompressed")
        whole = pairs.join(some.select(F.col("sig").alias("a"), F.col("body").alias("x")), "a").join(some.select(F.col("sig").alias("b"), F.col("body").alias("y")), "b")
        links = self.scratch.save(arrow_map(whole.select("a", "b", "x", "y"), _verify(self.t), _PAIRS))
        self.scratch.drop(pairs)
        self.scratch.drop(some)
        sent.destroy()
        return links

    def groups(self) -> DataFrame:
        """(id, group): the group of every row that has a near copy; the group is its smallest id."""
        total = self.sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not total:
            return self.rows.select("id", F.col("id").alias("group"), F.lit(0).cast("long").alias("rows")).limit(0)
        sketch, hot = self._sketch()
        sent = self.spark.sparkContext.broadcast(sketch)
        buckets = max(12, math.ceil(total / BUCKET))
        tasks = max(min(buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), math.ceil(total / TASK))
        lists = self._lists(sent, hot, buckets).repartition(tasks, "bucket").sortWithinPartitions("bucket")
        full, star = _compare(self.t, star=False), _compare(self.t, star=True)
        either = lambda bucket, columns: star(bucket, columns) if bucket < 0 else full(bucket, columns)
        links = [self.verified(lists.mapInArrow(_per_bucket(4, either), _PAIRS))]
        comps = self.scratch.save(components(links[0].select(F.col("a").alias("u"), F.col("b").alias("v")), self.scratch))
        if int(sketch.max()) > hot:
            links.append(self.verified(self.candidates_hot(sent, hot, comps)))
            if links[-1].head(1):
                every = reduce(DataFrame.unionByName, links)
                comps = components(every.select(F.col("a").alias("u"), F.col("b").alias("v")), self.scratch)
        self.links = links
        placed = self.rows.join(comps, self.rows.sig == comps.node, "left").select("id", F.coalesce("component", "sig").alias("c"))
        placed = self.scratch.save(placed)
        sizes = placed.groupBy("c").agg(F.min("id").alias("group"), F.count("*").alias("rows")).filter("rows > 1")
        return placed.join(sizes, "c").select("id", "group", "rows")


#: The project's rule: three words, half of the sequences, at least forty of them.
RULE = {"words": 3, "similarity": 0.5, "least": 40}


def near_copies(rows: DataFrame) -> DataFrame:
    """(row_id, group_row_id, group_rows) of every row of ``clean`` that has a near copy in its dataset.

    Null datasets, null texts and texts of fewer than 40 distinct three-word
    sequences have none; exact copies are near copies; an empty table gives no
    rows.
    """
    groups = NearCopies(rows, dataset_key(F.col("dataset")), **RULE).groups()
    return groups.select(F.col("id").alias("row_id"), F.col("group").alias("group_row_id"), F.col("rows").alias("group_rows"))


def near_copy_pairs(rows: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b), row_id_a < row_id_b: all pairs of a group, as the project asks for.

    A large group's rows are cut into blocks that each meet the whole group in
    a place of their own, so no task pairs more than PAIR_BLOCK rows with one.
    """
    groups = Scratch(rows.sparkSession, "nearcopies").save(near_copies(rows))
    blocks = F.ceil(F.col("group_rows") / F.lit(PAIR_BLOCK)).cast("int")
    a = groups.select("group_row_id", F.pmod(F.xxhash64("row_id"), blocks).cast("int").alias("block"), F.col("row_id").alias("row_id_a"))
    b = groups.select("group_row_id", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("row_id").alias("row_id_b"))
    return a.join(b, ["group_row_id", "block"]).filter("row_id_a < row_id_b").select("row_id_a", "row_id_b")
