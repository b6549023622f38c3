"""Percentiles of very large numeric columns from mergeable compactor hierarchies."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.names import dataset_key
from scoreloom.runtime import Scratch

FEATURES = ("logp_a", "rank_a", "logrank_a", "entropy_a", "logp_b", "cross_entropy_ba")
PERCENTILES = (1, 5, 25, 50, 75, 95, 99)
#: Size of the top compactor; lower ones shrink by SHRINK a level, down to LEAST.
K = 400
SHRINK = 2 / 3
LEAST = 8
#: A stated rank error is exceeded with at most this probability.
DELTA = 1e-6
#: Sketches a task holds before it sends them on and starts afresh.
HELD = 20_000
#: Tasks that share the sketches of one key in the first of two merges.
WAYS = 16


class Sketch:
    """A hierarchy of compactors: level h holds values that stand for 2**h each.

    A level above its size is sorted and every other value, from a random
    first or second, goes one level up.  A compaction at level h moves the rank
    of any value by 0 or, with equal chance, by plus or minus 2**h, so the
    squared weights of all compactions (``moved``) bound the error of a rank by
    Hoeffding's inequality; sketches of parts merge level by level and their
    ``moved`` add up.
    """

    __slots__ = ("n", "low", "high", "moved", "levels", "rng", "k")

    def __init__(self, seed: int = 0, k: int = K):
        self.n, self.low, self.high, self.moved, self.k = 0, math.inf, -math.inf, 0.0, k
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.rng = np.random.Generator(np.random.PCG64(seed))

    def _room(self, h: int) -> int:
        return max(LEAST, math.ceil(self.k * SHRINK ** (len(self.levels) - 1 - h)))

    def _settle(self) -> None:
        h = 0
        while h < len(self.levels):
            own = self.levels[h]
            if len(own) > self._room(h):
                if h + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                own = np.sort(own)
                odd = len(own) & 1
                keep, own = own[:odd], own[odd:]
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], own[int(self.rng.integers(2)) :: 2]])
                self.levels[h] = keep
                self.moved += 4.0**h
                h = -1 if h + 2 == len(self.levels) and h > 0 else h
            h += 1

    def add(self, values: np.ndarray) -> None:
        """Takes finite values."""
        if len(values):
            self.n += len(values)
            self.low, self.high = min(self.low, float(values.min())), max(self.high, float(values.max()))
            self.levels[0] = np.concatenate([self.levels[0], values])
            self._settle()

    def merge(self, other: Sketch) -> None:
        self.n += other.n
        self.moved += other.moved
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        while len(self.levels) < len(other.levels):
            self.levels.append(np.empty(0))
        for h, more in enumerate(other.levels):
            self.levels[h] = np.concatenate([self.levels[h], more])
        self._settle()

    def percentiles(self, at: Sequence[float]) -> list[float | None]:
        """The least kept value whose share of the weight reaches each percentile; the ends are exact."""
        if not self.n:
            return [None for _ in at]
        values = np.concatenate(self.levels)
        weight = np.concatenate([np.full(len(x), 1 << h, dtype=np.int64) for h, x in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        total = np.cumsum(weight[order])
        out = []
        for p in at:
            i = int(np.searchsorted(total, p / 100 * total[-1] - 1e-9))
            out.append(self.low if p <= 0 else self.high if p >= 100 else float(values[order][min(i, len(values) - 1)]))
        return out

    def rank_error(self, delta: float = DELTA) -> float:
        """Error of a rank as a share of n, exceeded with at most probability delta."""
        return math.sqrt(2 * self.moved * math.log(2 / delta)) / self.n if self.n else 0.0

    def pack(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], dtype=np.int64)
        return sizes.tobytes() + np.concatenate(self.levels).astype(np.float64).tobytes()

    @classmethod
    def unpack(cls, n: int, low: float, high: float, moved: float, body: bytes, seed: int, k: int = K) -> Sketch:
        out = cls(seed, k)
        out.n, out.low, out.high, out.moved = n, low, high, moved
        count = int(np.frombuffer(body, dtype=np.int64, count=1)[0])
        sizes = np.frombuffer(body, dtype=np.int64, count=count, offset=8)
        out.levels = np.split(np.frombuffer(body, dtype=np.float64, offset=8 * (count + 1)), np.cumsum(sizes)[:-1])
        return out


_KEYS = "dataset string, day date, feature string"
SCHEMA = f"{_KEYS}, n bigint, low double, high double, moved double, sketch binary"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _emit(held: dict[tuple, Sketch]) -> Iterator[pa.RecordBatch]:
    keys = list(held)
    for i in range(0, len(keys), 500):
        rows = [(*key, s.n, s.low, s.high, s.moved, s.pack()) for key in keys[i : i + 500] if (s := held[key]).n]
        if rows:
            columns = list(zip(*rows))
            types = [pa.string(), pa.date32(), pa.string(), pa.int64(), *[pa.float64()] * 3, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_NAMES)


def _seed(*parts: object) -> int:
    return zlib.crc32(repr(parts).encode())


def _partial(features: Sequence[str], k: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sketch] = {}
        part, turn = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            turn += 1
            name, day = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
            names, days = name.dictionary.to_pylist(), day.dictionary.to_pylist()
            code = pc.fill_null(name.indices, len(names)).to_numpy(zero_copy_only=False).astype(np.int64) * (len(days) + 1)
            code += pc.fill_null(day.indices, len(days)).to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            ordered = code[order]
            cuts = np.flatnonzero(np.diff(ordered, prepend=-1, append=-1))
            for f, feature in enumerate(features):
                lists = batch.column(2 + f)
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                values = pc.cast(lists.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
                ends = np.cumsum(size)
                if not len(values):
                    continue
                # Values in the order of the groups, one run a group.
                own = size[order]
                done = np.cumsum(own)
                values = values[np.repeat((ends - size)[order] - (done - own), own) + np.arange(done[-1])]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    part = values[done[a] - own[a] : done[b - 1]]
                    part = part[np.isfinite(part)]
                    if len(part):
                        i, j = divmod(int(ordered[a]), len(days) + 1)
                        key = (names[i] if i < len(names) else None, days[j] if j < len(days) else None, feature)
                        if key not in held:
                            held[key] = Sketch(_seed(seed, key, part, turn), k)
                        held[key].add(part)
            if len(held) > HELD:
                yield from _emit(held)
                held = {}
        yield from _emit(held)

    return run


def _merge_sorted(keys: int, k: int, seed: int, level: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merges neighbouring rows of one key as they stream by; one sketch is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sketch] = {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            ready: dict[tuple, Sketch] = {}
            for *key, n, low, high, moved, body in zip(*(c.to_pylist() for c in batch.columns)):
                own = tuple(key) if keys == 3 else (key[0], None, key[2])
                if own in held:
                    held[own].merge(Sketch.unpack(n, low, high, moved, body, 0, k))
                else:
                    ready |= held
                    held = {own: Sketch.unpack(n, low, high, moved, body, _seed(seed, own, level, part), k)}
            yield from _emit(ready)
        yield from _emit(held)

    return run


def _merged(sketches: DataFrame, way: Column, keys: int, k: int, seed: int, level: str) -> DataFrame:
    """One sketch for each key, merged in WAYS parts first, so that no task takes in all sketches of a key."""
    by = ["dataset", "day", "feature"] if keys == 3 else ["dataset", "feature"]
    parts = sketches.withColumn("_way", F.pmod(way, F.lit(WAYS)))
    first = parts.repartition(*by, "_way").sortWithinPartitions(*by, "_way").select(_NAMES).mapInArrow(_merge_sorted(keys, k, seed, f"{level} 1"), SCHEMA)
    return first.repartition(*by).sortWithinPartitions(*by).mapInArrow(_merge_sorted(keys, k, seed, f"{level} 2"), SCHEMA)


def daily_sketches(rows: DataFrame, features: Sequence[str] = FEATURES, k: int = K, seed: int = 0) -> DataFrame:
    """(dataset, day, feature, n, low, high, moved, sketch): one sketch of the finite elements of each array.

    Names are made uniform; a null dataset or scored_at is a group of its own.
    Null, NaN and infinite elements, null structs and empty arrays add nothing,
    and a group without finite elements has no row.  Every row counts, rows
    delivered twice too.  Each task sends one small sketch per group, however
    many values the group has, and partial sketches are merged as sorted
    streams in two steps, so a hot group neither collects values nor sketches in
    one place.  Tasks draw their bits apart from each other, as the bound asks.
    """
    arrays = [F.col("token_features")[f].alias(f"f{i}") for i, f in enumerate(features)]
    values = rows.select(dataset_key(F.col("dataset")).alias("dataset"), F.date_from_unix_date(F.floor(F.unix_micros(F.col("scored_at").cast("timestamp")) / 86_400_000_000).cast("int")).alias("day"), *arrays)
    partial = values.mapInArrow(_partial(features, k, seed), SCHEMA)
    return _merged(partial, F.spark_partition_id(), 3, k, seed, "days")


def combine(sketches: DataFrame, k: int = K, seed: int = 0) -> DataFrame:
    """One sketch per (dataset, feature) from those of days or other parts; day is null."""
    return _merged(sketches.select(_NAMES), F.xxhash64("day"), 2, k, seed, "all")


def percentiles(sketches: DataFrame, at: Sequence[float] = PERCENTILES, k: int = K) -> DataFrame:
    """(dataset, day, feature, n, percentile, value, rank_error) of each sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for *key, n, low, high, moved, body in zip(*(c.to_pylist() for c in batch.columns)):
                s = Sketch.unpack(n, low, high, moved, body, 0, k)
                rows += [(*key, n, float(p), v, s.rank_error()) for p, v in zip(at, s.percentiles(at))]
            if rows:
                types = [pa.string(), pa.date32(), pa.string(), pa.int64(), *[pa.float64()] * 3]
                names = [*_NAMES[:4], "percentile", "value", "rank_error"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return sketches.select(_NAMES).mapInArrow(run, f"{_KEYS}, n bigint, percentile double, value double, rank_error double")


def all_percentiles(rows: DataFrame) -> DataFrame:
    """(dataset, scope, day, feature, n, percentile, value, rank_error): of each day, and of all days combined from the days' sketches.

    ``scope`` is ``day`` or ``all``; the sketches of days are written once and read by both.
    """
    daily = Scratch(rows.sparkSession, "quantiles").save(daily_sketches(rows))
    whole = percentiles(combine(daily)).withColumn("scope", F.lit("all"))
    each = percentiles(daily).withColumn("scope", F.lit("day"))
    return each.unionByName(whole).select("dataset", "scope", "day", "feature", "n", "percentile", "value", "rank_error")


def beyond_error(rows: DataFrame) -> DataFrame:
    """(dataset, feature, n, n_beyond): finite elements of each array, and how many of its percentiles miss their place by more than the stated rank error.

    Places are counted over all values: a percentile's value must have no more
    than its share below it and no less up to it, within the error.
    """
    found = Scratch(rows.sparkSession, "quantiles").save(all_percentiles(rows).filter("scope = 'all'"))
    one = F.struct("percentile", "value", "rank_error")
    stated = found.groupBy("dataset", "feature").agg(F.array_sort(F.collect_list(one)).alias("stated"))  # PERCENTILES rows a group
    kind = "array<struct<feature:string,x:double>>"

    def tagged(name: str) -> Column:
        return F.coalesce(F.transform(F.col("token_features")[name], lambda x: F.struct(F.lit(name).alias("feature"), x.cast("double").alias("x"))).cast(kind), F.array().cast(kind))

    values = rows.select(dataset_key(F.col("dataset")).alias("_d"), F.inline(F.concat(*map(tagged, FEATURES)))).filter("x is not null and not isnan(x) and abs(x) < double('inf')")
    both = values.withColumnRenamed("feature", "_f").join(stated, F.col("_d").eqNullSafe(F.col("dataset")) & (F.col("_f") == F.col("feature")))
    at = [F.get("stated", F.lit(i)) for i in range(len(PERCENTILES))]
    counts = [F.count(F.when(c, 1)).alias(f"{name}{i}") for i, s in enumerate(at) for name, c in (("below", F.col("x") < s["value"]), ("upto", F.col("x") <= s["value"]))]
    each = both.groupBy("dataset", "feature").agg(F.count("*").alias("n"), F.first("stated").alias("stated"), *counts)
    n = F.col("n")
    misses = [((F.col(f"below{i}") / n > s["percentile"] / 100 + s["rank_error"]) | (F.col(f"upto{i}") / n < s["percentile"] / 100 - s["rank_error"])).cast("long") for i, s in enumerate(at)]
    return each.select("dataset", "feature", "n", sum(misses[1:], misses[0]).alias("n_beyond"))
