"""Session, table reading and intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Settings a session of our own gets; a session passed in is never changed.
SESSION = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[*]", shuffle_partitions: int = 8, memory: str = "6g", **more: str) -> SparkSession:
    """A session for tests, the bench and the command line."""
    builder = SparkSession.builder.master(master).config("spark.driver.memory", memory)
    for key, value in {**SESSION, "spark.sql.shuffle.partitions": str(shuffle_partitions), **more}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a missing setting is an error, since a folder of one machine would
    not be seen by the others.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    global _own
    if _own is None:
        _own = tempfile.TemporaryDirectory(prefix="scoreloom-")
        atexit.register(_own.cleanup)
    return f"file://{_own.name}"


_own: tempfile.TemporaryDirectory | None = None


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clear() -> None:
    """Removes this process's intermediate tables when it ends; what can't be reached any more stays."""
    for spark, root in _roots:
        if root.startswith(("file:", "/")):
            shutil.rmtree(root.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        else:
            with contextlib.suppress(Exception):
                _delete(spark, root)


_roots: list[tuple[SparkSession, str]] = []
atexit.register(_clear)


@contextlib.contextmanager
def skew_split(spark: SparkSession) -> Iterator[None]:
    """Joins that run inside split hot partitions, whatever the session's own settings, which are put back."""
    own = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.forceOptimizeSkewedJoin": "true"}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Intermediate tables of one query in the shared folder, kept until the process ends.

    ``save`` writes a frame as Parquet and gives back a reader of it: lineage
    is cut, a lost executor costs no recomputation before that point, and
    later readers still prune columns.  ``drop`` removes a table that nothing
    reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
        self.count = 0
        _roots.append((spark, self.root))

    def path(self) -> str:
        self.count += 1
        return f"{self.root}/{self.count:04d}"

    def save(self, df: DataFrame, compression: str = "zstd") -> DataFrame:
        path = self.path()
        with skew_split(self.spark):
            df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path  # type: ignore[attr-defined]
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_scratch", None)
        if path:
            _delete(self.spark, path)
