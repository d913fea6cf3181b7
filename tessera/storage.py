"""Shared-folder storage: cut lineage through tables every executor can read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files go as soon as the query that made them has been written.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = "spark.tessera.local.dir"
    root = spark.conf.get(key, None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set(key, root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unique path in the shared folder."""
    return f"{shared_root(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    """The session's own number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def _held(spark: SparkSession, **settings: str) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialise(df: DataFrame, name: str = "t", tasks: int = 0) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Works like ``checkpoint()`` (lineage ends, lost executors lose nothing) but
    keeps the columnar format, so later scans prune columns and push filters.
    The shuffle files behind the table go at once. Its shuffles have ``tasks``
    partitions where that is more than the session's own number.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    more = {"spark.sql.shuffle.partitions": str(tasks)} if tasks > partitions(spark) else {}
    with _held(spark, **{_CLEAN: "true"}, **more):
        # a plan is made when it is first needed: this one anew, under these settings
        (df.select("*") if more else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if 2 * heap.totalMemory() > heap.maxMemory():
        tidy(spark)  # plans of finished steps fill the heap up to its bound before the driver collects them by itself
    return out


#: Rows that one task of a sort or window by key should hold.
ROWS = 500_000


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """``df`` dealt by ``keys`` to as many partitions as keep a task at about ``ROWS`` rows, however large the table is.

    A table that the session's own number of partitions holds that way stays as
    it is. ``rows`` is the number of rows where it is known; else they're counted.
    """
    n = df.count() if rows is None else rows
    wanted = -(-n // ROWS)
    return df if wanted < 2 else df.repartition(wanted, *keys)


def discard(*tables: DataFrame | None) -> None:
    """Delete what :func:`materialise` wrote, once nothing reads it any more."""
    for t in tables:
        if path := getattr(t, "_tessera_path", None):
            drop(t.sparkSession, path)


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage: only then does Spark let go of the broadcast tables of finished steps."""
    spark.sparkContext._jvm.System.gc()


def drop(spark: SparkSession, path: str) -> None:
    """Delete a path made by :func:`shared_path`."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
