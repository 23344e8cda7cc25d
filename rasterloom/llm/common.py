"""Helpers shared by the training-data operators: the shared folder, written tables, names."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: space and the five ASCII controls from tab to carriage return.
WS = r"[\x20\x09-\x0D]"

#: A side is broadcast only if its measured size is at most this; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20

#: What a Python worker keeps for its next tasks (vocabularies, by path).
KEPT: dict[str, object] = {}


def light(work: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """work on batches that needs nothing kept: first lets go of what other stages' tasks left, as workers outlive stages."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if KEPT:
            KEPT.clear()
            gc.collect()
            trim()
        return work(batches)

    return run


def trim() -> None:
    """Give memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if give:
        give(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(path)
        return path.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete paths of the shared folder that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows fit in limit, else df itself, which then joins by shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from names that df doesn't have, whatever extra columns it brings."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def one_spaced(text: Column) -> Column:
    """Each white-space run as one space, null as the empty text.  Only runs that change are matched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\x09-\x0D]{WS}*|\x20{WS}+", " ")


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else unchanged."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts can be long: at most so many rows go to a Python worker at once; Spark itself bounds a batch's bytes (arrow.maxBytesPerBatch, 64 MB).

    The session keeps this, as a plan reads it when it runs, after the call; a smaller setting of the session stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
