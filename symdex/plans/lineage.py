"""Cutting lineage, through the folder that all executors share.

What is written here is read as files afterwards, so a lost executor never
makes an earlier step run again.  A block of ``held`` deletes what was written
in it; the rest goes when Python ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: Bytes of the files read that a task of a repartition has to do with.
SHARE = 4 << 20
_roots: set[str] = set()
_listening: list[list[str]] = []


def folder(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on one machine."""
    base = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"{_KEY} must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="symdex-")
        spark.conf.set(_KEY, base)
        _roots.add(base)
    own = f"{base.rstrip('/')}/symdex-cut-{spark.sparkContext.applicationId}"
    _roots.add(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    for paths in _listening:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(*frames: DataFrame) -> int:
    """Tasks that leave each about ``SHARE`` of the files that these frames read, and at least one for each core.

    For ``repartition``: the number follows the input, as the session's shuffle
    partitions may not, and adaptive execution joins none of them.  Where a
    frame comes from no files it is the session's.
    """
    spark, read = frames[0].sparkSession, 0
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        read += sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    set_ = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = min(set_, spark.sparkContext.defaultParallelism)
    return max(least, set_ if read >= 1 << 60 else min(-(-read // SHARE), 100_000))  # a frame of no files has no size, and says 8 EB


def _delete(path: str) -> None:
    jvm, context = SparkContext._jvm, SparkContext._active_spark_context
    p = jvm.org.apache.hadoop.fs.Path(path)
    conf = context._jsc.hadoopConfiguration() if context and context._jsc else jvm.org.apache.hadoop.conf.Configuration()
    p.getFileSystem(conf).delete(p, True)


@contextlib.contextmanager
def held() -> Iterator[None]:
    """What is cut inside is deleted at the end, when the answer is out."""
    paths: list[str] = []
    _listening.append(paths)
    try:
        yield
    finally:
        _listening.remove(paths)
        for path in paths:
            _delete(path)


@atexit.register
def _end() -> None:
    for path in sorted(_roots):
        with contextlib.suppress(Exception):  # the application is over, with or without its JVM
            _delete(path)
