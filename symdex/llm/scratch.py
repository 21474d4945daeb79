"""Tables written to the folder that all executors share.

A table written here cuts lineage: later stages read files, so losing an
executor never recomputes (or loses) what came before it.  The folder is the
one the cluster names in ``spark.checkpoint.dir``; only where that is unset,
as in tests on one machine, a temporary folder is made and set.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_roots: set[str] = set()
#: Names in the catalog of the tables in buckets, by path.
_named: dict[str, str] = {}
#: Lists that are told of every table written while they are here.
_listening: list[list[str]] = []


def root(spark: SparkSession) -> str:
    """Folder for this application's tables; it goes when Python ends."""
    base = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{_KEY} must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="symdex-")
        spark.conf.set(_KEY, base)
        _roots.add(base)
    own = f"{base.rstrip('/')}/symdex-{spark.sparkContext.applicationId}"
    _roots.add(own)
    return own


def _path(spark: SparkSession, name: str) -> str:
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    for held in _listening:
        held.append(path)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it read back."""
    spark = df.sparkSession
    path = _path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """The same in buckets by a column; the catalog has it, under a name of its own, until it is released."""
    spark = df.sparkSession
    path = _path(spark, "buckets")
    name = _named[path] = f"symdex_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, column).option("path", path).saveAsTable(name)
    return spark.table(name)


@contextlib.contextmanager
def noted(held: list[str]) -> Iterator[list[str]]:
    """Adds to ``held`` the path of every table written meanwhile."""
    _listening.append(held)
    try:
        yield held
    finally:
        _listening.remove(held)


def _forget(path: str) -> None:
    """Takes a table in buckets out of the catalog."""
    name, spark = _named.pop(path, None), SparkSession.getActiveSession()
    if name and spark:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _delete(path: str) -> None:
    jvm, context = SparkContext._jvm, SparkContext._active_spark_context
    p = jvm.org.apache.hadoop.fs.Path(path)
    conf = context._jsc.hadoopConfiguration() if context and context._jsc else jvm.org.apache.hadoop.conf.Configuration()
    p.getFileSystem(conf).delete(p, True)


def release(paths: list[str]) -> None:
    """Deletes tables that ``noted`` listed; frames built on them end with them."""
    while paths:
        path = paths.pop()
        _forget(path)
        _delete(path)


@atexit.register
def _end() -> None:
    for path in list(_named):
        with contextlib.suppress(Exception):
            _forget(path)
    for path in sorted(_roots):
        with contextlib.suppress(Exception):  # the application is over, with or without its JVM
            _delete(path)


def fresh(name: str) -> str:
    """A column name that no input has."""
    return f"__sx_{name}_{uuid.uuid4().hex[:12]}"


def columns(df: DataFrame) -> list[Column]:
    """The columns of ``df`` whatever their names hold."""
    return [df["`" + c.replace("`", "``") + "`"] for c in df.columns]
