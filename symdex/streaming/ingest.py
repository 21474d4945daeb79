"""Document changes as a stream: each micro-batch is an incremental update of a stored index's files.

A batch has rows (id, project_id, relative_path, absolute_path, text, removed,
seq).  The last row of a file by ``seq`` counts; what was applied is kept by
batch number in the index's meta table, so a batch that is delivered again
after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators.extraction import source_files
from ..operators.search import FIELDS, postings
from ..plans.lineage import cut
from ..schema import conform
from ..sources.store import Store

CHANGES = "id string, project_id string, relative_path string, absolute_path string, text string, removed boolean, seq bigint"
KEY = "stream_batch"


def read_changes(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def latest(batch: DataFrame) -> DataFrame:
    """One row for each file: the one with the highest ``seq``, a removal going before an equal."""
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq"), F.desc(F.coalesce("removed", F.lit(False))), F.xxhash64("text")))
    return batch.withColumn("_k", last).where("_k = 1").drop("_k")


def apply_batch(store: Store, batch: DataFrame, number: int, include_generated: bool = False) -> bool:
    """Files and bodies after a batch; False if the index has this batch already."""
    if store.version() and int(store.meta().get(KEY, "-1")) >= number:
        return False
    index, changed = store.read(), cut(latest(batch))
    gone = changed.select(F.col("id").alias("_gone"))
    there = changed.where(~F.coalesce("removed", F.lit(False)))
    new = source_files(there, include_generated)
    files = index.source_files.join(gone, F.col("id") == F.col("_gone"), "left_anti").unionByName(conform(new, "source_files"))
    fresh = there.join(new.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_semi").where("length(text) > 0")
    fresh = conform(fresh.select(F.col("id").alias("file_id"), "relative_path", "absolute_path", F.col("text").alias("content")), "bodies")
    bodies = index.bodies.join(gone, F.col("file_id") == F.col("_gone"), "left_anti").unionByName(fresh)
    known = {}
    if "body" in index.search:  # only the batch's files are searched for tokens
        left = index.search["body"].rows.join(gone, F.col("doc") == F.col("_gone"), "left_anti")
        known["body"] = left.unionByName(postings(fresh, "file_id", FIELDS["body"]))
    store.update({KEY: str(number)}, postings=known, source_files=files, bodies=bodies)
    return True


def start(store: Store, changes: DataFrame, checkpoint: str, include_generated: bool = False, available_now: bool = True) -> StreamingQuery:
    """Applies a stream of changes; by default what is there now, then it ends."""
    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, number: apply_batch(store, df, number, include_generated))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def project_rates(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Changes (ts, project_id) per window and project; rows later than ``late`` are dropped by the watermark."""
    timed = events.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "project_id").agg(F.count(F.lit(1)).alias("changes")).select(F.col("w.start").alias("window_start"), "project_id", "changes")
