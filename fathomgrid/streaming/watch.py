"""Change-driven updates as streams: polling files, debouncing bursts, idempotent batches, windows.

Deletions don't show in a file stream: pair it with ``snapshot_diff`` over two listings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

BINARY = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def file_changes(spark: SparkSession, root: str, pattern: str = "*", per_batch: int | None = None) -> DataFrame:
    """New and changed files under ``root`` as a stream; the checkpoint remembers what was seen."""
    r = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    if per_batch:
        r = r.option("maxFilesPerTrigger", per_batch)
    return r.load(root)


def apply_changes(changes: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "2 seconds") -> StreamingQuery:
    """Run ``update(batch, batch_id)`` on every micro-batch.  The offset is committed only after the
    update: a failed one is tried again with the same id, so updates must be idempotent by id.
    With ``every=None`` what is there is caught up on and the stream ends."""
    w = changes.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def by_member(batch: DataFrame, root: str) -> DataFrame:
    """Adds the first path segment below ``root``: the member of a class of bases that a file belongs to."""
    below = F.regexp_replace("path", "^.*?" + root.strip("/").replace(".", r"\.") + "/", "")
    return batch.withColumn("member", F.when(F.instr(below, "/") > 0, F.get(F.split(below, "/"), F.lit(0))))


def bursts(events: DataFrame, key: str, ts: str, quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """(key, start, end, events): one row per burst, given out once it has been quiet."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, quiet).alias("w"), key).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def windowed(events: DataFrame, ts: str, by: list[str], size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts per tumbling or sliding event-time window (an extension: change streams have no event time)."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
