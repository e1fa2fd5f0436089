"""Streams over the event log: watching, live state, windows.

A watch is at-least-once and resumes from its checkpoint; consumers drop
repeated events by ``event_id``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspan.sources.store import EVENTS, RECOVERY


def changes(spark: SparkSession, path: str, collection: str | None = None, late: str = "1 hour", files: int = 1000) -> DataFrame:
    """New events as they are appended, each event once within the watermark."""
    found = spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).parquet(f"{path}/events")
    found = found if collection is None else found.where(F.col("collection") == collection)
    return found.withWatermark("written_at", late).dropDuplicatesWithinWatermark(["event_id"])


def watch(spark: SparkSession, path: str, each: Callable[[DataFrame, int], None], checkpoint: str, collection: str | None = None) -> StreamingQuery:
    """Call ``each`` with batches of new events, in batches that may be repeated after a failure."""
    return changes(spark, path, collection).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain_live(spark: SparkSession, path: str, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest event per subject in generations under ``target``.

    Batch n writes generation n from generation n-1 and the new events; a
    repeated batch writes the same generation again, so the result is exact.
    """
    order = F.struct(*[F.col(c) for c in RECOVERY])
    columns = [f.split(" ")[0] for f in EVENTS.split(", ") if not f.startswith(("collection ", "key "))]

    def each(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        rows = batch if n == 0 else batch.unionByName(session.read.schema(EVENTS).parquet(f"{target}/generation={n - 1}"))
        latest = rows.groupBy("collection", "key").agg(F.max_by(F.struct(*columns), order).alias("e")).select("collection", "key", "e.*")
        latest.write.mode("overwrite").parquet(f"{target}/generation={n}")

    return spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).parquet(f"{path}/events").writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def generation(spark: SparkSession, target: str, n: int) -> DataFrame:
    """The live documents of a generation."""
    return spark.read.schema(EVENTS).parquet(f"{target}/generation={n}").where(F.col("kind") == "put")


def event_counts(events: DataFrame, width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes", at: str = "written_at") -> DataFrame:
    """Events per collection and time window; for batches and streams alike."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, width, slide or width), "collection").agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", "collection", "n")
