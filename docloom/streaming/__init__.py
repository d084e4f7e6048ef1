"""Structured Streaming over arriving files and events.

The reference semantics know no streams; what is here runs the same operators as files arrive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """(doc_id, length, content) of files as they appear in a folder, each once."""
    stream = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return stream.select(F.col("path").alias("doc_id"), "length", "content")


def extract(files: DataFrame, make: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes make(files) of each batch as Parquet. A batch that runs again overwrites its own folder, so no row is there twice."""

    def write(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def sessions(events: DataFrame, gap: str = "1 day", late: str = "1 hour", by: str = "user_id", ts: str = "ts") -> DataFrame:
    """(by, start, end, events, value): runs of events broken by a gap, closed once the watermark has passed them."""
    return (
        events.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, late)
        .groupBy(by, F.session_window(ts, gap).alias("w"))
        .agg(F.count("*").alias("events"), F.sum("value").alias("value"))
        .select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "value")
    )
