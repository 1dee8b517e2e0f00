"""Logs and uploads as streams, with the results of the batch operators.

State is bounded by a watermark: rows later than it are dropped by the engine, which is what a watermark means; a batch
read of the same files has them all. Checkpoints lie under spark.checkpoint.dir unless a folder is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docsafe.sources import files


def log_events(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1000) -> DataFrame:
    """JSON objects of the lines of a growing folder, as `files.log_events` reads them."""
    return files.parsed_events(spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(path), schema)


def uploads(spark: SparkSession, path: str, most: int = 50 << 20, files_a_batch: int = 100) -> DataFrame:
    """Files that arrive in a folder, with the checks of `files.uploads`."""
    shape = "path string, modificationTime timestamp, length bigint, content binary"
    return files.checked_uploads(spark.readStream.format("binaryFile").schema(shape).option("maxFilesPerTrigger", files_a_batch).load(path), most)


def stage_stats(events: DataFrame, late: str = "1 hour", every: str = "1 hour") -> DataFrame:
    """start, stage, n, total, mean, longest of events (ts, stage, ms) by window of event time."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "stage").agg(F.count("*").alias("n"), F.sum("ms").alias("total"), F.avg("ms").alias("mean"), F.max("ms").alias("longest"))
    return out.select(F.col("w.start").alias("start"), "stage", "n", "total", "mean", "longest")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, start, end, n, total: events (ts, key, ms) that follow each other within the gap."""
    out = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("ms").alias("total"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def distinct_diagnostics(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """events without repeats of (fingerprint, ms) within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["fingerprint", "ms"])


def start(stream: DataFrame, path: str, name: str, checkpoint: str | None = None, once: bool = False) -> StreamingQuery:
    """Appends a stream to Parquet, whole batches or none; `once` ends when what is there now has been read."""
    folder = checkpoint or stream.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("a stream needs a checkpoint folder: give one or set spark.checkpoint.dir")
    writer = stream.writeStream.format("parquet").outputMode("append").queryName(name).option("checkpointLocation", f"{folder}/streams/{name}").option("path", path)
    return (writer.trigger(availableNow=True) if once else writer).start()
