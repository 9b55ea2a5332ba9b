"""Windows over an event stream, and incremental indexing of a folder.

These go beyond the batch catalogue: event-time windows run as Structured
Streaming queries that process what is there and stop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import new_path


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events as a stream; times without a zone are read in the session's."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        reader, path = reader.option("pathGlobFilter", p.getName()), str(p.getParent())
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame, label: str) -> DataFrame:
    """Run a complete-mode aggregation over all input there is.

    The last state of the result is in the shared folder, as is the stream's
    checkpoint, from which a lost driver goes on.
    """
    spark, out = stream.sparkSession, new_path(stream.sparkSession, label)
    write = lambda df, _: df.write.mode("overwrite").parquet(out)
    q = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", new_path(spark, f"{label}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _summary(grouped) -> DataFrame:
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    rows = _summary(events.withWatermark("ts", "1 hour").groupBy(F.window("ts", width), "event_type"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour") -> DataFrame:
    rows = _summary(events.withWatermark("ts", "1 hour").groupBy(F.window("ts", width, step), "event_type"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    rows = _summary(events.withWatermark("ts", "1 hour").groupBy(F.session_window("ts", gap), "user_id"))
    return rows.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("stop"), "n", "total")


def watch_folder(spark: SparkSession, root: str, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Hand new source files, batch by batch, to ``handle``; with ``every`` it goes
    on at that interval, otherwise it stops when all files are read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.rs").load(root)
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
