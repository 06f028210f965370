"""The batch operators on streams; sinks are Parquet tables with their own checkpoint, written exactly once or, in complete mode, replaced by each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nodes import parse_nodes
from ..operators.staging import scratch


def stream_table(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """A Parquet table, a folder of files or a single one, as a stream of its files, so many in a batch."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files)
    if folder:
        return reader.parquet(path)
    parent, _, name = path.rstrip("/").rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(parent)


def stream_nodes(docs: DataFrame, **options) -> DataFrame:
    """Node rows of a stream of documents: stateless, append mode."""
    return parse_nodes(docs, **options)


def event_counts(events: DataFrame, window: str = "1 hour", late: str | None = "2 hours", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) in tumbling or sliding windows; late rows beyond the watermark are dropped, none without one."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, n) of sessions that end after a gap."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, and return what it wrote.

    In append mode groups that the watermark has not passed are not written;
    complete mode, over groups without a watermark, returns all of them.
    """
    spark = stream.sparkSession
    path = scratch(spark, "quillspark-stream")
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if mode == "complete":  # files cannot be a sink of it: each batch replaces the table
        spark.createDataFrame([], stream.schema).write.parquet(f"{path}/out")
        out = out.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out"))
    else:
        out = out.format("parquet").option("path", f"{path}/out")
    out.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
