"""Incremental and streaming forms: skipping what was seen, windows over events, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .joins import surviving


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """(ts, level, message) of lines like ``[time] [LEVEL] message``; other lines go."""
    pattern = r"^\[([^\]]+)\] \[([A-Z]+)\] (.*)$"
    return lines.where(F.col(column).rlike(pattern)).select(
        F.try_to_timestamp(F.regexp_extract(column, pattern, 1)).alias("ts"), F.regexp_extract(column, pattern, 2).alias("level"), F.regexp_extract(column, pattern, 3).alias("message")
    )


def stream_events(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """A stream over event files with a watermark on their time."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling_counts(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Events and sum of values per window and type; works on tables and on streams."""
    grouped = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions per user: runs of events with pauses below the gap."""
    grouped = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_seen(events: DataFrame, key: str) -> DataFrame:
    """Each key once within the watermark, for streams that repeat themselves."""
    return events.dropDuplicatesWithinWatermark([key])


def write_new(stream: DataFrame, target: str, checkpoint: str, key: str, every: str | None = None, survive: bool = False) -> DataStreamWriter:
    """A writer that appends only rows whose key no earlier batch had; once over what there is, or ``every`` interval.

    Keys are kept in a table of their own beside the target (``<target>_keys``), so that a batch reads those and not
    the rows.  A batch writes below its own number, so one that is written again after a failure replaces its first try
    and adds nothing twice.  With ``survive`` a batch that fails is logged and passed over, so its rows are not written; without, it ends the stream.  Rows
    without a key go, as nothing tells whether they were seen.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark, keys = rows.sparkSession, f"{target}_keys"
        fresh = rows.where(F.col(key).isNotNull()).dropDuplicates([key])
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(keys)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            seen = spark.read.parquet(keys)
            fresh = fresh.join(seen.where(F.col("batch") != number).select(key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/batch={number}")
        spark.read.parquet(f"{target}/batch={number}").select(key).write.mode("overwrite").parquet(f"{keys}/batch={number}")

    writer = stream.writeStream.foreachBatch(surviving(batch) if survive else batch).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
