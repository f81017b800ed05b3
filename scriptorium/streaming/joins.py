"""Joins and windows in event time, and a place for rows that come too late."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def interval_join(events: DataFrame, causes: DataFrame, key: str, at: str, cause_at: str, seconds: int) -> DataFrame:
    """Each event with the causes of its key in the ``seconds`` before it (its own instant included); works on tables and on streams.

    Times are cut into stretches of ``seconds``, and an event meets its own stretch and the one before by equality,
    so a key with many rows over a long time is no large task.  On streams both sides carry a watermark, and
    rows leave the state when no partner can come.  The sides' other columns have names of their own.
    """
    part = lambda c: F.floor(F.unix_seconds(c) / seconds)
    left = events.withColumn("__part", F.explode(F.array(part(F.col(at)), part(F.col(at)) - 1)))
    right = causes.withColumnRenamed(key, "__key").withColumn("__own", part(F.col(cause_at)))
    near = F.expr(f"`{cause_at}` <= `{at}` and `{cause_at}` >= `{at}` - interval {seconds} seconds")
    return left.join(right, (F.col(key) == F.col("__key")) & (F.col("__part") == F.col("__own")) & near).drop("__part", "__own", "__key")


def sliding_counts(events: DataFrame, at: str, width: str, slide: str, *keys: str) -> DataFrame:
    """(window_start, keys, n): rows of each window of ``width``, one beginning every ``slide``; works on tables and on streams."""
    grouped = events.groupBy(F.window(at, width, slide).alias("w"), *keys).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("window_start"), *keys, "n")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def write_with_late(stream: DataFrame, target: str, checkpoint: str, at: str, late: str, every: str | None = None) -> DataStreamWriter:
    """A writer that puts rows that come more than ``late`` after their time into ``<target>_late``, and the others into ``target``.

    A row is late if its time is before the latest time of all earlier batches less ``late``, as with a watermark, which would drop it.
    Rows without a time are late.  What the batches reached is kept in ``<target>_marks``; a batch writes all three below its own number, so one
    that is run again replaces its first try.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark, marks = rows.sparkSession, f"{target}_marks"
        before = spark.read.parquet(marks).where(F.col("batch") < number).agg(F.max("reached")).first()[0] if _exists(spark, marks) else None
        limit = F.lit(before) - F.expr(f"interval {late}") if before is not None else None
        is_late = F.col(at).isNull() if limit is None else F.col(at).isNull() | (F.col(at) < limit)
        rows.where(~is_late).write.mode("overwrite").parquet(f"{target}/batch={number}")
        rows.where(is_late).write.mode("overwrite").parquet(f"{target}_late/batch={number}")
        reached = spark.read.parquet(f"{target}/batch={number}").agg(F.max(at).alias("reached"))
        reached.coalesce(1).write.mode("overwrite").parquet(f"{marks}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def surviving(step: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A batch function whose error is logged and does not end the stream: the batch counts as done, as a run that failed is not repeated.

    Takes and gives a function (rows, number).  Its errors are on ``failures`` of the function, the last hundred of them.
    """
    failures: list[tuple[int, str]] = []

    def run(rows: DataFrame, number: int) -> None:
        try:
            step(rows, number)
        except Exception as error:  # noqa: BLE001  whatever a run raises, the next one comes
            logging.getLogger(__name__).warning("batch %s failed: %s", number, error)
            failures.append((number, str(error)))
            del failures[:-100]

    run.failures = failures
    return run
