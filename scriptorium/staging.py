"""Cutting lineage through tables in the folder that the whole cluster shares.

``stage(df, name)`` writes a DataFrame as Parquet below ``spark.checkpoint.dir`` and reads it
back, so that a lost executor costs a re-read and not the work before it, and so that the
optimizer knows the size of the table.  ``stage_bucketed`` does so in buckets of a key, so that joins on that
key shuffle only the other side.  The files of one application lie in one folder; ``clear_staged`` removes it once
no result is needed any more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where one machine runs everything and the session names no folder, as in tests.
LOCAL_FALLBACK = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; ``ValueError`` if a cluster's session names none."""
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not named:
        master = conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = LOCAL_FALLBACK
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again with the same schema."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``df`` written to the shared folder in hash buckets of ``key``, without a shuffle, and read again.

    Each task writes its own rows to the buckets, so the rows of a bucket are only brought together when it is read.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", f"{_folder(spark)}/{table}").bucketBy(buckets, key).saveAsTable(table)
    made = spark.table(table)
    made.schema  # resolved before the catalog forgets the table; its files stay
    spark.sql(f"DROP TABLE {table}")
    return made


def clear_staged(spark: SparkSession) -> None:
    """Removes all staged tables of this application."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
