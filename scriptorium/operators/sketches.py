"""Stored sketches per day: distinct counts, quantiles and frequent items of any period by merging, without the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sizes of the sketches.  A distinct count is off by about 1.04 / sqrt(2 ** LOG_SIZE) (one standard deviation); a quantile's rank by about
#: 2.3 / QUANTILE_SIZE ** 0.9; frequent items are exact up to ITEM_SIZE * 3 / 4 different ones in a group.
LOG_SIZE, QUANTILE_SIZE, ITEM_SIZE = 12, 200, 1024


def sketch_days(rows: DataFrame, at: str, keys: list[str], distinct: str, value: str, item: str) -> DataFrame:
    """(day, keys, n, users, quantiles, items): a row of bounded size per day and keys.

    Sketches are made before the shuffle in each task and merged after it, so a hot group sends one sketch per task.  Nulls of ``distinct``,
    ``value`` and ``item`` are in ``n`` only; rows without a time are of the day null; NaN values are left out.
    """
    value_ = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return rows.groupBy(F.to_date(at).alias("day"), *keys).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(distinct, LOG_SIZE).alias("users"), F.kll_sketch_agg_double(value_, F.lit(QUANTILE_SIZE)).alias("quantiles"),
        F.expr(f"approx_top_k_accumulate(cast(`{item}` as string), {ITEM_SIZE})").alias("items"),
    )


def store_days(sketches: DataFrame, path: str) -> None:
    """Sketches in one folder per day; days that are there already are replaced, all others keep their files."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_days(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Stored sketches of the days between two dates, both included; other days' folders are not opened."""
    found = spark.read.parquet(path)
    for bound, sign in ((first, ">="), (last, "<=")):
        if bound is not None:
            found = found.where(F.expr(f"day {sign} date'{bound}'"))
    return found


def merge_sketches(sketches: DataFrame, *keys: str | Column) -> DataFrame:
    """(keys, n, users, quantiles, items) of sketch rows: any grouping of days and keys, and merged ones can be merged again."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.hll_union_agg("users").alias("users"), F.kll_merge_agg_double("quantiles", F.lit(QUANTILE_SIZE)).alias("quantiles"),
        F.expr(f"approx_top_k_combine(items, {ITEM_SIZE})").alias("items"),
    )


def estimates(sketches: DataFrame, quantiles: list[float], top: int) -> DataFrame:
    """Sketch rows read: ``users`` as a number, ``quantiles`` as an array (null if there was no value), ``items`` as the ``top`` most frequent with their counts."""
    asked = F.array(*[F.lit(float(q)) for q in quantiles])
    read = F.when(F.kll_sketch_get_n_double("quantiles") > 0, F.kll_sketch_get_quantile_double("quantiles", asked))
    found = F.expr(f"slice(filter(approx_top_k_estimate(items, {top + 1}), x -> x.item is not null), 1, {top})")  # null is an item of the sketch
    others = [c for c in sketches.columns if c not in ("users", "quantiles", "items")]
    return sketches.select(*others, F.hll_sketch_estimate("users").alias("users"), read.alias("quantiles"), found.alias("items"))
