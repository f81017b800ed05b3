"""Serving and bookkeeping: nested fetches, owner checks, incremental skips, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage


def nest(parents: DataFrame, children: DataFrame, on: str, fields: list[str], name: str) -> DataFrame:
    """Parents with their children as an array of structs, in order of the fields; none: an empty array."""
    rows = children.groupBy(on).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    empty = F.array().cast(rows.schema[name].dataType)
    return parents.join(rows, on, "left").withColumn(name, F.coalesce(name, empty))


def delete_owned(rows: DataFrame, requests: DataFrame, row_id: str, owner: str) -> DataFrame:
    """Rows that no request by their own owner asks to delete."""
    return rows.join(requests.select(row_id, owner).distinct(), [row_id, owner], "left_anti")


def unmatched_requests(rows: DataFrame, requests: DataFrame, row_id: str, owner: str) -> DataFrame:
    """Requests that name no row of their own owner, which a service answers with an error."""
    return requests.select(row_id, owner).distinct().join(rows.select(row_id, owner), [row_id, owner], "left_anti")


def merge_state(state: DataFrame, processed: DataFrame, key: str, at: str) -> DataFrame:
    """A state (key, at, ...) after a run: each key with its latest entry."""
    w = Window.partitionBy(key).orderBy(F.desc(at))
    return state.unionByName(processed, allowMissingColumns=True).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def lookup(rows: DataFrame, names: dict[str, str], by: str, to: str, default: str) -> DataFrame:
    """Rows with the name of one of their values, or the default."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    found = F.try_element_at(F.create_map(*pairs), F.col(by)) if pairs else F.lit(None).cast("string")
    return rows.withColumn(to, F.coalesce(found, F.lit(default)))


def preferred(rows: DataFrame, key: str, wanted: Column, order: str, limit: int) -> DataFrame:
    """The first ``limit`` rows of each key: those that are wanted, then others, each in order."""
    w = Window.partitionBy(key).orderBy(F.when(wanted, 0).otherwise(1), order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")


def skip_seen(rows: DataFrame, seen: DataFrame, on: str) -> DataFrame:
    """Rows whose key was not processed before."""
    return rows.join(seen.select(on).distinct(), on, "left_anti")


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files (path, mtime) that are new or newer than before."""
    old = before.select("path", F.col("mtime").alias("old"))
    return after.join(old, "path", "left").where(F.col("old").isNull() | (F.col("mtime") > F.col("old"))).drop("old")


def fingerprint(values: Column) -> Column:
    """MD5 of the sorted values of a group: equal sets of values give equal fingerprints."""
    return F.md5(F.array_join(F.array_sort(F.collect_list(values)), "").cast("binary"))


def round_robin(rows: DataFrame, order: list[str], others: DataFrame, other_order: list[str], n_others: int) -> DataFrame:
    """Each row with the other of its number modulo their count.

    Numbers come from sorted ranges: a count per range first, then a place within it, so no window spans the table.
    """
    a = number_rows(rows, order, "__i").withColumn("__j", F.pmod(F.col("__i"), F.lit(n_others)))
    b = number_rows(others, other_order, "__j")
    return a.join(b, "__j").drop("__i", "__j")


def number_rows(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with their number from 0 in the given order; equal keys are numbered in any order.

    Sorted ranges get their numbers in place, then each range the number of rows before it.  The ranges are stored
    first, so both readers see the same ones however often a task is run.
    """
    spread = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    placed = stage(spread.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*order))), "ranges")
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__size"))  # one row per range
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(before.drop("__size")), "__part").withColumn(name, F.col("__before") + F.col("__at") - 1).drop("__part", "__at", "__before")


def upsert_value(rows: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """Rows with the changed value of one column where there is a change."""
    new = changes.select(key, F.col(column).alias("__new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def changed_sets(now: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Keys whose fingerprint (key, fingerprint) is new or differs from the stored one."""
    old = stored.select(key, F.col("fingerprint").alias("__old"))
    return now.join(old, key, "left").where(~F.col("fingerprint").eqNullSafe(F.col("__old"))).drop("__old")


def latest_per(rows: DataFrame, key: str, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows of each key in the given order, as a history shows them, with their ``rank``."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def last_n(values: Column, n: int) -> Column:
    """The last ``n`` values of an array, or all if it has fewer."""
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), F.lit(n))


def run_counts(log: DataFrame, run: str, status: str) -> DataFrame:
    """Per run: successes and skips; and the total of the last run, which is what a state file shows."""
    each = log.groupBy(run).agg(F.count_if(F.col(status) == "success").alias("success"), F.count_if(F.col(status) == "skip").alias("skipped"))
    last = log.agg(F.max(run).alias("__last"))
    return each.join(F.broadcast(last)).withColumn("total_articles", F.when(F.col(run) == F.col("__last"), F.col("success"))).drop("__last")


def with_retries(attempts: DataFrame, key: str, attempt: str, ok: str, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """The first successful attempt of each key among its first ``most``, and the keys that failed them all."""
    tried = attempts.where(F.col(attempt) <= most)
    first = tried.groupBy(key).agg(F.min(F.when(F.col(ok), F.col(attempt))).alias(attempt), F.count("*").alias("tries"))
    return tried.join(first.where(F.col(attempt).isNotNull()).select(key, attempt), [key, attempt]), first.where(F.col(attempt).isNull()).select(key, "tries")


def public_columns(rows: DataFrame, secret: list[str], **equal) -> DataFrame:
    """Rows whose columns equal the given values, without the secret columns."""
    for name, value in equal.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows.drop(*secret)


def cache_put(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """A cache (mode, key, answer) in which the new entries replace those of the same mode and key."""
    return cache.join(entries.select("mode", "key").distinct(), ["mode", "key"], "left_anti").unionByName(entries.dropDuplicates(["mode", "key"]))


def cache_clear(cache: DataFrame, modes: list[str] | None = None) -> DataFrame:
    """The cache without the entries of some modes, or of all."""
    return cache.where(~F.col("mode").isin(modes)) if modes is not None else cache.limit(0)
