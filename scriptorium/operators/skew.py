"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if more than one in ``SHARES`` rows, and more than ``LEAST`` rows, have it; its rows are dealt to ``SALTS`` keys.
SHARES, LEAST, SALTS = 200, 10_000, 64


def join_spread(rows: DataFrame, side: DataFrame, on: str, spread: Column, how: str = "inner", least: int = LEAST) -> DataFrame:
    """``rows`` joined with ``side`` on one column, none of whose keys makes a large task.

    Fewer than ``SHARES`` keys can be hot, so they are known to the driver; their rows are dealt out by ``spread``, an expression over
    ``rows`` that differs between the rows of a key, and the side's rows of these keys are repeated.
    """
    counted = rows.groupBy(on).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in counted.where((F.col("n") > max(total // SHARES, least)) & F.col(on).isNotNull()).select(on).collect()]
    if not hot:
        return rows.join(side, on, how)
    salt, is_hot = "__salt", F.coalesce(F.col(on).isin(hot), F.lit(False))
    dealt = rows.withColumn(salt, F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int"))
    every = side.withColumn(salt, F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(every, [on, salt], how).drop(salt)
