"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of columns that live only inside an operator.
OWN = "__scr_"
#: A key is hot if more than one in ``SHARES`` rows have it, so there are fewer than that; its rows are dealt to ``SALTS`` keys.
SHARES, SALTS = 1_000, 1_000


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Jobs run inside send at most so many rows at once to Python, as texts are long; the session's own setting comes back after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def annotate(docs: DataFrame, udf_column: Column, fields: list[str]) -> DataFrame:
    """``docs`` with the fields of one struct-valued expression as columns.

    A column of ``docs`` that has the name of a field is replaced; all others pass through.
    """
    out = docs.withColumn(OWN + "r", udf_column)
    keep = [c for c in docs.columns if c.lower() not in {f.lower() for f in fields}]
    return out.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{OWN}r`.`{f}`").alias(f) for f in fields])


def texts(array: pa.Array) -> list[str | None]:
    """Python strings of a string array."""
    return array.to_pylist()


def struct_of(rows: list[tuple], schema: pa.StructType) -> pa.StructArray:
    """Rows of Python values as one struct array."""
    columns = list(zip(*rows, strict=True)) if rows else [()] * schema.num_fields
    return pa.StructArray.from_arrays(
        [pa.array(list(c), type=schema.field(i).type) for i, c in enumerate(columns)],
        fields=[schema.field(i) for i in range(schema.num_fields)],
    )


def by_text(function: Callable[[str], tuple], schema: pa.StructType) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """An Arrow iterator function that applies ``function`` to every text (null: empty)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield struct_of([function(t if t is not None else "") for t in texts(batch)], schema)

    return run


def join_salted(rows: DataFrame, side: DataFrame, on: list[str], count: str, spread: Column, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``side`` but ``count``; hot keys of ``rows`` are dealt to salted keys.

    ``side`` is a stored table with unique keys; its column ``count`` tells how many rows have each.  A key with more
    than a share of all of them is hot; there are at most ``SHARES`` such, so they are broadcast to salt the rows.  ``spread`` is
    an expression over ``rows`` that differs between the rows of a hot key.
    """
    total = side.agg(F.sum(count)).first()[0] or 0
    hot, salt = F.col(count) > max(total // SHARES, SALTS), OWN + "salt"
    few = F.broadcast(side.where(hot).select(*on, F.lit(True).alias(OWN + "hot")))
    mine = F.when(F.col(OWN + "hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int")
    salted = rows.join(few, on, "left").withColumn(salt, mine).drop(OWN + "hot")
    every = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(side.withColumn(salt, F.explode(every)).drop(count), [*on, salt], how).drop(salt)
