"""Daily sketches against exact SQL, within their bounds."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import sketches as K

DATA = "/root/testdata/sf0.1/events.parquet"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sketches") / "days")
    rows = spark.read.parquet(DATA)
    K.store_days(K.sketch_days(rows, "ts", ["event_type"], "user_id", "value", "user_id"), path)
    return path


def test_merged_days_are_within_the_bounds(spark, stored):
    by_week = K.merge_sketches(K.read_days(spark, stored), F.date_trunc("week", "day").cast("date").alias("week"), "event_type")
    quantiles = [0.1, 0.5, 0.9]
    week = {(r.week, r.event_type): r for r in K.estimates(by_week, quantiles, 5).collect()}
    month = {r.event_type: r for r in K.estimates(K.merge_sketches(by_week, "event_type"), quantiles, 5).collect()}
    con = duckdb.connect()
    con.execute(f"create view e as select *, date_trunc('week', ts)::date as week from '{DATA}'")
    assert len(week) == con.execute("select count(*) from (select distinct week, event_type from e)").fetchone()[0] > 20
    for keys, found in (("week, event_type", week), ("event_type", month)):
        for *key, n, users, values in con.execute(f"select {keys}, count(*), count(distinct user_id), list(value) from e group by {keys}").fetchall():
            got = found[tuple(key) if len(key) > 1 else key[0]]
            assert got.n == n and abs(got.users - users) <= 5 * 1.04 / 2 ** (K.LOG_SIZE / 2) * users
            known = [v for v in values if v is not None]
            for q, value in zip(quantiles, got.quantiles, strict=True):
                below = sum(v < value for v in known) / len(known)
                upto = sum(v <= value for v in known) / len(known)
                assert below - 0.03 <= q <= upto + 0.03


def test_frequent_items_are_exact_while_few(spark):
    rows = spark.read.parquet(DATA)
    days = K.sketch_days(rows, "ts", [], "user_id", "value", "event_type")
    got = K.estimates(K.merge_sketches(days), [0.5], 3).first()["items"]
    want = duckdb.sql(f"select event_type, count(*) as n from '{DATA}' group by 1 order by n desc limit 3").fetchall()
    assert [(r["item"], r["count"]) for r in got] == want


def test_a_day_is_replaced_alone_and_others_are_not_opened(spark, stored):
    files = lambda: {str(p) for p in Path(stored).rglob("*.parquet")}
    before, day = files(), "2024-01-05"
    again = spark.read.parquet(DATA).where(f"to_date(ts) = '{day}'")
    K.store_days(K.sketch_days(again, "ts", ["event_type"], "user_id", "value", "user_id"), stored)
    assert all(f"day={day}" in p for p in before ^ files()) and before != files()
    read = K.read_days(spark, stored, day, day)
    assert read.select("day").distinct().count() == 1 and "PartitionFilters: [isnotnull(day" in read._jdf.queryExecution().toString()


def test_odd_rows(spark):
    schema = "at timestamp, k string, user int, value double, item string"
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(day, "a", None, None, None), (day, "a", None, float("nan"), None), (None, "b", 1, 2.0, "x"), (day, None, 1, 3.0, "y")], schema)
    got = {(str(r.day), r.k): (r.n, r.users, r.quantiles, [tuple(i) for i in r["items"]]) for r in K.estimates(K.sketch_days(rows, "at", ["k"], "user", "value", "item"), [0.5], 2).collect()}
    assert got == {("2024-01-01", "a"): (2, 0, None, []), ("None", "b"): (1, 1, [2.0], [("x", 1)]), ("2024-01-01", None): (1, 1, [3.0], [("y", 1)])}
    assert K.sketch_days(rows.limit(0), "at", ["k"], "user", "value", "item").count() == 0
