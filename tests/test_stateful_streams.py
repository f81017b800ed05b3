"""Stateful streams: retries equal their batch form and survive restarts, joins and windows in event time, late rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import serving
from scriptorium.streaming import joins as J
from scriptorium.streaming import retries as T

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def timers(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, T.STATE_STORE)
    yield spark
    spark.conf.set(name, before)


class Stream:
    """A folder of files as a stream; each ``add`` is a file and a run of its own, from the checkpoint."""

    def __init__(self, spark, tmp_path, schema):
        self.spark, self.path, self.schema = spark, tmp_path, schema
        (tmp_path / "in").mkdir()

    def run(self, plan):
        source = self.spark.readStream.schema(self.schema).parquet(str(self.path / "in"))
        out = plan(source).writeStream.format("parquet").option("checkpointLocation", str(self.path / "state")).option("path", str(self.path / "out"))
        out.trigger(availableNow=True).start().awaitTermination(120)

    def add(self, rows, plan):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.path / "in"))
        self.run(plan)
        return self.spark.read.parquet(str(self.path / "out")).collect()


def _at(seconds):
    return START + dt.timedelta(seconds=seconds)


def _retries(source):
    return T.retry_events(source.withWatermark("at", "0 seconds"), pause=60, forget=10_000)


SCHEMA = "key string, attempt int, ok boolean, at timestamp"


def test_retries_equal_the_batch_form(timers, tmp_path):
    orders = timers.read.parquet("/root/testdata/sf0.001/orders.parquet")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    tries = orders.select(F.col("o_custkey").cast("string").alias("key"), n.alias("attempt"), (F.col("o_orderstatus") == "F").alias("ok")).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("attempt")))
    stream = Stream(timers, tmp_path, tries.schema.simpleString()[7:-1].replace(":", " "))
    rows = [tuple(r) for r in tries.collect()]
    rows.sort(key=lambda r: (r[1] * 7 % 5, r[0]))  # attempts of a key come in any order, over three runs
    for k in range(3):
        got = stream.add(rows[k::3], lambda s: T.retry_events(s.withWatermark("at", "1 day"), forget=10_000_000))
    done, failed = serving.with_retries(tries, "key", "attempt", "ok")
    whole = failed.where("tries = 3")  # a key with fewer attempts may still succeed
    assert {(r.key, r.attempt) for r in got if r.event == "done"} == {(r.key, r.attempt) for r in done.collect()}
    assert sorted(r.key for r in got if r.event == "failed") == sorted(r.key for r in whole.collect())
    assert len({r.key for r in got}) == len(got)


def test_pauses_expiry_and_restart(timers, tmp_path):
    stream = Stream(timers, tmp_path, SCHEMA)
    stream.add([("a", 1, False, _at(0)), ("b", 1, None, _at(0)), (None, 1, True, _at(0)), ("n", None, True, _at(0))], _retries)
    asked = lambda got: {(r.key, r.attempt) for r in got if r.event == "retry"}
    assert not asked(stream.add([("clock", 1, True, _at(59))], _retries))
    assert asked(stream.add([("clock", 1, True, _at(61))], _retries)) == {("a", 2), ("b", 2)}  # each run ends with the watermark moved
    assert asked(stream.add([("a", 2, False, _at(70)), ("clock", 1, True, _at(189))], _retries)) == {("a", 2), ("b", 2)}
    stream.add([("clock", 1, True, _at(300))], _retries)
    got = stream.add([("a", 3, False, _at(301)), ("a", 3, False, _at(302)), ("clock", 1, True, _at(9_000))], _retries)
    assert ("a", 3) in {(r.key, r.attempt) for r in got if r.event == "retry"}  # 120 seconds after its second failure
    assert [(r.key, r.attempt) for r in got if r.event == "failed"] == [("a", 3)]
    stream.add([("clock", 1, True, _at(20_000))], _retries)
    got = stream.add([("clock", 1, True, _at(40_000))], _retries)
    assert {(r.key, r.attempt) for r in got if r.event == "expired"} == {("b", 1), ("n", 0)}
    assert [r.key for r in got if r.event == "done"].count("clock") >= 1
    with pytest.raises(ValueError):
        T.retry_events(None, most=3, pause=60, forget=240)


def _causes(rows, kind, at, name):
    return rows.where(F.col("event_type") == kind).select("user_id", F.col("ts").cast("timestamp").alias(at), F.col("event_id").alias(name))


def test_interval_join_of_streams_equals_tables(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    want = J.interval_join(_causes(rows, "purchase", "at", "event"), _causes(rows, "click", "cause_at", "cause"), "user_id", "at", "cause_at", 7200)
    plain = _causes(rows, "purchase", "at", "event").alias("l").join(_causes(rows, "click", "cause_at", "cause").alias("r"), F.expr("l.user_id = r.user_id and cause_at <= at and cause_at >= at - interval 7200 seconds"))
    expected = {(r.event, r.cause) for r in plain.select("event", "cause").collect()}
    assert {(r.event, r.cause) for r in want.collect()} == expected and expected
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    side = lambda kind, at, name: _causes(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), kind, at, name).withWatermark(at, "1 hour")
    joined = J.interval_join(side("purchase", "at", "event"), side("click", "cause_at", "cause"), "user_id", "at", "cause_at", 7200)
    joined.writeStream.format("memory").queryName("near").trigger(availableNow=True).start().awaitTermination(120)
    got = [(r.event, r.cause) for r in spark.table("near").collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_late_rows_go_to_their_own_table(spark, tmp_path):
    schema, target = "id int, at timestamp", str(tmp_path / "out")

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        J.write_with_late(stream, target, str(tmp_path / "state"), "at", "1 hour").start().awaitTermination(60)

    add([(1, _at(0)), (2, _at(7200)), (3, None)])  # no row is late against its own batch
    add([(4, _at(3599)), (5, _at(3600)), (6, _at(20_000))])
    add([(7, _at(16_399)), (8, _at(16_400))])
    ids = lambda path: sorted(r.id for r in spark.read.parquet(path).collect())
    assert ids(target) == [1, 2, 5, 6, 8] and ids(target + "_late") == [3, 4, 7]


def test_a_run_that_fails_does_not_end_the_stream(spark, tmp_path):
    seen = []

    def step(rows, number):
        seen.append(number)
        if number == 0:
            raise RuntimeError("first run")
        rows.write.mode("overwrite").parquet(str(tmp_path / "out"))

    run = J.surviving(step)
    for k in range(2):
        spark.range(k, k + 1).write.mode("append").parquet(str(tmp_path / "in"))
        spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(60)
    assert seen == [0, 1] and run.failures == [(0, "first run")]
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]
