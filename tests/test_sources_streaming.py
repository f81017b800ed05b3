"""Sources, sinks and streams on small files of their own."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import retrieval, serving
from scriptorium.sources import files
from scriptorium.streaming import incremental as I


def test_chunk_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"text": "one"}, {"content": "two"}, {"text": ""}]))
    (tmp_path / "b.txt").write_text("x\n\n y \n")
    assert [r.chunk for r in files.read_chunks(spark, str(tmp_path / "a.json")).collect()] == ["one", "two"]
    assert [r.chunk for r in files.read_chunks(spark, str(tmp_path / "b.txt")).collect()] == ["x", "y"]


def test_news_and_images(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"000{k}_t{k}.md").write_text(f"# title {k}\nbody")
    (tmp_path / "p.png").write_bytes(b"x")
    news = files.read_news(spark, str(tmp_path), 2).collect()
    assert len(news) == 2 and all(r.title.startswith("title") for r in news)
    assert [r.page_no for r in files.read_images(spark, str(tmp_path)).collect()] == [1]


def test_sinks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("law", "a"), ("case", "b")], "kb_name string, chunk string")
    files.write_store(rows, str(tmp_path / "kb"))
    assert spark.read.parquet(str(tmp_path / "kb")).where("kb_name = 'law'").select("chunk").first()[0] == "a"
    files.write_report(rows, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    files.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2


def test_stream_writes_each_key_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, v string")
    rows.write.parquet(source)

    def run():
        stream = spark.readStream.schema(rows.schema).parquet(source)
        I.write_new(stream, target, str(tmp_path / "state"), "id").start().awaitTermination(60)

    run()
    spark.createDataFrame([(2, "b"), (3, "c")], rows.schema).write.mode("append").parquet(source)
    run()
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_windowed_stream_equals_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = I.tumbling_counts(spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp")))
    (tmp_path / "in").mkdir()
    spark.read.parquet(path).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = I.tumbling_counts(I.stream_events(spark, str(tmp_path / "in")))
    job = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    job.awaitTermination(60)
    found, want = spark.table("windows").withColumn("total", F.round("total", 4)), batch.withColumn("total", F.round("total", 4))
    assert found.count() == want.count() > 0 and found.select(want.columns).exceptAll(want).isEmpty()


def test_number_rows_without_one_task(spark):
    rows = spark.range(1000).withColumn("k", F.hash("id"))
    numbered = serving.number_rows(rows, ["k"], "n")
    assert [r.n for r in numbered.orderBy("k").collect()] == list(range(1000))


def test_cosine_blocks_agree(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    whole = retrieval.cosine_top_k(rows.where("id % 50 = 0"), rows, 5).collect()
    blocks = retrieval.cosine_top_k(rows.where("id % 50 = 0"), rows, 5, block_rows=7).collect()
    assert sorted(whole) == sorted(blocks)


def test_keyed_store_rewrites_only_what_a_change_touches(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(k, f"0{k % 3}", f"t{k}") for k in range(60)], "key bigint, kb_name string, text string")
    files.write_keyed(rows, path, "key", width=10)
    names = lambda: {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}
    before = names()
    changes = spark.createDataFrame([(4, "01", "new"), (5, "01", "added"), (900, "a/b", "far")], "key bigint, kb_name string, text string")
    assert files.update_keyed(changes, path, "key", width=10) == 2
    gone = before - names()
    assert gone and all(n.startswith("kb_name=01/key_part=0/") for n in gone)
    want = {(k, f"0{k % 3}"): f"t{k}" for k in range(60)} | {(4, "01"): "new", (5, "01"): "added", (900, "a/b"): "far"}
    assert {(r.key, r.kb_name): r.text for r in files.read_keyed(spark, path).collect()} == want
    assert {r.key for r in files.read_keyed(spark, path, "a/b").collect()} == {900}
    assert files.delete_workspace(spark, path, "a/b") and not files.delete_workspace(spark, path, "a/b")
    assert {r.kb_name for r in files.read_keyed(spark, path).collect()} == {"00", "01", "02"}
    for empty in (lambda: files.write_keyed(rows.limit(0), path + "2", "key"), lambda: files.update_keyed(rows.limit(0), path, "key"), lambda: files.write_store(rows.limit(0), path + "3")):
        with pytest.raises(ValueError):
            empty()
