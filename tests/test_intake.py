"""Inputs, inserts and contents: paths and their checks, keys, order; chapters, edits, evidence of hot items."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import display as D
from scriptorium.operators import graph as G
from scriptorium.operators import retrieval as R
from scriptorium.operators import segments as S
from scriptorium.sources import files
from scriptorium.streaming import incremental as I


def test_page_images(spark, tmp_path):
    for name in ("b.PNG", "a.jpg", "c.webp", "note.txt"):
        (tmp_path / name).write_bytes(b"x")
    names = lambda found: [(r.page_no, r.image_path.rsplit("/", 1)[-1], r.source_type) for r in found.orderBy("page_no").collect()]
    folder = str(tmp_path)
    assert names(files.page_images(spark, folder)) == [(1, "a.jpg", "image"), (2, "b.PNG", "image"), (3, "c.webp", "image")]
    assert names(files.page_images(spark, folder + "/?.[jw]*")) == [(1, "a.jpg", "image"), (2, "c.webp", "image")]
    assert names(files.page_images(spark, [folder + "/c.webp", folder + "/a.jpg", folder + "/c.webp"])) == [(1, "c.webp", "image"), (2, "a.jpg", "image"), (3, "c.webp", "image")]
    assert names(files.page_images(spark, folder + "/b.PNG")) == [(1, "b.PNG", "image")]
    assert files.page_images(spark, folder + "/*.gif").count() == 0 and files.page_images(spark, []).count() == 0
    for wrong in (folder + "/d.png", [folder + "/a.jpg", folder + "/d.png"], folder + "/none"):
        with pytest.raises(FileNotFoundError):
            files.page_images(spark, wrong)
    for wrong in (folder + "/note.txt", [folder + "/note.txt"], folder + "/*", [folder]):
        with pytest.raises(ValueError):
            files.page_images(spark, wrong)


def test_insert_rows_gives_keys_and_refuses_repeats(spark, tmp_path):
    path, schema = str(tmp_path / "users"), "mail string, at int, name string"
    first = spark.createDataFrame([("a", 2, "x"), ("b", 1, "y"), ("a", 3, "z"), (None, 5, "p"), (None, 4, "q")], schema)
    refused = files.insert_rows(first, path, "id", ["at"], ["mail"])
    assert [(r.mail, r.at) for r in refused.collect()] == [("a", 3)]
    again = spark.createDataFrame([("b", 6, "w"), ("c", 8, "v"), ("d", 7, "u")], schema)
    assert [r.mail for r in files.insert_rows(again, path, "id", ["at"], ["mail"]).collect()] == ["b"]
    stored = {(r.id, r.mail, r.at) for r in spark.read.parquet(path).collect()}
    assert stored == {(1, "b", 1), (2, "a", 2), (3, None, 4), (4, None, 5), (5, "d", 7), (6, "c", 8)}
    assert files.insert_rows(again, path, "id", ["at"]).count() == 0 and spark.read.parquet(path).agg(F.max("id")).first()[0] == 9
    with pytest.raises(ValueError):
        files.insert_rows(first.limit(0), path, "id", ["at"])


def test_contents_are_written_in_order(spark, tmp_path):
    docs = spark.range(500).select(F.format_string("%04d.md", (F.col("id") * 7) % 500).alias("path"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("x\n# t"), "id")).otherwise("no heading").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([("README.md", "# r"), ("SUMMARY.md", "# s"), ("a.txt", "# t")], docs.schema))
    files.write_contents(docs, str(tmp_path / "toc"), "Contents")
    lines = "".join(p.read_text() for p in sorted(Path(tmp_path / "toc").glob("part-*"))).split("\n")
    assert lines[0] == "# Contents" and dt.datetime.fromisoformat(lines[2]) and lines[3] == ""
    listed = [x for x in lines[4:] if x]
    assert len(listed) == 500 and [x.split("](")[1] for x in listed] == [f"{k:04d}.md)" for k in range(500)]
    assert listed[0] == "- [t0](0000.md)" and listed[7] == "- [0007.md](0007.md)"


def test_chapters(spark):
    rows = [(1, "# one\n## sub\ntext\n\n# two\n#no\n # no\n# \n# three"), (2, None), (3, ""), (4, "\n# a"), (5, "before\n# a")]
    got = {(r.id, r.chapter_no): r.text for r in S.split_chapters(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()}
    assert got == {(1, 1): "# one\n## sub\ntext", (1, 2): "# two\n#no\n # no", (1, 3): "#", (1, 4): "# three", (4, 1): "# a", (5, 1): "before", (5, 2): "# a"}


def test_edits_and_renames(spark):
    nodes = spark.createDataFrame([("a", "k", "d"), ("b", None, "e")], "name string, kind string, description string")
    changed, unknown = G.edit_rows(nodes, spark.createDataFrame([("a", None, "new"), ("z", "k", "n")], "name string, kind string, description string"), ["name"])
    assert {tuple(r) for r in changed.collect()} == {("a", "k", "new"), ("b", None, "e")} and [r.name for r in unknown.collect()] == ["z"]
    with pytest.raises(ValueError):
        G.edit_rows(nodes, nodes.withColumnRenamed("kind", "other"), ["name"])
    hub = spark.range(30_000).select(F.concat(F.lit("n"), "id").alias("src"), F.lit("hub").alias("dst"), F.lit(1).alias("weight"))
    names = spark.createDataFrame([("hub", "HUB"), ("n5", "five")], "name string, new_name string")
    renamed = D.rename_entities(nodes, hub.unionByName(spark.createDataFrame([(None, "hub", 2)], "src string, dst string, weight int")), names)[1]
    assert renamed.count() == 30_001 == renamed.where("dst = 'HUB'").count() and renamed.where("src = 'five'").count() == renamed.where("src is null").count() == 1


def test_first_successful_of_a_hot_item(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).when(F.col("id") % 3 == 1, "hot").otherwise(F.concat(F.lit("i"), "id")).alias("item"), (F.col("id") % 4 + 1).alias("q"), "id")
    want = {tuple(r) for r in R.first_successful(rows, "item", "q", few=True).select("item", "q", "id", "fallback_query").collect()}
    for least in (100, 10_000):
        got = [tuple(r) for r in R.first_successful(rows, "item", "q", least=least).select("item", "q", "id", "fallback_query").collect()]
        assert len(got) == len(want) and set(got) == want


def test_periodic_writer_goes_on(spark, tmp_path):
    schema, source, target = "id int, v string", str(tmp_path / "in"), str(tmp_path / "out")
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    add([(1, "a"), (None, "n")])
    job = I.write_new(spark.readStream.schema(schema).parquet(source), target, str(tmp_path / "state"), "id", every="1 second", survive=True).start()
    try:
        job.processAllAvailable()
        add([(1, "a"), (2, "b"), (None, "n")])
        job.processAllAvailable()
        assert job.isActive and sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 2]
    finally:
        job.stop()
        job.awaitTermination(30)
