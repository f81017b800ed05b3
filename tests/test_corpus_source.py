"""The corpus format: all kinds of files, large and small, filters, and restarts of its stream."""

import json

import pytest
from pyspark.sql import functions as F

from scriptorium.sources import corpus as K


@pytest.fixture
def source(spark, tmp_path):
    K.register_corpus(spark)
    folder = tmp_path / "in"
    (folder / "law").mkdir(parents=True)
    (folder / "a.md").write_text("# title\n\nbody")
    (folder / "law" / "b.txt").write_text("one\n\n  two \nthree é")
    (folder / "c.jsonl").write_text('{"text": "x"}\n"y"\n\n{"content": "z", "text": ""}\n{"n": 1}\n')
    (folder / "d.json").write_text(json.dumps([{"text": "p"}, "q", {"content": "r"}, None, ""]))
    for none in ("e.pdf", "_f.md", ".g.txt"):
        (folder / none).write_text("no")
    return folder


WANT = {("a.md", 0, "# title\n\nbody"), ("law/b.txt", 0, "one"), ("law/b.txt", 5, "two"), ("law/b.txt", 12, "three é"), ("c.jsonl", 0, "x"), ("c.jsonl", 14, "y"), ("c.jsonl", 19, "z"), ("d.json", 0, "p"), ("d.json", 1, "q"), ("d.json", 2, "r")}


@pytest.mark.parametrize("split", [1, 2, 7, 1 << 20])
def test_every_text_once_however_cut(spark, source, split):
    found = spark.read.format("corpus").option("splitBytes", split).load(str(source))
    got = [(r.name, r.at, r.text) for r in found.collect()]
    assert len(got) == len(WANT) and set(got) == WANT
    assert found.rdd.getNumPartitions() == (1 if split > 100 else len(K.stretches(K.listed(str(source)), split)))


def test_large_line_file_and_many_small_files(spark, tmp_path):
    K.register_corpus(spark)
    lines = [f"line {k} " + "ä" * (k % 50) for k in range(20_000)]
    (tmp_path / "big.txt").write_text("\n".join(lines))
    for k in range(100):
        (tmp_path / f"s{k:03d}.md").write_text(f"small {k}")
    found = spark.read.format("corpus").option("splitBytes", 100_000).load(str(tmp_path))
    assert sorted(r.text for r in found.collect()) == sorted([*(x.strip() for x in lines), *(f"small {k}" for k in range(100))])
    parts = K.stretches(K.listed(str(tmp_path)), 100_000)
    assert max(sum(high - low for _, low, high in p.parts) for p in parts) <= 100_000 and len(parts) < 20


def test_filters_choose_the_files(spark, source):
    (source / "broken.json").write_text("{")  # reading it is an error
    read = lambda condition: sorted(r.text for r in spark.read.format("corpus").load(str(source)).where(condition).collect())
    assert read("kind = 'md'") == ["# title\n\nbody"]
    assert read("name like 'law/%' and text <> 'two'") == ["one", "three é"]
    assert read("name in ('a.md', 'd.json') and at > 0") == ["q", "r"]
    assert read("kind = 'none'") == []
    with pytest.raises(Exception, match="JSON"):
        read("text = 'q'")
    with pytest.raises(Exception, match="none"):
        spark.read.format("corpus").load(str(source / "none")).count()


def test_stream_restarts_from_its_offsets(spark, source, tmp_path):
    log, out, state = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = spark.readStream.format("corpus").option("log", log).load(str(source))
        job = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(processingTime="0 seconds").start()
        try:
            job.processAllAvailable()
        finally:
            job.stop()
            job.awaitTermination(30)
        return sorted((r.name, r.at, r.text) for r in spark.read.parquet(out).collect())

    assert run() == sorted(WANT)
    import os

    (source / "late.md").write_text("late")
    os.utime(source / "late.md", (1, 1))  # older than all that was read
    assert run() == sorted([*WANT, ("late.md", 0, "late")])
    assert run() == sorted([*WANT, ("late.md", 0, "late")])
    with pytest.raises(Exception, match="log"):
        spark.readStream.format("corpus").load(str(source)).writeStream.format("noop").option("checkpointLocation", state + "2").start().awaitTermination(30)
