"""The pipeline's stages on the smallest tables: columns, effect, and what they keep."""

import itertools

from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import kneser_ney, line_crf
from scriptorium.staging import stage
from scriptorium.tables import table

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = table(spark, DATA, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, step in corpus_pipeline.STAGES:
        made = stage(step(spark, docs, DATA), "t")
        if name != "best-fit packing":
            assert made.columns == columns
            assert {r[0] for r in made.select("doc_id").collect()} <= {r[0] for r in docs.select("doc_id").collect()}
            counts.append(made.count())
            docs = made
    assert counts[0] > counts[1] >= counts[2] == counts[3] > counts[4] > 0.5 * counts[0]
    assert {r[0] for r in made.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_quality_rules_fit_on_the_whole_table(spark, monkeypatch):
    given = []
    monkeypatch.setattr(corpus_pipeline.line_crf, "fit_from_labels", lambda docs, labels: given.append(docs.count()) or corpus_pipeline.line_crf.Field())
    docs = table(spark, DATA, "documents")
    corpus_pipeline.quality_rules(spark, docs.limit(3), DATA)
    assert given == [docs.count()]


LONG = "a long tale of many words that goes on and on and on until the end of it, "
ODD = [
    (1, None, None, None, None), (None, "x " * 80, None, None, 160), (2, "", "en", "s", 0), (3, LONG * 4000, "en", "s", 0), (4, "short one", "en", "s", 9), (4, "short one", "en", "s", 9),
    (5, "\n".join(f"{LONG}{k}" for k in range(3)), "fr", "s", 9), (6, "\n".join(f"{LONG}{k}" for k in range(3)), "fr", "s", 9),
]


def test_stages_on_odd_rows_and_clashing_columns(spark):
    schema = table(spark, DATA, "documents").schema
    more = {c: F.lit("mine") for c in ("row", "node", "root", "kept", "n", "hash", "place", "chunk", "key", "check", "salt")}
    rows = spark.createDataFrame(ODD, schema).withColumns(more)
    ids = lambda made: sorted(((r.doc_id, r.text) for r in made.select("doc_id", "text").collect()), key=str)
    stages = dict(corpus_pipeline.STAGES)
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, rows.limit(0), DATA).count() == 0
        if name != "best-fit packing":
            made = step(spark, rows, DATA)
            assert made.columns == rows.columns and made.where("kept <> 'mine' or row <> 'mine'").isEmpty()
    kept = ids(stages["quality classifier"](spark, rows, DATA))
    assert not any(text in (None, "") for _, text in kept) and {(4, "short one")} <= set(kept) and kept.count((4, "short one")) == 2
    assert all(len(text.split()) >= 50 for _, text in ids(stages["quality rules"](spark, rows, DATA)))
    lines = dict(ids(stages["line dedup"](spark, rows, DATA)))
    # three lines that differ by one letter are one
    assert lines[5] == f"{LONG}0" and lines[6] == "" and lines[1] is None and lines[4] in ("", "short one") and lines[3] == ODD[3][1]
    # equal rows are one document; null and empty texts have the same empty set of shingles
    assert [k for k, _ in ids(stages["simhash near-dedup"](spark, rows, DATA))] == [1, 3, 4, 5, None]
    packed = stages["best-fit packing"](spark, rows, DATA).collect()
    assert sum(r.piece == 0 for r in packed) == len(ODD) and {r.doc_id for r in packed} == {r[0] for r in ODD}


def test_each_stage_matches_brute_force(spark):
    docs, stages = table(spark, DATA, "documents"), dict(corpus_pipeline.STAGES)
    labels = table(spark, DATA, "labels")
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = lambda made: {r.doc_id: r.text for r in made.collect()}
    judged = {r.doc_id for r in kneser_ney.classify(docs.select("doc_id", "lang", "text"), labels).where("kept").collect()}
    assert set(held(stages["quality classifier"](spark, docs, DATA))) == judged
    field = line_crf.fit_from_labels(docs, labels)
    assert set(held(stages["quality rules"](spark, docs, DATA))) == {k for k, t in texts.items() if line_crf.judge(t or "", field)[6]}
    sets = {}
    for k, t in texts.items():
        words = (t or "").encode().lower().split()
        sets[k] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}
    first = {k: k for k in texts}

    def find(k):
        while first[k] != k:
            k = first[k]
        return k

    for a, b in itertools.combinations(sorted(texts), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            first[max(a, b)] = min(a, b)
    assert held(stages["simhash near-dedup"](spark, docs, DATA)) == {k: texts[k] for k in texts if find(k) == k}
