"""The inverted lexical index: exactness, early ending, and what a scan opens."""

import math
import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from scriptorium.operators import graph as G
from scriptorium.operators import lexical as L
from scriptorium.operators.skew import join_spread


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    return [(k, " ".join(f"{'abcd'[k % 4]}{''.join(chr(97 + int(c)) for c in str(min(int(rng.expovariate(0.08)), 60)))}" for _ in range(rng.randrange(3, 60)))) for k in range(600)]


def brute(docs, queries, k):
    held = {key: [w for w in (text or "").lower().replace(".", " ").split() if w] for key, text in docs}
    n, mean = len(held), sum(map(len, held.values())) / len(held)
    df = Counter(t for words in held.values() for t in {*words})
    out = []
    for q, text in queries:
        asked = {*(text or "").lower().split()}
        scored = []
        for key, words in held.items():
            tf = Counter(words)
            s = round(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(words) / mean)) for t in asked if tf[t]), 6)
            if s > 0:
                scored.append((-s, key))
        out += [(q, key, -s, rank) for rank, (s, key) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def rows(df):
    return sorted((r.query_id, r.item_id, round(r.score, 6), r["rank"]) for r in df.collect())


def test_many_queries_match_brute_force_in_small_blocks(spark, corpus):
    index = L.build_lexical_index(spark.createDataFrame(corpus, "key bigint, text string"), "key", "text", block_docs=20)
    queries = [(k, corpus[k][1]) for k in range(0, 600, 50)] + [(9_000, "nowhere"), (9_001, None), (9_002, "AB ab aba")]
    got = L.lexical_top_k(index, spark.createDataFrame(queries, "query_id bigint, text string"), 7)
    assert rows(got) == brute(corpus, queries, 7)


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_queries_scored_on_shelves_match_brute_force(spark, corpus, monkeypatch, kind):
    for name, value in (("EARLY_ENTRIES", 0), ("SHELF_ENTRIES", 700), ("GROUP_TERMS", 60), ("STRIP", 3)):
        monkeypatch.setattr(L, name, value)
    docs = [*corpus, *[(600 + k, corpus[k % 8][1]) for k in range(40)], (700, None), (701, "")]
    cast = str if kind == "string" else int
    docs = [(cast(key), text) for key, text in docs]
    index = L.build_lexical_index(spark.createDataFrame(docs, f"key {kind}, text string"), "key", "text", block_docs=20)
    queries = [(k, corpus[k][1]) for k in range(0, 600, 50)] + [(9_000, "nowhere"), (9_001, None), (9_002, "AB ab aba")]
    stages, stage = [], L.stage
    monkeypatch.setattr(L, "stage", lambda df, name, *more: stages.append(name) or stage(df, name, *more))
    got = L.lexical_top_k(index, spark.createDataFrame(queries, "query_id bigint, text string"), 7)
    assert rows(got) == brute(docs, queries, 7)
    assert "visits" not in stages and len({p[1] for p in L._shelves(index.postings)}) > 8


def shuffled(spark):
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_more_groups_and_shelves_shuffle_no_more(spark, corpus, monkeypatch):
    index = L.build_lexical_index(spark.createDataFrame(corpus, "key bigint, text string"), "key", "text", block_docs=20)
    queries = spark.createDataFrame(corpus[::5], "query_id bigint, text string")
    wrote, found = [], []
    for terms, entries in ((100_000, 100_000), (60, 300)):
        for name, value in (("EARLY_ENTRIES", 0), ("GROUP_TERMS", terms), ("SHELF_ENTRIES", entries), ("SHELVES", 1)):
            monkeypatch.setattr(L, name, value)
        before = shuffled(spark)
        found.append(rows(L.lexical_top_k(index, queries, 3)))
        wrote.append(shuffled(spark) - before)
    assert found[0] == found[1] == brute(corpus, corpus[::5], 3)
    assert wrote[1] < 3 * wrote[0]


def test_hybrid_search_shuffles_no_more_for_more_groups(spark, monkeypatch):
    from scriptorium.plans import catalog

    run, wrote, found = catalog.queries()["rt1_hybrid"], [], []
    for terms, entries in ((1_000_000, 4_000_000), (100, 2_000)):
        for name, value in (("EARLY_ENTRIES", 0), ("GROUP_TERMS", terms), ("SHELF_ENTRIES", entries), ("SHELVES", 1)):
            monkeypatch.setattr(L, name, value)
        before = shuffled(spark)
        found.append(rows(run(spark, "/root/testdata/sf0.001")))
        wrote.append(shuffled(spark) - before)
    assert found[0] and found[0] == found[1]
    assert wrote[1] < 2 * wrote[0]


def test_queries_end_before_blocks_that_cannot_matter(spark, corpus, monkeypatch):
    index = L.build_lexical_index(spark.createDataFrame(corpus, "key bigint, text string"), "key", "text", block_docs=10)
    scored, stage = [], L.stage
    monkeypatch.setattr(L, "stage", lambda df, name, *more: scored.append((made := stage(df, name, *more)).count()) or made if name == "visits" else stage(df, name, *more))
    queries = [(k, f"{'abcd'[k % 4]}{chr(97 + k)}b {'abcd'[k % 4]}c") for k in range(8)]
    got = L.lexical_top_k(index, spark.createDataFrame(queries, "query_id bigint, text string"), 3)
    assert rows(got) == brute(corpus, queries, 3)
    assert sum(scored) < 8 * index.postings.select("block").distinct().count() / 2


def test_a_few_terms_open_their_partitions_only(spark, corpus):
    index = L.build_lexical_index(spark.createDataFrame(corpus, "key bigint, text string"), "key", "text")
    terms = spark.createDataFrame([("ab",), ("ba",)], "term string")
    read = L.asked_postings(index, terms)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(term, [" in plan
    assert {r.term for r in read.select("term").distinct().collect()} <= {"ab", "ba"}
    many = spark.createDataFrame([(f"{c}{d}{e}",) for c in "abcd" for d in "abcdef" for e in "abcdefghij"], "term string")
    assert many.count() > L.LITERAL_TERMS
    assert L.asked_postings(index, many).count() == index.postings.join(many, "term", "left_semi").count()


def test_empty_and_null_rows(spark):
    schema, asked = "key bigint, text string", spark.createDataFrame([(1, "same"), (2, None), (3, "")], "query_id bigint, text string")
    odd = [(1, None), (2, ""), (3, "same words"), (4, "same words"), (5, "12 . 5")]
    index = L.build_lexical_index(spark.createDataFrame(odd, schema), "key", "text")
    got = L.lexical_top_k(index, asked, 1).collect()
    assert [(r.query_id, r.item_id) for r in got] == [(1, 3)] and index.documents == 5
    empty = L.build_lexical_index(spark.createDataFrame([], schema), "key", "text")
    assert L.lexical_top_k(empty, asked, 5).count() == 0 and L.lexical_top_k(index, asked.limit(0), 5).count() == 0


# --- graph -----------------------------------------------------------------------------------------


def test_chains_of_aliases_end_at_their_root(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(50)] + [(f"h{i}", "n7") for i in range(300)] + [("x", "x"), ("y", None), (None, "z"), ("two", "b"), ("two", "a")]
    aliases = spark.createDataFrame(chain, "name string, target string")
    got = {r.name: r.target for r in G.resolve_aliases(aliases, least=10).collect()}
    assert got == {f"n{i}": "n50" for i in range(50)} | {f"h{i}": "n50" for i in range(300)} | {"two": "a"}
    nodes = spark.createDataFrame([(n, "k", n) for n in ("n0", "n1", "n49", "n50", "h5", "q")], "name string, kind string, description string")
    edges = spark.createDataFrame([(f"h{i}", "q", 1) for i in range(300)] + [("n0", "n1", 5), ("q", "n3", 2)], "src string, dst string, weight int")
    merged, moved = G.merge_entities(nodes, edges, aliases, least=10)
    assert sorted(r.name for r in merged.collect()) == ["n50", "q"]
    assert sorted(map(tuple, moved.collect())) == [("n50", "q", 300), ("q", "n50", 2)]


def test_names_are_not_broadcast(spark):
    links = spark.createDataFrame([(f"n{i}", f"n{i - 1}") for i in range(60) if i % 20], "name string, target string")
    nodes = spark.createDataFrame([(f"n{i}", "k", "d") for i in range(60)], "name string, kind string, description string")
    edges = spark.createDataFrame([(f"n{i}", "x", 1) for i in range(60)], "src string, dst string, weight int")
    for made in G.merge_entities(nodes, edges, links):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("length", [2, 3, 8, 13])
def test_circles_of_aliases_are_told(spark, length):
    pairs = [(f"c{i}", f"c{(i + 1) % length}") for i in range(length)] + [("tail", "c0"), ("a", "b")]
    with pytest.raises(ValueError, match="circle"):
        G.resolve_aliases(spark.createDataFrame(pairs, "name string, target string"))


def test_expansion_through_hubs_matches_a_walk(spark):
    rng = random.Random(6)
    pairs = [(f"v{rng.randrange(120)}", f"v{rng.randrange(120)}", 1) for _ in range(90)] + [("hub", f"v{i}", 1) for i in range(0, 120, 2)] + [(None, "v1", 1), ("v2", None, 1)]
    edges = spark.createDataFrame(pairs, "src string, dst string, weight int")
    seeds = [(1, "v0"), (1, "v5"), (2, "hub"), (3, "nowhere"), (4, None)]
    near = {}
    for a, b, _ in pairs:
        if a and b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = set()
    for q in (1, 2, 3):
        seen = {n: 0 for query, n in seeds if query == q}
        for hop in range(1, 4):
            for n in [m for n, h in seen.items() if h == hop - 1 for m in near.get(n, ()) if m not in seen]:
                seen.setdefault(n, hop)
        want |= {(q, n, h) for n, h in seen.items()}
    got = [tuple(r) for r in G.expand(edges, spark.createDataFrame(seeds, "query_id int, name string"), 3, least=5).where("name is not null").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert G.expand(edges.limit(0), spark.createDataFrame(seeds[:1], "query_id int, name string"), 2).count() == 1


def test_spread_joins_keep_rows_of_hot_and_missing_keys(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)] + [(None, 999)], "k string, i int")
    side = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("k3", "c"), (None, "d")], "k string, v string")
    for how in ("inner", "left"):
        got, want = (Counter(tuple(r) for r in df.select("k", "i", "v").collect()) for df in (join_spread(rows, side, "k", F.col("i"), how, least=5), rows.join(side, "k", how)))
        assert got == want
