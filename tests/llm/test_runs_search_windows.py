"""Periodic runs, ranked search and window packing against brute force, the tokenizers library and odd inputs."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from oracle import compare
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scriptorium.llm import clustered_search, periodic_runs, queries, window_packing
from scriptorium.staging import stage

DATA = "/root/testdata/sf0.001"
WORD = public_tokenizers.path("word_bpe_49k.json")
LONG = "the long tale goes on and on " * 20_000
ODD = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t ", "en"), (4, "same text of a few words here " * 3, "en"), (4, "same text of a few words here " * 3, "en"),
    (None, "a row that has no id at all, but a text", None), (5, LONG, "en"), (6, "ünïcødé 漢字。🙂 <|endoftext|> don't  stop now 12345\x1c\x85 ΣΑΣ " + "漢字。" * 4000, "de"), (7, "word " * 9000, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    more = {c: F.lit("mine") for c in ("runs", "collapsed", "start", "length", "ids", "term", "shard", "score", "rank", "offset", "leaf")}
    return spark.createDataFrame(ODD, "doc_id bigint, text string, lang string").withColumns(more)


# --- 11 --------------------------------------------------------------------------------------------


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            if len(part) >= max(24, 3 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((i, len(part), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected_runs(doc_id, text):
    words = text.encode().split() if text else []
    h, n = (zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def digest(r):
    return (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)


def test_runs_of_random_words_match_brute_force():
    rng = random.Random(1)
    for _ in range(500):
        n, k = rng.randrange(0, 300), rng.choice([1, 2, 3, 5, 40])
        words = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(3) if n > 30 else 0):
            a, p, size = rng.randrange(n - 20), rng.randrange(1, 40), rng.randrange(20, 160)
            for i in range(a + p, min(n, a + size)):
                words[i] = words[i - p]
        assert periodic_runs.find_runs(np.array(words, np.int32)) == brute_runs(words)


@pytest.mark.parametrize("n, values", [(400, 3), (5_000, 40), (5_000, 4_000)])
def test_lag_matches_of_heavy_and_light_words_are_exact(n, values):
    codes = (np.random.default_rng(n).zipf(1.4, n) % values).astype(np.int32)
    often = np.bincount(codes)[codes] >= 3
    got = periodic_runs.lag_matches(codes, n // 3)
    assert got[1:].tolist() == [int(((codes[:-q] == codes[q:]) & often[q:]).sum()) for q in range(1, n // 3 + 1)]


def test_run_digests_of_the_whole_table_match_brute_force(docs):
    want = {r.doc_id: expected_runs(r.doc_id, r.text) for r in docs.collect()}
    got = {r.doc_id: digest(r) for r in periodic_runs.run_digests(docs).collect()}
    assert got == want and sum(w[0] > 0 for w in want.values()) > 10


def test_runs_of_odd_rows(spark, odd):
    got = periodic_runs.run_digests(odd).collect()
    assert Counter(map(digest, got)) == Counter(expected_runs(*r[:2]) for r in ODD if r[0] != 5) + Counter(digest(r) for r in got if r.doc_id == 5)
    (long,) = [r for r in periodic_runs.annotate_runs(odd).collect() if r.doc_id == 5]
    assert [tuple(r) for r in long.runs] == [(0, 140_000, 7)] and long.collapsed == "the long tale goes on and on" and long.start == "mine"
    assert periodic_runs.run_digests(odd.limit(0)).count() == 0


def test_a_million_equal_words_and_nested_periods():
    assert periodic_runs.find_runs(np.zeros(1_000_000, np.int32)) == [(0, 1_000_000, 1)]
    inner = [1] * 30 + [2, 3]
    assert periodic_runs.find_runs(np.array(inner * 4, np.int32)) == [(0, 30, 1), (0, 128, 32), (32, 30, 1), (64, 30, 1), (96, 30, 1)]


# --- 13 --------------------------------------------------------------------------------------------


def check_windows(rows, texts, capacity=4096):
    """Each document's ids lie in its pieces in order, sequences are gapless; returns padding and tokens."""
    tokenizer = Tokenizer.from_file(WORD)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_window[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for key, parts in by_doc.items():
        ids = np.array(tokenizer.encode(texts[key] or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for parts in by_window.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        fill = sum(r.length for r in parts)
        assert fill <= capacity
        padding += 0 if fill & (fill - 1) == 0 else capacity - fill
    return padding, sum(r.length for r in rows)


def test_windows_of_the_whole_table(docs):
    padding, tokens = check_windows(window_packing.pack_windows(docs, WORD).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert padding <= 0.01 * tokens


def test_windows_hand_on_between_spans_and_keep_the_order(docs):
    rows = window_packing.pack_windows(docs.coalesce(1), WORD, span=20_000).collect()
    padding, tokens = check_windows(rows, {r.doc_id: r.text for r in docs.collect()})
    assert padding <= 0.01 * tokens
    placed = [(r.sequence_id, r.offset, r.start) for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
    order = [r.doc_id for r in docs.coalesce(1).collect()]
    met = list(dict.fromkeys(r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))))
    assert placed == sorted(placed) and met == order


def test_windows_of_odd_rows(spark, odd):
    rows = window_packing.pack_windows(odd.where("doc_id is null or doc_id <> 4"), WORD, with_ids=True).collect()
    padding, tokens = check_windows(rows, {k: t for k, t, _ in ODD if k != 4})
    assert padding <= 0.05 * tokens and all(len(r.ids) == r.length for r in rows)
    both = window_packing.pack_windows(odd.where("doc_id = 4"), WORD).collect()
    assert sum(r.length for r in both) == 2 * both[0].doc_tokens
    assert window_packing.pack_windows(odd.limit(0), WORD).count() == 0


def test_cuts_have_the_least_cost():
    rng = random.Random(2)
    for _ in range(300):
        capacity = rng.choice([48, 64])
        places, penalties = [0], [0]
        for _ in range(rng.randrange(2, 50)):
            places.append(places[-1] + rng.randrange(1, rng.choice([3, 20, 48])))
            penalties.append(rng.choice([0, window_packing.SENTENCE, window_packing.HARD]))
        penalties[-1] = 0
        known = dict(zip(places, penalties, strict=True))
        for last in (True, False):
            least = [0] + [10**9] * (len(places) - 1)
            for j in range(1, len(places)):
                for i in range(j):
                    fill = places[j] - places[i]
                    if fill <= capacity:
                        cost = window_packing.window_cost(fill, capacity)
                        if last and j == len(places) - 1:
                            cost = min(cost, window_packing.HARD * (fill.bit_count() - 1))
                        least[j] = min(least[j], least[i] + cost + penalties[j])
            cuts = window_packing.choose_cuts(np.array(places), np.array(penalties), capacity, last)
            paid = sum(window_packing.window_cost(b - a, capacity) + known.get(b, window_packing.HARD) for a, b in zip(cuts, cuts[1:]))
            assert cuts[0] == 0 and cuts[-1] == places[-1] and paid == least[-1]


def test_sentence_tokens_equal_the_library():
    rng = random.Random(3)
    tokens, tokenizer = window_packing.SentenceTokens(WORD), Tokenizer.from_file(WORD)
    letters = "abcXYZ .!?\n\t\r'1234éÉΣς漢字。！ \xa0́\x1c\x85🙂-"
    for _ in range(3_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        if rng.random() < 0.2:
            text = text[:20] + rng.choice(["<|endoftext|>", "<|ENDOFTEXT|>", "x" * 400 + ". y."]) + text[20:]
        ids, ends = tokens.encode(text)
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert (np.diff(ends) > 0).all() and (not len(ends) or ends[-1] <= len(ids))
    ids, ends = tokens.encode("One two. Three (four!) five\nsix 3.5 seven?")
    words = [tokenizer.id_to_token(i) for i in ids]
    assert [words[e - 1] for e in ends] == [".</w>", "!)</w>", "five</w>", "?</w>"]


# --- 12 --------------------------------------------------------------------------------------------


def brute_search(docs, items, k=10):
    held = [(key, Counter(clustered_search.terms_of(text))) for key, text in docs]
    held = [(key, c) for key, c in held if c]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked = {*clustered_search.terms_of(text)}
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in asked if df[t]}
        scored = []
        for key, c in held:
            m = 10 + 90 * c.total() * n // total
            score = sum(w * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, w in weight.items() if t in c)
            if score > 0:
                scored.append((-score, key is None, key or 0))
        out += [(item, rank, None if missing else key, -score) for rank, (score, missing, key) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def found(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_search_of_the_whole_table_matches_sql_and_brute_force(spark, docs):
    compare(spark, queries.op12_clustered_search, queries.oracle_sql()["op12_clustered_search"])
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = found(clustered_search.search_documents(docs, items))
    assert got == brute_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_search_does_not_depend_on_shards_or_tree(spark, docs):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    want = found(clustered_search.search_documents(docs, items))
    index = clustered_search.build_index(docs, sample=50, depth=3, shard_postings=2_000)
    assert index.postings.select("shard").distinct().count() > 20
    assert found(clustered_search.search(index, items)) == want


def test_search_stops_before_shards_that_cannot_matter(spark, monkeypatch):
    # four languages of their own: a query's best documents are in its language, the others cannot reach them
    rng = random.Random(4)
    rows = [(k, " ".join(f"{'abcd'[k % 4]}{min(int(rng.expovariate(0.05)), 80)}" for _ in range(40))) for k in range(800)]
    index = clustered_search.build_index(spark.createDataFrame(rows, "doc_id bigint, text string"), depth=4, shard_postings=2_000)
    visited = []
    monkeypatch.setattr(clustered_search, "stage", lambda df, name: visited.append((made := stage(df, name)).count()) or made if name == "visits" else stage(df, name))
    items = [(k, " ".join(f"{'abcd'[k % 4]}{j + k}" for j in range(8))) for k in range(12)]
    got = found(clustered_search.search(index, spark.createDataFrame(items, "item_id bigint, text string")))
    assert got == brute_search(rows, items)
    assert sum(visited) < 12 * index.postings.select("shard").distinct().count() / 2


def test_search_of_odd_rows(spark, odd):
    items = [(1, "Same TEXT and the long tale"), (1, "漢字 stop 12345"), (2, None), (3, ""), (4, "nowhere"), (None, "word words id ID"), (5, "ÜNÏCØDÉ ünïcødé")]
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("rank", F.lit("mine")).withColumn("term", F.lit("mine"))
    got = found(clustered_search.search_documents(odd, asked))
    assert got == brute_search([r[:2] for r in ODD], items)
    assert clustered_search.search_documents(odd.limit(0), asked).count() == 0
    assert clustered_search.search_documents(odd, asked.limit(0)).count() == 0


def test_ties_beyond_k_go_to_the_smallest_ids(spark):
    rows = [(k, "equal words in many copies") for k in range(300, 0, -1)] + [(500 + k, "other") for k in range(50)]
    index = clustered_search.build_index(spark.createDataFrame(rows, "doc_id bigint, text string"), shard_postings=100)
    items = spark.createDataFrame([(1, "equal copies")], "item_id bigint, text string")
    assert [r.doc_id for r in clustered_search.search(index, items).orderBy("rank").collect()] == list(range(1, 11))


def test_bisection_lowers_the_cost_and_parts_topics():
    rng = np.random.default_rng(5)
    docs = [np.unique(rng.integers(0, 40, 12) + 40 * (k % 2)) for k in range(200)]
    graph = clustered_search.Graph(docs, 80)
    left, right = graph.bisect(np.arange(200))
    assert sorted([*left, *right]) == list(range(200)) and len(left) == 100
    assert graph.cost(left) + graph.cost(right) < graph.cost(np.arange(100)) + graph.cost(np.arange(100, 200))
    assert len({int(d) % 2 for d in left}) == len({int(d) % 2 for d in right}) == 1
    tree = clustered_search.fit_tree([[b"%d" % t for t in d] for d in docs], depth=1)
    assert len({tree.leaf([b"%d" % t for t in docs[k]]) for k in range(0, 200, 2)}) == 1
