"""The training-data operators against brute force, round trips, held-out accuracy and odd inputs."""

import hashlib
import itertools
import math
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scriptorium.llm import bpe, common, kneser_ney, language_mixture, license_scan, line_crf, line_dedup, packing, simhash, site_style, transport_stream

DATA = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = "the long tale goes on and on " * 20_000
ODD = [
    (1, None, None, None, 0), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "same text of a few words here " * 3, "en", "s", 90),
    (4, "same text of a few words here " * 3, "en", "s", 90), (None, "a row that has no id at all, but a text", "fr", None, 39), (5, LONG, "en", "s", len(LONG)), (6, "ünïcødé 漢字 🙂 <|endoftext|> don't  stop now 12345", "de", "s", 40), (7, "1234 5678", None, "s", 9),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    # further columns clash with names that operators use
    more = {c: F.lit("mine") for c in ("key", "node", "root", "hash", "kept", "row", "h", "p", "n", "piece", "chunk", "place")}
    return spark.createDataFrame(ODD, SCHEMA).withColumns(more)


OPERATORS = {
    "language": lambda d, labels: language_mixture.predict_languages(d),
    "kneser_ney": lambda d, labels: kneser_ney.classify(d, labels),
    "simhash": lambda d, labels: simhash.fingerprint_components(d),
    "line_dedup": lambda d, labels: line_dedup.dedup_lines(d),
    "media": lambda d, labels: transport_stream.media_digests(d),
    "line_crf": lambda d, labels: line_crf.line_quality(d, line_crf.fit_from_labels(d, labels)),
    "license": lambda d, labels: license_scan.license_report(d),
    "bpe": lambda d, labels: bpe.encoding_digests(d, WORD),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, odd, name):
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 0), (99, 0, 1)], "doc_id bigint, quality int, toxic int")
    got = OPERATORS[name](odd, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ODD)
    assert OPERATORS[name](odd.limit(0), labels.limit(0)).count() == 0


def test_odd_packing_and_pages(spark, odd):
    got = packing.pack(odd, BYTE).collect()
    assert {r.doc_id for r in got} == {r[0] for r in ODD}
    assert packing.pack(odd.limit(0), BYTE).count() == 0
    pages = spark.createDataFrame([(1, None, None), (2, "http://h/x", ""), (None, "x", "<p>a<p>b"), (3, "http://h/y", "<div>" * 3000 + "deep")], "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in site_style.page_texts(pages).collect()} == {1: "", 2: "", None: "a b", 3: "deep"}
    assert site_style.page_texts(pages.limit(0)).count() == 0
    assert simhash.keep_first(odd).count() <= len(ODD) and simhash.keep_first(odd.limit(0)).count() == 0


# --- 1 ---------------------------------------------------------------------------------------------


def test_site_style_drops_repeated_branches(spark):
    page = "<html><head><title>t</title></head><body><nav>home</nav><div class='strip'>Buy now</div><div class='text'><p>Story {0} is &amp; was</p><p>told  in\n{0} parts<br>twice</p></div><div class='comments'>first! {0}</div><script>x</script></body></html>"
    rows = spark.createDataFrame([(k, f"http://h.x/{k}", page.format(k)) for k in range(12)], "page_id int, url string, html string")
    got = {r.page_id: r.text for r in site_style.page_texts(rows).collect()}
    assert got == {k: f"Story {k} is & was told in {k} parts twice" for k in range(12)}


def test_style_tree_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    pages = []
    for k in range(60):
        body = [f"<div class='top'><p>{rng.choice(['one', 'two'])}</p><p>same</p></div>"] * int(rng.integers(1, 3))
        body += [f"<p>own {k} {j}</p>" for j in range(rng.integers(0, 4))] + ["<section><div>tail<div>deep</div></div></section>"] * int(rng.integers(0, 2))
        pages.append((k, f"http://h{k % 3}.x/{k}", f"<body>{''.join(body)}</body>"))
    got = {(r.host, r.node): r for r in site_style.style_tree(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    for h in range(3):
        own = [site_style.Page(p) for _, u, p in pages if u.startswith(f"http://h{h}.")]
        nodes = set().union(*[p.up for p in own])

        def entropy(values, m):
            return -sum(n / sum(values) * math.log(n / sum(values), m) for n in values) if m > 1 else 1.0

        def importance(node):
            here = [p for p in own if node in p.up]
            m = len(here)
            shown = [[x for x, y in zip(p.layout[node], [0, *p.layout[node]]) if x != y] for p in here if p.layout.get(node)]
            layouts = Counter(map(str, shown))
            fade = 0.9 ** max(len(layouts), 1)
            look = (entropy(list(layouts.values()), m) if layouts else 0.0) if m > 1 else 1.0
            texts = Counter(t for p in here for t in {t for n, t, *_ in p.blocks if n == node})
            said = 1 - sum(n * math.log(n, m) for n in texts.values()) / sum(texts.values()) if texts and m > 1 else float(bool(texts))
            mean = sum(p.layout[node].count(None) / len(p.layout[node]) for p in here if p.layout.get(node)) / m * said
            for child in {c for p in here for c in p.layout.get(node, []) if c is not None}:
                mean += sum(p.layout[node].count(child) / len(p.layout[node]) for p in here if p.layout.get(node)) / m * importance(child)
            return (1 - fade) * look + fade * mean

        def most(node):
            return max(importance(n) for n in nodes if any(node in p.up.get(n, ()) for p in own))

        assert {n for host, n in got if host == f"h{h}.x"} == nodes
        for n in nodes:
            r = got[f"h{h}.x", n]
            assert r.importance == pytest.approx(importance(n), abs=1e-9) and r.most == pytest.approx(most(n), abs=1e-9)
            assert r.pages == sum(n in p.up for p in own)


def test_the_tree_decides_where_no_name_tells(spark):
    page = "<body><div class='a'>On this site since 1999</div><div class='share-price'><p>Story {0} of the price</p></div><div class='z'><p>Call us</p><p>Write us</p></div></body>"
    rows = spark.createDataFrame([(k, f"http://h.x/{k}", page.format(k)) for k in range(12)] + [(99, "http://lone.x/", page.format(99))], "page_id int, url string, html string")
    got = {r.page_id: r.text for r in site_style.page_texts(rows).collect()}
    assert got == {k: f"Story {k} of the price" for k in range(12)} | {99: "On this site since 1999 Story 99 of the price Call us Write us"}
    assert site_style.main_text(page.format(3)) != got[3]
    assert site_style.main_text("<section class='ad-hoc-report'><p>found</p></section><div id='notice-of-award'>won</div>") == "found won"


@pytest.mark.parametrize("page", ["<a " * 300_000, "<div>" * 100_000, "<div>" * 100_000 + "</p>" * 100_000, "<nav>x" * 50_000, '<a "' * 100_000 + ">", "<!--" * 100_000, "&" * 300_000])
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    site_style.main_text(page)
    site_style.page_stats(page)
    assert time.process_time() - began < 5


def test_pages_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "http://h/1", "<p>a</p>", 5, "n"), (2, None, None, 6, "m")], "page_id int, url string, html string, host int, low string")
    got = site_style.extract_text(rows.withColumns({"text": F.lit("old"), "n": F.lit(3), "node": F.lit(4)})).collect()
    assert {(r.page_id, r.text, r.host, r.low, r.n, r.node) for r in got} == {(1, "a", 5, "n", 3, 4), (2, "", 6, "m", 3, 4)}


def test_site_style_keeps_content_in_suspect_wrappers(spark):
    story = "A long story of many words that is the content of this page. " * 3
    pages = {
        1: f"<body><div class='layout no-sidebar'><nav>menu</nav><article><p>{story}</p></article></div></body>",
        2: f"<body><div class='sidebar-layout'><div class='menu'>menu</div><article><p>{story}</p></article></div></body>",
        3: f"<body><form id='f'><div><p>{story}</p></div></form><footer>foot</footer></body>",
        4: f"<body><div class='text'><p>{story}</p></div><article>card one</article><article>card two</article></body>",
        5: f"<body><article><p>{story}</p></article><div class='comments'>first!</div><span class='share'>Share</span></body>",
    }
    cards = {4: " card one card two"}
    rows = spark.createDataFrame([(k, f"http://h{k}.x/", v) for k, v in pages.items()], "page_id int, url string, html string")
    assert {r.page_id: r.text for r in site_style.page_texts(rows).collect()} == {k: story.strip() + cards.get(k, "") for k in pages}
    many = spark.createDataFrame([(f"http://h.x/{k}", "<body><nav>home</nav><p>own %d</p></body>" % k) for k in range(9)], "url string, html string")
    tree = {r.node: r.importance for r in site_style.style_tree(many).collect()}
    body = site_style._child(0, "body")
    assert tree[site_style._child(body, "nav")] < 0.11 < 0.8 < tree[site_style._child(body, "p")]


# --- 2 ---------------------------------------------------------------------------------------------


def test_held_out_languages(spark):
    rows = language_mixture.predict_languages(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    both = rows.where("held_out and lang_pred <> 'und'").join(truth, "doc_id").select("lang", "lang_pred").collect()
    assert np.mean([r.lang == r.lang_pred for r in both]) > 0.9
    held = {r.doc_id: r.held_out for r in rows.collect()}
    assert all(v == (zlib.crc32(str(k).encode()) % 5 == 0) for k, v in held.items())


def test_a_mixture_of_four_languages_keeps_all():
    rng, names = np.random.default_rng(6), ["a", "b", "c", "d", "e"]
    letters = ["abcde", "fghij", "klmno", "pqrst", "uvwxy"]
    say = lambda k, n: " ".join("".join(rng.choice(list(letters[k]), 6)) for _ in range(n))
    counts = np.zeros((language_mixture.CELLS, 5))
    for k in range(5):
        counts[:, k] = np.bincount(language_mixture._cells(language_mixture._points(f" {say(k, 3000)} "))[0], minlength=language_mixture.CELLS)
    table = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * language_mixture.CELLS)).astype(np.float32)
    for n in range(1, 6):
        langs, shares = language_mixture.mixtures([" ".join(say(k, 60) for k in range(n))], table)[0]
        assert {names[i] for i in langs} == set(names[:n]) and shares.sum() == pytest.approx(1, abs=0.01)


# --- 3 ---------------------------------------------------------------------------------------------


def test_mixture_matches_brute_force(spark, docs):
    names, table = language_mixture.train(docs, "text", "lang")
    cell = lambda gram: language_mixture._cells(language_mixture._points(gram))[0]
    rows = docs.where("n_chars between 200 and 3000").limit(25).collect()
    values = [r.text for r in rows] + [rows[0].text + " " + rows[1].text, "a", ""]
    for text, found in zip(values, language_mixture.mixtures(values, table), strict=True):
        words = ["".join(g) for k, g in itertools.groupby(text.lower(), str.isalpha) if k]
        if not words:
            assert found is None
            continue
        like = np.array([table[cell(f" {w} ")].sum(0) for w in words], float)
        like = np.exp(like - like.max(1, keepdims=True))

        def em(share, rounds):
            for _ in range(rounds):
                joint = like * share
                share = (joint / np.maximum(joint.sum(1, keepdims=True), 1e-30)).mean(0)
            return share, np.log(np.maximum((like * share).sum(1), 1e-30)).sum()

        share, _ = em(np.full(len(names), 1 / len(names)), 8)
        order, best = np.argsort(-share, kind="stable"), None
        for k in range(1, len(names) + 1):
            allowed = np.isin(np.arange(len(names)), order[:k])
            begin = share * allowed + 1e-6 * allowed
            fitted, value = em(begin / begin.sum(), 0 if k == 1 else 4)
            value -= (k - 1) * (0.5 * np.log(len(words)) + np.log(len(names)))
            if best is None or value > best[0] + 1e-9:
                best = (value, set(order[:k].tolist()), fitted)
        assert set(found[0].tolist()) == best[1] and found[1] == pytest.approx(best[2][found[0]], abs=1e-3)


def test_long_texts_hold_equal_words_once(docs):
    names, table = language_mixture.train(docs, "text", "lang")
    values = [r.text for r in docs.orderBy("doc_id").limit(40).collect()] + [None, "xyz " * 5000]
    for a, b in zip(language_mixture.mixtures(values, table), language_mixture.mixtures(values, table, held_words=50), strict=True):
        assert (a is None and b is None) or (a[0].tolist() == b[0].tolist() and a[1] == pytest.approx(b[1], abs=1e-4))


def test_all_languages_are_learned_and_a_column_of_something_else_is_refused(spark):
    words = [[f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}{y}{k % 7}".replace("0", "") for x in "aeio" for y in "bdlm"] for k in range(80)]
    rows = spark.createDataFrame([(" ".join(words[k][(i + j) % 16] for j in range(40)), f"l{k:02}") for k in range(80) for i in range(20)], "text string, lang string")
    names, table = language_mixture.train(rows, "text", "lang")
    assert names == [f"l{k:02}" for k in range(80)] and table.shape == (language_mixture.CELLS, 80)
    found = language_mixture.mixtures([" ".join(words[k]) for k in range(80)], table)
    assert [int(m[0][0]) for m in found] == list(range(80))
    with pytest.raises(ValueError, match="more than 79"):
        language_mixture.train(rows, "text", "lang", max_languages=79)


def test_kneser_ney_sums_to_one_and_matches_brute_force(spark):
    text = "abracadabra banana"
    model = kneser_ney.Model(kneser_ney.count_ngrams(spark.createDataFrame([(text,)], "text string"), 3), 3)
    letters = sorted(set(text))
    code = lambda g: int.from_bytes(g.encode("latin-1"), "big")
    names = {code(h + c): h + c for h in ("ab", "zz", "za", "\xff\xff") for c in letters + ["?"]}
    wanted = spark.createDataFrame([(g,) for g in names], "g bigint")
    got = {names[r.g]: float(np.exp(r.lp)) for r in model.log_probabilities(wanted).collect()}
    left = 1 - model.floor * 1  # all seen letters share what the unseen one does not take
    for context in ("ab", "zz"):
        assert sum(got[context + c] for c in letters) == pytest.approx(left, abs=0.1)
    padded = chr(kneser_ney.PAD) * 2 + text
    count = {3: Counter(padded[i : i + 3] for i in range(len(text)))}
    for n in (2, 1):
        count[n] = Counter(g[1:] for g in count[n + 1])

    def chance(g):
        if not g:
            return 1 / (len(count[1]) + 1)
        n, d = len(g), kneser_ney._discounts([sum(v == k for v in count[len(g)].values()) for k in (1, 2, 3, 4)])
        own = {k: v for k, v in count[n].items() if k[:-1] == g[:-1]}
        if not own:
            return chance(g[1:])
        cut = lambda v: d[min(v, 3) - 1]
        total = sum(own.values())
        return (own[g] - cut(own[g]) if g in own else 0) / total + sum(map(cut, own.values())) / total * chance(g[1:])

    for g, p in got.items():
        assert p == pytest.approx(chance(g), rel=1e-4)


def test_thresholds_by_language_and_ties(spark):
    rng = np.random.default_rng(11)
    words = {"aa": ["alpha", "beta", "gamma", "delta"], "bb": ["uno", "duo", "tres", "quattuor"]}
    rows = [(k, " ".join(rng.choice(words[lang], 60)), lang) for k in range(400) for lang in ("aa" if k % 2 else "bb",)]
    rows += [(1000, "alpha " * 60, "cc"), (1001, "zqx " * 60, "cc"), (1002, "zqx " * 60, "aa"), (1003, None, "aa"), (1004, "", "bb"), (1005, "alpha " * 60, None), (1006, "zqx " * 60, "aa")]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(400)] + [(1002, 1, 0), (1002, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in kneser_ney.classify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), labels, quantile=0.9).collect()}
    assert not got[1002].trusted  # a label denies it
    held = {k for k, h in ((r.doc_id, r.h) for r in spark.range(400).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(kneser_ney.FOLDS)) == 0).alias("h")).collect()) if h}
    for lang in ("aa", "bb"):
        lpp = sorted(math.ceil(math.log(got[k].perplexity) * 1000) / 1000 for k in held if got[k].lang == lang)
        want = lpp[math.ceil(0.9 * len(lpp)) - 1]
        assert math.log({got[k].threshold for k in got if got[k].lang == lang}.pop()) == pytest.approx(want, abs=1e-6)
    every = sorted(math.ceil(math.log(got[k].perplexity) * 1000) / 1000 for k in held)
    assert math.log(got[1000].threshold) == pytest.approx(every[math.ceil(0.9 * len(every)) - 1], abs=1e-6)  # a language without trusted text
    assert got[1000].kept and got[1005].kept and not any(got[k].kept for k in (1001, 1002, 1003, 1004, 1006)) and got[1002].perplexity == got[1006].perplexity
    for r in got.values():
        assert r.kept == (r.n > 0 and math.log(r.perplexity) <= math.log(r.threshold) + 1e-12)


def test_scores_match_brute_force_however_chunks_are_cut(spark, docs, texts):
    model = kneser_ney.Model(kneser_ney.count_ngrams(docs.select("text")))
    grams = {}
    for k, t in texts.items():
        raw = bytes([kneser_ney.PAD]) * 4 + (t or "").encode()
        grams[k] = [int.from_bytes(raw[i : i + 5], "big") for i in range(len(raw) - 4)]
    wanted = spark.createDataFrame([(g,) for g in set(itertools.chain(*grams.values()))], "g bigint")
    lp = {r.g: r.lp for r in model.log_probabilities(wanted).collect()}
    for rows, size in ((docs, 1 << 24), (docs.repartition(3), 20_000)):
        got = {r.doc_id: (r.n, r.nll) for r in kneser_ney.score(rows.select("doc_id", "text"), model, chunk_bytes=size).collect()}
        assert set(got) == set(texts)
        for k, own in grams.items():
            assert got[k][0] == len(own) and got[k][1] == pytest.approx(-sum(lp[g] for g in own), rel=1e-5, abs=1e-6)


def test_classifier_rejects_junk(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    junk = spark.createDataFrame([(900_000 + k, "zqxj#%wvk " * 60, "en", "s", 600) for k in range(3)], SCHEMA)
    got = kneser_ney.classify(docs.unionByName(junk), labels).collect()
    assert not any(r.kept for r in got if r.doc_id >= 900_000)
    assert np.mean([r.kept for r in got if r.trusted]) > 0.9


# --- 4 ---------------------------------------------------------------------------------------------


def brute_components(marks, radius):
    root = {m: m for m in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(marks), 2):
        if (a ^ b).bit_count() <= radius:
            root[find(a)] = find(b)
    return {m: find(m) for m in marks}


def test_fingerprints_and_components_match_brute_force(docs, texts):
    def mark(text):
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))

    marks = {k: mark(t) for k, t in texts.items()}
    groups = brute_components(set(marks.values()), 3)
    least = defaultdict(lambda: 1 << 62)
    for k, m in marks.items():
        least[groups[m]] = min(least[groups[m]], k)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.fingerprint_components(docs).collect()}
    assert got == {k: (f"{m:016x}", least[groups[m]]) for k, m in marks.items()}


def test_hot_keys_in_chunks_lose_no_link(spark):
    rng, marks = np.random.default_rng(1), set()
    for base in rng.integers(0, 1 << 62, 12):
        for _ in range(60):
            flips = rng.choice(64, rng.integers(0, 6), replace=False)
            marks.add(int(base) ^ sum(1 << int(i) for i in flips))
    marks = {m & ((1 << 64) - 1) for m in marks}
    want = brute_components(marks, 3)
    rows = spark.createDataFrame([(k, bytearray(m.to_bytes(8, "big"))) for k, m in enumerate(marks)], "doc_id bigint, bits binary")
    got = {r.node & ((1 << 64) - 1): r.component_id for r in simhash.near_components(rows, 3, chunk_rows=20).collect()}
    pairs = {(want[m], got[m]) for m in marks}
    assert len(pairs) == len(set(want.values())) == len(set(got.values()))


@pytest.mark.parametrize("similarity", [0.80, 0.82, 0.85, 0.75])
def test_near_dedup_recall_at_the_bound(spark, similarity):
    rng = np.random.default_rng(int(similarity * 100))
    rows, pairs = [], []
    for k in range(120):
        size = int(rng.integers(120, 320))
        base = [f"w{x}" for x in rng.integers(0, 1 << 40, size)]
        near, grams = list(base), lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        own = grams(base)
        at = 0
        while True:  # replace words until the next one would go below the bound
            tried = list(near)
            tried[(at * 7) % size] = f"x{k}_{at}"
            shared = len(own & grams(tried))
            if shared / (2 * len(own) - shared) < similarity:
                break
            near, at = tried, at + 1
        if similarity < 0.8:
            near = tried
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
        shared = len(own & grams(near))
        pairs.append(shared / (2 * len(own) - shared))
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {2 * k for k in range(120)} <= kept
    caught = [2 * k + 1 not in kept for k in range(120)]
    assert all(not c for c, p in zip(caught, pairs, strict=True) if p < 0.8)  # nothing below the bound goes
    if similarity >= 0.8:
        assert np.mean([c for c, p in zip(caught, pairs, strict=True) if p >= 0.8]) >= 0.99


def test_near_dedup_keeps_first_of_each_group(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(5000)]
    base = [list(rng.choice(words, 200)) for _ in range(20)]
    rows = []
    for k, b in enumerate(base):
        near = list(b)
        near[100] = "changed"
        rows += [(k, " ".join(b), "en", "s", 1), (100 + k, " ".join(near), "en", "s", 1), (200 + k, " ".join(b), "en", "s", 1)]
    got = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == set(range(20))


def test_near_dedup_holds_to_the_similarity(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK_CHARS", 1_500, raising=False)  # groups are dealt out as chunks too
    rng, rows, want = np.random.default_rng(5), [], set()
    words = [f"w{k}" for k in range(5000)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    seen = Counter()
    for k in range(480):
        base = list(rng.choice(words, 200))
        near = list(base)
        for at in rng.choice(np.arange(5, 195, 6), 2 + k % 6, replace=False):  # similarities from 0.90 to 0.70
            near[at] = f"x{at}"
        a, b = shingles(base), shingles(near)
        rows += [(k, " ".join(base), "en", "s", 1), (1000 + k, " ".join(near), "en", "s", 1)]
        alike = len(a & b) >= 0.8 * len(a | b)
        want |= {k} if alike else {k, 1000 + k}
        seen[alike] += 1
    assert min(seen.values()) >= 200
    assert {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_equal_shingle_sets_meet_whatever_their_counts(spark):
    line = "one two three four five six seven eight nine ten "
    rows = [(1, line * 2, "en", "s", 1), (2, line * 9, "en", "s", 1), (3, "", "en", "s", 1), (4, None, "en", "s", 1), (5, "a b", "en", "s", 1)]
    assert {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, SCHEMA)).collect()} == {1, 3, 5}


# --- 5 ---------------------------------------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def brute_lines(rows, least=40):
    earlier, out = [], {}
    for doc, text in sorted(rows):
        kept = []
        for line in text.split("\n"):
            if len(line) >= least and any(one_edit(line, e) for e in earlier if abs(len(e) - len(line)) <= 1):
                pass
            else:
                kept.append(line)
            if len(line) >= least:
                earlier.append(line)
        out[doc] = "\n".join(kept)
    return out


def test_line_dedup_matches_brute_force(spark, texts):
    rng = np.random.default_rng(3)
    rows = [(k, t) for k, t in texts.items() if t is not None and len(t) < 3000]
    lines = ["".join(rng.choice(list("abc d"), rng.integers(38, 90))) for _ in range(25)]
    for k in range(120):
        line = list(lines[rng.integers(25)])
        at, how = int(rng.integers(len(line))), rng.integers(4)
        line[at : at + (how != 1)] = "x" if how < 2 else "" if how == 2 else line[at]
        rows.append((10_000 + k, "head\n" + "".join(line)))
    want = brute_lines(rows)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.text for r in got} == want


def test_short_lines_go_as_exact_copies(spark, texts):
    rows = [(k, t) for k, t in texts.items() if t is not None] + [(10_001, "All rights reserved.\n\nown\n \nAll rights reserved"), (10_002, "All rights reserved.\n\nown\n \nown.")]
    left = {r.doc_id: r for r in line_dedup.line_digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    long = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    seen, gone = set(), 0
    for k, _ in sorted(rows):
        kept = []
        for line in long[k].split("\n"):  # longer lines are compared in the test above
            if line.strip() and len(line) < 40 and line in seen:
                gone += 1
            else:
                kept.append(line)
            seen.add(line)
        assert left[k].text_sha256 == hashlib.sha256("\n".join(kept).encode()).hexdigest()
    assert kept == ["", " ", "own."] and gone > 2


# --- 6 ---------------------------------------------------------------------------------------------


def test_media_round_trip(docs, texts):
    for r in transport_stream.media_digests(docs).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\0" * ((-len(raw) % 64) if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.continuity_errors == 0


def section(pid, table, number, body, counter=0):
    """Packets of one section, which may go on over several."""
    rest = struct.pack(">HBBB", number, 0xC1, 0, 0) + body
    raw = bytes([table]) + struct.pack(">H", 0xB000 | len(rest) + 4) + rest
    raw = b"\0" + raw + struct.pack(">I", transport_stream._mpeg_crc(raw))
    out = [struct.pack(">BHB", 0x47, (0x4000 if at == 0 else 0) | pid, 0x10 | counter + at // 184 & 15) + raw[at : at + 184].ljust(184, b"\xff") for at in range(0, len(raw), 184)]
    return b"".join(out)


def test_program_tables_of_odd_shapes():
    data = transport_stream.mux(bytes(range(256)) * 40)[2 * 188 :]
    first = section(0, 0, 1, struct.pack(">HHHH", 7, 0xE000 | 0x500, 8, 0xE000 | 0x600))
    beyond = section(0x500, 2, 7, struct.pack(">HH", 0xE100, 0xF3FF))  # the program's info would go past the section
    assert transport_stream.demux(first + beyond + data)[0] is False
    cut = section(0x500, 2, 7, struct.pack(">HHBH", 0xE100, 0xF000, 6, 0xE100))  # a stream entry that is cut short
    assert transport_stream.demux(first + cut + data)[0] is False
    many = struct.pack(">HH", 0xE100, 0xF000) + b"".join(struct.pack(">BHH", 6, 0xE000 | pid, 0xF000) for pid in (*range(0x700, 0x780), 0x100))
    assert len(section(0x500, 2, 7, many)) > 3 * 188
    got = transport_stream.demux(first + section(0x500, 2, 7, many) + section(0x600, 2, 8, struct.pack(">HHBHH", 0xE100, 0xF000, 27, 0xE200, 0xF000)) + data)
    assert got[:3] == (True, 0x100, 6) and got[8] == bytes(range(256)) * 40 and len(got[9]) == 130 and got[9][-1] == {"program": 8, "pid": 0x200, "stream_type": 27}
    for n in range(188):  # no crash on any damaged byte of the tables
        whole = bytearray(first + beyond + data)
        whole[n] ^= 0xFF
        transport_stream.demux(bytes(whole))


def test_media_columns_are_replaced(spark):
    got = transport_stream.add_media_columns(spark.createDataFrame([("a", "x", 1), (None, "y", 2)], "text string, ts string, media int")).collect()
    assert [bytes(r.media.payload)[:1] for r in got] == [b"a", b"\0"] and {bytes(r.ts)[:1] for r in got} == {b"G"}


def test_lost_packet_is_counted():
    stream = transport_stream.mux(bytes(range(256)) * 300)
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    del packets[len(packets) // 2]
    assert transport_stream.demux(b"".join(packets))[4] >= 1
    assert transport_stream.demux(b"nonsense")[0] is False


# --- 7 ---------------------------------------------------------------------------------------------


def test_base_counts_match_brute_force(docs, texts):
    import re

    field = line_crf.Field()
    for r in line_crf.line_quality(docs, field).collect():
        text = texts[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        again = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(again) > 50 * len(words))


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(4)
    for _ in range(30):
        field = line_crf.Field(rng.normal(size=3), rng.normal(size=(2, 2)))
        rows = [tuple(x) for x in rng.normal(size=(6, 3))]
        worth = lambda y: sum(np.dot(r, field.emission) for r, k in zip(rows, y, strict=True) if k) + sum(field.transition[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        assert worth([int(x) for x in field.decode(rows)]) == pytest.approx(max(worth(y) for y in itertools.product((0, 1), repeat=6)))


def test_fit_samples_labelled_documents_that_are_there(spark, monkeypatch):
    monkeypatch.setattr(line_crf, "fit", lambda data: data)
    docs = spark.createDataFrame([(k, f"text number {k} of some words") for k in range(90, 100)] + [(200, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(300)], "doc_id bigint, quality int, toxic int")
    assert Counter(label for _, label in line_crf.fit_from_labels(docs, labels, max_fit_docs=4)) == {0: 4, 1: 4}


def test_field_fitted_on_half_the_labels_judges_the_other_half(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    field = line_crf.fit_from_labels(docs, labels.where("doc_id % 2 = 0"))
    quality = {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    got = [(quality[r.doc_id], r.kept) for r in line_crf.line_quality(docs.where("doc_id % 2 = 1"), field).collect() if r.doc_id in quality and not r.base_failed]
    assert np.mean([k for q, k in got if q == 1]) > 0.98 and np.mean([k for q, k in got if q == 0]) < 0.1 and len(got) > 100


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(4, len(line_crf.FEATURES)))
    field = line_crf.Field(rng.normal(size=len(line_crf.FEATURES)), rng.normal(size=(2, 2)))

    def likelihood(f, label):
        score = rows @ f.emission
        paths = [sum(score[i] * y for i, y in enumerate(p)) + sum(f.transition[a, b] for a, b in zip(p, p[1:])) for p in itertools.product((0, 1), repeat=4)]
        one = sum(score) * label + 3 * f.transition[label, label]
        return one - np.logaddexp.reduce(paths)

    for label in (0, 1):
        e, t = field.gradient(rows, label)
        for k in range(len(e)):
            step = np.eye(len(e))[k] * 1e-6
            assert e[k] == pytest.approx((likelihood(line_crf.Field(field.emission + step, field.transition), label) - likelihood(field, label)) / 1e-6, abs=1e-3)
        for i, j in itertools.product((0, 1), repeat=2):
            step = np.zeros((2, 2))
            step[i, j] = 1e-6
            assert t[i, j] == pytest.approx((likelihood(line_crf.Field(field.emission, field.transition + step), label) - likelihood(field, label)) / 1e-6, abs=1e-3)


def test_repeat_words_match_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(200):
        words = [bytes([97 + x]) for x in rng.integers(0, 5, rng.integers(0, 40))]
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + d for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for d in range(3)}
        assert line_crf.repeat_words(words) == len(covered)


# --- 8 ---------------------------------------------------------------------------------------------


def test_licenses_at_four_fifths_match_brute_force_both_ways(spark):
    rng = np.random.default_rng(8)
    names, filler = sorted(license_scan.TEMPLATES), [f"w{k}" for k in range(400)]
    rows = []
    for k in range(240):
        parts = []
        for name in rng.choice(names, 2, replace=False):
            words = license_scan.words_of(license_scan.TEMPLATES[name])
            for _ in range(int(rng.integers(0, 1 + len(words) // 12))):  # a changed word breaks three shingles
                words[rng.integers(len(words))] = "changed"
            parts += [*rng.choice(filler, rng.integers(0, 120)), *words]
        rows.append((k, " ".join(parts)))
    got = {r.doc_id: r for r in license_scan.license_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    missed, met = 0, 0
    for k, text in rows:
        words, found = license_scan.words_of(text), set(got[k].licenses.split(","))
        for name in names:
            mine = grams(license_scan.words_of(license_scan.TEMPLATES[name]))
            span = 2 * len(mine)  # the best share within any run of about the template's length
            best = max(len(mine & grams(words[i : i + len(mine) + 4])) for i in range(len(words))) / len(mine)
            anywhere = max(len(mine & grams(words[max(0, i - span) : i + 3 * span])) for i in range(0, len(words), span)) / len(mine)
            if best >= 0.8:
                met += 1
                missed += name not in found
            if name in found:
                assert anywhere >= 0.8
    assert met > 300 and missed == 0
    assert any(r.covered for r in got.values()) and all(set(r.covered.split(",")) <= {"", *r.licenses.split(",")} for r in got.values())


def test_licenses_match_brute_force(spark, texts):
    template = license_scan.TEMPLATES["gpl-notice"]
    changed = template.replace("redistribute", "share")
    planted = {1: f"{'word ' * 500}{template} {'tail ' * 300}", 2: changed, 3: template.replace("free", "fee").replace("General", "x"), 4: "Licensed under CC BY-SA 4.0."}
    rows = spark.createDataFrame(list((planted | {k + 100: t for k, t in texts.items()}).items()), "doc_id bigint, text string")
    got = {r.doc_id: set(filter(None, r.licenses.split(","))) for r in license_scan.license_report(rows).collect()}
    assert "gpl-notice" in got[1] & got[2] and "gpl-notice" not in got[3] and got[4] == {"cc-by-sa-4.0"}
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))}
    for k, text in texts.items():
        mine = grams(license_scan.words_of(text or ""))
        whole = {n for n, t in license_scan.TEMPLATES.items() if grams(license_scan.words_of(t)) <= mine}
        assert whole <= got[k + 100]


# --- 9 and 10 --------------------------------------------------------------------------------------


def test_packing_is_valid_and_tight(docs, texts):
    tokenizer, got, bins, pieces = Tokenizer.from_file(BYTE), packing.pack(docs, BYTE).collect(), defaultdict(list), defaultdict(dict)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id][r.piece] = r
    assert set(pieces) == set(texts)
    for k, own in pieces.items():
        ids = [*tokenizer.encode(texts[k] or "", add_special_tokens=False).ids, 2]
        assert sorted(own) == list(range(len(own))) and sum(r.length for r in own.values()) == len(ids)
        for p, r in own.items():
            assert r.length == 1024 or p == 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 1024
    sizes = [r.length for r in got]
    assert len(bins) <= len(packing.best_fit(sizes, 1024)) and len(bins) <= -(-sum(sizes) // 1024) * 1.02 + 1


def test_local_search_beats_best_fit():
    sizes = [int(x) for x in np.random.default_rng(200).integers(200, 345, 3000)]
    bins = packing.best_fit(sizes, 1024)
    better = packing.local_search(sizes, bins, 1024)
    assert sorted(i for b in better for i in b) == list(range(3000)) and max(sum(sizes[i] for i in b) for b in better) <= 1024
    assert len(better) <= 0.955 * len(bins)
    assert packing.local_search(sizes, better, 1024) == better or len(packing.local_search(sizes, better, 1024)) <= len(better)


def test_packing_repeated_rows_and_ties(spark):
    rows = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, None), (None, None), (3, "word " * 3000)], "doc_id bigint, text string")
    got = packing.pack(rows, BYTE).collect()
    assert Counter((r.doc_id, r.piece) for r in got)[1, 0] == 2 and sum(r.doc_id is None for r in got) == 2
    places = [(r.sequence_id, r.offset) for r in got]
    assert len(places) == len(set(places)) and sorted(r.piece for r in got if r.doc_id == 3) == [0, 1, 2]


def test_local_search_empties_bins():
    bins = [[0, 1], [2, 3], [4]]
    sizes = [5, 3, 4, 4, 2]  # best fit leaves 8, 8 and 2 of 10 where 9 and 9 hold all
    assert len(packing.local_search(sizes, bins, 10)) == 2


def test_bpe_equals_library(spark, texts):
    tokenizer = Tokenizer.from_file(WORD)
    given = dict(texts) | {-1: ODD[7][1], -2: "A" * 3000, -3: "é İstanbul ﬁne x​z ''s 'S I'LL", -4: None, -5: "<|startoftext|>hi<|endoftext|>"}
    rows = spark.createDataFrame(list(given.items()), "doc_id bigint, text string")
    for r in bpe.encoding_digests(rows, WORD).collect():
        ids = tokenizer.encode(given[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids), given[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_word_cache_is_bounded_by_characters():
    tokens, rng = bpe.WordBpe(WORD, cache_chars=2_000), np.random.default_rng(8)
    library = Tokenizer.from_file(WORD)
    for _ in range(40):
        text = " ".join("".join(rng.choice(list("abcdé漢"), int(rng.integers(1, 90)))) for _ in range(20)) + " x " + "y" * 3_000
        assert tokens.encode(text) == library.encode(text, add_special_tokens=False).ids
        assert sum(map(len, tokens.young)) <= 2_000 + bpe.KEPT_CHARS and max(map(len, [*tokens.young, *tokens.old])) <= bpe.KEPT_CHARS


def test_new_words_merge_together(monkeypatch):
    # a text of new words only: they merge in rows, not one by one, and each as the library does
    rng, alone = np.random.default_rng(3), []
    words = ["".join(rng.choice(list("etaoinshrdlué漢"), n)) for n in range(1, 90) for _ in range(40)]
    real = bpe.merge_word
    monkeypatch.setattr(bpe, "merge_word", lambda *a: alone.append(1) or real(*a))
    text = " ".join(words) + " " + " ".join("x" * n for n in range(300, 2_000, 100))
    assert bpe.WordBpe(WORD).encode(text) == Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids
    assert len(alone) < 100


def test_groups_of_texts_keep_their_order(monkeypatch):
    monkeypatch.setattr(bpe, "GROUP_CHARS", 50)
    tokens, library = bpe.WordBpe(WORD, cache_chars=100), Tokenizer.from_file(WORD)
    given = ["", None, "a<|endoftext|>b c", "<|ENDOFTEXT|>", "\n<|endoftext|>", " \t ", *("one two, three! 'tis " * n for n in range(9)), None, ""]
    done = [tokens.encode_group(group) for group in bpe.groups(pa.array(given, pa.string()))]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in given]
    assert len(done) > 3 and [ids for group in done for ids in group.to_pylist()] == want
    decoded = [t for group in done for t in tokens.decode_group(group).to_pylist()]
    assert decoded == [library.decode(ids, skip_special_tokens=False) for ids in want] and tokens.decode(want[2]) == decoded[2]


def test_a_text_of_very_many_equal_lines(spark):
    line, n = "the very same line stands here again and again", 100_000
    rows = spark.createDataFrame([(1, "\n".join([line] * n + [line + "!", "another one that is long enough to be looked at"])), (2, line), (3, None)], "doc_id int, text string")
    began = time.perf_counter()
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(rows).collect()}
    assert got == {1: (line + "\nanother one that is long enough to be looked at", n), 2: ("", 1), 3: (None, 0)}
    assert time.perf_counter() - began < 60


def test_lines_of_one_common_stretch(spark, monkeypatch):
    # every line shares its first and its last stretch with all others, so those keys are hot
    monkeypatch.setattr(line_dedup, "join_salted", lambda *a, **k: salted.append(1) or real(*a, **k))
    real, salted = common.join_salted, []
    monkeypatch.setattr(common, "SALTS", 8)
    texts = [f"Numbered header of the same common stretch, number {k * 37:06} and then an end that all of these share" for k in range(600)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id for r in line_dedup.dedup_lines(rows).where("n_removed > 0").collect()}

    def near(a, b):
        return sum(x != y for x, y in zip(a, b)) <= 1

    assert got == {k for k in range(600) if any(near(texts[j], texts[k]) for j in range(k))} and salted


def test_suspects_are_seen_at_any_depth_and_articles_do_not_hide_content():
    nested = "<div>" * 600 + "<p>content</p><nav>menu</nav>" + "</div>" * 600
    assert site_style.main_text(nested) == "content"
    words = lambda n, w: " ".join([w] * n)
    page = f"<div class='content'><p>{words(40, 'aside')}</p></div><article><p>{words(60, 'story')}</p></article>"
    assert site_style.main_text(page) == f"{words(40, 'aside')} {words(60, 'story')}"
    page = f"<div class='content'><p>{words(40, 'story')}</p></div><article class='teaser'><p>{words(30, 'teaser')}</p></article>"
    assert site_style.main_text(page) == words(40, "story")
    for noise in ("<div class='fb-comments'>no</div>", "<section class='discussion'>no</section>", "<div class='cookie-wall'>no</div>"):
        assert site_style.main_text(f"<p>{words(9, 'yes')}</p>{noise}") == words(9, "yes")


def test_many_chunks_in_few_buckets(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(kneser_ney, "MOST_BUCKETS", 3)
    model = kneser_ney.Model(kneser_ney.count_ngrams(docs.where("doc_id < 40").select("text")))
    few = docs.where("doc_id < 60").select("doc_id", "text")
    got = [{r.doc_id: (r.n, round(r.nll, 2)) for r in kneser_ney.score(few, model, chunk_bytes=size).collect()} for size in (1, 1 << 30)]
    assert got[0] == got[1] and len(got[0]) == 60
