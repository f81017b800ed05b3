"""Hand-made expectations for rules, lines, chunks and evidence."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from scriptorium.operators import lines as L
from scriptorium.operators import retrieval as R
from scriptorium.operators import rules as U
from scriptorium.operators import segments as S
from scriptorium.plans import catalog


def test_levels_by_relation(spark):
    rule = U.Rule("r", ("aa", "bb"), related=("pay",), medium_at=3, low_at=2)
    rows = spark.createDataFrame([("1", "other", "aa bb"), ("2", "pay", "aa bb"), ("3", "pay", "aa"), ("4", "other", "aa"), ("5", None, None)], "id string, clause_type string, text string")
    got = {r.id: r.risk_level for r in U.identify_risks(rows, [rule]).collect()}
    assert got == {"1": "low", "2": "medium", "3": "low", "4": "none", "5": "none"}


def test_best_two_then_one(spark):
    rules = [U.Rule("low", ("x",), medium_at=9), U.Rule("high", ("x",), ("x",)), U.Rule("m1", ("x", "y"), medium_at=1), U.Rule("m2", ("x",), medium_at=1)]
    rows = spark.createDataFrame([("1", "t", "x y")], "id string, clause_type string, text string")
    assert [r.risk_type for r in U.identify_risks(rows, rules).orderBy("risk_no").collect()] == ["high", "m1"]
    assert [r.risk_type for r in U.identify_risks(rows, rules[:1]).collect()] == ["low"]


def test_evidence_order_and_cap(spark):
    rows = [("i", "b", "t1", "c1", 9), ("i", "a", "t1", "c1", 9), ("i", "a", "t2", "c2", 7), ("i", "a", "t3", "c3", 6), ("i", "a", "t4", "c4", 2)]
    got = R.choose_evidence(spark.createDataFrame(rows, "item string, kb_name string, title string, content string, score int"), "item", 2).orderBy("rank").collect()
    assert [(r.kb_name, r.title) for r in got] == [("a", "t1"), ("a", "t2")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id string, clause_type string, text string")
    assert U.identify_risks(none, [U.Rule("r", ("a",))]).count() == 0
    assert S.chunk_markdown(none, "doc_id", "text").count() == 0
    assert L.merge_short_lines(L.explode_lines(none, "doc_id", "text"), "doc_id").count() == 0


def test_short_lines_merge_in_their_row(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["", " ", "a", "bc", "\U0001f600\U0001f600", " d ", "word", "longer one", "\r", "\u2028x"]) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    rows = spark.createDataFrame([*enumerate([*texts, "", None, "a\n" * 20_000])], "id int, t string")
    exploded = L.merge_short_lines(L.explode_lines(rows, "id", "t"), "id")
    want = {r.id: r.text for r in L.join_lines(exploded, "id").collect()}
    made = rows.select("id", L.short_lines_merged(F.col("t")).alias("ls"))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert {r.id: "\n".join(r.ls) for r in made.collect() if r.ls} == want
    plan = catalog.queries()["tx3_merge_short"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_chunks_keep_all_text(spark):
    text = "# h\n\n" + "\n\n".join(f"{'word ' * 60}{k}" for k in range(30))
    rows = S.chunk_markdown(spark.createDataFrame([("1", text)], "doc_id string, text string"), "doc_id", "text").collect()
    joined = " ".join(r.chunk for r in rows)
    assert len(rows) > 5 and all(f" {k}" in joined for k in range(30))


def brute_blocks(text):
    out, buf, fence = [], [], False
    table = lambda line: line.count("|") >= 2
    for line in text.split("\n"):
        mark = re.match(r"\s*```", line)
        if not fence and buf and (mark or not line.strip(" ") or table(line) != table(buf[-1])):
            out, buf = [*out, "\n".join(buf)], []
        if fence or mark or line.strip(" "):
            buf.append(line)
        if mark:
            fence = not fence
            if not fence:
                out, buf = [*out, "\n".join(buf)], []
    return out + ["\n".join(buf)] * bool(buf)


ODD_TEXTS = [
    None, "", "# Head", "Plain head", "no full stop\nsecond", "ends.\nsecond", "# Head\ntext of more than twenty characters", "a\n\nb\n \nc",
    "before\n| a | b |\n|---|---|\n| 1 | 2 |\nafter", "one | pipe\nmore", "text\n```py\nx = 1\n\n| y | z |\n```\ntail", "```\nnever closed\n\n| a | b |", "```\na\n```\n```\nb\n```",
]


def whole_table(spark, tmp_path, name):
    """The query on the documents of sf0.001 and odd ones, and the texts by id."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = spark.createDataFrame([(900_000 + k, t, "en", "s1", len(t or "")) for k, t in enumerate(ODD_TEXTS)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.unionByName(more.select([more[c].cast(docs.schema[c].dataType) for c in docs.columns])).write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    return {r.doc_id: r for r in catalog.queries()[name](spark, str(tmp_path)).collect()}, {r.doc_id: r for r in rows.collect()}


def test_blocks_of_all_documents(spark, tmp_path):
    got, docs = whole_table(spark, tmp_path, "ch2_blocks_all")
    assert set(got) == set(docs) and any("```" in (d.text or "") for d in docs.values())
    for k, d in docs.items():
        want = brute_blocks(d.text or "")
        assert (got[k].n_blocks, got[k].md5) == (len(want), hashlib.md5("\x1f".join(want).encode()).hexdigest()), d.text


def test_relevance_of_all_documents(spark, tmp_path):
    got, docs = whole_table(spark, tmp_path, "pr15_relevance_all")
    assert set(got) == set(docs)
    bare = 0
    for k, d in docs.items():
        lines = [x.strip(" ") for x in (d.text or "").split("\n") if x.strip(" ")]
        heading = not lines or (len(lines) == 1 and lines[0].startswith("#")) or (len(lines) <= 2 and all(len(x) <= 20 and "." not in x for x in lines))
        t = re.sub(r"\s+", "", (d.source or "") + (d.text or ""))
        i, p, e = (sum(w in t for w in words) for words in (("hation", "erthe"), ("ingth", "ment"), ("keit",)))
        assert got[k].score == 5 * i + 8 * p - 7 * e - 5 * (i + p == 0) + 2 * ("1" in (d.source or "")) - 20 * heading, d.text
        bare += heading
    assert bare >= 5


def test_threshold_search_has_no_cap(spark):
    rows = spark.createDataFrame([(k, [1.0, k / 400]) for k in range(200)] + [(200 + k, [0.0, -1.0]) for k in range(20)], "id long, vector array<double>")
    got = R.cosine_at_least(rows.where("id % 50 = 0"), rows, 0.2, block_rows=32).collect()
    want = {(q, k) for q in (0, 50, 100, 150) for k in range(200) if k != q} | {(200, k) for k in range(201, 220)}
    assert {(r.query_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert R.cosine_top_k(rows.where("id = 0"), rows, 60, threshold=0.2).count() == 60


def test_all_words_of_a_pack_are_found_where_they_overlap(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 5))) for _ in range(40)]
    texts = ["".join(rng.choice("abéc") for _ in range(rng.randrange(0, 12))) for _ in range(300)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.f for r in rows.select("id", U.find_words(F.col("t"), words).alias("f")).collect()}
    assert got == {i: [w for w in dict.fromkeys(words) if t and w in t] for i, t in enumerate(texts)}
    assert rows.select(U.find_words(F.col("t"), []).alias("f")).first().f == []


def test_rules_match_an_evaluation_word_by_word(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 4)))
    some = lambda n: tuple(word() for _ in range(rng.randrange(n)))
    rules = [
        U.Rule(f"r{i}", some(5) + (word(),), some(3), some(2), rng.randrange(1, 4), rng.randrange(1, 3), some(3), tuple(some(3) for _ in range(rng.randrange(3))), some(3), rng.randrange(3), rng.random() < 0.3, {f"g{j}": some(3) + (word(),) for j in range(rng.randrange(3))})
        for i in range(6)
    ]
    texts = [(i, "".join(rng.choice("abcd") for _ in range(rng.randrange(14))), word()) for i in range(300)] + [(999, None, None)]

    def expected(t, kind):
        made = []
        for i, r in enumerate(rules):
            n = lambda words: sum(w in t for w in {*words})
            kw, st, rel, grp = n(r.keywords), n(r.strong), any(x in kind for x in r.related), all(n(g) for g in r.groups.values())
            conf = 6 * st + 2 * kw + rel + grp
            combos = not r.combinations or any(c and n(c) == len({*c}) for c in r.combinations)
            ok = (st > 0 or not r.require_strong) and grp and (not r.required_any or n(r.required_any)) and combos and not (n(r.blocked) and kw <= r.blocked_max and not st) and kw + st
            level = 0 if not ok else 3 if st else 2 if kw >= r.medium_at or conf >= 6 else 1 if kw >= r.low_at or (rel and kw) else 0
            made.append((-level, -conf, -st, -kw, i))
        best = sorted(m for m in made if m[0] < 0)
        return [(rules[i].risk_type, -lv, -c, -s, -k) for lv, c, s, k, i in ([m for m in best if m[0] <= -2][:2] or best[:1])] or [("no risk", 0, 0, 0, 0)]

    rows = U.identify_risks(spark.createDataFrame(texts, "id int, text string, clause_type string"), rules).orderBy("id", "risk_no").collect()
    got, known = {}, {i: t or "" for i, t, _ in texts}
    for r in rows:
        got.setdefault(r.id, []).append((r.risk_type, U.LEVELS.index(r.risk_level), r.confidence, r.strong_count, r.keyword_count))
        assert all(w in known[r.id] for w in r.triggers) and bool(r.triggers) == (r.risk_type != "no risk")
    assert got == {i: expected(t or "", k or "") for i, t, k in texts}


def test_a_thousand_words_cost_at_most_twice_fifty():
    rng = random.Random(3)
    words = list({"".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(1_200)})[:1_000]
    texts = ["".join(rng.choice("abcdefghijklmnop") for _ in range(250)) for _ in range(4_000)]

    def seconds(pack):
        best = 9.0
        for _ in range(3):
            began = time.perf_counter()
            pack.found(texts)
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(U.WordPack(words)) < 2 * seconds(U.WordPack(words[:50])) + 0.05


def test_texts_of_a_hundred_thousand_titles(spark):
    text = "\n".join(f"Part A{i} one\nClause {i} says so" for i in range(100_000))
    rows = spark.createDataFrame([(1, "x"), (2, text), (3, None), (4, "Part A0")], "id int, t string")
    began = time.perf_counter()
    found = S.section_titles(rows, "id", "t", "Part [A-Z][0-9]+")
    last = found.where("id = 2").orderBy(F.desc("place")).first()
    assert (last.section_title, text[last.place :][: len(last.section_title)]) == ("Part A99999", "Part A99999")
    assert found.groupBy("id").count().orderBy("id").collect() == [(2, 100_000), (4, 1)]
    layout = L.Layout(section="^Part [A-Z]", clause="", attachment=r"^Annex \d", subpoint="")
    made = S.split_contract(rows, "id", "t", layout, "Clause 0", r"Clause \d+", "start")
    assert made.where("id = 2 and section_title is not null").count() == 100_000
    assert S.split_clauses(rows, "id", "t", r"Clause \d+").where("pos = 100000").first().section == "Clause 99999"
    assert time.perf_counter() - began < 60


def test_running_sums_of_arrays(spark):
    rows = spark.createDataFrame([(i, [rng % 7 for rng in range(i % 5)] if i % 3 else None) for i in range(50)], "id int, n array<int>")
    got = {r.id: r.s for r in rows.select("id", S.running_sums(F.col("n")).alias("s")).collect()}
    assert got == {r.id: [sum(r.n[:k]) for k in range(len(r.n))] if r.n else [] for r in rows.collect()}
