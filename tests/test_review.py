"""Hand-made expectations for review, rendering, graph, splitting and bookkeeping operators."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from scriptorium import staging
from scriptorium.operators import graph as G
from scriptorium.operators import lines as L
from scriptorium.operators import render as N
from scriptorium.operators import retrieval as R
from scriptorium.operators import review as V
from scriptorium.operators import segments as S
from scriptorium.operators import serving as B
from scriptorium.sources import files


def scored(spark, risk_type, clause, content, kb="labor_law", title="t", rule=None):
    rule = V.retrieval_rule(F.col("risk_type"), {risk_type: rule or {"include_any": ["工资"]}}, {})
    rows = spark.createDataFrame([(risk_type, clause, kb, title, content)], "risk_type string, clause string, kb_name string, title string, content string")
    r = V.score_hit(rows.withColumn("rule", rule)).first()
    return r.score, r.notes


def test_labour_adjustments(spark):
    long = "这是一个足够长的条文内容。" * 3
    assert scored(spark, "其他", "", long + "工资") == (5, ["exact_match"])
    assert scored(spark, "其他", "", long) == (-5, ["weak_match"])
    assert scored(spark, "其他", "", long + "工 资", kb="civil_code", title="第十条") == (5 + 2 - 1, ["specific_article_title", "civil_code_penalty", "exact_match"])
    assert scored(spark, "试用期风险", "试用期工资", long + "工资") == (5 + 8, ["exact_match", "wage_specific_match"])
    assert scored(spark, "试用期风险", "报酬", long) == (-5 - 24, ["weak_match", "missing_wage_specificity"])
    assert scored(spark, "试用期风险", "无", long) == (-5, ["weak_match"])
    assert scored(spark, "试用期工资风险", "", long + "加班工资") == (5 - 12, ["exact_match", "overtime_mismatch"])
    assert scored(spark, "薪酬支付风险", "加班", long + "加班工资") == (5 + 3, ["exact_match", "overtime_related"])
    assert scored(spark, "薪酬支付风险", "待遇", long + "加班工资") == (5 - 24 - 20, ["exact_match", "overtime_not_in_clause", "adjustment_mismatch"])
    assert scored(spark, "薪酬支付风险", "调薪", long + "协商一致") == (-5 + 5, ["weak_match", "adjustment_related"])
    training = {"prefer_any": ["职业培训"]}
    assert scored(spark, "培训服务期风险", "职业培训", long + "职业培训", rule=training) == (8 + 4 - 8, ["topic_match", "generic_training_only"])
    assert scored(spark, "其他", "", "# 工资", rule={"include_any": ["工资"], "exclude_any": ["工"]}) == (5 - 20 - 7, ["heading_only", "exclude_hit", "exact_match"])


def test_rule_lists_replace_defaults(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    got = {r.k: r.r for r in rows.select("k", V.retrieval_rule(F.col("k"), {"a": {"include_any": ["x"], "exclude_any": []}}, {"include_any": ["d"], "exclude_any": ["e"]}).alias("r")).collect()}
    assert (got["a"].include_any, got["a"].exclude_any) == (["x"], []) and (got["b"].include_any, got["b"].exclude_any, got[None].include_any) == (["d"], ["e"], ["d"])


def test_evidence_of_each_item(spark):
    items = spark.createDataFrame([("r1", "pay", "wages"), ("r2", "pay", "none"), ("r3", "other", "x")], "item_id string, risk_type string, clause string")
    text = "wages are due on the first day of the month."
    hits = spark.createDataFrame(
        [("pay", 0, "a", 1, "", text), ("pay", 0, "b", 2, "T", text + " more"), ("pay", 0, "a", 3, "", "# wages"), ("pay", 1, "a", 4, "late", text), ("other", 1, "a", 5, "late", text)],
        "risk_type string, query_index int, kb_name string, item_id int, title string, content string",
    )
    rule = lambda kind: V.retrieval_rule(kind, {}, {"include_any": ["wages"]})
    got = {r.item_id: r for r in V.retrieve_evidence(items, hits, rule, [], "item_id").collect()}
    assert [(b.rank, b.kb_name, b.title) for b in got["r1"].bases] == [(1, "a", text), (2, "b", "T")] and got["r1"].retrieval_notes == ["exact_match"]
    assert [b.title for b in got["r3"].bases] == ["late"] and got["r3"].retrieval_notes == ["fallback_query"]
    none = {r.item_id: r for r in V.retrieve_evidence(items, hits.limit(0), rule, [], "item_id").collect()}
    assert len(none) == 3 and all(r.bases == [] and r.retrieval_notes == ["insufficient_specificity"] for r in none.values())


def test_weak_splitting_in_three_stages(spark):
    split = lambda text, **sizes: [(r.clause_id, r.text) for r in S.split_weakly(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text", "Part [A-Z]", ["Further", "Also"], r"\d\)", **sizes).orderBy("pos").collect()]
    assert split("only one piece") == [("C1", "only one piece")]
    assert split("head Part A one") == [("C1", "head Part A one")]  # one section title is not enough
    assert split("head\nPart A one\nPart B two") == [("C1", "Part A one"), ("C2", "Part B two")]
    long = "Part A " + "x" * 40 + " Further y Also z"
    assert [t for _, t in split(f"{long}\nPart B", long=40)] == ["Part A " + "x" * 40, "Further y", "Also z", "Part B"]
    points = "Part A\n1) first point of it\n2) second point of it\n3) no\nPart B"
    assert [t for _, t in split(points, middle=20)] == ["1) first point of it", "2) second point of it", "Part B"]
    assert split("") == [] and split(" \n ") == []


def test_soft_words_inside_a_section_mark_do_not_cut_it(spark):
    rows = spark.createDataFrame([(1, "x" * 40 + " Reform the law. Still form y")], "id int, text string")
    got = [r.text for r in S.split_weakly(rows, "id", "text", "[A-Z][a-z]+ the[^\n]*", ["form "], r"\d\)", long=40).orderBy("pos").collect()]
    assert got == ["x" * 40, "Reform the law. Still", "form y"]


def test_any_clauses_and_attachments(spark):
    rows = spark.createDataFrame([(1, "pre Art. 1 a\nPart A\nArt. 2 b"), (2, "Part A x\nPart B y"), (3, "plain"), (4, None), (5, "")], "id int, text string")
    got = [(r.id, r.clause_id, r.text) for r in S.split_any_clauses(rows, "id", "text", r"Art\. \d", "Part [A-Z]", ["Also"], r"\d\)").orderBy("id", "pos").collect()]
    assert got == [(1, "C1", "Art. 1 a"), (1, "C2", "Art. 2 b"), (2, "C1", "Part A x"), (2, "C2", "Part B y"), (3, "C1", "plain")]
    rows = spark.createDataFrame([(1, "Annex 1\nMap\nrest Annex 2"), (2, "no mark"), (3, " "), (4, None)], "id int, text string")
    got = [(r.id, r.attachment_id, r.title, r.text) for r in S.split_attachments(rows, "id", "text", r"Annex \d", "annex").orderBy("id", "pos").collect()]
    assert got == [(1, "A1", "Annex 1 Map", "Annex 1\nMap\nrest"), (1, "A2", "Annex 2", "Annex 2"), (2, "A1", "annex", "no mark")]


def test_section_titles_at_the_ends_go(spark):
    rows = spark.createDataFrame([("Part A\nArt. 1 x\n y \n\nPart B",), ("Part A",), ("Part A\nother",), ("Art. 1\nPart A x\nz",), ("",)], "t string")
    got = [r[0] for r in rows.select(S.strip_section_titles(F.col("t"), "^Part", r"^Art\. \d")).collect()]
    assert got == ["Art. 1 x\ny", "", "Part A\nother", "Art. 1\nPart A x\nz", ""]


def test_contract_of_clauses_and_attachments(spark):
    text = "cover\nPart A rules\nArt. 1 first clause text\nmore\nPart B pay\nArt. 2 second clause\nAnnex 1\nMap of it\nline"
    layout = L.Layout(section="^Part [A-Z]", clause="", attachment=r"^Annex \d", subpoint="")
    rows = S.split_contract(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text", layout, "Part", r"Art\. \d", "start").orderBy("part", "pos").collect()
    assert [(r.part, r.item_id, r.section_title, r.title, r.text) for r in rows] == [
        ("attachment", "A1", None, "Annex 1 Map of it", "Annex 1\nMap of it\nline"),
        ("main_body", "C1", "Part A rules", "firstclausetext", "Art. 1 first clause text\nmore"),
        ("main_body", "C2", "Part B pay", "secondclause", "Art. 2 second clause"),
    ]


def test_protected_blocks_and_packing(spark):
    table, fence = "| a | b |\n|---|---|\n" + "| 1 | 2 |\n" * 30, "```\n" + "x = 1\n" * 40 + "```"
    text = f"# head\n\nfirst paragraph\n\n{table}\n\nsecond paragraph\n\n{fence}\n\nthird paragraph"
    got = [r.chunk for r in S.chunk_markdown(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text", size=120, overlap=10).orderBy("section_no", "chunk_no").collect()]
    assert got == ["# head\n\nfirst paragraph", table.strip(), "second paragraph", fence, "third paragraph"]
    flags = spark.createDataFrame([(table.strip(),), (fence,), ("| a | b |\n| c | d |",), ("text",)], "t string").select(S.is_protected(F.col("t"))).collect()
    assert [r[0] for r in flags] == [True, True, False, False]
    words = "\n\n".join(f"{k} " + "word " * 10 for k in range(6)).strip()
    chunks = [r.chunk for r in S.chunk_markdown(spark.createDataFrame([(1, words)], "id int, text string"), "id", "text", size=130, overlap=10).orderBy("chunk_no").collect()]
    assert len(chunks) > 2 and all(b.startswith(a[-10:]) for a, b in zip(chunks, chunks[1:], strict=False))


def test_headlines(spark):
    cases = {"pay": [V.Headline("late", (("late",), ("wage",))), V.Headline("by trigger", (("zz",),), triggers=("bonus",)), V.Headline("bare", lacks=("amount",))]}
    rows = [("own", "pay", "late wage", [], "s"), ("", "pay", "late wage", [], "s"), (None, "pay", "x amount", ["a bonus"], "s"), ("", "pay", "x", None, ""), ("", "pay", "amount", [], "S1"), ("", "else", None, None, "s" * 25), ("", "else", "", [], ""), ("", "none", "", [], None)]
    made = spark.createDataFrame(rows, "e string, k string, c string, t array<string>, s string")
    got = [r[0] for r in made.select(V.headline(*(F.col(x) for x in "ekcts"), cases, "none", "to check", " matters")).collect()]
    assert got == ["own", "late", "by trigger", "bare", "S1 matters", "s" * 18 + "… matters", "else matters", "to check"]


def test_blocks_and_answers(spark):
    blocks = [("section_title", " One "), ("clause", "a Art. 1 b"), ("attachment", "map"), ("attachment", "Annex 2"), ("text", "end")]
    rows = spark.createDataFrame([(blocks,)], "b array<struct<block_type:string,text:string>>")
    assert rows.select(N.render_blocks(F.col("b"), r"Art\. \d", r"Annex \d", "Annex")).first()[0] == "One\n\na \nArt. 1 b\n\nAnnex map\n\nAnnex 2\n\nend"
    answers = [json.dumps({"choices": [{"message": {"content": c}}]}) for c in (" plain ", [{"text": "a"}, {"type": "x"}, {"text": ""}, {"text": "b"}])] + ["{}", "no json", None]
    got = spark.createDataFrame([(a,) for a in answers], "a string").select(N.response_text(F.col("a"))).collect()
    assert [r[0] for r in got] == ["plain", "a\nb", "", "", ""]
    results = [{"context": "one\n\n two \n\n", "sources": ["s"]}, {"contexts": ["a", " ", "b"], "context": "c"}, {"context": "", "references": ["r"]}, {"result": "x\n\ny"}, {"other": 1}, ["l", ""]]
    rows = spark.createDataFrame([(json.dumps(r),) for r in results], "r string").select(N.context_text(F.col("r")), N.context_list(F.col("r"))).collect()
    assert [tuple(r) for r in rows] == [("one\n\n two \n\n", ["one", "two"]), ("c", ["a", "b"]), ("r", ["r"]), ("x\n\ny", ["x", "y"]), (None, None), ("l\n\n", ["l"])]


def test_graph_edits(spark):
    nodes = spark.createDataFrame([("a", "k1", "d1"), ("b", "k2", "d2"), ("c", None, "d1")], "name string, kind string, description string")
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "a", 4)], "src string, dst string, weight long")
    aliases = spark.createDataFrame([("b", "a"), ("c", "a")], "name string, target string")
    pick = lambda strategy: G.merge_entities(nodes, edges, aliases, {"kind": strategy, "description": strategy})[0].first()
    assert [(pick(s).kind, pick(s).description) for s in G.STRATEGIES] == [("k1; k2", "d1; d2; d1"), ("k1", "d1"), ("k1; k2", "d1; d2")]
    assert G.merge_entities(nodes, edges, aliases)[1].count() == 0
    with pytest.raises(ValueError, match="strategies"):
        pick("newest")
    grown, more = G.insert_graph(nodes, edges, nodes.limit(0), spark.createDataFrame([("a", "b", 5), ("a", "z", 1)], edges.schema))
    assert {r.name for r in grown.collect()} == {"a", "b", "c", "z"} and {(r.src, r.dst): r.weight for r in more.collect()}["a", "b"] == 6
    left, kept = G.delete_entities(nodes, edges, nodes.where("name = 'a'"))
    assert [r.name for r in left.orderBy("name").collect()] == ["b", "c"] and [tuple(r) for r in kept.collect()] == [("b", "c", 2)]
    seeds = spark.createDataFrame([("a",)], "name string")
    size = lambda mode: G.search_graph(edges, seeds, F.array(F.lit("c")), 1, mode, spark.createDataFrame([("t", 1.0)], "item string, weight double")).count()
    assert {m: size(m) for m in ("local", "global", "hybrid", "naive", "mix", "bypass")} == {"local": 2, "global": 1, "hybrid": 3, "naive": 1, "mix": 4, "bypass": 0}
    with pytest.raises(ValueError, match="chunks"):
        G.search_graph(edges, seeds, F.array(F.lit("c")), 1, "naive")


def test_token_chunks_overlap(spark):
    rows = spark.createDataFrame([(1, [str(k) for k in range(25)]), (2, []), (3, ["x"]), (4, [str(k) for k in range(10)]), (5, None)], "id int, t array<string>")
    got = [(r.id, r.chunk_no, r.tokens[0], r.tokens[-1]) for r in G.token_chunks(rows, "id", F.col("t"), 10, 2).orderBy("id", "chunk_no").collect()]
    assert got == [(1, 0, "0", "9"), (1, 1, "8", "17"), (1, 2, "16", "24"), (3, 0, "x", "x"), (4, 0, "0", "9")]


def test_bookkeeping(spark):
    tries = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, True), ("b", 1, False), ("b", 2, False), ("b", 3, False), ("b", 4, True)], "k string, n int, ok boolean")
    done, failed = B.with_retries(tries, "k", "n", "ok")
    assert [(r.k, r.n) for r in done.collect()] == [("a", 2)] and [(r.k, r.tries) for r in failed.collect()] == [("b", 3)]
    cache = spark.createDataFrame([("x", "1", "old"), ("y", "1", "y")], "mode string, key string, answer string")
    put = B.cache_put(cache, spark.createDataFrame([("x", "1", "new"), ("x", "2", "two")], cache.schema))
    assert {(r.mode, r.key, r.answer) for r in put.collect()} == {("x", "1", "new"), ("x", "2", "two"), ("y", "1", "y")}
    assert B.cache_clear(put, ["x"]).count() == 1 and B.cache_clear(put).count() == 0
    assert [r[0] for r in spark.createDataFrame([([1, 2, 3],), ([1],), ([],)], "a array<int>").select(B.last_n(F.col("a"), 2)).collect()] == [[2, 3], [1], []]
    with pytest.raises(ValueError, match="radius"):
        R.within_radius(spark.createDataFrame([("a", 0.0, 0.0)], "name string, lat double, lon double"), 0.0, 0.0, 0)


def test_more_sources_and_sinks(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps(["one", {"text": "two"}, "", {"content": 'th"ree'}]))
    (tmp_path / "l.jsonl").write_text('"a b"\n{"content": "c"}\n\n')
    assert [r.chunk for r in files.read_chunks(spark, str(tmp_path / "s.json")).collect()] == ["one", "two", 'th"ree']
    assert [r.chunk for r in files.read_chunks(spark, str(tmp_path / "l.jsonl")).collect()] == ["a b", "c"]
    (tmp_path / "m.md").write_text("# T\nbody")
    assert files.read_markdown(spark, str(tmp_path / "m.md")).first().text == "# T\nbody"
    (tmp_path / "r.json").write_text(json.dumps({"summary": {"n": 2}, "risk_items": [{"id": "C1"}]}, indent=1))
    assert files.read_report(spark, str(tmp_path / "r.json")).first().summary.n == 2
    pages = spark.createDataFrame([("d", "cover\nPage 3\nthree\n第7页\nseven\nPage 9\n")], "id string, text string")
    assert [(r.page_no, r.text) for r in files.numbered_pages(pages, "id", "text").collect()] == [(1, "cover"), (3, "three"), (7, "seven")]
    rows = spark.createDataFrame([(1, "a|b\nc"), (2, None)], "id int, v string")
    files.write_rows(rows, str(tmp_path / "md"), "md")
    lines = {r[0] for r in spark.read.text(str(tmp_path / "md")).collect()}
    assert lines == {"| id | v |", "|---|---|", "| 1 | a b c |", "| 2 |  |"}
    files.write_rows(rows, str(tmp_path / "txt"), "txt")
    assert "id: 1" in {r[0] for r in spark.read.text(str(tmp_path / "txt")).collect()}
    files.write_texts(rows.select(F.col("v").alias("markdown")).where("v is not null"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out" / "*")).count() == 2
    with pytest.raises(ValueError, match="nothing"):
        files.write_report(rows.limit(0), str(tmp_path / "none"))
    state = files.with_defaults(spark.createDataFrame([(None,)], "a int"), {"a": F.lit(5), "b": F.lit("x")}).first()
    assert (state.a, state.b) == (5, "x")


def test_tables_of_a_database(spark):
    url = "jdbc:derby:memory:scriptorium;create=true"
    spark.range(10).select(F.col("id"), (F.col("id") * 2).alias("v")).write.mode("overwrite").format("jdbc").option("url", url).option("dbtable", "T").save()
    whole, parts = files.read_jdbc(spark, url, "T"), files.read_jdbc(spark, url, "T", "id", (0, 10), 4)
    assert whole.count() == parts.count() == 10 and parts.rdd.getNumPartitions() == 4


def test_no_local_folder_on_a_cluster(spark):
    def session(**conf):
        return SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf), conf=SimpleNamespace(get=lambda k, d=None: d, set=lambda k, v: None))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(session(**{"spark.master": "spark://host:7077"}))
    assert staging.shared_dir(session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///x"})) == "hdfs:///x"
    assert staging.shared_dir(session(**{"spark.master": "local[4]"})) == staging.LOCAL_FALLBACK


def test_bucketed_tables_join_without_a_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 50).alias("k"), "id")
    stored = staging.stage_bucketed(rows, "t", "k", 4)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, rows.collect()))
    joined = stored.join(rows.groupBy("k").count().hint("merge"), "k")
    assert joined.count() == 1000
    assert not [t for t in spark.catalog.listTables() if t.name == "t"]


def test_index_holds_every_row_and_finds_nine_of_ten(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries, index = rows.where("id % 50 = 0"), R.build_index(rows, 32, block_rows=20)
    assert index.rows.count() == rows.count() == index.rows.select("iid").distinct().count()
    exact = {(r.query_id, r.item_id) for r in R.vector_top_k(queries, rows, 10, "cosine").collect()}
    found = {(r.query_id, r.item_id) for r in R.index_top_k(index, queries, 10, 20, block_rows=3).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    whole = {(r.query_id, r.item_id) for r in R.index_top_k(index, queries, 10, 32).collect()}
    assert whole == exact
    empty = R.build_index(rows.limit(0), 4)
    assert R.index_top_k(empty, queries, 10, 2).count() == 0
