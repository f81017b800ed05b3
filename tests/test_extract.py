"""Articles by their ways of being found, JSON in prose, blocks, lines and addresses on odd rows."""

from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import extract as X
from scriptorium.operators import retrieval as R
from scriptorium.operators import rules as U
from scriptorium.operators import serving as B

CONTENT = '<div class="col-xs-6 content-center">'
PAGES = [
    (1, f'<h1 class="content-title"> A &amp; B </h1><p>outside</p>{CONTENT}<p>one<p>two <b>bold</b></p><p> </p><script>var x = "<p>no</p>";</script></div><p>after</p>'),
    (2, f"{CONTENT}first\n\n  second <br>third</div>"),
    (3, '<h1>other</h1><div class="text">short</div><span class="my-content">this is longer than twenty characters</span><div class="side">not this one, whatever its length</div>'),
    (4, "<p>nothing here</p>"),
    (5, None),
    (6, f'<h1 class="content-title">only a title</h1>{CONTENT} </div>'),
    (7, f"{CONTENT}<p>outer</p>{CONTENT}<p>inner</p></div></div></div></p>"),
    (8, "<div>" * 3000 + f"{CONTENT}<p>deep"),
    (9, f'{CONTENT}<p class="text">p with a class, counted once here</p></div>'),
]


def test_articles(spark):
    pages = spark.createDataFrame(PAGES, "id int, html string").withColumn("title", F.lit("clash"))
    got = {r.id: (r.title, r.paragraphs, r.way) for r in X.articles(pages, "id", "html").collect()}
    assert got == {
        1: ("A & B", ["one", "two bold"], "paragraphs"), 2: ("untitled_2", ["first", "second third"], "lines"), 3: ("untitled_3", ["this is longer than twenty characters"], "elements"),
        6: ("only a title", [], "none"), 7: ("untitled_7", ["outer", "inner"], "paragraphs"), 8: ("untitled_8", ["deep"], "paragraphs"), 9: ("untitled_9", ["p with a class, counted once here"], "paragraphs"),
    }
    assert X.articles(pages.limit(0), "id", "html").count() == 0


def test_cut_references_stay(spark):
    page = '<h1>a &amp; b&&lt;&#65;&#x42; &nosuch; R&amp;D &amp;lt; &copy and&amp</h1><div class="a&b"><p>x &amp y</div>'
    got = X.articles(spark.createDataFrame([(1, page)], "id int, html string"), "id", "html", ("h1", None), ("div", "a&b")).first()
    assert (got.title, got.paragraphs) == ("a & b&<AB &nosuch; R&D &lt; &copy and&amp", ["x &amp y"])


def test_lines_that_begin_with_their_number_keep_it(spark):
    rows = spark.createDataFrame([("0 zero <a>\n \n 2 two 2\u00a0",), (" ",), (None,)], "t string")
    assert [r[0] for r in rows.select(T.html_paragraphs(F.col("t"))).collect()] == ["<p>0 zero &lt;a&gt;</p><p>2 two 2</p>", "", None]
    bare = spark.createDataFrame([(" # title ",), ("0",), ("0\n \n1\n2",), (" \n ",)], "t string")
    assert [r[0] for r in bare.select(R.heading_only(F.col("t"))).collect()] == [True, True, False, True]


def test_json_blocks_and_lines(spark):
    texts = ['{"a": 1}', '```json\n{"a": 2}\n```', 'so: {"a": {"b": 3}} done', "no braces", "{broken", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    read = X.json_of(F.col("t"))
    got = {r.id: (r.a, r.broken) for r in rows.select("id", F.try_variant_get(read["value"], "$.a", "string").alias("a"), read["broken"].alias("broken")).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: "1", 1: "2", 2: '{"b":3}', 3: None, 4: None, 5: None, 6: None} and [got[k][1] for k in range(3)] == [False, False, True]
    blocks = spark.createDataFrame([([("a", "x"), ("z", "y"), (None, "w"), ("a", " "), ("a", None)],), ([("a", " ")],), (None,)], "b array<struct<kind:string,text:string>>")
    assert [r.v and [tuple(b) for b in r.v] for r in blocks.select(X.valid_blocks(F.col("b"), ["a"]).alias("v")).collect()] == [[("a", "x"), ("other", "y"), ("other", "w")], None, None]
    lines = spark.createDataFrame([(1, '```\n{"n": 1}\n{bad\ntext {"n": 5}\n{"n": 2, "m": "x"}\n```'), (2, None)], "id int, t string")
    assert sorted((r.id, r.n, r.m) for r in X.json_lines(lines, ["id"], "t", "n int, m string").collect()) == [(1, 1, None), (1, 2, "x")]


def test_addresses_lookup_and_preferred(spark):
    links = spark.createDataFrame([("https://a.b/c?d", u) for u in ("//x.y/z", "/p", "http://q", "mailto:r", "", None)], "page string, u string")
    assert [r[0] for r in links.select(X.full_address(F.col("page"), F.col("u"))).collect()] == ["https://x.y/z", "https://a.b/p", "http://q", None, None, None]
    rows = spark.createDataFrame([("k", "en", 1), ("k", None, 2), ("k", "xx", 3), (None, "en", 4)], "key string, lang string, at int")
    assert {r.at: r.name for r in B.lookup(rows, {"en": "England"}, "lang", "name", "other").collect()} == {1: "England", 2: "other", 3: "other", 4: "England"}
    assert {r.name for r in B.lookup(rows, {}, "lang", "name", "other").collect()} == {"other"}
    assert {(r.key, r.at) for r in B.preferred(rows, "key", F.col("lang") == "xx", "at", 2).collect()} == {("k", 3), ("k", 1), (None, 4)}


def test_rollup_and_focus(spark):
    levels = {"a": ["high", "low"], "b": ["none"], "c": ["low"] * 3, "d": ["medium"] * 4}
    risks = spark.createDataFrame([(k, x, f"C{i}") for k, v in levels.items() for i, x in enumerate(v, 9)] + [("a", "high", "C10"), ("a", "high", "C9")], "doc string, risk_level string, clause string")
    assert {r.doc: r.status for r in U.report_rollup(risks, "doc").collect()} == {"a": "critical", "b": "safe", "c": "attention", "d": "warning"}
    assert [(r.doc, r.focus) for r in U.focus_list(risks, "doc", F.col("clause")).collect()] == [("a", "C9,C10")]
