"""Queries of the rule, ranking, retrieval and report operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import keyword_hits, lines_of, squash
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import rules as U
from ..operators import serving as B
from ..tables import table
from .registry import query
from .rule_packs import RULES


def _clauses(spark, sf) -> DataFrame:
    """Lines that are not blank are clauses; the language stands for the clause type."""
    return table(spark, sf, "documents").select("doc_id", F.col("lang").alias("clause_type"), F.posexplode(lines_of(F.col("text"))).alias("pos", "text"))


_CLAUSES = "(select doc_id, lang as clause_type, row_number() over (partition by doc_id order by i) - 1 as pos, regexp_replace(l, '\\s+', '', 'g') as t, l as text from (select doc_id, lang, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where trim(l) <> '')"


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]::varchar[]"


def _count(words: tuple[str, ...]) -> str:
    return f"len(list_filter({_list(words)}, lambda k: contains(t, k)))"


def _rule_sql(index: int, r: U.Rule) -> str:
    related = " or ".join(f"contains(clause_type, '{x}')" for x in r.related) or "false"
    groups = " and ".join(f"{_count(w)} > 0" for w in r.groups.values()) or "true"
    combos = " or ".join("(" + " and ".join(f"contains(t, '{w}')" for w in c) + ")" for c in r.combinations) or "true"
    required = f"{_count(r.required_any)} > 0" if r.required_any else "true"
    blocked = f"({_count(r.blocked)} > 0 and kw <= {r.blocked_max} and st = 0)" if r.blocked else "false"
    strong = "st > 0" if r.require_strong else "true"
    return f"""select doc_id, pos, {index} as rule_idx, '{r.risk_type}' as risk_type, kw, st, 6 * st + 2 * kw + cast(rel as int) + cast(grp as int) as conf,
 case when not (({strong}) and grp and ({required}) and ({combos}) and not {blocked} and kw + st > 0) then 0 when st > 0 then 3 when kw >= {r.medium_at} or 6 * st + 2 * kw + cast(rel as int) + cast(grp as int) >= 6 then 2 when kw >= {r.low_at} or (rel and kw >= 1) then 1 else 0 end as lv
 from (select *, {_count(r.keywords)} as kw, {_count(r.strong)} as st, ({related}) as rel, ({groups}) as grp from {_CLAUSES})"""


_HITS = "hits as (" + " union all ".join(_rule_sql(i, r) for i, r in enumerate(RULES)) + ")"
_RISKS = f"""with {_HITS}, good as (select *, max(lv) over (partition by doc_id, pos) as top, row_number() over (partition by doc_id, pos order by lv desc, conf desc, st desc, kw desc, rule_idx) as rn from hits where lv > 0),
kept as (select * from good where (top >= 2 and lv >= 2 and rn <= 2) or (top < 2 and rn = 1)),
risks as (select c.doc_id, c.pos, coalesce(k.rn, 1) as risk_no, coalesce(k.risk_type, 'no risk') as risk_type, case coalesce(k.lv, 0) when 3 then 'high' when 2 then 'medium' when 1 then 'low' else 'none' end as risk_level, coalesce(k.conf, 0) as confidence, coalesce(k.st, 0) as strong_count, coalesce(k.kw, 0) as keyword_count,
 coalesce(k.lv, 0) >= 2 as needs_attention, coalesce(k.lv = 3 or (k.lv = 2 and (k.st > 0 or k.kw >= 3 or k.conf >= 8)), false) as is_key from {_CLAUSES} c left join kept k using (doc_id, pos))"""


@query("pr1_keyword_score", f"select doc_id, pos, {_count(RULES[0].keywords)} as score from {_CLAUSES}")
def pr1(spark, sf):
    words = F.array(*[F.lit(w) for w in RULES[0].keywords])
    return _clauses(spark, sf).select("doc_id", F.col("pos").cast("long").alias("pos"), F.size(keyword_hits(squash(F.col("text")), words)).cast("long").alias("score"))


#: A wide pack: a thousand syllable pairs, built by rule.
_SYLLABLES = [a + b for a in ("th", "er", "en", "an", "in", "ch", "ei", "un", "qu", "ou", "re", "st", "ti", "on", "es", "de", "la", "le", "ci", "me") for b in ("a", "e", "i", "o", "u")]
WIDE = tuple(x + y for x in _SYLLABLES for y in _SYLLABLES[::10])


@query("jn1_wide_pack", f"select doc_id, sum(len(f)) as n_hits, count(*) filter (where len(f) > 0) as n_clauses, md5(string_agg(array_to_string(f, ','), ';' order by pos)) as md5 from (select doc_id, pos, list_filter({_list(WIDE)}, lambda k: contains(t, k)) as f from {_CLAUSES}) group by doc_id")
def jn1_wide_pack(spark, sf):
    """Every clause against a thousand words in one pass."""
    found = _clauses(spark, sf).select("doc_id", "pos", U.find_words(squash(F.col("text")), list(WIDE)).alias("f"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.array_join("f", ",").alias("f")))), lambda x: x["f"])
    return found.groupBy("doc_id").agg(F.sum(F.size("f")).alias("n_hits"), F.count_if(F.size("f") > 0).alias("n_clauses"), F.md5(F.array_join(listed, ";").cast("binary")).alias("md5"))


@query("pr4_combinations", f"select doc_id, count(*) filter (where (contains(t, 'the') and contains(t, 'and')) or (contains(t, 'les') and contains(t, 'des'))) as n_met, count(*) as n from {_CLAUSES} group by doc_id")
def pr4(spark, sf):
    met = U.all_of_any(squash(F.col("text")), RULES[1].combinations)
    return _clauses(spark, sf).groupBy("doc_id").agg(F.count_if(met).alias("n_met"), F.count("*").alias("n"))


@query("pr6_group_hits", f"select doc_id, sum({_count(RULES[4].groups['a'])}) as hits_a, sum({_count(RULES[4].groups['b'])}) as hits_b from {_CLAUSES} group by doc_id")
def pr6(spark, sf):
    hits = U.group_hits(squash(F.col("text")), RULES[4].groups)
    rows = _clauses(spark, sf).select("doc_id", hits.alias("h"))
    return rows.groupBy("doc_id").agg(F.sum(F.size(F.col("h")["a"])).alias("hits_a"), F.sum(F.size(F.col("h")["b"])).alias("hits_b"))


@query("tk1_risks", f"{_RISKS} select doc_id, pos, risk_no, risk_type, risk_level, confidence, strong_count, keyword_count, needs_attention, is_key from risks")
def tk1(spark, sf):
    risks = U.identify_risks(_clauses(spark, sf), RULES)
    return risks.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("risk_no").cast("long").alias("risk_no"), "risk_type", "risk_level", "confidence", "strong_count", "keyword_count", "needs_attention", "is_key")


@query("agg1_risk_summary", f"""{_RISKS} select doc_id, count(*) as total, count(*) filter (where needs_attention) as attention, count(*) filter (where risk_level = 'high') as high, count(*) filter (where is_key) as key_risks,
 count(*) filter (where risk_type = 'wages') as n_wages from risks group by doc_id""")
def agg1(spark, sf):
    summary = U.risk_summary(U.identify_risks(_clauses(spark, sf), RULES), "doc_id")
    wages = F.coalesce(F.try_element_at("risk_type_counts", F.lit("wages")), F.lit(0))
    return summary.select("doc_id", "total", "attention", "high", "key_risks", wages.alias("n_wages"))


@query("flagship_risk_by_language", f"""{_RISKS} select lang, risk_level, count(*) as n, sum(confidence) as confidence from risks join documents using (doc_id) group by lang, risk_level""")
def flagship(spark, sf):
    risks = U.identify_risks(_clauses(spark, sf), RULES)
    return risks.groupBy(F.col("clause_type").alias("lang"), "risk_level").agg(F.count("*").alias("n"), F.sum("confidence").alias("confidence"))


_KINDS = {"report": ("hation", "erthe"), "letter": ("ment", "eau"), "notice": ("keit", "ung"), "note": ("ción", "mente")}


@query("pr11_classify", "select doc_id, pos, case when clause_type = 'de' then 'german' when n1 = 0 and n2 = 0 and n3 = 0 and n4 = 0 then 'other' when n1 >= n2 and n1 >= n3 and n1 >= n4 then 'report' when n2 >= n3 and n2 >= n4 then 'letter' when n3 >= n4 then 'notice' else 'note' end as kind from (select *, " + ", ".join(f"{_count(w)} as n{i}" for i, w in enumerate(_KINDS.values(), 1)) + f" from {_CLAUSES})")
def pr11(spark, sf):
    kind = U.classify(F.col("text"), F.col("clause_type"), F.lit("-"), {"de": "german"}, {"§1": "first"}, _KINDS, "other")
    return _clauses(spark, sf).select("doc_id", F.col("pos").cast("long").alias("pos"), kind.alias("kind"))


@query("agg2_parse_metrics", f"select doc_id, count(*) as n_clauses, count(distinct left(text, 4)) as n_titles, cast(floor(avg(length(text))) as bigint) as mean_chars, count(*) <= 1 and sum(length(text)) > 1200 as under_segmented from {_CLAUSES} group by doc_id")
def agg2(spark, sf):
    return U.parse_metrics(_clauses(spark, sf), "doc_id", "text", F.left("text", F.lit(4)))


@query("agg3_report_rollup", f"""{_RISKS}, d as (select doc_id, count(*) filter (where risk_level = 'high') as critical, count(*) filter (where risk_level = 'medium') as warning, count(*) filter (where risk_level = 'low') as notice from risks group by doc_id)
select *, case when critical > 0 then 'critical' when warning + notice = 0 then 'safe' when warning + notice <= 3 then 'attention' else 'warning' end as status from d""")
def agg3(spark, sf):
    return U.report_rollup(U.identify_risks(_clauses(spark, sf), RULES), "doc_id")


_CUBE = "select lang, source, risk_level, grouping_id(lang, source, risk_level)::bigint as totals, count(*) as n, sum(confidence) as confidence, count(*) filter (where risk_level = 'high') as high, count(distinct doc_id) as documents from risks join (select doc_id, lang, source from documents) using (doc_id)"


def _risks_by_source(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", F.col("lang").alias("clause_type"), F.posexplode(lines_of(F.col("text"))).alias("pos", "text"))
    return U.identify_risks(docs, RULES).withColumnRenamed("clause_type", "lang")


@query("agg3_risk_cube", f"{_RISKS} {_CUBE} group by cube (lang, source, risk_level)")
def agg3_risk_cube(spark, sf):
    """Counts by language, source and level, and all their totals."""
    return U.risk_cube(_risks_by_source(spark, sf), ["lang", "source", "risk_level"])


@query("agg3_grouping_sets", f"{_RISKS} {_CUBE} group by grouping sets ((lang, risk_level), (source), ())")
def agg3_grouping_sets(spark, sf):
    return U.risk_cube(_risks_by_source(spark, sf), ["lang", "source", "risk_level"], [["lang", "risk_level"], ["source"], []])


@query("agg5_distribution", f"""{_RISKS}, n as (select doc_id, risk_type, count(*) as n from risks where risk_level <> 'none' group by doc_id, risk_type) select doc_id, string_agg(risk_type || ' x' || cast(n as varchar), ', ' order by risk_type) as sentence from n group by doc_id""")
def agg5(spark, sf):
    s = U.risk_summary(U.identify_risks(_clauses(spark, sf), RULES), "doc_id").where("risk_type_counts is not null")
    parts = F.transform(F.array_sort(F.map_entries("risk_type_counts")), lambda e: F.concat(e["key"], F.lit(" x"), e["value"].cast("string")))
    return s.select("doc_id", F.array_join(parts, ", ").alias("sentence"))


@query("agg6_focus_list", f"""{_RISKS} select doc_id, string_agg(id, ',' order by length(id), id) as focus from (select distinct doc_id, 'C' || cast(pos + 1 as varchar) as id from risks where risk_level = 'high') group by doc_id""")
def agg6(spark, sf):
    return U.focus_list(U.identify_risks(_clauses(spark, sf), RULES), "doc_id", F.concat(F.lit("C"), (F.col("pos") + 1).cast("string")))


@query("agg13_report_json", f"""{_RISKS} select doc_id, count(*) as n_items, md5(string_agg(cast(pos as varchar) || ':' || risk_type || ':' || risk_level, ';' order by pos, risk_no)) as md5 from risks where needs_attention group by doc_id""")
def agg13(spark, sf):
    # the nested report is built, written as JSON and read again
    risks = U.identify_risks(_clauses(spark, sf), RULES).where("needs_attention")
    items = F.array_sort(F.collect_list(F.struct("pos", "risk_no", "risk_type", "risk_level", "triggers")))
    report = risks.groupBy("doc_id").agg(F.to_json(F.struct(F.count("*").alias("n_items"), items.alias("risk_items"))).alias("report"))
    read = F.from_json("report", "n_items bigint, risk_items array<struct<pos:bigint,risk_no:bigint,risk_type:string,risk_level:string>>")
    line = F.transform(F.col("r.risk_items"), lambda x: F.concat_ws(":", x["pos"].cast("string"), x["risk_type"], x["risk_level"]))
    return report.select("doc_id", read.alias("r")).select("doc_id", F.col("r.n_items").alias("n_items"), F.md5(F.array_join(line, ";").cast("binary")).alias("md5"))


@query("jn3_lookup_default", "select doc_id, coalesce(name, 'other') as country_name from documents left join (values ('en', 'England'), ('fr', 'France')) v(lang, name) using (lang)")
def jn3(spark, sf):
    return B.lookup(table(spark, sf, "documents"), {"en": "England", "fr": "France"}, "lang", "country_name", "other").select("doc_id", "country_name")


# --- retrieval -----------------------------------------------------------------------------------


_RELEVANCE = """select doc_id, 5 * i + 8 * p - 7 * e - case when i = 0 and p = 0 then 5 else 0 end + 2 * cast(coalesce(contains(source, '1'), false) as int) - case when len(ls) = 0 or (len(ls) = 1 and starts_with(ls[1], '#')) or (len(ls) <= 2 and len(list_filter(ls, lambda x: length(x) > 20 or contains(x, '.'))) = 0) then 20 else 0 end as score
from (select doc_id, source, ls, len(list_filter(['hation', 'erthe'], lambda k: contains(t, k))) as i, len(list_filter(['ingth', 'ment'], lambda k: contains(t, k))) as p, len(list_filter(['keit'], lambda k: contains(t, k))) as e
from (select doc_id, source, regexp_replace(coalesce(source, '') || coalesce(text, ''), '\\s+', '', 'g') as t, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') as ls from documents))"""


@query("pr15_relevance", _RELEVANCE)
@query("pr15_relevance_all", _RELEVANCE)
def pr15_all(spark, sf):
    # every document, so that the rule on headings acts
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    r = R.relevance(F.lit(""), F.col("source"), F.col("text"), words("hation", "erthe"), words("ingth", "ment"), words("keit"), "1")
    return table(spark, sf, "documents").select("doc_id", r["score"].cast("long").alias("score"))


@query("pr28_queries", "select doc_id, len(list_distinct(list_filter([source, case when lang = 'en' then source || ' law' end, case when n_chars > 2000 then source || ' long' end, lang], lambda x: x is not null))) as n_queries from documents")
def pr28(spark, sf):
    made = R.targeted_queries(F.col("source"), [(F.col("lang") == "en", F.concat("source", F.lit(" law"))), (F.col("n_chars") > 2000, F.concat("source", F.lit(" long")))], F.col("lang"), "law")
    return table(spark, sf, "documents").select("doc_id", F.size(made).cast("long").alias("n_queries"))


def _hits(spark, sf) -> DataFrame:
    """Documents as hits of the item that is their source; the query is a third of them."""
    d = table(spark, sf, "documents")
    return d.select(F.col("source").alias("item"), F.col("lang").alias("kb_name"), F.left("text", F.lit(12)).alias("title"), F.col("text").alias("content"), (F.col("n_chars") % 40).alias("score"), (F.col("doc_id") % 3).alias("query_index"), "doc_id")


_HIT = "(select source as item, lang as kb_name, left(text, 12) as title, text as content, n_chars % 40 as score, doc_id % 3 as query_index, doc_id from documents)"


@query("tk5_first_successful", f"select item, doc_id, query_index > 0 as fallback_query from (select *, min(query_index) over (partition by item) as m from {_HIT} where score > 20) where query_index = m")
def tk5(spark, sf):
    return R.first_successful(_hits(spark, sf).where("score > 20"), "item", "query_index").select("item", "doc_id", "fallback_query")


@query("tk4_evidence", f"""with s as (select *, regexp_replace(title, '\\s+', '', 'g') as st, left(regexp_replace(content, '\\s+', '', 'g'), 160) as sc from {_HIT} where score >= 5),
o as (select *, row_number() over (partition by item, st, sc order by score desc, kb_name, title, content) as n from s), k as (select *, row_number() over (partition by item, kb_name order by score desc, kb_name, title, content) as m from o where n = 1)
select item, kb_name, title, score, row_number() over (partition by item order by score desc, kb_name, title, content) as rank from k where m <= 3""")
def tk4(spark, sf):
    return R.choose_evidence(_hits(spark, sf), "item", 3).select("item", "kb_name", "title", "score", F.col("rank").cast("long").alias("rank"))


@query("set4_keep_first", "select source, lang, min(doc_id) as doc_id from documents group by source, lang")
def set4(spark, sf):
    return R.keep_first(table(spark, sf, "documents").select("source", "lang", "doc_id"), ["source", "lang"], ["doc_id"])


@query("rt1_cosine", """with e as (select vec_id, embedding::double[] as v from embeddings), s as (select q.vec_id as query_id, c.vec_id as item_id, round(list_dot_product(q.v, c.v) / nullif(sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v)), 0), 9) as s from e q, e c where q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by s desc, item_id) as rank from s) select query_id, item_id, round(s, 4) as score, rank from r where rank <= 10""")
def rt1(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = R.cosine_top_k(rows.where("id % 50 = 0"), rows, 10)
    return found.select("query_id", "item_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


_THRESHOLD = """with e as (select vec_id, embedding::double[] as v from embeddings) select q.vec_id as query_id, count(*) as n from e q, e c where q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and round(list_dot_product(q.v, c.v) / nullif(sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v)), 0), 9) >= 0.2 group by q.vec_id"""


@query("dg3_cosine_threshold", _THRESHOLD)
@query("dg3_cosine_threshold_all", _THRESHOLD)
def dg3_all(spark, sf):
    # a plain filter, however many items match
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return R.cosine_at_least(rows.where("id % 50 = 0"), rows, 0.2).groupBy("query_id").agg(F.count("*").alias("n"))


@query("rt1_lexical", """with w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda x: x <> '') as w from documents), c as (select doc_id, len(w) as n, len(list_filter(w, lambda x: x = 'hation')) as a, len(list_filter(w, lambda x: x = 'erthe')) as b from w),
s as (select count(*) as docs, avg(n) as mean, count(*) filter (where a > 0) as da, count(*) filter (where b > 0) as db from c),
x as (select doc_id, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) as score from c, s)
select doc_id, score, row_number() over (order by score desc, doc_id) as rank from x where score > 0 order by score desc, doc_id limit 20""")
def rt1_lexical(spark, sf):
    found = R.bm25_top_k(table(spark, sf, "documents"), "doc_id", "text", ["hation", "erthe"], 20)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query("dg2_token_budget", "select conv_id, turn, used from (select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn) as used from conversations) where used <= 3000")
def dg2(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return R.token_budget(rows, "conv_id", ["turn"], "n", 3000).select("conv_id", "turn", "used")


@query("tk12_radius", """select s_name as name, cast(round(2 * 6371000 * asin(sqrt(power(sin((radians(lat) - radians(31.2)) / 2), 2) + cos(radians(31.2)) * cos(radians(lat)) * power(sin((radians(lon) - radians(121.4)) / 2), 2)))) as bigint) as distance from (select s_name, 30 + (s_suppkey * 37 % 200) / 100.0 as lat, 120 + (s_suppkey * 53 % 300) / 100.0 as lon from supplier) where round(2 * 6371000 * asin(sqrt(power(sin((radians(lat) - radians(31.2)) / 2), 2) + cos(radians(31.2)) * cos(radians(lat)) * power(sin((radians(lon) - radians(121.4)) / 2), 2)))) <= 50000 order by distance, name limit 20""")
def tk12(spark, sf):
    key = F.col("s_suppkey")
    points = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), (30 + (key * 37 % 200) / 100.0).alias("lat"), (120 + (key * 53 % 300) / 100.0).alias("lon"))
    return R.within_radius(points, 31.2, 121.4, 50000).select("name", "distance")


# --- graph ---------------------------------------------------------------------------------------


def _graph(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    nodes = c.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"), F.col("c_mktsegment").alias("description"))
    edges = o.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("weight")).join(c.hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
    edges = edges.select(F.col("c_name").alias("src"), F.col("o_orderpriority").alias("dst"), "weight")
    aliases = c.where("c_custkey % 2 = 1 and c_custkey > 1").select(F.col("c_name").alias("name"), F.format_string("Customer#%09d", F.col("c_custkey") - 1).alias("target"))
    return nodes, edges, aliases.join(c.select(F.col("c_name").alias("target")), "target", "left_semi").select("name", "target")


_ALIAS = "a as (select c_name as name, printf('Customer#%09d', c_custkey - 1) as target from customer where c_custkey % 2 = 1 and c_custkey > 1 and printf('Customer#%09d', c_custkey - 1) in (select c_name from customer))"


@query("dg7_merge_nodes", f"with {_ALIAS} select coalesce(target, c_name) as name, min(c_mktsegment) as kind, string_agg(distinct c_mktsegment, '; ' order by c_mktsegment) as description from customer left join a on c_name = a.name group by 1")
def dg7_nodes(spark, sf):
    return G.merge_entities(*_graph(spark, sf))[0]


@query("dg7_merge_edges", f"with {_ALIAS}, e as (select c_name as src, o_orderpriority as dst from orders join customer on o_custkey = c_custkey) select coalesce(target, src) as src, dst, count(*) as weight from e left join a on src = a.name where coalesce(target, src) <> dst group by 1, 2")
def dg7_edges(spark, sf):
    return G.merge_entities(*_graph(spark, sf))[1]


@query("dg6_delete_documents", "select lang as name, count(*) as n_sources from documents where doc_id not in (select doc_id from labels where quality = 0) group by lang")
def dg6(spark, sf):
    items = table(spark, sf, "documents").select(F.col("lang").alias("name"), "doc_id")
    return G.delete_documents(items, table(spark, sf, "labels").where("quality = 0").select("doc_id"))


@query("dg1_local_neighbours", "with e as (select c_name as src, o_orderpriority as dst, count(*) as weight from orders join customer on o_custkey = c_custkey group by 1, 2) select dst as name, src as neighbour, weight from e where dst = '1-URGENT'")
def dg1(spark, sf):
    seeds = spark.createDataFrame([("1-URGENT",)], "name string")
    return G.neighbours(_graph(spark, sf)[1], seeds)


@query("tk10_preferred", "select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by case when role = 'user' then 0 else 1 end, turn) as n from conversations) where n <= 2")
def tk10(spark, sf):
    return B.preferred(table(spark, sf, "conversations"), "conv_id", F.col("role") == "user", "turn", 2).select("conv_id", "turn", "role")
