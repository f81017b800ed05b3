"""Queries of the review, rendering, graph and bookkeeping operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import image_urls, lines_of
from ..operators import display as D
from ..operators import graph as G
from ..operators import quantized as Z
from ..operators import render as N
from ..operators import retrieval as R
from ..operators import review as V
from ..operators import rules as U
from ..operators import segments as S
from ..operators import serving as B
from ..sources import files
from ..tables import table
from .registry import QUERIES, query
from .rule_packs import RULES
from .rule_queries import _CLAUSES, _RISKS, _clauses, _graph
from .text_queries import _cut_sql, titles_sql, weak_sql

RETRIEVAL = {
    "en": {"include_any": ["hation", "erthe"], "prefer_any": ["ingth", "tionth"], "fallback_keywords": ["ofthe"]},
    "fr": {"include_any": ["ment"], "prefer_any": ["eau", "aux"], "exclude_any": [], "fallback_keywords": ["elle"]},
    "de": {"prefer_any": ["ung", "sch"], "exclude_any": ["zzz"]},
}
DEFAULT = {"include_any": ["ción"], "prefer_any": ["mente"], "exclude_any": ["keit"], "fallback_keywords": ["que"]}
ADJUSTMENTS = (
    V.Adjustment("plain", "en", -8, has=("hation",), lacks=("ingth", "erthe")),
    V.Adjustment("specific", "fr", 8, has=("ment", "eau"), clause_has=("aux",)),
    V.Adjustment("missing", "fr", -24, lacks=("ment", "eau"), clause_has=("aux",)),
    V.Adjustment("apart", "de", 3, has=("sch",), clause_lacks=("keit",)),
)


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _md5(column):
    return F.md5(column.cast("binary"))


def _rule(kind):
    return V.retrieval_rule(kind, RETRIEVAL, DEFAULT)


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]::varchar[]"


def _sql_rule(name: str, kind: str = "lang") -> str:
    cases = " ".join(f"when '{k}' then {_sql_list(r[name])}" for k, r in RETRIEVAL.items() if name in r)
    return f"case {kind} {cases} else {_sql_list(DEFAULT[name])} end"


def _sql_any(column: str, words) -> str:
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _sql_adjustments() -> str:
    out = []
    for a in ADJUSTMENTS:
        parts = [f"lang = '{a.risk_type}'"]
        parts += [_sql_any("t", a.has)] if a.has else []
        parts += ["not " + _sql_any("t", a.lacks)] if a.lacks else []
        parts += [_sql_any("c", a.clause_has)] if a.clause_has else []
        parts += ["not " + _sql_any("c", a.clause_lacks)] if a.clause_lacks else []
        out.append(f"case when {' and '.join(parts)} then {a.points} else 0 end")
    return " + ".join(out)


_BARE = "(len(ls) = 0 or (len(ls) = 1 and starts_with(ls[1], '#')) or (len(ls) <= 2 and len(list_filter(ls, lambda x: length(x) > 20 or contains(x, '.'))) = 0))"
_LS = "list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"


def _sql_score(rows: str, keep: str) -> str:
    """Scores of rows (lang, clause, kb_name, title, content and ``keep``)."""
    return f"""(select {keep}, lang, kb_name, title, content, ls, 5 * len(i) + 8 * len(p) + 4 * len(list_filter(p, lambda w: contains(c, w))) - 7 * len(e) - case when kb_name = 'src2' or kb_name = 'turns' then 1 else 0 end + case when contains(title, '1') then 2 else 0 end
 - case when {_BARE} then 20 else 0 end - case when len(i) = 0 and len(p) = 0 then 5 else 0 end + {_sql_adjustments()} as score
 from (select *, list_filter({_sql_rule('include_any')}, lambda w: contains(t, w)) as i, list_filter({_sql_rule('prefer_any')}, lambda w: contains(t, w)) as p, list_filter({_sql_rule('exclude_any')}, lambda w: contains(t, w)) as e
 from (select *, {_LS} as ls, regexp_replace(title || content, '\\s+', '', 'g') as t, regexp_replace(clause, '\\s+', '', 'g') as c from {rows})))"""


_SCORING = {"adjustments": ADJUSTMENTS, "article_words": ("1",), "penalties": {"src2": 1, "turns": 1}}


@query("pr22_rule_merge", f"select doc_id, array_to_string({_sql_rule('include_any')}, ',') as include_any, array_to_string({_sql_rule('prefer_any')}, ',') as prefer_any, array_to_string({_sql_rule('exclude_any')}, ',') as exclude_any, array_to_string({_sql_rule('fallback_keywords')}, ',') as fallback_keywords from documents")
def pr22(spark, sf):
    rows = _docs(spark, sf).select("doc_id", _rule(F.col("lang")).alias("r"))
    return rows.select("doc_id", *[F.array_join(F.col(f"r.{name}"), ",").alias(name) for name in V.RULE_FIELDS])


@query("pr15_adjustments", f"select doc_id, score from {_sql_score('''(select doc_id, lang, regexp_replace(text, 'ment|ing', '', 'g') as clause, source as kb_name, source as title, text as content from documents)''', 'doc_id')}")
def pr15_adjustments(spark, sf):
    rows = _docs(spark, sf).select(
        "doc_id", F.col("lang").alias("risk_type"), _rule(F.col("lang")).alias("rule"), F.regexp_replace("text", "ment|ing", "").alias("clause"),
        F.col("source").alias("kb_name"), F.col("source").alias("title"), F.col("text").alias("content"),
    )
    return V.score_hit(rows, **_SCORING).select("doc_id", F.col("score").cast("long").alias("score"))


_KINDS = ("en", "fr", "de", "es")


def _search_words() -> dict[tuple[str, int], list[str]]:
    rules = {k: DEFAULT | RETRIEVAL.get(k, {}) for k in _KINDS}
    return {(k, i): words for k, r in rules.items() for i, words in enumerate([[*r["include_any"], *r["prefer_any"][:3]], r["fallback_keywords"]])}


_SEARCH = "(values " + ", ".join(f"('{k}', {i}, {_sql_list(w)})" for (k, i), w in _search_words().items()) + ") q(kind, qi, words)"
_STORES = "(select 'benchmark' as kb_name, item_id, text as content from benchmark union all select 'turns', conv_id * 1000 + turn, text from conversations where role <> 'user')"


@query("rt3_risk_retrieval", f"""with h as (select kind, qi, kb_name, item_id, content, len(list_filter(words, lambda w: contains(regexp_replace(content, '\\s+', '', 'g'), w))) as hits from {_STORES}, {_SEARCH}),
top as (select * from (select *, row_number() over (partition by kind, qi, kb_name order by hits desc, item_id) as n from h where hits > 0) where n <= 6),
m as (select d.doc_id, d.lang, d.text as clause, kb_name, '' as title, content, qi from documents d join top on d.lang = kind where d.doc_id % 50 = 0),
s as (select * from {_sql_score('m', 'doc_id, qi')} where score >= 5 and trim(content) <> '' and not contains(content, 'keit') and not {_BARE}),
n as (select doc_id, kb_name, qi, content, score, left(trim(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '')[1]), 80) as title from s),
f as (select *, min(qi) over (partition by doc_id) as least from n),
o as (select *, row_number() over (partition by doc_id, regexp_replace(title, '\\s+', '', 'g'), left(regexp_replace(content, '\\s+', '', 'g'), 160) order by score desc, kb_name, title, content) as again from f where qi = least),
k as (select *, row_number() over (partition by doc_id, kb_name order by score desc, kb_name, title, content) as place from o where again = 1),
b as (select doc_id, count(*) as n_bases, string_agg(kb_name || ':' || cast(score as varchar) || ':' || title, ';' order by score desc, kb_name, title, content) as line, max(least) as late from k where place <= 3 group by doc_id)
select d.doc_id, coalesce(n_bases, 0) as n_bases, md5(coalesce(line, '')) as md5, case when late is null then 'insufficient_specificity' when late > 0 then 'fallback_query' else 'exact_match' end as notes from documents d left join b using (doc_id) where d.doc_id % 50 = 0""")
def rt3(spark, sf):
    turns = table(spark, sf, "conversations").where("role <> 'user'").select(F.lit("turns").alias("kb_name"), (F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), F.col("text").alias("content"))
    store = table(spark, sf, "benchmark").select(F.lit("benchmark").alias("kb_name"), "item_id", F.col("text").alias("content")).unionByName(turns).withColumn("title", F.lit(""))
    items = _docs(spark, sf).where("doc_id % 50 = 0").select("doc_id", F.col("lang").alias("risk_type"), F.col("text").alias("clause"))
    got = V.retrieve_evidence(items, V.keyword_search(_search_words(), store, 6), _rule, ["keit"], "doc_id", 3, **_SCORING)
    line = F.array_join(F.transform("bases", lambda b: F.concat_ws(":", b["kb_name"], b["score"].cast("string"), b["title"])), ";")
    return got.select("doc_id", F.size("bases").cast("long").alias("n_bases"), _md5(line).alias("md5"), F.array_join("retrieval_notes", ",").alias("notes"))


@query("jn2_clause_of_risk", "select l.doc_id, l.quality, d.source as section, d.n_chars from labels l left join (select * from documents where lang in ('en', 'fr')) d using (doc_id)")
def jn2(spark, sf):
    clauses = _docs(spark, sf).where("lang in ('en', 'fr')").select("doc_id", F.col("source").alias("section"), "n_chars")
    return V.clause_of(table(spark, sf, "labels").select("doc_id", "quality"), clauses, ["doc_id"])


HEADLINES = {
    "en": [V.Headline("long terms", (("hationth", "ertheer"),)), V.Headline("with triggers", (("zzz",),), triggers=("src1",)), V.Headline("other")],
    "fr": [V.Headline("no water", lacks=("eau",)), V.Headline("both", (("eauaux", "eaueau"), ("ment",)))],
}


@query("pr19_headline", """select doc_id, coalesce(nullif(left(trim(e), 80), ''), case lang when 'en' then case when contains(text, 'hationth') or contains(text, 'ertheer') then 'long terms' when contains(text, 'zzz') or contains(source, 'src1') then 'with triggers' else 'other' end
 when 'fr' then case when not contains(text, 'eau') then 'no water' when (contains(text, 'eauaux') or contains(text, 'eaueau')) and contains(text, 'ment') then 'both' end end,
 case when title = '' then null when length(title) <= 20 then title || ' needs a look' else left(title, 18) || '… needs a look' end, case when lang = 'es' then 'to be reviewed' else lang || ' needs a look' end) as headline
 from (select *, case when doc_id % 7 = 0 then ' Summary of ' || cast(doc_id as varchar) || ' ' else '' end as e, case doc_id % 3 when 0 then repeat(source, 7) when 1 then source else '' end as title from documents)""")
def pr19(spark, sf):
    k = F.col("doc_id")
    explicit = F.when(k % 7 == 0, F.concat(F.lit(" Summary of "), k.cast("string"), F.lit(" "))).otherwise("")
    section = F.when(k % 3 == 0, F.repeat("source", 7)).when(k % 3 == 1, F.col("source")).otherwise("")
    return _docs(spark, sf).select("doc_id", V.headline(explicit, F.col("lang"), F.col("text"), F.array("source"), section, HEADLINES, "es", "to be reviewed", " needs a look").alias("headline"))


@query("pr20_lookups", "select doc_id, case lang when 'en' then 'critical' when 'fr' then 'warning' else 'notice' end as severity, case lang when 'en' then 'write it down' else 'have it checked' end as suggestion, case lang when 'de' then 'often disputed' else 'to be looked at' end || case doc_id % 3 when 0 then ': no basis' when 1 then ': weak basis' else '' end as explanation from documents")
def pr20(spark, sf):
    tables = {"severity": ({"en": "critical", "fr": "warning"}, "notice"), "suggestion": ({"en": "write it down"}, "have it checked"), "prefix": ({"de": "often disputed"}, "to be looked at")}
    status = F.when(F.col("doc_id") % 3 == 0, "missing").when(F.col("doc_id") % 3 == 1, "weak").otherwise("given")
    rows = _docs(spark, sf).select("doc_id", status.alias("status"), *V.lookups(F.col("lang"), tables))
    return rows.select("doc_id", "severity", "suggestion", V.explanation(F.col("prefix"), F.col("status"), {"missing": ": no basis", "weak": ": weak basis"}).alias("explanation"))


@query("agg10_review_counts", "select lang, count(*) as reviewed, count(*) filter (where n_chars % 2 = 0) as candidates, count(*) filter (where doc_id % 4 < 2) as high_or_medium, count(*) filter (where doc_id % 4 = 2) as insufficient from documents group by lang")
def agg10(spark, sf):
    level = F.element_at(F.array(*[F.lit(x) for x in ("high", "medium", "insufficient", "low")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return V.review_counts(_docs(spark, sf).select("lang", (F.col("n_chars") % 2 == 0).alias("risk_candidate"), level.alias("risk_level")), "lang")


@query("agg11_report_context", f"""{_RISKS}, p as (select doc_id, count(*) filter (where pos % 5 < 4) as n_clauses, count(*) filter (where pos % 5 = 4) as n_attachments from {_CLAUSES} group by doc_id),
f as (select * from risks where risk_level <> 'none'), t as (select doc_id, string_agg(risk_type || '=' || cast(n as varchar), ',' order by risk_type) as types from (select doc_id, risk_type, count(*) as n from f group by all) group by doc_id),
i as (select doc_id, count(*) filter (where is_key) as n_key, md5(string_agg(cast(pos as varchar) || ':' || risk_type, ';' order by pos, risk_type)) as md5 from f group by doc_id)
select doc_id, n_clauses, n_attachments, coalesce(n_key, 0) as n_key, types, md5 from p left join t using (doc_id) left join i using (doc_id)""")
def agg11(spark, sf):
    clauses = _clauses(spark, sf)
    risks = U.identify_risks(clauses, RULES).where("risk_level <> 'none'").select("doc_id", F.col("pos").alias("item_id"), "risk_type", "is_key")
    made = V.report_context(clauses.select("doc_id", F.when(F.col("pos") % 5 == 4, "attachment").otherwise("main_body").alias("part")), risks, "doc_id")
    types = F.array_join(F.transform(F.array_sort(F.map_entries("risk_type_counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    line = F.array_join(F.transform("risk_items", lambda r: F.concat_ws(":", r["item_id"].cast("string"), r["risk_type"])), ";")
    return made.select("doc_id", "n_clauses", "n_attachments", "n_key", types.alias("types"), _md5(line).alias("md5"))


@query("agg7_run_counts", "select conv_id, count(*) filter (where role = 'assistant') as success, count(*) filter (where role = 'user') as skipped, case when conv_id = (select max(conv_id) from conversations) then count(*) filter (where role = 'assistant') end as total_articles from conversations group by conv_id")
def agg7(spark, sf):
    status = F.when(F.col("role") == "assistant", "success").when(F.col("role") == "user", "skip").otherwise("other")
    return B.run_counts(table(spark, sf, "conversations").select("conv_id", status.alias("status")), "conv_id", "status")


@query("tk6_history", "select o_custkey, o_orderkey, rank from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rank from orders) where rank <= 5")
def tk6(spark, sf):
    return B.latest_per(table(spark, sf, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 5).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("tk7_newest", "select o_orderkey, row_number() over (order by o_orderdate desc, o_orderkey) - 1 as place from orders")
def tk7(spark, sf):
    return B.number_rows(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.col("o_orderkey")], "place").select("o_orderkey", "place")


@query("tk9_last_lines", "select doc_id, md5(array_to_string(ls[greatest(len(ls) - 4, 1):], chr(10))) as md5 from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as ls from documents)")
def tk9(spark, sf):
    return _docs(spark, sf).select("doc_id", _md5(F.array_join(B.last_n(lines_of(F.col("text")), 5), "\n")).alias("md5"))


@query("set1_body_and_attachments", f"""{_RISKS}, k as (select doc_id, pos, risk_type, row_number() over (partition by doc_id, pos order by rn) as risk_no from kept where lv = 3 or (lv = 2 and (st > 0 or kw >= 3 or conf >= 8)))
select doc_id, pos, risk_no, risk_type from risks where pos % 5 < 4 union all select c.doc_id, c.pos, coalesce(risk_no, 1), coalesce(risk_type, 'no risk') from {_CLAUSES} c left join k using (doc_id, pos) where c.pos % 5 = 4""")
def set1(spark, sf):
    clauses = _clauses(spark, sf)
    body, extra = U.identify_risks(clauses.where("pos % 5 < 4"), RULES), U.identify_risks(clauses.where("pos % 5 = 4"), RULES, key_only=True)
    return body.unionByName(extra).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("risk_no").cast("long").alias("risk_no"), "risk_type")


@query("set5_sorted_notes", f"select doc_id, array_to_string(list_sort(list_distinct(list(left(text, 2)))), ',') as notes from {_CLAUSES} group by doc_id")
def set5(spark, sf):
    notes = F.transform(lines_of(F.col("text")), lambda x: F.left(x, F.lit(2)))
    return _docs(spark, sf).where(F.size(lines_of(F.col("text"))) > 0).select("doc_id", F.array_join(V.sorted_notes(notes), ",").alias("notes"))


@query("pr23_public", "select c_custkey, c_name, c_nationkey, c_mktsegment from customer where c_mktsegment = 'BUILDING' and c_nationkey = 3")
def pr23(spark, sf):
    return B.public_columns(table(spark, sf, "customer"), ["c_acctbal"], c_mktsegment="BUILDING", c_nationkey=3)


@query("snk6_unmatched_requests", "select distinct o_orderkey, o_custkey + 1 as o_custkey from orders where o_orderstatus = 'P' and o_custkey % 2 = 1")
def snk6(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    requests = rows.where("o_orderstatus = 'P'").select("o_orderkey", (F.col("o_custkey") + F.col("o_custkey") % 2).alias("o_custkey"))
    return B.unmatched_requests(rows, requests, "o_orderkey", "o_custkey")


@query("snk9_merged_state", "select o_custkey, max(o_orderkey) as o_orderkey from orders group by o_custkey")
def snk9(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    old = rows.where("o_orderkey % 2 = 0").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    return B.merge_state(old, rows.where("o_orderkey % 2 = 1"), "o_custkey", "o_orderkey")


_PLACE = "30 + (s_suppkey * 37 % 200) / 100.0 as lat, 120 + (s_suppkey * 53 % 300) / 100.0 as lon"


@query("rt10_near_places", f"""with p as (select s_name as name, s_suppkey, {_PLACE} from supplier), r as (select n_nationkey as request_id, 30 + (n_nationkey * 7 % 20) / 10.0 as a, 120 + (n_nationkey * 11 % 30) / 10.0 as b from nation where n_nationkey % 5 <> 4),
d as (select request_id, name, cast(round(2 * 6371000 * asin(sqrt(power(sin((radians(lat) - radians(a)) / 2), 2) + cos(radians(a)) * cos(radians(lat)) * power(sin((radians(lon) - radians(b)) / 2), 2)))) as bigint) as distance from p, r)
select * from (select *, row_number() over (partition by request_id order by distance, name) as rank from d where distance <= 40000) where rank <= 8""")
def rt10(spark, sf):
    key, n = F.col("s_suppkey"), F.col("n_nationkey")
    points = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), (30 + (key * 37 % 200) / 100.0).alias("lat"), (120 + (key * 53 % 300) / 100.0).alias("lon"))
    nations = table(spark, sf, "nation")
    places = nations.where("n_nationkey % 5 <> 4").select(F.col("n_name").alias("place"), (30 + (n * 7 % 20) / 10.0).alias("lat"), (120 + (n * 11 % 30) / 10.0).alias("lon"))
    found = R.near_places(nations.select(n.alias("request_id"), F.col("n_name").alias("place")), places, points, 40000, 8)
    return found.withColumn("rank", F.col("rank").cast("long")).withColumn("request_id", F.col("request_id").cast("int"))


# --- segments ------------------------------------------------------------------------------------

_STRIPPED = "(select doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as ls from documents)"


@query("seg5_section_titles", f"""with a as (select doc_id, case when coalesce(regexp_matches(ls[1], '^[A-Z][a-z]+ ') and regexp_matches(ls[2], '^Th'), false) then ls[2:] else ls end as ls from {_STRIPPED})
select doc_id, md5(array_to_string(case when len(ls) > 0 and regexp_matches(ls[len(ls)], '^[A-Z][a-z]+ ') then ls[1:len(ls) - 1] else ls end, chr(10))) as md5 from a""")
def seg5(spark, sf):
    return _docs(spark, sf).select("doc_id", _md5(S.strip_section_titles(F.col("text"), "^[A-Z][a-z]+ ", "^Th")).alias("md5"))


@query("seg3_title_places", """with p as (select doc_id, string_split(regexp_replace(text, '(Th[a-z]+\\.)', chr(1) || '\\1', 'g'), chr(1)) as parts from documents), u as (select doc_id, parts, unnest(range(1, len(parts) + 1)) as i from p)
select doc_id, coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x))), 0)::bigint as place, regexp_extract(parts[i], '^(Th[a-z]+\\.)', 1) as section_title from u where regexp_matches(parts[i], '^Th[a-z]+\\.')""")
def seg3(spark, sf):
    return S.section_titles(_docs(spark, sf), "doc_id", "text", "Th[a-z]+\\.").withColumn("place", F.col("place").cast("long"))


@query("seg9_attachments", """with p as (select doc_id, text, list_filter(string_split(regexp_replace(text, '(Released|Licensed|All rights)', chr(1) || '\\1', 'g'), chr(1)), lambda x: regexp_matches(x, '^(Released|Licensed|All rights)')) as parts from documents),
q as (select doc_id, len(parts) > 0 as marked, unnest(case when len(parts) > 0 then parts else [text] end) as t, generate_subscripts(case when len(parts) > 0 then parts else [text] end, 1) as pos from p),
r as (select *, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as ls from q where trim(t, ' ' || chr(10) || chr(9)) <> '')
select doc_id, pos, 'A' || cast(pos as varchar) as attachment_id, case when marked then array_to_string(ls[1:2], ' ') else 'attachment' end as title, md5(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) as md5 from r""")
def seg9(spark, sf):
    rows = S.split_attachments(_docs(spark, sf), "doc_id", "text", "Released|Licensed|All rights", "attachment")
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "attachment_id", "title", _md5(F.col("text")).alias("md5"))


_HEAD_OF_PART = "[A-Z][a-z]+ the"


@query("seg7_any_clauses", f"""with m as (select doc_id, place, {titles_sql('part', '^' + _HEAD_OF_PART, '^Th[a-z]+[.]')} as text from {_cut_sql('text', 'Th[a-z]+[.]', 'documents')}), r as (select doc_id, row_number() over (partition by doc_id order by place) as pos, text from m
union all select * from {weak_sql("(select * from documents where not regexp_matches(text, 'Th[a-z]+[.]'))", _HEAD_OF_PART, ['hation ', 'ement '], '[0-9]{1,2}[.)]')}) select doc_id, pos, 'C' || cast(pos as varchar) as clause_id, md5(text) as md5 from r""")
def seg7_any(spark, sf):
    rows = S.split_any_clauses(_docs(spark, sf), "doc_id", "text", "Th[a-z]+\\.", "[A-Z][a-z]+ the[^\n]*", ["hation ", "ement "], "[0-9]{1,2}[.)]")
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "clause_id", _md5(F.col("text")).alias("md5"))


@query("src13_images", "select doc_id, i, case i when 1 then 'https://h/a' || cast(doc_id as varchar) || '?w=276' when 2 then 'http://x.org/b' || source || '?a=1&w=3' end as url from documents, (values (1), (2)) v(i) where (i = 1 and doc_id % 2 = 0) or (i = 2 and doc_id % 3 > 0)")
def src13_images(spark, sf):
    k = F.col("doc_id")
    first = F.concat(F.lit("<p><img class='pic big' src='' data-src=\"//h/a"), k.cast("string"), F.when(k % 2 == 0, "?w=276").otherwise("?w=9"), F.lit("\">"))
    second = F.concat(F.lit("<IMG alt='x'\n class='big pic' src='"), F.when(k % 3 > 0, "/b").otherwise("data:image/b"), "source", F.lit("?a=1&w=3'><img src='http://y/c?w=276'>"))
    urls = image_urls(F.concat(first, second), F.lit("http://x.org"), ["pic", "big"])
    rows = _docs(spark, sf).select("doc_id", F.explode(urls).alias("url"))
    return rows.select("doc_id", F.when(F.contains("url", F.lit("/a")), 1).otherwise(2).alias("i"), "url")


@query("src17_join_pages", "select conv_id, md5(string_agg(text, chr(10) || chr(10) order by turn)) as md5 from conversations group by conv_id")
def src17(spark, sf):
    return files.join_pages(table(spark, sf, "conversations"), "conv_id", "turn", "text").select("conv_id", _md5(F.col("text")).alias("md5"))


@query("tx9_clean_pages", "select conv_id, turn as page_no, role as parse_mode, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '' and not regexp_matches(x, '^[0-9]{1,3}$')), chr(10))) as md5 from conversations")
def tx9(spark, sf):
    from ..functions.text import drop_page_numbers

    pages = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("page_no"), F.col("role").alias("parse_mode"), "text")
    cleaned = pages.withColumn("text", F.array_join(drop_page_numbers(lines_of(F.col("text"))), "\n"))
    return cleaned.select("conv_id", "page_no", "parse_mode", _md5(F.col("text")).alias("md5"))


# --- rendering -----------------------------------------------------------------------------------


@query("sc3_render_blocks", f"""select doc_id, md5(trim(regexp_replace(array_to_string(list_transform(ls, lambda x, i: case (i - 1) % 4 when 0 then chr(10) || x || chr(10) when 1 then regexp_replace(x, '(Th[a-z]+)', chr(10) || '\\1', 'g')
 when 2 then chr(10) || case when starts_with(x, 'The') then x else 'Part ' || x end || chr(10) else x end), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))) as md5 from {_STRIPPED}""")
def sc3(spark, sf):
    kinds = F.array(*[F.lit(x) for x in ("section_title", "clause", "attachment", "paragraph")])
    blocks = F.transform(lines_of(F.col("text")), lambda x, i: F.struct(F.element_at(kinds, i % 4 + 1).alias("block_type"), x.alias("text")))
    return _docs(spark, sf).select("doc_id", _md5(N.render_blocks(blocks, "Th[a-z]+", "The", "Part")).alias("md5"))


@query("sc4_response_text", "select conv_id, turn, md5(case when turn % 2 = 0 then trim(text, ' ' || chr(10) || chr(9) || chr(13)) else role || chr(10) || text end) as md5 from conversations")
def sc4(spark, sf):
    part = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"))
    plain = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    listed = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(part(F.col("role")), part(F.lit("")), part(F.col("text"))).alias("content")).alias("message"))).alias("choices")))
    answer = F.when(F.col("turn") % 2 == 0, plain).otherwise(listed)
    return table(spark, sf, "conversations").select("conv_id", "turn", _md5(N.response_text(answer)).alias("md5"))


@query("sc6_contexts", "select conv_id, turn, case turn % 4 when 0 then 2 when 1 then 2 when 2 then 1 end as n, md5(case turn % 4 when 0 then role || chr(10) || chr(10) || text when 1 then role || chr(10) || chr(10) || text when 2 then text end) as md5 from conversations")
def sc6(spark, sf):
    both = F.concat("role", F.lit("\n\n"), "text")
    result = (
        F.when(F.col("turn") % 4 == 0, F.to_json(F.struct(F.lit("").alias("context"), F.array("role", "text").alias("contexts"), F.lit("x").alias("sources"))))
        .when(F.col("turn") % 4 == 1, F.to_json(F.struct(both.alias("context"), F.array().cast("array<string>").alias("contexts"))))
        .when(F.col("turn") % 4 == 2, F.to_json(F.struct(F.col("text").alias("result"))))
        .otherwise(F.to_json(F.struct(F.lit(1).alias("other"))))
    )
    rows = table(spark, sf, "conversations").select("conv_id", "turn", result.alias("r"))
    n = F.when(N.context_list(F.col("r")).isNotNull(), F.size(N.context_list(F.col("r"))))
    return rows.select("conv_id", "turn", n.cast("int").alias("n"), _md5(N.context_text(F.col("r"))).alias("md5"))


@query("rt7_answer_prompt", "select conv_id, turn, md5('Answer from the context.' || chr(10) || chr(10) || 'Context:' || chr(10) || text || chr(10) || chr(10) || 'Question: ' || role || chr(10) || 'Answer:') as md5 from conversations")
def rt7(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", _md5(N.answer_prompt(F.col("role"), F.col("text"), "Answer from the context.")).alias("md5"))


_LABELS = {"item": "Risk", "item_id": "id", "risk_type": "type", "notes": "notes", "bases": "bases"}


@query("rt6_report_prompt", """with i as (select conv_id, count(*) as n, string_agg(cast(turn as varchar), ', ' order by turn) as ids, string_agg('### Risk ' || cast(k as varchar) || chr(10) || '- id: ' || cast(turn as varchar) || chr(10) || '- type: ' || role || chr(10) || '- notes: ' || case when turn % 2 = 0 then 'exact' else 'none given' end || chr(10) || '- bases:' || chr(10) || case when turn % 3 = 0 then 'no basis found' else '- [kb] ' || role || chr(10) || '  ' || text end, chr(10) || chr(10) order by turn) as body
 from (select *, row_number() over (partition by conv_id order by turn) as k from conversations) group by conv_id)
select conv_id, md5('Write a report.' || chr(10) || 'items: ' || cast(n as varchar) || chr(10) || 'ids: ' || ids || chr(10) || 'source: ' || cast(conv_id as varchar) || chr(10) || 'summary: {"n":' || cast(n as varchar) || '}' || chr(10) || chr(10) || body) as md5 from i""")
def rt6(spark, sf):
    k = F.col("turn")
    basis = F.array(F.struct(F.lit("kb").alias("kb_name"), F.col("role").alias("title"), F.col("text").alias("content")))
    item = F.struct(k.alias("item_id"), F.col("role").alias("risk_type"), F.when(k % 2 == 0, F.array(F.lit("exact"))).otherwise(F.array().cast("array<string>")).alias("notes"), F.when(k % 3 != 0, basis).alias("bases"))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.count("*").alias("n"))
    prompt = N.report_prompt(F.col("conv_id").cast("string"), F.struct("n"), F.col("items"), _LABELS, "Write a report.", "none given", "no basis found")
    return rows.select("conv_id", _md5(prompt).alias("md5"))


_HEAD = "'[DOC_ID] ' || id || chr(10) || '[DOC_TYPE] ' || kind || chr(10) || '[TITLE] ' || title || chr(10) || '[SOURCE] ' || source || chr(10) || '[META] ' || meta || chr(10) || '[CONTENT]' || chr(10) || content"


@query("pr27_documents", f"""with c as (select 'contract_clause:C' || cast(doc_id as varchar) as id, 'contract_clause' as kind, concat_ws(' ', case when doc_id % 2 = 0 then source end, case when doc_id % 3 = 0 then 'C' || cast(doc_id as varchar) else lang end) as title, source,
 '{{"clause_id":"C' || cast(doc_id as varchar) || '","clause_type":"' || case when doc_id % 5 = 0 then 'unsorted' else lang end || '","part":"main_body"}}' as meta, case when doc_id % 2 = 0 then source || chr(10) else '' end || trim(text) as content from documents where trim(text) <> ''),
a as (select 'contract_attachment:A' || cast(item_id as varchar) as id, 'contract_clause' as kind, 'A' || cast(item_id as varchar) as title, 'benchmark' as source, '{{"attachment_id":"A' || cast(item_id as varchar) || '","part":"attachment"}}' as meta, trim(text) as content from benchmark where trim(text) <> '')
select doc_id, md5(rendered) as md5 from (select id as doc_id, {_HEAD} as rendered from (select * from c union all select * from a) union all select 'risk_card:' || kind, '[DOC_ID] risk_card:' || kind || chr(10) || '[DOC_TYPE] risk_card' || chr(10) || '[TITLE] ' || kind || ' card' || chr(10) || '[SOURCE] rules' || chr(10) || '[META] {{"risk_type":"' || kind || '"}}' || chr(10) || '[CONTENT]' || chr(10) || 'type: ' || kind || chr(10) || 'about: ' || chr(10) || 'words: ' || words || case when strong = '' then '' else chr(10) || 'strong: ' || strong end
 from (values """ + ", ".join(f"('{r.risk_type}', '{', '.join(r.keywords)}', '{', '.join(r.strong)}')" for r in RULES) + ") v(kind, words, strong))")
def pr27(spark, sf):
    k, none = F.col("doc_id"), F.lit("")
    name = F.concat(F.lit("C"), k.cast("string"))
    clauses = _docs(spark, sf).select(
        name.alias("clause_id"), F.when(k % 2 == 0, F.col("source")).otherwise(none).alias("section_title"), none.alias("section"), F.when(k % 3 == 0, none).otherwise(F.col("lang")).alias("title"),
        F.when(k % 5 == 0, none).otherwise(F.col("lang")).alias("clause_type"), F.lit("main_body").alias("part"), "text", "source",
    )
    extra = table(spark, sf, "benchmark").select(F.concat(F.lit("A"), F.col("item_id").cast("string")).alias("attachment_id"), none.alias("title"), F.lit(None).cast("string").alias("part"), "text")
    cards = spark.createDataFrame([(r.risk_type, None, list(r.keywords), list(r.strong)) for r in RULES], "risk_type string, description string, keywords array<string>, strong array<string>")
    made = N.clause_documents(clauses, F.col("source")).unionByName(N.attachment_documents(extra, F.lit("benchmark")))
    made = made.unionByName(N.card_documents(cards, {"risk_type": "type", "description": "about", "keywords": "words", "strong": "strong", "title": " card"}, F.lit("rules")))
    return made.select("doc_id", _md5(F.col("rendered")).alias("md5"))


@query("set2_retrieval_documents", "select split_part(id, ':', 1) as kind, count(*) as n from (select 'contract_clause:' as id from documents where trim(text) <> '' union all select 'contract_attachment:' from benchmark where trim(text) <> '' union all select 'risk_card:' from range(5)) group by 1")
def set2(spark, sf):
    return pr27(spark, sf).groupBy(F.split_part("doc_id", F.lit(":"), F.lit(1)).alias("kind")).agg(F.count("*").alias("n"))


@query("snk7_article_markdown", f"""select doc_id, md5('---' || chr(10) || 'doc_id: ' || cast(doc_id as varchar) || chr(10) || 'lang: ' || lang || chr(10) || '---' || n || '# ' || t || n || '![image](u' || cast(doc_id as varchar) || ')' || n || '---' || n || array_to_string(ls, chr(10) || chr(10) || '---' || chr(10) || chr(10)) || n || '---' || n || 'paragraphs: ' || cast(len(ls) as varchar)) as md5,
 '| ' || cast(doc_id as varchar) || ' | ' || case when length(t) > 30 then left(t, 30) || '...' else t end || ' | ![image](u' || cast(doc_id as varchar) || ') |' as index_line from (select s.*, d.lang, repeat(d.source, 3 + (d.doc_id % 10)::int) as t, chr(10) || chr(10) as n from {_STRIPPED} s join documents d using (doc_id))""")
def snk7(spark, sf):
    k = F.col("doc_id")
    rows = _docs(spark, sf).select("doc_id", "lang", F.repeat("source", (3 + k % 10).cast("int")).alias("title"), lines_of(F.col("text")).alias("paragraphs"), F.concat(F.lit("u"), k.cast("string")).alias("image_url"))
    return N.article_markdown(rows, ["doc_id", "lang"], "image", "paragraphs:").select("doc_id", _md5(F.col("markdown")).alias("md5"), "index_line")


# --- graph and store -----------------------------------------------------------------------------

_EDGES = "e as (select c_name as src, o_orderpriority as dst, count(*) as weight from orders join customer on o_custkey = c_custkey group by 1, 2)"


@query("dg1_mix", f"with {_EDGES} select 'local' as part, dst || '|' || src as item, weight::double as weight from e where dst = '1-URGENT' union all select * from (select 'global', src || '|' || dst, weight::double from e where contains(dst, 'LOW') or contains(src, '0007') order by weight desc, src, dst limit 25) union all select 'chunk', cast(item_id as varchar), length(text)::double from benchmark")
def dg1_mix(spark, sf):
    seeds = spark.createDataFrame([("1-URGENT",)], "name string")
    chunks = table(spark, sf, "benchmark").select(F.col("item_id").alias("item"), F.length("text").alias("weight"))
    return G.search_graph(_graph(spark, sf)[1], seeds, F.array(F.lit("LOW"), F.lit("0007")), 25, "mix", chunks)


@query("dg5_insert_graph", f"with {_EDGES}, o as (select * from e where dst <> '5-LOW'), n as (select * from e where dst in ('5-LOW', '1-URGENT')) select src, dst, sum(weight)::bigint as weight from (select * from o union all select * from n) group by all")
def dg5(spark, sf):
    nodes, edges, _ = _graph(spark, sf)
    return G.insert_graph(nodes.where("kind <> 'BUILDING'"), edges.where("dst <> '5-LOW'"), nodes.limit(0), edges.where("dst in ('5-LOW', '1-URGENT')"))[1]


@query("dg5_insert_nodes", f"with {_EDGES} select c_name as name, case when c_mktsegment <> 'BUILDING' then c_mktsegment end as kind from customer where c_mktsegment <> 'BUILDING' or c_name in (select src from e where dst in ('5-LOW', '1-URGENT')) union all select distinct dst, null from e where dst in ('5-LOW', '1-URGENT')")
def dg5_nodes(spark, sf):
    nodes, edges, _ = _graph(spark, sf)
    return G.insert_graph(nodes.where("kind <> 'BUILDING'"), edges, nodes.limit(0), edges.where("dst in ('5-LOW', '1-URGENT')"))[0].select("name", "kind")


@query("dg6_delete_entities", f"with {_EDGES} select src, dst, weight from e where dst <> '5-LOW' and src not in (select c_name from customer where c_mktsegment = 'BUILDING') and not (dst = '1-URGENT' and weight > 2)")
def dg6_entities(spark, sf):
    nodes, edges, _ = _graph(spark, sf)
    gone = nodes.where("kind = 'BUILDING'").select("name").unionByName(spark.createDataFrame([("5-LOW",)], "name string"))
    return G.delete_relations(G.delete_entities(nodes, edges, gone)[1], edges.where("dst = '1-URGENT' and weight > 2"))


_NAMED = "a as (select c_name as name, printf('Customer#%09d', c_custkey - 1) as target from customer where c_custkey % 2 = 1 and c_custkey > 1 and printf('Customer#%09d', c_custkey - 1) in (select c_name from customer))"


@query("dg7_merge_strategies", f"with {_NAMED}, m as (select coalesce(target, c_name) as name, c_mktsegment as k, target is not null as late, c_name as old from customer left join a on c_name = a.name) select name, arg_min(k, (late::int, old)) as kind, string_agg(k, '; ' order by late, old) as description from m group by name")
def dg7_strategies(spark, sf):
    return G.merge_entities(*_graph(spark, sf), strategies={"kind": "keep_first", "description": "concatenate"})[0]


@query("dg9_token_chunks", "with t as (select doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w from documents), s as (select doc_id, w, unnest(range(0, greatest(len(w) - 100 - 1, 0) + 1, 1100)) as b from t where len(w) > 0) select doc_id, b // 1100 as chunk_no, len(w[b + 1:b + 1200]) as n, md5(array_to_string(w[b + 1:b + 1200], ' ')) as md5 from s")
def dg9(spark, sf):
    words = F.filter(F.split("text", r"(?U)\s+", -1), lambda w: w != "")
    made = G.token_chunks(_docs(spark, sf), "doc_id", words)
    return made.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.size("tokens").cast("long").alias("n"), _md5(F.array_join("tokens", " ")).alias("md5"))


@query("dg10_cache", "select role as mode, cast(conv_id as varchar) as key, min(text) filter (where turn = t) as answer from (select *, max(turn) over (partition by role, conv_id) as t from conversations where role <> 'system') group by 1, 2")
def dg10(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("role").alias("mode"), F.col("conv_id").cast("string").alias("key"), F.col("text").alias("answer"), "turn")
    late = rows.groupBy("mode", "key").agg(F.max("turn").alias("turn")).join(rows, ["mode", "key", "turn"]).drop("turn")
    early = rows.groupBy("mode", "key").agg(F.min("turn").alias("turn")).join(rows, ["mode", "key", "turn"]).drop("turn")
    return B.cache_clear(B.cache_put(early.select("mode", "key", "answer"), late.select("mode", "key", "answer")), ["system"])


def _nearest(spark, sf, metric):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = R.vector_top_k(rows.where("id % 50 = 0"), rows, 10, metric)
    return found.select("query_id", "item_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def _sql_nearest(score: str) -> str:
    return f"with e as (select vec_id, embedding::double[] as v from embeddings), s as (select q.vec_id as query_id, c.vec_id as item_id, round({score}, 9) as s from e q, e c where q.vec_id % 50 = 0 and q.vec_id <> c.vec_id), r as (select *, row_number() over (partition by query_id order by s desc, item_id) as rank from s) select query_id, item_id, round(s, 4) as score, rank from r where rank <= 10"


@query("dg11_l2", _sql_nearest("-list_distance(q.v, c.v)"))
def dg11_l2(spark, sf):
    return _nearest(spark, sf, "l2")


@query("dg11_inner", _sql_nearest("list_dot_product(q.v, c.v)"))
def dg11_inner(spark, sf):
    return _nearest(spark, sf, "inner")


@query("dg11_index")
def dg11_index(spark, sf):
    # an index of every row; its recall is measured against the exact search in the tests
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = R.index_top_k(R.build_index(rows, 32), rows.where("id % 50 = 0"), 10, 20)
    return found.select("query_id", "item_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("dg11_quantized", _sql_nearest("coalesce(list_dot_product(q.v, c.v) / nullif(sqrt(list_dot_product(q.v, q.v) * list_dot_product(c.v, c.v)), 0), 0)"))
def dg11_quantized(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = Z.quantized_top_k(Z.build_quantized(rows, 32), rows.where("id % 50 = 0"), 10)
    return found.select("query_id", "item_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("dg13_unique_contexts", f"select doc_id, pos, text from (select doc_id, min(pos) as pos, left(text, 12) as text from {_CLAUSES} where trim(left(text, 12)) <> '' group by doc_id, left(text, 12))")
def dg13(spark, sf):
    rows = _clauses(spark, sf).select("doc_id", F.col("pos").cast("long").alias("pos"), F.left("text", F.lit(12)).alias("text"))
    return G.unique_contexts(rows, "doc_id", "pos", "text")


@query("dg14_insert_documents", "with s as (select cast(doc_id as varchar) as doc_id, text from documents where doc_id % 2 = 0), n as (select case when doc_id % 3 = 0 then 'doc-' || md5(text) else cast(doc_id as varchar) end as doc_id, text from documents) select doc_id, md5(text) as md5 from s union all select doc_id, md5(min(text)) from n where doc_id not in (select doc_id from s) group by doc_id")
def dg14(spark, sf):
    rows = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("doc_id"), "text", (F.col("doc_id") % 3).alias("k"))
    new = rows.select(F.when(F.col("k") != 0, F.col("doc_id")).alias("doc_id"), "text")
    return G.insert_documents(rows.where("cast(doc_id as bigint) % 2 = 0").select("doc_id", "text"), new).select("doc_id", _md5(F.col("text")).alias("md5"))


@query("st4_changed_sets", "with a as (select o_custkey as k, string_agg(o_orderpriority, '' order by o_orderpriority) as v from orders group by 1), b as (select o_custkey as k, string_agg(o_orderpriority, '' order by o_orderpriority) as v from orders where o_orderstatus <> 'P' group by 1) select k, md5(a.v) as fingerprint from a left join b using (k) where b.v is distinct from a.v")
def st4(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderpriority", "o_orderstatus")
    made = lambda rows: rows.groupBy("k").agg(B.fingerprint(F.col("o_orderpriority")).alias("fingerprint"))
    return B.changed_sets(made(orders), made(orders.where("o_orderstatus <> 'P'")), "k")


@query("st3_retries", "select o_custkey, n, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from orders), (select o_custkey as c, min(n) as m from (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from orders) where n <= 3 and o_orderstatus = 'F' group by 1) where c = o_custkey and n = m")
def st3(spark, sf):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    attempts = table(spark, sf, "orders").select("o_custkey", "o_orderkey", n.cast("long").alias("n"), (F.col("o_orderstatus") == "F").alias("ok"))
    return B.with_retries(attempts, "o_custkey", "n", "ok")[0].select("o_custkey", "n", "o_orderkey")
