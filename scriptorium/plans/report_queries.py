"""Queries of the display and intake operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import display as D
from ..operators import graph as G
from ..operators import rules as U
from ..operators import segments as S
from ..tables import table
from .registry import query
from .rule_packs import RULES
from .rule_queries import _CLAUSES, _RISKS, _clauses, _graph
from .text_queries import blocks_sql


def _docs(spark, sf):
    return table(spark, sf, "documents")


@query("pr12_attachment_type", "select doc_id, case when contains(source, '1') or contains(t, 'hation') then 'renewal' when contains(source, '2') or contains(t, 'keit') then 'change' else 'attachment' end as kind from (select doc_id, source, regexp_replace(text, '\\s+', '', 'g') as t from documents)")
def pr12(spark, sf):
    phrases = {"1": "renewal", "hation": "renewal", "2": "change", "keit": "change"}
    text = F.regexp_replace("text", "[12]", "")  # the digits are looked for in titles only
    return _docs(spark, sf).select("doc_id", D.attachment_type(F.col("source"), text, phrases, "attachment").alias("kind"))


@query("pr14_noise", f"select doc_id, count(*) filter (where contains(text, 'keit') or (length(trim(text)) <= 20 and not contains(text, '.')) or starts_with(trim(text), '#')) as n_noise, count(*) as n from {_CLAUSES} group by doc_id")
def pr14(spark, sf):
    return _clauses(spark, sf).groupBy("doc_id").agg(F.count_if(D.is_noise(F.lit(""), F.col("text"), ["keit"])).alias("n_noise"), F.count("*").alias("n"))


@query("pr16_title_from_content", f"select doc_id, case when doc_id % 3 = 0 then trim(text) else left(trim(text), 80) end as title from {_CLAUSES} where pos = 0")
def pr16(spark, sf):
    docs = _docs(spark, sf).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\n## "), F.regexp_replace("text", r"^\s+", ""))).otherwise(F.col("text"))
    return docs.select("doc_id", D.title_from_content(marked, F.lit("untitled")).alias("title"))


_STATUS = "(select doc_id, lang, case when doc_id % 5 = 0 then 'missing' when doc_id % 2 = 1 then 'partial' when lang = 'en' and contains(text, 'hation') then 'weak' else 'given' end as status from documents)"


def _statuses(spark, sf):
    status = D.basis_status(F.col("doc_id") % 5, F.col("doc_id") % 2 == 0, F.coalesce("lang", F.lit("")), F.col("text"), {"en": ["hation"]})
    return _docs(spark, sf).select("doc_id", "lang", status.alias("status"))


@query("pr17_basis_status", f"select doc_id, status from {_STATUS}")
def pr17(spark, sf):
    return _statuses(spark, sf).select("doc_id", "status")


@query("pr18_display_level", f"select doc_id, case when status = 'missing' then 'high' when lang = 'fr' then 'low' when lang = 'en' then case when status = 'weak' then 'high' else 'medium' end when lang = 'de' then case when status = 'partial' then 'low' else 'medium' end when doc_id % 7 = 0 then 'high' else 'medium' end as level from {_STATUS}")
def pr18(spark, sf):
    severity = F.when(F.col("doc_id") % 7 == 0, "critical").otherwise("warning")
    return _statuses(spark, sf).select("doc_id", D.display_level(F.col("status"), F.col("lang"), severity, ["fr"], ["en"], ["de"]).alias("level"))


@query("pr24_valid_uploads", "select doc_id from documents where lang in ('en', 'fr') and n_chars <= 2000")
def pr24(spark, sf):
    name = F.concat("source", F.lit(".v1."), F.upper("lang"))
    return _docs(spark, sf).where(D.valid_upload(name, F.col("n_chars"), [".en", ".fr"], 2000)).select("doc_id")


@query("pr26_points", "select s_name as name, case when s_suppkey % 3 > 0 then 'a' || s_name when s_suppkey % 2 = 1 then 'd' || cast(s_nationkey as varchar) else 'unknown' end as address, s_suppkey / 4.0::double as lon, s_suppkey / 8.0::double as lat, case when s_suppkey % 5 = 0 then 0 else s_suppkey end as distance, case when s_suppkey % 4 > 0 then 't' || s_name end as tel from supplier where s_suppkey % 7 > 0")
def pr26(spark, sf):
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(
        F.col("s_name").alias("name"),
        F.when(k % 3 > 0, F.concat(F.lit("a"), "s_name")).otherwise("").alias("address"),
        F.when(k % 2 == 1, F.concat(F.lit("d"), F.col("s_nationkey").cast("string"))).otherwise("").alias("district"),
        F.when(k % 7 > 0, F.concat_ws(",", (k / 4).cast("string"), (k / 8).cast("string"))).otherwise("none").alias("location"),
        F.when(k % 5 == 0, "n/a").otherwise(F.concat(k.cast("string"), F.lit(".4"))).alias("distance"),
        F.when(k % 4 > 0, F.concat(F.lit("t"), "s_name")).otherwise("").alias("tel"),
    )
    return D.normalize_points(rows)


@query("agg8_contents", "select path, '- [' || case when doc_id % 4 = 0 then 'Title ' || cast(doc_id as varchar) else path end || '](' || path || ')' as line from (select doc_id, source || '-' || cast(doc_id as varchar) || '.md' as path from documents where doc_id % 2 = 0)")
def agg8(spark, sf):
    k = F.col("doc_id")
    text = F.when(k % 4 == 0, F.concat(F.lit("intro\n# Title "), k.cast("string"), F.lit("\n"), F.regexp_replace("text", "#", ""))).otherwise(F.regexp_replace("text", "#", ""))
    path = F.concat(F.col("source"), F.lit("-"), k.cast("string"), F.when(k % 2 == 0, ".md").otherwise(".txt"))
    return D.contents_lines(_docs(spark, sf).select(path.alias("path"), text.alias("text")))


@query("agg12_executive_summary", f"""{_RISKS}, n as (select doc_id, count(*) as n, count(*) filter (where pos % 3 = 0) as missing, count(*) filter (where confidence < 8) as weak, string_agg(distinct risk_type, ', ' order by risk_type) as types from risks where risk_level <> 'none' group by doc_id)
select doc_id, cast(n as varchar) || ' clauses show a risk: ' || types || '. ' || case when missing > 0 then cast(missing as varchar) || ' have no basis and need a review.' else 'All have a basis.' end || case when weak > 0 then ' ' || cast(weak as varchar) || ' rest on a weak basis.' else '' end as summary from n""")
def agg12(spark, sf):
    risks = U.identify_risks(_clauses(spark, sf), RULES).where("risk_level <> 'none'")
    n = risks.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("pos") % 3 == 0).alias("missing"), F.count_if(F.col("confidence") < 8).alias("weak"), F.array_join(F.sort_array(F.collect_set("risk_type")), ", ").alias("types")
    )
    return n.select("doc_id", D.executive_summary(F.col("n"), F.col("types"), F.col("missing"), F.col("weak")).alias("summary"))


@query("tk2_key_only", f"""{_RISKS}, k as (select doc_id, pos, risk_type, lv, row_number() over (partition by doc_id, pos order by rn) as risk_no from kept where lv = 3 or (lv = 2 and (st > 0 or kw >= 3 or conf >= 8)))
select c.doc_id, c.pos, coalesce(risk_no, 1) as risk_no, coalesce(risk_type, 'no risk') as risk_type, coalesce(lv, 0) >= 2 as needs_attention from {_CLAUSES} c left join k using (doc_id, pos)""")
def tk2(spark, sf):
    found = U.identify_risks(_clauses(spark, sf), RULES, key_only=True)
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("risk_no").cast("long").alias("risk_no"), "risk_type", "needs_attention")


@query("tk8_latest", "select source, path, n_chars from (select source, lang || '/' || cast(doc_id as varchar) as path, n_chars, row_number() over (partition by source order by n_chars desc, lang || '/' || cast(doc_id as varchar) desc) as n from documents) where n = 1")
def tk8(spark, sf):
    return D.latest(_docs(spark, sf).select("source", "n_chars", F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("path")), "source", "n_chars", "path")


@query("tk11_matching_or_first", "select conv_id, turn from (select conv_id, turn, contains(text, 'you') as m, bool_or(contains(text, 'you')) over (partition by conv_id) as a, row_number() over (partition by conv_id order by contains(text, 'you') desc, turn) as n from conversations) where n <= 2 and (m or not a)")
def tk11(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return D.matching_or_first(rows, "conv_id", F.contains(F.col("text"), F.lit("you")), ["turn"], 2).select("conv_id", "turn")


@query("set3_union_stores", "select 'benchmark' as store, text as content from benchmark union all select 'system', text from conversations where role = 'system' union all select 'archive', 'nothing found'")
def set3(spark, sf):
    turns = table(spark, sf, "conversations").withColumnRenamed("text", "content")
    stores = {"benchmark": table(spark, sf, "benchmark").withColumnRenamed("text", "content"), "system": turns.where("role = 'system'"), "archive": turns.where("role = 'archive'")}
    return D.union_stores(stores, "nothing found")


@query("jn9_new_rows", "select o_custkey, min(o_orderkey) as o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING') group by o_custkey")
def jn9(spark, sf):
    known = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return D.new_rows(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), known, "o_custkey", ["o_orderkey"])


@query("rt9_allowed_references", "select doc_id, case when lang in ('en', 'de') then lang else '' end as kept, case when lang in ('en', 'de') then 'high' else 'medium' end as level from documents")
def rt9(spark, sf):
    allowed = F.array(F.lit("en"), F.lit("de"))
    made = D.allowed_references(F.array("lang", "source"), allowed, F.lit("high"), {"high": "medium", "medium": "low"})
    return _docs(spark, sf).select("doc_id", made.alias("m")).select("doc_id", F.array_join("m.kept", ",").alias("kept"), F.col("m.level").alias("level"))


@query("dg4_rename_edges", "select case when c_custkey % 2 = 1 then upper(c_name) else c_name end as src, case when o_orderpriority = '1-URGENT' then 'URGENT' else o_orderpriority end as dst, count(*) as weight from orders join customer on o_custkey = c_custkey group by 1, 2")
def dg4(spark, sf):
    nodes, edges, _ = _graph(spark, sf)
    names = table(spark, sf, "customer").where("c_custkey % 2 = 1").select(F.col("c_name").alias("name"), F.upper("c_name").alias("new_name"))
    names = names.unionByName(spark.createDataFrame([("1-URGENT", "URGENT")], "name string, new_name string"))
    return D.rename_entities(nodes, edges, names)[1].select("src", "dst", "weight")


_EDITED = "e as (select c_name as src, o_orderpriority as dst, count(*) as weight from orders join customer on o_custkey = c_custkey group by 1, 2)"


@query("dg4_edit_graph", f"with {_EDITED} select src, dst, case when dst = '1-URGENT' and src like '%3' then weight + 10 else weight end as weight, case when c_custkey % 3 = 0 then 'EDITED' else c_mktsegment end as kind, case when c_custkey % 6 = 0 then 'new' else c_mktsegment end as description from e join customer on src = c_name")
def dg4_edit(spark, sf):
    nodes, edges, _ = _graph(spark, sf)
    k = F.col("c_custkey")
    changes = table(spark, sf, "customer").where(k % 3 == 0).select(F.col("c_name").alias("name"), F.lit("EDITED").alias("kind"), F.when(k % 6 == 0, "new").alias("description"))
    weights = edges.where("dst = '1-URGENT' and src like '%3'").select("src", "dst", (F.col("weight") + 10).alias("weight"))
    made = G.edit_rows(edges, weights, ["src", "dst"])[0].join(G.edit_rows(nodes, changes, ["name"])[0].withColumnRenamed("name", "src"), "src")
    return made.select("src", "dst", "weight", "kind", "description")


@query("ch2_blocks", f"select doc_id, len({blocks_sql('text')}) as n_blocks from documents")
def ch2(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(S.markdown_blocks(F.col("text"))).cast("long").alias("n_blocks"))


@query("ch2_blocks_all", f"select doc_id, len(b) as n_blocks, md5(array_to_string(b, chr(31))) as md5 from (select doc_id, {blocks_sql("coalesce(text, '')")} as b from documents)")
def ch2_all(spark, sf):
    blocks = S.markdown_blocks(F.coalesce("text", F.lit("")))
    return _docs(spark, sf).select("doc_id", F.size(blocks).cast("long").alias("n_blocks"), F.md5(F.array_join(blocks, "\x1f").cast("binary")).alias("md5"))
