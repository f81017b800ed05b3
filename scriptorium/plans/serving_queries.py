"""Queries of the serving, bookkeeping and event operators over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import serving as S
from ..sources import files
from ..staging import shared_dir
from ..streaming import incremental as I
from ..streaming import joins as J
from ..tables import table
from .registry import query


@query("jn5_nested_children", "select n_nationkey, n_name, count(s_suppkey) as n_children, coalesce(string_agg(cast(s_suppkey as varchar), ',' order by s_suppkey), '') as ids from nation left join supplier on s_nationkey = n_nationkey group by 1, 2")
def jn5(spark, sf):
    parents = table(spark, sf, "nation").select("n_nationkey", "n_name")
    children = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    nested = S.nest(parents, children, "n_nationkey", ["s_suppkey"], "suppliers")
    ids = F.array_join(F.transform("suppliers", lambda x: x["s_suppkey"].cast("string")), ",")
    return nested.select("n_nationkey", "n_name", F.size("suppliers").cast("long").alias("n_children"), ids.alias("ids"))


@query("jn6_delete_owned", "select o_orderkey from orders where not (o_orderstatus = 'P' and o_custkey % 2 = 0)")
def jn6(spark, sf):
    # requests by even customers are their own, those of odd ones name another owner
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    requests = rows.where("o_orderstatus = 'P'").select("o_orderkey", (F.col("o_custkey") + F.col("o_custkey") % 2).alias("o_custkey"))
    return S.delete_owned(rows, requests, "o_orderkey", "o_custkey").select("o_orderkey")


@query("jn7_skip_seen", "select doc_id from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def jn7(spark, sf):
    return S.skip_seen(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("jn10_changed_files", "select source || '/' || cast(doc_id as varchar) as path, n_chars as mtime from documents where lang = 'fr' or doc_id % 3 = 2")
def jn10(spark, sf):
    after = table(spark, sf, "documents").select("lang", "doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("mtime"))
    before = after.where("lang <> 'fr'").select("path", (F.col("mtime") - F.col("doc_id") % 3 + 1).alias("mtime"))
    return S.changed_files(before, after.select("path", "mtime")).select("path", "mtime")


@query("agg9_fingerprint", "select user_id, md5(string_agg(cast(event_id as varchar), '' order by cast(event_id as varchar))) as fingerprint from events group by user_id")
def agg9(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(S.fingerprint(F.col("event_id").cast("string")).alias("fingerprint"))


@query("jn11_round_robin", "select page_id, n_name from (select page_id, (row_number() over (order by page_id) - 1) % 25 as j from pages) join (select n_name, row_number() over (order by n_nationkey) - 1 as j from nation) using (j)")
def jn11(spark, sf):
    images = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return S.round_robin(table(spark, sf, "pages").select("page_id"), ["page_id"], images, ["n_nationkey"], images.count()).select("page_id", "n_name")


@query("snk5_update", "select c_custkey, coalesce(m, c_acctbal) as c_acctbal from customer left join (select o_custkey, max(o_totalprice) as m from orders group by o_custkey) on o_custkey = c_custkey")
def snk5(spark, sf):
    changes = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return S.upsert_value(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), changes, "c_custkey", "c_acctbal")


@query("snk5_keyed_store", """with d as (select doc_id, coalesce(lang, 'none') as kb_name, coalesce(text, '') as text from documents),
u as (select doc_id, kb_name, 'changed ' || doc_id as text from d where doc_id % 97 = 0 union all select doc_id + 10000000, kb_name, text from d where doc_id % 101 = 0),
s as (select * from d where (doc_id, kb_name) not in (select (doc_id, kb_name) from u) union all select * from u) select kb_name, count(*) as n, sum(doc_id)::bigint as ids, sum(length(text))::bigint as chars from s where kb_name <> 'fr' group by kb_name""")
def snk5_keyed_store(spark, sf):
    """A store by workspace and key range is written, changed where it must be, rid of one workspace, and read."""
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/store-{uuid.uuid4().hex}"
    rows = table(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("kb_name"), F.coalesce("text", F.lit("")).alias("text"))
    files.write_keyed(rows, path, "doc_id", width=500)
    changed = rows.where("doc_id % 97 = 0").withColumn("text", F.concat(F.lit("changed "), "doc_id"))
    added = rows.where("doc_id % 101 = 0").withColumn("doc_id", F.col("doc_id") + 10_000_000)
    files.update_keyed(changed.unionByName(added), path, "doc_id", width=500)
    files.delete_workspace(spark, path, "fr")
    return files.read_keyed(spark, path).groupBy("kb_name").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"), F.sum(F.length("text")).alias("chars"))


@query("st5_log_levels", "select cast(ts as date) as day, case when value > 50 then 'ERROR' else 'INFO' end as level, count(*) as n from events group by 1, 2")
def st5(spark, sf):
    level = F.when(F.col("value") > 50, "ERROR").otherwise("INFO")
    lines = table(spark, sf, "events").select(F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] ["), level, F.lit("] "), "event_type").alias("value"))
    return I.parse_log(lines).groupBy(F.to_date("ts").alias("day"), "level").agg(F.count("*").alias("n"))


@query("st_tumbling_counts", "select date_trunc('day', ts)::timestamp as window_start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def st_tumbling(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return I.tumbling_counts(events).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("st_sessions", """with a as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minutes then 0 else 1 end as first from events),
b as (select user_id, ts, sum(first) over (partition by user_id order by ts) as s from a) select user_id, min(ts) as session_start, max(ts) + interval 30 minutes as session_end, count(*) as n from b group by user_id, s""")
def st_sessions(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = I.sessions(events)
    return found.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("st5_interval_join", "select p.event_id as event, c.event_id as cause from events p join events c on p.user_id = c.user_id and c.ts <= p.ts and c.ts >= p.ts - interval 2 hour where p.event_type = 'purchase' and c.event_type = 'click'")
def st5_interval(spark, sf):
    events = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    side = lambda kind, at, name: events.where(F.col("event_type") == kind).select("user_id", F.col("at").alias(at), F.col("event_id").alias(name))
    return J.interval_join(side("purchase", "at", "event"), side("click", "cause_at", "cause"), "user_id", "at", "cause_at", 7200).select("event", "cause")


@query("st5_sliding_counts", "select cast(epoch(w) as bigint) as window_start, event_type, count(*) as n from (select event_type, unnest(generate_series(date_trunc('hour', ts) - interval 5 hour, date_trunc('hour', ts), interval 1 hour)) as w from events) group by 1, 2")
def st5_sliding(spark, sf):
    events = table(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("at"))
    return J.sliding_counts(events, "at", "6 hours", "1 hour", "event_type").select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n")
