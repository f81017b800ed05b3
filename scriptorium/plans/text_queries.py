"""Queries of the text, line and segment operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk_table as C
from ..operators import extract as X
from ..operators import lines as L
from ..operators import segments as S
from ..sources.files import first_source, split_pages
from ..tables import table
from .registry import query


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _md5(x) -> F.Column:
    return F.md5(x.cast("binary"))


@query("tx1_whitespace", "select doc_id, md5(replace(replace(replace(replace(replace(replace(replace(text, ' the ', chr(12288) || 'the' || chr(160)), '. ', '.' || chr(13) || chr(10)), chr(12288), ' '), chr(160), ' '), chr(9), ' '), chr(13) || chr(10), chr(10)), chr(13), chr(10))) as norm_md5 from documents")
def tx1(spark, sf):
    noisy = F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit("　the ")), F.lit(". "), F.lit(".\r\n"))
    return _docs(spark, sf).select("doc_id", _md5(T.normalize_whitespace(noisy)).alias("norm_md5"))


_LINES = "(select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents)"


@query("tx2_page_numbers", "select doc_id, count(*) filter (where not regexp_full_match(w, '[0-9]{1,3}')) as n_kept, count(*) as n_all from (select doc_id, unnest(string_split(replace(text, ' ', chr(10)) || chr(10) || cast(doc_id as varchar), chr(10))) as w from documents) where trim(w) <> '' group by doc_id")
def tx2(spark, sf):
    words = T.lines_of(F.concat(F.replace(F.col("text"), F.lit(" "), F.lit("\n")), F.lit("\n"), F.col("doc_id").cast("string")))
    return _docs(spark, sf).select("doc_id", F.size(T.drop_page_numbers(words)).cast("long").alias("n_kept"), F.size(words).cast("long").alias("n_all"))


_WORDS = "(select doc_id, trim(unnest(string_split(replace(text, ' ', chr(10)), chr(10)))) as l, generate_subscripts(string_split(replace(text, ' ', chr(10)), chr(10)), 1) - 1 as pos from documents)"


@query("tx3_merge_short", f"""with s as (select *, l <> '' and length(l) <= 2 as short from {_WORDS}), b as (select *, coalesce(lag(short) over (partition by doc_id order by pos), false) as before from s),
g as (select *, sum(case when short and before then 0 else 1 end) over (partition by doc_id order by pos) as grp from b),
m as (select doc_id, grp, string_agg(l, '' order by pos) as line from g group by doc_id, grp) select doc_id, count(*) as n_lines, md5(string_agg(line, chr(10) order by grp)) as md5 from m where line <> '' group by doc_id""")
def tx3(spark, sf):
    merged = L.short_lines_merged(F.replace(F.col("text"), F.lit(" "), F.lit("\n")))
    return _docs(spark, sf).select("doc_id", merged.alias("ls")).where("size(ls) > 0").select("doc_id", F.size("ls").cast("long").alias("n_lines"), _md5(F.array_join("ls", "\n")).alias("md5"))


_FLAGS = "regexp_matches(l, '^(The|Le|Die|El) ') as s, regexp_matches(l, '^(Th|De|Un)[a-z]+ ') as c, regexp_matches(l, '^[A-Z]+!!') as a, regexp_matches(l, '^[0-9]{1,2}[.)]') as p, (starts_with(l, 'Licensed') or starts_with(l, 'Released') or starts_with(l, 'All rights')) as f"
_TRIMMED = "(select doc_id, pos, regexp_replace(l, '^\\s+|\\s+$', '', 'g') as l from " + _LINES + ")"


@query("tx4_headers", f"select doc_id, count(*) filter (where s) as n_section, count(*) filter (where c) as n_clause, count(*) filter (where a) as n_attachment, count(*) filter (where p) as n_subpoint from (select *, {_FLAGS} from {_TRIMMED}) group by doc_id")
def tx4(spark, sf):
    flags = L.header_flags(F.col("line"), L.LATIN)
    lines = L.explode_lines(_docs(spark, sf), "doc_id", "text")
    return lines.groupBy("doc_id").agg(*[F.count_if(flags[f"is_{k}"]).alias(f"n_{k}") for k in ("section", "clause", "attachment", "subpoint")])


@query("tx5_keep_separate", f"select doc_id, count(*) filter (where l = '' or s or c or a or p or f) as n_separate from (select *, {_FLAGS} from {_TRIMMED}) group by doc_id")
def tx5(spark, sf):
    lines = L.explode_lines(_docs(spark, sf), "doc_id", "text")
    return lines.groupBy("doc_id").agg(F.count_if(L.keep_separate(F.col("line"), L.LATIN)).alias("n_separate"))


def _merge_sql(more: str) -> str:
    return f"""with x as (select *, {_FLAGS} from {_TRIMMED} where l <> ''), k as (select *, s or c or a or p or f as apart, (ends_with(l, '.') or ends_with(l, '!') or ends_with(l, '?')) as ends from x),
b as (select *, lag(apart) over w as ab, lag(ends) over w as eb from k window w as (partition by doc_id order by pos)), g as (select *, sum(case when ab is null or apart or ab or eb {more} then 1 else 0 end) over (partition by doc_id order by pos) as grp from b),
m as (select doc_id, grp, string_agg(l, '' order by pos) as line from g group by doc_id, grp) select doc_id, count(*) as n_lines, md5(string_agg(line, chr(10) order by grp)) as md5 from m group by doc_id"""


def _merged(lines: DataFrame) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), _md5(text).alias("md5"))


@query("tx6_merge_sentences", _merge_sql(""))
def tx6(spark, sf):
    return _merged(L.merge_broken_sentences(L.explode_lines(_docs(spark, sf), "doc_id", "text"), "doc_id", L.LATIN))


@query("tx6_merge_fragments", _merge_sql("or length(l) > 3"))
def tx6b(spark, sf):
    return _merged(L.merge_broken_sentences(L.explode_lines(_docs(spark, sf), "doc_id", "text"), "doc_id", L.LATIN, fragments_only=True))


@query("tx7_break_before", "select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '([^\\n])(Th[a-z]{6,}\\.)', '\\1' || chr(10) || '\\2', 'g'), '\\n{2,}', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) as md5 from documents")
def tx7(spark, sf):
    return _docs(spark, sf).select("doc_id", _md5(T.break_before(F.col("text"), ["Th[a-z]{6,}\\."])).alias("md5"))


@query("tx8_clean_page", f"select doc_id, count(*) as n_lines, md5(string_agg(l, chr(10) order by pos)) as md5 from {_TRIMMED} where l <> '' and not regexp_full_match(l, '[0-9]{{1,3}}') group by doc_id")
def tx8(spark, sf):
    lines = T.drop_page_numbers(T.lines_of(T.normalize_whitespace(F.col("text"))))
    return _docs(spark, sf).select("doc_id", F.size(lines).cast("long").alias("n_lines"), _md5(F.array_join(lines, "\n")).alias("md5")).where("n_lines > 0")


@query("tx10_merge_pages", "select conv_id, count(*) as n_pages, md5(string_agg(trim(regexp_replace(text, ' {2,}', ' ', 'g')), chr(10) order by turn) filter (where trim(text) <> '')) as md5 from conversations group by conv_id")
def tx10(spark, sf):
    # one conversation is one document whose turns are pages
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace("text", " {2,}", " ")).alias("t"))
    pages = F.filter(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda p: p["t"] != "")
    made = rows.groupBy("conv_id").agg(F.count("*").alias("n_pages"), F.array_join(F.transform(pages, lambda p: p["t"]), "\n").alias("t"))
    return made.select("conv_id", "n_pages", _md5(F.col("t")).alias("md5"))


@query("tx11_squash", "select doc_id, length(regexp_replace(text, '\\s+', '', 'g')) as n_chars, md5(regexp_replace(text, '\\s+', '', 'g')) as md5 from documents")
def tx11(spark, sf):
    t = T.squash(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.length(t).cast("long").alias("n_chars"), _md5(t).alias("md5"))


def _markdown() -> F.Column:
    return F.concat(F.lit("# "), F.regexp_replace(F.col("text"), "\\. ", ".\n\n- [x](http://e/y) *b* "), F.lit("\n```\ncode\n```\n1. end"))


_MARKDOWN = "'# ' || regexp_replace(text, '\\. ', '.' || chr(10) || chr(10) || '- [x](http://e/y) *b* ', 'g') || chr(10) || '```' || chr(10) || 'code' || chr(10) || '```' || chr(10) || '1. end'"


@query("tx12_strip_markdown", f"select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_MARKDOWN}, '(?s)```.*?```', '', 'g'), '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g'), '(?m)^#{{1,6}} *', '', 'g'), '(?m)^ *[-*+] +', '', 'g'), '(?m)^ *[0-9]+\\. +', '', 'g'), '[>*_`#]', '', 'g'), '\\n{{2,}}', chr(10), 'g'))) as md5 from documents")
def tx12(spark, sf):
    return _docs(spark, sf).select("doc_id", _md5(T.strip_markdown(_markdown())).alias("md5"))


@query("tx13_shorten", "select doc_id, case when length(t) > 80 then left(t, 79) || '…' else t end as preview from (select doc_id, trim(regexp_replace(regexp_replace(text, '(?m)^#+ *', '', 'g'), '[ \\n\\t]+', ' ', 'g')) as t from documents)")
def tx13(spark, sf):
    return _docs(spark, sf).select("doc_id", T.shorten(F.col("text"), 80).alias("preview"))


@query("tx14_html_paragraphs", """select doc_id, md5(coalesce(array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:8], lambda x: '<p>' || replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</p>'), ''), '')) as md5 from documents""")
def tx14(spark, sf):
    return _docs(spark, sf).select("doc_id", _md5(T.html_paragraphs(F.col("text"))).alias("md5"))


@query("tx15_title", "select doc_id, case when doc_id % 2 = 0 then trim(string_split(text, chr(10))[1]) else 'note-' || source end as title from (select * from documents where trim(string_split(text, chr(10))[1]) <> '' or doc_id % 2 = 1)")
def tx15(spark, sf):
    rows = _docs(spark, sf).where("trim(split(text, '\n')[0]) <> '' or doc_id % 2 = 1")
    plain = F.regexp_replace(F.col("text"), "(?m)^#", "")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("## "), plain)).otherwise(F.lit("plain"))
    return rows.select("doc_id", T.title_of(text, F.concat(F.lit("0012_note-"), F.col("source"), F.lit(".md"))).alias("title"))


@query("tx16_safe_filename", "select doc_id, case when n = '' then 'untitled' else n end as filename from (select doc_id, left(rtrim(regexp_replace(string_split(text, chr(10))[1], '[^\\p{L}\\p{N} _-]', '', 'g')), 50) as n from documents)")
def tx16(spark, sf):
    return _docs(spark, sf).select("doc_id", T.safe_filename(F.element_at(F.split("text", "\n"), 1)).alias("filename"))


@query("tx17_page_markers", "select conv_id, md5(string_agg('--- page ' || cast(turn as varchar) || ' ---' || chr(10) || text, chr(10) order by turn)) as md5 from conversations group by conv_id")
def tx17(spark, sf):
    page = F.concat(F.lit("--- page "), F.col("turn").cast("string"), F.lit(" ---\n"), F.col("text"))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", page.alias("p")))), lambda x: x["p"]), "\n").alias("t"))
    return rows.select("conv_id", _md5(F.col("t")).alias("md5"))


@query("tx18_tail", "select doc_id, md5(right(text, 2000)) as md5 from documents")
def tx18(spark, sf):
    return _docs(spark, sf).select("doc_id", _md5(F.right("text", F.lit(2000))).alias("md5"))


@query("tx19_language_alias", "select lang_name, count(*) as n from (select case lang when 'en' then 'english' when 'fr' then 'french' else lang end as lang_name from documents) group by lang_name")
def tx19(spark, sf):
    return _docs(spark, sf).groupBy(T.alias_language(F.col("lang"), {"en": "english", "fr": "french"}).alias("lang_name")).agg(F.count("*").alias("n"))


@query("tx20_codec", "select doc_id, cast(doc_id as varchar) as parsed_id, string_split(text, chr(10))[1] as title, source, lang as meta_lang, md5(text) as content_md5 from documents")
def tx20(spark, sf):
    title = F.element_at(F.split("text", "\n"), 1)
    rendered = T.render_document(F.col("doc_id"), F.lit("document"), title, F.col("source"), F.create_map(F.lit("lang"), F.col("lang")), F.col("text"))
    p = T.parse_document(rendered)
    return _docs(spark, sf).withColumn("p", p).select("doc_id", F.col("p.doc_id").alias("parsed_id"), F.col("p.title").alias("title"), F.col("p.source").alias("source"), F.try_element_at("p.metadata", F.lit("lang")).alias("meta_lang"), _md5(F.col("p.content")).alias("content_md5"))


# --- segments ------------------------------------------------------------------------------------


@query("seg1_body", "select doc_id, length(regexp_replace(case when instr(text, 'that') > 0 then substr(text, instr(text, 'that')) else text end, '^\\s+|\\s+$', '', 'g')) as n from documents")
def seg1(spark, sf):
    return _docs(spark, sf).select("doc_id", F.length(S.body_from(F.col("text"), "that")).cast("long").alias("n"))


@query("seg2_attachments", "select doc_id, length(regexp_replace(case when i > 0 then substr(text, 1, i - 1) else text end, '^\\s+|\\s+$', '', 'g')) as n_main, case when i > 0 then length(regexp_replace(substr(text, i), '^\\s+|\\s+$', '', 'g')) else 0 end as n_attachments from (select doc_id, text, case when regexp_matches(text, '\\nTh') then instr(text, chr(10) || 'Th') else 0 end as i from documents)")
def seg2(spark, sf):
    rows = _docs(spark, sf).select("doc_id", S.split_at_attachment(F.col("text"), "^Th").alias("p"))
    return rows.select("doc_id", F.length("p.main").cast("long").alias("n_main"), F.length("p.attachments").cast("long").alias("n_attachments"))


@query("seg4_nearest_section", f"""with x as (select doc_id, pos, l, regexp_matches(l, '^(The|Le|Die|El) ') as s from {_TRIMMED}),
y as (select doc_id, pos, s, last_value(case when s then l end ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) as section_title from x)
select doc_id, pos, section_title from y where not s""")
def seg4(spark, sf):
    lines = L.explode_lines(_docs(spark, sf), "doc_id", "text")
    is_section = L.header_flags(F.col("line"), L.LATIN)["is_section"]
    marks = lines.where(is_section).withColumnRenamed("line", "section_title")
    rows = S.nearest_before(marks, lines.where(~is_section).select("doc_id", "pos"), "doc_id", "pos", "section_title")
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "section_title")


@query("seg7_clauses", """with p as (select doc_id, unnest(string_split(regexp_replace(text, '(Th[a-z]+)', chr(1) || '\\1', 'g'), chr(1))) as t, generate_subscripts(string_split(regexp_replace(text, '(Th[a-z]+)', chr(1) || '\\1', 'g'), chr(1)), 1) as i from documents),
c as (select *, row_number() over (partition by doc_id order by i) as pos from p where regexp_matches(t, '^Th[a-z]+')),
d as (select doc_id, pos, regexp_extract(t, '^(Th[a-z]+)', 1) as section, regexp_replace(t, '^\\s+|\\s+$', '', 'g') as b from c),
e as (select *, regexp_replace(string_split(regexp_replace(substr(b, length(section) + 1), '^\\s+|\\s+$', '', 'g'), chr(10))[1], '\\s+', '', 'g') as first from d)
select doc_id, pos, 'C' || cast(pos as varchar) as clause_id, section, case when length(first) <= 1 then section || ' clause' else left(first, 18) end as title, md5(b) as md5 from e""")
def seg7(spark, sf):
    rows = S.split_clauses(_docs(spark, sf), "doc_id", "text", "Th[a-z]+")
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "clause_id", "section", "title", _md5(F.col("text")).alias("md5"))


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _pieces(text: str, marker: str) -> str:
    """SQL: the stripped pieces that are not blank of a text cut before each marker."""
    return f"list_filter(list_transform(string_split(regexp_replace({text}, '({marker})', chr(1) || '\\1', 'g'), chr(1)), lambda x: {_STRIP.format('x')}), lambda x: x <> '')"


def weak_sql(docs: str, section: str, soft: list[str], point: str) -> str:
    """SQL of ``split_weakly`` over rows (doc_id, text)."""
    words = "|".join([section, *soft])
    return f"""(with w as (select doc_id, {_STRIP.format('text')} as t from {docs}),
a as (select doc_id, t, list_filter({_pieces('t', section)}, lambda x: regexp_matches(x, '^{section}')) as m from w),
b as (select doc_id, unnest(case when len(m) >= 2 then m else [t] end) as t, generate_subscripts(case when len(m) >= 2 then m else [t] end, 1) as a from a),
c as (select doc_id, t, a, {_pieces('t', words)} as m from b where t <> ''),
d as (select doc_id, a, unnest(case when length(t) >= 1200 and len(m) > 1 then m else [t] end) as t, generate_subscripts(case when length(t) >= 1200 and len(m) > 1 then m else [t] end, 1) as b from c),
e as (select *, {_pieces('t', chr(92) + 'n' + point)} as m from d),
f as (select *, case when length(t) >= 250 and len(list_filter(m, lambda x: regexp_matches(x, '^{point}'))) >= 2 then list_filter(m, lambda x: length(x) >= 12) else [t] end as k from e),
g as (select doc_id, a, b, unnest(k) as text, generate_subscripts(k, 1) as c from f)
select doc_id, row_number() over (partition by doc_id order by a, b, c) as pos, text from g)"""


@query("seg8_weak_clauses", f"select doc_id, pos, 'C' || cast(pos as varchar) as clause_id, md5(text) as md5 from {weak_sql('documents', 'Th[a-z]+[.]', ['hation ', 'ement '], '[0-9]{1,2}[.)]')}")
def seg8(spark, sf):
    rows = S.split_weakly(_docs(spark, sf), "doc_id", "text", "Th[a-z]+\\.[^\n]*", ["hation ", "ement "], "[0-9]{1,2}[.)]")
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "clause_id", _md5(F.col("text")).alias("md5"))


def titles_sql(text: str, section: str, clause: str) -> str:
    """SQL of ``strip_section_titles``."""
    lines = f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '')"
    led = f"(case when coalesce(regexp_matches(({lines})[1], '{section}') and regexp_matches(({lines})[2], '{clause}'), false) then ({lines})[2:] else {lines} end)"
    return f"array_to_string(case when coalesce(regexp_matches({led}[-1], '{section}'), false) then {led}[1:len({led}) - 1] else {led} end, chr(10))"


def _cut_sql(text: str, marker: str, rows: str) -> str:
    """SQL: (doc_id, at, place, part) of the pieces that begin with the marker, with the characters before them."""
    parts = f"string_split(regexp_replace({text}, '({marker})', chr(1) || '\\1', 'g'), chr(1))"
    return f"""(select doc_id, i as at, coalesce(list_sum(list_transform(ps[1:i - 1], lambda x: length(x))), 0) as place, ps[i] as part from (select doc_id, {parts} as ps, unnest(range(1, len({parts}) + 1)) as i from {rows}) where regexp_matches(ps[i], '^{marker}'))"""


_FIRST = "regexp_replace(string_split(" + _STRIP.format("substr(b, length(mark) + 1)") + ", chr(10))[1], '\\s+', '', 'g')"


@query("seg11_contract", f"""with x as (select doc_id, {_STRIP.format("case when instr(text, 'Th') > 0 then substr(text, instr(text, 'Th')) else text end")} as t from documents),
y as (select doc_id, case when instr(t, chr(10) || 'Released') > 0 then {_STRIP.format("left(t, instr(t, chr(10) || 'Released') - 1)")} else {_STRIP.format('t')} end as main, case when instr(t, chr(10) || 'Released') > 0 then {_STRIP.format("substr(t, instr(t, chr(10) || 'Released') + 1)")} else '' end as extra from x),
s as (select doc_id, place, regexp_extract(part, '^([A-Z][a-z]+ the [^\n]*)', 1) as section_title from {_cut_sql('main', '[A-Z][a-z]+ the ', 'y')}),
c as (select doc_id, place, regexp_extract(part, '^(Th[a-z]+)', 1) as mark, {titles_sql('part', '^[A-Z][a-z]+ the ', '^Th[a-z]+')} as b, row_number() over (partition by doc_id order by place) as pos from {_cut_sql('main', 'Th[a-z]+', 'y')}),
n as (select c.doc_id, c.pos, arg_max(section_title, s.place) as section_title from c left join s on s.doc_id = c.doc_id and s.place < c.place group by 1, 2),
p as (select doc_id, list_filter(string_split(regexp_replace(extra, '(Released)', chr(1) || '\\1', 'g'), chr(1)), lambda x: starts_with(x, 'Released')) as ps, extra from y),
q as (select doc_id, len(ps) > 0 as marked, unnest(case when len(ps) > 0 then ps else [extra] end) as t, generate_subscripts(case when len(ps) > 0 then ps else [extra] end, 1) as pos from p)
select doc_id, 'main_body' as part, pos, 'C' || cast(pos as varchar) as item_id, case when pos = 1 then coalesce(section_title, 'The beginning') else section_title end as section_title, case when length({_FIRST}) <= 1 then mark || ' clause' else left({_FIRST}, 18) end as title, md5(b) as md5 from c join n using (doc_id, pos)
union all select doc_id, 'attachment', pos, 'A' || cast(pos as varchar), null, case when marked then array_to_string((list_filter(list_transform(string_split(t, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> ''))[1:2], ' ') else 'attachment' end, md5({_STRIP.format('t')}) from q where trim(t, ' ' || chr(10) || chr(9)) <> ''""")
def seg11(spark, sf):
    layout = L.Layout(section="^[A-Z][a-z]+ the ", clause="", attachment="^Released", subpoint="")
    rows = S.split_contract(_docs(spark, sf), "doc_id", "text", layout, "Th", "Th[a-z]+", "The beginning")
    return rows.select("doc_id", "part", F.col("pos").cast("long").alias("pos"), "item_id", "section_title", "title", _md5(F.col("text")).alias("md5"))


def _headed() -> F.Column:
    return F.regexp_replace(F.col("text"), "(?m)^(Th[a-z]*) ", "## $1 ")


@query("ch1_sections", """with x as (select doc_id, unnest(string_split(regexp_replace(text, '(?m)^(Th[a-z]*) ', '## \\1 ', 'g'), chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
g as (select *, sum(case when regexp_matches(l, '^#{1,3} ') then 1 else 0 end) over (partition by doc_id order by pos) as section_no from x),
m as (select doc_id, section_no, regexp_replace(string_agg(l, chr(10) order by pos), '^\\s+|\\s+$', '', 'g') as t from g group by doc_id, section_no) select doc_id, section_no, md5(t) as md5 from m where t <> ''""")
def ch1(spark, sf):
    rows = S.markdown_sections(_docs(spark, sf).withColumn("text", _headed()), "doc_id", "text")
    return rows.select("doc_id", F.col("section_no").cast("long").alias("section_no"), _md5(F.col("text")).alias("md5"))


@query("src16_chapters", """with p as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\\n(Th[a-z]*) ', chr(10) || chr(1) || '# \\1 ', 'g'), chr(10) || chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as ps from documents)
select doc_id, unnest(range(1, len(ps) + 1)) as chapter_no, md5(unnest(ps)) as md5 from p""")
def src16(spark, sf):
    rows = _docs(spark, sf).withColumn("text", F.regexp_replace("text", "\n(Th[a-z]*) ", "\n# $1 "))
    return S.split_chapters(rows, "doc_id", "text").select("doc_id", F.col("chapter_no").cast("long").alias("chapter_no"), _md5(F.col("text")).alias("md5"))


def blocks_sql(text: str) -> str:
    """SQL of ``markdown_blocks``: a fold over the lines."""
    start = "{'done': []::varchar[], 'cur': '', 'fence': false, 'tab': false}"
    lines = f"list_transform(string_split({text}, chr(10)), lambda l: {{'done': []::varchar[], 'cur': l, 'fence': false, 'tab': false}})"
    mark, row = "regexp_matches(x.cur, '^\\s*```')", "(length(x.cur) - length(replace(x.cur, '|', '')) >= 2)"
    grown = "(case when s.cur = '' then x.cur else s.cur || chr(10) || x.cur end)"
    flushed, closed = "(case when s.cur = '' then s.done else list_append(s.done, s.cur) end)", f"list_append(s.done, {grown})"
    state = lambda done, cur, fence, tab: f"{{'done': {done}, 'cur': {cur}, 'fence': {fence}, 'tab': {tab}}}"
    step = (
        f"case when s.fence and {mark} then {state(closed, chr(39) * 2, 'false', 'false')} when s.fence then {state('s.done', grown, 'true', 'false')} when {mark} then {state(flushed, 'x.cur', 'true', 'false')} "
        f"when trim(x.cur, ' ') = '' then {state(flushed, chr(39) * 2, 'false', 'false')} when {row} <> s.tab then {state(flushed, 'x.cur', 'false', row)} else {state('s.done', grown, 'false', row)} end"
    )
    return f"list_transform([list_reduce(list_prepend({start}, {lines}), lambda s, x: {step})], lambda r: case when r.cur = '' then r.done else list_append(r.done, r.cur) end)[1]"


def pack_sql(blocks: str, size: int, overlap: int) -> str:
    """SQL of ``pack_blocks``: a fold over the blocks."""
    entry = lambda block: f"{{'done': []::varchar[], 'buf': []::varchar[], 'n': 0::bigint, 'b': {block}}}"
    text = "array_to_string(s.buf, chr(10) || chr(10))"
    closed = f"(case when len(s.buf) > 0 then list_append(s.done, {text}) else s.done end)"
    seed = f"(case when len(s.buf) > 0 then [right({text}, {overlap})] else []::varchar[] end)"
    state = lambda done, buf, n: f"{{'done': {done}, 'buf': {buf}, 'n': ({n})::bigint, 'b': ''}}"
    table = "(len(string_split(x.b, chr(10))) >= 2 and len(list_filter(string_split(x.b, chr(10)), lambda q: regexp_matches(q, '^\\s*\\|?[\\s:|-]*-[\\s:|-]*\\|[\\s:|-]*$'))) > 0)"
    step = (
        f"case when (starts_with(ltrim(x.b), '```') or {table}) and length(x.b) > {size} then {state(f'list_append({closed}, x.b)', '[]::varchar[]', '0')} "
        f"when s.n + length(x.b) + 2 > {size} then {state(closed, f'list_append({seed}, x.b)', f'case when len(s.buf) > 0 then length(right({text}, {overlap})) else 0 end + length(x.b) + 2')} else {state('s.done', 'list_append(s.buf, x.b)', 's.n + length(x.b) + 2')} end"
    )
    return f"list_transform([list_reduce(list_prepend({entry(chr(39) * 2)}, list_transform({blocks}, lambda b: {entry('b')})), lambda s, x: {step})], lambda r: case when len(r.buf) > 0 then list_append(r.done, array_to_string(r.buf, chr(10) || chr(10))) else r.done end)[1]"


_CHUNKS = f"""with l as (select doc_id, unnest(string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10))) as l, generate_subscripts(string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10)), 1) as i from documents),
f as (select *, sum(case when regexp_matches(l, '^\\s*```') then 1 else 0 end) over (partition by doc_id order by i) % 2 as inside from l),
h as (select *, sum(case when regexp_matches(l, '^#{{1,3}} ') and inside = 0 then 1 else 0 end) over (partition by doc_id order by i) as section_no from f),
s as (select doc_id, section_no, {_STRIP.format("string_agg(l, chr(10) order by i)")} as text from h group by all),
c as (select doc_id, section_no, case when length(text) <= 1000 then [text] else {pack_sql(blocks_sql('text'), 1000, 100)} end as cs from s where text <> ''),
u as (select doc_id, section_no, unnest(cs) as c, generate_subscripts(cs, 1) - 1 as chunk_no from c)
select doc_id, section_no::bigint as section_no, chunk_no, length(c) as n_chars, md5(c) as md5 from u"""


@query("ch5_chunks", _CHUNKS)
def ch5(spark, sf):
    text = F.regexp_replace(F.col("text"), "\\. ", ".\n\n")
    rows = S.chunk_markdown(_docs(spark, sf).withColumn("text", text), "doc_id", "text")
    return rows.select("doc_id", "section_no", "chunk_no", F.length("chunk").alias("n_chars"), _md5(F.col("chunk")).alias("md5"))


@query("ch4_table_function", _CHUNKS)
def ch4_sql(spark, sf):
    # the function is called from SQL
    C.register_chunks(spark)
    docs = _docs(spark, sf).select("doc_id", F.regexp_replace(F.col("text"), "\\. ", ".\n\n").alias("text"))
    return spark.sql("select key as doc_id, section_no, chunk_no, length(chunk) as n_chars, md5(chunk) as md5 from markdown_chunks(table({docs}))", docs=docs)


@query("src1_first_source", "select doc_id, case when doc_id % 3 = 0 then 'image' when doc_id % 3 = 1 then 'native' else 'local' end as parser_used, doc_id % 3 as n_warnings, md5(text) as md5 from documents where trim(text) <> ''")
def src1(spark, sf):
    # the first parser misses two thirds of the documents and the second a half of the rest
    r = F.col("doc_id") % 3
    found = first_source([("image", F.when(r == 0, F.col("text"))), ("native", F.when(r <= 1, F.col("text")).otherwise(" ")), ("local", F.col("text"))])
    rows = _docs(spark, sf).where("trim(text) <> ''").withColumn("s", found)
    return rows.select("doc_id", F.col("s.parser_used").alias("parser_used"), F.size("s.warnings").cast("long").alias("n_warnings"), _md5(F.col("s.text")).alias("md5"))


@query("src5_pages", "select doc_id, cast(pos + 1 as bigint) as page_no, md5(l) as md5 from (select doc_id, l, row_number() over (partition by doc_id order by pos) - 1 as pos from (select doc_id, pos, trim(l) as l from " + _LINES + ") where l <> '')")
def src5(spark, sf):
    # every line end is a page marker
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\nPage 7\n"))
    rows = split_pages(_docs(spark, sf).withColumn("text", text), "doc_id", "text")
    return rows.select("doc_id", F.col("page_no").cast("long").alias("page_no"), _md5(F.col("text")).alias("md5"))


@query("sc1_json_repair", "select doc_id, source as title, case when doc_id % 3 = 2 then true else false end as broken from documents")
def sc1(spark, sf):
    body = F.to_json(F.struct(F.col("source").alias("title")))
    raw = F.when(F.col("doc_id") % 3 == 0, body).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), body, F.lit(" done")))
    read = X.json_of(raw)
    return _docs(spark, sf).select("doc_id", F.try_variant_get(read["value"], "$.title", "string").alias("title"), read["broken"].alias("broken"))


@query("sc2_blocks", f"select doc_id, count(*) filter (where t = 'section_title') as n_title, count(*) filter (where t = 'clause') as n_clause, count(*) filter (where t = 'other') as n_other from (select doc_id, case when regexp_matches(l, '^The ') then 'section_title' when regexp_matches(l, '^Th') then 'clause' else 'other' end as t from {_TRIMMED} where l <> '') group by doc_id")
def sc2(spark, sf):
    blocks = F.transform(T.lines_of(F.col("text")), lambda x: F.struct(F.when(x.rlike("^The "), "section_title").when(x.rlike("^Th"), "clause").otherwise("strange").alias("kind"), x.alias("text")))
    valid = X.valid_blocks(blocks, ["section_title", "clause", "attachment", "other"])
    n = lambda k: F.size(F.filter("v", lambda b: b["kind"] == k)).cast("long")
    return _docs(spark, sf).select("doc_id", valid.alias("v")).where("v is not null").select("doc_id", n("section_title").alias("n_title"), n("clause").alias("n_clause"), n("other").alias("n_other"))


@query("sc5_json_lines", "select conv_id, turn, role, length(text) as n from conversations where text not like '{%'")
def sc5(spark, sf):
    rows = table(spark, sf, "conversations")
    line = F.to_json(F.struct("role", F.length("text").alias("n"), "turn"))
    packed = rows.groupBy("conv_id").agg(F.array_join(F.concat(F.array(F.lit("```json"), F.lit("{bad")), F.array_sort(F.collect_list(line)), F.array(F.lit("```"))), "\n").alias("t"))
    return X.json_lines(packed, ["conv_id"], "t", "turn bigint, role string, n bigint")


@query("sc20_articles", "select page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) as title, cast(list_aggregate(list_transform(list_filter(regexp_extract_all(html, '<p>([^<]*)', 1), lambda p: length(p) > 20), lambda p: length(p)), 'sum') as bigint) as n_chars, len(list_filter(regexp_extract_all(html, '<p>([^<]*)', 1), lambda p: length(p) > 20)) as n_paragraphs from pages")
def sc20(spark, sf):
    paragraphs = F.filter(F.regexp_extract_all("html", F.lit("<p>([^<]*)"), 1), lambda p: F.length(p) > 20)
    total = F.aggregate(paragraphs, F.lit(0).cast("long"), lambda a, p: a + F.length(p))
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("title"), F.when(F.size(paragraphs) > 0, total).alias("n_chars"), F.size(paragraphs).cast("long").alias("n_paragraphs"))


@query("src12_articles", """select page_id, trim(replace(replace(replace(replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) as title from pages where regexp_matches(html, '<h1>[^<]*</h1>')""")
def src12(spark, sf):
    # titles against SQL; paragraphs and the ways to find them against expected texts in the tests
    return X.articles(table(spark, sf, "pages"), "page_id", "html", ("h1", None), ("article", None)).where("title not like 'untitled!_%' escape '!'").select("page_id", "title")


@query("src13_links", "select page_id, count(*) as n_links, count(distinct u) as n_distinct from (select page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as u from pages) group by page_id")
def src13(spark, sf):
    links = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("u"))
    return links.groupBy("page_id").agg(F.count("*").alias("n_links"), F.countDistinct("u").alias("n_distinct"))


@query("pr25_urls", "select page_id, case when starts_with(u, '//') then 'https:' || u when starts_with(u, '/') then regexp_extract(url, '^(https?://[^/?#]+)', 1) || u else u end as full_url from (select page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as u from pages) where starts_with(u, '/') or starts_with(u, 'http')")
def pr25(spark, sf):
    links = table(spark, sf, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("u"))
    return links.select("page_id", X.full_address(F.col("url"), F.col("u")).alias("full_url")).where("full_url is not null")
