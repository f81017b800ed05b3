"""Rendered texts: blocks of pages, prompts, articles with front matter, documents for retrieval; and reading answers back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import render_document


def render_blocks(blocks: Column, clause_marker: str, attachment_head: str, attachment: str) -> Column:
    """The text of a page from its array of blocks (block_type, text), in order.

    Titles and attachments stand between blank lines, an attachment without its head gets the word, a clause
    marker in a clause begins a line, and more than one blank line becomes one.
    """

    def lines(b: Column) -> Column:
        text = F.trim(b["text"])
        apart = F.concat(F.lit("\n"), text, F.lit("\n"))
        named = F.when(text.rlike(f"^(?:{attachment_head})"), text).otherwise(F.concat(F.lit(attachment + " "), text))
        return (
            F.when(b["block_type"] == "section_title", apart)
            .when(b["block_type"] == "clause", F.regexp_replace(text, f"(?<!\n)({clause_marker})", "\n$1"))
            .when(b["block_type"] == "attachment", F.concat(F.lit("\n"), named, F.lit("\n")))
            .otherwise(text)
        )

    return F.btrim(F.regexp_replace(F.array_join(F.transform(blocks, lines), "\n"), "\n{3,}", "\n\n"), F.lit(" \n\t\r"))


def response_text(response: Column) -> Column:
    """The text of a chat answer (JSON): its content if that is a string, else its parts' texts by lines; no answer: empty."""
    content = F.get_json_object(response, "$.choices[0].message.content")
    parts = F.from_json(content, "array<struct<text:string>>")
    listed = F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t != ""), "\n")
    return F.btrim(F.coalesce(F.when(F.startswith(content, F.lit("[")), listed), content, F.lit("")), F.lit(" \n\t\r"))


#: The keys under which a result may hold its contexts, in order of priority, for one text and for a list.
TEXT_KEYS = ("context", "contexts", "source", "sources", "references")
LIST_KEYS = ("contexts", "context", "sources", "source", "references")


def _by_key(result: Column, keys: tuple[str, ...], from_list: Callable[[Column], Column], from_text: Callable[[Column], Column]) -> Column:
    """The value of the first key that has one, else of a ``result`` that is a text; a bare list is a list."""

    def read(value: Column) -> Column:
        listed = F.from_json(value, "array<string>")
        return F.when(value.isin("", "[]"), None).when(F.startswith(value, F.lit("[")) & listed.isNotNull(), from_list(listed)).otherwise(from_text(value))

    found = [read(F.get_json_object(result, f"$.{key}")) for key in keys]
    bare = F.when(F.startswith(F.ltrim(result), F.lit("[")), from_list(F.from_json(result, "array<string>")))
    return F.coalesce(bare, *found, from_text(F.nullif(F.get_json_object(result, "$.result"), F.lit(""))))


def _paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n", -1), lambda p: F.btrim(p, F.lit(" \n\t\r"))), lambda p: p != "")


def context_text(result: Column) -> Column:
    """One text of the contexts of a result (JSON); null if it has none."""
    return _by_key(result, TEXT_KEYS, lambda x: F.array_join(x, "\n\n"), lambda t: t)


def context_list(result: Column) -> Column:
    """The contexts of a result (JSON), a text cut at blank lines; null if it has none."""
    return _by_key(result, LIST_KEYS, lambda x: F.filter(x, lambda v: F.trim(v) != ""), _paragraphs)


def answer_prompt(question: Column, context: Column, instructions: str) -> Column:
    """Instructions, context and question."""
    return F.concat(F.lit(f"{instructions}\n\nContext:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def item_section(item: Column, number: Column, labels: dict[str, str], missing_notes: str, missing_bases: str, limit: int = 4) -> Column:
    """One risk item as Markdown: heading, fields, notes and at most ``limit`` bases.

    ``labels``: the heading under ``item`` and the name of each field of the item that is shown.
    """
    bases = F.transform(F.slice(F.coalesce(item["bases"], F.array().cast("array<struct<kb_name:string,title:string,content:string>>")), 1, limit), lambda b: F.concat(F.lit("- ["), b["kb_name"], F.lit("] "), b["title"], F.lit("\n  "), b["content"]))
    heading = F.concat(F.lit(f"### {labels['item']} "), number.cast("string"))
    fields = [F.concat(F.lit(f"- {label}: "), F.coalesce(item[name].cast("string"), F.lit(""))) for name, label in labels.items() if name not in ("item", "notes", "bases")]
    notes = F.concat(F.lit(f"- {labels['notes']}: "), F.coalesce(F.nullif(F.array_join(item["notes"], ", "), F.lit("")), F.lit(missing_notes)))
    basis = F.concat(F.lit(f"- {labels['bases']}:\n"), F.when(F.size(bases) > 0, F.array_join(bases, "\n")).otherwise(missing_bases))
    return F.concat_ws("\n", heading, *fields, notes, basis)


def report_prompt(source: Column, summary: Column, items: Column, labels: dict[str, str], instructions: str, missing_notes: str, missing_bases: str) -> Column:
    """Instructions, the facts that must stay as they are, and one section per risk item (an array of structs)."""
    sections = F.array_join(F.transform(items, lambda x, i: item_section(x, i + 1, labels, missing_notes, missing_bases)), "\n\n")
    ids = F.filter(F.transform(items, lambda x: F.trim(F.coalesce(x["item_id"].cast("string"), F.lit("")))), lambda x: x != "")
    facts = F.concat_ws("\n", F.concat(F.lit("items: "), F.size(items).cast("string")), F.concat(F.lit("ids: "), F.when(F.size(ids) > 0, F.array_join(ids, ", ")).otherwise("none")))
    return F.concat_ws("\n", F.lit(instructions), facts, F.concat(F.lit("source: "), source), F.concat(F.lit("summary: "), F.to_json(summary)), F.lit(""), sections)


def clause_documents(clauses: DataFrame, source: Column, kind: str = "contract_clause", unnamed: str = "clause") -> DataFrame:
    """(doc_id, rendered) of clauses (clause_id, section_title, section, title, clause_type, part, text) with a text."""
    part = lambda name: F.nullif(F.col(name), F.lit(""))
    title = F.coalesce(part("title"), part("clause_id"), F.lit(unnamed))
    meta = F.struct("clause_id", F.coalesce(part("clause_type"), F.lit("unsorted")).alias("clause_type"), F.coalesce("part", F.lit("main_body")).alias("part"))
    doc_id = F.concat(F.lit(kind + ":"), F.coalesce("clause_id", F.lit("")))
    content = F.concat_ws("\n", part("section_title"), part("section"), F.trim("text"))
    rows = clauses.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return rows.select(doc_id.alias("doc_id"), render_document(doc_id, F.lit(kind), F.concat_ws(" ", part("section_title"), part("section"), title), source, meta, content).alias("rendered"))


def attachment_documents(attachments: DataFrame, source: Column, kind: str = "contract_attachment", doc_type: str = "contract_clause", unnamed: str = "attachment") -> DataFrame:
    """(doc_id, rendered) of attachments (attachment_id, title, part, text) with a text."""
    doc_id = F.concat(F.lit(kind + ":"), F.coalesce("attachment_id", F.lit("")))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("attachment_id"), F.lit("")), F.lit(unnamed))
    meta = F.struct("attachment_id", F.coalesce("part", F.lit("attachment")).alias("part"))
    rows = attachments.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return rows.select(doc_id.alias("doc_id"), render_document(doc_id, F.lit(doc_type), title, source, meta, F.trim("text")).alias("rendered"))


def card_documents(rules: DataFrame, labels: dict[str, str], source: Column, separator: str = ", ") -> DataFrame:
    """(doc_id, rendered) of rule cards (risk_type, description, keywords, strong): a line for each list that is not empty."""
    line = lambda name, value: F.concat(F.lit(f"{labels[name]}: "), value)
    listed = [F.when(F.size(name) > 0, line(name, F.array_join(name, separator))) for name in ("keywords", "strong")]
    doc_id = F.concat(F.lit("risk_card:"), "risk_type")
    content = F.concat_ws("\n", line("risk_type", F.col("risk_type")), line("description", F.coalesce("description", F.lit(""))), *listed)
    return rules.select(doc_id.alias("doc_id"), render_document(doc_id, F.lit("risk_card"), F.concat("risk_type", F.lit(labels["title"])), source, F.struct("risk_type"), content).alias("rendered"))


def article_markdown(rows: DataFrame, fields: list[str], caption: str, closing: str) -> DataFrame:
    """``rows`` (title, paragraphs, image_url and ``fields``) with ``markdown`` (front matter, heading, image, paragraphs) and ``index_line``."""
    front = F.concat_ws("\n", F.lit("---"), *[F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields], F.lit("---"))
    body = F.array_join("paragraphs", "\n\n---\n\n")
    head = F.concat(F.lit("# "), "title", F.lit(f"\n\n![{caption}]("), "image_url", F.lit(")"))
    text = F.concat_ws("\n\n", front, head, F.lit("---"), body, F.lit("---"), F.concat(F.lit(closing + " "), F.size("paragraphs").cast("string")))
    short = F.when(F.length("title") > 30, F.concat(F.left("title", F.lit(30)), F.lit("..."))).otherwise(F.col("title"))
    line = F.concat_ws(" | ", F.concat(F.lit("| "), F.col(fields[0]).cast("string")), short, F.concat(F.lit(f"![{caption}]("), "image_url", F.lit(") |")))
    return rows.withColumn("markdown", text).withColumn("index_line", line)
