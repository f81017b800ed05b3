"""Markdown chunks as a table function of SQL: a text is cut and packed in one pass, in time linear in its length."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import arrow_udtf

FENCE, SPACE = re.compile(r"\s*```", re.ASCII), re.compile(r"\A[^\S\x1c-\x1f]+|[^\S\x1c-\x1f]+\Z")
#: A result batch ends at so many characters.
BATCH_CHARS = 4 << 20


def sections(text: str, level: int = 3) -> Iterator[tuple[int, str]]:
    """(section_no, text): cut before headings of at most ``level`` marks outside fenced code; blank sections go, their numbers stay."""
    heading, inside, number, lines = re.compile(f"#{{1,{level}}} "), False, 0, []
    for line in text.split("\n"):
        if FENCE.match(line):
            inside = not inside
        elif not inside and heading.match(line):
            yield number, SPACE.sub("", "\n".join(lines))
            number, lines = number + 1, []
        lines.append(line)
    yield number, SPACE.sub("", "\n".join(lines))


def blocks(text: str) -> Iterator[str]:
    """Fenced code whole, table rows together, paragraphs at blank lines."""
    lines: list[str] = []
    inside = table = False
    for line in text.split("\n"):
        mark, row = FENCE.match(line), line.count("|") >= 2
        ends = inside and mark
        if not inside and (mark or not line.strip(" ") or row != table):
            if lines:
                yield "\n".join(lines)
            lines = []
        if inside or mark or line.strip(" "):
            lines.append(line)
        if ends:
            yield "\n".join(lines)
            lines = []
        inside, table = bool(inside != bool(mark)), not inside and not mark and row and bool(line.strip(" "))
    if lines:
        yield "\n".join(lines)


def protected(block: str) -> bool:
    """Fenced code, or a table with a separator row: nothing but dashes, colons, bars and space, a bar after a dash."""
    lines = block.split("\n")
    return block.lstrip(" ").startswith("```") or len(lines) >= 2 and any("-" in x and x.rfind("|") > x.find("-") and not x.strip("-:| \t\x0b\f\r") for x in lines)


def packed(text: str, size: int, overlap: int) -> Iterator[str]:
    """Chunks of whole blocks of up to ``size`` characters; the next one begins with the last ``overlap`` of a full one."""
    held: list[str] = []
    n = 0
    for block in blocks(text):
        alone = len(block) > size and protected(block)
        if alone or n + len(block) + 2 > size:
            whole = "\n\n".join(held)
            if held:
                yield whole
            held = [whole[-overlap:]] if held and overlap and not alone else []
            n = sum(map(len, held))
        if alone:
            yield block
            n = 0
        else:
            held.append(block)
            n += len(block) + 2
    if held:
        yield "\n\n".join(held)


def chunks(text: str, size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """(section_no, chunk_no, chunk): sections that fit stay whole, others are packed from blocks."""
    for number, section in sections(text):
        if section:
            for i, chunk in enumerate([section] if len(section) <= size else packed(section, size, overlap)):
                yield number, i, chunk


def register_chunks(spark: SparkSession, name: str = "markdown_chunks", key_type: str = "bigint", size: int = 1000, overlap: int = 100) -> None:
    """Make ``name(TABLE(select key, text ...))`` a table function of SQL: (key, section_no, chunk_no, chunk).

    Each row is a whole text, so rows stay where they are and nothing is shuffled.  Lines end at line feeds; null and blank texts give no rows; repeated
    keys give their rows each.
    """

    @arrow_udtf(returnType=f"key {key_type}, section_no bigint, chunk_no int, chunk string")
    class MarkdownChunks:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            keys, texts = rows.column(0), rows.column(1)
            at, found, chars = [], [], 0

            def made() -> pa.Table:
                section, number, chunk = zip(*found, strict=True)
                return pa.table([keys.take(pa.array(at)), pa.array(section, pa.int64()), pa.array(number, pa.int32()), pa.array(chunk, pa.string())], ["key", "section_no", "chunk_no", "chunk"])

            for i in range(rows.num_rows):
                for one in chunks(texts[i].as_py() or "", size, overlap):
                    at.append(i)
                    found.append(one)
                    chars += len(one[2])
                    if chars >= BATCH_CHARS:
                        yield made()
                        at, found, chars = [], [], 0
            if found:
                yield made()

    spark.udtf.register(name, MarkdownChunks)


def chunk_rows(docs: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """The table function applied to a table, with its key's own name: (key, section_no, chunk_no, chunk)."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    register_chunks(spark, "__markdown_chunks", kind, size, overlap)
    found = spark.sql("select * from __markdown_chunks(table({rows}))", rows=docs.select(key, text))
    return found.withColumnRenamed("key", key)
