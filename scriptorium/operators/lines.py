"""Operators on lines: header tests, and merging lines that an extraction broke apart.

Merging is a running count of the lines that begin a group, per document.  The
window holds the lines of one document, and no group spans documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


@dataclass(frozen=True)
class Layout:
    """How lines of one kind of document are told apart, as regular expressions."""

    section: str
    clause: str
    attachment: str
    subpoint: str
    labels: tuple[str, ...] = ()
    ends: tuple[str, ...] = (".",)


#: How Chinese contracts mark sections, clauses, attachments, points and fields.
CHINESE = Layout(
    section="^[一二三四五六七八九十]+、",
    clause="^第[一二三四五六七八九十百零\\d]+条",
    attachment="^附件\\d+",
    subpoint="^(?:[（(]?\\d{1,2}[）)\\.、]|[①②③④⑤⑥⑦⑧⑨⑩])",
    labels=("甲方（用人单位）", "乙方（劳动者）", "统一社会信用代码", "法定代表人", "注册地", "经营地", "联系电话", "居民身份证号码", "户籍地址", "经常居住地", "签订日期"),
    ends=("。", "；", "！", "？"),
)

#: The same for the Latin texts of the test tables.
LATIN = Layout(section="^(The|Le|Die|El) ", clause="^(Th|De|Un)[a-z]+ ", attachment="^[A-Z]+!!", subpoint="^[0-9]{1,2}[.)]", labels=("Licensed", "Released", "All rights"), ends=(".", "!", "?"))


def header_flags(line: Column, layout: Layout) -> dict[str, Column]:
    """Whether a stripped line is a section, clause, attachment or point header, or a field."""
    label = F.lit(False)
    for x in layout.labels:
        label = label | line.startswith(x)
    return {
        "is_section": line.rlike(f"(?U){layout.section}"), "is_clause": line.rlike(f"(?U){layout.clause}"),
        "is_attachment": line.rlike(f"(?U){layout.attachment}"), "is_subpoint": line.rlike(f"(?U){layout.subpoint}"), "is_label": label,
    }


def keep_separate(line: Column, layout: Layout) -> Column:
    """Blank lines, headers and fields are never merged."""
    kept = line == ""
    for flag in header_flags(line, layout).values():
        kept = kept | flag
    return kept


def explode_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line): stripped lines with their position from 0."""
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).withColumn("line", strip(F.col("line")))


def merge_groups(lines: DataFrame, key: str, begins: Column, separator: str = "") -> DataFrame:
    """(key, grp, line): lines joined from each one that begins a group up to the next."""
    w = Window.partitionBy(key).orderBy("pos")
    numbered = lines.withColumn("grp", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), separator)
    return numbered.groupBy(key, "grp").agg(F.min("pos").alias("pos"), joined.alias("line"))


def merge_short_lines(lines: DataFrame, key: str, size: int = 2) -> DataFrame:
    """Runs of lines of at most ``size`` characters become one; a blank line ends a run and goes."""
    w = Window.partitionBy(key).orderBy("pos")
    short = (F.length("line") <= size) & (F.col("line") != "")
    marked = lines.withColumn("short", short).withColumn("before", F.lag("short").over(w))
    begins = ~(F.col("short") & F.coalesce("before", F.lit(False)))
    # a blank line stands between two runs and joins neither
    return merge_groups(marked, key, begins).where("line <> ''")


def short_lines_merged(text: Column, size: int = 2) -> Column:
    """The lines of a text as ``merge_short_lines`` leaves them, in its row: no line is dealt out."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: strip(x))
    short = lambda x: (F.length(x) <= size) & (x != "")
    # each line with the one before; the last pair has no line, and goes
    pairs = F.arrays_zip(lines, F.concat(F.array(F.lit("")), lines))
    joined = F.transform(pairs, lambda p: F.when(short(p["0"]) & short(p["1"]), p["0"]).otherwise(F.concat(F.lit("\n"), p["0"])))
    return F.filter(F.split(F.array_join(joined, ""), "\n", -1), lambda x: x != "")


def merge_broken_sentences(lines: DataFrame, key: str, layout: Layout, fragments_only: bool = False, fragment: int = 3) -> DataFrame:
    """A line joins the one before unless either stands alone or that one ends a sentence.

    With ``fragments_only``, lines of more than ``fragment`` characters never join.
    """
    w = Window.partitionBy(key).orderBy("pos")
    ends = F.lit(False)
    for x in layout.ends:
        ends = ends | F.col("line").endswith(x)
    marked = lines.where("line <> ''").withColumn("apart", keep_separate(F.col("line"), layout)).withColumn("ends", ends)
    marked = marked.withColumn("apart_before", F.lag("apart").over(w)).withColumn("ends_before", F.lag("ends").over(w))
    begins = F.col("apart_before").isNull() | F.col("apart") | F.col("apart_before") | F.col("ends_before")
    if fragments_only:
        begins = begins | (F.length("line") > fragment)
    return merge_groups(marked, key, begins)


def join_lines(lines: DataFrame, key: str, separator: str = "\n") -> DataFrame:
    """(key, text): the lines of each key in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), separator)
    return lines.groupBy(key).agg(text.alias("text"))
