"""Text expressions: whitespace, Markdown, titles, file names, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Spaces of any script: what ``trim`` takes off in SQL.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_whitespace(text: Column) -> Column:
    """Ideographic and no-break spaces and tabs as spaces, line ends as newlines; null as empty."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "　 \t", "   ")
    return F.regexp_replace(spaced, "\r\n?", "\n")


def squash(text: Column) -> Column:
    """Without any white space, as texts are matched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


def lines_of(text: Column) -> Column:
    """Stripped lines that are not blank, in order."""
    return F.filter(F.transform(F.split(text, "\n", -1), strip), lambda line: line != "")


def drop_page_numbers(lines: Column) -> Column:
    """Without lines of one to three digits."""
    return F.filter(lines, lambda line: ~line.rlike(r"(?U)^\d{1,3}$"))


def break_before(text: Column, patterns: list[str]) -> Column:
    """A newline before each match that has none, in the order of the patterns; blank lines go."""
    for pattern in patterns:
        text = F.regexp_replace(text, f"(?<!\n)({pattern})", "\n$1")
    return strip(F.regexp_replace(text, "\n{2,}", "\n"))


def strip_markdown(text: Column) -> Column:
    """Plain text of Markdown: no fences, images, link targets, heading, list or emphasis marks."""
    for pattern, new in (
        (r"(?s)```.*?```", ""),
        (r"!\[[^\]]*\]\([^)]*\)", ""),
        (r"\[([^\]]+)\]\([^)]*\)", "$1"),
        (r"(?m)^#{1,6} *", ""),
        (r"(?m)^ *[-*+] +", ""),
        (r"(?m)^ *[0-9]+\. +", ""),
        (r"[>*_`#]", ""),
        (r"\n{2,}", "\n"),
    ):
        text = F.regexp_replace(text, pattern, new)
    return F.trim(text)


def shorten(text: Column, size: int) -> Column:
    """One line of at most ``size`` characters, the last an ellipsis if some are cut."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(text, "(?m)^#+ *", ""), "[ \n\t]+", " "))
    return F.when(F.length(flat) > size, F.concat(F.left(flat, F.lit(size - 1)), F.lit("…"))).otherwise(flat)


def escape_html(text: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def html_paragraphs(text: Column, limit: int = 8) -> Column:
    """The first blocks of a text as escaped HTML paragraphs."""
    # a lambda of its own: a function of two arguments would get the line's number as the second, here the characters to trim
    parts = F.filter(F.transform(F.split(text, "\n", -1), lambda p: F.trim(p, F.lit(SPACES))), lambda p: p != "")
    return F.array_join(F.transform(F.slice(parts, 1, limit), lambda p: F.concat(F.lit("<p>"), escape_html(p), F.lit("</p>"))), "")


def title_of(text: Column, filename: Column) -> Column:
    """The first heading, else the file's stem without a number in front."""
    heading = F.trim(F.regexp_extract(text, r"(?m)^ *#+ *(.*)$", 1))
    stem = F.regexp_replace(F.regexp_replace(filename, r"\.[^.]*$", ""), r"^[0-9]+[_-]*", "")
    return F.when(heading != "", heading).otherwise(stem)


def safe_filename(title: Column, default: str = "untitled") -> Column:
    """Letters, digits, space, dash and underscore, at most fifty characters."""
    kept = F.left(F.rtrim(F.regexp_replace(title, r"[^\p{L}\p{N} _-]", "")), F.lit(50))
    return F.when(kept == "", F.lit(default)).otherwise(kept)


def alias_language(lang: Column, aliases: dict[str, str]) -> Column:
    """The name that a table gives to a language code, else the code itself."""
    pairs = [F.lit(x) for kv in aliases.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(lang)), lang)


def keyword_hits(text: Column, keywords: Column) -> Column:
    """The distinct keywords that a squashed text contains, in the order of the list."""
    return F.array_distinct(F.filter(keywords, lambda k: F.contains(text, k)))


def render_document(doc_id: Column, doc_type: Column, title: Column, source: Column, metadata: Column, content: Column) -> Column:
    """Tagged header lines, then the content."""
    head = [("DOC_ID", doc_id), ("DOC_TYPE", doc_type), ("TITLE", title), ("SOURCE", source), ("META", F.to_json(metadata))]
    return F.concat(F.concat_ws("\n", *[F.concat(F.lit(f"[{tag}] "), F.coalesce(value.cast("string"), F.lit(""))) for tag, value in head]), F.lit("\n[CONTENT]\n"), content)


def parse_document(rendered: Column) -> Column:
    """Struct of the fields of a rendered document; metadata that is no JSON is kept raw."""

    def tag(name: str) -> Column:
        return F.regexp_extract(rendered, rf"(?m)^\[{name}\] (.*)$", 1)

    meta = tag("META")
    parsed = F.when(F.try_parse_json(meta).isNotNull(), F.from_json(meta, "map<string,string>")).otherwise(F.create_map(F.lit("raw_meta"), meta))
    return F.struct(
        tag("DOC_ID").alias("doc_id"), tag("DOC_TYPE").alias("doc_type"), tag("TITLE").alias("title"), tag("SOURCE").alias("source"),
        parsed.alias("metadata"), F.regexp_extract(rendered, r"(?s)\[CONTENT\]\n(.*)$", 1).alias("content"),
    )


#: The attributes that may hold an image's address, in order, and what marks addresses of the wanted width.
IMAGE_ATTRIBUTES = ("src", "data-src", "data-hi-res-url")
WIDTH_MARKS = ("w=276", "&w=")


def absolute_url(url: Column, root: Column) -> Column:
    """An address with its scheme and host; null if it is none of http."""
    bare = F.trim(url)
    full = F.when(F.startswith(bare, F.lit("//")), F.concat(F.lit("https:"), bare)).when(F.startswith(bare, F.lit("/")), F.concat(root, bare)).otherwise(bare)
    return F.when(F.startswith(full, F.lit("http")), full)


def image_urls(html: Column, root: Column, classes: list[str] | None = None, marks: tuple[str, ...] = WIDTH_MARKS) -> Column:
    """The absolute addresses of a page's images in order; with ``classes`` those that have them all, or all images if none has.

    An image's address is the first attribute of ``IMAGE_ATTRIBUTES`` that is not empty; only addresses with one of the marks count (none: all).
    """
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<img\b[^>]*>"), 0)

    def value(tag: Column, name: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)), F.lit(""))

    if classes:
        listed = lambda tag: F.split(F.coalesce(value(tag, "class"), F.lit("")), r"\s+")
        wanted = F.filter(tags, lambda tag: F.size(F.array_except(F.array(*[F.lit(c) for c in classes]), listed(tag))) == 0)
        tags = F.when(F.size(wanted) > 0, wanted).otherwise(tags)
    urls = F.array_compact(F.transform(tags, lambda tag: absolute_url(F.coalesce(*[value(tag, a) for a in IMAGE_ATTRIBUTES]), root)))
    if not marks:
        return urls
    return F.filter(urls, lambda u: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(u, m)))
