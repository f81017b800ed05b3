"""Display and intake: statuses and levels of report rows, titles, summaries, validation, selections with a fallback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines_of, squash
from .retrieval import heading_only
from .skew import join_spread


def attachment_type(title: Column, text: Column, phrases: dict[str, str], default: str) -> Column:
    """The type of the first phrase that the title or the text contains, white space aside."""
    found = [F.when(F.contains(squash(title), F.lit(p)) | F.contains(squash(text), F.lit(p)), kind) for p, kind in phrases.items()]
    return F.coalesce(*found, F.lit(default))


def title_from_content(content: Column, fallback: Column, size: int = 80) -> Column:
    """The first line with text: a heading without its marks, else its first characters; the fallback if there is none."""
    first = F.get(lines_of(content), F.lit(0))
    bare = F.trim(F.regexp_replace(first, "^#+", ""))
    made = F.when(F.startswith(first, F.lit("#")), bare).otherwise(F.left(first, F.lit(size)))
    return F.coalesce(F.nullif(made, F.lit("")), fallback)


def is_noise(title: Column, content: Column, tokens: list[str]) -> Column:
    """Blank content, a heading alone, or a noise token in title or content."""
    both = F.concat_ws("\n", title, content)
    marked = reduce(lambda a, b: a | b, [F.contains(both, F.lit(t)) for t in tokens], F.lit(False))
    return (F.trim(F.coalesce(content, F.lit(""))) == "") | marked | heading_only(content)


def basis_status(n_bases: Column, exact: Column, risk_type: Column, clause: Column, strict: dict[str, list[str]]) -> Column:
    """``missing``, ``partial`` without an exact match, ``weak`` where a strict type's clause has one of its words, else ``given``."""
    weak = reduce(
        lambda a, b: a | b,
        [(risk_type == kind) & reduce(lambda a, b: a | b, [F.contains(clause, F.lit(w)) for w in words]) for kind, words in strict.items()],
        F.lit(False),
    )
    return F.when(F.coalesce(n_bases, F.lit(0)) == 0, "missing").when(~exact, "partial").when(weak, "weak").otherwise("given")


def display_level(status: Column, risk_type: Column, severity: Column, low: list[str], by_weakness: list[str], by_match: list[str]) -> Column:
    """High without a basis; then by the kind of risk type; then high if the severity is critical."""
    return (
        F.when(status == "missing", "high")
        .when(risk_type.isin(low), "low")
        .when(risk_type.isin(by_weakness), F.when(status == "weak", "high").otherwise("medium"))
        .when(risk_type.isin(by_match), F.when(status == "partial", "low").otherwise("medium"))
        .when(severity == "critical", "high")
        .otherwise("medium")
    )


def valid_upload(filename: Column, size: Column, extensions: list[str], max_bytes: int) -> Column:
    """Whether the extension is allowed and the size within the limit."""
    return F.lower(F.regexp_extract(filename, r"\.[^./]*$", 0)).isin(extensions) & (size <= max_bytes)


def normalize_points(rows: DataFrame, unknown: str = "unknown") -> DataFrame:
    """Places with lon and lat from ``location``; rows without a comma there go.

    A distance that is no number is 0, an empty address is the district, else ``unknown``, an empty telephone is null.
    """
    return rows.where(F.contains(F.coalesce("location", F.lit("")), F.lit(","))).select(
        "name",
        F.coalesce(F.nullif("address", F.lit("")), F.nullif("district", F.lit("")), F.lit(unknown)).alias("address"),
        F.expr("try_cast(split(location, ',', 2)[0] as double)").alias("lon"),
        F.expr("try_cast(split(location, ',', 2)[1] as double)").alias("lat"),
        F.coalesce(F.expr("try_cast(try_cast(distance as double) as bigint)"), F.lit(0)).alias("distance"),
        F.nullif("tel", F.lit("")).alias("tel"),
    )


def contents_lines(files: DataFrame, path: str = "path", text: str = "text", skip: tuple[str, ...] = ("README.md", "SUMMARY.md")) -> DataFrame:
    """(path, line) of a table of contents: the first heading of each Markdown file, else its path; sort by path to write it."""
    title = F.coalesce(F.nullif(F.regexp_extract(text, r"(?m)^# ([^\n]*)", 1), F.lit("")), F.col(path))
    wanted = files.where(F.endswith(F.col(path), F.lit(".md")) & ~F.col(path).isin(*skip))
    return wanted.select(path, F.concat(F.lit("- ["), title, F.lit("]("), F.col(path), F.lit(")")).alias("line"))


def executive_summary(n_risks: Column, distribution: Column, missing: Column, weak: Column) -> Column:
    """Sentences on the number of risks, their types, and how many lack a full legal basis."""
    return F.concat_ws(
        " ",
        F.format_string("%d clauses show a risk: %s.", n_risks, distribution),
        F.when(missing > 0, F.format_string("%d have no basis and need a review.", missing)).otherwise(F.lit("All have a basis.")),
        F.when(weak > 0, F.format_string("%d rest on a weak basis.", weak)),
    )


def latest(rows: DataFrame, group: str, mtime: str, path: str) -> DataFrame:
    """The newest path of each group (equal times: the greatest path)."""
    return rows.groupBy(group).agg(F.max(F.struct(mtime, path)).alias("__m")).select(group, F.col("__m")[path].alias(path), F.col("__m")[mtime].alias(mtime))


def matching_or_first(rows: DataFrame, group: str, matches: Column, order: list[str], n: int) -> DataFrame:
    """The first ``n`` matching rows of each group, or its first ``n`` rows if none matches."""
    marked = rows.withColumn("__match", F.coalesce(matches, F.lit(False)))
    ranked = marked.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("__match"), *order)))
    # matches come first, so the first row tells whether there is one
    any_match = F.first("__match").over(Window.partitionBy(group).orderBy(F.desc("__match"), *order))
    return ranked.withColumn("__any", any_match).where((F.col("__n") <= n) & (F.col("__match") | ~F.col("__any"))).drop("__match", "__n", "__any")


def union_stores(stores: dict[str, DataFrame], placeholder: str) -> DataFrame:
    """(store, content) of all stores; a store without rows gives one row with the placeholder."""
    tagged = [rows.select(F.lit(name).alias("store"), "content") for name, rows in stores.items()]
    names = tagged[0].sparkSession.createDataFrame([(n,) for n in stores], "store string")
    found = reduce(DataFrame.unionByName, tagged)
    held = found.select("store").distinct()
    return found.unionByName(names.join(held, "store", "left_anti").withColumn("content", F.lit(placeholder)))


def new_rows(rows: DataFrame, existing: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows to insert: the first of each key that does not exist yet."""
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")
    return first.join(existing.select(key).distinct(), key, "left_anti")


def allowed_references(references: Column, allowed: Column, level: Column, lower: dict[str, str]) -> Column:
    """Struct of the references that are allowed and the level, which is lowered if none is."""
    kept = F.array_intersect(F.coalesce(references, F.array().cast("array<string>")), allowed)
    lowered = reduce(lambda c, kv: c.when(level == kv[0], kv[1]), lower.items(), F.when(F.lit(False), "")).otherwise(level)
    return F.struct(kept.alias("kept"), F.when(F.size(kept) == 0, lowered).otherwise(level).alias("level"))


def rename_entities(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges where each entity of ``names`` (name, new_name) has its new name."""

    def renamed(rows: DataFrame, column: str, other: str | None = None) -> DataFrame:
        to = names.select(F.col("name").alias(column), F.col("new_name").alias("__new"))
        met = join_spread(rows, to, column, F.col(other), "left") if other else rows.join(to, column, "left")
        return met.withColumn(column, F.coalesce("__new", column)).drop("__new")

    return renamed(nodes, "name"), renamed(renamed(edges, "src", "dst"), "dst", "src")
