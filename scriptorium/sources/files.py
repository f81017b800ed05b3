"""Sources and sinks: chunk files, Markdown, folders of news, nested JSON, rendered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import title_of
from ..operators.display import contents_lines
from ..operators.serving import number_rows
from ..staging import stage


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(chunk): a JSON list or JSON lines of strings or of objects with text or content, else the non-blank lines of a text file."""
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("value"))
    else:
        whole = spark.read.text(path)
    if path.endswith((".json", ".jsonl")):
        # an object comes as its JSON text; a string of a JSON list as itself, of a line with its quotes
        bare = F.get(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>"), F.lit(0)) if path.endswith(".jsonl") else F.col("value")
        found = whole.select(F.when(F.startswith(F.ltrim("value"), F.lit("{")), F.coalesce(F.get_json_object("value", "$.text"), F.get_json_object("value", "$.content"))).otherwise(bare).alias("chunk"))
    else:
        found = whole.select(F.trim("value").alias("chunk"))
    return found.where("chunk is not null and chunk <> ''")


def read_report(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A report context from one JSON file of any depth."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def join_pages(pages: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, text): the pages of each document, in order, with a blank line between them."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n").alias(text))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole Markdown files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_news(spark: SparkSession, folder: str, limit: int) -> DataFrame:
    """(title, filename, crawled_at, text): the newest Markdown files of a folder; the limit is held between 1 and 20."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    text = F.decode("content", "UTF-8")
    rows = files.select(title_of(text, name).alias("title"), name.alias("filename"), F.to_date("modificationTime").alias("crawled_at"), "modificationTime", text.alias("text"))
    return rows.orderBy(F.desc("modificationTime"), "filename").limit(min(max(limit, 1), 20)).drop("modificationTime")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(page_no, image_path): the image files of a folder, by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,bmp,webp}").load(folder).select("path")
    return number_rows(files, ["path"], "n").select((F.col("n") + 1).cast("int").alias("page_no"), F.col("path").alias("image_path"))


#: Extensions of image files.
IMAGES = ("png", "jpg", "jpeg", "bmp", "webp")


def page_images(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """(page_no, image_path, source_type): the image of a path, the images of a folder or glob by path, or those of a list in its order.

    ``FileNotFoundError`` if a named path does not exist, ``ValueError`` if it or one that a glob finds is no image; other files of a
    folder are left out, and a glob that finds nothing has no pages.  A list is checked path by path; folders and globs are listed by Spark.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def status(path: str):
        place = jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(conf)
        if not system.exists(place):
            raise FileNotFoundError(path)
        return system.getFileStatus(place)

    def checked(path: str) -> str:
        found = status(path)
        if found.isDirectory() or path.rsplit(".", 1)[-1].lower() not in IMAGES:
            raise ValueError(f"not an image: {path}")
        return found.getPath().toString()

    named, globbed = isinstance(source, (list, tuple)), not isinstance(source, (list, tuple)) and any(c in source for c in "*?")
    if named or not globbed and not status(source).isDirectory():
        paths = [checked(p) for p in (source if named else [source])]
        rows = spark.createDataFrame(list(enumerate(paths, 1)), "page_no int, image_path string")
        return rows.withColumn("source_type", F.lit("image"))
    place = jvm.org.apache.hadoop.fs.Path(source)
    if globbed and not place.getFileSystem(conf).globStatus(place):
        return spark.createDataFrame([], "page_no int, image_path string, source_type string")
    found = spark.read.format("binaryFile").load(source).select("path")
    is_image = F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*IMAGES)
    if globbed:
        other = found.where(~is_image).first()
        if other:
            raise ValueError(f"not an image: {other[0]}")
    rows = number_rows(found.where(is_image), ["path"], "n")
    return rows.select((F.col("n") + 1).cast("int").alias("page_no"), F.col("path").alias("image_path"), F.lit("image").alias("source_type"))


def first_source(candidates: list[tuple[str, Column]]) -> Column:
    """Struct of the first text that is not blank, the parser that gave it, and a warning for each one before."""
    usable = [F.trim(F.coalesce(text, F.lit(""))) != "" for _, text in candidates]
    text = F.coalesce(*[F.when(ok, t) for ok, (_, t) in zip(usable, candidates, strict=True)])
    used = F.coalesce(*[F.when(ok, F.lit(name)) for ok, (name, _) in zip(usable, candidates, strict=True)])
    warnings, before = [], F.lit(True)
    for ok, (name, _) in zip(usable, candidates, strict=True):
        before = before & ~ok
        warnings.append(F.when(before, F.lit(f"{name}: empty")))
    return F.struct(text.alias("text"), used.alias("parser_used"), (used != candidates[0][0]).alias("fallback_used"), F.array_compact(F.array(*warnings)).alias("warnings"))


#: A line that begins a page, with its number.
PAGE_MARKER = r"(?im)^(?:page +([0-9]+)|第([0-9]+)页)[ ]*$"


def numbered_pages(docs: DataFrame, key: str, text: str, marker: str = PAGE_MARKER) -> DataFrame:
    """(key, page_no, text): the text after each marker line with the number in it; text before the first is page 1, blank pages go."""
    rows = docs.select(key, F.posexplode(F.split(text, f"(?={marker})", -1)).alias("n", "part"))
    given = F.coalesce(*[F.nullif(F.regexp_extract("part", "^" + marker, g), F.lit("")) for g in (1, 2)]).cast("int")
    body = F.btrim(F.regexp_replace("part", "^" + marker, ""), F.lit(" \n\t\r"))
    return rows.select(key, F.coalesce(given, F.lit(1)).alias("page_no"), body.alias("text")).where("text <> ''")


def split_pages(docs: DataFrame, key: str, text: str, marker: str = r"(?im)^(?:page +[0-9]+|第[0-9]+页)[ ]*$") -> DataFrame:
    """(key, page_no, text): the text between marker lines; blank pages go."""
    pages = F.filter(F.transform(F.split(text, marker, -1), lambda p: F.btrim(p, F.lit(" \n\t\r"))), lambda p: p != "")
    return docs.select(key, F.posexplode(pages).alias("n", "text")).select(key, (F.col("n") + 1).alias("page_no"), "text")


def write_report(reports: DataFrame, path: str) -> None:
    """Nested report rows as JSON lines; ``ValueError`` if there are none."""
    if reports.isEmpty():
        raise ValueError("there is nothing to write")
    reports.write.mode("overwrite").json(path)


def write_store(chunks: DataFrame, path: str) -> None:
    """A knowledge base, one folder per store, so that reading one store prunes the others; ``ValueError`` if there are no chunks."""
    if chunks.isEmpty():
        raise ValueError("there is nothing to insert")
    chunks.write.mode("append").partitionBy("kb_name").parquet(path)


#: Keys of one folder of a keyed store; touched folders are broadcast up to so many, and joined by shuffle beyond.
KEY_WIDTH, BROADCAST_FOLDERS = 100_000, 100_000


def _open_keyed(spark: SparkSession, path: str) -> DataFrame:
    """A keyed store whose workspaces are strings, even if all their names look like numbers."""
    found = spark.read.parquet(path).schema
    return spark.read.schema(StructType([StructField(f.name, StringType()) if f.name == "kb_name" else f for f in found])).parquet(path)


def _keyed(rows: DataFrame, key: str, width: int) -> DataFrame:
    return rows.withColumn("key_part", F.floor(F.col(key) / width).cast("bigint"))


def write_keyed(rows: DataFrame, path: str, key: str, width: int = KEY_WIDTH) -> None:
    """A new keyed store: a folder per workspace (``kb_name``) and range of a whole-number key, so that later changes touch few files."""
    if rows.isEmpty():
        raise ValueError("there is nothing to insert")
    _keyed(rows, key, width).write.mode("errorifexists").partitionBy("kb_name", "key_part").parquet(path)


def read_keyed(spark: SparkSession, path: str, workspace: str | None = None) -> DataFrame:
    """The rows of a keyed store; of one workspace only its folders are opened."""
    rows = _open_keyed(spark, path)
    return (rows if workspace is None else rows.where(F.col("kb_name") == workspace)).drop("key_part")


def update_keyed(changes: DataFrame, path: str, key: str, width: int = KEY_WIDTH) -> int:
    """Rows of a keyed store replaced by those of the same workspace and key, others added; returns how many folders were written anew.

    Only the folders that a change falls into are read and replaced, in one commit; all other files stay as they are.  The last
    of equal keys is not defined, so keys of ``changes`` are unique; a key or workspace must not be null.
    """
    spark, own = changes.sparkSession, ["kb_name", "key_part"]
    if changes.isEmpty():
        raise ValueError("there is nothing to update")
    new = stage(_keyed(changes, key, width), "changes")
    touched = stage(new.select(*own).distinct(), "touched")
    folders = touched.count()
    # a join on the folders' columns, so that Spark prunes the scan by what was touched
    here = _open_keyed(spark, path).join(F.broadcast(touched) if folders <= BROADCAST_FOLDERS else touched, own, "left_semi")
    kept = here.join(new.select("kb_name", key), ["kb_name", key], "left_anti").select(new.columns)
    made = stage(kept.unionByName(new), "updated")  # written before what it is read from is replaced
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*own).parquet(path)
    return folders


def delete_workspace(spark: SparkSession, path: str, workspace: str) -> bool:
    """Removes the folder of one workspace; whether there was one."""
    jvm = spark.sparkContext._jvm
    name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(workspace)
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/kb_name={name}")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def insert_rows(rows: DataFrame, path: str, key: str, order: list[str], unique: list[str] | None = None) -> DataFrame:
    """Rows appended to a table with keys of their own, from one above the greatest; returns the rows that were refused.

    With ``unique`` columns, as for accounts, a row is refused if the table or an earlier row (by ``order``) has the same values; a row with
    a null there is not.  Keys follow ``order``, which no two rows share.  ``ValueError`` if there are no rows.
    """
    spark = rows.sparkSession
    if rows.isEmpty():
        raise ValueError("there is nothing to insert")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stored = spark.read.parquet(path) if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place) else None
    top = (stored.agg(F.max(key)).first()[0] or 0) if stored is not None else 0
    refused = rows.limit(0)
    if unique:
        whole = F.lit(True)
        for c in unique:
            whole = whole & F.col(c).isNotNull()
        first = rows.where(whole).groupBy(*unique).agg(F.min(F.struct(*order)).alias("__first"))
        taken = stored.select(*unique).distinct().withColumn("__taken", F.lit(True)) if stored is not None else None
        marked = rows.join(first, unique, "left")
        marked = marked.join(taken, unique, "left") if taken is not None else marked.withColumn("__taken", F.lit(None).cast("boolean"))
        again = F.col("__first").isNotNull() & ((F.struct(*order) != F.col("__first")) | F.col("__taken").isNotNull())
        marked = stage(marked.select(*rows.columns, again.alias("__again")), "inserts")
        rows, refused = marked.where("not __again").drop("__again"), marked.where("__again").drop("__again")
    number_rows(rows, order, "__n").withColumn(key, F.col("__n") + top + 1).drop("__n").write.mode("append").parquet(path)
    return refused


def write_contents(files: DataFrame, path: str, title: str) -> None:
    """A table of contents of Markdown files (path, text) as text: the title, the time, then a line per file by path.

    The parts of the written folder, read by name, are the whole in order, however many there are.
    """
    lines = contents_lines(files).select(F.lit(1).alias("o"), F.col("path").alias("p"), F.col("line").alias("value"))
    at = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    head = files.sparkSession.range(1).select(F.lit(0).alias("o"), F.lit("").alias("p"), F.concat(F.lit(f"# {title}\n\n"), at, F.lit("\n")).alias("value"))
    head.unionByName(lines).orderBy("o", "p").select("value").write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_texts(rows: DataFrame, path: str, text: str = "markdown") -> None:
    """Rendered texts, one file per task below a new folder named by the time; older folders stay."""
    at = rows.sparkSession.sql("select date_format(current_timestamp(), 'yyyyMMdd_HHmmss')").first()[0]
    rows.select(F.col(text).alias("value")).write.text(f"{path}/{at}")


def write_rows(rows: DataFrame, path: str, kind: str) -> None:
    """Rows as ``csv``, as a Markdown table (``md``) or as lines of ``column: value`` (``txt``)."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]
    if kind == "csv":
        write_csv(rows, path)
    elif kind == "md":
        head = rows.sparkSession.createDataFrame([(f"| {' | '.join(rows.columns)} |",), ("|" + "---|" * len(rows.columns),)], "value string")
        lines = rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.regexp_replace(v, "[\n|]", " ") for v in values]), F.lit(" |")).alias("value"))
        head.coalesce(1).write.mode("overwrite").text(path)
        lines.write.mode("append").text(path)
    elif kind == "txt":
        rows.select(F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), v) for c, v in zip(rows.columns, values, strict=True)], F.lit("")).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown kind {kind}")


def read_jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8) -> DataFrame:
    """A table of a database; with a numeric key and its bounds it is read in parts."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def with_defaults(state: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """State rows whose missing columns and values come from the defaults."""
    for name, value in defaults.items():
        state = state.withColumn(name, F.coalesce(F.col(name), value) if name in state.columns else value)
    return state
