"""Line dedup within one edit, by a deletion-neighbourhood join.

A line of at least ``min_chars`` characters goes if an earlier line (by document id, then
position) is equal to it or one insertion, deletion or substitution away; the earliest stays.
Shorter lines are not compared within one edit, since short lines meet by chance.  With ``short_copies`` a
shorter line goes too if an earlier one is equal to it and it is not blank; without, it is never touched.

Equal lines meet by two hashes, 128 bits: the earliest place of each is a partial aggregate, so a line that fills a third
of the corpus is one row per task.  To find the other places, such a line's are dealt to many salted keys.  Near lines meet in these steps:

1. One edit leaves the first or the last stretch of a line as it is.  Lines emit a hash of both
   stretches; lines that share one with another line go on with the other part, the region.  Regions
   are halved in the same way until they are short.  This passes few lines and loses no pair.
2. Short regions emit all variants with one character deleted, and the region itself, as hashed
   keys together with what stands around.  Equal variants are joined: variants with the same place of
   deletion are substitutions, a variant equal to a whole region is an insertion.
3. The earliest partner under each key is verified by edit distance on the whole lines.

Keys hold their earliest places as partial aggregates, so no pairs of a group are made and no group is
collected.  Texts are shuffled once, for the result; hashes and places otherwise.

Defined results: null texts stay null and empty ones empty; a document whose lines all go stays
with an empty text; rows with equal ids and equal texts are one document here and keep the same lines; a
null id comes after all others; an empty table gives no rows.  Other columns pass through;
``n_chars`` follows the text where it is there, and a column named ``n_removed`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .common import OWN, join_salted

MIN_CHARS, SHORT = 40, 24
#: Hashes of lines are broadcast up to so many, and joined by shuffle beyond.
BROADCAST_HASHES = 500_000


def document_key(doc_id: Column, text: Column) -> Column:
    """A key of an id and a text: only texts of one id could collide."""
    return F.concat_ws(":", doc_id, F.xxhash64(text))


def _check(line: str | Column) -> Column:
    """A second hash of a line: both together are 128 bits."""
    return F.xxhash64(F.lit(1), line)


def long_lines(docs: DataFrame, min_chars: int = MIN_CHARS, short_copies: bool = False) -> DataFrame:
    """(hash, check, place, line) of lines with at least ``min_chars`` characters; places are in order of precedence.

    With ``short_copies``, all lines that are not blank.
    """
    # hashed and cut before the lines are dealt out, so that no line carries its text along
    cut = docs.select("doc_id", F.xxhash64("text").alias("doc"), F.split("text", "\n", -1).alias("lines"))
    lines = cut.select("doc_id", "doc", F.posexplode("lines").alias("line_no", "line"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "doc", "line_no")
    long = F.length("line") >= min_chars
    lines = lines.where(long | F.col("line").rlike(r"(?U)\S") if short_copies else long)
    return lines.select(F.xxhash64("line").alias("hash"), _check("line").alias("check"), place.alias("place"), "line")


def _stretch(n: Column) -> Column:
    """A length of at most half of n that rarely differs for n and n + 1."""
    return F.floor(n / 16).cast("int") * 8


def _halves(context: Column, region: Column) -> Column:
    """Array of (key, region): a hash of the first or last stretch and its context, and the rest.

    A line one longer uses its own stretch; where that differs, the shorter line uses both.
    """
    n = F.length(region)

    def at(size: Column, nominal: int) -> list[Column]:
        return [
            F.struct(F.xxhash64(context, F.lit("first"), size, F.left(region, size)).alias("key"), F.substring(region, size + 1, n).alias("region")),
            F.struct(F.xxhash64(context, F.lit("last"), size, F.right(region, size)).alias("key"), F.left(region, n - size).alias("region")),
        ]

    own, more = _stretch(n), _stretch(n + 1)
    return F.when(own == more, F.array(*at(own, 0))).otherwise(F.array(*at(own, 0), *at(more, 1)))


def _sharing(keys: DataFrame) -> DataFrame:
    """The rows whose key lines of at least two hashes have; the rows of a frequent key are dealt out."""
    shared = keys.groupBy("key").agg(F.min("hash").alias("lo"), F.max("hash").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n")
    return join_salted(keys, stage(shared, "shared_keys"), ["key"], "n", F.col("hash"), "left_semi")


def _only(lines: DataFrame, hashes: DataFrame) -> DataFrame:
    """Lines whose hash (and check, if given) is listed; a short list is broadcast."""
    return lines.join(F.broadcast(hashes) if hashes.count() <= BROADCAST_HASHES else hashes, hashes.columns, "left_semi")


def repeated_places(places: DataFrame) -> DataFrame:
    """The places of equal lines but the first of each."""
    counted = stage(places.groupBy("hash", "check").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1"), "repeated_lines")
    return join_salted(places, counted, ["hash", "check"], "n", F.col("place")).where("place <> first").select("place")


def near_lines(lines: DataFrame) -> DataFrame:
    """(hash, check) of the lines that have an earlier line one edit away."""
    start = F.explode(_halves(F.lit(0).cast("long"), F.col("line")))
    keys = lines.select("hash", start.alias("k")).select("hash", F.col("k.key").alias("key"))
    members = stage(_sharing(keys).select("hash").distinct(), "members")
    # the texts and first places of the few lines that share a stretch with another
    known = stage(_only(lines, members).groupBy("hash").agg(F.min("place").alias("place"), F.min("line").alias("line")), "member_lines")
    rows = known.select("hash", start.alias("k")).select("hash", "k.*")
    done: DataFrame | None = None
    while True:
        rows = stage(_sharing(rows), "regions")
        brief = F.length("region") <= SHORT + 1  # a region just above the limit meets shorter and longer ones
        done = rows.where(brief) if done is None else done.unionByName(rows.where(brief))
        rows = rows.where(F.length("region") > SHORT)
        if rows.isEmpty():
            break
        rows = rows.select("hash", F.explode(_halves(F.col("key"), F.col("region"))).alias("k")).select("hash", "k.*")
    region, i = F.col("region"), F.length("region")
    whole = F.array(F.struct(F.lit(-1).alias("cut"), F.xxhash64("key", region).alias("s")))
    deleted = F.transform(
        F.sequence(F.lit(1), i),
        lambda k: F.struct((k - 1).alias("cut"), F.xxhash64(F.col("key"), F.concat(F.left(region, k - 1), F.substring(region, k + 1, i))).alias("s")),
    )
    variants = done.distinct().join(known.select("hash", "place"), "hash").select(
        F.struct("place", "hash").alias("own"), F.explode(F.when(i > 0, F.concat(whole, deleted)).otherwise(whole)).alias("v")
    ).select("own", "v.cut", "v.s")
    variants = stage(variants, "variants")
    cut, own, best = F.col("cut"), F.col("own"), F.col("best")
    # a key that many variants share is one row here, and they are dealt out when they meet it
    same = variants.where(cut >= 0).groupBy("s", "cut").agg(F.min("own").alias("best"), F.count("*").alias("n")).where("n > 1")
    substituted = join_salted(variants.where(cut >= 0), stage(same, "equal_variants"), ["s", "cut"], "n", own)
    ends = variants.groupBy("s").agg(F.min(F.when(cut < 0, own)).alias("whole"), F.min(F.when(cut >= 0, own)).alias("part"), F.count("*").alias("n")).where("whole is not null and part is not null")
    inserted = join_salted(variants, stage(ends, "whole_variants"), ["s"], "n", F.struct("own", "cut")).withColumn("best", F.when(cut < 0, F.col("part")).otherwise(F.col("whole")))
    found = [stage(part.where(best < own).select("own", "best"), "pairs") for part in (substituted, inserted)]
    pairs = found[0].unionByName(found[1]).select(F.col("own.hash").alias("hash"), F.col("best.hash").alias("partner")).where("hash <> partner").distinct()
    a, b = known.select("hash", F.col("line").alias("a")), known.select(F.col("hash").alias("partner"), F.col("line").alias("b"))
    return pairs.join(a, "hash").join(b, "partner").where(F.levenshtein("a", "b", 1) >= 0).select("hash", _check(F.col("a")).alias("check")).distinct()


def removed_lines(docs: DataFrame, min_chars: int = MIN_CHARS, short_copies: bool = False) -> DataFrame:
    """(doc, gone): the numbers of the lines that go, for each document that loses some."""
    lines = long_lines(docs, min_chars).select("hash", "place", "line")
    places = long_lines(docs, min_chars, short_copies).select("hash", "check", "place")
    near = stage(near_lines(lines), "near_lines")
    gone = repeated_places(places).unionByName(_only(places, near).select("place"))
    doc = F.concat_ws(":", F.col("place.id"), F.col("place.doc"))
    return gone.groupBy(doc.alias("doc")).agg(F.collect_set("place.line_no").alias("gone"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, count: str = "n_removed", short_copies: bool = False) -> DataFrame:
    """``docs`` without lines that an earlier one repeats within one edit; their number is added as ``count``.

    ``short_copies``: lines below ``min_chars`` go if an earlier one is equal to them.
    """
    gone = stage(removed_lines(docs.select("doc_id", "text"), min_chars, short_copies), "removed").select(F.col("doc").alias(OWN + "doc"), F.col("gone").alias(OWN + "gone"))
    joined = docs.drop(count).withColumn(OWN + "doc", document_key(F.col("doc_id"), F.col("text"))).join(gone, OWN + "doc", "left")
    numbers, lines = F.col(OWN + "gone"), F.col(OWN + "lines")
    # what stays is found by hashing, in linear time; only texts that lose lines are cut
    joined = joined.withColumn(OWN + "lines", F.when(numbers.isNotNull(), F.split("text", "\n", -1)))
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), numbers)
    left = F.array_join(F.transform(stays, lambda i: F.get(lines, i)), "\n")
    out = joined.withColumn("text", F.when(numbers.isNull(), F.col("text")).otherwise(left)).withColumn(count, F.coalesce(F.size(numbers), F.lit(0)))
    if "n_chars" in docs.columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(count) > 0, changed).otherwise(F.col("n_chars")))
    return out.drop(OWN + "doc", OWN + "gone", OWN + "lines")


def line_digests(docs: DataFrame) -> DataFrame:
    """One row per document: id, the text that is left, its length, and how many lines went."""
    left = dedup_lines(docs.select("doc_id", "text"), short_copies=True)
    return left.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"), F.col("n_removed").cast("long").alias("n_removed"))
