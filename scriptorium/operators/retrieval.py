"""Retrieval: vector and lexical top-k, relevance scores, and the choice of evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keyword_hits, squash
from ..staging import stage
from .skew import LEAST, join_spread

#: Rows of a block; of one whose pairs are all kept if they are near enough; queries of a block that are scored at a time.
BLOCK_ROWS, PAIR_ROWS, STRIP_ROWS = 4096, 2048, 128


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def cosine_at_least(queries: DataFrame, corpus: DataFrame, threshold: float, block_rows: int = PAIR_ROWS) -> DataFrame:
    """(query_id, item_id, score): all items whose cosine is at or above the threshold, however many they are."""
    return _compared(queries, corpus, None, threshold, block_rows)


def cosine_top_k(queries: DataFrame, corpus: DataFrame, k: int, threshold: float | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, item_id, score, rank): the k nearest items by cosine for each query.

    ``queries`` and ``corpus``: id long, vector array<float>.  Both are dealt to blocks of bounded size; a task
    multiplies one block of queries with one of items and keeps k per query, so what is shuffled
    back is blocks x k.  An item is not compared with a query of its own id.  Vectors of length zero score 0.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return _compared(queries, corpus, k, threshold, block_rows).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


METRICS = ("cosine", "l2", "inner")


def vector_top_k(queries: DataFrame, corpus: DataFrame, k: int, metric: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """As ``cosine_top_k`` for any metric: the score is the cosine, the inner product, or the negative distance (``l2``)."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return _compared(queries, corpus, k, None, block_rows, metric).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _compared(queries: DataFrame, corpus: DataFrame, k: int | None, threshold: float | None, block_rows: int, metric: str = "cosine") -> DataFrame:
    """(query_id, item_id, score) of each pair of blocks: the k nearest items of each query, or all for None."""
    n_query = max(1, -(-queries.count() // block_rows))
    n_item = max(1, -(-corpus.count() // block_rows))
    left = queries.select(F.col("id").alias("qid"), F.col("vector").alias("v"), F.pmod(F.xxhash64("id"), F.lit(n_query)).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_item - 1).cast("long"))).alias("ib"))
    right = corpus.select(F.col("id").alias("iid"), F.col("vector").alias("v"), F.pmod(F.xxhash64("id"), F.lit(n_item)).alias("ib"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_query - 1).cast("long"))).alias("qb"))

    return left.groupBy("qb", "ib").cogroup(right.groupBy("qb", "ib")).applyInArrow(_comparison(k, threshold, metric), "query_id long, item_id long, score double")


def _matrix(column: pa.ChunkedArray | pa.Array, metric: str = "cosine") -> np.ndarray:
    """Vectors as rows, of length one for the cosine."""
    arrays = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(arrays.offsets.to_numpy()) if len(arrays) else np.zeros(0)
    if len(size) and not arrays.null_count and (size == size[0]).all():
        m = arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(size), -1)
    else:
        m = np.array(column.to_pylist(), np.float64)
    if metric != "cosine" or not len(m):
        return m
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1)


def _comparison(k: int | None, threshold: float | None, metric: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What one block of queries (qid, v) finds in one block of items (iid, v)."""
    schema = pa.schema([("query_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64())])

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        qid, iid = a["qid"].to_numpy(), b["iid"].to_numpy()
        order = np.argsort(iid, kind="stable")  # of equal scores the least id comes first
        left, right, iid = _matrix(a["v"], metric), _matrix(b["v"], metric)[order], iid[order]
        length = (right**2).sum(1)[None, :]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for first in range(0, len(qid), STRIP_ROWS):
            own, asked = left[first : first + STRIP_ROWS], qid[first : first + STRIP_ROWS]
            score = own @ right.T
            if metric == "l2":
                score *= -2
                score += length
                score += (own**2).sum(1)[:, None]
                np.negative(np.sqrt(np.maximum(score, 0, out=score), out=score), out=score)
            np.round(score, 9, out=score)
            score[(asked[:, None] == iid[None, :]) | np.isnan(score)] = -np.inf
            if threshold is not None:
                score[score < threshold] = -np.inf
            if k is None or k >= len(iid):
                row, at = np.nonzero(score > -np.inf)
                out.append((asked[row], iid[at], score[row, at]))
                continue
            for i, line in enumerate(score):
                met = np.flatnonzero((line >= np.partition(line, len(iid) - k)[len(iid) - k]) & (line > -np.inf))
                met = met[np.argsort(-line[met], kind="stable")[:k]]
                out.append((np.full(len(met), asked[i]), iid[met], line[met]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return compare


@dataclass(frozen=True)
class VectorIndex:
    """Cells around centroids: every row of the corpus (iid, v, cell, ib), and the blocks of each cell."""

    centroids: np.ndarray
    rows: DataFrame
    sizes: DataFrame
    metric: str


def build_index(corpus: DataFrame, cells: int, metric: str = "cosine", sample_rows: int = 20_000, rounds: int = 8, block_rows: int = BLOCK_ROWS) -> VectorIndex:
    """An inverted-file index of all rows of ``corpus`` (id, vector).

    The centroids are fitted to at most ``sample_rows`` rows, chosen by a hash of the id; every row is then put in the cell of
    its nearest centroid.  A cell beyond ``block_rows`` rows is dealt to several blocks.
    """
    sample = _matrix(pa.array([r[0] for r in corpus.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vector").collect()]), metric)
    centroids = sample[:: max(1, len(sample) // cells)][:cells].copy()
    for _ in range(rounds if len(sample) else 0):
        own = _nearest_cells(sample, centroids, 1)[:, 0]
        for c in range(len(centroids)):
            if (own == c).any():
                centroids[c] = sample[own == c].mean(0)

    placed = corpus.select(F.col("id").alias("iid"), F.col("vector").alias("v")).mapInArrow(_cell_finder(centroids, 1, metric), "iid long, v array<double>, cell int")
    placed = stage(placed, "cells")
    sizes = stage(placed.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")), "cell_sizes")  # a row per cell
    rows = placed.join(F.broadcast(sizes), "cell").withColumn("ib", F.pmod(F.xxhash64("iid"), F.col("blocks")).cast("int")).drop("blocks")
    return VectorIndex(centroids, rows, sizes, metric)


def _nearest_cells(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    distance = (centroids**2).sum(1)[None, :] - 2 * vectors @ centroids.T
    return np.argsort(distance, axis=1, kind="stable")[:, :n]


def _cell_finder(centroids: np.ndarray, n: int, metric: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the ``n`` nearest cells to rows (id, v), one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(centroids):
                cells = _nearest_cells(_matrix(batch.column(1), metric), centroids, n)
                again = np.repeat(np.arange(batch.num_rows), cells.shape[1])
                vectors = batch.column(1).cast(pa.list_(pa.float64())).take(pa.array(again))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(again)), vectors, pa.array(cells.reshape(-1), pa.int32())], [*batch.schema.names[:2], "cell"])

    return run


def index_top_k(index: VectorIndex, queries: DataFrame, k: int, probes: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """As ``vector_top_k``, but a query is compared only with the items of its ``probes`` nearest cells."""
    wanted = queries.select(F.col("id").alias("qid"), F.col("vector").alias("v")).mapInArrow(_cell_finder(index.centroids, probes, index.metric), "qid long, v array<double>, cell int")
    wanted = stage(wanted, "probes")
    groups = wanted.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("groups"))  # a row per cell
    both = F.broadcast(stage(groups.join(index.sizes, "cell"), "blocks"))
    left = wanted.join(both, "cell").select("qid", "v", "cell", F.pmod(F.xxhash64("qid"), F.col("groups")).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("ib"))
    right = index.rows.join(both, "cell").select("iid", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("qb"), "ib")
    keys = ["cell", "qb", "ib"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_comparison(k, None, index.metric), "query_id long, item_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): lower-case words of Latin letters."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    return docs.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def bm25_top_k(docs: DataFrame, key: str, text: str, terms: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score, rank): the k best documents for a few terms.

    Only the terms asked for are counted, in place; two totals of the corpus are broadcast as one row.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    # cut once: one pass over the words counts all terms, and the few numbers per document are stored
    zero = F.array(*[F.lit(0) for _ in range(len(terms) + 1)])
    step = lambda a, w: F.array(a[0] + 1, *[a[i + 1] + (w == t).cast("int") for i, t in enumerate(terms)])
    counted = docs.select(key, F.aggregate(words, zero, step).alias("c"))
    base = stage(counted.select(key, F.col("c")[0].alias("n"), *[F.col("c")[i + 1].alias(f"tf{i}") for i in range(len(terms))]), "term_counts")
    stats = base.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.ln(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    scored = base.join(F.broadcast(stats)).select(key, F.round(score, 6).alias("score")).where("score > 0")
    top = scored.orderBy(F.desc("score"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def heading_only(content: Column) -> Column:
    """No lines, one heading, or at most two short lines without a full stop."""
    lines = F.filter(F.transform(F.split(F.coalesce(content, F.lit("")), "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    brief = (F.size(lines) <= 2) & F.forall(lines, lambda x: (F.length(x) <= 20) & ~F.contains(x, F.lit(".")))
    return (F.size(lines) == 0) | ((F.size(lines) == 1) & F.startswith(F.element_at(F.concat(lines, F.array(F.lit(""))), 1), F.lit("#"))) | brief


def relevance(clause: Column, title: Column, content: Column, include: Column, prefer: Column, exclude: Column, article: str) -> Column:
    """Struct of ``score`` and ``notes``: hits of the retrieval rule's words in a result.

    5 per include word, 8 per prefer word, 4 per prefer word that the clause has too, 2 for an article
    word in the title, -20 for a heading alone, -7 per exclude word, -5 without include and prefer words.
    """
    text = squash(F.concat_ws("", title, content))
    inc, pre, exc = keyword_hits(text, include), keyword_hits(text, prefer), keyword_hits(text, exclude)
    both = keyword_hits(squash(clause), pre)
    bare = heading_only(content)
    none = (F.size(inc) == 0) & (F.size(pre) == 0)
    score = 5 * F.size(inc) + 8 * F.size(pre) + 4 * F.size(both) + F.when(F.contains(F.coalesce(title, F.lit("")), F.lit(article)), 2).otherwise(0) - F.when(bare, 20).otherwise(0) - 7 * F.size(exc) - F.when(none, 5).otherwise(0)
    notes = F.array_compact(F.array(F.when(F.size(inc) > 0, "include"), F.when(F.size(pre) > 0, "prefer"), F.when(F.size(both) > 0, "clause"), F.when(bare, "heading"), F.when(F.size(exc) > 0, "exclude")))
    return F.struct(score.alias("score"), notes.alias("notes"))


def targeted_queries(primary: Column, variants: list[tuple[Column, Column]], fallback: Column, default: str) -> Column:
    """Queries to try in order: the primary one, variants whose condition holds, the fallback if it differs."""
    tried = F.array_compact(F.array(primary, *[F.when(condition, query) for condition, query in variants], F.when(fallback != primary, fallback)))
    return F.when(F.size(tried) > 0, F.array_distinct(tried)).otherwise(F.array(F.lit(default)))


def first_successful(candidates: DataFrame, item: str, query_index: str, few: bool = False, least: int = LEAST) -> DataFrame:
    """The candidates of the first query that has any; later ones say that they are a fallback.  Null is an item as others.

    The first query of each item is a small aggregate; candidates are written once and meet it, those of a hot item dealt out.
    With ``few``, where an item has a bounded number of candidates, one window does.
    """
    if few:
        found = candidates.withColumn("__q", F.min(query_index).over(Window.partitionBy(item)))
    else:
        rows = stage(candidates.withColumn("__item", F.to_json(F.struct(item))), "candidates")
        first = rows.groupBy("__item").agg(F.min(query_index).alias("__q"))
        spread = F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind])
        found = join_spread(rows, first, "__item", spread, least=least).drop("__item")
    return found.where(F.col(query_index) == F.col("__q")).withColumn("fallback_query", F.col("__q") > 0).drop("__q")


def choose_evidence(hits: DataFrame, item: str, per_store: int, least: int = 5) -> DataFrame:
    """Per item: good hits by (score, store, title), repeats dropped, at most ``per_store`` a store, ranked anew."""
    good = hits.where(F.col("score") >= least)
    order = [F.desc("score"), F.col("kb_name"), F.col("title")]
    same = Window.partitionBy(item, squash(F.col("title")), F.left(squash(F.col("content")), F.lit(160))).orderBy(*order, "content")
    once = good.withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")
    store = Window.partitionBy(item, "kb_name").orderBy(*order, "content")
    capped = once.withColumn("__n", F.row_number().over(store)).where(F.col("__n") <= per_store).drop("__n")
    return capped.withColumn("rank", F.row_number().over(Window.partitionBy(item).orderBy(*order, "content")))


def metres_between(lat: Column, lon: Column, to_lat: Column, to_lon: Column) -> Column:
    """Great-circle distance in whole metres."""
    a, b = F.radians(lat), F.radians(to_lat)
    half = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(to_lon) - F.radians(lon)) / 2), 2)
    return F.round(2 * 6371000 * F.asin(F.sqrt(half)), 0).cast("long")


def within_radius(points: DataFrame, lat: float, lon: float, radius_m: float, k: int = 20) -> DataFrame:
    """The k nearest points within a radius, by great-circle distance in metres."""
    if radius_m <= 0:
        raise ValueError("the radius must be above 0")
    metres = metres_between(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    return points.withColumn("distance", metres).where(F.col("distance") <= radius_m).orderBy("distance", "name").limit(k)


def near_places(requests: DataFrame, places: DataFrame, points: DataFrame, radius_m: float, k: int = 20) -> DataFrame:
    """(request_id, name, distance, rank): for each request (request_id, place) the k nearest points around the place of that name.

    Places (place, lat, lon) are looked up by name; a request whose place is unknown has no rows.  Points and places
    meet in cells of a grid as wide as the radius, so only neighbouring cells are compared.
    """
    if radius_m <= 0:
        raise ValueError("the radius must be above 0")
    step = float(radius_m) / 111_000  # degrees of latitude
    at = requests.join(places, "place").select("request_id", F.col("lat").alias("a"), F.col("lon").alias("b"))
    # a degree of longitude is shorter, so a request looks at more columns of the grid
    wide = F.least(F.ceil(1 / F.greatest(F.cos(F.radians(F.abs("a") + step)), F.lit(0.01))), F.lit(100)).cast("int")
    cell = lambda c: F.floor(F.col(c) / step)
    near = at.select("*", F.explode(F.sequence(cell("a") - 1, cell("a") + 1)).alias("y"), wide.alias("w")).select("*", F.explode(F.sequence(cell("b") - F.col("w"), cell("b") + F.col("w"))).alias("x"))
    placed = points.select("name", "lat", "lon", cell("lat").alias("y"), cell("lon").alias("x"))
    found = near.join(placed, ["y", "x"]).withColumn("distance", metres_between(F.col("a"), F.col("b"), F.col("lat"), F.col("lon"))).where(F.col("distance") <= radius_m)
    w = Window.partitionBy("request_id").orderBy("distance", "name")
    return found.select("request_id", "name", "distance", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def token_budget(rows: DataFrame, key: str, order: list[str], tokens: str, budget: int) -> DataFrame:
    """Rows in order as long as their running sum of tokens stays within the budget."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)
