"""Product-quantised vectors: short codes are scanned, and only rows that may be among the nearest are compared exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .retrieval import BLOCK_ROWS, METRICS, _comparison, _matrix

#: Up to so many (query, item) candidates are broadcast to the scan of whole vectors; beyond, both sides meet in a shuffle.
BROADCAST_CANDIDATES = 1_000_000
#: What rounding may add to a bound; scores are rounded to nine places.
SLACK = 1e-6


@dataclass(frozen=True)
class QuantizedIndex:
    """``codes``: iid, code (a byte per part), error (length of what the code leaves out), ib (block); ``vectors``: id, vector."""

    books: list[np.ndarray]
    codes: DataFrame
    vectors: DataFrame
    metric: str
    blocks: int


def build_quantized(corpus: DataFrame, parts: int, metric: str = "cosine", sample_rows: int = 20_000, rounds: int = 12, block_rows: int = BLOCK_ROWS) -> QuantizedIndex:
    """Codes of all rows of ``corpus`` (id long, vector array<float>).

    A vector is cut into ``parts`` stretches, each replaced by the number of its nearest codeword out of at most 256.  The codewords
    are fitted to at most ``sample_rows`` rows, chosen by a hash of the id; every row gets a code, however far from them it lies,
    and the length of its error, by which the search stays exact.  Vectors have one length, ids are unique; rows without a vector or id go, as they
    have no distance.  For the cosine, vectors are taken to length one; those of length zero score 0.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    rows = corpus.select("id", "vector").where("id is not null and vector is not null")
    sample = _matrix(pa.array([r[0] for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vector").collect()]), metric)
    books = [_codewords(piece, rounds) for piece in np.array_split(sample, parts, axis=1)] if sample.size else []
    coded = stage(rows.select(F.col("id").alias("iid"), F.col("vector").alias("v")).mapInArrow(_coder(books, metric), "iid long, code binary, error double"), "codes")
    blocks = max(1, -(-coded.count() // block_rows))
    return QuantizedIndex(books, coded.withColumn("ib", F.pmod(F.xxhash64("iid"), F.lit(blocks)).cast("int")), rows, metric, blocks)


def _codewords(piece: np.ndarray, rounds: int) -> np.ndarray:
    """At most 256 centres of the sample's stretches, by rounds of nearest centre and mean."""
    centres = piece[:: max(1, len(piece) // 256)][:256].copy()
    for _ in range(rounds):
        own = _closest(piece, centres)
        count = np.bincount(own, minlength=len(centres))
        total = np.stack([np.bincount(own, piece[:, j], len(centres)) for j in range(piece.shape[1])], axis=1) if piece.shape[1] else centres
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def _closest(piece: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None, :] - 2 * piece @ centres.T, axis=1)


def _coder(books: list[np.ndarray], metric: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (iid, v) as (iid, code, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(1), metric)
            code, error = np.zeros((len(vectors), len(books)), np.uint8), np.zeros(len(vectors))
            for j, (piece, centres) in enumerate(zip(np.array_split(vectors, len(books), axis=1), books, strict=True)):
                code[:, j] = _closest(piece, centres)
                error += ((piece - centres[code[:, j]]) ** 2).sum(1)
            codes = pa.array([row.tobytes() for row in code], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), codes, pa.array(np.sqrt(error))], ["iid", "code", "error"])

    return run


def _scan(books: list[np.ndarray], metric: str, keep: int, exact: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What one block of queries (qid, v) may find in one block of codes (iid, code, error): low and high are bounds of the score."""
    schema = pa.schema([("query_id", pa.int64()), ("item_id", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])

    def scan(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        qid, iid, error = a["qid"].to_numpy(), b["iid"].to_numpy(), b["error"].to_numpy()
        code = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(len(iid), len(books))
        out = []
        for q, vector in zip(qid, _matrix(a["v"], metric), strict=True):
            total = np.zeros(len(iid))
            for j, (piece, centres) in enumerate(zip(np.array_split(vector, len(books)), books, strict=True)):
                table = -((centres - piece) ** 2).sum(1) if metric == "l2" else centres @ piece
                total += table[code[:, j]]
            score = -np.sqrt(np.maximum(-total, 0)) if metric == "l2" else total
            reach = (error if metric == "l2" else error * np.linalg.norm(vector)) + SLACK
            low, high = score - reach, score + reach
            other = iid != q
            if exact:
                least = np.partition(low[other], -keep)[-keep] if other.sum() > keep else -np.inf
                best = np.flatnonzero(other & (high >= least))
            else:
                low = high = score
                best = np.flatnonzero(other)
                if len(best) > keep:
                    best = best[np.lexsort((iid[best], -score[best]))[:keep]]
            out.append(pa.Table.from_arrays([pa.array(np.full(len(best), q)), pa.array(iid[best]), pa.array(low[best]), pa.array(high[best])], schema=schema))
        return pa.concat_tables(out)

    return scan


def candidates(index: QuantizedIndex, queries: DataFrame, k: int, most: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, item_id): items that must be compared exactly.

    For ``most=None`` these are all items that may be among the ``k`` best: their best possible score reaches the k-th best of the
    worst possible ones.  Each block drops what its own rows already rule out.  Otherwise the ``most`` best by code alone.
    """
    asked = queries.select("id", "vector").where("id is not null and vector is not null")
    groups = max(1, -(-asked.count() // block_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(F.col("id").alias("qid"), F.col("vector").alias("v"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("qb"), every(index.blocks).alias("ib"))
    right = index.codes.select("iid", "code", "error", "ib", every(groups).alias("qb"))
    found = left.groupBy("qb", "ib").cogroup(right.groupBy("qb", "ib")).applyInArrow(_scan(index.books, index.metric, k if most is None else most, most is None), "query_id long, item_id long, low double, high double")
    if most is not None:
        w = Window.partitionBy("query_id").orderBy(F.desc("high"), "item_id")
        return found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).select("query_id", "item_id")
    found = stage(found, "bounds")
    w = Window.partitionBy("query_id").orderBy(F.desc("low"))
    least = found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).groupBy("query_id").agg(F.min("low").alias("least"), F.count("*").alias("n"))
    return found.join(least, "query_id").where((F.col("high") >= F.col("least")) | (F.col("n") < k)).select("query_id", "item_id")


def quantized_top_k(index: QuantizedIndex, queries: DataFrame, k: int, most: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, item_id, score, rank) as ``vector_top_k``: the codes are scanned, then the candidates are compared by their whole vectors.

    Exact for ``most=None``, where the codes' errors decide how many rows are compared; with ``most`` each query compares so
    many rows, and may miss some of the nearest.
    """
    pairs = stage(candidates(index, queries, k, most, block_rows), "candidates")
    n = pairs.count()
    items = index.vectors.select(F.col("id").alias("item_id"), F.col("vector").alias("v"))
    wanted = items.join(F.broadcast(pairs) if n <= BROADCAST_CANDIDATES else pairs, "item_id")
    # a query's candidates are dealt to blocks, so that many of them are no large task
    blocks = max(1, -(-n // block_rows))
    salt = F.pmod(F.xxhash64("item_id"), F.lit(min(blocks, 64))).cast("int")
    right = wanted.select(F.col("item_id").alias("iid"), "v", F.col("query_id").alias("q"), salt.alias("ib"))
    left = queries.where("id is not null and vector is not null").select(F.col("id").alias("qid"), F.col("vector").alias("v"), F.col("id").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(min(blocks, 64) - 1))).alias("ib"))
    found = left.groupBy("q", "ib").cogroup(right.groupBy("q", "ib")).applyInArrow(_comparison(k, None, index.metric), "query_id long, item_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
