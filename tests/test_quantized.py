"""Product-quantised search: exact by its bounds, near enough by codes alone, and how much it reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import quantized as Q
from scriptorium.operators import retrieval as R


def _rows(spark, sf="0.01"):
    return spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _pairs(found):
    return {(r.query_id, r.item_id, r.rank) for r in found.collect()}


@pytest.mark.parametrize("metric", R.METRICS)
def test_bounds_make_the_search_exact(spark, metric):
    rows = _rows(spark)
    queries = rows.where("id % 50 = 0")
    index = Q.build_quantized(rows, 16, metric, sample_rows=200, block_rows=90)
    assert index.codes.count() == rows.count() == index.codes.select("iid").distinct().count() and index.blocks > 1
    assert _pairs(Q.quantized_top_k(index, queries, 10, block_rows=3)) == _pairs(R.vector_top_k(queries, rows, 10, metric))


def test_codes_find_nine_of_ten_and_read_a_fifth(spark):
    rows = _rows(spark, "0.1")
    queries, n = rows.where("id % 50 = 0"), rows.count()
    index, most = Q.build_quantized(rows, 32), 100
    found = Q.quantized_top_k(index, queries, 10, most)
    exact = {p[:2] for p in _pairs(R.vector_top_k(queries, rows, 10, "cosine"))}
    assert len({p[:2] for p in _pairs(found)} & exact) >= 0.9 * len(exact)
    width = 4 * len(rows.first().vector)
    read = n * (index.codes.agg(F.max(F.length("code"))).first()[0]) + most * width  # of one query, in bytes
    assert read <= 0.2 * n * width


def test_rows_far_from_the_sample_are_found(spark):
    made = np.random.default_rng(5)
    rows = [(i, [float(x) for x in made.normal(size=6)]) for i in range(300)] + [(1000 + i, [50.0 + i, -40.0, 30.0, 20.0, 10.0, float(i)]) for i in range(4)]
    corpus = spark.createDataFrame(rows, "id bigint, vector array<float>")
    index = Q.build_quantized(corpus.where("id < 1000"), 4, "l2", sample_rows=50)
    far = Q.build_quantized(corpus, 4, "l2", sample_rows=20)
    queries = corpus.where("id in (0, 7, 1001)")
    assert _pairs(Q.quantized_top_k(far, queries, 3)) == _pairs(R.vector_top_k(queries, corpus, 3, "l2"))
    assert _pairs(Q.quantized_top_k(index, queries, 3)) == _pairs(R.vector_top_k(queries, corpus.where("id < 1000"), 3, "l2"))


def test_odd_vectors(spark):
    rows = [(1, [0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, None), (None, [1.0, 2.0, 3.0]), (5, [0.0, 1.0, 0.0])]
    corpus = spark.createDataFrame(rows, "id bigint, vector array<float>").withColumn("code", F.lit("x"))
    index = Q.build_quantized(corpus, 5)
    got = {(r.query_id, r.item_id, r.score) for r in Q.quantized_top_k(index, corpus, 1).collect()}
    assert got == {(1, 2, 0.0), (2, 3, 1.0), (3, 2, 1.0), (5, 1, 0.0)}
    empty = Q.build_quantized(corpus.limit(0), 2)
    assert Q.quantized_top_k(empty, corpus, 3).count() == 0 and Q.quantized_top_k(index, corpus.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        Q.build_quantized(corpus, 2, "other")
