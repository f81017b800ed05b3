"""One block of queries against one block of items: exact, and in bounded memory."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from scriptorium.operators import retrieval as R


def block(name, n, seed, dims=8):
    vectors = np.round(np.random.default_rng(seed).normal(size=(n, dims)), 1)
    vectors[n // 2] = 0
    return pa.table({name: pa.array(np.random.default_rng(seed + 9).permutation(n).astype(np.int64)), "v": pa.array(vectors.astype(np.float32).tolist(), pa.list_(pa.float32()))}), vectors.astype(np.float32).astype(np.float64)


@pytest.mark.parametrize("metric", R.METRICS)
@pytest.mark.parametrize(("k", "threshold"), [(5, None), (5, 0.3), (None, 0.3), (900, None)])
def test_blocks_match_brute_force(metric, k, threshold):
    (a, x), (b, y) = block("qid", 300, 1), block("iid", 500, 2)
    if metric == "cosine":
        x, y = (m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1) for m in (x, y))
    score = -np.sqrt(((x[:, None] - y[None]) ** 2).sum(2)) if metric == "l2" else x @ y.T
    want = []
    for q, line in zip(a["qid"].to_pylist(), np.round(score, 9), strict=True):
        pairs = sorted((-s, i) for s, i in zip(line, b["iid"].to_pylist(), strict=True) if i != q and (threshold is None or s >= threshold))
        want += [(q, -s) for s, i in pairs[:k]]
    got = R._comparison(k, threshold, metric)(a, b)
    found, want = sorted(zip(got["query_id"].to_pylist(), got["score"].to_pylist(), strict=True)), sorted(want)
    assert [q for q, _ in found] == [q for q, _ in want] and np.allclose([s for _, s in found], [s for _, s in want], atol=1e-8)


@pytest.mark.parametrize(("k", "metric", "threshold", "limit"), [(10, "l2", None, 80), (None, "cosine", 0.0, 200)])
def test_a_block_is_compared_in_bounded_memory(k, metric, threshold, limit):
    (a, _), (b, _) = block("qid", 2048, 1, 16), block("iid", 2048, 2, 16)
    tracemalloc.start()
    R._comparison(k, threshold, metric)(a, b)
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert most < limit
