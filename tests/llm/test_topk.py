"""Top-k search against all scores."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def brute(rows, k, every):
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % every == 0:
            best = sorted((-int(q @ v), j) for j, v in ok if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_ties_nulls_and_odd_values(spark):
    r = random.Random(1)
    rows = [(i, [r.uniform(-0.5, 0.5) for _ in range(16)]) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(40)]  # one common vector
    rows += [(400, None), (401, [None] + [0.0] * 15), (402, [float("nan")] + [0.0] * 15), (403, [float("inf")] + [0.0] * 15), (404, [0.0] * 16)]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    got = sorted(tuple(x) for x in topk.top_k(df, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows, 5, 20)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0], "", ""), (50, [2.0], "", "")], SCHEMA)
    assert topk.top_k(df, F.col("vec_id") % 50 == 0).count() == 2
    assert topk.top_k(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("n", [1, 7, 500])
def test_bounds_close_in(n):
    r = np.random.default_rng(n)
    x, q = np.floor(256 * r.normal(0, 0.2, (n, 8))), np.floor(256 * r.normal(0, 0.2, (5, 8)))
    for known in (np.full(5, -np.inf), np.sort(q @ x.T, axis=1)[:, -3:][:, 0]):
        at, ids, scores = topk.Block(np.arange(n), x).search(np.full(5, -1), q, 3, known)
        for i in range(5):
            true = q[i] @ x.T
            order = np.lexsort((np.arange(n), -true))[:3]
            assert ids[at == i].tolist() == order.tolist() and scores[at == i].tolist() == true[order].astype(int).tolist()


def test_bounds_spare_rows():
    """Most rows are never resolved where the k-th best score is known."""
    r = np.random.default_rng(4)
    x, q = np.floor(256 * r.normal(0, 0.1, (4000, 32))), np.floor(256 * r.normal(0, 0.1, (20, 32)))
    known = np.sort(q @ x.T, axis=1)[:, -5]
    block = topk.Block(np.arange(4000), x)
    depth = 3000
    upper = np.maximum(q, 0) @ np.maximum(x, block.lists[4000 - depth]).T + np.minimum(q, 0) @ np.minimum(x, block.lists[depth - 1]).T
    assert (upper >= q @ x.T).all() and (upper >= known[:, None]).mean() < topk.FEW
