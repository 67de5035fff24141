"""Exact search beside brute force."""

import math

import numpy as np
import pytest

from acreage.llm import topk


def by_hand(rows, k, every):
    good = [(n, [math.floor(256 * float(x)) for x in v]) for n, v in rows
            if n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    raw = {}
    for n, v in rows:
        if n is not None and n % every == 0 and v is not None and all(x is not None and math.isfinite(x) for x in v):
            raw[n] = min(raw.get(n, v), v)
    out = []
    for n, v in raw.items():
        q = [math.floor(256 * float(x)) for x in v]
        scored = sorted([(-sum(a * b for a, b in zip(q, c)), m) for m, c in good if m != n and len(c) == len(q)])[:k]
        out += [(n, i + 1, m, -s) for i, (s, m) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("rows,queries", [(2048, 512), (16, 3)])
def test_top_k(spark, scratch, monkeypatch, rows, queries):
    monkeypatch.setattr(topk, "ROWS", rows)
    monkeypatch.setattr(topk, "QUERIES", queries)
    rng = np.random.default_rng(0)
    data = [(i, rng.normal(0, 1 / (1 + np.arange(40)), 40).astype(np.float32).tolist()) for i in range(300)]
    data += [(i, data[i % 7][1]) for i in range(300, 340)] + [(400, None), (None, data[0][1]), (450, [float("nan")] * 40), (500, [None] * 40), (550, [1.0, 2.0]), (551, [1.0, 1.0]),
             (600, []), (50, data[3][1]), (7, data[9][1]), (650, [float("inf")] * 40), (700, [1e8] * 40), (701, [-1e8] * 40)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "'x' as id").repartition(5)
    got = sorted(tuple(r) for r in topk.top_k(frame, scratch, k=5, every=50).collect())
    assert got == by_hand(data, 5, 50)
    assert topk.top_k(frame.limit(0), scratch).count() == 0


def test_bounds_drop_no_candidate():
    rng = np.random.default_rng(1)
    data = np.round(rng.normal(0, 100, (64, 500)) * np.linspace(3, 0.01, 64)[:, None]).astype(np.int64)
    got = topk.best_of(data[:, :20], np.arange(20), data, np.arange(500), 5)
    scores = data[:, :20].T @ data
    for q in range(20):
        want = sorted([(-int(scores[q, j]), j) for j in range(500) if j != q])[:5]
        assert [(x[1], x[2]) for x in got if x[0] == q] == [(j, -s) for s, j in want]
