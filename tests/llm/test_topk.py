import math
import random

import pytest
from pyspark.sql import functions as F

from docloom.llm import topk


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for q, v in ok:
        if q % 50 or (q, tuple(v)) in seen:
            continue
        seen.add((q, tuple(v)))
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(400)]
    rows += [(i, [0.5] * 8) for i in range(400, 520)]  # ties
    rows += [(600, None), (650, [1.0, None] + [0.0] * 6), (700, [float("nan")] * 8), (750, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (800, []), (850, [0.25, 0.5]), (50, rows[50][1]), (3, rows[3][1])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")
    monkeypatch.setattr(topk, "CANDIDATE_TILE", 100)
    monkeypatch.setattr(topk, "QUERY_TILE", 5)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert sorted(map(tuple, topk.top_k(few, F.col("vec_id") % 50 == 0).collect())) == brute([x for x in rows if x[0] in (0, 1, 2)])


@pytest.mark.parametrize("size", [1.0, 1e9])
def test_tile_is_exact(size):
    import numpy as np

    g = np.random.default_rng(5)
    rows = np.floor(g.normal(size=(700, 6)) * 50 * size)
    ids = np.sort(g.integers(0, 600, 700))
    queries = rows[:40]
    at, found, score = topk.search_tile(queries, ids[:40], rows, ids, 5, 16)
    for q in range(40):
        want = sorted((-sum(int(a) * int(b) for a, b in zip(queries[q], rows[j])), int(ids[j])) for j in range(700) if ids[j] != ids[q])[:5]
        limit = 2**63 - 1
        assert [(int(s), int(i)) for s, i in zip(score[at == q], found[at == q])] == [(max(-limit, min(limit, -s)), i) for s, i in want]
