from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewise.llm import topk_search as t

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k, scale=64):
    ok = [(i, [np.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in ok), default=0)
    vs = [(i, np.asarray(v + [0] * (width - len(v)))) for i, v in ok]
    out = {}
    for q, v in vs:
        if q % 20 == 0 and q not in out:
            best = sorted((-int(v @ w), i) for i, w in vs if i != q)[:k]
            out[q] = [(r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


def got(df, k, **how):
    out = {}
    for r in t.top_k(df, F.col("vec_id") % 20 == 0, k, **how).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


@pytest.mark.parametrize("kind", ["normal", "ties", "wide", "clusters"])
def test_against_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    x = {"normal": rng.normal(0, 0.12, (400, 64)), "ties": rng.integers(-1, 2, (400, 3)) / 64, "wide": rng.normal(0, 1e4, (200, 8)), "clusters": np.repeat(rng.normal(0, 0.2, (8, 16)), 50, 0)}[kind]
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    for how in ({}, {"candidate_block": 60, "query_block": 7}):
        assert got(df, 20, **how) == brute(rows, 20)


def test_reading_stops_early():
    """On skewed vectors most queries stop before the lists' end, and what they give is exact."""
    rng = np.random.default_rng(0)
    v = np.floor(np.exp(rng.normal(0, 1.5, (4000, 6)))).astype(np.int64)  # few large entries
    ids, q = np.arange(4000), v[::20] * rng.choice([1, -1], (200, 1), p=[0.8, 0.2])
    depths = []
    for query, best, scores, depth in t.block_top_k(ids[::20], q, ids, v, 10):
        full = v @ q[query // 20]
        want = sorted((-int(s), i) for i, s in enumerate(full) if i != query)[:10]
        assert [(-int(s), int(i)) for s, i in zip(scores, best, strict=True)] == want
        depths.append(depth)
    assert len(depths) == 200 and np.mean(np.asarray(depths) < 4000) > 0.6 and min(depths) <= 1000


def test_bounds_hold_at_any_depth():
    rng = np.random.default_rng(1)
    v, q = rng.integers(-50, 50, (300, 5)), rng.integers(-50, 50, (40, 5))
    lists, exact = t.SortedLists(v, 50), q @ v.T
    for depth in (1, 10, 150, 299, 300):
        lower, upper = lists.bounds(q, depth)
        assert (lower <= exact).all() and (exact <= upper).all()
    assert (lower == exact).all() and (upper == exact).all()


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0]), (1, [0.5, None]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, None), (None, [1.0, 1.0]), (5, []), (6, [-1.0, 3.0]), (6, [-1.0, 3.0]), (40, [2.0, 2.0]), (40, [2.0, 2.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("mine")).withColumn("score", F.lit(1)).withColumn("id", F.lit(2))
    assert got(df, 3) == brute(rows, 3)
    assert t.top_k(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    assert t.top_k(spark.createDataFrame([(0, [1.0])], SCHEMA), F.lit(True)).count() == 0
