"""Vector search as matrix products against all pairs, and the recall of the index."""

import math

import numpy as np
import pytest

from folioscope.operators import vectors
from folioscope.plans import registry


def table(spark, x, parts=3):
    return spark.createDataFrame([(k, None if v is None else [float(e) for e in v], k % 3) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(parts)


def brute(x, asked, k):
    out = set()
    for q in asked:
        s = sorted((-round(float(np.dot(np.float32(x[q]).astype(float), np.float32(v).astype(float))), 6), n) for n, v in enumerate(x) if v is not None and len(v) == len(x[q]))
        out |= {(q, n, -c) for c, n in s[:k]}
    return out


@pytest.fixture
def small_sets(monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_VECTORS", 6)
    monkeypatch.setattr(vectors, "PRODUCT", 40)


def test_nearest_and_above_by_all_pairs(spark, small_sets):
    rng = np.random.default_rng(1)
    x = [*rng.standard_normal((80, 5)), None, [1.0], *([rng.standard_normal(5)] * 4)]
    v = table(spark, x)
    q = v.filter("vec_id % 7 = 0")
    asked = [k for k in range(0, len(x), 7) if x[k] is not None]
    assert {(r.query_id, r.vec_id, r.score) for r in vectors.nearest(v, q, 6).collect()} == brute(x, asked, 6)
    pairs = {(a, b) for a, b, s in brute(x, asked, len(x)) if s >= 0.5}
    assert {(r.query_id, r.vec_id) for r in vectors.above(v, q, 0.5).collect()} == pairs
    assert vectors.nearest(v.filter("false"), q, 3).count() == vectors.nearest(v, q.filter("false"), 3).count() == 0
    plan = vectors.nearest(v, q, 6)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def recall(got, want):
    return len({r[:2] for r in got} & {r[:2] for r in want}) / len(want)


@pytest.mark.parametrize("kind", ["clusters", "sphere", "copies"])
def test_recall_of_the_index(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 24))
    if kind == "clusters":
        x = rng.standard_normal((40, 24))[rng.integers(0, 40, 3000)] + 0.4 * x
    if kind == "copies":
        x[:1200] = x[0]  # a cell that holds two fifths of all rows
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = table(spark, x, 6)
    own = vectors.index(v, k=10)
    assert spark.read.parquet(own.path).count() == 3000
    got = [(r.query_id, r.vec_id) for r in vectors.probe(own, v.filter("vec_id % 100 = 0"), 10).collect()]
    asked = range(0, 3000, 100)
    if kind == "copies":  # copies stand for one another
        found, best = {}, {}
        for q, n in got:
            found.setdefault(q, []).append(round(float(x[q] @ x[n]), 4))
        for q, n, _ in brute(x, asked, 10):
            best.setdefault(q, []).append(round(float(x[q] @ x[n]), 4))
        share = np.mean([sum(s >= min(best[q]) for s in found[q]) / 10 for q in asked])
    else:
        share = recall(got, brute(x, asked, 10))
    assert share >= 0.9 and own.probes <= len(own.centroids)
    if kind == "clusters":
        assert own.probes < len(own.centroids) / 2  # most cells are never read
        plan = vectors.probe(own, v.filter("vec_id = 0"), 10)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_registered_index_query_reaches_its_recall(spark):
    data = "/root/testdata/sf0.01"
    exact = {(r.query_id, r.vec_id) for r in registry.QUERIES["vector_topk_all"](spark, data).collect()}
    got = {(r.query_id, r.vec_id) for r in registry.QUERIES["vector_index_topk"](spark, data).collect()}
    assert len(got & exact) / len(exact) >= 0.9


def test_index_of_an_empty_table_finds_nothing(spark):
    v = table(spark, [[1.0, 0.0]])
    assert vectors.probe(vectors.index(v.filter("false")), v, 3).count() == 0
    assert math.isqrt(0) == 0
