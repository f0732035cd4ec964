"""Vector search against numpy over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trilayer.operators import vectors


def brute(q, v, k, least=None):
    out = set()
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    for qi, x in q:
        scored = sorted((-round(float(unit(x) @ unit(y)), 12), vi) for vi, y in v if len(y) == len(x))
        scored = [s for s in scored if least is None or -s[0] >= least][:k]
        out |= {(qi, vi, r + 1) for r, (_, vi) in enumerate(scored)}
    return out


def table(rng, n, d):
    rows = [(i, rng.normal(size=d).round(2).tolist()) for i in range(n)]
    return rows + [(n + i, rows[i % 3][1]) for i in range(60)]  # ties: copies


@pytest.mark.parametrize("shuffled", [False, True])
def test_blocks_of_questions_meet_all_vectors(spark, monkeypatch, shuffled):
    rng = np.random.default_rng(5)
    v = table(rng, 500, 6) + [(2000 + i, rng.normal(size=4).tolist()) for i in range(50)]
    q = [(i, x) for i, x in v if i % 9 == 0 or i > 2040]
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 8 * 6 * 16)
    monkeypatch.setattr(vectors, "CELL_BYTES", 5000)
    if shuffled:
        monkeypatch.setattr(vectors, "QUERY_BYTES", 10)
    vs = spark.createDataFrame([(f"v{i:05d}", x) for i, x in v], "id string, embedding array<double>").repartition(5)
    qs = spark.createDataFrame(q, "query_id long, embedding array<double>").repartition(3)
    named = [(f"v{i:05d}", x) for i, x in v]
    found = vectors.knn(qs, vs, 7)
    assert found.columns == ["query_id", "id", "score", "rank"]
    assert {(r.query_id, r.id, r["rank"]) for r in found.collect()} == brute(q, named, 7)
    floor = vectors.knn(qs, vs, 7, min_score=0.4).collect()
    assert {(r.query_id, r.id, r["rank"]) for r in floor} == brute(q, named, 7, 0.4) and all(r.score >= 0.4 for r in floor)


def test_full_heaps_are_handed_on(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = table(rng, 300, 5)
    monkeypatch.setattr(vectors, "HEAP_ROWS", 40)
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 8 * 5 * 10)
    vs = spark.createDataFrame(v, "id long, embedding array<float>").coalesce(2)
    q = vs.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    q32 = [(i, np.float32(x).astype(float).tolist()) for i, x in v]
    assert {(r.query_id, r.id, r["rank"]) for r in vectors.knn(q, vs, 4).collect()} == brute([x for x in q32 if x[0] % 10 == 0], q32, 4)


def test_vectors_of_any_size_and_none(spark):
    v = spark.createDataFrame([(1, [1e200, 1e200]), (2, [1e-200, 0.0]), (3, [0.0, 5.0])], "id long, embedding array<double>")
    q = v.withColumnRenamed("id", "query_id")
    assert {(r.query_id, r.id) for r in vectors.knn(q, v, 1).collect()} == {(1, 1), (2, 2), (3, 3)}
    assert vectors.knn(q.limit(0), v, 3).count() == 0 and vectors.knn(q, v.where(F.lit(False)), 3).count() == 0
