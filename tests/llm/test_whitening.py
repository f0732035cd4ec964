"""Whitening against numpy on the whole matrix."""

import math

import numpy as np
import pytest

from trilayer.llm import whitening
from trilayer.llm.queries import op13_embedding_whitening

SCHEMA = "vec_id long, embedding array<double>, label int, n string, whitened string, _index int"


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], v, 1, "x", "y", 2) for i, v in enumerate(vectors)], SCHEMA)


def plain(vectors, components=32):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True))) for row in x]
    c = np.array([[(n * a - b) / n for a, b in zip(row, s, strict=True)] for row in x], float)
    e, axes = np.linalg.eigh(c.T @ c / n)
    k = min(components, int((e > e.max() * 1e-10).sum()))
    return n, deviation, (c @ axes[:, ::-1][:, :k]) / np.sqrt(e[::-1][:k]), e[::-1][:k] / e.sum()


def held_to(rows, ids, vectors):
    n, deviation, white, explained = plain(vectors)
    k = white.shape[1]
    assert len(rows) == n * k and {r.n for r in rows} == {n}
    at = {(r.vec_id, r.component): r for r in rows}
    got = np.array([[at[i, j + 1].whitened for j in range(k)] for i in ids])
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got * sign - white).max() < 1e-6
    assert [int(at[i, 1].deviation) for i in ids] == deviation
    assert np.allclose([at[ids[0], j + 1].explained for j in range(k)], explained, rtol=1e-9)
    assert max(r.identity_error for r in rows) < 1e-8
    assert np.abs(got.T @ got / n - np.eye(k)).max() < 1e-8


@pytest.mark.parametrize("d", [5, 40])
def test_against_numpy(spark, monkeypatch, d):
    rng = np.random.default_rng(d)
    scale = np.linspace(0.05, 3, d)
    vectors = ((rng.normal(size=(1500, d)) @ rng.normal(size=(d, d))) * scale + 5).tolist()
    ids = list(range(0, 3000, 2))
    held_to(whitening.whiten(frame(spark, vectors, ids).repartition(6)).collect(), ids, vectors)
    # more blocks than one task multiplies
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 1)
    monkeypatch.setattr(whitening, "TASK_BLOCKS", 2)
    held_to(whitening.whiten(frame(spark, vectors, ids).repartition(3)).collect(), ids, vectors)


def test_edges(spark):
    rng = np.random.default_rng(9)
    good = rng.normal(size=(60, 4)).tolist()
    bad = [None, [], [1.0, None, 0.0, 0.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0], [1.0, 2.0]]
    rows = whitening.whiten(frame(spark, good + bad)).collect()
    held_to(rows, list(range(60)), good)
    # repeated rows and null ids are rows of their own
    again = whitening.whiten(frame(spark, good + good[:3], [*range(60), 0, None, None])).collect()
    assert len(again) == 63 * 4 and sum(r.vec_id is None for r in again) == 8 and {r.n for r in again} == {63}
    # a column that is always the same has no component
    held_to(whitening.whiten(frame(spark, [[*v, 7.0] for v in good])).collect(), list(range(60)), [[*v, 7.0] for v in good])
    for none in ([], bad[:5], good[:1], [good[0]] * 5):
        assert whitening.whiten(frame(spark, none)).count() == 0
    assert whitening.whiten(frame(spark, good)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_beyond_a_long(spark):
    rows = whitening.whiten(frame(spark, [[3e10], [-3e10], [0.0]] * 3)).collect()
    assert max(int(r.deviation) for r in rows) == (9 * 64 * 3 * 10**10) ** 2


def test_query(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    keep = [(r.vec_id, r.embedding) for r in table if r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding)]
    held_to(op13_embedding_whitening(spark, "/root/testdata/sf0.001").collect(), [i for i, _ in keep], [v for _, v in keep])
