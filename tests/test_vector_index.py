"""The stored index against exact search."""

import numpy as np
from pyspark.sql import functions as F

from trilayer.operators import vector_index, vectors


def recall(near, exact):
    pairs = lambda df: {(r.query_id, r.id) for r in df.collect()}
    want = pairs(exact)
    return len(pairs(near) & want) / len(want)


def test_recall_upsert_delete_and_reuse(spark, tmp_path, monkeypatch):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = v.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    index = vector_index.VectorIndex.create(v, str(tmp_path / "i"))
    cells = len(index.model.centres)
    assert 40 <= cells <= 50
    near = index.search(q, 10, nprobe=cells // 4)
    assert recall(near, vectors.knn(q, v, 10)) >= 0.95

    # the stored index serves another session object, without a fit, after changes; large cells are split
    monkeypatch.setattr(vector_index.Quantiser, "fit", None)
    monkeypatch.setattr(vector_index, "CELL_ROWS", 60)
    monkeypatch.setattr(vector_index, "CELL_QUESTIONS", 7)
    again = vector_index.VectorIndex(spark, str(tmp_path / "i"))
    moved = v.where("id % 7 = 1").select("id", F.reverse("embedding").alias("embedding"))
    again.upsert(moved, 1)
    again.delete(v.where("id % 5 = 0").select("id"), 2)
    new = spark.createDataFrame([(10**6 + i, np.eye(64)[i].tolist()) for i in range(5)] + [(10**6 + 9, None)], "id long, embedding array<float>")
    again.upsert(new, 3)
    now = v.where("id % 7 <> 1").unionByName(moved).where("id % 5 <> 0").unionByName(new)
    assert again.live().count() == now.where("embedding is not null").count()
    # recall is counted over the questions that exact search answers too
    assert recall(again.search(q, 10, nprobe=cells // 4), vectors.knn(q, now, 10)) >= 0.95


def test_copies_and_unusable_vectors(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(1000 + i, rng.normal(size=3).tolist()) for i in range(100)]
    bad = [(5000, None), (5001, [0.0, 0.0, 0.0]), (5002, [None, 1.0, 1.0]), (5003, [float("nan")] * 3), (5004, [1.0])]
    v = spark.createDataFrame(rows + bad, "id long, embedding array<double>")
    index = vector_index.VectorIndex.create(v, str(tmp_path / "i"))
    q = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [0.5, 0.5, -1.0]), (3, None), (4, [1.0])], "query_id long, embedding array<double>")
    got = index.search(q, 5).collect()
    assert {r.query_id for r in got} == {1, 2} and all(r.id < 5000 for r in got)
    assert sum(r.query_id == 1 and r.id < 300 for r in got) == 5
