"""Extraction in few jobs, and folders of many small files."""

import os
import uuid

import pytest

from trilayer.operators import extraction
from trilayer.sources import files


def test_a_killed_job_keeps_the_sub_batches_that_ended(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{i:03d}", f"text {i}") for i in range(160)], "chunk_id string, content string")
    log, path, bad = str(tmp_path / "calls"), str(tmp_path / "cache"), str(tmp_path / "broken")
    os.makedirs(log)
    open(bad, "w").close()

    def fn(b):
        open(f"{log}/{uuid.uuid4().hex}", "w").close()
        if os.path.exists(bad) and len(os.listdir(log)) > 10:
            raise OSError("the machine is gone")
        return b.assign(passage=b["content"], entities=[["e"]] * len(b), triples=[[]] * len(b), failed=False, error=None)[["chunk_id", "passage", "entities", "triples", "failed", "error"]]

    with pytest.raises(Exception, match="the machine is gone"):
        extraction.extract(chunks, path, fn, rows=8)
    kept = extraction.cached(spark, path).count()
    assert kept >= 8 * (10 - spark.sparkContext.defaultParallelism)
    os.remove(bad)
    before = len(os.listdir(log))
    assert extraction.extract(chunks, path, fn, rows=8).count() == 0
    assert extraction.cached(spark, path).count() == 160
    assert len(os.listdir(log)) - before == -(-(160 - kept) // 8)
    assert len(os.listdir(f"{path}/manifests")) < 40  # a manifest a run, not a wave


def test_small_files_are_read_in_few_tasks(spark, tmp_path):
    path, n = str(tmp_path / "texts"), 300
    spark.range(n).selectExpr("concat('text ', id) as text").write.mode("overwrite").parquet(str(tmp_path / "in"))
    files.write_texts(spark.read.parquet(str(tmp_path / "in")), path)
    assert sum(x.startswith("part-") for x in os.listdir(path)) == n and not [x for x in os.listdir(path) if os.path.isdir(f"{path}/{x}")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        read = files.read_text_corpus(spark, path, "notes")
        assert read.rdd.getNumPartitions() <= files.TASKS * spark.sparkContext.defaultParallelism
        assert {r.text for r in read.collect()} == {f"text {i}\n" for i in range(n)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
