"""Stuck documents are requeued when the watermark passes their timeout."""

from datetime import datetime, timedelta

from trilayer.streaming import intake

START = datetime(2024, 1, 1)


def test_timers_fire_once_and_start_anew(spark, tmp_path):
    src, seen = str(tmp_path / "in"), []
    at = lambda m: START + timedelta(minutes=m)
    batches = [
        [("a", "parsing", at(0)), ("b", "processing", at(1)), ("c", "processed", at(1)), ("d", "parsing", at(2)), ("d", "processed", at(3))],
        [("b", "processed", at(5)), ("z", "pending", at(30))],  # the watermark now stands at 25 minutes
        [("z", "pending", at(31))],
        [("z", "pending", at(60))],
        [("a", "processing", at(61)), ("z", "pending", at(62))],
        [("z", "pending", at(100))],
        [("z", "pending", at(101))],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "doc_id string, status string, ts timestamp").coalesce(1).write.parquet(f"{src}/{k}")
    s = spark.readStream.schema("doc_id string, status string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{src}/*").withWatermark("ts", "5 minutes")
    q = intake.stream_status(s, 20 * 60 * 1000).writeStream.foreachBatch(lambda b, k: seen.extend(b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "saved"))
    q.trigger(availableNow=True).start().awaitTermination()
    assert [(r.doc_id, r.recovered_from) for r in seen if r.recovered_from] == [("a", "parsing"), ("a", "processing")]
    last = {r.doc_id: r.status for r in seen}
    assert last == {"a": "pending", "b": "processed", "c": "processed", "d": "processed", "z": "pending"}
