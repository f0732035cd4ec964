"""Continuous intake on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trilayer.functions.text import hash_id


# States in which a document can get stuck.
UNFINISHED = ("parsing", "processing")


def stream_intake(docs: DataFrame, ts: str = "ts", text_col: str = "text", delay: str = "1 hour") -> DataFrame:
    """Streaming documents with a content-hash id, each content once within the watermark."""
    d = docs.withColumn("doc_id", hash_id(F.col(text_col), "doc-")).withWatermark(ts, delay)
    return d.dropDuplicatesWithinWatermark(["doc_id"])


def stream_latency(events: DataFrame, width: str = "1 day", delay: str = "1 day", ts: str = "ts", col: str = "value") -> DataFrame:
    """Tumbling windows of a request log: requests, mean and approximate percentiles."""
    e = events.withWatermark(ts, delay) if events.isStreaming else events
    w = e.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), F.avg(col).alias("mean"), F.percentile_approx(col, F.lit(0.95)).alias("p95"), F.max(col).alias("max"))
    return w.select(F.col("w.start").alias("window_start"), "n", "mean", "p95", "max")


class StuckDocuments(StatefulProcessor):
    """Keeps the latest (status, time) of a document; an unfinished one has a timer that requeues it.

    Of events with one time the greater status counts; an event older than what
    is kept changes nothing.  When the watermark passes the time of the last
    event plus the timeout, the document becomes pending, once; an event after
    that starts it anew.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "status string, at long")

    def _row(self, key: tuple, status: str, was: str | None) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": [key[0]], "status": [status], "recovered_from": pd.array([was], dtype=object)})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        status, at = self.last.get() if self.last.exists() else (None, -1)
        for b in rows:
            ms = b["ts"].astype("datetime64[ms]").astype("int64")
            for new_at, new in zip(ms, b["status"], strict=True):
                if (new_at, new or "") >= (at, status or ""):
                    status, at = new, int(new_at)
        self.last.update((status, at))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if status in UNFINISHED:
            self.handle.registerTimer(at + self.timeout_ms)
        yield self._row(key, status, None)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        if self.last.exists():
            was, at = self.last.get()
            if was in UNFINISHED:
                self.last.update(("pending", at))
                yield self._row(key, "pending", was)

    def close(self) -> None:
        pass


def stream_status(events: DataFrame, timeout_ms: int) -> DataFrame:
    """Status changes of (doc_id, status, ts, with a watermark on ts): (doc_id, status, recovered_from).

    A document that stays parsing or processing past the timeout comes out as
    pending, recovered_from naming where it was stuck.  State is kept by key in
    Spark's RocksDB store, which this sets for the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.select("doc_id", "status", "ts").groupBy("doc_id")
    return rows.transformWithStateInPandas(StuckDocuments(timeout_ms), "doc_id string, status string, recovered_from string", "Update", "EventTime")


def stream_index(chunks: DataFrame, state_path: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame]):  # noqa: ANN201
    """Extract each micro-batch's new chunks and append them, once per batch id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["chunk_id"])
        try:
            known = spark.read.parquet(state_path).where(F.col("batch_id") != batch_id).select("chunk_id")
            new = new.join(known, "chunk_id", "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        extract(new).write.mode("overwrite").parquet(f"{state_path}/batch_id={batch_id}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
