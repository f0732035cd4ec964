"""Corpus selection and incremental maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilayer.operators.keyed import upsert


def corpus_chunks(doc_status: DataFrame, doc_chunk: DataFrame, cache: DataFrame, batch: DataFrame, exclude: DataFrame) -> DataFrame:
    """Chunk ids of the corpus.

    Chunks of processed documents, the current batch and cached chunks that no
    document claims, without chunks that only excluded documents hold.
    """
    live = doc_chunk.join(doc_status.where("status = 'processed'").select("doc_id"), "doc_id", "left_semi").join(exclude.select("doc_id"), "doc_id", "left_anti")
    orphan = cache.select("chunk_id").join(doc_chunk.select("chunk_id"), "chunk_id", "left_anti")
    return live.select("chunk_id").union(batch.select("chunk_id")).union(orphan).distinct()


def diff_ids(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """(id, change): added, orphan or kept."""
    o, n = old.select(F.col(key).alias("_o")).distinct(), new.select(F.col(key).alias("_n")).distinct()
    j = o.join(n, F.col("_o") == F.col("_n"), "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "orphan").otherwise("kept")
    return j.select(F.coalesce("_o", "_n").alias(key), change.alias("change"))


def refresh_edges(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges with added or overwritten ones; a pair has no direction."""
    pair = lambda e: e.withColumn("_k", F.concat_ws("\x01", F.least("src", "dst"), F.greatest("src", "dst"), "type"))
    e = pair(edges).withColumn("_v", F.lit(0))
    return upsert(e, pair(changes).withColumn("_v", F.lit(1)), "_k", "_v").drop("_k", "_v")
