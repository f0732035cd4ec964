"""Document administration over doc_status (doc_id, status, file_path, ...) and doc_chunk (doc_id, chunk_id, pos)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# States of a document.
STATUSES = ["pending", "parsing", "processing", "processed", "failed"]


def split_duplicates(files: DataFrame, doc_status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, duplicates) of files with a content-hash doc_id; of equal new files the smallest path is new."""
    known = doc_status.select("doc_id")
    first = Window.partitionBy("doc_id").orderBy("file_path")
    f = files.withColumn("_n", F.row_number().over(first))
    new = f.where("_n = 1").join(known, "doc_id", "left_anti").drop("_n")
    dup = f.where("_n > 1").join(known, "doc_id", "left_anti").drop("_n").unionByName(files.join(known, "doc_id", "left_semi"))
    return new, dup


def list_docs(doc_status: DataFrame, status: str | None, limit: int, offset: int = 0) -> DataFrame:
    """A page in (created_at, doc_id) order with total and next_offset (null at the end)."""
    d = doc_status if status is None else doc_status.where(F.col("status") == status)
    total = d.agg(F.count("*").alias("total"))
    page = d.orderBy("created_at", "doc_id").offset(offset).limit(limit)
    more = F.when(F.col("total") > offset + limit, F.lit(offset + limit))
    return page.crossJoin(F.broadcast(total)).withColumn("next_offset", more)


def doc_chunks(doc_chunk: DataFrame, chunks: DataFrame, doc_id: str, limit: int, offset: int = 0) -> DataFrame:
    """Chunks of one document in order; ones without text are skipped."""
    c = doc_chunk.where((F.col("doc_id") == doc_id) & F.col("pos").between(offset, offset + limit - 1))
    return c.join(chunks.select("chunk_id", "content"), "chunk_id").where("content is not null").orderBy("pos")


def refcounts(doc_status: DataFrame, doc_chunk: DataFrame, exclude: DataFrame) -> DataFrame:
    """How many processed documents hold each chunk."""
    live = doc_status.where("status = 'processed'").select("doc_id").join(exclude.select("doc_id"), "doc_id", "left_anti")
    return doc_chunk.join(live, "doc_id", "left_semi").select("doc_id", "chunk_id").distinct().groupBy("chunk_id").agg(F.count("*").alias("refs"))


def delete_docs(doc_status: DataFrame, doc_chunk: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_status, doc_chunk, report): per id, chunks dropped and shared, or not_found."""
    left = refcounts(doc_status, doc_chunk, ids).select("chunk_id", F.lit(1).alias("_shared"))
    own = doc_chunk.join(ids.select("doc_id"), "doc_id", "left_semi").select("doc_id", "chunk_id").distinct().join(left, "chunk_id", "left")
    counts = own.groupBy("doc_id").agg(F.count_if(F.col("_shared").isNull()).alias("dropped"), F.count_if(F.col("_shared").isNotNull()).alias("shared"))
    known = doc_status.select("doc_id", F.lit("deleted").alias("outcome"))
    report = ids.select("doc_id").distinct().join(known, "doc_id", "left").join(counts, "doc_id", "left")
    report = report.select("doc_id", F.coalesce("outcome", F.lit("not_found")).alias("outcome"), F.coalesce("dropped", F.lit(0)).alias("dropped"), F.coalesce("shared", F.lit(0)).alias("shared"))
    gone = ids.select("doc_id")
    return doc_status.join(gone, "doc_id", "left_anti"), doc_chunk.join(gone, "doc_id", "left_anti"), report


def requeue(doc_status: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Failed or stuck documents (or the given failed or pending ones) become pending; where they were is kept."""
    if ids is None:
        hit = F.col("status").isin("parsing", "processing")
        d = doc_status
    else:
        d = doc_status.join(ids.select("doc_id", F.lit(True).alias("_hit")).distinct(), "doc_id", "left")
        hit = F.coalesce("_hit", F.lit(False)) & F.col("status").isin("failed", "pending")
    d = d.withColumn("recovered_from", F.when(hit, F.col("status"))).withColumn("requeued", hit)
    return d.withColumn("status", F.when(hit, F.lit("pending")).otherwise(F.col("status"))).drop("_hit")


def requeued_chunks(doc_chunk: DataFrame, requeued: DataFrame) -> DataFrame:
    """``doc_chunk`` without the chunks of documents that ``requeue`` took out of the middle of their work.

    A worker that died may have recorded chunks it never installed; the retry
    derives them anew.
    """
    torn = requeued.where(F.col("requeued") & F.col("recovered_from").isin("parsing", "processing"))
    return doc_chunk.join(torn.select("doc_id"), "doc_id", "left_anti")


def process_summary(doc_status: DataFrame) -> DataFrame:
    """(status, n, doc_id): processed and failed documents, each with the number of its state."""
    d = doc_status.where(F.col("status").isin("processed", "failed"))
    return d.join(F.broadcast(d.groupBy("status").agg(F.count("*").alias("n"))), "status").select("status", "n", "doc_id")  # two rows


def search_docs(doc_status: DataFrame, term: str, limit: int = 50) -> DataFrame:
    """Distinct paths that hold a term, whatever its case."""
    return doc_status.where(F.contains(F.lower("file_path"), F.lit(term.lower()))).select("file_path").distinct().orderBy("file_path").limit(limit)


def read_document(doc_status: DataFrame, doc_chunk: DataFrame, passages: DataFrame, path: str) -> DataFrame:
    """Passages of documents with exactly this path, or whose path ends in it as a whole name."""
    d = doc_status.where((F.col("file_path") == path) | F.endswith("file_path", F.lit("/" + path)))
    c = doc_chunk.join(d.select("doc_id", "file_path"), "doc_id")
    return c.join(passages.withColumnRenamed("passage_id", "chunk_id"), "chunk_id").select("file_path", "pos", "chunk_id", "content").orderBy("file_path", "pos")
