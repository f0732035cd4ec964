"""Provenance repair: which source a chunk came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trilayer.functions.text import basename, hash_id, preview


def chunk_sources(chunks: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, chunk_ids, length, preview) of (source, chunk_order, content), and sources whose count differs from (source, n)."""
    row = F.struct("chunk_order", hash_id(F.trim("content"), "chunk-").alias("id"), "content")
    m = chunks.groupBy("source").agg(F.array_sort(F.collect_list(row)).alias("r"))
    m = m.select("source", F.transform("r", lambda x: x["id"]).alias("chunk_ids"), F.aggregate("r", F.lit(0), lambda s, x: s + F.length(x["content"])).alias("length"), preview(F.col("r")[0]["content"]).alias("preview"))
    off = m.join(expected, "source", "full_outer").where(~F.size("chunk_ids").eqNullSafe(F.col("n"))).select("source")
    return m, off


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def stem_key(text: Column) -> Column:
    """Lower-case letters and digits of a name."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " ")


def match_sources(stems: DataFrame, files: DataFrame) -> DataFrame:
    """(stem, file_path, outcome): exact stem first, else its folded key; several files: ambiguous; none: missing.

    Files that no stem claims are orphans (null stem).
    """
    f = files.select("file_path", stem(F.col("file_path")).alias("fs")).withColumn("fk", F.trim(stem_key(F.col("fs"))))
    s = stems.select("stem").distinct().withColumn("sk", F.trim(stem_key(F.col("stem"))))
    exact = s.join(f, F.col("stem") == F.col("fs")).select("stem", "file_path", F.lit(0).alias("prio"))
    loose = s.join(f, F.col("sk") == F.col("fk")).select("stem", "file_path", F.lit(1).alias("prio"))
    c = exact.unionByName(loose)
    best = c.withColumn("b", F.min("prio").over(Window.partitionBy("stem"))).where("prio = b").groupBy("stem").agg(F.min("file_path").alias("file_path"), F.count_distinct("file_path").alias("n"))
    out = s.join(best, "stem", "left").select("stem", F.when(F.col("n") == 1, F.col("file_path")).alias("file_path"), F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("matched").alias("outcome"))
    orphan = f.join(c.select("file_path"), "file_path", "left_anti").select(F.lit(None).cast("string").alias("stem"), "file_path", F.lit("orphan").alias("outcome"))
    return out.unionByName(orphan)


def overlap(regenerated: DataFrame, graph_ids: DataFrame, least: float = 0.9) -> DataFrame:
    """(coverage, fidelity, ok) of two sets of chunk ids."""
    r, g = regenerated.select("chunk_id").distinct(), graph_ids.select("chunk_id").distinct()
    j = r.withColumn("a", F.lit(1)).join(g.withColumn("b", F.lit(1)), "chunk_id", "full_outer")
    both = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    o = j.agg(F.coalesce(both / F.nullif(F.count("b"), F.lit(0)), F.lit(0.0)).alias("coverage"), F.coalesce(both / F.nullif(F.count("a"), F.lit(0)), F.lit(0.0)).alias("fidelity"))
    return o.withColumn("ok", (F.col("coverage") >= least) & (F.col("fidelity") >= least))


def build_status(sources: DataFrame, matched: DataFrame, created_at: int) -> DataFrame:
    """Processed records of matched sources."""
    m = sources.join(matched.where("outcome = 'matched'").select(F.col("stem").alias("source"), "file_path"), "source")
    return m.select(hash_id(F.col("file_path"), "doc-").alias("doc_id"), F.lit("processed").alias("status"), "file_path", F.col("preview").alias("content_summary"), F.col("length").alias("content_length"), "chunk_ids", F.size("chunk_ids").alias("chunk_count"), F.lit(created_at).cast("long").alias("created_at"))
