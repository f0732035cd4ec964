"""A corpus pipeline of five of the operators, applied to ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trilayer.llm import decontam, line_dedup, mixing, ngram_join, quality
from trilayer.llm._spark import cut, small

#: Columns that stages read.
READ = ("doc_id", "text", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _others_aside(stage: Stage) -> Stage:
    """Run a stage with the columns it doesn't read under names of no meaning, so that none can clash with its own.

    Common to all stages: null ids and repeated rows are rows like others, null
    and empty texts have no words or lines, texts of any length are read whole,
    and an empty table gives an empty one.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        aside = {c: c if c in READ else f"_column{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.toDF(*aside.values()), sf_dir)
        back = {v: k for k, v in aside.items()}
        return out.toDF(*[back.get(c, c) for c in out.columns])

    return run


#: No SQL expresses the learned classifier; tests hold each stage against brute force.
ORACLE_SQL = None


@_others_aside
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (probability of label 1 below one half) go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model, name="_quality")
    return scored.where(F.col("_quality") >= 0.5).select(*docs.columns)


@_others_aside
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, or lie within two edits of it, leave their text.

    A document that loses all of its words goes; n_chars follows the text.
    """
    cleaned = line_dedup.dedup(docs)
    lost = F.col("n_exact") + F.col("n_near") > 0
    cleaned = cleaned.where(~lost | (F.trim(F.translate("text", "\n\t\r", "   ")) != ""))
    return cleaned.select(*[F.when(lost, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else c for c in docs.columns])


@_others_aside
def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    joined = ngram_join.join(docs)
    # Texts that lose against another text, or of which further copies must go.
    several = joined.where((F.col("n_shingles") > 0) & ((F.col("copies") > 1) | ~F.col("id").eqNullSafe(F.col("class_id"))))
    several = small(cut(several.select("h", F.col("id").alias("_first"), F.col("id").eqNullSafe(F.col("class_id")).alias("_wins"))), 64)
    marked = docs.withColumn("h", ngram_join.text_key(F.col("text"))).join(several, "h", "left")
    kept = marked.where(F.col("_wins").isNull()).select(*docs.columns)
    first = marked.where(F.col("_wins") & F.col("doc_id").eqNullSafe(F.col("_first"))).dropDuplicates(["h"]).select(*docs.columns)
    return kept.unionByName(first)


@_others_aside
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule marks go; all others stay as they are."""
    names = ("_n_words", "_spans", "_items")
    marked = decontam.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), names=names)
    return marked.where(~decontam.contaminated("_spans", "_n_words")).select(*docs.columns)


@_others_aside
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: (doc_id, source, size, source_size, target, taken)."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is materialised in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
