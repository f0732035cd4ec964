"""Registered queries: each applies one operator to its whole table.

They add nothing but the digest columns that their contract names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trilayer.llm import ball_tree, conversations, decontam, embedding_join, exact_dedup, kneser_ney, license_join, line_dedup, mixing, ngram_join, pii_crf, quality, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.label(docs, ngram_join.join(docs))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = kneser_ney.count(docs.where(~kneser_ney.held_out(F.col("doc_id"))))
    scored = kneser_ney.score(docs, model)
    out = kneser_ney.held_out(F.col("doc_id")).alias("held_out")
    return scored.select("doc_id", out, "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", F.col("lm_score").alias("score"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.join(_table(spark, sf_dir, "embeddings"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs, short=True).select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontam.mark(docs, _table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        "n_words",
        decontam.hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontam.contaminated().alias("contaminated"),
    )


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.collapse(_table(spark, sf_dir, "conversations"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_crf.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("pii", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii_crf.KINDS], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_join.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.col(x)["label"] for x in c]))), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.col("places")["word"]).alias("first_word"),
        F.array_max(F.col("places")["word"]).alias("last_word"),
        labels("places").alias("base_labels"),
        labels("places", "matches", "spans").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.concat(F.col("matches")["containment"], F.col("spans")["containment"])), F.lit(0.0))).alias("score"),
    )


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(exact_dedup.normalised(F.col("text")), 256))
    return exact_dedup.dedup(docs, carry=("text_sha256",)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return white.select("vec_id", "component", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "whitened", "explained", "identity_error")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_lm_scoring, op3_source_mixing, op4_embedding_near_dedup, op5_line_dedup, op6_benchmark_decontamination, op7_quality_classifier, op8_chat_formatting, op9_pii, op10_license_scan, op11_exact_dedup, op12_lexical_search, op13_embedding_whitening)}
