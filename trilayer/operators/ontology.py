"""Typing of facts: schemas, their links and the frequency filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trilayer.functions.text import json_object, packed, unpacked
from trilayer.operators.memory import KEYS, Memory, grouped_facts, links_per_fact, triple_id

SCHEMA_KEYS = ["head_type_key", "rel_key", "tail_type_key"]


def schema_id() -> Column:
    return triple_id("schema-", *[F.col(k) for k in SCHEMA_KEYS])


def dedup_schemas(typed: DataFrame) -> DataFrame:
    """One schema for each canonical type triple; the first spelling is displayed."""
    first = F.min_by(F.struct("head_type", "relation", "tail_type"), F.struct("chunk_id", "pos"))
    s = typed.groupBy(*SCHEMA_KEYS).agg(first.alias("t"))
    return s.select(schema_id().alias("schema_id"), "t.head_type", "t.relation", "t.tail_type", *SCHEMA_KEYS)


def link_schemas(facts: DataFrame, typed: DataFrame) -> DataFrame:
    """Facts with the schema of their last typing, by (chunk_id, pos)."""
    key = packed(F.col("fact_id"), "fact-").alias("_fact")
    last = typed.groupBy(key).agg(F.max_by(F.struct(*SCHEMA_KEYS), F.struct("chunk_id", "pos")).alias("s"))
    f = facts.drop("schema_id").select(key, *[c for c in facts.columns if c not in ("fact_id", "schema_id")])
    out = f.join(last, "_fact", "left")
    return out.select(unpacked(F.col("_fact"), "fact-").alias("fact_id"), *[c for c in f.columns if c != "_fact"], _schema_of("s").alias("schema_id"))


def _schema_of(keys: str) -> Column:
    """Id of a struct of schema keys (null: null)."""
    return F.when(F.col(keys).isNotNull(), triple_id("schema-", *[F.col(f"{keys}.{k}") for k in SCHEMA_KEYS]))


def typed_facts(keyed: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Facts of keyed triples with the schema of their last typing, grouped once; with ``links``, their frequency."""
    last = F.max_by(F.struct(*SCHEMA_KEYS), F.struct("chunk_id", "pos"))
    f = grouped_facts(keyed, last.alias("s"))
    f = f.withColumn("frequency", F.lit(None).cast("long")) if links is None else f.join(links_per_fact(links), "_fact", "left").fillna(0, ["frequency"])
    return f.select(unpacked(F.col("_fact"), "fact-").alias("fact_id"), "t.head", "t.relation", "t.tail", *KEYS, "frequency", F.lit(True).alias("active"), _schema_of("s").alias("schema_id"))


def schema_frequency(schemas: DataFrame, facts: DataFrame) -> DataFrame:
    n = facts.where("schema_id is not null").groupBy("schema_id").agg(F.count("*").alias("frequency"))
    return schemas.drop("frequency").join(n, "schema_id", "left").fillna(0, ["frequency"])


def filter_schemas(mem: Memory, least: int) -> Memory:
    """Schemas of ``least`` facts or more; facts of the others lose their type and become inactive."""
    if least <= 0:
        return mem
    kept = mem.schemas.where(F.col("frequency") >= least)
    ok = kept.select("schema_id", F.lit(True).alias("_ok"))
    facts = mem.facts.join(ok, "schema_id", "left")
    stays = F.col("schema_id").isNull() | F.col("_ok").isNotNull()
    facts = facts.withColumn("active", F.col("active") & stays).withColumn("schema_id", F.when(F.col("_ok"), F.col("schema_id"))).drop("_ok")
    return mem.with_(facts=facts, schemas=kept)


def guarded_filter(mem: Memory, least: int, most: float = 0.5) -> tuple[Memory, DataFrame]:
    """The filter, unless it would deactivate more than ``most`` of the typed facts; and (ratio, applied).

    The decision is a one-row frame joined to the layers, not a trip to the driver.
    """
    low = mem.schemas.where(F.col("frequency") < least)
    ratio = F.coalesce(F.sum("frequency"), F.lit(0)) / F.greatest(F.lit(1), F.max("_all"))
    total = mem.schemas.agg(F.coalesce(F.sum("frequency"), F.lit(0)).alias("_all"))
    report = total.join(low.select("frequency"), F.lit(True), "left").agg(ratio.alias("ratio")).withColumn("applied", (F.lit(least) > 0) & (F.col("ratio") <= most))
    done = F.broadcast(report.select("applied"))  # one row
    freq = mem.schemas.select("schema_id", "frequency")
    facts = mem.facts.join(freq.withColumnRenamed("frequency", "_f"), "schema_id", "left").crossJoin(done)
    drop = F.col("applied") & F.col("schema_id").isNotNull() & (F.coalesce("_f", F.lit(0)) < least)
    facts = facts.withColumn("active", F.col("active") & ~drop).withColumn("schema_id", F.when(~drop, F.col("schema_id"))).drop("_f", "applied")
    schemas = mem.schemas.crossJoin(done).where(~F.col("applied") | (F.col("frequency") >= least)).drop("applied")
    return mem.with_(facts=facts, schemas=schemas), report


def apply_cached_types(facts: DataFrame, cache: DataFrame) -> DataFrame:
    """(fact_id, chunk_id, pos, types) of facts whose canonical triple the cache holds."""
    return facts.select("fact_id", "head_key", "rel_key", "tail_key").join(cache, ["head_key", "rel_key", "tail_key"])


def typing_batches(facts: DataFrame, links: DataFrame, size: int = 20) -> DataFrame:
    """Untyped facts by passage, ``size`` a batch: (passage_id, batch, fact_ids)."""
    todo = facts.where("schema_id is null").select("fact_id").join(links, "fact_id")
    rn = F.row_number().over(Window.partitionBy("passage_id").orderBy("fact_id"))
    b = todo.withColumn("batch", F.ceil(rn / size).cast("int"))
    return b.groupBy("passage_id", "batch").agg(F.array_sort(F.collect_list("fact_id")).alias("fact_ids"))


def parse_types(reply: Column) -> Column:
    """(triple, types) pairs of a reply where both sides have three slots."""
    pairs = F.from_json(json_object(reply), "struct<typed:array<struct<triple:array<string>,types:array<string>>>>")["typed"]
    return F.filter(F.coalesce(pairs, F.array().cast("array<struct<triple:array<string>,types:array<string>>>")), lambda p: (F.size(p["triple"]) == 3) & (F.size(p["types"]) == 3))


def persist_types(extractions: DataFrame, typed: DataFrame) -> DataFrame:
    """Records with the type map of their chunk."""
    m = typed.groupBy("chunk_id").agg(F.array_sort(F.collect_set(F.struct("fact_id", "head_type", "relation", "tail_type"))).alias("ontology"))
    return extractions.drop("ontology").join(m, "chunk_id", "left")
