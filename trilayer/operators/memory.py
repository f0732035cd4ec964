"""Three-layer memory: facts, passages and schemas, with content-hash ids.

Of several spellings of one canonical key the first in (chunk_id, pos) order is
displayed.  Fact ids hash the canonical key, so they don't depend on spelling.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trilayer.functions.canonical import canonical
from trilayer.functions.session import materialise
from trilayer.functions.text import hash_id, packed, unpacked

KEYS = ["head_key", "rel_key", "tail_key"]


@dataclass(frozen=True)
class Memory:
    """facts, passages, links (fact_id, passage_id) and schemas."""

    facts: DataFrame
    passages: DataFrame
    links: DataFrame
    schemas: DataFrame | None = None

    def with_(self, **changes: DataFrame) -> Memory:
        return replace(self, **changes)


def triple_id(prefix: str, *keys: Column) -> Column:
    return hash_id(F.concat_ws("\x01", *keys), prefix)


def fact_id() -> Column:
    return triple_id("fact-", *[F.col(k) for k in KEYS])


def _fact_key() -> Column:
    """``fact_id`` packed: shuffles hold half of its bytes."""
    return F.concat(F.lit(b"\x00"), F.unhex(F.md5(F.concat_ws("\x01", *KEYS))))


def grouped_facts(keyed: DataFrame, *more: Column) -> DataFrame:
    """(_fact, t: labels, keys, ...) of each canonical triple; ``more`` are further aggregates."""
    first = F.min_by(F.struct("head", "relation", "tail"), F.struct("chunk_id", "pos"))
    return keyed.groupBy(_fact_key().alias("_fact")).agg(first.alias("t"), *[F.first(k).alias(k) for k in KEYS], *more)


def dedup_facts(keyed: DataFrame) -> DataFrame:
    """One fact for each canonical triple of (chunk_id, pos, head, relation, tail, keys)."""
    return grouped_facts(keyed).select(unpacked(F.col("_fact"), "fact-").alias("fact_id"), "t.head", "t.relation", "t.tail", *KEYS)


def dedup_passages(chunks: DataFrame) -> DataFrame:
    """One passage for each chunk id, also of chunks without triples."""
    p = chunks.groupBy(packed(F.col("chunk_id"), "chunk-").alias("_chunk")).agg(F.min("content").alias("content"))
    return p.select(unpacked(F.col("_chunk"), "chunk-").alias("passage_id"), "content", F.lit("text").alias("modality"))


def fact_passage(keyed: DataFrame) -> DataFrame:
    pairs = keyed.select(_fact_key().alias("_fact"), packed(F.col("chunk_id"), "chunk-").alias("_chunk")).distinct()
    return pairs.select(unpacked(F.col("_fact"), "fact-").alias("fact_id"), unpacked(F.col("_chunk"), "chunk-").alias("passage_id"))


def links_per_fact(links: DataFrame) -> DataFrame:
    return links.groupBy(packed(F.col("fact_id"), "fact-").alias("_fact")).agg(F.count("*").alias("frequency"))


def fact_frequency(facts: DataFrame, links: DataFrame) -> DataFrame:
    f = facts.drop("frequency").withColumn("fact_id", packed(F.col("fact_id"), "fact-")).withColumnRenamed("fact_id", "_fact")
    out = f.join(links_per_fact(links), "_fact", "left").fillna(0, ["frequency"])
    return out.select(unpacked(F.col("_fact"), "fact-").alias("fact_id"), *[c for c in out.columns if c != "_fact"])


def build(keyed: DataFrame, chunks: DataFrame) -> Memory:
    """Untyped memory of keyed triples and chunks."""
    links = fact_passage(keyed)
    facts = fact_frequency(dedup_facts(keyed), links)
    facts = facts.withColumn("schema_id", F.lit(None).cast("string")).withColumn("active", F.lit(True))
    return Memory(facts, dedup_passages(chunks), links)


def facts_of_schema(mem: Memory, schemas: DataFrame) -> DataFrame:
    return schemas.select("schema_id").join(mem.facts, "schema_id", "left")


def passages_of_fact(mem: Memory, facts: DataFrame) -> DataFrame:
    return facts.select("fact_id").join(mem.links, "fact_id", "left")


def facts_of_passage(mem: Memory, passages: DataFrame) -> DataFrame:
    return passages.select("passage_id").join(mem.links, "passage_id", "left")


def schema_of_fact(mem: Memory, facts: DataFrame) -> DataFrame:
    return facts.select("fact_id").join(mem.facts.select("fact_id", "schema_id"), "fact_id", "left")


def remove_facts(mem: Memory, gone: DataFrame) -> Memory:
    """Without the facts and their links; schema frequencies follow."""
    ids = gone.select("fact_id")
    facts = mem.facts.join(ids, "fact_id", "left_anti")
    out = mem.with_(facts=facts, links=mem.links.join(ids, "fact_id", "left_anti"))
    if mem.schemas is None:
        return out
    n = facts.where("schema_id is not null").groupBy("schema_id").agg(F.count("*").alias("frequency"))
    return out.with_(schemas=mem.schemas.drop("frequency").join(n, "schema_id", "left").fillna(0, ["frequency"]))


def replace_facts(mem: Memory, rewrites: DataFrame) -> Memory:
    """Rename facts by (fact_id, head, relation, tail); one that meets an existing key merges into it.

    Passages are united; an untyped target inherits the smallest schema of its sources.
    """
    r = canonical(rewrites, {"head": "head_key", "relation": "rel_key", "tail": "tail_key"})
    r = materialise(r.select(F.col("fact_id").alias("old"), fact_id().alias("new"), "head", "relation", "tail", *KEYS))
    old = mem.facts.join(r.select(F.col("old").alias("fact_id"), F.col("new")), "fact_id")
    schema = old.groupBy("new").agg(F.min("schema_id").alias("given"))
    named = r.groupBy("new").agg(F.min_by(F.struct("head", "relation", "tail", *KEYS), "old").alias("t"))
    kept = mem.facts.join(r.select(F.col("old").alias("fact_id")), "fact_id", "left_anti")
    fresh = named.join(kept.select(F.col("fact_id").alias("new")), "new", "left_anti").join(old.select("new").distinct(), "new")
    fresh = fresh.select(F.col("new").alias("fact_id"), "t.head", "t.relation", "t.tail", *[f"t.{k}" for k in KEYS], F.lit(0).cast("long").alias("frequency"), F.lit(None).cast("string").alias("schema_id"), F.lit(True).alias("active"))
    facts = kept.unionByName(fresh).join(schema.withColumnRenamed("new", "fact_id"), "fact_id", "left")
    facts = facts.withColumn("schema_id", F.coalesce("schema_id", "given")).drop("given")
    links = mem.links.join(r.select(F.col("old").alias("fact_id"), "new"), "fact_id", "left")
    links = links.select(F.coalesce("new", "fact_id").alias("fact_id"), "passage_id").distinct()
    return mem.with_(facts=fact_frequency(facts, links), links=links)


def add_facts(mem: Memory, keyed: DataFrame) -> Memory:
    """Create or reuse facts of keyed triples (with an optional schema_id) and unite their links."""
    new = dedup_facts(keyed)
    has = "schema_id" in keyed.columns
    typed = keyed.select(fact_id().alias("fact_id"), (F.col("schema_id") if has else F.lit(None).cast("string")).alias("given")).groupBy("fact_id").agg(F.min("given").alias("given"))
    fresh = new.join(mem.facts.select("fact_id"), "fact_id", "left_anti").select("*", F.lit(0).cast("long").alias("frequency"), F.lit(None).cast("string").alias("schema_id"), F.lit(True).alias("active"))
    facts = mem.facts.unionByName(fresh).join(typed, "fact_id", "left")
    facts = facts.withColumn("schema_id", F.coalesce("schema_id", "given")).drop("given")
    links = mem.links.union(fact_passage(keyed)).distinct()
    return mem.with_(facts=fact_frequency(facts, links), links=links)


def summary(mem: Memory) -> DataFrame:
    """(metric, value) of the three layers."""
    per_fact = mem.links.groupBy("fact_id").agg(F.count("*").alias("n"))
    per_passage = mem.links.groupBy("passage_id").agg(F.count("*").alias("n"))
    parts = [
        mem.facts.agg(F.count("*").cast("double").alias("facts"), F.count_if("active").cast("double").alias("active_facts")),
        mem.passages.agg(F.count("*").cast("double").alias("passages")),
        per_fact.agg(F.avg("n").alias("passages_per_fact")),
        per_passage.agg(F.avg("n").alias("facts_per_passage")),
    ]
    if mem.schemas is not None:
        parts.append(mem.schemas.agg(F.count("*").cast("double").alias("schemas"), F.min("frequency").cast("double").alias("schema_frequency_min"), F.max("frequency").cast("double").alias("schema_frequency_max"), F.avg("frequency").alias("schema_frequency_avg")))
    rows = [p.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in p.columns])).alias("s")).select("s.*") for p in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def entity_surfaces(extracted: DataFrame, facts: DataFrame) -> DataFrame:
    """Distinct canonical entities of extraction records (entity_key) and fact endpoints."""
    ends = facts.select(F.explode(F.array("head_key", "tail_key")).alias("entity_key"))
    return extracted.select("entity_key").union(ends).where("entity_key <> ''").distinct()


def save(mem: Memory, path: str) -> None:
    """One Parquet table for each layer."""
    for name in ("facts", "passages", "links", "schemas"):
        if (df := getattr(mem, name)) is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark, path: str) -> Memory:  # noqa: ANN001
    """What ``save`` wrote; a passage without a modality is text."""
    read = lambda n: spark.read.parquet(f"{path}/{n}")
    return Memory(read("facts"), read("passages").fillna("text", ["modality"]), read("links"), read("schemas"))
