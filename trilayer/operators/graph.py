"""The typed, weighted graph over the three layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trilayer.functions.text import hash_id, packed, unpacked
from trilayer.operators.memory import Memory

NODE = ["node_id", "label", "content"]
EDGE = ["src", "dst", "type", "weight", "relations"]


def _entity(col: str):  # noqa: ANN202
    return hash_id(F.col(col), "entity-")


def _edges(df: DataFrame, kind: str, weight="1.0", relations: str = "cast(null as array<string>)") -> DataFrame:  # noqa: ANN001
    w = F.expr(weight) if isinstance(weight, str) else weight
    return df.select("src", "dst", F.lit(kind).alias("type"), w.cast("double").alias("weight"), F.expr(relations).alias("relations"))


def active(facts: DataFrame) -> DataFrame:
    return facts.where("active")


def layer_nodes(mem: Memory) -> DataFrame:
    """Passage, Schema and Fact nodes (active facts only)."""
    p = mem.passages.select(F.col("passage_id").alias("node_id"), F.lit("Passage").alias("label"), "content")
    line = lambda *c: F.concat_ws(" ", *c)
    f = active(mem.facts).select(F.col("fact_id").alias("node_id"), F.lit("Fact").alias("label"), line("head", "relation", "tail").alias("content"))
    s = mem.schemas.select(F.col("schema_id").alias("node_id"), F.lit("Schema").alias("label"), line("head_type", "relation", "tail_type").alias("content"))
    return p.unionByName(s).unionByName(f)


def type_nodes(schemas: DataFrame) -> DataFrame:
    t = schemas.select(F.explode(F.array("head_type_key", "tail_type_key")).alias("content")).distinct()
    return t.select(hash_id(F.col("content"), "type-").alias("node_id"), F.lit("Type").alias("label"), "content")


def entity_nodes(facts: DataFrame) -> DataFrame:
    e = active(facts).select(F.explode(F.array("head_key", "tail_key")).alias("content")).distinct()
    return e.select(_entity("content").alias("node_id"), F.lit("Entity").alias("label"), "content")


def type_relations(schemas: DataFrame) -> DataFrame:
    """One edge for each unordered pair of types; of several schemas the greatest id gives relation and weight."""
    a, b = hash_id(F.col("head_type_key"), "type-"), hash_id(F.col("tail_type_key"), "type-")
    last = F.max_by(F.struct("relation", F.greatest(F.lit(1), "frequency").alias("w")), "schema_id")
    e = schemas.groupBy(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).agg(last.alias("t"))
    return _edges(e, "TYPE_RELATION", F.col("t.w"), "array(t.relation)")


def _short(col: str):  # noqa: ANN202
    """``hash_id`` packed, for what is shuffled."""
    return F.concat(F.lit(b"\x00"), F.unhex(F.md5(F.col(col))))


def _named(df: DataFrame, **prefixes: str) -> DataFrame:
    """``df`` with packed ids as text again."""
    return df.withColumns({c: unpacked(F.col(c), p) for c, p in prefixes.items()})


def entity_relations(facts: DataFrame) -> DataFrame:
    """One edge for each unordered pair of entities: number of facts, the first eight relations by fact id."""
    a, b = _short("head_key"), _short("tail_key")
    f = active(facts).where("head_key <> tail_key")
    rn = Window.partitionBy("src", "dst").orderBy("fact_id")
    f = f.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), "fact_id", "relation").withColumn("n", F.row_number().over(rn))
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= 8, F.struct("n", "relation")))), lambda x: x["relation"])
    e = f.groupBy("src", "dst").agg(F.count("*").alias("w"), first.alias("r"))
    return _edges(_named(e, src="entity-", dst="entity-"), "ENTITY_RELATION", F.col("w"), "r")


def entity_passage_map(facts: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct (entity_id, passage_id) of active facts."""
    f = active(facts).select(packed(F.col("fact_id"), "fact-").alias("f"), F.array(_short("head_key"), _short("tail_key")).alias("e"))
    p = f.join(links.select(packed(F.col("fact_id"), "fact-").alias("f"), packed(F.col("passage_id"), "chunk-").alias("passage_id")), "f")
    return _named(p.select(F.explode("e").alias("entity_id"), "passage_id").distinct(), entity_id="entity-", passage_id="chunk-")


def mentions(keyed: DataFrame) -> DataFrame:
    """``entity_passage_map`` of the memory that holds these keyed triples and no others, all active."""
    p = keyed.select(F.explode(F.array(_short("head_key"), _short("tail_key"))).alias("entity_id"), packed(F.col("chunk_id"), "chunk-").alias("passage_id"))
    return _named(p.distinct(), entity_id="entity-", passage_id="chunk-")


def entity_passages(facts: DataFrame, links: DataFrame) -> DataFrame:
    return _edges(entity_passage_map(facts, links).toDF("src", "dst"), "PASSAGE_ENTITY")


def fact_passages(facts: DataFrame, links: DataFrame) -> DataFrame:
    p = links.select(packed(F.col("fact_id"), "fact-").alias("src"), packed(F.col("passage_id"), "chunk-").alias("dst"))
    p = p.join(active(facts).select(packed(F.col("fact_id"), "fact-").alias("src")), "src", "left_semi")
    return _edges(_named(p, src="fact-", dst="chunk-"), "FACT_PASSAGE")


def fact_schemas(facts: DataFrame) -> DataFrame:
    return _edges(active(facts).where("schema_id is not null").select("fact_id", "schema_id").toDF("src", "dst"), "FACT_SCHEMA")


def entity_types(facts: DataFrame, schemas: DataFrame) -> DataFrame:
    """Typed endpoints; an edge weighs one over the members of the type."""
    f = active(facts).join(schemas.select("schema_id", "head_type_key", "tail_type_key"), "schema_id")
    ends = f.select(F.explode(F.array(F.struct(_short("head_key").alias("e"), F.col("head_type_key").alias("t")), F.struct(_short("tail_key").alias("e"), F.col("tail_type_key").alias("t")))).alias("x"))
    pairs = ends.select("x.e", "x.t").distinct().select(unpacked(F.col("e"), "entity-").alias("src"), hash_id(F.col("t"), "type-").alias("dst"))
    members = pairs.groupBy("dst").agg(F.count("*").alias("m"))
    return _edges(pairs.join(members, "dst"), "ENTITY_TO_TYPE", 1 / F.col("m"))


def density(pairs: DataFrame, passages: DataFrame) -> DataFrame:
    """Information density of each passage, in (0, 1).

    Sum over its entities of ln(N / (1 + df)) + 1, over ln(entities + 1); then a
    logistic scale around the mean of the non-zero values.
    """
    df = pairs.groupBy("entity_id").agg(F.count("*").alias("df"))
    total = passages.agg(F.count("*").alias("n_all"))
    own = pairs.join(df, "entity_id").crossJoin(F.broadcast(total))  # one row
    x = own.groupBy("passage_id").agg((F.sum(F.log(F.col("n_all") / (1 + F.col("df"))) + 1) / F.log(F.count("*") + F.lit(1.0))).alias("x"))
    x = passages.select("passage_id").join(x, "passage_id", "left").fillna(0.0, ["x"])
    some = F.when(F.col("x") != 0, F.col("x"))
    stats = x.agg(F.avg(some).alias("mean"), F.count(some).alias("n"), (F.max(some) - F.min(some)).alias("range"))
    spread = F.when(F.col("n") <= 1, F.lit(1.0)).otherwise(F.greatest(F.lit(1e-6), F.col("range") / 4))
    z = (F.col("x") - F.coalesce("mean", F.lit(0.0))) / spread
    return x.crossJoin(F.broadcast(stats)).select("passage_id", (1 / (1 + F.exp(-z))).alias("density"))


def build_nodes(mem: Memory) -> DataFrame:
    return layer_nodes(mem).unionByName(type_nodes(mem.schemas)).unionByName(entity_nodes(mem.facts))


def edge_kinds(mem: Memory, pairs: DataFrame | None = None) -> list[DataFrame]:
    """The edges of each kind; ``pairs`` is the memory's ``entity_passage_map``, where there is one."""
    ep = entity_passages(mem.facts, mem.links) if pairs is None else _edges(pairs.toDF("src", "dst"), "PASSAGE_ENTITY")
    return [type_relations(mem.schemas), entity_relations(mem.facts), ep, fact_passages(mem.facts, mem.links), fact_schemas(mem.facts), entity_types(mem.facts, mem.schemas)]


def build_edges(mem: Memory) -> DataFrame:
    return reduce(DataFrame.unionByName, edge_kinds(mem))


def upsert_edges(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges by (pair, type); a zero or null weight becomes one."""
    from trilayer.operators.incremental import refresh_edges

    w = F.coalesce(F.nullif(F.col("weight"), F.lit(0.0)), F.lit(1.0))
    return refresh_edges(edges, changes.withColumn("weight", w))
