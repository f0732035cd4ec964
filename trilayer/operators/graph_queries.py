"""Questions to the graph."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilayer.functions.session import materialise

#: Edges as one table, or as one for each kind.
Edges = DataFrame | list[DataFrame]


def _of_each(edges: Edges, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``ask`` of the edges; the kinds are asked one after another, and what one took of the disk is free for the next."""
    return ask(edges) if isinstance(edges, DataFrame) else reduce(DataFrame.unionByName, [materialise(ask(e)) for e in edges])


def subgraph(nodes: DataFrame, edges: Edges, label: str, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A page of nodes of one label, edges with both ends on it (four times as many at most), and whether it was cut."""
    match = nodes.where(F.lower("label") == label.lower())
    page = match.orderBy("node_id").limit(limit)
    ends = page.select("node_id") if isinstance(edges, DataFrame) else materialise(page.select("node_id"))
    e = _of_each(edges, lambda e: e.join(ends.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ends.withColumnRenamed("node_id", "dst"), "dst", "left_semi"))
    return page, e.orderBy("src", "dst", "type").limit(4 * limit), match.agg((F.count("*") > limit).alias("truncated"))


def redact(nodes: DataFrame) -> DataFrame:
    """Passage texts become their lengths."""
    text = F.concat(F.lit("["), F.length("content").cast("string"), F.lit(" characters]"))
    return nodes.withColumn("content", F.when(F.col("label") == "Passage", text).otherwise(F.col("content")))


def labels(nodes: DataFrame) -> DataFrame:
    return nodes.select("label").distinct()


def profile(nodes: DataFrame, edges: Edges) -> DataFrame:
    """(part, name, n): nodes by label and edges by type."""
    n = nodes.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).select(F.lit("node").alias("part"), "name", "n")
    return n.unionByName(_of_each(edges, lambda e: e.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("part"), "name", "n")))


def property_keys(nodes: DataFrame, sample: int = 5000) -> DataFrame:
    """Keys of a map column ``props`` in a sample of nodes."""
    return nodes.limit(sample).select(F.explode(F.map_keys("props")).alias("key")).distinct()


def key_use(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, name, key, n): how many nodes of a label, and edges of a type, hold a value for each key."""

    def one(df: DataFrame, part: str, by: str) -> DataFrame:
        keys = [c for c in df.columns if c != by]
        held = df.groupBy(F.col(by).alias("name")).agg(*[F.count(c).alias(c) for c in keys])
        each = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("n")) for c in keys])
        return held.select(F.lit(part).alias("part"), "name", F.inline(each)).where("n > 0")

    return one(nodes, "node", "label").unionByName(one(edges, "edge", "type"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def neighborhood(edges: DataFrame, node_id: str, hops: int = 1, limit: int | None = None) -> DataFrame:
    """(node_id, hop) within 1 to 3 undirected hops; an unknown node is an error."""
    if not 1 <= hops <= 3:
        raise ValueError("1 to 3 hops")
    both = _both(edges)
    if both.where(F.col("src") == node_id).isEmpty():
        raise KeyError(node_id)
    seen = both.where(F.col("src") == node_id).select(F.lit(node_id).alias("node_id"), F.lit(0).alias("hop")).limit(1)
    edge = seen
    for h in range(1, hops + 1):
        new = both.join(edge.select(F.col("node_id").alias("src")), "src").select(F.col("dst").alias("node_id")).distinct()
        edge = new.join(seen.select("node_id"), "node_id", "left_anti").withColumn("hop", F.lit(h))
        seen = seen.unionByName(edge)
    return seen.orderBy("hop", "node_id").limit(limit) if limit else seen


def neighborhood_edges(edges: DataFrame, node_id: str, hops: int = 1) -> DataFrame:
    """Edges on undirected paths of up to ``hops`` steps from a node: those with an end fewer steps away."""
    near = neighborhood(edges, node_id, hops).where(F.col("hop") < hops).select("node_id")
    src, dst = near.withColumnRenamed("node_id", "src"), near.withColumnRenamed("node_id", "dst")
    return edges.join(src, "src", "left_semi").unionByName(edges.join(src, "src", "left_anti").join(dst, "dst", "left_semi"))


def highlights(nodes: DataFrame, edges: Edges, schemas: DataFrame, k: int = 5) -> DataFrame:
    """(kind, content, n): leading entities by relations, schemas by frequency, types by use (unused ones count 0)."""
    top = lambda df: df.orderBy(F.col("n").desc(), "content").limit(k)
    rel = _of_each(edges, lambda e: e.where("type = 'ENTITY_RELATION'").select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("n")))
    ent = nodes.where("label = 'Entity'").join(rel, "node_id").select(F.lit("entity").alias("kind"), "content", "n")
    sch = schemas.select(F.lit("schema").alias("kind"), F.concat_ws(" ", "head_type", "relation", "tail_type").alias("content"), F.col("frequency").alias("n"))
    use = _of_each(edges, lambda e: e.where("type = 'ENTITY_TO_TYPE'").groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("n")))
    typ = nodes.where("label = 'Type'").join(use, "node_id", "left").select(F.lit("type").alias("kind"), "content", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return top(ent).unionByName(top(sch)).unionByName(top(typ))


def degree(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))


def get_nodes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("node_id").join(nodes, "node_id", "left").withColumn("found", F.col("label").isNotNull())


def get_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges of (a, b), whichever way they run."""
    key = lambda a, b: F.struct(F.least(a, b), F.greatest(a, b))
    return pairs.select(key("a", "b").alias("k")).distinct().join(edges.withColumn("k", key("src", "dst")), "k").drop("k")


def match(edges: DataFrame, types: list[str]) -> DataFrame:
    """Paths along directed edges of the given types: node_0, node_1, ..."""
    out = edges.where(F.col("type") == types[0]).select(F.col("src").alias("node_0"), F.col("dst").alias("node_1"))
    for k, t in enumerate(types[1:], 1):
        step = edges.where(F.col("type") == t).select(F.col("src").alias(f"node_{k}"), F.col("dst").alias(f"node_{k + 1}"))
        out = out.join(step, f"node_{k}")
    return out.select(*[f"node_{k}" for k in range(len(types) + 1)])


def graph_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges and which layers are there."""
    n = nodes.agg(F.count("*").alias("nodes"), *[(F.count_if(F.col("label") == x) > 0).alias(f"has_{x.lower()}") for x in ("Passage", "Fact", "Schema", "Entity", "Type")])
    return n.crossJoin(edges.agg(F.count("*").alias("edges")))


def truncate_props(nodes: DataFrame, most: int = 500) -> DataFrame:
    """Contents of more than ``most`` characters are cut; ``truncated`` names them."""
    long = F.length("content") > most
    return nodes.withColumn("truncated", F.when(long, F.array(F.lit("content"))).otherwise(F.array().cast("array<string>"))).withColumn("content", F.when(long, F.substring("content", 1, most)).otherwise(F.col("content")))
