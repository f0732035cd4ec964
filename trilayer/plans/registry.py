"""Registered queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trilayer.functions.canonical import canonical
from trilayer.functions.session import discard, materialise, scratch, stored
from trilayer.functions.text import packed, unpacked
from trilayer.operators import graph, memory, ontology

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Layers:
    """The typed memory of some tables, as ``memory.Memory``; a layer is stored when it is first read."""

    def __init__(self, tables: Tables, **own: DataFrame):
        self._tables, self._own = tables, own

    def __getattr__(self, name: str) -> DataFrame:
        if name not in ("facts", "passages", "links", "schemas"):
            raise AttributeError(name)
        return self._own[name] if name in self._own else getattr(self._tables, name)

    def with_(self, **changes: DataFrame) -> Layers:
        return Layers(self._tables, **(self._own | changes))


class Tables:
    """The given tables of one folder, and what is derived from them.

    The corpus of the graph queries: each order is a passage; its lines, customer,
    nation and region give (head, relation, tail) triples with types.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def chunks(self) -> DataFrame:
        s = lambda c: F.col(c).cast("string")
        text = F.concat(F.lit("Order "), s("o_orderkey"), F.lit(" placed by customer "), s("o_custkey"), F.lit(", status "), s("o_orderstatus"), F.lit(", priority "), s("o_orderpriority"))
        return self.orders.withColumn("content", text).withColumn("chunk_id", F.concat(F.lit("chunk-"), F.md5("content"))).select("chunk_id", "content", "o_orderkey", "o_custkey")

    @cached_property
    def triples(self) -> DataFrame:
        """One join of the orders and one of the lines; a row of it gives all of its triples."""
        o = self.chunks.select(packed(F.col("chunk_id"), "chunk-").alias("_chunk"), "o_orderkey", "o_custkey")
        c = o.join(self.customer.select("c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        r = c.join(self.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(self.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        line = self.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").join(o.drop("o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey", "o_orderkey")
        line = line.join(self.supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
        line = line.join(self.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"), "left")
        part = F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))
        spelled = F.when(F.col("o_orderkey") % 2 == 0, F.upper("n_name")).otherwise(F.lower("n_name"))

        def one(pos, head, rel: str, tail, types: tuple[str, str], there: str | None = None):  # noqa: ANN001, ANN202
            t = F.struct(pos.cast("int").alias("pos"), head.alias("head"), F.lit(rel).alias("relation"), tail.alias("tail"), F.lit(types[0]).alias("head_type"), F.lit(types[1]).alias("tail_type"))
            return t if there is None else F.when(F.col(there).isNotNull(), t)

        def rows(df: DataFrame, *triples) -> DataFrame:  # noqa: ANN002
            t = df.select("_chunk", F.explode(F.array(*triples)).alias("t")).where("t is not null")
            return t.select(unpacked(F.col("_chunk"), "chunk-").alias("chunk_id"), "t.*")

        order = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))
        return rows(
            r,
            one(F.lit(0), order, "placed by", F.col("c_name"), ("Order", "Customer")),
            one(F.lit(100), F.col("c_name"), "lives in", F.col("n_name"), ("Customer", "Nation"), "n_nationkey"),
            one(F.lit(101), spelled, "part of", F.col("r_name"), ("Nation", "Region"), "r_regionkey"),
        ).union(rows(
            line,
            one(F.col("l_linenumber"), part, "supplied by", F.col("s_name"), ("Part", "Supplier"), "s_suppkey"),
            one(200 + F.col("l_linenumber"), part, "has brand", F.col("p_brand"), ("Part", "Brand"), "p_partkey"),
        ))

    @cached_property
    def keyed(self) -> DataFrame:
        path = scratch(self.spark, "triples")
        k = stored(canonical(stored(self.triples, path), {"head": "head_key", "relation": "rel_key", "tail": "tail_key", "head_type": "head_type_key", "tail_type": "tail_type_key"}))
        discard(self.spark, path)
        return k

    @cached_property
    def links(self) -> DataFrame:
        return stored(memory.fact_passage(self.keyed))

    @cached_property
    def facts(self) -> DataFrame:
        return stored(ontology.typed_facts(self.keyed, self.links))

    @cached_property
    def passages(self) -> DataFrame:
        return stored(memory.dedup_passages(self.chunks))

    @cached_property
    def schemas(self) -> DataFrame:
        """Frequencies need the facts' schemas alone."""
        facts = self.__dict__.get("facts")
        return materialise(ontology.schema_frequency(ontology.dedup_schemas(self.keyed), ontology.typed_facts(self.keyed) if facts is None else facts))

    @cached_property
    def mem(self) -> Layers:
        return Layers(self)

    @cached_property
    def pairs(self) -> DataFrame:
        """Entities and the passages that mention them."""
        return stored(graph.mentions(self.keyed))

    @cached_property
    def nodes(self) -> DataFrame:
        return stored(self.passing_nodes)

    @cached_property
    def edges(self) -> DataFrame:
        """Kinds are stored one after another, so that no two of them take the disk at once."""
        return reduce(DataFrame.unionByName, [stored(e) for e in self.edge_kinds])

    @property
    def passing_nodes(self) -> DataFrame:
        """The nodes for queries that read them once: not stored, and labels that a query leaves out aren't made."""
        return graph.build_nodes(self.mem)

    @property
    def edge_kinds(self) -> list[DataFrame]:
        """The edges of each kind, not stored either."""
        return graph.edge_kinds(self.mem, self.__dict__.get("pairs", graph.mentions(self.keyed)))

    @cached_property
    def messages(self) -> DataFrame:
        return self.conversations.select(F.col("conv_id").alias("thread_id"), "turn", "role", "text")

    @cached_property
    def status(self) -> DataFrame:
        """A record for each document: equal texts share a doc_id made of the content."""
        s = F.element_at(F.array(*[F.lit(x) for x in ("pending", "parsing", "processing", "processed", "failed")]), (F.col("doc_id") % 5 + 1).cast("int"))
        path = F.concat_ws("/", F.lit("/data"), F.col("source"), F.col("lang"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string"), F.lit(".txt")))
        return self.documents.select(F.col("doc_id").cast("string").alias("doc_id"), s.alias("status"), path.alias("file_path"), (F.col("doc_id") % 97).alias("created_at"), "text")

    @cached_property
    def doc_chunk(self) -> DataFrame:
        """Lines as chunks: a line that several documents hold is one chunk."""
        d = self.documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "content"))
        d = d.withColumn("content", F.trim("content")).where("content <> ''")
        return d.select("doc_id", F.concat(F.lit("chunk-"), F.md5("content")).alias("chunk_id"), "pos", "content")


PRELUDE = r"""
chunks AS (
  SELECT 'chunk-' || md5(content) AS chunk_id, content, o_orderkey, o_custkey
  FROM (SELECT o_orderkey, o_custkey, 'Order ' || o_orderkey || ' placed by customer ' || o_custkey || ', status ' || o_orderstatus || ', priority ' || o_orderpriority AS content FROM orders)),
oc AS (SELECT * FROM chunks JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ol AS (SELECT * FROM lineitem JOIN chunks ON l_orderkey = o_orderkey),
triples AS (
  SELECT chunk_id, 0 AS pos, 'Order ' || o_orderkey AS head, 'placed by' AS relation, c_name AS tail, 'Order' AS head_type, 'Customer' AS tail_type FROM oc
  UNION ALL SELECT chunk_id, l_linenumber, 'Part ' || l_partkey, 'supplied by', s_name, 'Part', 'Supplier' FROM ol JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL SELECT chunk_id, 100, c_name, 'lives in', n_name, 'Customer', 'Nation' FROM oc
  UNION ALL SELECT chunk_id, 101, CASE WHEN o_orderkey % 2 = 0 THEN upper(n_name) ELSE lower(n_name) END, 'part of', r_name, 'Nation', 'Region' FROM oc
  UNION ALL SELECT chunk_id, 200 + l_linenumber, 'Part ' || l_partkey, 'has brand', p_brand, 'Part', 'Brand' FROM ol JOIN part ON l_partkey = p_partkey),
keyed AS (
  SELECT *, lower(head) AS head_key, lower(relation) AS rel_key, lower(tail) AS tail_key, lower(head_type) AS head_type_key, lower(tail_type) AS tail_type_key,
         'fact-' || md5(lower(head) || chr(1) || lower(relation) || chr(1) || lower(tail)) AS fact_id,
         'schema-' || md5(lower(head_type) || chr(1) || lower(relation) || chr(1) || lower(tail_type)) AS schema_id, chunk_id || lpad(CAST(pos AS VARCHAR), 6, '0') AS ord
  FROM triples),
links AS (SELECT DISTINCT fact_id, chunk_id AS passage_id FROM keyed),
freq AS (SELECT fact_id, count(*) AS frequency FROM links GROUP BY fact_id),
facts AS MATERIALIZED (
  SELECT fact_id, arg_min(head, ord) AS head, arg_min(relation, ord) AS relation, arg_min(tail, ord) AS tail, min(head_key) AS head_key, min(rel_key) AS rel_key, min(tail_key) AS tail_key,
         arg_max(schema_id, ord) AS schema_id, any_value(frequency) AS frequency
  FROM keyed JOIN freq USING (fact_id) GROUP BY fact_id),
sfreq AS (SELECT schema_id, count(*) AS frequency FROM facts GROUP BY schema_id),
schemas AS (
  SELECT k.schema_id, arg_min(head_type, ord) AS head_type, arg_min(relation, ord) AS relation, arg_min(tail_type, ord) AS tail_type, min(head_type_key) AS head_type_key, min(rel_key) AS rel_key, min(tail_type_key) AS tail_type_key, coalesce(any_value(frequency), 0) AS frequency
  FROM keyed k LEFT JOIN sfreq s ON s.schema_id = k.schema_id GROUP BY k.schema_id),
passages AS (SELECT chunk_id AS passage_id, min(content) AS content FROM chunks GROUP BY chunk_id),
ents AS (SELECT fact_id, unnest([head_key, tail_key]) AS e FROM facts),
ep AS MATERIALIZED (SELECT DISTINCT 'entity-' || md5(e) AS entity_id, passage_id FROM ents JOIN links USING (fact_id)),
status AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, ['pending', 'parsing', 'processing', 'processed', 'failed'][doc_id % 5 + 1] AS status,
         '/data/' || source || '/' || lang || '/Doc ' || doc_id || '.txt' AS file_path, doc_id % 97 AS created_at, text
  FROM documents),
doc_chunk AS (
  SELECT doc_id, 'chunk-' || md5(content) AS chunk_id, pos, content
  FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(i - 1 AS INTEGER) AS pos, trim(string_split(text, chr(10))[i], ' ') AS content FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))
  WHERE content <> ''),
edges AS MATERIALIZED (
  SELECT src, dst, 'TYPE_RELATION' AS type, CAST(arg_max(w, schema_id) AS DOUBLE) AS weight
  FROM (SELECT least(a, b) AS src, greatest(a, b) AS dst, schema_id, greatest(1, frequency) AS w FROM (SELECT 'type-' || md5(head_type_key) AS a, 'type-' || md5(tail_type_key) AS b, schema_id, frequency FROM schemas)) GROUP BY src, dst
  UNION ALL SELECT least(a, b), greatest(a, b), 'ENTITY_RELATION', CAST(count(*) AS DOUBLE) FROM (SELECT 'entity-' || md5(head_key) AS a, 'entity-' || md5(tail_key) AS b FROM facts WHERE head_key <> tail_key) GROUP BY 1, 2
  UNION ALL SELECT entity_id, passage_id, 'PASSAGE_ENTITY', 1.0 FROM ep
  UNION ALL SELECT fact_id, passage_id, 'FACT_PASSAGE', 1.0 FROM links
  UNION ALL SELECT fact_id, schema_id, 'FACT_SCHEMA', 1.0 FROM facts
  UNION ALL SELECT a, b, 'ENTITY_TO_TYPE', 1.0 / count(*) OVER (PARTITION BY b)
    FROM (SELECT DISTINCT 'entity-' || md5(e) AS a, 'type-' || md5(t) AS b FROM (SELECT head_key AS e, head_type_key AS t FROM facts JOIN schemas USING (schema_id) UNION ALL SELECT tail_key, tail_type_key FROM facts JOIN schemas USING (schema_id)))),
nodes AS MATERIALIZED (
  SELECT passage_id AS node_id, 'Passage' AS label, content FROM passages
  UNION ALL SELECT schema_id, 'Schema', head_type || ' ' || relation || ' ' || tail_type FROM schemas
  UNION ALL SELECT fact_id, 'Fact', head || ' ' || relation || ' ' || tail FROM facts
  UNION ALL SELECT 'type-' || md5(t), 'Type', t FROM (SELECT DISTINCT unnest([head_type_key, tail_type_key]) AS t FROM schemas)
  UNION ALL SELECT 'entity-' || md5(e), 'Entity', e FROM (SELECT DISTINCT e FROM ents))
"""


_last: dict[str, object] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables of a folder; queries of one session share what is derived from the folder read last."""
    if _last.get("key") != (spark, sf_dir):
        _last.update(key=(spark, sf_dir), tables=Tables(spark, sf_dir))
    return _last["tables"]


def query(name: str, sql: str | None = None, plain: bool = False) -> Callable:
    """Register a function of ``Tables``; ``sql`` follows the shared prelude unless ``plain``."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: f(tables(spark, sf_dir))
        if sql is not None:
            s = sql.strip()
            joint = ",\n" if s.split(None, 1)[0].upper() not in ("SELECT",) else "\n"
            SQL[name] = s if plain else f"WITH RECURSIVE {PRELUDE.strip()}{joint}{s}"
        return f

    return add
