"""Queries over keyed tables, memory, ontology, conflicts and the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilayer.functions.text import hash_id
from trilayer.functions.session import materialise
from trilayer.operators import conflicts, documents, graph, graph_queries, incremental, keyed, memory, ontology
from trilayer.plans.registry import Tables, query


@query("k1_upsert", """
n AS (SELECT o_custkey AS c_custkey, arg_max(o_totalprice, o_orderkey) AS c_acctbal FROM orders GROUP BY o_custkey)
SELECT c_custkey, coalesce(n.c_acctbal, c.c_acctbal) AS c_acctbal FROM customer c FULL JOIN n USING (c_custkey)
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    base = t.customer.select("c_custkey", "c_acctbal", F.lit(0).cast("long").alias("v"))
    changes = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderkey").alias("v"))
    return keyed.upsert(base, changes, "c_custkey", "v").select("c_custkey", "c_acctbal")


@query("k2_lookup", "SELECT o_orderkey AS pos, o_custkey AS c_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(t: Tables) -> DataFrame:
    return keyed.lookup(t.customer.select("c_custkey", "c_name"), t.orders.select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("c_custkey")), "c_custkey").select("pos", "c_custkey", "c_name")


@query("k3_missing_keys", "SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(t: Tables) -> DataFrame:
    return keyed.missing_keys(t.orders.select("o_orderkey"), t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("k4_delete_ids", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(t: Tables) -> DataFrame:
    return keyed.delete_ids(t.customer.select("c_custkey", "c_name"), t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("k5_by_status", "SELECT doc_id, status FROM status WHERE status IN ('pending', 'failed')")
def _(t: Tables) -> DataFrame:
    return keyed.by_status(t.status.select("doc_id", "status"), ["pending", "failed"])


@query("k6_clear_namespace", "SELECT doc_id, source, lang FROM documents WHERE lang IS DISTINCT FROM 'en'")
def _(t: Tables) -> DataFrame:
    return keyed.clear(t.documents.select("doc_id", "source", "lang"), "en", "lang")


@query("t3_canonical_triples", "SELECT chunk_id, pos, head_key, rel_key, tail_key FROM keyed")
def _(t: Tables) -> DataFrame:
    return t.keyed.select("chunk_id", "pos", "head_key", "rel_key", "tail_key")


@query("m1_fact_dedup", "SELECT fact_id, head, relation, tail FROM facts")
def _(t: Tables) -> DataFrame:
    return memory.dedup_facts(t.keyed).select("fact_id", "head", "relation", "tail")


@query("m2_passage_dedup", "SELECT passage_id, content, 'text' AS modality FROM passages")
def _(t: Tables) -> DataFrame:
    return memory.dedup_passages(t.chunks)


@query("m3_fact_passage_links", "SELECT fact_id, passage_id FROM links")
def _(t: Tables) -> DataFrame:
    return memory.fact_passage(t.keyed)


@query("m4_fact_frequency", "SELECT fact_id, frequency FROM facts")
def _(t: Tables) -> DataFrame:
    return memory.fact_frequency(memory.dedup_facts(t.keyed), memory.fact_passage(t.keyed)).select("fact_id", "frequency")


@query("m5_typed_build", "SELECT fact_id, head, relation, tail, schema_id, frequency FROM facts")
def _(t: Tables) -> DataFrame:
    return t.mem.facts.select("fact_id", "head", "relation", "tail", "schema_id", "frequency")


@query("m6_layer_lookups", """
SELECT 'facts_of_schema' AS lookup, schema_id AS key, count(fact_id) AS n FROM schemas LEFT JOIN facts USING (schema_id) GROUP BY schema_id
UNION ALL SELECT 'passages_of_fact', fact_id, count(passage_id) FROM facts LEFT JOIN links USING (fact_id) GROUP BY fact_id
UNION ALL SELECT 'facts_of_passage', passage_id, count(fact_id) FROM passages LEFT JOIN links USING (passage_id) GROUP BY passage_id
UNION ALL SELECT 'schema_of_fact', schema_id, count(*) FROM facts GROUP BY schema_id
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    m = t.mem
    n = lambda df, name, key, what: df.groupBy(F.col(key).alias("key")).agg(F.count(what).alias("n")).select(F.lit(name).alias("lookup"), "key", "n")
    return (
        n(memory.facts_of_schema(m, m.schemas), "facts_of_schema", "schema_id", "fact_id")
        .unionByName(n(memory.passages_of_fact(m, m.facts), "passages_of_fact", "fact_id", "passage_id"))
        .unionByName(n(memory.facts_of_passage(m, m.passages), "facts_of_passage", "passage_id", "fact_id"))
        .unionByName(n(memory.schema_of_fact(m, m.facts), "schema_of_fact", "schema_id", "fact_id"))
    )


@query("m7_remove_facts", """
g AS (SELECT fact_id FROM facts WHERE frequency = 1)
SELECT 'fact' AS kind, fact_id AS key, frequency AS n FROM facts WHERE fact_id NOT IN (SELECT fact_id FROM g)
UNION ALL SELECT 'link', fact_id, count(*) FROM links WHERE fact_id NOT IN (SELECT fact_id FROM g) GROUP BY fact_id
UNION ALL SELECT 'schema', schema_id, count(fact_id) FROM schemas LEFT JOIN (SELECT * FROM facts WHERE fact_id NOT IN (SELECT fact_id FROM g)) USING (schema_id) GROUP BY schema_id
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    m = memory.remove_facts(t.mem, t.mem.facts.where("frequency = 1"))
    return (
        m.facts.select(F.lit("fact").alias("kind"), F.col("fact_id").alias("key"), F.col("frequency").alias("n"))
        .union(m.links.groupBy("fact_id").count().select(F.lit("link"), "fact_id", "count"))
        .union(m.schemas.select(F.lit("schema"), "schema_id", "frequency"))
    )


@query("m8_replace_facts", """
rw AS (SELECT fact_id AS old, 'fact-' || md5(head_key || chr(1) || 'sold by' || chr(1) || tail_key) AS fact_id FROM facts WHERE rel_key = 'supplied by'),
l2 AS (SELECT DISTINCT coalesce(rw.fact_id, l.fact_id) AS fact_id, passage_id FROM links l LEFT JOIN rw ON rw.old = l.fact_id)
SELECT fact_id, count(*) AS frequency FROM l2 GROUP BY fact_id
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    rw = t.mem.facts.where("rel_key = 'supplied by'").select("fact_id", "head", F.lit("sold by").alias("relation"), "tail")
    return memory.replace_facts(t.mem, rw).facts.select("fact_id", "frequency")


@query("m9_add_facts", "SELECT fact_id, frequency FROM facts")
def _(t: Tables) -> DataFrame:
    half = t.keyed.where("pos < 100")
    m = memory.build(half, t.chunks)
    return memory.add_facts(m, t.keyed.where("pos >= 100")).facts.select("fact_id", "frequency")


@query("m10_layer_summary", """
SELECT 'facts' AS metric, CAST(count(*) AS DOUBLE) AS value FROM facts
UNION ALL SELECT 'active_facts', CAST(count(*) AS DOUBLE) FROM facts
UNION ALL SELECT 'passages', CAST(count(*) AS DOUBLE) FROM passages
UNION ALL SELECT 'passages_per_fact', avg(n) FROM (SELECT count(*) AS n FROM links GROUP BY fact_id)
UNION ALL SELECT 'facts_per_passage', avg(n) FROM (SELECT count(*) AS n FROM links GROUP BY passage_id)
UNION ALL SELECT 'schemas', CAST(count(*) AS DOUBLE) FROM schemas
UNION ALL SELECT 'schema_frequency_min', CAST(min(frequency) AS DOUBLE) FROM schemas
UNION ALL SELECT 'schema_frequency_max', CAST(max(frequency) AS DOUBLE) FROM schemas
UNION ALL SELECT 'schema_frequency_avg', avg(frequency) FROM schemas
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    m = t.mem
    return memory.summary(m.with_(facts=m.facts.withColumn("active", F.lit(True))))


@query("m12_entity_surfaces", "SELECT DISTINCT e AS entity_key FROM ents UNION SELECT lower(c_name) FROM customer")
def _(t: Tables) -> DataFrame:
    return memory.entity_surfaces(t.customer.select(F.lower("c_name").alias("entity_key")), t.mem.facts)


@query("o1_schema_dedup", "SELECT schema_id, head_type, relation, tail_type FROM schemas")
def _(t: Tables) -> DataFrame:
    return ontology.dedup_schemas(t.keyed).select("schema_id", "head_type", "relation", "tail_type")


@query("o2_fact_schema_link", "SELECT fact_id, schema_id FROM facts")
def _(t: Tables) -> DataFrame:
    typed = t.keyed.withColumn("fact_id", memory.fact_id())
    return ontology.link_schemas(memory.dedup_facts(t.keyed), typed).select("fact_id", "schema_id")


@query("o3_schema_frequency", "SELECT schema_id, frequency FROM schemas")
def _(t: Tables) -> DataFrame:
    return t.mem.schemas.select("schema_id", "frequency")


@query("o4_frequency_filter", """
k AS (SELECT schema_id FROM schemas WHERE frequency >= 1000)
SELECT fact_id, k.schema_id, k.schema_id IS NOT NULL AS active FROM facts f LEFT JOIN k ON k.schema_id = f.schema_id
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return ontology.filter_schemas(t.mem, 1000).facts.select("fact_id", "schema_id", "active")


@query("o5_guarded_filter", """
r AS (SELECT coalesce(sum(CASE WHEN frequency < 1000 THEN frequency END), 0) / greatest(1, sum(frequency)) AS ratio FROM schemas)
SELECT s.schema_id, s.frequency, r.ratio, r.ratio <= 0.5 AS applied FROM schemas s, r WHERE r.ratio > 0.5 OR s.frequency >= 1000
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    m, report = ontology.guarded_filter(t.mem, 1000)
    return m.schemas.select("schema_id", "frequency").crossJoin(report)


@query("o6_cached_types", "SELECT fact_id, head_type, tail_type FROM facts JOIN (SELECT DISTINCT head_key, rel_key, tail_key, head_type, tail_type FROM keyed) USING (head_key, rel_key, tail_key)")
def _(t: Tables) -> DataFrame:
    cache = t.keyed.select("head_key", "rel_key", "tail_key", "head_type", "tail_type").distinct()
    return ontology.apply_cached_types(t.mem.facts, cache).select("fact_id", "head_type", "tail_type")


@query("o7_typing_batches", """
b AS (SELECT passage_id, fact_id, CAST(ceil(row_number() OVER (PARTITION BY passage_id ORDER BY fact_id) / 4.0) AS INTEGER) AS batch FROM links)
SELECT passage_id, batch, string_agg(fact_id, ',' ORDER BY fact_id) AS fact_ids FROM b GROUP BY passage_id, batch
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    facts = t.mem.facts.withColumn("schema_id", F.lit(None).cast("string"))
    return ontology.typing_batches(facts, t.mem.links, 4).withColumn("fact_ids", F.array_join("fact_ids", ","))


@query("o10_persist_types", "SELECT chunk_id, count(DISTINCT fact_id) AS n_types FROM keyed GROUP BY chunk_id")
def _(t: Tables) -> DataFrame:
    typed = t.keyed.withColumn("fact_id", memory.fact_id())
    base = t.chunks.join(typed.select("chunk_id").distinct(), "chunk_id", "left_semi").withColumn("ontology", F.lit(None))
    return ontology.persist_types(base, typed).select("chunk_id", F.size("ontology").cast("long").alias("n_types"))


GROUPS = """
grp AS (
  SELECT DISTINCT members FROM (
    SELECT string_agg(fact_id, ',' ORDER BY fact_id) AS members FROM facts GROUP BY head_key, rel_key HAVING count(*) > 1
    UNION ALL SELECT string_agg(fact_id, ',' ORDER BY fact_id) FROM facts GROUP BY rel_key, tail_key HAVING count(*) > 1))
"""


@query("f1_conflict_groups", GROUPS + "SELECT CAST((length(members) + 1) // 38 AS BIGINT) AS size, members[1:37] AS first, members[-37:] AS last, md5(members) AS members FROM grp")
def _(t: Tables) -> DataFrame:
    """Groups by their digests; for the comparison alone their members are put in one text."""
    g = materialise(conflicts.conflict_groups(t.mem.facts))
    m = conflicts.members_of(g, t.mem.facts).groupBy("group_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list("fact_id")), ",")).alias("members"))
    return g.join(m, "group_id").select("size", "first", "last", "members")


@query("f2_group_ranking", GROUPS + ", r AS (SELECT members, length(members) AS n FROM grp ORDER BY n DESC, members LIMIT 50) SELECT (n + 1) // 38 AS size, members[1:37] AS first, members[-37:] AS last, md5(members) AS members, (SELECT greatest(0, count(*) - 50) FROM grp) AS cut FROM r")
def _(t: Tables) -> DataFrame:
    """Groups in rank order; members are put in one text for the comparison alone, and only those of groups within the budget."""
    facts = t.mem.facts
    top, cut = conflicts.rank_groups(materialise(conflicts.conflict_groups(facts)), facts=facts)
    m = conflicts.members_of(top, facts).groupBy("group_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list("fact_id")), ",")).alias("members"))
    ranked = top.join(m, "group_id").crossJoin(F.broadcast(cut))  # one row
    return ranked.orderBy(F.col("size").desc(), "first", "second").select("size", "first", "last", "members", "cut")


VERDICT = """
v AS (
  SELECT o_orderkey AS id, o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' AS hard, CASE o_orderstatus WHEN 'F' THEN 'Duplicate' ELSE 'value' END AS type,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'high' ELSE CAST((o_orderkey % 100) / 100.0 AS VARCHAR) END AS confidence
  FROM orders)
"""


@query("f4_verdict_guards", VERDICT + "SELECT id FROM v WHERE hard AND lower(type) NOT IN ('duplicate', 'none', 'uncertain') AND CASE WHEN confidence IS NULL THEN 1.0 ELSE coalesce(try_cast(confidence AS DOUBLE), 0.0) END >= 0.85")
def _(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    v = t.orders.select(
        k.alias("id"), F.substring("o_orderpriority", 1, 1).isin("1", "2").alias("hard"), F.when(F.col("o_orderstatus") == "F", "Duplicate").otherwise("value").alias("type"),
        F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, "high").otherwise(((k % 100) / 100.0).cast("string")).alias("confidence"),
    )
    return conflicts.hard_conflicts(v).select("id")


@query("f5_verdict_facts", "SELECT f.fact_id AS a_fact_id, f.tail_key AS b_tail_key, g.fact_id AS b_fact_id FROM facts f LEFT JOIN facts g ON g.head_key = f.head_key AND g.rel_key = 'supplied by' AND g.tail_key = f.tail_key")
def _(t: Tables) -> DataFrame:
    f = t.mem.facts.withColumn("group_id", F.lit(1))
    keys = ["head_key", "rel_key", "tail_key"]
    v = f.select("group_id", *[F.col(k).alias(f"a_{k}") for k in keys], F.col("head_key").alias("b_head_key"), F.lit("supplied by").alias("b_rel_key"), F.col("tail_key").alias("b_tail_key"))
    return conflicts.attach_facts(v, f).select("a_fact_id", "b_tail_key", "b_fact_id")


PAIRS = """
pr AS (SELECT min(fact_id) AS a, max(fact_id) AS b, head_key FROM facts WHERE rel_key = 'supplied by' GROUP BY head_key HAVING count(*) > 1),
side AS (SELECT head_key, 0 AS s, a AS fact_id FROM pr UNION ALL SELECT head_key, 1, b FROM pr),
bundle AS (
  SELECT head_key AS conflict_id, string_agg('(' || head || ', ' || relation || ', ' || tail || ') ' || left(content, 800), chr(10) ORDER BY s, passage_id) AS bundle
  FROM side JOIN facts USING (fact_id, head_key) JOIN links USING (fact_id) JOIN passages USING (passage_id) GROUP BY head_key)
"""


def _pairs(t: Tables) -> DataFrame:
    f = t.mem.facts.where("rel_key = 'supplied by'").groupBy(F.col("head_key").alias("conflict_id"))
    return f.agg(F.min("fact_id").alias("a_fact_id"), F.max("fact_id").alias("b_fact_id")).where("a_fact_id <> b_fact_id")


@query("f6_evidence_bundles", PAIRS + "SELECT conflict_id, md5(bundle) AS bundle FROM bundle")
def _(t: Tables) -> DataFrame:
    return conflicts.evidence(_pairs(t), t.mem).withColumn("bundle", F.md5("bundle"))


@query("f7_bundle_batches", PAIRS + """,
o AS MATERIALIZED (SELECT conflict_id, length(bundle) AS n, row_number() OVER (ORDER BY conflict_id) AS i FROM bundle),
g AS (
  SELECT conflict_id, i, n AS held, CAST(0 AS BIGINT) AS batch FROM o WHERE i = 1
  UNION ALL
  SELECT o.conflict_id, o.i, CASE WHEN held > 0 AND held + n > 24000 THEN n ELSE held + n END, batch + CASE WHEN held > 0 AND held + n > 24000 THEN 1 ELSE 0 END FROM g JOIN o ON o.i = g.i + 1)
SELECT conflict_id, batch FROM g
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return conflicts.batch_bundles(conflicts.evidence(_pairs(t), t.mem))


@query("f8_apply_resolutions", """
rw AS (SELECT fact_id AS old, 'fact-' || md5(head_key || chr(1) || 'sold by' || chr(1) || tail_key) AS fact_id FROM facts WHERE rel_key = 'supplied by'),
l2 AS (SELECT DISTINCT coalesce(rw.fact_id, l.fact_id) AS fact_id, passage_id FROM links l LEFT JOIN rw ON rw.old = l.fact_id),
gone AS (SELECT fact_id FROM facts WHERE rel_key = 'has brand')
SELECT fact_id, count(*) AS frequency FROM l2 WHERE fact_id NOT IN (SELECT fact_id FROM gone) GROUP BY fact_id
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    f = t.mem.facts
    res = f.where("rel_key = 'supplied by'").select("fact_id", F.lit("modified").alias("action"), "head", F.lit("sold by").alias("relation"), "tail")
    res = res.union(f.where("rel_key = 'has brand'").select("fact_id", F.lit("discarded"), "head", "relation", "tail"))
    return conflicts.apply_resolutions(t.mem, res)[0].facts.select("fact_id", "frequency")


@query("f9_failure_report", "SELECT count(*) AS batches, count(*) FILTER (status = 'failed') AS failed_batches FROM status")
def _(t: Tables) -> DataFrame:
    return conflicts.resolution_report(t.status)


@query("i1_corpus_chunks", """
live AS (SELECT chunk_id FROM doc_chunk JOIN status USING (doc_id) WHERE status = 'processed' AND doc_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 0))
SELECT chunk_id FROM live UNION SELECT chunk_id FROM chunks
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    bad = t.labels.where("quality = 0").select(F.col("doc_id").cast("string").alias("doc_id"))
    return incremental.corpus_chunks(t.status, t.doc_chunk, t.chunks, t.chunks.limit(0), bad)


@query("i2_id_diff", """
o AS (SELECT DISTINCT chunk_id AS id FROM doc_chunk JOIN status USING (doc_id) WHERE status IN ('processed', 'failed')),
n AS (SELECT DISTINCT chunk_id AS id FROM doc_chunk JOIN status USING (doc_id) WHERE status IN ('processed', 'pending'))
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'orphan' ELSE 'kept' END AS change FROM o FULL JOIN n ON o.id = n.id
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    c = t.doc_chunk.join(t.status.select("doc_id", "status"), "doc_id")
    pick = lambda *s: c.where(F.col("status").isin(*s)).select(F.col("chunk_id").alias("id"))
    return incremental.diff_ids(pick("processed", "failed"), pick("processed", "pending"))


@query("i4_rebuild_after_delete", """
k2 AS (SELECT * FROM keyed WHERE chunk_id IN (SELECT chunk_id FROM chunks JOIN orders USING (o_orderkey) WHERE o_orderstatus <> 'F'))
SELECT fact_id, count(DISTINCT chunk_id) AS frequency FROM k2 GROUP BY fact_id
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    gone = t.chunks.join(t.orders.where("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey").select("chunk_id")
    rest = t.keyed.join(gone, "chunk_id", "left_anti")
    return memory.build(rest, t.chunks.join(gone, "chunk_id", "left_anti")).facts.select("fact_id", "frequency")


@query("i5_edge_refresh", """
ch AS (SELECT dst AS src, src AS dst, type, 9.0 AS weight FROM edges WHERE type = 'ENTITY_RELATION' AND weight > 1)
SELECT type, count(*) AS n, sum(weight) AS weight FROM (
  SELECT type, weight FROM edges e WHERE NOT (type = 'ENTITY_RELATION' AND weight > 1) UNION ALL SELECT type, weight FROM ch) GROUP BY type
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    e = t.edges
    ch = e.where("type = 'ENTITY_RELATION' and weight > 1").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", F.lit(9.0).alias("weight"), "relations")
    return incremental.refresh_edges(e, ch).groupBy("type").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query("g1_layer_nodes", "SELECT node_id, label FROM nodes WHERE label IN ('Passage', 'Schema', 'Fact')")
def _(t: Tables) -> DataFrame:
    return graph.layer_nodes(t.mem).select("node_id", "label")


@query("g2_type_nodes", "SELECT * FROM nodes WHERE label = 'Type'")
def _(t: Tables) -> DataFrame:
    return graph.type_nodes(t.mem.schemas)


@query("g3_entity_nodes", "SELECT * FROM nodes WHERE label = 'Entity'")
def _(t: Tables) -> DataFrame:
    return graph.entity_nodes(t.mem.facts)


for _id, _name, _kind, _make in (
    ("g4", "type_relations", "TYPE_RELATION", lambda m: graph.type_relations(m.schemas)),
    ("g5", "entity_relations", "ENTITY_RELATION", lambda m: graph.entity_relations(m.facts)),
    ("g6", "entity_passages", "PASSAGE_ENTITY", lambda m: graph.entity_passages(m.facts, m.links)),
    ("g7", "fact_passages", "FACT_PASSAGE", lambda m: graph.fact_passages(m.facts, m.links)),
    ("g8", "fact_schemas", "FACT_SCHEMA", lambda m: graph.fact_schemas(m.facts)),
    ("g9", "entity_types", "ENTITY_TO_TYPE", lambda m: graph.entity_types(m.facts, m.schemas)),
):
    query(f"{_id}_{_name}", f"SELECT * FROM edges WHERE type = '{_kind}'")(lambda t, make=_make: make(t.mem).select("src", "dst", "type", "weight"))


@query("g10_entity_passage_map", "SELECT * FROM ep")
def _(t: Tables) -> DataFrame:
    return graph.entity_passage_map(t.mem.facts, t.mem.links)


DENSITY = """
df AS (SELECT entity_id, count(*) AS df FROM ep GROUP BY entity_id),
x0 AS (SELECT passage_id, sum(ln((SELECT count(*) FROM passages) / (1.0 + df)) + 1) / ln(count(*) + 1.0) AS x FROM ep JOIN df USING (entity_id) GROUP BY passage_id),
x1 AS (SELECT passage_id, coalesce(x, 0.0) AS x FROM passages LEFT JOIN x0 USING (passage_id)),
st AS (SELECT avg(x) AS m, count(x) AS n, max(x) - min(x) AS r FROM x1 WHERE x <> 0),
density AS MATERIALIZED (SELECT passage_id, 1 / (1 + exp(-((x - coalesce(m, 0)) / CASE WHEN n <= 1 THEN 1 ELSE greatest(1e-6, r / 4) END))) AS density FROM x1, st)
"""


@query("g11_information_density", DENSITY + "SELECT passage_id, round(density, 6) AS density FROM density")
def _(t: Tables) -> DataFrame:
    d = graph.density(graph.entity_passage_map(t.mem.facts, t.mem.links), t.mem.passages)
    return d.select("passage_id", F.round("density", 6).alias("density"))


@query("g12_edge_upsert", "SELECT src, dst, type, CASE WHEN type = 'FACT_PASSAGE' THEN 1.0 ELSE weight END AS weight FROM edges")
def _(t: Tables) -> DataFrame:
    ch = t.edges.where("type = 'FACT_PASSAGE'").withColumn("weight", F.lit(0.0))
    return graph.upsert_edges(t.edges, ch).select("src", "dst", "type", "weight")


@query("q1_subgraph", """
pg AS (SELECT node_id FROM nodes WHERE lower(label) = 'entity' ORDER BY node_id LIMIT 500)
SELECT src, dst, type FROM edges WHERE src IN (FROM pg) AND dst IN (FROM pg) ORDER BY src, dst, type LIMIT 2000
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return graph_queries.subgraph(t.passing_nodes, t.edge_kinds, "entity", 500)[1].select("src", "dst", "type")


@query("q2_redaction", "SELECT node_id, CASE WHEN label = 'Passage' THEN '[' || length(content) || ' characters]' ELSE content END AS content FROM nodes")
def _(t: Tables) -> DataFrame:
    return graph_queries.redact(t.passing_nodes).select("node_id", "content")


@query("q3_labels", "SELECT DISTINCT label FROM nodes")
def _(t: Tables) -> DataFrame:
    return graph_queries.labels(t.passing_nodes)


@query("q4_profile", "SELECT 'node' AS part, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type")
def _(t: Tables) -> DataFrame:
    return graph_queries.profile(t.passing_nodes, t.edge_kinds)


@query("q4_key_use", """
SELECT 'node' AS part, label AS name, unnest(['node_id', 'content']) AS key, unnest([count(node_id), count(content)]) AS n FROM nodes GROUP BY label
UNION ALL SELECT 'edge', type, unnest(['src', 'dst', 'weight']), unnest([count(src), count(dst), count(weight)]) FROM edges GROUP BY type
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return graph_queries.key_use(t.nodes.select("node_id", "label", "content"), t.edges.select("src", "dst", "type", "weight"))


BOTH = "both_ AS MATERIALIZED (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"


@query("q5_neighborhood", BOTH + """,
h0 AS (SELECT 'entity-' || md5('europe') AS node_id, 0 AS hop),
h1 AS MATERIALIZED (SELECT DISTINCT dst AS node_id, 1 AS hop FROM both_ JOIN h0 ON src = node_id WHERE dst NOT IN (SELECT node_id FROM h0)),
h2 AS (SELECT DISTINCT dst AS node_id, 2 AS hop FROM both_ JOIN h1 ON src = node_id WHERE dst NOT IN (SELECT node_id FROM h0 UNION ALL SELECT node_id FROM h1))
SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    import hashlib

    return graph_queries.neighborhood(t.edges, "entity-" + hashlib.md5(b"europe").hexdigest(), 2)


@query("q5_neighborhood_edges", BOTH + """,
h0 AS (SELECT 'entity-' || md5('europe') AS node_id),
near AS (SELECT node_id FROM h0 UNION SELECT dst FROM both_ JOIN h0 ON src = node_id)
SELECT src, dst, type, weight FROM edges WHERE src IN (SELECT node_id FROM near) OR dst IN (SELECT node_id FROM near)
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    import hashlib

    return graph_queries.neighborhood_edges(t.edges.select("src", "dst", "type", "weight"), "entity-" + hashlib.md5(b"europe").hexdigest(), 2)


@query("q6_highlights", """
en AS (SELECT 'entity' AS kind, content, count(*) AS n FROM (SELECT unnest([src, dst]) AS node_id FROM edges WHERE type = 'ENTITY_RELATION') JOIN nodes USING (node_id) GROUP BY content ORDER BY n DESC, content LIMIT 5),
sc AS (SELECT 'schema', head_type || ' ' || relation || ' ' || tail_type AS content, frequency AS n FROM schemas ORDER BY n DESC, content LIMIT 5),
ty AS (SELECT 'type', content, count(e.src) AS n FROM nodes LEFT JOIN (SELECT * FROM edges WHERE type = 'ENTITY_TO_TYPE') e ON e.dst = node_id WHERE label = 'Type' GROUP BY content ORDER BY n DESC, content LIMIT 5)
SELECT * FROM en UNION ALL SELECT * FROM sc UNION ALL SELECT * FROM ty
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return graph_queries.highlights(t.passing_nodes, t.edge_kinds, t.mem.schemas)


@query("q7_degree", "SELECT node_id, count(*) AS degree FROM (SELECT unnest([src, dst]) AS node_id FROM edges) GROUP BY node_id")
def _(t: Tables) -> DataFrame:
    return graph_queries.degree(t.edges)


@query("q8_point_lookup", """
SELECT 'entity-' || md5(lower(c_name)) AS node_id, n.node_id IS NOT NULL AS found FROM customer LEFT JOIN nodes n ON n.node_id = 'entity-' || md5(lower(c_name))
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return graph_queries.get_nodes(t.nodes, t.customer.select(hash_id(F.lower("c_name"), "entity-").alias("node_id"))).select("node_id", "found")


@query("q8b_edge_lookup", "SELECT src, dst, weight FROM edges WHERE type = 'ENTITY_RELATION'")
def _(t: Tables) -> DataFrame:
    e = t.edges.where("type = 'ENTITY_RELATION'")
    return graph_queries.get_edges(e, e.select(F.col("dst").alias("a"), F.col("src").alias("b"))).select("src", "dst", "weight")


@query("q9_pattern_match", "SELECT a.src AS node_0, a.dst AS node_1, b.dst AS node_2 FROM edges a JOIN edges b ON a.dst = b.src WHERE a.type = 'ENTITY_TO_TYPE' AND b.type = 'TYPE_RELATION'")
def _(t: Tables) -> DataFrame:
    return graph_queries.match(t.edges, ["ENTITY_TO_TYPE", "TYPE_RELATION"])


@query("q10_graph_report", "SELECT (SELECT count(*) FROM nodes) AS nodes, true AS has_passage, true AS has_fact, true AS has_schema, true AS has_entity, true AS has_type, (SELECT count(*) FROM edges) AS edges")
def _(t: Tables) -> DataFrame:
    return graph_queries.graph_report(t.nodes, t.edges)


@query("q11_property_truncation", "SELECT doc_id, left(text, 500) AS content, CASE WHEN length(text) > 500 THEN 'content' ELSE '' END AS truncated FROM documents")
def _(t: Tables) -> DataFrame:
    d = graph_queries.truncate_props(t.documents.select("doc_id", F.col("text").alias("content")))
    return d.select("doc_id", "content", F.array_join("truncated", ",").alias("truncated"))


@query("d1_duplicate_intake", """
h AS (SELECT 'doc-' || md5(text) AS doc_id, file_path FROM status)
SELECT file_path, row_number() OVER (PARTITION BY doc_id ORDER BY file_path) = 1 AS is_new FROM h
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    files = t.status.select(hash_id(F.col("text"), "doc-").alias("doc_id"), "file_path")
    new, dup = documents.split_duplicates(files, files.limit(0))
    return new.select("file_path", F.lit(True).alias("is_new")).union(dup.select("file_path", F.lit(False)))


@query("d2_status_listing", "SELECT doc_id, created_at, (SELECT count(*) FROM status WHERE status = 'processed') AS total FROM status WHERE status = 'processed' ORDER BY created_at, doc_id LIMIT 25 OFFSET 10")
def _(t: Tables) -> DataFrame:
    return documents.list_docs(t.status, "processed", 25, 10).select("doc_id", "created_at", "total")


@query("d3_document_chunks", "SELECT chunk_id, pos FROM doc_chunk WHERE doc_id = '1' AND pos BETWEEN 0 AND 49")
def _(t: Tables) -> DataFrame:
    return documents.doc_chunks(t.doc_chunk.drop("content"), t.doc_chunk.select("chunk_id", "content").distinct(), "1", 50).select("chunk_id", "pos")


REFS = """
refs AS (SELECT chunk_id, count(DISTINCT doc_id) AS refs FROM doc_chunk JOIN status USING (doc_id) WHERE status = 'processed' AND doc_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 0) GROUP BY chunk_id)
"""


@query("d4_refcounts", REFS + "SELECT * FROM refs")
def _(t: Tables) -> DataFrame:
    return documents.refcounts(t.status, t.doc_chunk, t.labels.where("quality = 0").select(F.col("doc_id").cast("string").alias("doc_id")))


@query("d5_delete_documents", REFS + """,
own AS (SELECT DISTINCT doc_id, chunk_id FROM doc_chunk WHERE doc_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 0)),
cnt AS (SELECT doc_id, count(*) FILTER (refs IS NULL) AS dropped, count(refs) AS shared FROM own LEFT JOIN refs USING (chunk_id) GROUP BY doc_id)
SELECT DISTINCT CAST(l.doc_id AS VARCHAR) AS doc_id, CASE WHEN s.doc_id IS NULL THEN 'not_found' ELSE 'deleted' END AS outcome, coalesce(dropped, 0) AS dropped, coalesce(shared, 0) AS shared
FROM labels l LEFT JOIN status s ON s.doc_id = CAST(l.doc_id AS VARCHAR) LEFT JOIN cnt ON cnt.doc_id = CAST(l.doc_id AS VARCHAR) WHERE quality = 0
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return documents.delete_docs(t.status, t.doc_chunk, t.labels.where("quality = 0").select(F.col("doc_id").cast("string").alias("doc_id")))[2]


@query("d6_requeue", "SELECT doc_id, CASE WHEN status IN ('parsing', 'processing') THEN 'pending' ELSE status END AS status, CASE WHEN status IN ('parsing', 'processing') THEN status END AS recovered_from FROM status")
def _(t: Tables) -> DataFrame:
    return documents.requeue(t.status).select("doc_id", "status", "recovered_from")


@query("d6_requeued_chunks", "SELECT doc_id, chunk_id, pos FROM doc_chunk JOIN status USING (doc_id) WHERE status NOT IN ('parsing', 'processing')")
def _(t: Tables) -> DataFrame:
    return documents.requeued_chunks(t.doc_chunk, documents.requeue(t.status)).select("doc_id", "chunk_id", "pos")


@query("d7_process_summary", "SELECT status, count(*) OVER (PARTITION BY status) AS n, doc_id FROM status WHERE status IN ('processed', 'failed')")
def _(t: Tables) -> DataFrame:
    return documents.process_summary(t.status)


@query("d8_search_documents", "SELECT DISTINCT file_path FROM status WHERE contains(lower(file_path), 'src1/en') ORDER BY file_path LIMIT 50")
def _(t: Tables) -> DataFrame:
    return documents.search_docs(t.status, "SRC1/en")


@query("d9_read_document", "SELECT file_path, pos, chunk_id FROM status JOIN doc_chunk USING (doc_id) WHERE file_path = 'Doc 7.txt' OR file_path LIKE '%/Doc 7.txt'")
def _(t: Tables) -> DataFrame:
    p = t.doc_chunk.select(F.col("chunk_id").alias("passage_id"), "content").distinct()
    return documents.read_document(t.status, t.doc_chunk.drop("content"), p, "Doc 7.txt").select("file_path", "pos", "chunk_id")
