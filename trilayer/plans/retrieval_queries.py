"""Queries over vectors and retrieval.

Questions of the vector queries are the rows of ``embeddings`` whose id is
divisible by 20, against all rows; questions of the graph queries are the
regions, linked to facts by hashed bag-of-words vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilayer.functions.session import materialise, scratch, stored
from trilayer.operators import graph, incremental, retrieval, vector_index, vectors
from trilayer.plans.memory_queries import DENSITY
from trilayer.plans.registry import Tables, query

KNN = """
q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(q.e, CAST(v.embedding AS DOUBLE[])), 12) AS score FROM q, embeddings v),
hits AS (SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10)
"""


def _vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding")


def _questions(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("v1_exact_knn", KNN + "SELECT query_id, id, rank, round(score, 6) AS score FROM hits")
def _(t: Tables) -> DataFrame:
    return vectors.knn(_questions(t), _vectors(t), 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("v2_similarity_floor", KNN + "SELECT query_id, id, rank FROM hits WHERE score >= 0.3")
def _(t: Tables) -> DataFrame:
    return vectors.knn(_questions(t), _vectors(t), 10, min_score=0.3).select("query_id", "id", "rank")


@query("v3_approximate_knn")
def _(t: Tables) -> DataFrame:
    """The index is stored, and a quarter of its cells searched."""
    index = vector_index.VectorIndex.create(_vectors(t), scratch(t.spark, "index"))
    return index.search(_questions(t), 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("v5_hash_embedding", """
w AS (SELECT doc_id, ('0x' || md5(t)[1:2])::INTEGER % 64 AS b FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents)),
c AS (SELECT doc_id, b, count(*) AS n FROM w GROUP BY doc_id, b)
SELECT doc_id AS id, CAST(count(*) AS INTEGER) AS dims, round(max(n) / sqrt(sum(n * n)), 9) AS largest FROM c GROUP BY doc_id
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    e = vectors.hash_embed(t.documents.where(F.rlike(F.lower("text"), F.lit("[a-z0-9]"))), "doc_id", "text")
    return e.select("id", F.size(F.filter("embedding", lambda x: x > 0)).alias("dims"), F.round(F.array_max("embedding"), 9).alias("largest"))


@query("v6_vector_upsert", "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 64 END AS dims FROM embeddings WHERE vec_id % 5 <> 0")
def _(t: Tables) -> DataFrame:
    v = _vectors(t)
    ch = v.where("id % 3 = 0").select("id", F.array(F.lit(1.0).cast("float")).alias("embedding"), F.lit(1).alias("version"))
    out = vectors.delete_vectors(vectors.upsert_vectors(v, ch), v.where("id % 5 = 0"))
    return out.select("id", F.size("embedding").alias("dims"))


@query("v7_dimension_guard", "SELECT count(*) AS vectors, count(*) FILTER (len(embedding) <> 64) AS wrong FROM embeddings")
def _(t: Tables) -> DataFrame:
    return vectors.dimension_report(_vectors(t), 64)


def _fact_vectors(t: Tables) -> DataFrame:
    f = t.mem.facts.select("fact_id", F.concat_ws("\t", "head", "relation", "tail").alias("text"))
    return vectors.hash_embed(f, "fact_id", "text")


def _regions(t: Tables) -> DataFrame:
    q = t.region.select("r_regionkey", F.concat(F.lit("part of "), F.lower("r_name")).alias("text"))
    return vectors.hash_embed(q, "r_regionkey", "text").withColumnRenamed("id", "query_id")


HASHED = """
fw AS (SELECT fact_id, ('0x' || md5(w)[1:2])::INTEGER % 64 AS b, count(*) AS n FROM (SELECT fact_id, unnest(regexp_extract_all(lower(head || chr(9) || relation || chr(9) || tail), '[a-z0-9]+')) AS w FROM facts) GROUP BY 1, 2),
fn AS (SELECT fact_id, sqrt(sum(n * n)) AS m FROM fw GROUP BY fact_id),
qw AS (SELECT r_regionkey AS query_id, ('0x' || md5(w)[1:2])::INTEGER % 64 AS b, count(*) AS n FROM (SELECT r_regionkey, unnest(regexp_extract_all('part of ' || lower(r_name), '[a-z0-9]+')) AS w FROM region) GROUP BY 1, 2),
qn AS (SELECT query_id, sqrt(sum(n * n)) AS m FROM qw GROUP BY query_id),
fs AS (SELECT query_id, fact_id, round(sum(qw.n * fw.n) / any_value(qn.m * fn.m), 12) AS score FROM qw JOIN fw USING (b) JOIN fn USING (fact_id) JOIN qn USING (query_id) GROUP BY query_id, fact_id),
fhits AS MATERIALIZED (SELECT query_id, fact_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id) AS rank FROM fs) WHERE rank <= 50),
kept AS MATERIALIZED (SELECT * FROM fhits WHERE score >= 0.6),
es AS (SELECT query_id, 'entity-' || md5(e) AS node_id, avg(score) AS mass FROM kept JOIN ents USING (fact_id) GROUP BY 1, 2),
ps AS (SELECT query_id, passage_id AS node_id, sum(mass * 0.05) AS mass FROM es JOIN ep ON entity_id = node_id GROUP BY 1, 2),
sw AS (SELECT schema_id, ('0x' || md5(w)[1:2])::INTEGER % 64 AS b, count(*) AS n FROM (SELECT schema_id, unnest(regexp_extract_all(lower(head_type || chr(9) || relation || chr(9) || tail_type), '[a-z0-9]+')) AS w FROM schemas) GROUP BY 1, 2),
sn AS (SELECT schema_id, sqrt(sum(n * n)) AS m FROM sw GROUP BY schema_id),
shits AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, schema_id) AS rank FROM (SELECT query_id, schema_id, round(sum(qw.n * sw.n) / any_value(qn.m * sn.m), 12) AS score FROM qw JOIN sw USING (b) JOIN sn USING (schema_id) JOIN qn USING (query_id) GROUP BY query_id, schema_id)) WHERE rank <= 5),
send AS (SELECT query_id, 'entity-' || md5(e) AS node_id, sum(score * 0.1) AS m FROM shits JOIN (SELECT schema_id, unnest([head_key, tail_key]) AS e FROM facts) USING (schema_id) GROUP BY 1, 2),
ss AS (SELECT query_id, schema_id AS node_id, score * 0.1 AS mass FROM shits UNION ALL SELECT query_id, node_id, m FROM send UNION ALL SELECT query_id, passage_id, sum(m * 0.05) FROM send JOIN ep ON entity_id = node_id GROUP BY 1, 2),
pw AS (SELECT passage_id, ('0x' || md5(w)[1:2])::INTEGER % 64 AS b, count(*) AS n FROM (SELECT passage_id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS w FROM passages) GROUP BY 1, 2),
pn AS (SELECT passage_id, sqrt(sum(n * n)) AS m FROM pw GROUP BY passage_id),
pscore AS (SELECT query_id, passage_id, round(sum(qw.n * pw.n) / any_value(qn.m * pn.m), 12) AS score FROM qw JOIN pw USING (b) JOIN pn USING (passage_id) JOIN qn USING (query_id) GROUP BY query_id, passage_id),
phits AS MATERIALIZED (SELECT query_id, passage_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM pscore) WHERE rank <= 10),
""" + DENSITY.strip() + """,
ds AS (SELECT query_id, passage_id AS node_id, score * 0.05 * density AS mass FROM phits JOIN density USING (passage_id)),
seeds AS (SELECT * FROM es UNION ALL SELECT * FROM ps UNION ALL SELECT * FROM ss UNION ALL SELECT * FROM ds),
reset AS MATERIALIZED (SELECT query_id, node_id, mass / sum(mass) OVER (PARTITION BY query_id) AS mass FROM (SELECT query_id, node_id, sum(mass) AS mass FROM seeds WHERE node_id IN (SELECT node_id FROM nodes) GROUP BY 1, 2)),
sym AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges WHERE src <> dst),
named AS MATERIALIZED (SELECT node_id AS name, CAST(row_number() OVER () AS INTEGER) AS i FROM (SELECT src AS node_id FROM sym UNION SELECT node_id FROM reset)),
adj AS MATERIALIZED (SELECT a.i AS src, b.i AS dst, w / sum(w) OVER (PARTITION BY sym.src) AS p FROM (SELECT src, dst, sum(weight) AS w FROM sym GROUP BY src, dst) sym JOIN named a ON a.name = sym.src JOIN named b ON b.name = sym.dst),
start AS MATERIALIZED (SELECT query_id, i AS node_id, mass FROM reset JOIN named ON name = reset.node_id)
"""
#: Steps of the SQL, after which less than 2^-33 of a question's mass is missing.
STEPS = 34


def _ppr_sql() -> str:
    steps = ["y0 AS MATERIALIZED (SELECT * FROM start)"]
    for k in range(STEPS):
        steps.append(
            f"y{k + 1} AS MATERIALIZED (SELECT query_id, node_id, sum(mass) AS mass FROM (SELECT query_id, dst AS node_id, mass * p * 0.5 AS mass FROM y{k} JOIN adj ON src = node_id "
            f"UNION ALL SELECT r.query_id, r.node_id, r.mass * (0.5 + 0.5 * coalesce(d, 0)) FROM start r LEFT JOIN (SELECT query_id, sum(mass) AS d FROM y{k} WHERE node_id NOT IN (SELECT src FROM adj) GROUP BY query_id) l USING (query_id)) GROUP BY query_id, node_id)"
        )
    return HASHED + ", " + ",\n".join(steps) + f",\nranked AS (SELECT query_id, name AS node_id, mass FROM y{STEPS} JOIN named ON i = y{STEPS}.node_id)\n"


def _hits(t: Tables) -> DataFrame:
    if "hits" not in t.__dict__:
        t.__dict__["hits"] = stored(retrieval.link_facts(_regions(t), _fact_vectors(t), 50))
    return t.__dict__["hits"]


def _seeds(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = stored(retrieval.entity_seeds(retrieval.threshold(_hits(t), 0.6), t.mem.facts))
    return e, retrieval.spread_to_passages(e, t.pairs, 0.05)


def _schema_hits(t: Tables) -> DataFrame:
    text = t.mem.schemas.select("schema_id", F.concat_ws("\t", "head_type", "relation", "tail_type").alias("text"))
    return vectors.knn(_regions(t), vectors.hash_embed(text, "schema_id", "text"), retrieval.PARAMS["schema_top_k"])


def _passage_seeds(t: Tables) -> DataFrame:
    v = vectors.hash_embed(t.mem.passages, "passage_id", "content")
    hits = materialise(vectors.knn(_regions(t), v, 10))
    return retrieval.passage_seeds(hits, graph.density(t.pairs, t.mem.passages), 0.05)


def _reset(t: Tables) -> DataFrame:
    """Seeds of all four kinds: entities of linked facts, their passages, linked schemas, dense passages."""
    e, p = _seeds(t)
    facts = t.mem.facts.withColumn("active", F.lit(True))
    s = retrieval.schema_seeds(materialise(_schema_hits(t)), facts, t.pairs, 0.1, 0.05)
    seeds = materialise(e.union(p).union(s).union(_passage_seeds(t)))
    return materialise(retrieval.reset_vector(seeds, t.nodes, t.region.select(F.col("r_regionkey").alias("query_id"))))


def _scores(t: Tables) -> DataFrame:
    if "scores" not in t.__dict__:
        t.__dict__["scores"] = materialise(retrieval.ppr(_reset(t), t.edges, bound=1e-10))
    return t.__dict__["scores"]


@query("v4_embed_changes")
def _(t: Tables) -> DataFrame:
    texts = t.mem.facts.select(F.col("fact_id").alias("id"), F.concat_ws("\t", "head", "relation", "tail").alias("text"))
    old = vectors.hash_embed(texts.where("length(id) > 0 and id < 'fact-8'"), "id", "text")
    ch = incremental.diff_ids(old, texts)
    return vectors.embed_changes(ch, texts, lambda b: b.assign(embedding=[[float(len(x)), 1.0] for x in b["text"]])[["id", "embedding"]], old)


@query("r1_fact_linking", HASHED + "SELECT query_id, fact_id, rank, round(score, 6) AS score FROM fhits")
def _(t: Tables) -> DataFrame:
    return _hits(t).select("query_id", "fact_id", "rank", F.round("score", 6).alias("score"))


@query("r2_threshold", HASHED + "SELECT query_id, fact_id FROM kept")
def _(t: Tables) -> DataFrame:
    return retrieval.threshold(_hits(t), 0.6).select("query_id", "fact_id")


@query("r3_rerank", HASHED + "SELECT query_id, fact_id, CASE WHEN query_id % 2 = 0 THEN CASE rank WHEN 3 THEN 1 ELSE 2 END ELSE rank END AS place FROM fhits WHERE CASE WHEN query_id % 2 = 0 THEN rank IN (1, 3) ELSE score >= 0.6 END")
def _(t: Tables) -> DataFrame:
    picks = t.region.select(F.col("r_regionkey").alias("query_id"), F.when(F.col("r_regionkey") % 2 == 0, F.array(F.lit(3), F.lit(1), F.lit(3), F.lit(999))).otherwise(F.array(F.lit(0))).alias("picks"))
    return retrieval.rerank(_hits(t), picks, 0.6).select("query_id", "fact_id", "place")


@query("r4_schema_seeds", """
h AS (SELECT c_nationkey % 5 AS query_id, schema_id AS id, 0.5::DOUBLE AS score FROM (SELECT DISTINCT c_nationkey FROM customer), schemas WHERE rel_key = 'part of'),
s AS (SELECT DISTINCT query_id, id, score * 0.1 AS m FROM h),
f AS (SELECT query_id, m, fact_id, head_key, tail_key FROM s JOIN facts ON schema_id = id),
e AS (SELECT query_id, 'entity-' || md5(unnest([head_key, tail_key])) AS node_id, m FROM f),
u AS (SELECT query_id, id AS node_id, m FROM s UNION ALL SELECT query_id, node_id, m FROM e UNION ALL SELECT query_id, passage_id, m * 0.05 FROM e JOIN ep ON entity_id = node_id)
SELECT query_id, node_id, round(sum(m), 9) AS mass FROM u GROUP BY 1, 2
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    q = t.customer.select((F.col("c_nationkey") % 5).alias("query_id")).distinct()
    hits = q.crossJoin(t.mem.schemas.where("rel_key = 'part of'").select(F.col("schema_id").alias("id"))).withColumn("score", F.lit(0.5))
    facts = t.mem.facts.withColumn("active", F.lit(True))
    return retrieval.schema_seeds(hits, facts, graph.entity_passage_map(facts, t.mem.links), 0.1, 0.05).withColumn("mass", F.round("mass", 9))


@query("r5_entity_seeds", HASHED + "SELECT query_id, node_id, round(mass, 9) AS mass FROM es")
def _(t: Tables) -> DataFrame:
    return _seeds(t)[0].withColumn("mass", F.round("mass", 9))


@query("r6_passage_spread", HASHED + "SELECT query_id, node_id, round(mass, 9) AS mass FROM ps")
def _(t: Tables) -> DataFrame:
    return _seeds(t)[1].withColumn("mass", F.round("mass", 9))


@query("r7_dense_passage_seeds", HASHED + "SELECT query_id, node_id, round(mass, 9) AS mass FROM ds")
def _(t: Tables) -> DataFrame:
    return _passage_seeds(t).withColumn("mass", F.round("mass", 9))


@query("r8_reset_vector", HASHED + "SELECT query_id, node_id, round(mass, 9) AS mass FROM reset")
def _(t: Tables) -> DataFrame:
    return _reset(t).withColumn("mass", F.round("mass", 9))


@query("r9_personalized_pagerank", _ppr_sql() + "SELECT query_id, node_id, round(mass, 8) AS mass FROM ranked WHERE node_id IN (SELECT passage_id FROM passages)")
def _(t: Tables) -> DataFrame:
    s = _scores(t).join(t.mem.passages.select(F.col("passage_id").alias("node_id")), "node_id", "left_semi")
    return s.select("query_id", "node_id", F.round("mass", 8).alias("mass"))


@query("r10_passage_ranking", _ppr_sql() + f", rp AS (SELECT query_id, passage_id, row_number() OVER (PARTITION BY query_id ORDER BY round(mass, 12) DESC, passage_id) AS rank FROM ranked JOIN passages ON passage_id = node_id) SELECT query_id, CAST(rank AS INTEGER) AS rank, passage_id FROM rp WHERE rank <= 10")
def _(t: Tables) -> DataFrame:
    return retrieval.rank_passages(_scores(t), t.mem.passages).select("query_id", "rank", "passage_id")


@query("r11_dense_retrieval", HASHED + "SELECT query_id, rank, passage_id FROM phits")
def _(t: Tables) -> DataFrame:
    return retrieval.dense_texts(_regions(t), t.mem.passages, lambda p: vectors.hash_embed(p, "passage_id", "content")).select("query_id", "rank", "passage_id")


NATIONS = HASHED.replace("FROM region", "FROM nation").replace("r_regionkey", "n_nationkey").replace("'part of ' || lower(r_name)", "lower(n_name)")
ROUTES = NATIONS.rstrip() + """,
mode AS (SELECT n_nationkey AS query_id, ['ppr', 'context', 'naive', 'bypass', 'ppr'][n_nationkey % 5 + 1] AS mode FROM nation),
sl AS (SELECT * FROM shits WHERE score >= 0.2),
rk AS (SELECT query_id, passage_id, rank FROM (SELECT query_id, node_id AS passage_id, row_number() OVER (PARTITION BY query_id ORDER BY round(mass, 12) DESC, node_id) AS rank FROM ps) WHERE rank <= 10),
way AS (
  SELECT query_id, mode, CASE WHEN mode IN ('naive', 'bypass') THEN mode
    WHEN query_id NOT IN (SELECT query_id FROM kept) AND query_id NOT IN (SELECT query_id FROM sl) THEN 'dense_fallback_no_facts'
    WHEN query_id NOT IN (SELECT query_id FROM rk) THEN 'dense_fallback_empty_ppr' ELSE 'ppr' END AS path
  FROM mode),
got AS (
  SELECT query_id, mode, path, rank, passage_id FROM way JOIN rk USING (query_id) WHERE path = 'ppr'
  UNION ALL SELECT query_id, mode, path, rank, passage_id FROM way JOIN phits USING (query_id) WHERE path NOT IN ('ppr', 'bypass'))
"""


def _routed(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nations as questions of all modes: (questions, ways, passages)."""
    if "routed" not in t.__dict__:
        mode = F.get(F.array(*[F.lit(m) for m in ("ppr", "context", "naive", "bypass", "ppr")]), (F.col("n_nationkey") % 5).cast("int"))
        asked = t.nation.select(F.col("n_nationkey").alias("query_id"), F.lower("n_name").alias("question"), mode.alias("mode"))
        q = materialise(vectors.hash_embed(asked, "query_id", "question").withColumnRenamed("id", "query_id"))
        kept = stored(retrieval.threshold(retrieval.link_facts(q, _fact_vectors(t), 50), 0.6))
        text = t.mem.schemas.select("schema_id", F.concat_ws("\t", "head_type", "relation", "tail_type").alias("text"))
        schemas = materialise(vectors.knn(q, vectors.hash_embed(text, "schema_id", "text"), 5, min_score=0.2))
        scores = retrieval.one_hop_scores(stored(retrieval.entity_seeds(kept, t.mem.facts)), t.pairs)
        ranked = materialise(retrieval.rank_passages(scores, t.mem.passages))
        dense = materialise(retrieval.dense_texts(q, t.mem.passages, lambda p: vectors.hash_embed(p, "passage_id", "content")))
        way = materialise(retrieval.paths(asked, kept, schemas, ranked))
        t.__dict__["routed"] = (asked, way, materialise(retrieval.retrieve(way, ranked, dense)))
    return t.__dict__["routed"]


@query("r12_fallback_routing", ROUTES + "SELECT query_id, path, CAST(rank AS INTEGER) AS rank, passage_id FROM got UNION ALL SELECT query_id, path, 0, '' FROM way WHERE path = 'bypass'")
def _(t: Tables) -> DataFrame:
    _, way, got = _routed(t)
    rest = way.where("path = 'bypass'").select("query_id", "path", F.lit(0).alias("rank"), F.lit("").alias("passage_id"))
    return got.select("query_id", "path", "rank", "passage_id").unionByName(rest)


@query("r18_modes", ROUTES + """,
c AS (SELECT query_id, string_agg('<<<PASSAGE ' || rank || '>>>' || chr(10) || content || chr(10) || '<<<END PASSAGE ' || rank || '>>>', chr(10) || chr(10) ORDER BY rank) AS ctx FROM got JOIN passages USING (passage_id) GROUP BY query_id),
p AS (SELECT query_id, mode, path, CASE WHEN mode = 'context' THEN coalesce(ctx, '') WHEN ctx IS NULL THEN lower(n_name) ELSE ctx || chr(10) || chr(10) || 'Question: ' || lower(n_name) END AS prompt FROM way JOIN nation ON n_nationkey = query_id LEFT JOIN c USING (query_id))
SELECT query_id, mode, path, md5(prompt) AS prompt, CASE WHEN mode <> 'context' THEN 'reply to ' || length(prompt) END AS answer FROM p
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    asked, way, got = _routed(t)
    out = retrieval.answer(way, asked, got, lambda b: b.assign(answer=[f"reply to {len(x)}" for x in b["prompt"]])[["query_id", "answer"]])
    return out.select("query_id", "mode", "path", F.md5("prompt").alias("prompt"), "answer")


@query("r13_one_hop_scores", HASHED + "SELECT query_id, node_id, round(mass * 20, 9) AS mass FROM ps")
def _(t: Tables) -> DataFrame:
    pairs = graph.entity_passage_map(t.mem.facts, t.mem.links)
    return retrieval.one_hop_scores(_seeds(t)[0], pairs).withColumn("mass", F.round("mass", 9))


@query("r14_source_labels", "SELECT chunk_id, string_split(min(file_path), '/')[-1] AS source, min(file_path) AS source_path FROM doc_chunk JOIN status USING (doc_id) GROUP BY chunk_id")
def _(t: Tables) -> DataFrame:
    return retrieval.source_labels(t.doc_chunk, t.status)


@query("r15_references", KNN + "SELECT query_id, rank AS number, id AS passage_id FROM hits")
def _(t: Tables) -> DataFrame:
    r = vectors.knn(_questions(t), _vectors(t), 10).withColumnRenamed("id", "passage_id")
    return retrieval.references(r)


@query("r16_hop_numbering", KNN + "SELECT query_id, hop, rank + CASE WHEN hop = 2 THEN 10 ELSE 0 END AS number, id AS passage_id FROM hits, (SELECT CAST(unnest([1, 2]) AS INTEGER) AS hop)")
def _(t: Tables) -> DataFrame:
    r = vectors.knn(_questions(t), _vectors(t), 10).withColumnRenamed("id", "passage_id")
    return retrieval.number_hops(r.withColumn("hop", F.explode(F.array(F.lit(1), F.lit(2)))))


@query("r17_payload", KNN + "SELECT query_id, count(*) AS total_docs, string_agg(id, ',' ORDER BY rank) FILTER (rank <= 3) AS doc_ids FROM hits GROUP BY query_id")
def _(t: Tables) -> DataFrame:
    r = vectors.knn(_questions(t), _vectors(t), 10).withColumnRenamed("id", "passage_id")
    return retrieval.payload(r, 3).select("query_id", "total_docs", F.array_join("doc_ids", ",").alias("doc_ids"))


@query("t7_prompt_fence", KNN + "SELECT query_id, string_agg('<<<PASSAGE ' || rank || '>>> source=emb' || chr(10) || 'vector ' || id || ' < < <x> > >' || chr(10) || '<<<END PASSAGE ' || rank || '>>>', chr(10) || chr(10) ORDER BY rank) AS prompt FROM hits GROUP BY query_id")
def _(t: Tables) -> DataFrame:
    r = vectors.knn(_questions(t), _vectors(t), 10)
    r = r.select("query_id", "rank", F.concat(F.lit("vector "), F.col("id").cast("string"), F.lit(" <<<x>>>")).alias("content"), F.lit("emb").alias("source"))
    return retrieval.fence(r)


@query("r18_context_mode")
def _(t: Tables) -> DataFrame:
    r = retrieval.rank_passages(_scores(t), t.mem.passages).withColumn("source", F.lit(""))
    return retrieval.fence(r)


@query("r19_parameter_sweep", KNN + """,
ks AS (SELECT CAST(unnest([1, 3, 5, 10]) AS INTEGER) AS k),
g AS (SELECT k, query_id, avg(score) AS m, max(score) AS x, count(*) AS n FROM hits JOIN ks ON rank <= k GROUP BY 1, 2),
c AS (SELECT k, avg(0.5 * m + 0.3 * x + 0.2 * least(1.0, n / 5.0)) AS s FROM g GROUP BY k),
p AS (SELECT k, s, row_number() OVER (ORDER BY round(s, 10) DESC, k) AS place FROM c),
j AS (SELECT k, s, place, 0.4 * s + 0.6 * k / 10 AS final FROM p WHERE place <= 3)
SELECT k, round(s, 6) AS combo_score, CAST(place AS INTEGER) AS place, CAST(row_number() OVER (ORDER BY round(final, 10) DESC, k) AS INTEGER) AS final_place FROM j
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    hits = vectors.knn(_questions(t), _vectors(t), 10)
    ks = t.spark.createDataFrame([(1,), (3,), (5,), (10,)], "k int")
    s = retrieval.sweep_scores(hits, ks)
    out = retrieval.rejudge(s, ks.withColumn("judge", F.col("k").cast("double")), 3)
    return out.select("k", F.round("combo_score", 6).alias("combo_score"), "place", "final_place")
