"""Retrieval for a table of questions at once: linking, seeds, PageRank, ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trilayer.functions.session import materialise, stored
from trilayer.functions.text import basename, defang, hash_id
from trilayer.operators.pagerank import block_graph, push
from trilayer.operators.vectors import knn

# Defaults of the retrieval parameters.
PARAMS = {"top_k": 10, "linking_top_k": 50, "passage_node_weight": 0.05, "damping": 0.5, "fact_similarity_threshold": 0.6, "schema_top_k": 5, "schema_node_weight": 0.1}


def link_facts(queries: DataFrame, fact_vectors: DataFrame, k: int = 50) -> DataFrame:
    return knn(queries, fact_vectors, k).withColumnRenamed("id", "fact_id")


def threshold(hits: DataFrame, least: float = 0.6) -> DataFrame:
    return hits.where(F.col("score") >= least)


def rerank(hits: DataFrame, picks: DataFrame, least: float, most: int = 50) -> DataFrame:
    """Candidates that valid 1-based picks (query_id, picks) choose, in that order; no valid pick: the threshold.

    Adds ``place``, the new order.
    """
    c = hits.where(F.col("rank") <= most)
    p = picks.select("query_id", F.posexplode(F.array_distinct("picks")).alias("pos", "rank"))
    chosen = c.join(p, ["query_id", "rank"])
    rest = c.join(chosen.select("query_id").distinct(), "query_id", "left_anti").where(F.col("score") >= least)
    cols = [*hits.columns, "place"]
    order = lambda col: F.row_number().over(Window.partitionBy("query_id").orderBy(col)).alias("place")
    return chosen.select(*hits.columns, order("pos")).unionByName(rest.select(*hits.columns, order("rank"))).select(cols)


def _entity(col: str) -> Column:
    return hash_id(F.col(col), "entity-")


def schema_seeds(schema_hits: DataFrame, facts: DataFrame, pairs: DataFrame, w: float, pw: float) -> DataFrame:
    """Seeds of linked schemas: the schema and, for each endpoint of its facts, the entity and all of its passages.

    pairs: (entity_id, passage_id).  Endpoints are summed before they meet their passages.
    """
    s = schema_hits.select("query_id", F.col("id").alias("schema_id"), (F.col("score") * w).alias("m"))
    own = s.select("query_id", F.col("schema_id").alias("node_id"), "m")
    f = s.join(facts.where("active").select("schema_id", "head_key", "tail_key"), "schema_id")
    ends = f.select("query_id", F.explode(F.array(_entity("head_key"), _entity("tail_key"))).alias("node_id"), "m")
    ends = ends.groupBy("query_id", "node_id").agg(F.sum("m").alias("m"))
    psg = ends.join(pairs, F.col("node_id") == F.col("entity_id")).select("query_id", F.col("passage_id").alias("node_id"), (F.col("m") * pw).alias("m"))
    return own.union(ends).union(psg).groupBy("query_id", "node_id").agg(F.sum("m").alias("mass"))


def entity_seeds(hits: DataFrame, facts: DataFrame) -> DataFrame:
    """Mean score of the kept facts that mention an entity; a self-loop counts twice."""
    f = hits.select("query_id", "fact_id", "score").join(facts.select("fact_id", "head_key", "tail_key"), "fact_id")
    ends = f.select("query_id", F.explode(F.array(_entity("head_key"), _entity("tail_key"))).alias("node_id"), "score")
    return ends.groupBy("query_id", "node_id").agg(F.avg("score").alias("mass"))


def spread_to_passages(seeds: DataFrame, pairs: DataFrame, w: float) -> DataFrame:
    s = seeds.join(pairs, F.col("node_id") == F.col("entity_id")).select("query_id", F.col("passage_id").alias("node_id"), (F.col("mass") * w).alias("m"))
    return s.groupBy("query_id", "node_id").agg(F.sum("m").alias("mass"))


def passage_seeds(passage_hits: DataFrame, density: DataFrame, w: float) -> DataFrame:
    """Dense hits weighed by density, one half where unknown."""
    p = passage_hits.withColumnRenamed("id", "passage_id").join(density, "passage_id", "left")
    return p.select("query_id", F.col("passage_id").alias("node_id"), (F.col("score") * w * F.coalesce("density", F.lit(0.5))).alias("mass"))


def reset_vector(seeds: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Positive seeds in the graph, normalised per question; without any: uniform over all nodes."""
    s = seeds.groupBy("query_id", "node_id").agg(F.sum("mass").alias("mass")).where("mass > 0").join(nodes.select("node_id"), "node_id", "left_semi")
    some = s.select("query_id", "node_id", (F.col("mass") / F.sum("mass").over(Window.partitionBy("query_id"))).alias("mass"))
    none = queries.select("query_id").join(s.select("query_id").distinct(), "query_id", "left_anti")
    total = nodes.agg(F.count("*").alias("n"))
    every = none.crossJoin(F.broadcast(total)).crossJoin(nodes.select("node_id")).select("query_id", "node_id", (1 / F.col("n")).alias("mass"))
    return some.union(every)


def ppr(reset: DataFrame, edges: DataFrame, damping: float = 0.5, bound: float = 1e-6) -> DataFrame:
    """Personalised PageRank of all questions: (query_id, node_id, mass), within ``bound`` a question.

    ``edges`` (src, dst, weight) have no direction.  To ask more than once, keep
    the ``block_graph`` and ``push`` to it.
    """
    return push(reset, block_graph(edges), damping, bound)


def rank_passages(scores: DataFrame, passages: DataFrame, k: int = 10, fallback: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, passage_id, score, content): best passages with content, ties by id."""
    content = passages.select("passage_id", "content")
    if fallback is not None:
        content = content.unionByName(fallback.select("passage_id", "content").join(content, "passage_id", "left_anti"))
    s = scores.select("query_id", F.col("node_id").alias("passage_id"), F.col("mass").alias("score")).join(content, "passage_id")
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "passage_id"))
    return s.withColumn("rank", rn).where(F.col("rank") <= k).select("query_id", "rank", "passage_id", "score", "content")


def dense(queries: DataFrame, passage_vectors: DataFrame, passages: DataFrame, k: int = 10) -> DataFrame:
    """Dense-only ranking; blank content is dropped."""
    ok = passages.where(F.trim(F.coalesce("content", F.lit(""))) != "")
    hits = knn(queries, passage_vectors.join(ok.select(F.col("passage_id").alias("id")), "id", "left_semi"), k).withColumnRenamed("id", "passage_id")
    return hits.join(ok.select("passage_id", "content"), "passage_id").select("query_id", "rank", "passage_id", "score", "content")


def dense_texts(queries: DataFrame, passages: DataFrame, embed: Callable[[DataFrame], DataFrame], k: int = 10) -> DataFrame:
    """As ``dense``, of passages that ``embed`` turns into (id, embedding) here: no vector is shuffled, and the hits look up their texts."""
    ok = passages.where(F.trim(F.coalesce("content", F.lit(""))) != "")
    hits = stored(knn(queries, embed(ok), k).withColumnRenamed("id", "passage_id"))
    return hits.join(ok.select("passage_id", "content"), "passage_id").select("query_id", "rank", "passage_id", "score", "content")


# Modes of a question and names of the ways it can go.
MODES = ["ppr", "naive", "context", "bypass"]
NO_FACTS, EMPTY_GRAPH = "dense_fallback_no_facts", "dense_fallback_empty_ppr"


def paths(questions: DataFrame, kept: DataFrame, schemas: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, mode, path) of (query_id, mode): which way each question goes, in one plan.

    Naive and bypass go their own way.  Of the others, one without a kept fact
    and without a linked schema goes to dense search, and so does one for which
    the graph ranks no passage.  A null mode is ppr, an unknown one an error.
    """
    has = lambda df, name: df.select("query_id").distinct().withColumn(name, F.lit(True))
    q = questions.select("query_id", F.coalesce("mode", F.lit("ppr")).alias("mode"))
    q = q.join(has(kept, "_facts"), "query_id", "left").join(has(schemas, "_schemas"), "query_id", "left").join(has(ranked, "_ranked"), "query_id", "left")
    graph = F.when(F.col("_facts").isNull() & F.col("_schemas").isNull(), NO_FACTS).when(F.col("_ranked").isNull(), EMPTY_GRAPH).otherwise("ppr")
    known = F.when(F.col("mode").isin("naive", "bypass"), F.col("mode")).when(F.col("mode").isin("ppr", "context"), graph)
    return q.select("query_id", "mode", F.coalesce(known, F.raise_error(F.concat(F.lit("no such mode: "), F.col("mode"))).cast("string")).alias("path"))


def retrieve(way: DataFrame, ranked: DataFrame, dense_ranked: DataFrame) -> DataFrame:
    """Passages of each question by its path: (query_id, mode, path, rank, passage_id, score, content); bypass has none."""
    cols = ["query_id", "rank", "passage_id", "score", "content"]
    graph = way.where("path = 'ppr'").join(ranked.select(cols), "query_id")
    other = way.where(F.col("path").isin("naive", NO_FACTS, EMPTY_GRAPH)).join(dense_ranked.select(cols), "query_id")
    return graph.unionByName(other).select("query_id", "mode", "path", *cols[1:])


def answer(way: DataFrame, questions: DataFrame, retrieved: DataFrame, fn) -> DataFrame:  # noqa: ANN001
    """(query_id, mode, path, prompt, answer) of questions (query_id, question).

    The prompt is the fenced passages and the question, of bypass the question
    alone.  ``fn`` takes a pandas frame (query_id, prompt) and returns (query_id,
    answer); context mode ends with the prompt and calls no model.
    """
    fenced = fence(retrieved.withColumn("source", F.lit("")) if "source" not in retrieved.columns else retrieved).withColumnRenamed("prompt", "_context")
    text = F.when(F.col("_context").isNull(), F.col("question")).otherwise(F.concat(F.col("_context"), F.lit("\n\nQuestion: "), F.col("question")))
    asked = way.join(questions.select("query_id", "question"), "query_id").join(fenced, "query_id", "left")
    asked = materialise(asked.select("query_id", "mode", "path", F.when(F.col("mode") == "context", F.coalesce("_context", F.lit(""))).otherwise(text).alias("prompt")))
    kind = asked.schema["query_id"].dataType.simpleString()
    replies = materialise(asked.where("mode <> 'context'").select("query_id", "prompt").mapInPandas(lambda it: (fn(b) for b in it), f"query_id {kind}, answer string"))
    return asked.join(replies, "query_id", "left")


def route(queries: DataFrame, graph: DataFrame, naive: DataFrame) -> DataFrame:
    """Graph results where a question has any, else dense ones; adds ``path``."""
    has = graph.select("query_id").distinct()
    rest = naive.join(has, "query_id", "left_anti").withColumn("path", F.lit("naive"))
    return graph.withColumn("path", F.lit("ppr")).unionByName(rest).join(queries.select("query_id"), "query_id", "left_semi")


def one_hop_scores(seeds: DataFrame, pairs: DataFrame) -> DataFrame:
    """Without a graph: seed weights pushed from entities to their passages."""
    return spread_to_passages(seeds, pairs, 1.0)


def source_labels(doc_chunk: DataFrame, doc_status: DataFrame) -> DataFrame:
    """(chunk_id, source, source_path): base name of the smallest path that holds the chunk; none: unknown."""
    p = doc_chunk.join(doc_status.select("doc_id", "file_path"), "doc_id", "left").groupBy("chunk_id").agg(F.min("file_path").alias("source_path"))
    label = F.when(F.col("source_path").startswith("inline:"), F.col("source_path")).otherwise(basename(F.col("source_path")))
    return p.select("chunk_id", F.coalesce(label, F.lit("unknown")).alias("source"), "source_path")


def references(ranked: DataFrame) -> DataFrame:
    """(query_id, number, passage_id) in rank order."""
    return ranked.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("number"), "passage_id")


def number_hops(ranked: DataFrame) -> DataFrame:
    """Numbers that go on over the hops of one question."""
    return ranked.select("query_id", "hop", F.row_number().over(Window.partitionBy("query_id").orderBy("hop", "rank")).alias("number"), "passage_id")


def fence(ranked: DataFrame) -> DataFrame:
    """(query_id, prompt): one text of numbered fences from (query_id, rank, content, source)."""
    n = F.col("rank").cast("string")
    src = F.when(F.coalesce("source", F.lit("")) != "", F.concat(F.lit(" source="), defang(F.col("source")))).otherwise(F.lit(""))
    block = F.concat(F.lit("<<<PASSAGE "), n, F.lit(">>>"), src, F.lit("\n"), defang(F.col("content")), F.lit("\n<<<END PASSAGE "), n, F.lit(">>>"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("s")))), lambda x: x["s"]), "\n\n")
    return ranked.groupBy("query_id").agg(whole.alias("prompt"))


def payload(ranked: DataFrame, most: int | None = None) -> DataFrame:
    """(query_id, total_docs, doc_ids, doc_scores): scores to four digits, lists bounded."""
    row = F.array_sort(F.collect_list(F.struct("rank", "passage_id", F.round("score", 4).alias("s"))))
    p = ranked.groupBy("query_id").agg(F.count("*").alias("total_docs"), row.alias("r"))
    r = F.slice("r", 1, most) if most else F.col("r")
    return p.select("query_id", "total_docs", F.transform(r, lambda x: x["passage_id"]).alias("doc_ids"), F.transform(r, lambda x: x["s"]).alias("doc_scores"))


def sweep_scores(hits: DataFrame, ks: DataFrame) -> DataFrame:
    """Score of each grid value of k over hits made once at the largest: (k, combo_score, place).

    Per question .5 mean + .3 max + .2 min(1, n / 5), averaged over questions.
    """
    g = hits.join(F.broadcast(ks), F.col("rank") <= F.col("k"))  # the grid is a handful of rows
    q = g.groupBy("k", "query_id").agg(F.avg("score").alias("m"), F.max("score").alias("x"), F.count("*").alias("n"))
    s = q.groupBy("k").agg(F.avg(0.5 * F.col("m") + 0.3 * F.col("x") + 0.2 * F.least(F.lit(1.0), F.col("n") / 5)).alias("combo_score"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.round("combo_score", 10).desc(), "k")))


def rejudge(scores: DataFrame, judged: DataFrame, top_n: int) -> DataFrame:
    """The first ``top_n`` combinations ranked again by .4 score + .6 judge / 10."""
    s = scores.where(F.col("place") <= top_n).join(judged, "k", "left")
    final = 0.4 * F.col("combo_score") + 0.6 * F.coalesce("judge", F.lit(0.0)) / 10
    return s.withColumn("final", final).withColumn("final_place", F.row_number().over(Window.orderBy(F.round("final", 10).desc(), "k")))
