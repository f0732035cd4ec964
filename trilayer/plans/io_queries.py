"""Queries over sources and sinks, model hooks and streams.

Files are derived from the given tables, written to the shared folder and read
back by the source under test.  Model hooks run scripted functions.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilayer.functions.session import materialise, scratch
from trilayer.functions.text import hash_id
from trilayer.operators import conflicts, delta, evaluation, extraction, memory
from trilayer.plans.registry import Tables, query
from trilayer.sources import files
from trilayer.streaming import intake


@query("s1_corpus_json", "SELECT lang AS title, text FROM documents WHERE trim(text) <> ''")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "corpus")
    t.documents.select(F.col("lang").alias("title"), "text").write.json(path)
    return files.read_corpus(t.spark, path, multi_line=False).select("title", "text")


@query("s2_text_corpus", "SELECT 'notes' AS title, text FROM documents")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "texts")
    files.write_texts(t.documents.select("text"), path)
    d = files.read_text_corpus(t.spark, path, "notes")
    return d.select("title", F.regexp_replace("text", r"\n$", "").alias("text"))


@query("s3_questions", "SELECT CAST(item_id AS VARCHAR) AS example_id, text AS question, left(text, 9) AS gold_answers, CAST(item_id % 7 AS VARCHAR) AS gold_docs FROM benchmark")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "questions")
    b = t.benchmark
    title = F.array((F.col("item_id") % 7).cast("string"), F.lit("0"))
    b.select(F.col("item_id").cast("string").alias("_id"), F.col("text").alias("question"), F.substring("text", 1, 9).alias("answer"), F.array(title, title).alias("supporting_facts")).write.json(path)
    q = files.read_questions(t.spark, path, multi_line=False)
    return q.select("example_id", "question", F.array_join("gold_answers", "|").alias("gold_answers"), F.array_join("gold_docs", "|").alias("gold_docs"))


@query("s7_block_sidecar_scan", "SELECT doc_id AS blockid, pos AS level, content FROM doc_chunk")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "blocks")
    c = t.doc_chunk.select(F.lit("content").alias("type"), F.col("doc_id").alias("blockid"), F.col("pos").alias("level"), "content")
    line = F.to_json(F.struct("type", "blockid", "level", "content"))
    c.select(line.alias("value")).union(t.region.select(F.concat(F.lit('{"type": "meta", "x'), F.col("r_name")))).union(t.region.select(F.lit('{"type": "meta"}'))).write.text(path)
    return files.read_blocks(t.spark, path).select("blockid", "level", "content")


@query("s9_directory_intake", "SELECT DISTINCT 'doc-' || md5(text || chr(10)) AS doc_id FROM documents WHERE doc_id % 2 = 1")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "files")
    files.write_texts(t.documents.select("text"), path)
    known = t.documents.where("doc_id % 2 = 0").select(hash_id(F.concat("text", F.lit("\n")), "doc-").alias("doc_id"), F.lit("processed").alias("status"))
    odd = t.documents.where("doc_id % 2 = 1").select(hash_id(F.concat("text", F.lit("\n")), "doc-").alias("doc_id"))
    known = known.join(odd, "doc_id", "left_anti")
    found = files.scan_dir(t.spark, path, known, exclude=["_SUCCESS"]).where(F.contains("file_path", F.lit("/part-"))).select("doc_id").distinct()
    return found


@query("s10_text_decode", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'needs a parser' WHEN 1 THEN 'not UTF-8' WHEN 2 THEN 'blank' ELSE 'byte literal' END AS reason FROM documents UNION ALL SELECT doc_id, '' FROM documents")
def _(t: Tables) -> DataFrame:
    m = F.col("doc_id") % 4
    raw = F.when(m == 0, F.concat(F.lit(b"%PDF-1.7 "), F.encode("text", "UTF-8"))).when(m == 1, F.concat(F.encode("text", "UTF-8"), F.lit(b"\xff\xfe"))).when(m == 2, F.lit(b" \n ")).otherwise(F.lit(b"b'x'"))
    bad = t.documents.select("doc_id", F.lit("p").alias("file_path"), raw.alias("content"))
    good = t.documents.select("doc_id", F.lit("p").alias("file_path"), F.encode("text", "UTF-8").alias("content"))
    docs, rejects = files.decode_files(bad.unionByName(good))
    return rejects.select("doc_id", "reason").union(docs.select("doc_id", F.lit("")))


@query("s12_extraction_scan", "SELECT CAST(o_orderkey AS VARCHAR) AS idx, o_orderstatus AS passage, false AS failed FROM orders")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "extractions")
    row = F.struct(F.col("o_orderkey").cast("string").alias("idx"), F.col("o_orderstatus").alias("passage"), F.lit("[]").alias("extracted_entities"), F.lit("[]").alias("extracted_triples"), F.lit(False).alias("failed"))
    t.orders.select(F.array(row).alias("docs")).write.json(path)
    return files.read_extractions(t.spark, path, multi_line=False).select("idx", "passage", "failed")


@query("s13_memory_snapshot", "SELECT fact_id, schema_id, frequency FROM facts")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "memory")
    memory.save(t.mem, path)
    return memory.load(t.spark, path).facts.select("fact_id", "schema_id", "frequency")


@query("s14_golden_set", "SELECT item_id AS example_id, text FROM benchmark")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "golden")
    b = t.benchmark.select(F.col("item_id").alias("example_id"), "text")
    files.save_golden(b, b, path)
    return files.load_golden(t.spark, path)[0]


def _entities(passage: str) -> list[str]:
    return [w.strip(",") for w in passage.split() if w[:1].isupper()]


def _triples(passage: str, found: list[str]) -> list[tuple[str, str, str]]:
    if passage.endswith("LOW"):
        raise ValueError("the model refuses")
    return [(found[0], "mentions", passage.split()[1])]


@query("x5_two_step_extraction", "SELECT chunk_id, content LIKE '%LOW' AS failed, CASE WHEN content LIKE '%LOW' THEN '' ELSE 'Order' END AS head FROM chunks")
def _(t: Tables) -> DataFrame:
    e = extraction.run_batches(t.chunks.select("chunk_id", "content"), extraction.extract_batch(_entities, _triples), extraction.EXTRACTION)
    return e.select("chunk_id", "failed", F.coalesce(F.get("triples", F.lit(0))["head"], F.lit("")).alias("head"))


@query("x3_checkpointed_extraction", "SELECT chunk_id FROM chunks WHERE content NOT LIKE '%LOW'")
def _(t: Tables) -> DataFrame:
    path, fn = scratch(t.spark, "cache"), extraction.extract_batch(_entities, _triples)
    c = t.chunks.select("chunk_id", "content")
    half = c.where(F.pmod(F.xxhash64("chunk_id"), F.lit(2)) == 0)
    extraction.extract(half, path, fn, rows=1024)
    extraction.extract(c, path, fn, rows=1024)  # only what is missing
    return extraction.cached(t.spark, path).select("chunk_id")


@query("x4_retry_failures", "SELECT chunk_id, CASE WHEN content LIKE '%LOW' THEN 0 ELSE 1 END AS triples FROM chunks")
def _(t: Tables) -> DataFrame:
    c, path = t.chunks.select("chunk_id", "content"), scratch(t.spark, "cache")
    failed = extraction.extract(c, path, extraction.extract_batch(_entities, _triples), rows=1024)
    extraction.retry_failed(failed, extraction.extract_batch(_entities, lambda p, f: []), path)
    return extraction.cached(t.spark, path).select("chunk_id", F.size("triples").cast("long").alias("triples"))


@query("f3_verdict_call", """
grp AS (
  SELECT DISTINCT members FROM (
    SELECT string_agg(fact_id, ',' ORDER BY fact_id) AS members FROM facts GROUP BY head_key, rel_key HAVING count(*) > 1
    UNION ALL SELECT string_agg(fact_id, ',' ORDER BY fact_id) FROM facts GROUP BY rel_key, tail_key HAVING count(*) > 1))
SELECT (length(members) + 1) // 38 AS asked, members[1:37] AS target, (length(members) + 1) // 38 > 2 AS hard FROM grp
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    """A scripted verdict names the smallest fact it was shown; a group's parts are put together."""
    facts = t.mem.facts.select("fact_id", "head_key", "rel_key", "tail_key")
    groups = materialise(conflicts.conflict_groups(facts))
    verdict = lambda g: pd.DataFrame({"group_id": [g["group_id"].iloc[0]], "target": [g["fact_id"].min()], "n": [len(g)]})
    v = conflicts.verdict_call(groups, facts, verdict, "group_id string, target string, n long")
    return v.groupBy("group_id").agg(F.sum("n").alias("asked"), F.min("target").alias("target")).select("asked", "target", (F.col("asked") > 2).alias("hard"))


@query("o8_typing_call", "SELECT passage_id, n, n > 4 AS typed FROM (SELECT passage_id, count(*) AS n FROM links GROUP BY passage_id)")
def _(t: Tables) -> DataFrame:
    g = t.mem.links.groupBy("passage_id").agg(F.count("*").alias("n"))
    reply = lambda b: b.assign(reply=["{}" if n > 4 else "" for n in b["n"]])
    asked = extraction.call_twice(g, reply, "passage_id string, n long, reply string", F.col("reply") != "")
    return asked.select("passage_id", "n", (F.col("reply") != "").alias("typed"))


@query("e11_judge_call", "SELECT doc_id AS example_id, CASE WHEN doc_id % 3 = 0 THEN 'error' WHEN doc_id % 3 = 1 THEN 'correct' ELSE 'unparsed' END AS verdict FROM documents")
def _(t: Tables) -> DataFrame:
    def reply(b: pd.DataFrame) -> pd.DataFrame:
        k = b["example_id"] % 3
        return pd.DataFrame({"example_id": b["example_id"], "reply": ['{"verdict": "correct"}' if x == 1 else "?" for x in k], "error": ["down" if x == 0 else None for x in k]})

    p = t.documents.select(F.col("doc_id").alias("example_id"), F.col("lang").alias("question"), F.array("source").alias("gold_answers"), F.col("text").alias("prediction"))
    return evaluation.judge(p, reply)


@query("f9_failed_batches", "SELECT count(*) AS batches, count(*) FILTER (o_orderstatus = 'F') AS failed_batches FROM orders")
def _(t: Tables) -> DataFrame:
    return conflicts.resolution_report(t.orders.select(F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ok").alias("status")))


def _drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now and return what it wrote."""
    spark = stream.sparkSession
    out, saved = scratch(spark, name), scratch(spark, f"{name}-state")
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", saved).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("st1_stream_intake", "SELECT DISTINCT 'doc-' || md5(text) AS doc_id FROM documents")
def _(t: Tables) -> DataFrame:
    s = t.spark.readStream.schema(t.documents.schema).parquet(f"{t.dir}/documents.parquet*")
    s = s.select("text", F.timestamp_seconds(F.lit(864_000)).alias("ts"))
    return _drain(intake.stream_intake(s, delay="1 day"), "intake").select("doc_id")


@query("st2_stream_status", """
s AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, ts, CASE event_type WHEN 'signup' THEN 'parsing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'processed' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status FROM events),
l AS (SELECT doc_id, arg_max(status, (ts, status)) AS status, max(ts) AS ts FROM s GROUP BY doc_id),
w AS (SELECT *, status IN ('parsing', 'processing') AND ts + INTERVAL 6 HOUR <= (SELECT max(ts) FROM s) - INTERVAL 1 HOUR AS stuck FROM l)
SELECT doc_id, CASE WHEN stuck THEN 'pending' ELSE status END AS status, CASE WHEN stuck THEN status END AS recovered_from FROM w
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    """Users as documents; the watermark ends an hour before the last event, and six hours without one are too long."""
    s = t.spark.readStream.schema(t.events.schema).parquet(f"{t.dir}/events.parquet*")
    names = {"signup": "parsing", "click": "processing", "purchase": "processed", "error": "failed"}
    status = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("event_type")), F.lit("pending"))
    s = s.select(F.col("user_id").cast("string").alias("doc_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 hour")
    out, saved, spark = scratch(t.spark, "status"), scratch(t.spark, "status-state"), t.spark
    q = intake.stream_status(s, 6 * 3600 * 1000)
    write = lambda b, k: b.withColumn("k", F.lit(k)).write.mode("overwrite").parquet(f"{out}/b={k}")
    q.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", saved).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("doc_id").agg(F.max_by(F.struct("status", "recovered_from"), "k").alias("s"))
    return last.select("doc_id", "s.status", "s.recovered_from")


@query("st3_stream_index", "SELECT DISTINCT chunk_id FROM chunks")
def _(t: Tables) -> DataFrame:
    src, out, saved = scratch(t.spark, "chunks"), scratch(t.spark, "index"), scratch(t.spark, "index-state")
    c = t.chunks.select("chunk_id", "content")
    c.write.parquet(src)
    s = t.spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 2).parquet(src)
    intake.stream_index(s, out, saved, lambda d: d).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out).select("chunk_id")


def _store(t: Tables, name: str) -> tuple[delta.DeltaMemory, Callable[[DataFrame], DataFrame], DataFrame]:
    """A store, its extraction (the triples of the tables) and all changes: each customer is a document whose chunks are the orders."""
    triples = t.triples
    columns = ["chunk_id", "pos", "head", "relation", "tail", "head_type", "tail_type"]
    extract = lambda chunks: triples.join(chunks.select("chunk_id"), "chunk_id", "left_semi").select(columns)
    rows = t.chunks.select(F.col("o_custkey").cast("string").alias("doc_id"), "chunk_id", "content", F.lit(False).alias("removed"))
    return delta.DeltaMemory(t.spark, scratch(t.spark, name)), extract, rows


@query("st3_stream_memory", "SELECT fact_id, head, relation, tail, schema_id, frequency FROM facts")
def _(t: Tables) -> DataFrame:
    """Three micro-batches; the last repeats a part of the first."""
    store, extract, rows = _store(t, "memory")
    src, saved = scratch(t.spark, "changes"), scratch(t.spark, "memory-state")
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(2))
    for k, batch in enumerate([rows.where(part == 0), rows.where(part == 1), rows.where((part == 0) & (F.col("doc_id") % 2 == 0))]):
        batch.coalesce(1).write.parquet(f"{src}/{k}")
    s = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    delta.stream_memory(s, store, extract, saved).trigger(availableNow=True).start().awaitTermination()
    return store.memory().facts.select("fact_id", "head", "relation", "tail", "schema_id", "frequency")


@query("d5_delete_to_the_end", """
live AS (SELECT * FROM keyed WHERE chunk_id IN (SELECT chunk_id FROM chunks JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 5 <> 0)),
left_ AS (SELECT fact_id, count(DISTINCT chunk_id) AS n, arg_max(schema_id, ord) AS schema_id, min(head_key) AS h, min(tail_key) AS t FROM live GROUP BY fact_id),
typed AS (SELECT schema_id, count(*) AS n FROM left_ GROUP BY schema_id),
e2 AS (SELECT fact_id, unnest([h, t]) AS e FROM left_)
SELECT 'fact' AS kind, fact_id AS id, n FROM left_
UNION ALL SELECT 'schema', s.schema_id, coalesce(n, 0) FROM (SELECT DISTINCT schema_id FROM live) s LEFT JOIN typed USING (schema_id)
UNION ALL SELECT 'passage', chunk_id, 1 FROM chunks JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 5 <> 0 GROUP BY chunk_id
UNION ALL SELECT 'ENTITY_RELATION', least(a, b) || ' ' || greatest(a, b), count(*) FROM (SELECT 'entity-' || md5(h) AS a, 'entity-' || md5(t) AS b FROM left_ WHERE h <> t) GROUP BY least(a, b), greatest(a, b)
UNION ALL SELECT 'PASSAGE_ENTITY', 'entity-' || md5(e) || ' ' || chunk_id, 1 FROM e2 JOIN live USING (fact_id) GROUP BY e, chunk_id
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    """All documents come, those of every fifth nation go; what is left of facts, schemas, passages and edges."""
    store, extract, rows = _store(t, "deleted")
    store.apply(rows, extract, 0)
    gone = t.customer.where("c_nationkey % 5 = 0").select(F.col("c_custkey").cast("string").alias("doc_id"), F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("string").alias("content"), F.lit(True).alias("removed"))
    store.apply(gone, extract, 1)
    m, e, one = store.memory(), store.table("edges"), F.lit(1).cast("long")
    row = lambda df, kind, i, n: df.select(F.lit(kind).alias("kind"), i.alias("id"), n.alias("n"))
    return (
        row(m.facts, "fact", F.col("fact_id"), F.col("frequency")).unionByName(row(m.schemas, "schema", F.col("schema_id"), F.col("frequency"))).unionByName(row(m.passages, "passage", F.col("passage_id"), one))
        .unionByName(row(e.where("type = 'ENTITY_RELATION'"), "ENTITY_RELATION", F.concat_ws(" ", "src", "dst"), F.col("weight").cast("long"))).unionByName(row(e.where("type = 'PASSAGE_ENTITY'"), "PASSAGE_ENTITY", F.concat_ws(" ", "src", "dst"), one))
    )
