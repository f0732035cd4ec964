"""Queries over text functions, chunking, conversations, evaluation, statistics and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilayer.functions import canonical as canon
from trilayer.functions import text as tx
from trilayer.operators import chunking, evaluation, extraction, ontology, provenance, stats, threads, tokenizer
from trilayer.plans.registry import Tables, query
from trilayer.sources import files
from trilayer.streaming import intake


@query("s4_gold_docs", "SELECT item_id, string_agg(t, '|' ORDER BY f) AS gold_docs FROM (SELECT item_id, t, min(i) AS f FROM (SELECT item_id, unnest(string_split(text, ' ')) AS t, generate_subscripts(string_split(text, ' '), 1) AS i FROM benchmark) WHERE t <> '' GROUP BY item_id, t) GROUP BY item_id")
def _(t: Tables) -> DataFrame:
    cited = F.transform(F.split("text", " "), lambda w: F.array(w, F.lit("0")))
    none = F.lit(None).cast("array<struct<title:string,is_supporting:boolean>>")
    return t.benchmark.select("item_id", F.array_join(evaluation.gold_docs(cited, none, F.lit("source")), "|").alias("gold_docs"))


@query("s5_gold_answers", "SELECT item_id, string_agg(t, '|' ORDER BY f) AS gold_answers FROM (SELECT item_id, t, min(i) AS f FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM benchmark) WHERE trim(t) <> '' GROUP BY item_id, t) GROUP BY item_id")
def _(t: Tables) -> DataFrame:
    lines = F.split("text", "\n", -1)
    return t.benchmark.select("item_id", F.array_join(evaluation.gold_answers(lines, lines), "|").alias("gold_answers"))


@query("s6_titled_text", "SELECT doc_id, CASE WHEN lang <> '' THEN lang || chr(10) || text ELSE text END AS content FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.titled_text(F.col("lang"), F.col("text")).alias("content"))


@query("s8_block_sidecar", """
b AS (SELECT doc_id, pos, content FROM (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, string_split(text, chr(10))[i] AS content FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)) WHERE trim(content) <> '')
SELECT doc_id, count(*) AS blocks, sha256(string_agg(content, chr(10) || chr(10) ORDER BY pos)) AS sha256 FROM b GROUP BY doc_id
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    b = t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "content")).withColumn("heading", F.lit(""))
    return files.sidecar(b)[1]


@query("s11_parse_routing", """
SELECT file_path, CASE WHEN doc_id % 5 = 0 THEN 'fast' WHEN file_path LIKE '%.txt' THEN 'plain' ELSE 'legacy' END AS engine, CASE WHEN doc_id % 5 = 0 THEN 'R' ELSE 'P' END AS strategy
FROM (SELECT CAST(doc_id AS BIGINT) AS doc_id, CASE WHEN CAST(doc_id AS BIGINT) % 5 = 0 THEN replace(file_path, '.txt', ' [fast-R].txt') ELSE file_path END AS file_path FROM status)
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    f = t.status.select(F.when(F.col("doc_id").cast("long") % 5 == 0, F.replace("file_path", F.lit(".txt"), F.lit(" [fast-R].txt"))).otherwise(F.col("file_path")).alias("file_path"))
    rules = t.spark.createDataFrame([(1, "pdf", "ocr", "F"), (2, "t.*", "plain", "P"), (3, ".*", "other", "")], "no int, pattern string, engine string, options string")
    return files.route_files(f, rules)


_MARKS = {0: ".[fast-Ri].txt", 1: ".[-P].txt", 2: ".pdf", 3: ".[nope].txt", 4: ".[ocr].txt", 5: ".[].txt"}


@query("s11_parser_directives", """
SELECT CASE doc_id % 7 WHEN 0 THEN replace(file_path, '.txt', '.[fast-Ri].txt') WHEN 1 THEN replace(file_path, '.txt', '.[-P].txt') WHEN 2 THEN replace(file_path, '.txt', '.pdf') WHEN 3 THEN replace(file_path, '.txt', '.[nope].txt') WHEN 4 THEN replace(file_path, '.txt', '.[ocr].txt') WHEN 5 THEN replace(file_path, '.txt', '.[].txt') ELSE file_path END AS file_path,
  CASE WHEN doc_id % 7 = 0 THEN 'fast' WHEN doc_id % 7 IN (1, 6) THEN 'plain' WHEN doc_id % 7 = 2 THEN 'ocr' END AS engine,
  CASE doc_id % 7 WHEN 0 THEN 'Ri' WHEN 1 THEN 'P' WHEN 2 THEN 'ite' WHEN 6 THEN 'Pe' END AS options,
  CASE doc_id % 7 WHEN 0 THEN 'R' WHEN 1 THEN 'P' WHEN 2 THEN 'F' WHEN 6 THEN 'P' END AS strategy,
  CASE doc_id % 7 WHEN 3 THEN 'unknown engine' WHEN 4 THEN 'engine does not take the suffix' WHEN 5 THEN 'empty hint' END AS error
FROM (SELECT CAST(doc_id AS BIGINT) AS doc_id, file_path FROM status)
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    mark = F.element_at(F.create_map(*[F.lit(x) for kv in _MARKS.items() for x in kv]), (F.col("doc_id").cast("long") % 7).cast("int"))
    f = t.status.select(F.replace("file_path", F.lit(".txt"), F.coalesce(mark, F.lit(".txt"))).alias("file_path"))
    rules = t.spark.createDataFrame([(1, "t?t", "Plain-xPe"), (2, "[!t]*", "ocr-lite"), (3, "*", "fast")], "no int, pattern string, hint string")
    engines = t.spark.createDataFrame([("fast", "txt"), ("plain", "txt"), ("ocr", "pdf")], "engine string, suffix string")
    return files.route_parsers(f, rules, engines)


@query("t1_hash_id", "SELECT doc_id, 'doc-' || md5(text) AS id FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.hash_id(F.col("text"), "doc-").alias("id"))


@query("t2_canonical_key", "SELECT doc_id, md5(trim(regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'), '\\s+', ' ', 'g'))) AS key FROM documents")
def _(t: Tables) -> DataFrame:
    return canon.canonical(t.documents.select("doc_id", "text"), {"text": "key"}).select("doc_id", F.md5("key").alias("key"))


@query("t4_strip_accents", "SELECT doc_id, md5(strip_accents(text)) AS plain FROM documents")
def _(t: Tables) -> DataFrame:
    return canon.strip_accents(t.documents.select("doc_id", "text"), "text", "plain").select("doc_id", F.md5("plain").alias("plain"))


@query("t5_preview", "SELECT doc_id, CASE WHEN length(c) > 200 THEN left(c, 197) || '...' ELSE c END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM documents)")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.preview(F.col("text")).alias("preview"))


@query("t6_content_ids", "SELECT DISTINCT chunk_id FROM doc_chunk")
def _(t: Tables) -> DataFrame:
    return t.doc_chunk.select(tx.hash_id(F.trim("content"), "chunk-").alias("chunk_id")).distinct()


@query("t8_query_prefix", "SELECT item_id, 'query: ' || text AS text FROM benchmark")
def _(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", tx.prefix_query(tx.prefix_query(F.col("text"), "query: "), "query: ").alias("text"))


@query("t9_token_estimate", "SELECT doc_id, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query("t10_truncation", "SELECT doc_id, left(text, 80) AS cut, CASE WHEN len(w) > 32 THEN array_to_string(w[1:32], ' ') ELSE text END AS words FROM (SELECT doc_id, text, regexp_extract_all(text, '\\S+') AS w FROM documents)")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.truncate_chars(F.col("text"), 32).alias("cut"), tx.truncate_tokens(F.col("text"), 32).alias("words"))


@query("t11_json_object", "SELECT event_id, props AS fenced, props AS bare, '{}' AS none FROM events")
def _(t: Tables) -> DataFrame:
    p = F.col("props")
    return t.events.select(
        "event_id",
        tx.json_object(F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```\nDone {x}"))).alias("fenced"),
        tx.json_object(F.concat(F.lit("It is "), p, F.lit(" indeed"))).alias("bare"),
        tx.json_object(F.replace(p, F.lit("{"), F.lit("("))).alias("none"),
    )


def _final_sql(x: str) -> str:
    """SQL of what a reply says in its first final channel."""
    bare = rf"regexp_replace(regexp_replace(regexp_replace({x}, '(^|<\|[^|>]*\|>)(analysis|final|commentary)\b\s*', '', 'g'), '<\|[^|>]*\|>', '', 'g'), '^\s+|\s+$', '', 'g')"
    return rf"""CASE WHEN contains({x}, '{tx.FINAL_TAG}') THEN string_split(substr({x}, instr({x}, '{tx.FINAL_TAG}') + 27), '<|')[1] WHEN contains({x}, '<|') THEN {bare}
    WHEN regexp_matches({x}, '^(analysis|commentary)\S') THEN CASE WHEN contains({x}, '{tx.FINAL_WORD}') THEN substr({x}, instr({x}, '{tx.FINAL_WORD}') + 14) ELSE {bare} END ELSE {x} END"""


#: Replies around a conversation's text: marked, with two final channels, welded, welded with two final words, without a final channel, plain.
REPLIES = {
    "tagged": ("<|channel|>analysis<|message|>think<|end|><|channel|>final<|message|>", "<|return|>"),
    "twice": ("<|channel|>final<|message|>", "<|end|><|channel|>final<|message|>two"),
    "welded": ("analysisthinking assistantfinal", ""),
    "welded_twice": ("commentaryx assistantfinal", " assistantfinal second"),
    "no_final": ("<|channel|>analysis<|message|>", "<|end|>"),
    "plain": ("", ""),
}


@query("t12_final_channel", "SELECT conv_id, turn, " + ", ".join(f"{_final_sql(name)} AS {name}" for name in REPLIES) + " FROM (SELECT conv_id, turn, " + ", ".join(f"'{a}' || text || '{b}' AS {name}" for name, (a, b) in REPLIES.items()) + " FROM conversations)")
def _(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", *[tx.final_channel(F.concat(F.lit(a), F.col("text"), F.lit(b))).alias(name) for name, (a, b) in REPLIES.items()])


C1 = """
w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents),
c AS (SELECT doc_id, CAST(s // 40 AS INTEGER) AS chunk_order, w[s + 1 : s + 50] AS p FROM (SELECT doc_id, w, unnest(range(0, len(w), 40)) AS s FROM w))
"""


@query("c1_fixed_windows", C1 + "SELECT doc_id, chunk_order, CAST(len(p) AS INTEGER) AS tokens, array_to_string(p, ' ') AS content FROM c")
def _(t: Tables) -> DataFrame:
    return chunking.chunk_fixed(t.documents, 50, 10)


@query("u2_token_windows", C1 + "SELECT doc_id, chunk_order, CAST(len(p) AS INTEGER) AS tokens, array_to_string(p, ' ') AS content FROM c")
def _(t: Tables) -> DataFrame:
    """Whitespace tokens through the hook: windows cut from the text, their blanks made one for the comparison."""
    w = tokenizer.chunk_tokens(t.documents, tokenizer.PatternTokens(), 50, 10)
    return w.withColumn("content", F.regexp_replace("content", r"\s+", " "))


@query("u2_token_counts", "SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS tokens FROM documents")
def _(t: Tables) -> DataFrame:
    return tokenizer.token_counts(t.documents, tokenizer.PatternTokens()).select("doc_id", "tokens")


@query("c2_separator_windows", """
p AS (SELECT doc_id, i AS p, regexp_extract_all(string_split(text, chr(10))[i], '\\S+') AS w FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
c AS (SELECT doc_id, p, s, w[s + 1 : s + 30] AS x FROM (SELECT doc_id, p, w, unnest(range(0, len(w), 25)) AS s FROM p))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p, s) - 1 AS INTEGER) AS chunk_order, CAST(len(x) AS INTEGER) AS tokens, array_to_string(x, ' ') AS content FROM c
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return chunking.chunk_split(t.documents, "\n", 30, 5)


@query("c3_recursive_split")
def _(t: Tables) -> DataFrame:
    return chunking.chunk_recursive(t.documents, 60)


def _blocks(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "content")).withColumn("heading", F.concat(F.lit("part "), F.col("pos").cast("string")))


@query("c4_paragraph_merge")
def _(t: Tables) -> DataFrame:
    return chunking.chunk_blocks(_blocks(t), 80)


@query("c5_blocks_or_text")
def _(t: Tables) -> DataFrame:
    return chunking.chunk_blocks_or_text(t.documents, _blocks(t).where("doc_id % 2 = 0"), 80)


@query("c6_strategy_dispatch")
def _(t: Tables) -> DataFrame:
    s = F.element_at(F.array(F.lit("F"), F.lit("R"), F.lit("P")), (F.col("doc_id") % 3 + 1).cast("int"))
    return chunking.chunk(t.documents.withColumn("strategy", s), _blocks(t), 80, 10)


@query("c7_titled_chunks", C1 + "SELECT doc_id, chunk_order, CAST(len(p) AS INTEGER) AS tokens, CASE WHEN starts_with(array_to_string(p, ' '), lang) THEN array_to_string(p, ' ') ELSE lang || chr(10) || array_to_string(p, ' ') END AS content FROM c JOIN documents USING (doc_id)")
def _(t: Tables) -> DataFrame:
    return chunking.chunk_corpus(t.documents, 50, 10, title_col="lang")


@query("c8_table_markdown", "SELECT o_orderkey, '| key | status |' || chr(10) || '|---|---|' || chr(10) || '| ' || o_orderkey || ' | ' || o_orderstatus || ' |' || chr(10) || '| only |  |' AS md FROM orders")
def _(t: Tables) -> DataFrame:
    j = F.concat(F.lit('[["key","status"],["'), F.col("o_orderkey").cast("string"), F.lit('","'), F.col("o_orderstatus"), F.lit('"],["only"]]'))
    return t.orders.select("o_orderkey", tx.table_markdown(j).alias("md"))


@query("c9_drawing_text", "SELECT p_partkey AS id, '[Image] ' || p_name || '. ' || p_type || ' Text read in the image: ' || p_brand AS text FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, '[Image] Text read in the image: ' || p_brand FROM part WHERE p_size % 2 = 1")
def _(t: Tables) -> DataFrame:
    e = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "success").otherwise("error").alias("status"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.lit(" ").alias("caption"), F.array(F.col("p_brand"), F.lit(" ")).alias("ocr_texts"))
    return chunking.drawing_text(e)


@query("c10_inline_markup", "SELECT o_orderkey AS doc_id, CAST(0 AS INTEGER) AS pos, 'see ' || o_orderstatus || ' and  here' AS content FROM orders")
def _(t: Tables) -> DataFrame:
    b = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("pos"), F.lit('see <table id="a"/> and <drawing id="zz">x</drawing> here').alias("content"))
    e = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.lit("a").alias("ref"), F.col("o_orderstatus").alias("text"))
    return chunking.inline_markup(b, e)


@query("c11_unkern", "SELECT c_custkey, 'a ' || c_mktsegment || ' b' AS text, CAST(1 AS BIGINT) AS fixed FROM customer")
def _(t: Tables) -> DataFrame:
    spaced = F.array_join(F.split("c_mktsegment", ""), " ")
    glued, n = tx.unkern(F.concat(F.lit("a  "), spaced, F.lit("  b")))
    return t.customer.select("c_custkey", F.replace(glued, F.lit("  "), F.lit(" ")).alias("text"), n.alias("fixed"))


@query("c12_import_stats", "SELECT doc_id, count(*) AS blocks, sum(length(content)) AS chars, sum(len(regexp_extract_all(content, '\\S+'))) AS tokens FROM doc_chunk GROUP BY ROLLUP (doc_id)")
def _(t: Tables) -> DataFrame:
    return chunking.import_stats(t.doc_chunk)


RECORDS = """
rec AS (SELECT o_orderkey AS chunk_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 3 = 1 END AS failed, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS n FROM orders)
"""


def _records(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    e = F.when(k % 2 == 0, F.array(F.col("o_orderstatus"))).otherwise(F.array().cast("array<string>"))
    return t.orders.select(k.alias("chunk_id"), F.when(k % 3 != 0, k % 3 == 1).alias("failed"), e.alias("entities"), F.array().cast("array<string>").alias("triples"))


@query("x1_cache_hit", RECORDS + "SELECT chunk_id, CASE WHEN failed IS NULL THEN n > 0 ELSE NOT failed END AS hit FROM rec")
def _(t: Tables) -> DataFrame:
    return _records(t).select("chunk_id", extraction.is_hit().alias("hit"))


@query("x2_missing_chunks", RECORDS + "SELECT chunk_id FROM rec WHERE NOT CASE WHEN failed IS NULL THEN n > 0 ELSE NOT failed END")
def _(t: Tables) -> DataFrame:
    return extraction.missing_chunks(t.orders.select(F.col("o_orderkey").alias("chunk_id")), _records(t))


@query("x6_entity_normalisation", "SELECT c_custkey, c_name || '|' || c_mktsegment AS entities FROM customer")
def _(t: Tables) -> DataFrame:
    raw = F.concat(F.lit('[" '), F.col("c_name"), F.lit(' ", "", {"entity": "'), F.col("c_mktsegment"), F.lit('"}, "'), F.col("c_name"), F.lit('", {"x": 1}]'))
    return t.customer.select("c_custkey", F.array_join(extraction.normalise_entities(raw), "|").alias("entities"))


@query("x7_triple_normalisation", "SELECT c_custkey, c_name || '>lives in>' || c_nationkey || '|a>b>' || c_mktsegment AS triples FROM customer")
def _(t: Tables) -> DataFrame:
    raw = F.concat(F.lit('[["'), F.col("c_name"), F.lit('", "lives in", "'), F.col("c_nationkey").cast("string"), F.lit('"], ["x", " ", "y"], ["short"], {"raw_triple": ["a", "b", "'), F.col("c_mktsegment"), F.lit('"]}]'))
    line = F.transform(extraction.normalise_triples(raw), lambda s: F.concat_ws(">", s["head"], s["relation"], s["tail"]))
    return t.customer.select("c_custkey", F.array_join(line, "|").alias("triples"))


@query("x8_triple_parsing", "SELECT c_custkey, c_name || '>r>t|a>>' || c_mktsegment AS triples FROM customer")
def _(t: Tables) -> DataFrame:
    raw = F.concat(F.lit('[{"triple_str": "(\''), F.col("c_name"), F.lit("', 'r', 't')\"}, {\"foo\": \"bar\"}, {\"processed_triple\": [\"a\", \"\", \""), F.col("c_mktsegment"), F.lit('"]}]'))
    line = F.transform(extraction.parse_triples(raw), lambda s: F.concat_ws(">", s["head"], s["relation"], s["tail"]))
    return t.customer.select("c_custkey", F.array_join(line, "|").alias("triples"))


@query("o9_type_reply", """
SELECT c_custkey, CAST(CASE c_custkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS pairs, CASE WHEN c_custkey % 4 < 2 THEN c_name END AS head, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'A' END AS last_type FROM customer
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    pair = F.concat(F.lit('{"triple": ["'), F.col("c_name"), F.lit('", "r", "t"], "types": ["A", "r", "B"]}'))
    other = F.concat(F.lit('{"triple": ["x", "r", "y"], "types": ["'), F.col("c_mktsegment"), F.lit('", "r", "B"]}'))
    uneven = F.lit('{"triple": ["x"], "types": ["A", "r", "B"]}')
    k = F.col("c_custkey") % 4  # two pairs; one and an uneven one; an uneven one; no JSON
    found = F.when(k == 0, F.concat_ws(", ", pair, other)).when(k == 1, F.concat_ws(", ", uneven, pair)).when(k == 2, uneven)
    p = ontology.parse_types(F.coalesce(F.concat(F.lit('Sure: {"typed": ['), found, F.lit("]} ok")), F.lit("I can't say.")))
    return t.customer.select("c_custkey", F.size(p).cast("long").alias("pairs"), F.get(p, F.lit(0))["triple"][0].alias("head"), F.try_element_at(p, F.lit(-1))["types"][0].alias("last_type"))


@query("h1_thread_titles", """
f AS (SELECT conv_id AS thread_id, trim(regexp_replace(coalesce(arg_min(text, turn) FILTER (role = 'user'), ''), '\\s+', ' ', 'g')) AS t FROM conversations GROUP BY conv_id)
SELECT thread_id, CASE WHEN t = '' THEN 'New chat' WHEN length(t) > 120 THEN left(t, 120) || '…' ELSE t END AS title FROM f
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return threads.titles(t.messages)


@query("h2_thread_list", """
th AS (SELECT conv_id AS thread_id, conv_id % 7 AS o, max(turn) AS updated_at FROM conversations GROUP BY conv_id)
SELECT thread_id, updated_at, (SELECT count(*) FROM th WHERE o = 3) AS total FROM th WHERE o = 3 ORDER BY updated_at DESC, thread_id DESC LIMIT 20
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    th = threads.last_activity(t.messages).withColumn("owner", (F.col("thread_id") % 7).cast("string"))
    return threads.list_threads(th, "3", 20).select("thread_id", "updated_at", "total")


@query("h3_ordered_messages", "SELECT conv_id AS thread_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS number FROM conversations")
def _(t: Tables) -> DataFrame:
    return threads.thread_messages(t.messages, t.messages).select("thread_id", "turn", F.col("number").cast("long").alias("number"))


@query("h4_last_activity", "SELECT conv_id AS thread_id, max(turn) AS updated_at, count(*) AS messages FROM conversations GROUP BY conv_id")
def _(t: Tables) -> DataFrame:
    return threads.last_activity(t.messages)


@query("h5_role_validation", "SELECT role IN ('user', 'assistant') AS valid, count(*) AS n FROM conversations GROUP BY 1")
def _(t: Tables) -> DataFrame:
    ok, bad = threads.split_roles(t.messages)
    return ok.withColumn("valid", F.lit(True)).union(bad.withColumn("valid", F.lit(False))).groupBy("valid").agg(F.count("*").alias("n"))


@query("h6_cascade_delete", "SELECT conv_id AS thread_id, count(*) AS n FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id")
def _(t: Tables) -> DataFrame:
    th = threads.last_activity(t.messages)
    return threads.delete_threads(th, t.messages, th.where("thread_id % 3 = 0"))[1].groupBy("thread_id").agg(F.count("*").alias("n"))


@query("h7_context_budget", """
m AS (SELECT conv_id, turn, role, text, greatest(1, length(coalesce(text, '')) // 4) + 4 AS cost FROM conversations),
s AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id) AS total, coalesce(sum(CASE WHEN role = 'assistant' THEN cost - 5 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS saved FROM m)
SELECT conv_id AS thread_id, turn, CAST(cost AS BIGINT) AS cost, role = 'assistant' AND total - saved > 150 AS evicted FROM s
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return threads.evict(t.messages, 150, "assistant").select("thread_id", "turn", "cost", "evicted")


_QUOTED = [x.replace("'", "''") for x in (tx.FOLD_FROM.replace("`", ""), tx.FOLD_TO.replace("\'\'\'\'\'", "\'\'\'\'"))]
_NOT_WORD = r"[^\p{L}\p{N}\p{M}_]"
_STEPS = [
    (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"(?m)^\s{0,3}(#{1,6}\s+|>\s+|[-*+]\s+|\d+[.)]\s+)", ""), (r"\*\*|__|\*|_|`+|~~", ""), (r"[\[【]\s*\d+(?:\s*,\s*\d+)*\s*[\]】]", " "),
    (None, None), (r"[!-/:-@\[-`{-~]", " "), (f"({_NOT_WORD})", "\\1\x01"), (rf"(^|\x01)(a|an|the)({_NOT_WORD}|$)", r"\1 \3"), ("\x01", ""),
    (r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", " "),
]


def norm(text: str) -> str:
    """SQL of the comparison form of an SQL string; a word's borders are marked, since the dialect can't look around."""
    out = f"replace(translate(coalesce({text}, ''), '{_QUOTED[0]}', '{_QUOTED[1]}'), '…', '...')"
    for pattern, by in _STEPS:
        out = f"lower({out})" if pattern is None else f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"trim({out})"


PREDS = f"""
pred AS (SELECT doc_id AS example_id, text, array_to_string(regexp_extract_all(text, '\\S+')[3:12], ' ') AS g1 FROM documents),
pt AS MATERIALIZED (SELECT example_id, {norm("text")} AS p FROM pred),
gt AS MATERIALIZED (SELECT example_id, 1 AS no, {norm("g1")} AS g FROM pred UNION ALL SELECT example_id, 2, p FROM pt WHERE example_id % 4 = 0),
pw AS MATERIALIZED (SELECT example_id, p, CASE WHEN p = '' THEN 0 ELSE len(string_split(p, ' ')) END AS np FROM pt),
gw AS MATERIALIZED (SELECT example_id, no, g, CASE WHEN g = '' THEN 0 ELSE len(string_split(g, ' ')) END AS ng FROM gt)
"""
STR_ACC = PREDS + """,
sh AS (SELECT example_id, bool_or(ng > 0 AND contains(' ' || array_to_string(string_split(p, ' ')[1:WINDOW], ' ') || ' ', ' ' || g || ' ')) AS hit, min(ng) FILTER (ng > 0) AS least, any_value(np) AS np FROM pw JOIN gw USING (example_id) GROUP BY example_id),
sa AS (SELECT example_id, hit, hit AND np > 10 * least AS "verbose", np > WINDOW AS truncated FROM sh)
"""


def _preds(t: Tables) -> DataFrame:
    w = tx.word_tokens(F.col("text"))
    golds = F.when(F.col("doc_id") % 4 == 0, F.array(F.array_join(F.slice(w, 3, 10), " "), F.col("text"))).otherwise(F.array(F.array_join(F.slice(w, 3, 10), " ")))
    return t.documents.select(F.col("doc_id").alias("example_id"), F.col("text").alias("prediction"), golds.alias("gold_answers"))


@query("e1_answer_normalisation", f"SELECT doc_id, md5({norm('text')}) AS form FROM documents")
def _(t: Tables) -> DataFrame:
    return canon.compatible(t.documents.select("doc_id", "text"), "text").select("doc_id", F.md5(tx.normalise_answer(F.col("text"), folded=True)).alias("form"))


@query("e2_answer_tokens", PREDS + "SELECT example_id AS doc_id, CAST(np AS INTEGER) AS n FROM pw")
def _(t: Tables) -> DataFrame:
    return canon.compatible(t.documents.select("doc_id", "text"), "text").select("doc_id", F.size(tx.tokens(F.col("text"), folded=True)).alias("n"))


@query("e3_document_key", "SELECT c_custkey, 'the ' || lower(replace(c_name, '#', ' ')) AS key FROM customer")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", tx.doc_key(F.concat(F.lit("The "), F.col("c_name"), F.lit("."))).alias("key"))


@query("e4_exact_match", PREDS + "SELECT example_id, CAST(bool_or(p = g) AS DOUBLE) AS value FROM pw JOIN gw USING (example_id) GROUP BY example_id")
def _(t: Tables) -> DataFrame:
    return evaluation.exact_match(_preds(t))


@query("e5_token_f1", PREDS + """,
pc AS (SELECT example_id, t, count(*) AS a FROM (SELECT example_id, unnest(string_split(p, ' ')) AS t FROM pw WHERE np > 0) GROUP BY 1, 2),
gc AS (SELECT example_id, no, t, count(*) AS b FROM (SELECT example_id, no, unnest(string_split(g, ' ')) AS t FROM gw WHERE ng > 0) GROUP BY 1, 2, 3),
same AS (SELECT example_id, no, sum(least(a, b)) AS n FROM pc JOIN gc USING (example_id, t) GROUP BY 1, 2)
SELECT example_id, round(max(coalesce(2.0 * n / (np + ng), 0)), 9) AS value FROM gw JOIN pw USING (example_id) LEFT JOIN same USING (example_id, no) GROUP BY example_id
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return evaluation.token_f1(_preds(t)).select("example_id", F.round("value", 9).alias("value"))


@query("e6_str_acc", STR_ACC.replace("WINDOW", "200") + "SELECT example_id, hit, \"verbose\", truncated FROM sa")
def _(t: Tables) -> DataFrame:
    return evaluation.str_acc(_preds(t))


@query("e7_str_acc_audit", STR_ACC.replace("WINDOW", "20") + "SELECT avg(CAST(hit AS DOUBLE)) AS str_acc, count(*) FILTER (\"verbose\") / CAST(count(*) FILTER (hit) AS DOUBLE) AS verbose_hit_rate, avg(CAST(truncated AS DOUBLE)) AS truncated_rate FROM sa")
def _(t: Tables) -> DataFrame:
    return evaluation.str_acc_audit(evaluation.str_acc(_preds(t), 20))


RETR = """
gold AS (SELECT DISTINCT o_orderkey AS example_id, 'part ' || l_partkey AS key FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber <= 2),
ret AS (SELECT l_orderkey AS example_id, 'part ' || l_partkey AS key, min(l_linenumber) AS rank FROM lineitem WHERE l_linenumber <> 1 GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY rank, key) AS place FROM ret),
ex AS (SELECT o_orderkey AS example_id FROM orders),
ov AS (SELECT example_id, coalesce(ng, 0) AS ng, coalesce(nr, 0) AS nr, coalesce(nb, 0) AS nb FROM ex
  LEFT JOIN (SELECT example_id, count(*) AS ng FROM gold GROUP BY 1) USING (example_id) LEFT JOIN (SELECT example_id, count(*) AS nr FROM rk GROUP BY 1) USING (example_id)
  LEFT JOIN (SELECT example_id, count(*) AS nb FROM gold JOIN rk USING (example_id, key) GROUP BY 1) USING (example_id))
"""


def _retrieval(t: Tables) -> tuple[DataFrame, DataFrame]:
    part = F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))
    gold = t.lineitem.where("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("example_id")).agg(F.collect_set(part).alias("gold_docs"))
    ex = t.orders.select(F.col("o_orderkey").alias("example_id")).join(gold, "example_id", "left")
    return ex, t.lineitem.where("l_linenumber <> 1").select(F.col("l_orderkey").alias("example_id"), F.col("l_linenumber").alias("rank"), part.alias("title"))


@query("e8_recall_at_k", RETR + "SELECT example_id, k, coalesce(count(*) FILTER (place <= k) / CAST(nullif(count(key), 0) AS DOUBLE), 0) AS value FROM ex CROSS JOIN (SELECT CAST(unnest([1, 5, 10, 20]) AS INTEGER) AS k) LEFT JOIN gold USING (example_id) LEFT JOIN rk USING (example_id, key) GROUP BY example_id, k")
def _(t: Tables) -> DataFrame:
    return evaluation.recall_at_k(*_retrieval(t))


@query("e9_evidence_recall", RETR + "SELECT example_id, coalesce(nb / CAST(nullif(ng, 0) AS DOUBLE), 0) AS value FROM ov")
def _(t: Tables) -> DataFrame:
    return evaluation.evidence_recall(*_retrieval(t))


@query("e10_context_relevance", RETR + "SELECT example_id, coalesce(nb / CAST(nullif(nr, 0) AS DOUBLE), 0) AS value FROM ov")
def _(t: Tables) -> DataFrame:
    return evaluation.context_relevance(*_retrieval(t))


@query("e11_judge_parse", "SELECT doc_id, CASE WHEN quality = 1 THEN 'correct' WHEN toxic = 1 THEN 'incorrect' ELSE 'unparsed' END AS verdict FROM labels")
def _(t: Tables) -> DataFrame:
    v = F.when(F.col("quality") == 1, 'I say {"verdict": "Correct"}').when(F.col("toxic") == 1, '```json\n{"verdict": "incorrect"}\n```').otherwise("no idea")
    return t.labels.select("doc_id", evaluation.parse_verdict(v).alias("verdict"))


@query("e12_judge_summary", "SELECT avg(CAST(quality = 1 AS DOUBLE)) AS accuracy, avg(CAST(toxic = 1 AND quality <> 1 AS DOUBLE)) AS unparsed_rate FROM labels")
def _(t: Tables) -> DataFrame:
    return evaluation.judge_summary(t.labels.select(F.when(F.col("quality") == 1, "correct").when(F.col("toxic") == 1, "unparsed").otherwise("incorrect").alias("verdict")))


RUN = f"""
pred AS (SELECT doc_id AS example_id, text, array_to_string(regexp_extract_all(text, '\\S+')[3:12], ' ') AS g1 FROM documents),
whole AS MATERIALIZED (SELECT example_id, {norm("text")} AS p FROM pred),
pt AS (SELECT example_id, CASE WHEN example_id % 10 = 0 THEN '' ELSE p END AS p FROM whole),
gt AS MATERIALIZED (SELECT example_id, 1 AS no, {norm("g1")} AS g FROM pred UNION ALL SELECT example_id, 2, p FROM whole WHERE example_id % 4 = 0),
pw AS MATERIALIZED (SELECT example_id, p, CASE WHEN p = '' THEN 0 ELSE len(string_split(p, ' ')) END AS np FROM pt),
gw AS MATERIALIZED (SELECT example_id, no, g, CASE WHEN g = '' THEN 0 ELSE len(string_split(g, ' ')) END AS ng FROM gt)
"""
RUN = RUN + STR_ACC[len(PREDS):].replace("WINDOW", "200").rstrip() + """,
pc AS (SELECT example_id, t, count(*) AS a FROM (SELECT example_id, unnest(string_split(p, ' ')) AS t FROM pw WHERE np > 0) GROUP BY 1, 2),
gc AS (SELECT example_id, no, t, count(*) AS b FROM (SELECT example_id, no, unnest(string_split(g, ' ')) AS t FROM gw WHERE ng > 0) GROUP BY 1, 2, 3),
same AS (SELECT example_id, no, sum(least(a, b)) AS n FROM pc JOIN gc USING (example_id, t) GROUP BY 1, 2),
f1 AS (SELECT example_id, max(coalesce(2.0 * n / (np + ng), 0)) AS v FROM gw JOIN pw USING (example_id) LEFT JOIN same USING (example_id, no) GROUP BY example_id),
em AS (SELECT example_id, CAST(bool_or(p = g) AS DOUBLE) AS v FROM pw JOIN gw USING (example_id) GROUP BY example_id),
gold AS (SELECT DISTINCT doc_id, lower(unnest([lang, source])) AS key FROM documents),
found AS (SELECT doc_id, key, min(rank) AS rank FROM (SELECT doc_id, lower(source) AS key, 2 AS rank FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'the ' || lower(lang), 1 FROM documents UNION ALL SELECT doc_id, lower(lang), 3 FROM documents WHERE doc_id % 2 = 0) GROUP BY 1, 2),
place AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank, key) AS place FROM found),
ov AS (SELECT d.doc_id, count(DISTINCT gold.key) AS ng, count(place.key) AS nb, any_value(nf) AS nf, count(place.key) FILTER (place <= 1) AS b1, count(place.key) FILTER (place <= 5) AS b5
  FROM documents d LEFT JOIN gold USING (doc_id) LEFT JOIN place ON place.doc_id = d.doc_id AND place.key = gold.key LEFT JOIN (SELECT doc_id, count(*) AS nf FROM place GROUP BY 1) c ON c.doc_id = d.doc_id GROUP BY d.doc_id),
m(metric, value) AS (
  SELECT 'exact_match', avg(v) FROM em UNION ALL SELECT 'token_f1', avg(v) FROM f1
  UNION ALL SELECT 'str_acc', avg(CAST(hit AS DOUBLE)) FROM sa UNION ALL SELECT 'verbose_hit_rate', coalesce(count(*) FILTER ("verbose") / CAST(nullif(count(*) FILTER (hit), 0) AS DOUBLE), 0) FROM sa
  UNION ALL SELECT 'truncated_rate', avg(CAST(truncated AS DOUBLE)) FROM sa UNION ALL SELECT 'failures', count(*) FILTER (doc_id % 10 = 0) FROM documents
  UNION ALL SELECT 'recall@1', avg(b1 / CAST(ng AS DOUBLE)) FROM ov UNION ALL SELECT 'recall@5', avg(b5 / CAST(ng AS DOUBLE)) FROM ov
  UNION ALL SELECT 'evidence_recall', avg(nb / CAST(ng AS DOUBLE)) FROM ov UNION ALL SELECT 'context_relevance', avg(nb / CAST(nf AS DOUBLE)) FROM ov
  UNION ALL SELECT 'llm_acc', avg(CAST(doc_id % 7 = 1 AS DOUBLE)) FROM documents UNION ALL SELECT 'unparsed_rate', avg(CAST(doc_id % 7 = 2 AS DOUBLE)) FROM documents)
"""


@query("e13_run_scores", RUN + "SELECT metric, round(CAST(value AS DOUBLE), 9) AS value FROM m")
def _(t: Tables) -> DataFrame:
    """Documents as examples: one in ten fails, sources and languages are titles, and a scripted judge leaves most unjudged."""
    p, d = _preds(t), t.documents
    examples = p.select("example_id", "gold_answers").join(d.select(F.col("doc_id").alias("example_id"), F.array("lang", "source").alias("gold_docs")), "example_id")
    row = lambda df, rank, title: df.select(F.col("doc_id").alias("example_id"), F.lit(rank).alias("rank"), title.alias("title"))
    got = row(d.where("doc_id % 3 <> 0"), 2, F.col("source")).union(row(d, 1, F.concat(F.lit("The "), F.col("lang"), F.lit(".")))).union(row(d.where("doc_id % 2 = 0"), 3, F.col("lang")))
    verdict = F.when(F.col("doc_id") % 7 == 1, "correct").when(F.col("doc_id") % 7 == 2, "unparsed").otherwise("incorrect")
    judged = d.where("doc_id % 7 < 4").select(F.col("doc_id").alias("example_id"), verdict.alias("verdict"))
    s = evaluation.score_run(examples, p.select("example_id", "prediction", (F.col("example_id") % 10 == 0).alias("failed")), got, judged, (1, 5))
    return s.select("metric", F.round("value", 9).alias("value"))


RUNS = """
r AS (SELECT event_type AS metric, user_id % 5 AS run, avg(value) AS value FROM events GROUP BY 1, 2),
a AS (SELECT metric, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS stdev, min(value) AS min, max(value) AS max, count(*) AS n FROM r GROUP BY metric)
"""


def _runs(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("metric"), (F.col("user_id") % 5).alias("run")).agg(F.avg("value").alias("value"))


@query("e14_campaign_aggregate", RUNS + "SELECT metric, round(mean, 6) AS mean, round(stdev, 6) AS stdev, round(min, 6) AS min, round(max, 6) AS max, n, round(1.96 * stdev / sqrt(n), 6) AS ci95 FROM a")
def _(t: Tables) -> DataFrame:
    a = evaluation.aggregate_runs(_runs(t))
    return a.select("metric", *[F.round(c, 6).alias(c) for c in ("mean", "stdev", "min", "max")], "n", F.round("ci95", 6).alias("ci95"))


@query("e15_golden_comparison", RUNS + "SELECT metric, round(0.1 * mean, 6) AS delta, CASE WHEN 0.1 * mean > CASE WHEN stdev > 0 THEN 2 * stdev ELSE 0.01 END THEN 'better' WHEN 0.1 * mean < -CASE WHEN stdev > 0 THEN 2 * stdev ELSE 0.01 END THEN 'worse' ELSE 'same' END AS outcome FROM a")
def _(t: Tables) -> DataFrame:
    a = evaluation.aggregate_runs(_runs(t))
    return evaluation.compare_golden(a, a.withColumn("mean", 1.1 * F.col("mean"))).select("metric", F.round("delta", 6).alias("delta"), "outcome")


@query("e16_seeded_sample")
def _(t: Tables) -> DataFrame:
    return evaluation.sample(t.documents.select(F.col("doc_id").alias("example_id"), "lang"), 100, 7)


@query("e17_expected_strings", "SELECT lang AS kind, count(*) AS n, count(*) FILTER (contains(lower(text), 'the') AND contains(lower(text), 'an')) AS hits FROM documents GROUP BY ROLLUP (lang)")
def _(t: Tables) -> DataFrame:
    a = t.documents.select(F.col("lang").alias("kind"), F.col("text").alias("answer"), F.array(F.lit("The"), F.lit("AN")).alias("expect"))
    return evaluation.expected_hits(a)


@query("e18_passage_identity", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE string_split(text, chr(10))[1] END AS title FROM documents")
def _(t: Tables) -> DataFrame:
    r = t.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("source"), F.col("text").alias("content"))
    return evaluation.passage_identity(r).select("doc_id", "title")


@query("e19_citation_presence", r"SELECT doc_id, regexp_matches(text || CASE WHEN doc_id % 2 = 0 THEN ' [3]' ELSE '' END, '[\[【]\s*\d+\s*[\]】]') AS cites FROM documents")
def _(t: Tables) -> DataFrame:
    cited = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" [3]"))).otherwise(F.col("text"))
    return t.documents.select("doc_id", tx.has_citation(cited).alias("cites"))


@query("r20_judge_score", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 7.5 WHEN 1 THEN 10.0 WHEN 2 THEN 3.0 WHEN 3 THEN 3.0 WHEN 4 THEN 8.0 ELSE NULL END AS score FROM documents")
def _(t: Tables) -> DataFrame:
    m = F.col("doc_id") % 6
    reply = F.when(m == 0, "SCORE: 7.5 of 10").when(m == 1, "score = 42").when(m == 2, "I give 99 or 3").when(m == 3, "SCORE: -3").when(m == 4, "a4b5, v2x and 8.0").otherwise("none")
    return t.documents.select("doc_id", tx.parse_score(reply).alias("score"))


@query("b1_nearest_rank", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def _(t: Tables) -> DataFrame:
    return stats.nearest_rank(t.events, "value", (0.5, 0.95), ["event_type"])


@query("b2_latency_summary", "SELECT event_type, count(value) AS n, avg(value) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, min(value) AS min, max(value) AS max FROM events GROUP BY event_type")
def _(t: Tables) -> DataFrame:
    return stats.latency_summary(t.events, ["event_type"])


@query("b3_throughput", "SELECT event_type, count(*) AS requests, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS per_second FROM events GROUP BY event_type")
def _(t: Tables) -> DataFrame:
    return stats.throughput(t.events, ["event_type"]).withColumn("per_second", F.round("per_second", 9))


@query("b4_cost_per_query", "SELECT count(*) / CAST(count(DISTINCT user_id) AS DOUBLE) AS calls_per_query, sum(event_id % 100) / CAST(count(DISTINCT user_id) AS DOUBLE) AS tokens_per_query FROM events")
def _(t: Tables) -> DataFrame:
    return stats.cost_per_query(t.events.select(F.col("user_id").alias("query_id"), (F.col("event_id") % 100).alias("tokens")))


@query("p1_chunk_sources", "SELECT doc_id AS source, count(*) AS chunks, sum(length(content)) AS length FROM doc_chunk GROUP BY doc_id")
def _(t: Tables) -> DataFrame:
    c = t.doc_chunk.select(F.col("doc_id").alias("source"), F.col("pos").alias("chunk_order"), "content")
    m, _off = provenance.chunk_sources(c, c.groupBy("source").agg(F.count("*").cast("int").alias("n")))
    return m.select("source", F.size("chunk_ids").cast("long").alias("chunks"), F.col("length").cast("long").alias("length"))


@query("p2_match_sources", "SELECT 'doc ' || doc_id AS stem, CASE WHEN doc_id % 2 = 0 THEN file_path END AS file_path, CASE WHEN doc_id % 2 = 0 THEN 'matched' ELSE 'missing' END AS outcome FROM (SELECT CAST(doc_id AS BIGINT) AS doc_id, file_path FROM status)")
def _(t: Tables) -> DataFrame:
    even = t.status.where(F.col("doc_id").cast("long") % 2 == 0).select("file_path")
    return provenance.match_sources(t.status.select(F.concat(F.lit("doc "), F.col("doc_id")).alias("stem")), even)


@query("p3_overlap_gate", """
r AS (SELECT DISTINCT chunk_id FROM doc_chunk JOIN status USING (doc_id) WHERE status <> 'failed'), g AS (SELECT DISTINCT chunk_id FROM doc_chunk JOIN status USING (doc_id) WHERE status <> 'pending'), b AS (SELECT count(*) AS n FROM r JOIN g USING (chunk_id))
SELECT b.n / CAST((SELECT count(*) FROM g) AS DOUBLE) AS coverage, b.n / CAST((SELECT count(*) FROM r) AS DOUBLE) AS fidelity, b.n >= 0.9 * (SELECT count(*) FROM g) AND b.n >= 0.9 * (SELECT count(*) FROM r) AS ok FROM b
""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    c = t.doc_chunk.join(t.status.select("doc_id", "status"), "doc_id")
    return provenance.overlap(c.where("status <> 'failed'"), c.where("status <> 'pending'"))


@query("p4_rebuild_status", "SELECT 'doc-' || md5(file_path) AS doc_id, 'processed' AS status, count(*) AS chunk_count FROM status JOIN doc_chunk USING (doc_id) WHERE CAST(doc_id AS BIGINT) % 2 = 0 GROUP BY file_path")
def _(t: Tables) -> DataFrame:
    c = t.doc_chunk.select(F.concat(F.lit("doc "), F.col("doc_id")).alias("source"), F.col("pos").alias("chunk_order"), "content")
    m, _off = provenance.chunk_sources(c, c.groupBy("source").agg(F.count("*").cast("int").alias("n")))
    even = t.status.where(F.col("doc_id").cast("long") % 2 == 0).select("file_path")
    matched = provenance.match_sources(c.select(F.col("source").alias("stem")), even)
    return provenance.build_status(m, matched, 0).select("doc_id", "status", F.col("chunk_count").cast("long").alias("chunk_count"))


@query("st4_latency_windows", "SELECT date_trunc('day', ts) AS window_start, count(*) AS n, round(avg(value), 9) AS mean, max(value) AS max FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return intake.stream_latency(t.events).select("window_start", "n", F.round("mean", 9).alias("mean"), "max")
