"""Fixtures of the operators: small tables whose results are known."""

import fnmatch
import random
import re

import pytest
from pyspark.sql import functions as F

from trilayer.functions import canonical as canon
from trilayer.functions import text as tx
from trilayer.operators import chunking, conflicts, documents, evaluation, extraction, graph, graph_queries, memory, ontology, pagerank, retrieval, tokenizer, vectors
from trilayer.operators import keyed as keyed_tables
from trilayer.sources import files


def keyed(spark, rows):
    df = spark.createDataFrame(rows, "chunk_id string, pos int, head string, relation string, tail string")
    return canon.canonical(df, {"head": "head_key", "relation": "rel_key", "tail": "tail_key"})


def test_same_triple_twice_is_one_fact_of_two_passages(spark):
    k = keyed(spark, [("a", 0, "X", "r", "Y"), ("a", 1, "X", "r", "Y"), ("b", 0, "x", "R", "y")])
    chunks = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "no triples")], "chunk_id string, content string")
    m = memory.build(k, chunks)
    assert [(r.head, r.frequency) for r in m.facts.collect()] == [("X", 2)]
    assert m.passages.count() == 3


def test_accents_and_case_are_one_fact_first_spelling_shown(spark):
    k = keyed(spark, [("b", 0, "REFORME", "est", "Loi"), ("a", 0, "Réforme", "est", "loi"), ("c", 0, "Œuvre", "est", "œuvre")])
    f = {r.head_key: r.head for r in memory.dedup_facts(k).collect()}
    assert f == {"reforme": "Réforme", "oeuvre": "Œuvre"}


def test_density_is_higher_for_rare_entities(spark):
    pairs = spark.createDataFrame([("c", f"p{i}") for i in range(1, 5)] + [(f"r{i}", "p2") for i in range(3)], "entity_id string, passage_id string")
    d = {r.passage_id: r.density for r in graph.density(pairs, pairs.select("passage_id").distinct()).collect()}
    assert d["p2"] > d["p1"] and all(0 < x < 1 for x in d.values())


def test_pagerank_prefers_the_seeded_side_and_keeps_mass(spark):
    e = spark.createDataFrame([("a", "c1", 1.0), ("b", "c2", 1.0), ("a", "b", 0.5)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([("a",), ("b",), ("c1",), ("c2",), ("alone",)], "node_id string")
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    reset = retrieval.reset_vector(spark.createDataFrame([(1, "a", 2.0), (1, "zzz", 1.0)], "query_id int, node_id string, mass double"), nodes, q)
    s = retrieval.ppr(reset, e, bound=1e-11)
    one = {r.node_id: r.mass for r in s.where("query_id = 1").collect()}
    assert one["c1"] > one["c2"] and abs(sum(one.values()) - 1) < 1e-9
    two = {r.node_id: r.mass for r in s.where("query_id = 2").collect()}
    assert abs(sum(two.values()) - 1) < 1e-9 and set(two) == {"a", "b", "c1", "c2", "alone"}


def test_rerank_takes_valid_picks_else_the_threshold(spark):
    hits = spark.createDataFrame([(1, "x", 0.9, 1), (1, "y", 0.88, 2), (2, "x", 0.9, 1), (2, "y", 0.2, 2)], "query_id int, fact_id string, score double, rank int")
    picks = spark.createDataFrame([(1, [1, 7]), (2, [0])], "query_id int, picks array<int>")
    assert sorted((r.query_id, r.fact_id) for r in retrieval.rerank(hits, picks, 0.6).collect()) == [(1, "x"), (2, "x")]


def test_windows_overlap(spark):
    d = spark.createDataFrame([(1, " ".join(str(i) for i in range(500)))], "doc_id long, text string")
    c = chunking.chunk_fixed(d, 50, 10).orderBy("chunk_order").collect()
    assert len(c) == 13 and all(r.tokens <= 50 for r in c)
    assert c[0].content.split()[-10:] == c[1].content.split()[:10]
    with pytest.raises(ValueError):
        chunking.chunk_fixed(d, 10, 10)


def split_plainly(text, size, seps, count):
    """The recursive split by its rules, one recursion a level."""
    if count(text) <= size:
        return [text]
    here = next((s for s in seps if s in text), None)
    if here is None:
        return [text]
    rest = seps[seps.index(here) + 1 :]
    units = [u for u in text.split(here) if u] if here else list(text)
    chunks, fill = [], []
    cost = lambda units: sum(map(count, units)) + (count(here) * (len(units) - 1) if here else 0)
    for u in units:
        if count(u) > size and rest:
            chunks += [here.join(fill)] if fill else []
            chunks += split_plainly(u, size, rest, count)
            fill = []
        elif fill and cost([*fill, u]) > size:
            chunks.append(here.join(fill))
            fill = [u]
        else:
            fill.append(u)
    return chunks + ([here.join(fill)] if fill else [])


def test_recursive_split_against_its_rules(spark):
    rng = random.Random(5)
    marks = ["\n\n", "\n", "\n\n\n", "。", "！", ". ", "! ", "? ", " ", "  ", "\t", ""]
    texts = ["".join(rng.choice(["a", "bb", "word", "日本", "x" * 12]) + rng.choice(marks) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    texts += ["", " \n ", None, "\n\n", "one", "t\ta\tb\tc " * 30, "x" * 500]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for size, seps, hook in [(3, None, None), (7, None, None), (0, None, None), (4, [". ", " "], None), (5, [], None), (6, None, tokenizer.PatternTokens(r"\w|[^\w\s]"))]:
        count = (lambda s: len(s.split())) if hook is None else lambda s: len(re.findall(hook.pattern, s))  # noqa: B023
        got = {}
        for r in sorted(chunking.chunk_recursive(d, size, seps, tokenizer=hook).collect()):
            assert r.chunk_order == len(got.setdefault(r.doc_id, [])) and r.tokens == count(r.content)
            got[r.doc_id].append(r.content)
        for i, text in enumerate(texts):
            body = (text or "").strip()
            plain = [c.strip() for c in split_plainly(text, max(size, 1), (chunking.SEPARATORS if seps is None else seps) or [""], count) if c.strip()] if body else []
            assert got.get(i, []) == (plain or ([body] if body else [])), (size, seps, text)
    named = spark.createDataFrame([("k", "a b")], "key string, body string")
    assert chunking.chunk_recursive(named, 9, id_col="key", text_col="body").collect() == [("k", 0, 2, "a b")]


def test_recursive_and_block_chunks_keep_all_words(spark):
    text = "one two three.\n\nfour five six seven eight nine ten. eleven twelve\nthirteen"
    d = spark.createDataFrame([(1, text), (2, "  "), (3, None)], "doc_id long, text string")
    c = chunking.chunk_recursive(d, 4).collect()
    found = " ".join(r.content for r in sorted(c, key=lambda r: r.chunk_order))
    assert found.replace(".", "").split() == text.replace(".", "").split()  # separators at a chunk's ends go
    assert all(r.tokens <= 4 for r in c)
    b = spark.createDataFrame([(1, 0, "a b", "H1"), (1, 1, "c d", "H2"), (1, 2, " ".join("x" * 25), "H3"), (1, 3, None, "H4")], "doc_id long, pos int, content string, heading string")
    got = [(r.content[:6], r.heading) for r in chunking.chunk_blocks(b, 10).orderBy("chunk_order").collect()]
    assert got[0] == ("a b\n\nc", "H1") and got[1][1] == "H3"


def test_extraction_restarts_where_it_stopped(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{i}", f"text {i}") for i in range(6)], "chunk_id string, content string")

    def bad(p):
        if p.endswith("3"):
            raise RuntimeError("model down")
        return [p]

    fn = extraction.extract_batch(bad, lambda p, e: [(e[0], "is", "text")])
    path = str(tmp_path / "cache")
    failed = extraction.extract(chunks, path, fn, rows=2)
    assert [r.chunk_id for r in failed.collect()] == ["c3"]
    cache = extraction.cached(spark, path)
    assert cache.count() == 5 and extraction.missing_chunks(chunks, cache).count() == 1
    with pytest.raises(extraction.ExtractionError, match="1 of 1 chunks failed twice, c3: model down"):
        extraction.retry_failed(failed, fn, path)
    assert extraction.cached(spark, path).count() == 5
    again = extraction.retry_failed(failed, extraction.extract_batch(lambda p: [p], lambda p, e: []), path)
    assert [r.chunk_id for r in again.collect()] == ["c3"]
    assert extraction.cached(spark, path).count() == 6 and extraction.missing_chunks(chunks, extraction.cached(spark, path)).count() == 0


def test_safety_valve(spark):
    k = keyed(spark, [("a", i, f"h{i}", "r", "t") for i in range(3)]).withColumns({"head_type": F.lit("A"), "tail_type": F.lit("B")})
    k = canon.canonical(k, {"head_type": "head_type_key", "tail_type": "tail_type_key"})
    m = memory.build(k, k.select("chunk_id", F.lit("x").alias("content")))
    facts = ontology.link_schemas(m.facts, k.withColumn("fact_id", memory.fact_id()))
    m = m.with_(facts=facts, schemas=ontology.schema_frequency(ontology.dedup_schemas(k), facts))
    kept, report = ontology.guarded_filter(m, 10)
    assert report.first().applied is False and kept.facts.where("active").count() == 3
    assert ontology.filter_schemas(m, 10).facts.where("active").count() == 0


def test_conflict_groups_once(spark):
    f = memory.dedup_facts(keyed(spark, [("a", 0, "h", "r", "t1"), ("a", 1, "h", "r", "t2"), ("a", 2, "z", "q", "w")]))
    g = conflicts.conflict_groups(f).collect()
    assert [r.size for r in g] == [2]
    more = memory.dedup_facts(keyed(spark, [("a", i, f"h{i % 3}", "r", f"t{i % 4}") for i in range(12)] + [("b", 0, "x", "s", "y"), ("b", 1, "h0", "only", "t0")]))
    groups = conflicts.conflict_groups(more)
    sets = {}
    for r in conflicts.members_of(groups, more).collect():
        sets.setdefault(r.group_id, set()).add((r.head, r.tail))
    assert sorted(map(sorted, sets.values())) == sorted([[(f"h{i}", f"t{j}") for j in range(4)] for i in range(3)] + [[(f"h{i}", f"t{j}") for i in range(3)] for j in range(4)])
    top, cut = conflicts.rank_groups(groups, 3)
    assert [r.size for r in top.collect()] == [4, 4, 4] and cut.first().cut == 4


def test_shared_chunks_survive_a_deletion(spark):
    st = spark.createDataFrame([("a", "processed"), ("b", "processed"), ("c", "processed")], "doc_id string, status string")
    dc = spark.createDataFrame([("a", "s", 0), ("c", "s", 0), ("b", "o", 0)], "doc_id string, chunk_id string, pos int")
    ids = spark.createDataFrame([("a",), ("zz",)], "doc_id string")
    _, _, r = documents.delete_docs(st, dc, ids)
    assert {x.doc_id: (x.outcome, x.dropped, x.shared) for x in r.collect()} == {"a": ("deleted", 0, 1), "zz": ("not_found", 0, 0)}


def test_answer_forms(spark):
    d = spark.createDataFrame([("The **U.S.-based** [1] 1941–1945!",)], "t string")
    r = d.select(tx.normalise_answer(F.col("t")).alias("a"), tx.doc_key(F.lit("The Newcomers.")).alias("k")).first()
    assert r.a == "u s based 1941 1945" and r.k == "the newcomers"


def test_metrics(spark):
    p = spark.createDataFrame([(1, "Paris is the capital", ["paris"]), (2, "", ["x"]), (3, "Lyon", ["Lyon", "paris"])], "example_id long, prediction string, gold_answers array<string>")
    assert {r.example_id: r.value for r in evaluation.exact_match(p).collect()} == {1: 0.0, 2: 0.0, 3: 1.0}
    f1 = {r.example_id: round(r.value, 6) for r in evaluation.token_f1(p).collect()}
    assert f1 == {1: 0.5, 2: 0.0, 3: 1.0}
    assert {r.example_id: r.hit for r in evaluation.str_acc(p).collect()} == {1: True, 2: False, 3: True}


def test_knn_ties_and_ivf_recall(spark):
    v = spark.createDataFrame([(i, [float((i * 7) % 5), 1.0, float(i % 3)]) for i in range(60)], "id long, embedding array<double>")
    q = v.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    exact = vectors.knn(q, v, 5).select("query_id", "id").collect()
    assert len(exact) == 15
    near = vectors.knn_ivf(q, v, 5, cells=3, nprobe=3).select("query_id", "id").collect()
    assert len(set(exact) & set(near)) / len(exact) >= 0.9


def test_questions_in_both_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"_id": "1", "question": "q?", "answer": "a", "answer_aliases": ["b", "a"], "supporting_facts": [["T", "0"], ["T", "1"]]}]')
    (tmp_path / "b.json").write_text('[{"source": "S", "questions": {"deep": [{"id": "2", "question": "r?", "answer": "c"}]}}]')
    rows = {r.example_id: r for r in files.read_questions(spark, str(tmp_path)).collect()}
    assert rows["1"].gold_docs == ["T"] and rows["1"].gold_answers == ["a", "b"]
    assert rows["2"].gold_docs == ["S"] and rows["2"].question_type == "deep"


def test_intake_decodes_or_says_why(spark, tmp_path):
    for name, content in {"a.txt": b"good", "b.txt": b"\xff\xfe", "c.txt": b"  ", "d.txt": b"%PDF-1.7", ".hidden": b"x"}.items():
        (tmp_path / name).write_bytes(content)
    known = spark.createDataFrame([], "doc_id string, status string")
    docs, rejects = files.decode_files(files.scan_dir(spark, f"file://{tmp_path}", known))
    assert [r.text for r in docs.collect()] == ["good"]
    assert sorted(r.reason for r in rejects.collect()) == ["blank", "needs a parser", "not UTF-8"]


def test_golden_set_version(spark, tmp_path):
    ex = spark.range(2).withColumnRenamed("id", "example_id")
    files.save_golden(ex, ex, str(tmp_path), 2)
    with pytest.raises(ValueError):
        files.load_golden(spark, str(tmp_path), 1)
    assert files.load_golden(spark, str(tmp_path), 2)[0].count() == 2


def test_memory_round_trip(spark, tmp_path):
    k = keyed(spark, [("a", 0, "X", "r", "Y")])
    m = memory.build(k, spark.createDataFrame([("a", "A")], "chunk_id string, content string"))
    m = m.with_(schemas=spark.createDataFrame([("s", 1)], "schema_id string, frequency long"))
    memory.save(m, str(tmp_path / "m"))
    assert memory.load(spark, str(tmp_path / "m")).facts.collect() == m.facts.collect()


def test_predictions_are_whole_texts(spark):
    from types import SimpleNamespace

    from trilayer.operators import evaluation
    from trilayer.plans import text_queries

    text = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(4, text), (5, text)], "doc_id long, text string")
    p = text_queries._preds(SimpleNamespace(documents=docs))
    assert {r.prediction for r in p.collect()} == {text}
    assert {r.example_id: round(r.value, 9) for r in evaluation.token_f1(p).collect()} == {4: 1.0, 5: round(20 / 310, 9)}
    assert {r.example_id: (r.hit, r.truncated) for r in evaluation.str_acc(p).collect()} == {4: (True, True), 5: (True, True)}


def test_schema_seeds_reach_all_passages_of_an_endpoint(spark):
    facts = spark.createDataFrame([("f1", "a", "b", "s1", True), ("f2", "a", "c", "s2", True)], "fact_id string, head_key string, tail_key string, schema_id string, active boolean")
    links = spark.createDataFrame([("f1", "p1"), ("f2", "p2")], "fact_id string, passage_id string")
    hits = spark.createDataFrame([(1, "s1", 1.0)], "query_id int, id string, score double")
    got = {r.node_id: r.mass for r in retrieval.schema_seeds(hits, facts, graph.entity_passage_map(facts, links), 0.1, 0.05).collect()}
    assert abs(got["p1"] - 0.01) < 1e-12 and abs(got["p2"] - 0.005) < 1e-12 and got["s1"] == 0.1


def test_final_channel_is_the_first(spark):
    final = "<|channel|>final<|message|>"
    want = {
        f"{final}one<|end|>{final}two": "one", "analysisx assistantfinalfirst assistantfinalsecond": "first assistantfinalsecond", f"{final} kept ": " kept ",
        "<|channel|>analysis<|message|> thinking <|end|>": "thinking", "<|start|>final words": "words", "analysis of a case": "analysis of a case", "commentaryand more": "commentaryand more", "plain": "plain", "": "",
    }
    df = spark.createDataFrame([(x,) for x in want] + [(None,)], "t string")
    assert {r.t: r.f for r in df.select("t", tx.final_channel(F.col("t")).alias("f")).collect()} == want | {None: None}


def test_judge_scores(spark):
    want = {"SCORE: -3": 3.0, "score=7.25": 7.25, "Score : 42": 10.0, "99 then 4": 4.0, "a5 b6c": None, "10.5 or 10": 10.0, "none": None, "": None}
    df = spark.createDataFrame([(x,) for x in want], "t string")
    assert {r.t: r.s for r in df.select("t", tx.parse_score(F.col("t")).alias("s")).collect()} == want


def test_search_leaves_unusable_vectors_out(spark):
    good = [(i, [float(i), 1.0]) for i in range(1, 30)]
    bad = [(100, None), (101, [0.0, 0.0]), (102, [None, 1.0]), (103, [float("nan"), 1.0]), (104, [1.0]), (105, [])]
    v = spark.createDataFrame(good + bad, "id long, embedding array<double>")
    q = v.withColumnRenamed("id", "query_id").where("query_id in (1, 2, 100, 101, 102, 103, 105)")
    assert {r.query_id for r in vectors.knn(q, v, 3).collect()} == {1, 2}
    assert all(r.id < 100 for r in vectors.knn(q, v, 40).collect())
    two = v.where("size(embedding) = 2 or embedding is null")
    assert {r.query_id for r in vectors.knn_ivf(q.where("query_id <> 105"), two, 3, cells=2, nprobe=2).collect()} == {1, 2}


def test_equal_densities_are_spread_like_different_ones(spark):
    pairs = spark.createDataFrame([("a", "p1"), ("b", "p2")], "entity_id string, passage_id string")
    got = graph.density(pairs, spark.createDataFrame([("p1",), ("p2",), ("p3",)], "passage_id string")).collect()
    assert {r.passage_id: round(r.density, 9) for r in got} == {"p1": 0.5, "p2": 0.5, "p3": 0.0}


def test_parser_directives(spark):
    rules = spark.createDataFrame([(1, " T?T ", "plain-xPe"), (2, "[!d-t]*", "gone"), (3, "[d-t]*", "ocr (fine)"), (4, "*", "fast-R")], "no int, pattern string, hint string")
    engines = spark.createDataFrame([("plain", "txt"), ("ocr", "pdf"), ("ocr", "PDF"), ("fast", "txt"), ("fast", "a.c"), ("fast", "")], "engine string, suffix string")
    want = {
        "/d/a.txt": ("plain", "Pe", "P", None),
        "/d/a.PDF": ("ocr", "", "F", None),
        "a.[fast].txt": ("fast", "Pe", "P", None),
        "a.[ Fast(x=1)-zRF ].txt": ("fast", "RF", "R", None),
        "a.[-i!F].txt": ("plain", "i!F", "F", None),
        "a.[-].txt": ("plain", "Pe", "P", None),
        "a.[ ].txt": (None, None, None, "empty hint"),
        "a.[what-R].txt": (None, None, None, "unknown engine"),
        "a.[ocr].txt": (None, None, None, "engine does not take the suffix"),
        "a [fast].txt": ("plain", "Pe", "P", None),
        "/d/none": ("fast", "R", "R", None),
        "/d/.txt": ("fast", "R", "R", None),
        "/d/a.zip": ("legacy", "", "F", None),
        None: (None, None, None, None),
    }
    f = spark.createDataFrame([(p,) for p in [*want, "/d/a.txt"]], "file_path string")
    got = files.route_parsers(f, rules, engines).collect()
    assert len(got) == len(want) + 1
    assert {r.file_path: tuple(r)[1:] for r in got} == want
    assert {r.engine for r in files.route_parsers(f.where("file_path = '/d/a.txt'"), rules.limit(0), engines).collect()} == {"legacy"}


def test_glob_patterns_mean_what_a_shell_means(spark):
    globs = ["*", "a*", "?", "[ab]", "[!ab]", "[]a]", "[!]a]", "[", "[]", "[!]", "a.b", "a+(b)", "[*]", "[?a", "[a-c]x", "[^a]", "**b", "\\", "", "[a\\]"]
    names = ["", "a", "b", "c", "]", "[", "!", "[]", "[!]", "a.b", "axb", "a+(b)", "*", "[xa", "bx", "dx", "^", "ab", "\\", "a\nb", "?"]
    d = spark.createDataFrame([(g, n) for g in globs for n in names], "glob string, name string")
    for r in d.withColumn("met", F.rlike("name", files.glob_pattern(F.col("glob")))).collect():
        assert r.met == fnmatch.fnmatchcase(r.name, r.glob), (r.glob, r.name)


def test_neighbourhood_edges_and_keys(spark):
    e = spark.createDataFrame([("a", "b", "R", 1.0), ("b", "a", "R", 2.0), ("b", "c", "R", None), ("d", "c", "S", None), ("c", "e", "R", 1.0), ("d", "e", "R", 1.0), ("a", "a", "R", 5.0)], "src string, dst string, type string, weight double")
    ends = lambda k: sorted((r.src, r.dst) for r in graph_queries.neighborhood_edges(e, "a", k).collect())
    assert ends(1) == [("a", "a"), ("a", "b"), ("b", "a")]
    assert ends(2) == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "c")]
    assert ends(3) == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "e"), ("d", "c")]
    with pytest.raises(KeyError):
        graph_queries.neighborhood_edges(e, "z")
    n = spark.createDataFrame([("a", "Entity", None), ("b", "Entity", "x"), ("c", None, "y")], "node_id string, label string, content string")
    got = {tuple(r) for r in graph_queries.key_use(n, e).collect()}
    assert got == {("node", "Entity", "node_id", 2), ("node", "Entity", "content", 1), ("node", None, "node_id", 1), ("node", None, "content", 1), ("edge", "R", "src", 6), ("edge", "R", "dst", 6), ("edge", "R", "weight", 5), ("edge", "S", "src", 1), ("edge", "S", "dst", 1)}
    both = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id int, namespace string")
    assert {r.id for r in keyed_tables.clear(both, "x").collect()} == {2, 3}


def test_routing_uses_every_rule(spark):
    rules = spark.createDataFrame([(i, f"x{i}", f"e{i}", "R") for i in range(1500)] + [(2000, "x14.*", "late", "F")], "no int, pattern string, engine string, options string")
    f = spark.createDataFrame([("/a/b.x1490",), ("/a/b.x14zz",), ("/a/none",), ("/a/c [fast-P].x3",)], "file_path string")
    assert {r.file_path: (r.engine, r.strategy) for r in files.route_files(f, rules).collect()} == {"/a/b.x1490": ("e1490", "R"), "/a/b.x14zz": ("late", "F"), "/a/none": ("legacy", "F"), "/a/c [fast-P].x3": ("fast", "P")}


def test_pagerank_equals_the_dense_iteration(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    n, edges = 30, set()
    while len(edges) < 60:
        a, b = sorted(rng.integers(0, n - 3, 2).tolist())  # the last three nodes have no edge
        if a != b:
            edges.add((a, b))
    edges |= {(0, b) for b in range(1, n - 3)}
    e = [(f"n{a}", f"n{b}", float(rng.random() + 0.1)) for a, b in sorted(edges)]
    asked = {q: {int(i): float(rng.random()) for i in rng.integers(0, n, 4)} for q in range(21)}
    seeds = spark.createDataFrame([(q, f"n{i}", m) for q, x in asked.items() for i, m in x.items()], "query_id int, node_id string, mass double")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(n)], "node_id string")
    reset = retrieval.reset_vector(seeds, nodes, seeds.select("query_id").distinct())
    w = np.zeros((n, n))
    for a, b, x in e:
        w[int(a[1:]), int(b[1:])] = w[int(b[1:]), int(a[1:])] = x
    for a, b, x in e[:9]:  # parallel edges, one of them named the other way round
        w[int(a[1:]), int(b[1:])] += x / 2
        w[int(b[1:]), int(a[1:])] += x / 2
    w[4, 4] = 0.7
    e.append(("n4", "n4", 0.7))
    loose = w.sum(axis=1) == 0
    p = w / np.where(loose, 1, w.sum(axis=1))[:, None]
    want = {}
    for q, x in asked.items():
        r = np.zeros(n)
        for i, m in x.items():
            r[i] = m
        r /= r.sum()
        v = r
        for _ in range(60):
            v = 0.5 * r + 0.5 * (p.T @ v + v[loose].sum() * r)
        want |= {(q, f"n{i}"): m for i, m in enumerate(v) if m > 0}
    df = spark.createDataFrame(e + [(b, a, x / 2) for a, b, x in e[:9]] + [("n1", "n2", 0.0)], "src string, dst string, weight double")
    monkeypatch.setattr(pagerank, "QUESTIONS", 16)
    for hub, bound in ((100_000, 1e-6), (5, 1e-13), (5, 1e-3)):
        got = {(r.query_id, r.node_id): r.mass for r in pagerank.push(reset, pagerank.block_graph(df, block_edges=20, hub=hub), bound=bound).collect()}
        off = {q: sum(abs(got.get((q, f"n{i}"), 0) - want.get((q, f"n{i}"), 0)) for i in range(n)) for q in asked}
        assert max(off.values()) <= max(bound, 1e-12), (hub, bound, off)
        if bound < 1e-12:
            assert set(got) == set(want)


@pytest.mark.parametrize("parallel", [1, 3])
def test_a_killed_extraction_repeats_one_sub_batch_a_core(spark, tmp_path, parallel):
    import collections
    import os
    import uuid

    chunks = spark.createDataFrame([(f"c{i:03d}", f"text {i}") for i in range(100)], "chunk_id string, content string").repartition(5)
    log, path, bad = str(tmp_path / "calls"), str(tmp_path / "cache"), str(tmp_path / "broken")
    os.makedirs(log)
    open(bad, "w").close()

    def fn(b):
        assert len(b) <= 8
        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(b["chunk_id"]))
        if os.path.exists(bad) and len(os.listdir(log)) > 5:
            raise OSError("the machine is gone")
        return b.assign(passage=b["content"], entities=[["e"]] * len(b), triples=[[]] * len(b), failed=False, error=None)[["chunk_id", "passage", "entities", "triples", "failed", "error"]]

    with pytest.raises(Exception, match="the machine is gone"):
        extraction.extract(chunks, path, fn, rows=8, parallel=parallel)
    before = {r.chunk_id for r in extraction.cached(spark, path).collect()}
    assert len(before) >= 8 * parallel
    # an attempt without a manifest doesn't count
    extraction.cached(spark, path).write.parquet(f"{path}/attempts/unfinished")
    os.remove(bad)
    assert extraction.extract(chunks, path, fn, rows=8, parallel=parallel).count() == 0
    calls = collections.Counter(c for f in os.listdir(log) for c in open(f"{log}/{f}").read().split())
    assert extraction.cached(spark, path).count() == 100 and len(calls) == 100
    again = {c for c, n in calls.items() if n > 1}
    assert len(again) <= 8 * parallel and not again & before and max(calls.values()) <= 2


@pytest.mark.parametrize(("seed", "most"), [(1, 900), (2, 2500), (3, 40), (4, 6000)])
def test_batches_equal_one_greedy_pass(spark, monkeypatch, seed, most):
    import random

    rng = random.Random(seed)
    rows = [(f"k{i:05d}", "x" * (0 if rng.random() < 0.2 else rng.randint(0, most))) for i in range(400)]
    rows[:3] = [(rows[i][0], "") for i in range(3)]
    want, batch, held = {}, 0, 0
    for k, text in rows:
        if held and held + len(text) > 2000:
            batch, held = batch + 1, 0
        held += len(text)
        want[k] = batch
    df = spark.createDataFrame(rows, "conflict_id string, bundle string").repartition(5)
    for size in (30, 100_000):
        monkeypatch.setattr(conflicts, "RANGE_ROWS", size)
        assert {r.conflict_id: r.batch for r in conflicts.batch_bundles(df, 100).collect()} == want
    assert conflicts.batch_bundles(df.limit(0)).count() == 0


def test_each_question_goes_its_way(spark):
    q = spark.createDataFrame([(1, "ppr"), (2, "ppr"), (3, None), (4, "context"), (5, "naive"), (6, "bypass"), (7, "context")], "query_id int, mode string")
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "query_id int")
    ranks = lambda name, *ids: spark.createDataFrame([(i, 1, f"{name}{i}", 1.0, f"text of {name}{i}") for i in ids], "query_id int, rank int, passage_id string, score double, content string")
    ranked, dense = ranks("g", 1, 4, 5, 6), ranks("d", *range(1, 8))
    way = retrieval.paths(q, rows(1, 1, 4, 5), rows(2), ranked)
    assert {r.query_id: r.path for r in way.collect()} == {1: "ppr", 2: "dense_fallback_empty_ppr", 3: "dense_fallback_no_facts", 4: "ppr", 5: "naive", 6: "bypass", 7: "dense_fallback_no_facts"}
    got = retrieval.retrieve(way, ranked, dense)
    assert {r.query_id: r.passage_id for r in got.collect()} == {1: "g1", 2: "d2", 3: "d3", 4: "g4", 5: "d5", 7: "d7"}
    # an empty graph sends all to dense search
    none = retrieval.paths(q, rows(1), rows(2), ranked.limit(0))
    assert {r.path for r in none.where("mode = 'ppr'").collect()} == {"dense_fallback_empty_ppr", "dense_fallback_no_facts"}
    asked = q.select("query_id", F.concat(F.lit("q"), F.col("query_id")).alias("question"))
    said = {r.query_id: (r.prompt, r.answer) for r in retrieval.answer(way, asked, got, lambda b: b.assign(answer="to " + b["prompt"].str[-2:])[["query_id", "answer"]]).collect()}
    assert said[6] == ("q6", "to q6") and said[1][1] == "to q1" and said[4][1] is None and "text of g4" in said[4][0] and said[1][0].endswith("Question: q1")
    with pytest.raises(Exception, match="no such mode: agent"):
        retrieval.paths(spark.createDataFrame([(1, "agent")], "query_id int, mode string"), rows(1), rows(1), ranked).collect()


def test_answers_in_compatibility_form(spark):
    import unicodedata

    rows = [(1, "the \ufb01ne \u2163 print", ["fine IV print"]), (2, "x\u00b2 \uff21\uff22\uff23", ["nothing", "X2 abc"]), (3, "zz", [None, "b"]), (4, "caf\u0065\u0301 \u2014 s", ["caf\u00e9 s"]), (5, "plain", None), (6, "\u30d1\uff8a\uff9f", [])]
    p = spark.createDataFrame(rows, "example_id int, prediction string, gold_answers array<string>").coalesce(1)
    assert {r.example_id: r.value for r in evaluation.exact_match(p).collect()} == {1: 1.0, 2: 1.0, 3: 0.0, 4: 1.0, 5: None, 6: 0.0}
    assert {r.example_id: r.value for r in evaluation.token_f1(p.where("example_id < 3")).collect()} == {1: 1.0, 2: 1.0}
    got = {r.example_id: (r.prediction, r.gold_answers) for r in canon.compatible(p, "prediction", "gold_answers").collect()}
    n = lambda s: s if s is None else unicodedata.normalize("NFKC", s.replace("\u2014", "-"))
    assert got == {i: (n(a), g if g is None else [n(x) for x in g]) for i, a, g in rows}
    keys = spark.createDataFrame([(1, "\uff34he \ufb01le.", 1)], "example_id int, title string, rank int")
    assert evaluation._ranks(keys).first().key == "the file"


def test_calls_that_fail_are_made_once_more(spark, tmp_path):
    import os
    import uuid

    log = str(tmp_path / "calls")
    os.makedirs(log)

    def fn(b):
        for i in b["id"]:
            open(f"{log}/{i}-{uuid.uuid4().hex}", "w").close()
        seen = [sum(f.startswith(f"{i}-") for f in os.listdir(log)) for i in b["id"]]
        return b.assign(reply=["ok" if i == 1 or (i == 2 and n == 2) else None for i, n in zip(b["id"], seen)])

    got = extraction.call_twice(spark.createDataFrame([(1,), (2,), (3,)], "id int"), fn, "id int, reply string", F.col("reply") == "ok")
    assert {r.id: r.reply for r in got.collect()} == {1: "ok", 2: "ok", 3: None} and got.count() == 3
    assert sorted(int(f.split("-")[0]) for f in os.listdir(log)) == [1, 2, 2, 3, 3]


def test_large_groups_are_asked_about_in_parts(spark):
    import pandas as pd

    f = memory.dedup_facts(keyed(spark, [("a", i, "h", "r", f"t{i}") for i in range(100)] + [("b", 0, "x", "s", "y1"), ("b", 1, "x", "s", "y2")]))
    v = conflicts.verdict_call(conflicts.conflict_groups(f), f, lambda g: pd.DataFrame({"group_id": [g["group_id"].iloc[0]], "n": [len(g)]}), "group_id string, n long", rows=10).collect()
    assert sum(r.n for r in v) == 102 and max(r.n for r in v) < 30 and len(v) >= 9


def test_torn_chunks_go_when_a_document_is_requeued(spark):
    st = spark.createDataFrame([("a", "parsing"), ("b", "failed"), ("c", "processed")], "doc_id string, status string")
    dc = spark.createDataFrame([("a", "x", 0), ("b", "x", 0), ("c", "y", 0)], "doc_id string, chunk_id string, pos int")
    assert {r.doc_id for r in documents.requeued_chunks(dc, documents.requeue(st)).collect()} == {"b", "c"}
    assert {r.doc_id for r in documents.requeued_chunks(dc, documents.requeue(st, st.where("doc_id = 'b'"))).collect()} == {"a", "b", "c"}
