"""Registered queries against their SQL on the smallest tables, a spread of one per family."""

import hashlib
import os
from types import SimpleNamespace

import duckdb
import pytest

from trilayer.plans import load_queries, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [
    "k1_upsert", "k3_missing_keys", "k6_clear_namespace", "o9_type_reply", "s11_parser_directives", "q4_key_use", "q5_neighborhood_edges", "t2_canonical_key", "t11_json_object", "c1_fixed_windows", "c2_separator_windows", "c10_inline_markup", "x6_entity_normalisation",
    "m1_fact_dedup", "m8_replace_facts", "o4_frequency_filter", "f1_conflict_groups", "i2_id_diff", "g5_entity_relations", "g9_entity_types", "g11_information_density",
    "t12_final_channel", "r4_schema_seeds", "r20_judge_score", "e1_answer_normalisation", "e2_answer_tokens", "e4_exact_match", "e5_token_f1", "e6_str_acc", "e7_str_acc_audit", "e19_citation_presence", "d7_process_summary", "s11_parse_routing", "x4_retry_failures", "v1_exact_knn", "r8_reset_vector", "r9_personalized_pagerank", "r19_parameter_sweep", "q5_neighborhood", "d5_delete_documents", "h7_context_budget", "e8_recall_at_k", "e15_golden_comparison", "b2_latency_summary", "p2_match_sources", "st4_latency_windows",
    "f3_verdict_call", "f7_bundle_batches", "r12_fallback_routing", "r18_modes", "u2_token_windows", "d6_requeued_chunks", "d5_delete_to_the_end", "st2_stream_status", "e13_run_scores", "x3_checkpointed_extraction",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(df):
    def one(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, float):
            return repr(round(v, 5) + 0.0)
        return repr(float(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    queries, sql = load_queries()
    ours, theirs = queries[name](spark, SF).toPandas(), duck.execute(sql[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_sql_has_a_query():
    queries, sql = load_queries()
    assert set(sql) <= set(queries)
    assert len(queries) > 150


def test_group_ranking_by_members(spark, monkeypatch):
    """The 50th and 51st group begin alike: their members decide, not their ends, and come with the rank."""
    facts = [(f"fact-{100 * i + j:032x}", f"h{i}", f"r{i}", f"t{i}-{j}") for i in range(1, 50) for j in range(4)]
    facts += [(f"fact-{n:032x}", h, "r", t) for n, h, t in [(0, "h", "t"), (1, "h", "t1"), (9, "h", "t9"), (2, "h2", "t"), (3, "h3", "t")]]
    df = spark.createDataFrame(facts, "fact_id string, head_key string, rel_key string, tail_key string")
    monkeypatch.setattr(registry, "tables", lambda *_: SimpleNamespace(mem=SimpleNamespace(facts=df)))
    queries, sql = load_queries()
    ours = queries["f2_group_ranking"](spark, SF).toPandas()
    sets = [[f[0] for f in facts[4 * i : 4 * i + 4]] for i in range(49)] + [[f"fact-{n:032x}" for n in (0, 1, 9)]]
    want = [(len(m), m[0], m[-1], hashlib.md5(",".join(m).encode()).hexdigest(), 1) for m in sets]
    assert [tuple(r) for r in ours[["size", "first", "last", "members", "cut"]].itertuples(index=False)] == want
    con = duckdb.connect()
    con.execute("CREATE TABLE facts (fact_id VARCHAR, head_key VARCHAR, rel_key VARCHAR, tail_key VARCHAR)")
    con.executemany("INSERT INTO facts VALUES (?, ?, ?, ?)", facts)
    s = sql["f2_group_ranking"]
    assert rows(con.execute("WITH " + s[s.index("grp AS (") :]).fetchdf()) == rows(ours)


def test_group_ranking_matches_sql(spark, duck):
    test_query_matches_sql(spark, duck, "f2_group_ranking")
