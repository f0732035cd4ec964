"""Exact dedup against a plain grouping."""

import re

import pytest
from pyspark.sql import functions as F

from trilayer.llm import exact_dedup
from trilayer.llm.queries import op11_exact_dedup

DOCS = "doc_id long, text string, kept string, _h string, n int"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [
    (7, "one two", "x", "y", 1), (3, "onetwo", "x", "y", 1), (2, "one\ttwo\n", "x", "y", 1), (2, "one\ttwo\n", "x", "y", 1), (9, "\x0bone  two", None, None, None),
    (1, "one two", "x", "y", 1), (5, "One two", "x", "y", 1), (None, None, None, None, None), (4, "", "x", "y", 1), (6, " \r\f", "x", "y", 1), (None, " \r\f", "x", "y", 1),
    (10, LONG, "x", "y", 1), (11, LONG + " ", "x", "y", 1), (12, LONG[:-1] + "#", "x", "y", 1), (13, LONG[:64] + "tail", "x", "y", 1), (14, "\U0001f600 é", "x", "y", 1), (15, "\U0001f600é", "x", "y", 1),
]


def plain(rows):
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, i))
    out = []
    for members in groups.values():
        first = min(members)
        out += [(rows[m[3]][0], rows[first[3]][0], len(members), m == first) for m in members]
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()], key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def test_groups(spark, docs):
    assert got(exact_dedup.dedup(docs)) == plain([r[:2] for r in ROWS])
    assert got(exact_dedup.dedup(docs.repartition(5))) == plain([r[:2] for r in ROWS])


def test_hot_groups_and_a_full_bitmap(spark, monkeypatch):
    rows = [(i, ("a copy " if i % 3 else "text %d " % (i // 6)) + " " * (i % 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(exact_dedup.dedup(df)) == plain(rows)
    # a bitmap of few bits lets everything through, and the result is the same
    monkeypatch.setattr(exact_dedup, "ROW_BITS", 8)
    monkeypatch.setattr(exact_dedup, "MOST_ROWS", 2)
    assert got(exact_dedup.dedup(df)) == plain(rows)


def test_only_survivors_are_hashed_in_full(spark):
    rows = [(i, "x" * i) for i in range(2000)] + [(5000 + i, "%08d" % i) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    narrow = exact_dedup._lengths(df, "text")
    keys = narrow.groupBy("n", "p").count().where("count > 1").select(F.struct("n", "p").alias("k")).checkpoint()
    marked = exact_dedup._marked(narrow.withColumn("k", F.struct("n", "p")), F.col("k"), exact_dedup._bitmap(keys, F.col("k")), "again")
    assert keys.count() == 0 and marked.where("again").count() == 0


def test_kept_rows_with_their_columns(spark, docs):
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r[3] for r in plain([r[:2] for r in ROWS]))
    with pytest.raises(ValueError):
        exact_dedup.dedup(docs, carry=("kept",))
    carried = exact_dedup.dedup(docs, carry=("_h", "n", "text"))
    assert carried.columns == ["doc_id", "_h", "n", "text", "keep_id", "group_size", "kept"] and carried.count() == len(ROWS)


def test_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert exact_dedup.dedup(none).count() == 0 and exact_dedup.deduplicated(none).count() == 0


def test_query(spark):
    rows = op11_exact_dedup(spark, "/root/testdata/sf0.001").collect()
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows], key=str) == plain([(r.doc_id, r.text) for r in table])
