"""Ball-tree search against plain scoring of every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from trilayer.llm import ball_tree
from trilayer.llm.queries import op12_lexical_search

DOCS = "doc_id long, text string, item_id int, score string, n long, rank string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total, df = len(bags), sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            m = 100 - 90 + (90 * sum(bag.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in set(terms(text)) if t in bag)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()], key=str)


def corpus(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    rank = lambda: int(min(vocabulary - 1, rng.zipf(1.3)))
    return [(i, " ".join(f"t{rank()}" for _ in range(int(rng.integers(0, 60))))) for i in range(n)]


def test_search_equals_plain_scoring(spark):
    docs = corpus(1, 1500)
    docs += [(2000 + i, docs[7][1]) for i in range(200)]  # ties: copies of one text
    items = [(i, docs[i * 3][1]) for i in range(40)] + [(100, docs[7][1]), (101, "no such words"), (102, "t1 t2 t399")]
    df, asked = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id int, text string")
    assert got(ball_tree.search(df, asked)) == plain(docs, items)
    # several blocks of items, small shards and another k
    assert got(ball_tree.search(df, asked, k=3, block_bytes=600)) == plain(docs, items, 3)


def test_small_shards(spark, monkeypatch):
    monkeypatch.setattr(ball_tree, "SHARD_ENTRIES", 100)
    docs = corpus(2, 400)
    items = [(i, docs[i][1]) for i in range(15)]
    df, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    vocabulary = ball_tree.Vocabulary.of([t for _, t in items])
    batch = next(ball_tree._vectors(iter([ball_tree.pa.record_batch([ball_tree.pa.array([i for i, _ in docs]), ball_tree.pa.array([t for _, t in docs])], names=["_id", "_text"])]), vocabulary))
    keep = batch.filter(ball_tree.pc.greater(ball_tree.pc.list_value_length(batch.column(2)), 0))
    r = ball_tree.Ranking(vocabulary, np.ones(len(vocabulary.hashes), np.int64), 400, 9000, np.ones(15, np.int64))
    assert len(list(r.search(iter([keep.slice(a, 50) for a in range(0, len(keep), 50)]), 10, ["_q", "_id", "score"]))) > 2
    assert got(ball_tree.search(df, asked)) == plain(docs, items)


def vectors(seed, n, size, width):
    rng = np.random.default_rng(seed)
    rows = [np.sort(rng.choice(size, int(rng.integers(1, width)), replace=False)) for _ in range(n)]
    first = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    return first, np.concatenate(rows), rng.integers(0, 2 * 10**10, int(first[-1]))


@pytest.mark.parametrize("seed", range(4))
def test_no_row_exceeds_its_nodes_bound(seed):
    first, t, v = vectors(seed, 300, 120, 40)
    tree = ball_tree.Tree(first, t, v, leaf=4)
    rng = np.random.default_rng(seed + 50)
    for _ in range(30):
        q = np.sort(rng.choice(130, int(rng.integers(1, 25)), replace=False))
        score = np.add.reduceat(np.where(np.isin(tree.terms, q), tree.values, 0), tree.first[:-1])
        bound = tree.bounds(q)
        assert all(bound[k] >= score[a:b].max() for k, (a, b) in enumerate(zip(tree.begin, tree.end, strict=True)))


def test_copies_have_balls_of_no_size_and_bounds_that_hold():
    first, t, v = np.arange(0, 41, 4), np.tile([1, 5, 6, 9], 10), np.tile([19_999_999_999, 3, 7, 12_345_678_901], 10)
    tree = ball_tree.Tree(first, t, v, leaf=2)
    assert tree.bounds(np.array([1, 9]))[0] >= 19_999_999_999 + 12_345_678_901
    assert tree.radius.max() < 1e5


def test_subtrees_are_pruned():
    """Groups of alike documents: a search opens few of the leaves."""
    rng, rows = np.random.default_rng(3), []
    for g in range(60):
        own = np.arange(g * 20, g * 20 + 20)
        rows += [np.sort(rng.choice(own, 12, replace=False)) for _ in range(50)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    first = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    t = np.concatenate(rows)
    tree = ball_tree.Tree(first, t, np.full(len(t), 10**9))
    total = sum(x < 0 for x in tree.left)
    mask, tie = np.zeros(1200, bool), np.arange(len(rows))
    opened = [tree.best(rows[i], 10, 1, tie, mask)[1] for i in range(40)]
    assert max(opened) <= total / 10


def test_terms_of_one_hash_are_told_apart_by_their_bytes(monkeypatch):
    monkeypatch.setattr(ball_tree, "word_hashes", lambda low, s, e: (e - s).astype(np.uint64))
    v = ball_tree.Vocabulary.of(["ab cd ef", "cd xyz"])
    assert v.alike == 3
    low, s, e, _ = ball_tree.words(*ball_tree.buffers(ball_tree.pa.array(["zz ef xyz ab q"])))
    w, place = v.places(low, s, e)
    raw = v.data.tobytes()
    assert {(int(i), raw[v.first[p] : v.first[p] + v.length[p]]) for i, p in zip(w, place, strict=True)} == {(1, b"ef"), (2, b"xyz"), (3, b"ab")}


def test_edges(spark):
    rows = [(1, "the same text", 1, "x", 1, "y"), (1, "the same text", 1, "x", 1, "y"), (2, "The SAME text", None, None, None, None), (None, "null id same", 1, "x", 1, "y"), (None, None, None, None, None, None), (3, "", 1, "x", 1, "y"), (4, " .\n", 1, "x", 1, "y"), (5, LONG, 1, "x", 1, "y"), (6, "ÄÖ é same", 1, "x", 1, "y")]
    items = [(1, "same text"), (1, "same text"), (None, "w5 same null é"), (2, None), (3, ""), (4, "w1 w2 w3 nothing")]
    docs, asked = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id int, text string")
    assert got(ball_tree.search(docs, asked)) == plain([r[:2] for r in rows], items)
    none = docs.limit(0)
    assert ball_tree.search(none, asked).count() == 0 and ball_tree.search(docs, asked.limit(0)).count() == 0
    named = ball_tree.search(docs.withColumnRenamed("doc_id", "key").selectExpr("string(key) AS key", "text"), asked.withColumnRenamed("item_id", "q"), id_col="key", item_col="q")
    assert named.columns == ["q", "rank", "key", "score"] and named.count() == len(plain([r[:2] for r in rows], items))


def test_query(spark):
    read = lambda t: [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").collect()]
    assert got(op12_lexical_search(spark, "/root/testdata/sf0.001")) == plain([r[:2] for r in read("documents")], [r[:2] for r in read("benchmark")])
