"""Tokenizers as hooks: the same tests for whitespace tokens and for byte pairs."""

import pytest
from pyspark.sql import functions as F

from trilayer.operators import chunking, tokenizer

TEXTS = ["The quick brown fox, it jumps.", "  two  words\n", "", " \n ", None, "日本語のテキスト 🎉🎉 naïve café", "x" * 5000 + " " + "word " * 3000, "one"]


def makers():
    yield tokenizer.PatternTokens()
    files = pytest.importorskip("public_tokenizers")
    yield tokenizer.BytePairTokens(files.path("byte_bpe_50k.tiktoken"), files.PATTERN)


@pytest.mark.parametrize("k", [0, 1])
def test_windows_counts_and_cuts(spark, k):
    tok = list(makers())[k]
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    spans = {i: tok.offsets([t])[0] for i, t in enumerate(TEXTS) if t is not None}
    for size, overlap in ((7, 0), (5, 2)):
        got = {}
        for r in tokenizer.chunk_tokens(docs, tok, size, overlap, strip=False).orderBy("doc_id", "chunk_order").collect():
            got.setdefault(r.doc_id, []).append(r)
        assert set(got) == {i for i, t in enumerate(TEXTS) if t and t.strip()}
        for i, rows in got.items():
            n = len(spans[i][0])
            assert [r.chunk_order for r in rows] == list(range(-(-n // (size - overlap)))) and all(r.tokens <= size for r in rows)
            assert all(r.content in TEXTS[i] for r in rows)
            if k == 1 and not overlap:
                assert "".join(r.content for r in rows) == TEXTS[i]
    counts = {r.doc_id: (r.tokens, r.kept) for r in tokenizer.token_counts(docs, tok, 3).collect()}
    assert counts[4] == (0, None) and counts[2] == (0, "") and len(counts) == len(TEXTS)
    assert all(counts[i] == (len(s[0]), t if len(s[0]) <= 3 else t[: s[1][2]]) for i, t in enumerate(TEXTS) if t is not None for s in [spans[i]])
    with pytest.raises(ValueError):
        tokenizer.chunk_tokens(docs, tok, 3, 3)


def test_byte_pairs_round_trip():
    tok = list(makers())[1]
    texts = [t for t in TEXTS if t]
    assert tok.decode(tok.encode(texts)) == texts


def test_hooked_whitespace_equals_the_native_windows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    flat = lambda df: sorted((r.doc_id, r.chunk_order, r.tokens, r.c) for r in df.select("doc_id", "chunk_order", "tokens", F.regexp_replace("content", r"\s+", " ").alias("c")).collect())
    assert flat(tokenizer.chunk_tokens(docs, tokenizer.PatternTokens(), 50, 10)) == flat(chunking.chunk_fixed(docs, 50, 10))
