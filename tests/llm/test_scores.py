"""The language model's probabilities against a plain count, and that they sum to one; each pair of vectors counts in one block."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from trilayer.llm import embedding_join, kneser_ney

END, BEGIN = object(), object()


def tokens(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), END]


def trigrams(text):
    t = tokens(text)
    return list(zip([BEGIN, BEGIN, *t[:-2]] if len(t) > 1 else [BEGIN], [BEGIN, *t[:-1]], t, strict=True))


def model(texts):
    """(probability(second before, before, token), add-0.1 probability(token), counts) of an interpolated modified Kneser-Ney trigram model."""
    words, triples = Counter(), Counter()
    for text in texts:
        words.update(tokens(text))
        triples.update(trigrams(text))
    pairs = Counter((v, w) for _, v, w in triples)
    before = Counter(w for _, w in pairs)
    after2, after1 = defaultdict(list), defaultdict(list)
    for (u, v, _), n in triples.items():
        after2[u, v].append(n)
    for (v, _), n in pairs.items():
        after1[v].append(n)

    def discounts(counts):
        n = [sum(c == k for c in counts) for k in range(5)]
        if not n[1]:
            return [0, 0.5, 1, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        d = [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2] if n[2] else 2 * y, 3 - 4 * y * n[4] / n[3] if n[3] else 3 * y]
        return [0] + [min(x, k) if x > 0 else k / 2 for k, x in enumerate(d) if k]

    d3, d2, d1 = discounts(triples.values()), discounts(pairs.values()), discounts(before.values())
    cut = lambda n, d: n - d[min(n, 3)] if n else 0
    share = sum(d1[min(n, 3)] for n in before.values()) / (len(words) + 1)

    def blend(n, seen, d, low):
        return (cut(n, d) + sum(d[min(x, 3)] for x in seen) * low) / sum(seen) if seen else low

    def probability(u, v, w):
        low = (cut(before[w], d1) + share) / len(pairs)
        return blend(triples[u, v, w], after2.get((u, v)), d3, blend(pairs[v, w], after1.get(v), d2, low))

    total = sum(words.values())
    return probability, lambda w: (words[w] + 0.1) / (total + 0.1 * (len(words) + 1)), words


def test_scores_equal_plain_counts(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "Ab,", "ab,"]
    texts = [" ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(len(vocabulary))], k=rng.randint(0, 40))) for _ in range(60)] + [None, ""]
    probe = [*texts[:20], "never seen words w1 w2", "w1\tw1\n\nW1 AB, é", None]
    probability, base, words = model(texts)
    m = kneser_ney.count(spark.createDataFrame([(x,) for x in texts], "text string").repartition(3), shard_tokens=200)
    assert m["shards"] > 3 and m["tokens"] == sum(words.values()) and m["types"] == len(words)
    for r in kneser_ney.score(spark.createDataFrame([(x,) for x in probe], "text string"), m).collect():
        t = tokens(r.text)
        assert (r.n_tokens, r.n_known) == (len(t), sum(w in words for w in t))
        assert math.isclose(r.lm_score, sum(math.log10(probability(*x)) for x in trigrams(r.text)), rel_tol=1e-9)
        assert math.isclose(r.base_score, sum(math.log10(base(w)) for w in t), rel_tol=1e-9)
    some = [BEGIN, *list(words)[:9], "unseen"]
    for u, v in [(u, v) for u in some for v in some if u is not END and v is not END]:
        assert math.isclose(sum(probability(u, v, w) for w in words) + probability(u, v, "unseen"), 1, rel_tol=1e-9)


def test_hash_arrays_keep_every_value():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    one, four = rng.choice([1, 2, 254, 255, 256, 70_000, 1 << 40], len(keys)), rng.choice([0, 1, 2, 40_000], (len(keys), 4))
    stored = kneser_ney.hash_array("pair", keys, one) | kneser_ney.hash_array("context", keys, four)
    for name, want in (("pair", one), ("context", four)):
        got, found = kneser_ney.find(stored, name, keys)
        assert found.all() and (got == want).all()
        assert not kneser_ney.find(stored, name, keys ^ np.uint64(1 << 45))[1].any()


def test_a_pair_at_the_edge_of_a_block_counts_once():
    dim, blocks, threshold = 64, 4, 0.93
    share = (2 - 2 * threshold) / blocks
    for excess in (-1.5, -0.5, 0.5, 1.5, 2.5):
        apart = np.full(blocks, 0.03)
        apart[0] = share + excess * embedding_join._SLACK
        x = np.zeros((2, dim))
        for (lo, _), d in zip(embedding_join.block_edges(dim, blocks), apart, strict=True):
            x[:, lo] = np.sqrt(d) / 2 * np.array([1, -1])
            x[:, lo + 1] = np.sqrt((1 - apart.sum() / 4) / blocks)
        raw, zero = x @ embedding_join.rotation(dim).T, np.zeros(2, np.int64)
        got = [embedding_join._tile(np.arange(2), zero + 1, zero, zero, raw, b, (0, 0), threshold, blocks)[2] for b in range(blocks)]
        assert sum(int(n.sum()) for n in got) == 2
