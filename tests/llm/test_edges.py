"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import pytest
from pyspark.sql import functions as F

from trilayer.llm import conversations, decontam, embedding_join, kneser_ney, license_join, line_dedup, mixing, ngram_join, pii_crf, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, root string, id string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [
    (1, "the same text of some more than five words here", "en", "s", 1, "x", "y"), (1, "the same text of some more than five words here", "en", "s", 1, "x", "y"),
    (2, "the same text of some more than five words here", None, None, None, None, None), (None, "null id with a text of its own", "en", "s", 1, "x", "y"),
    (None, None, None, None, None, None, None), (3, "", "en", "t", 0, "x", "y"), (4, None, "en", "t", 0, "x", "y"), (5, LONG, "en", "s", 9, "x", "y"), (6, "\n\n \t", "en", "s", 9, "x", "y"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_ngram_join(spark, docs, none):
    rows = ngram_join.label(docs, ngram_join.join(docs)).collect()
    assert len(rows) == len(ROWS)
    same = [r for r in rows if r.doc_id in (1, 2)]
    assert {r.class_id for r in same} == {1} and {r.n_links for r in same} == {2} and sum(r.kept for r in same) == 2
    assert all(r.n_links == 0 and r.kept for r in rows if r.doc_id in (3, 4, 5, 6))
    assert ngram_join.label(none, ngram_join.join(none)).count() == 0


def test_kneser_ney(spark, docs, none):
    m = kneser_ney.count(docs, shard_tokens=2000)
    assert m["shards"] > 3
    rows = kneser_ney.score(docs, m).collect()
    assert len(rows) == len(ROWS) and all(r.lm_score <= 0 and r.n_known == r.n_tokens for r in rows)
    assert {r.n_tokens for r in rows if not (r.text or "").strip()} == {1}
    # a model split into shards scores like one in a single shard
    whole = kneser_ney.score(docs, kneser_ney.count(docs)).collect()
    assert sorted(round(r.lm_score, 9) for r in rows) == sorted(round(r.lm_score, 9) for r in whole)
    nothing = kneser_ney.score(docs, kneser_ney.count(none)).collect()
    assert all(abs(r.lm_score) < 1e-12 and r.n_known == 0 for r in nothing)
    assert kneser_ney.score(none, m).count() == 0
    with pytest.raises(ValueError):
        kneser_ney.score(docs.withColumn("n_known", F.lit(1)), m)


def test_mixing(spark, docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 3 * r.size for r in rows)
    by = {r.source: r for r in rows}
    for s in by:
        assert abs(sum(r.taken for r in rows if r.source == s) - by[s].target) < 1
    assert by["t"].target == 0 and abs(sum(r.target for r in by.values()) - sum(r.size for r in rows)) < 1e-6
    assert mixing.mix(none).count() == 0
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


def test_mixing_targets_by_water_filling(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 1), (None, 500), ("d", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    w, size = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}, {"a": 1000, "b": 10, "c": 1, "d": 0, None: 500}
    target, left, open_ = {}, 1511.0, set(w)
    while True:
        over = {s for s in open_ if left * w[s] / sum(w[x] for x in open_) > 3 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= over
    target |= {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
    assert {s: round(x, 6) for s, x in got.items()} == {s: round(x, 6) for s, x in target.items()}


def test_embedding_join(spark):
    v = [1.0, 0.0, 0.0, 0.0, 0.0]
    rows = [(1, v, 1), (1, v, 1), (2, [2.0, 0.0, 0.0, 0.0, 0.0], 1), (3, v, None), (4, None, 1), (5, [0.0] * 5, 1), (6, [float("nan")] + v[1:], 1), (7, [None, 1.0], 1), (8, v, 2), (None, v, 2), (9, [1.0, 0.3, 0.0, 0.0, 0.0], 1), (10, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("copies", F.lit("clash"))
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embedding_join.join(df).collect())
    assert got == sorted([("1", 3, "1", True), ("1", 3, "1", True), ("2", 3, "1", False), ("9", 3, "1", False), ("8", 1, "8", True), ("None", 1, "8", False), *[(str(i), 0, str(i), True) for i in (3, 4, 5, 6, 7, 10)]])
    assert embedding_join.join(df.limit(0)).count() == 0


def test_embedding_join_tiles_count_each_pair_once(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.standard_normal((6, 16))
    x = np.concatenate([b + 0.12 * rng.standard_normal((40, 16)) for b in base]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(y) for y in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.93).sum(axis=1) - 1
    size = embedding_join.TILE
    try:
        embedding_join.TILE = 16  # many tiles
        got = {r.vec_id: r.n_links for r in embedding_join.join(df).collect()}
    finally:
        embedding_join.TILE = size
    assert [got[i] for i in range(len(x))] == want.tolist()


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def test_line_links_are_complete(spark):
    import random

    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(20, 40))).strip("é ").ljust(20, "z") for _ in range(12)]
    lines = set(base)
    for b in base:
        for _ in range(12):
            s = list(b)
            for _ in range(rng.randint(1, 4)):
                k = rng.randrange(len(s))
                s[k : k + rng.randint(0, 1)] = rng.choice(["", "q", "é"])
            lines.add("".join(s).strip())
    lines = sorted(x for x in lines if len(x) >= 20)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    ids = {r.h: r.text for r in df.select(F.xxhash64("text").alias("h"), "text").collect()}
    got = {tuple(sorted((ids[r.a], ids[r.b]))) for r in line_dedup.near_links(df).collect()}
    want = {(a, b) for i, a in enumerate(lines) for b in lines[i + 1 :] if abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2}
    assert got == want and len(want) > 50


def test_line_dedup(spark, docs, none):
    out = line_dedup.dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_exact", "n_near"]
    rows = out.collect()
    assert len(rows) == len(ROWS)
    assert {(r.doc_id, r.text == "", r.n_exact) for r in rows if r.doc_id in (1, 2)} == {(1, False, 0), (2, True, 1)}
    assert [r.text for r in rows if r.doc_id == 4] == [None] and [r.n_lines for r in rows if r.doc_id == 4] == [0]
    assert line_dedup.dedup(none).count() == 0
    two = spark.createDataFrame([(1, "a line of words that repeats\nshort\nshort"), (2, "own\na line of words that repeat"), (3, "a line of words that repeats")], "doc_id long, text string")
    assert {r.doc_id: (r.text, r.n_exact, r.n_near) for r in line_dedup.dedup(two, short=False).collect()} == {1: ("a line of words that repeats\nshort\nshort", 0, 0), 2: ("own", 0, 1), 3: ("", 1, 0)}
    assert {r.doc_id: (r.text, r.n_exact, r.n_near) for r in line_dedup.dedup(two).collect()} == {1: ("a line of words that repeats\nshort", 1, 0), 2: ("own", 0, 1), 3: ("", 1, 0)}


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, "same TEXT of some"), (1, "same text of some"), (None, "id with a"), (2, None), (3, "..."), (4, LONG[:200])], "item_id long, text string")
    rows = decontam.mark(docs, bench).collect()
    assert len(rows) == len(ROWS)
    assert {r.doc_id: ([tuple(s) for s in r.spans], r["items"]) for r in rows if r.doc_id in (1, 2, 3, 4)} == {1: ([(1, 5)], ["1"]), 2: ([(1, 5)], ["1"]), 3: ([], []), 4: ([], [])}
    assert [r["items"] for r in rows if r.doc_id is None and r.text] == [["null"]]
    assert [len(r.spans) > 10 for r in rows if r.doc_id == 5] == [True]
    key = lambda r: (str(r.doc_id), str(r.text)[:9], str(r.spans), str(r["items"]))
    blocks = decontam.mark(docs, bench, block_chars=10).collect()  # a pass for each item
    assert sorted(map(key, rows)) == sorted(map(key, blocks))
    assert decontam.mark(none, bench).count() == 0 and all(not r.spans for r in decontam.mark(docs, bench.limit(0)).collect())
    with pytest.raises(ValueError):
        decontam.mark(docs.withColumn("spans", F.lit(1)), bench)


def test_fm_index_finds_all_occurrences():
    import numpy as np

    rng = np.random.default_rng(1)
    seq = np.concatenate(([0], rng.integers(1, 4, 500), [0], rng.integers(1, 4, 300), [0]))
    index = decontam.FMIndex(seq, 3)
    for pattern in ([1], [2, 3], [1, 1, 2], [3, 2, 1, 3, 2]):
        lo, hi = np.array([0]), np.array([len(seq)])
        for c in reversed(pattern):
            lo, hi = index.search(lo, hi, np.array([c]))
        at = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
        assert at == [i for i in range(len(seq)) if seq[i : i + len(pattern)].tolist() == pattern]


def test_quality(spark, docs, none):
    train = [(i, ("good plain words of text " * 5) if i % 2 else ("BAD!! JUNK!! " * 8), i % 2) for i in range(300)]
    d = spark.createDataFrame([(i, x) for i, x, _ in train], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in train] + [(None, 1), (5, None), (7, 3)], "doc_id long, quality int")
    model = quality.train(d, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    held = quality.score(d.where(quality.held_out(F.col("doc_id"))), model).collect()
    assert len(held) > 50 and all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in held)
    assert quality.score(none, model).count() == 0
    assert {r.score for r in quality.score(docs, quality.train(d, labels.limit(0))).collect()} == {0.5}


def test_conversations(spark):
    rows = [
        (1, 0, "user", "hi", "z"), (1, 1, "assistant", "yo", "z"), (2, 0, "user", "hi", "z"), (3, 0, "user", "hi", "z"), (3, 1, "assistant", "yo", "z"), (3, 2, "user", "ok", "z"),
        (4, 0, "user", "hi", "z"), (4, 1, "assistant", "yo", "z"), (4, 2, "user", "ok", "z"), (None, 0, "user", None, "z"), (5, 0, None, "", "z"), (6, 0, "user", "", "z"), (7, 0, "user", "a", "z"), (7, 0, "user", "a", "z"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in conversations.collapse(df).collect()}
    assert set(got) == {3, None, 5, 6, 7} and got[3][:2] == (3, 2) and got[7][0] == 2
    assert got[3][2] == "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n<|user|>\nok<|end|>\n"
    assert conversations.collapse(df.limit(0)).count() == 0


def test_pii(spark, docs, none):
    text = "é mail a.b@c.org, call (555) 123-4567 or +1 (555) 123-4567; card 4111 1111 1111 1111 or 4111.1111.1111.1111, host 10.0.0.300 and 10.0.0.3"
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(9, text)], "doc_id long, text string"))
    rows = pii_crf.find(df).collect()
    found = [(s.kind, text[s.first : s.end], s.base) for s in next(r for r in rows if r.doc_id == 9).pii]
    assert found == [("email", "a.b@c.org", True), ("phone", "(555) 123-4567", False), ("phone", "+1 (555) 123-4567", True), ("card", "4111 1111 1111 1111", True), ("card", "4111.1111.1111.1111", False), ("ip", "10.0.0.3", True)]
    assert all(not r.pii for r in rows if r.doc_id != 9)
    assert pii_crf.find(none).count() == 0


def test_pii_patterns_equal_the_plain_expressions():
    import random
    import re

    rng = random.Random(2)
    plain = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]
    check = [lambda s: True, lambda s: all(int(x) <= 255 for x in s.split(".")), pii_crf.is_card, pii_crf.is_phone]
    for _ in range(3000):
        s = "".join(rng.choice("a@.-+ 012 4 é()") for _ in range(60))
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(plain) for m in p.finditer(s) if check[k](m.group()))
        assert pii_crf.base_spans(s) == want


def test_license(spark, docs, none):
    df = spark.createDataFrame([(9, "Cc By\nNC 4.0\nLicensed UNDER the apache license, version 2.0"), (10, "under the mit\nlicense")], "doc_id long, text string")
    rows = {r.doc_id: r for r in license_join.scan(df).collect()}
    assert [(p.word, p.label) for p in rows[9].places] == [(0, "cc-by-nc"), (8, "apache-2")]
    assert [(m.block, m.label, m.containment) for m in rows[9].matches] == [(2, "apache-2", 1.0)]
    assert [(p.word, p.label) for p in rows[10].places] == [(0, "mit")]
    every = license_join.scan(docs).collect()
    assert len(every) == len(ROWS) and all(not r.places and not r.matches for r in every)
    assert license_join.scan(none).count() == 0


def test_line_links_of_many_variants_are_complete(spark):
    import random

    rng = random.Random(8)
    base = " ".join("".join(rng.choice("etanirsodhl") for _ in range(6)) for _ in range(12))
    lines = {base}
    while len(lines) < 200:
        w = base.split()
        for _ in range(rng.randint(1, 2)):
            k = rng.randrange(4, 12)
            w[k] = "".join(rng.choice("etanirs") for _ in range(6)) if rng.random() < 0.7 else w[k][:-1] + rng.choice("xyz")
        lines.add(" ".join(w))
    lines = sorted(lines)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    ids = {r.h: r.text for r in df.select(F.xxhash64("text").alias("h"), "text").collect()}
    got = {tuple(sorted((ids[r.a], ids[r.b]))) for r in line_dedup.near_links(df).collect()}
    want = {(a, b) for i, a in enumerate(lines) for b in lines[i + 1 :] if abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2}
    assert got == want and len(want) > 20


def test_license_over_several_lines(spark):
    import textwrap

    for label, notice in license_join.TEMPLATES:
        wrapped = "\n".join("# " + x for x in textwrap.wrap(notice, 24))
        assert "\n" in wrapped
        apart = wrapped.replace("\n", "\n\n")
        rows = [(1, f"Own words.\n\n{wrapped}\n\nMore words."), (2, f"Own words.\n{apart}\n\nMore words."), (3, apart), (4, f"Own words.\n\n{notice}\n\nMore words.")]
        got = {r.doc_id: r for r in license_join.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        last = wrapped.count("\n")
        want = {1: (2, 2 + last), 2: (1, 1 + 2 * last), 3: (0, 2 * last)}
        for i, (a, b) in want.items():
            assert (label, a, b, 1.0) in [tuple(s) for s in got[i].spans], (i, label)
        assert not got[4].spans and label in [m.label for m in got[4].matches]
    lines = [textwrap.fill(t, 70) for _, t in license_join.TEMPLATES if len(t) > 100]
    halves = [(9, lines[0].split("\n")[0]), (10, lines[0].split("\n")[1]), (11, None), (12, ""), (13, "\n\n")]  # a window stays in its row
    got = license_join.scan(spark.createDataFrame([*enumerate(lines), *halves], "doc_id long, text string").coalesce(1)).collect()
    assert [{s.label for s in r.spans} for r in got] == [{"mit"}, {"bsd"}, set(), set(), set(), set(), set()]
    assert [r.matches for r in got] == [[]] * 7


def test_ngram_join_recall_when_all_buckets_are_large(spark, monkeypatch):
    pairs, rows = 1500, []
    for i in range(pairs):
        common = " ".join(f"c{i}x{k}" for k in range(84))  # 80 shingles, and 10 more on each side
        rows += [(2 * i + side, common + "".join(f" s{side}x{i}x{k}" for k in range(10))) for side in (0, 1)]
    monkeypatch.setattr(ngram_join, "BUCKET", 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    met = sum(r.n_links for r in ngram_join.join(df).collect()) / 2
    assert met >= 0.992 * pairs


def test_line_dedup_of_short_lines(spark, none):
    footer = "Terms | Home | Help"
    assert len(footer) == 19
    rows = [(i, f"own {i}\n\n{footer}" + ("\n\nOK\nOK\n--\n--" if i == 0 else "")) for i in range(30)] + [(30, "Terms | Home | Hell"), (31, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = line_dedup.short_repeats(df).collect()
    assert [(r.n_lines, r.n_repeats) for r in left] == [(63, 30)]
    assert [(r.n_lines, r.n_repeats) for r in line_dedup.short_repeats(none).collect()] == [(0, 0)]
    got = {r.doc_id: (r.text, r.n_exact, r.n_near) for r in line_dedup.dedup(df, short=True).collect()}
    want = {i: (f"own {i}\n", 1, 0) for i in range(1, 30)} | {0: (f"own 0\n\n{footer}\n\nOK\n--\n--", 1, 0), 30: ("Terms | Home | Hell", 0, 0), 31: (None, 0, 0)}
    assert got == want


def test_decontamination_equals_plain_search_over_all_cuts(spark):
    import random
    import re

    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["a", "B", "c", "dé", "e", "f,"]) for _ in range(n))
    items = [(f"i{k}", text(rng.choice([0, 2, 5, 13, 14, 30]))) for k in range(12)] + [("i3", "a a a"), (None, "b c dé b c"), ("i99", None)]
    rows = [(i, text(rng.choice([0, 1, 3, 40, 400]))) for i in range(30)] + [(30, f"{items[-3][1]} {text(900)}"), (31, None), (None, items[-2][1])]
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (s or "").lower())
    windows = {}
    for item, s in items:
        w = words(s)
        for k in range(max(1, len(w) - 4) if w else 0):
            windows.setdefault(tuple(w[k : k + 5]), set()).add(str(item) if item is not None else "null")
    want = []
    for i, s in rows:
        w, hit, found = words(s), set(), set()
        for g, owners in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= owners
        want.append((str(i), len(w), sorted(hit), sorted(found)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    for chars, shard in ((decontam.BLOCK_CHARS, decontam.SHARD_WORDS), (60, 7), (1, 50)):
        got = decontam.mark(d, b, window=5, block_chars=chars, shard_words=shard).collect()
        assert sorted((str(r.doc_id), r.n_words, [x for s in r.spans for x in range(s.first, s.end)], list(r.items)) for r in got) == sorted(want)


def test_license_matches_equal_plain_containment(spark):
    import random
    import re

    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(60)]
    templates = [(f"t{k}", " ".join(rng.sample(vocabulary, rng.randint(1, 12)))) for k in range(200)] + [("none", "--")]
    lines = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 25))) for _ in range(300)] + [t for _, t in templates[:20]]
    words = lambda s: set(re.findall(r"[a-z0-9]+", s))
    got = license_join.scan(spark.createDataFrame(enumerate(lines), "doc_id long, text string"), templates=templates).collect()
    for r in got:
        sets = [(label, words(t)) for label, t in templates if words(t)]
        want = sorted((label, len(s & words(r.text)) / len(s)) for label, s in sets if len(s & words(r.text)) >= 0.8 * len(s) - 1e-9)
        assert sorted((m.label, m.containment) for m in r.matches) == want


def test_field_decodes_and_weighs_as_all_labellings_do():
    import itertools

    import numpy as np

    rng, n = np.random.default_rng(2), pii_crf._N
    trans = rng.normal(size=(n + 1, n)) + np.concatenate([pii_crf._forbidden(), [[-1e4 if x[0] == "I" else 0.0 for x in pii_crf._LABELS]]])
    for length in (1, 2, 3, 4):
        em = 2 * rng.normal(size=(length, n))
        every = list(itertools.product(range(n), repeat=length))
        score = np.array([trans[n, y[0]] + sum(em[k, y[k]] for k in range(length)) + sum(trans[y[k - 1], y[k]] for k in range(1, length)) for y in every])
        padded = np.concatenate([em, np.zeros((2, n))])
        assert tuple(pii_crf.viterbi(np.stack([padded, padded]), np.array([length, length]), trans)[1][:length]) == every[int(score.argmax())]
        p = np.exp(score - score.max())
        p /= p.sum()
        spans = [(begin, a, b) for begin in (1, 5) for a in range(length) for b in range(a + 1, length + 1)]
        for (begin, a, b), got in zip(spans, pii_crf.span_probabilities(em, trans, spans), strict=True):
            want = sum(w for y, w in zip(every, p, strict=True) if y[a] == begin and all(x == begin + 1 for x in y[a + 1 : b]) and (b == length or y[b] != begin + 1))
            assert abs(want - got) < 1e-9


def test_field_on_planted_spans_and_in_long_lines():
    import random

    rng = random.Random(12)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        d = "4" + digits(14)
        return next(d + c for c in "0123456789" if pii_crf.luhn(d + c))

    w, trans = pii_crf.train()
    words = "the office of river stones has many old maps and they said so again before winter".split()
    planted, hit, false = 0, 0, 0
    for k in range(400):
        before, after = (" ".join(rng.choices(words, k=rng.randint(2, 8))) for _ in range(2))
        c = card()
        secret = [f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", ".".join(c[i : i + 4] for i in range(0, 16, 4)), None][k % 4]
        other = rng.choice([f"in {rng.randint(1900, 2030)}", f"at {rng.randint(1, 12)}:{digits(2)}", f"for {digits(2)}.{digits(2)}", f"version {digits(1)}.{digits(1)}.{digits(1)}"])
        line = f"{before} {secret or other} {after}"
        got = pii_crf.field_spans([(0, 0, line)], w, trans)
        right = sum(line[a:b] == secret for _, a, _, b in got)
        planted, hit, false = planted + (secret is not None), hit + right, false + len(got) - right
    print(f"planted {planted}, found {hit}, others {false}")
    assert hit >= 0.9 * planted and false <= 0.02 * planted
    line = " ".join(["plain words"] * 1500 + ["call (555) 123-4567 now"] + ["more words"] * 1070 + ["or 555-010-2231 then"] + ["end"] * 3000)
    assert [line[a:b] for _, a, _, b in sorted(pii_crf.field_spans([(0, 0, line)], w, trans))] == ["(555) 123-4567", "555-010-2231"]


def test_quality_features_equal_plain_ones():
    """Grams of characters of one word, and the scores of many rows, against one row at a time in plain Python."""
    import random
    import re

    import numpy as np

    rng = random.Random(5)
    texts = ["", " ", "a", "é b", "añb  çdé\tfgh", "日本語の 文", "\U0001f600x \U0001f600\U0001f601yz"] + ["".join(rng.choice("abcé日 \n\t") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    data = [np.frombuffer(x.encode(), np.uint8) for x in texts]
    off = np.concatenate(([0], np.cumsum([len(x) for x in data])))
    table = np.random.default_rng(1).normal(size=quality.TABLE)
    got = quality.logits(np.concatenate(data), off, table)
    names = {}
    for x, d, z in zip(texts, data, got, strict=True):
        f, v = quality._bag(d)
        assert abs(float(v @ table[f]) - z) < 1e-9
        plain = re.sub(r"[\x09-\x0D]", " ", x)
        want = [plain[i : i + n] for n in (3, 4) for i in range(len(plain) - n + 1) if " " not in plain[i + 1 : i + n - 1]]
        grams = [(n, i, b) for n, (at, bucket, _) in zip((3, 4), quality._grams(d, np.array([0, len(d)])), strict=False) for i, b in zip(at.tolist(), bucket.tolist(), strict=True)]
        assert [plain[i : i + n] for n, i, _ in grams] == want
        for n, i, b in grams:
            assert names.setdefault(plain[i : i + n], b) == b


def test_quality_fit_separates_labels_by_a_telling_word():
    import numpy as np

    rng = np.random.default_rng(3)
    bags = [(np.sort(rng.choice(quality.TABLE, 30, replace=False)), rng.random(30) / 30) for _ in range(80)]
    labels = np.array([k % 2 for k in range(80)])
    for k in range(80):  # a word that tells the label
        bags[k] = np.append(bags[k][0], 7 + labels[k]), np.append(bags[k][1], 0.3)
    table, bias = quality.fit(bags, labels)
    z = np.array([float(v @ table[f]) + bias for f, v in bags])
    assert ((z > 0) == (labels == 1)).all() and np.mean(np.log1p(np.exp(-np.where(labels == 1, z, -z)))) < 0.3


def test_conversations_are_told_apart_whatever_their_characters(spark):
    rows = [(1, 0, "a\x1f=b", "c"), (2, 0, "a", "b\x1f=c"), (3, 0, "a-", "b"), (4, 0, "a", "-b"), (5, 0, "x", "y" * 300_000), (6, 0, "x", "y" * 300_000), (6, 1, "z", None)]
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in conversations.collapse(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (1, 1), 6: (2, 1)}


def test_license_templates_in_blocks_are_found_as_in_one(spark):
    import random

    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(80)]
    templates = [(f"t{k}", " ".join(rng.sample(vocabulary, rng.randint(2, 30)))) for k in range(60)] + [("none", "--")]
    texts = [None, "", "under the MIT license"]
    for k in range(120):
        words = [w for _ in range(rng.randint(0, 3)) for w in templates[rng.randrange(60)][1].split()] + rng.choices(vocabulary, k=20)
        texts.append("".join(w + rng.choice([" ", " ", " ", "\n"]) for w in words))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, _found0_ string, extra int")
    one = license_join.scan(df, templates=templates).orderBy("doc_id")
    rows = one.collect()
    assert sum(len(r.matches) for r in rows) > 20 and sum(len(r.spans) for r in rows) > 20 and rows[2].places
    for chars in (400, 5000):
        cut = license_join.scan(df, templates=templates, template_chars=chars).orderBy("doc_id")
        assert cut.columns == one.columns
        assert [sorted(map(str, [r.doc_id, r.n_words, r._found0_, r.extra, r.places, sorted(r.matches), sorted(r.spans)])) for r in cut.collect()] == [sorted(map(str, [r.doc_id, r.n_words, r._found0_, r.extra, r.places, sorted(r.matches), sorted(r.spans)])) for r in rows]


def test_license_scan_without_templates(spark, docs):
    for templates, phrases in (([], {}), ([("empty", " .")], {}), ([], {"same text": "x"})):
        rows = license_join.scan(docs, templates=templates, phrases=phrases).collect()
        assert len(rows) == len(ROWS) and not any(r.matches or r.spans for r in rows) and any(r.places for r in rows) == bool(phrases)
