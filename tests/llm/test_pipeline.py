"""Each pipeline stage against brute force on its own input."""

import re

import pytest

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and gave, written and read again as the driver does."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs.collect(), after.collect(), after.columns))
        docs = after
    return out


def test_stage_names_and_columns(stages):
    assert [s[0] for s in stages] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing"]
    assert all(s[3] == COLUMNS for s in stages[:-1])


def test_classifier_keeps_good_labels(spark, stages):
    _, before, after, _ = stages[0]
    kept = {r.doc_id for r in after}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.9 * len(good)
    assert len(after) < len(before)


def test_lines(stages):
    _, before, after, _ = stages[1]
    looked = lambda s: len(s) >= 20 or any(c.isalnum() for c in s)
    first, texts = {}, {r.doc_id: r.text for r in after}
    for r in sorted(before, key=lambda r: r.doc_id):
        for k, line in enumerate(r.text.split("\n")):
            s = line.strip(" \t\r")
            if looked(s):
                first.setdefault(s, (r.doc_id, k))
    for r in before:
        kept = [x for k, x in enumerate(r.text.split("\n")) if not looked(x.strip(" \t\r")) or first[x.strip(" \t\r")] == (r.doc_id, k)]
        got = texts.get(r.doc_id, "").split("\n")
        lost = [x for x in kept if x not in got]
        assert all(x in kept for x in got if x)
        for x in lost:  # near an earlier line
            s = x.strip(" \t\r")
            assert (len(s) >= 20 and any(len(o) >= 20 and abs(len(s) - len(o)) <= 2 and first[o] < first[s] for o in first)) or not "\n".join(kept).strip()


def test_near_duplicates(stages):
    _, before, after, _ = stages[2]
    sets = {}
    for r in before:
        w = words(r.text)
        n = min(5, len(w))
        sets[r.doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in after) == [i for i in ids if find(i) == i]


def test_contamination(spark, stages):
    _, before, after, _ = stages[3]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    lengths = {len(x) for x in windows}
    clean = []
    for r in before:
        w, hit = words(r.text), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append(r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(clean)


def test_mix(stages):
    _, before, after, _ = stages[4]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in before}
    assert all(r["size"] == size[r.doc_id] and 0 <= r.taken <= 3 * r["size"] for r in after)
    for s in {r.source for r in after}:
        mine = [r for r in after if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) < 1


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, h string, _wins int, _first string, _quality string, n_lines int, n_exact string, n_near int, _n_words int, _spans string, _items int, id string, class_id int"
EXTRA = ("own", 7, "f", "q", 1, "e", 2, 3, "s", 4, "i", 5)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_nulls_repeats_long_texts_empty_tables_and_clashing_columns(spark, k):
    long_ = " ".join(f"w{i % 977}" for i in range(20_000))
    texts = ["a text of more than five words that says something", "a text of more than five words that says something", None, "", " \n\t", long_, "a line that is long enough to be looked at\nand another one of its own"]
    rows = [(i if i != 4 else None, t, "en", "s", len(t or ""), *EXTRA) for i, t in enumerate(texts)] + [(0, texts[0], None, None, None, *EXTRA)]
    docs = spark.createDataFrame(rows, CLASHING)
    name, stage = cp.STAGES[k]
    out = stage(spark, docs, SF)
    if name == "source_mixing":
        assert out.count() == len(rows) and out.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    else:
        assert out.columns == docs.columns
        got = out.collect()
        assert all(tuple(r)[5:] == EXTRA for r in got) and len(got) <= len(rows)
        if name == "ngram_jaccard_join":
            assert sum(r.text == texts[0] for r in got) == 1 and any(r.text == long_ for r in got)
    assert stage(spark, docs.limit(0), SF).count() == 0
