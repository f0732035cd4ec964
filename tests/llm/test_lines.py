"""Line dedup as a whole against brute force, and its distance against the plain recurrence."""

import random

import pytest
from pyspark.sql import functions as F

from trilayer.llm import line_dedup
from tests.llm.test_edges import edits


def brute(docs, least, short, most=2):
    """{id: (text, n_lines, n_exact, n_near)} by comparing all lines with all."""
    first = {}
    looked = lambda x: len(x) >= least or (short and any(c.isalnum() for c in x))
    for i, text in sorted(docs):
        for k, line in enumerate((text or "").split("\n") if text is not None else []):
            if looked(x := line.strip(" \t\r")):
                first.setdefault(x, (i, k))
    long_ = [x for x in first if len(x) >= least]
    near = {x for x in long_ if any(first[y] < first[x] and abs(len(x) - len(y)) <= most and edits(x, y) <= most for y in long_)}
    out = {}
    for i, text in docs:
        lines = text.split("\n") if text is not None else []
        at = [x.strip(" \t\r") for x in lines]
        is_near = [x in near for x in at]
        exact = [looked(x) and not n and first[x] != (i, k) for k, (x, n) in enumerate(zip(at, is_near, strict=True))]
        kept = [x for x, e, n in zip(lines, exact, is_near, strict=True) if not e and not n]
        out[i] = (None if text is None else "\n".join(kept), len(lines), sum(exact), sum(is_near))
    return out


def variants(rng, base, n):
    out = []
    for _ in range(n):
        s = list(base)
        for _ in range(rng.randint(1, 4)):
            k = rng.randrange(len(s) + 1)
            s[k : k + rng.randint(0, 1)] = rng.choice(["", "q", "é", "😀"])
        out.append("".join(s))
    return out


@pytest.mark.parametrize(("many", "levels"), [(8, 1), (2, 1), (2, 2)])
def test_whole_dedup_equals_brute_force(spark, monkeypatch, many, levels):
    rng = random.Random(many + levels)
    monkeypatch.setattr(line_dedup, "MANY", many)
    monkeypatch.setattr(line_dedup, "LEVELS", levels)
    monkeypatch.setattr(line_dedup, "SIDE", 7)
    word = lambda: "".join(rng.choice("etanirsohé") for _ in range(rng.randint(2, 9)))
    pool = [" ".join(word() for _ in range(rng.randint(4, 9))) for _ in range(30)]
    pool += [x for b in pool[:6] for x in variants(rng, b, 12)]
    pool += ["12:00:01 host daemon: connection from " + word() + " " + word() for _ in range(60)]  # one long common prefix
    pool += ["ok", "--", "a b", "", "é", "😀 x"]
    docs = [(i, "\n".join(rng.choice(["", " "]) + rng.choice(pool) + rng.choice(["", "\t"]) for _ in range(rng.randint(1, 6)))) for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for short in (False, True):
        got = {r.doc_id: (r.text, r.n_lines, r.n_exact, r.n_near) for r in line_dedup.dedup(df, short=short).collect()}
        assert got == brute(docs, line_dedup.LEAST, short)


def test_distance_equals_the_recurrence(spark):
    rng = random.Random(1)
    rows = [("", ""), ("", "a"), ("a" * 300, "a" * 301)]
    for _ in range(600):
        a = "".join(rng.choice("abé😀") for _ in range(rng.randint(0, 14)))
        rows.append((a, variants(rng, a, 1)[0] if a else "ab"))
    df = spark.createDataFrame(rows, "a string, b string")
    for most in (0, 1, 2, 3):
        for r in df.select("a", "b", line_dedup.edit_distance(F.col("a"), F.col("b"), most).alias("d")).collect():
            assert min(r.d, most + 1) == min(edits(r.a, r.b), most + 1), (r, most)


def test_added_columns_must_be_free(spark):
    df = spark.createDataFrame([(1, "a", "z", "y")], "doc_id long, text string, first string, doc string")
    assert line_dedup.dedup(df).columns == [*df.columns, "n_lines", "n_exact", "n_near"]
    for name in ("n_lines", "n_exact", "n_near"):
        with pytest.raises(ValueError):
            line_dedup.dedup(df.withColumn(name, F.lit(1)))


def test_ids_of_text_and_repeated_rows(spark):
    line = "a line of words that repeats"
    df = spark.createDataFrame([("b", line), ("b", line), ("a", line + "\n" + line), (None, line + "s")], "doc_id string, text string")
    got = sorted((str(r.doc_id), r.text, r.n_exact, r.n_near) for r in line_dedup.dedup(df).collect())
    assert got == [("None", line + "s", 0, 0), ("a", "", 0, 2), ("b", "", 0, 1), ("b", "", 0, 1)]
