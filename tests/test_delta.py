"""Delta maintenance against full builds of what is left."""

import random

import pytest
from pyspark.sql import functions as F

from trilayer.functions.canonical import canonical
from trilayer.operators import delta, graph

TRIPLES = "chunk_id string, pos int, head string, relation string, tail string, head_type string, tail_type string"
CHANGES = "doc_id string, chunk_id string, content string, removed boolean"


def triples_of(content):
    """A chunk says triples by its text: words in threes, types by their first letters."""
    w = content.split()
    return [(i // 3, w[i], w[i + 1], w[i + 2], f"T{w[i][0].lower()}", f"T{w[i + 2][0].lower()}") for i in range(0, len(w) - 2, 3)]


def extract(calls=None):
    def run(chunks):
        rows = chunks.collect()
        if calls is not None:
            calls.extend(r.chunk_id for r in rows)
        return chunks.sparkSession.createDataFrame([(r.chunk_id, *t) for r in rows for t in triples_of(r.content)], TRIPLES)

    return run


def embed(texts):
    return texts.select("id", F.array(F.length("text").cast("double"), F.lit(1.0)).alias("embedding"))


def text(k):
    rng = random.Random(k)
    return " ".join(f"{rng.choice(['a', 'B', 'b', 'c', 'É', 'e'])}{rng.randint(0, 3)} {rng.choice(['r', 'R', 's'])} {rng.choice('xyz')}{rng.randint(0, 2)}" for _ in range(rng.randint(0, 5)))


def state(mem, edges):
    get = lambda df, *c: sorted(map(str, (tuple(r) for r in df.select(*c).collect())))
    return {
        "facts": get(mem.facts, "fact_id", "head", "relation", "tail", "frequency", "schema_id"),
        "schemas": get(mem.schemas, "schema_id", "head_type", "relation", "tail_type", "frequency"),
        "links": get(mem.links, "fact_id", "passage_id"),
        "passages": get(mem.passages, "passage_id", "content"),
        "edges": get(edges, "src", "dst", "type", F.round("weight", 9), "relations"),
    }


def full(spark, members, resolutions=None):
    chunks = sorted({c for cs in members.values() for c in cs})
    df = spark.createDataFrame([(f"c{c}", text(c)) for c in chunks], "chunk_id string, content string")
    rows = spark.createDataFrame([(f"c{c}", *t) for c in chunks for t in triples_of(text(c))], TRIPLES)
    keyed = canonical(rows, {"head": "head_key", "relation": "rel_key", "tail": "tail_key", "head_type": "head_type_key", "tail_type": "tail_type_key"})
    mem = delta.layers(delta.resolve(keyed, resolutions).distinct(), df)
    return state(mem, graph.build_edges(mem))


def changes(spark, adds, removes=()):
    return spark.createDataFrame([(d, f"c{c}", text(c), False) for d, cs in adds.items() for c in cs] + [(d, None, None, True) for d in removes], CHANGES)


def test_batches_with_repeats_removals_and_a_restart_equal_a_full_build(spark, tmp_path, monkeypatch):
    store, calls = delta.DeltaMemory(spark, str(tmp_path / "m")), []
    members = {"d1": [1, 2, 3], "d2": [3, 4], "d3": [5, 6, 7, 8], "d4": [8, 9]}
    store.apply(changes(spark, members), extract(calls), 0, embed=embed)
    assert state(store.memory(), store.edges()) == full(spark, members)

    # repeats change nothing; a removed document leaves what others hold
    calls.clear()
    store.apply(changes(spark, {"d1": [1, 2], "d5": [2, 10, 11]}, ["d3", "nobody"]), extract(calls), 1, embed=embed)
    members = {"d1": [1, 2, 3], "d2": [3, 4], "d4": [8, 9], "d5": [2, 10, 11]}
    assert sorted(calls) == ["c10", "c11"]
    assert state(store.memory(), store.edges()) == full(spark, members)

    # broken off before its commit, then run again, and once more after that
    batch = changes(spark, {"d2": [12], "d6": [5, 6]}, ["d2", "d1"])
    with monkeypatch.context() as m:
        m.setattr(delta.DeltaMemory, "_mark", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.apply(batch, extract(), 2, embed=embed)
    assert state(store.memory(), store.edges()) == full(spark, members)
    members = {"d2": [12], "d4": [8, 9], "d5": [2, 10, 11], "d6": [5, 6]}
    again = delta.DeltaMemory(spark, str(tmp_path / "m"))
    for _ in range(2):
        again.apply(batch, extract(), 2, embed=embed)
        assert state(again.memory(), again.edges()) == full(spark, members)

    # vectors are those of the facts and chunks that are left
    mem = again.memory()
    ids = {r[0] for r in mem.facts.select("fact_id").union(mem.passages.select("passage_id")).collect()}
    assert {r.id for r in again.table("vectors").collect()} == ids and again.table("vectors").count() == len(ids)

    # after compaction readers go on from the base
    again.compact()
    assert state(again.memory(), again.edges()) == full(spark, members)
    again.apply(changes(spark, {}, list(members)), extract(), 3)
    assert all(not v for v in state(again.memory(), again.edges()).values())


def test_resolutions_are_replayed(spark, tmp_path):
    members = {"d1": [1, 2, 3], "d2": [3, 4], "d3": [5, 6, 7]}
    raw = sorted({t for cs in members.values() for c in cs for t in triples_of(text(c))})
    keyed = canonical(spark.createDataFrame([("c", *t) for t in raw], TRIPLES), {"head": "head_key", "relation": "rel_key", "tail": "tail_key", "head_type": "head_type_key", "tail_type": "tail_type_key"})
    ids = sorted({r.fact_id for r in delta.resolve(keyed, None).collect()})
    target = raw[-1]
    res = spark.createDataFrame([(ids[0], "discarded", None, None, None), (ids[1], "modified", *target[1:4]), (ids[2], "modified", "new", "r", "thing"), (ids[3], "kept", None, None, None)], "fact_id string, action string, head string, relation string, tail string")
    store = delta.DeltaMemory(spark, str(tmp_path / "m"))
    store.apply(changes(spark, {"d1": members["d1"], "d3": members["d3"]}), extract(), 0, res)
    store.apply(changes(spark, {"d2": members["d2"]}, ["d1"]), extract(), 1, res)
    del members["d1"]
    assert state(store.memory(), store.edges()) == full(spark, members, res)


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    for k, batch in enumerate([changes(spark, {"d1": [1, 2]}), changes(spark, {"d1": [1], "d2": [2, 3]}), changes(spark, {"d3": [4]}, ["d1"])]):
        batch.coalesce(1).write.mode("append").parquet(f"{src}/{k}")
    store = delta.DeltaMemory(spark, str(tmp_path / "m"))
    s = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    delta.stream_memory(s, store, extract(), str(tmp_path / "saved")).trigger(availableNow=True).start().awaitTermination()
    assert len(store.batches()) == 3
    held = {}
    for r in store.table("members").collect():
        held.setdefault(r.doc_id, []).append(int(r.chunk_id[1:]))
    assert state(store.memory(), store.edges()) == full(spark, held)
