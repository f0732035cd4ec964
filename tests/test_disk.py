"""What derived tables take of the disk."""

from pyspark.sql import functions as F

from trilayer.functions.session import scratch, stored
from trilayer.functions.text import hash_id, packed, unpacked
from trilayer.plans.registry import Tables

SF = "/root/testdata/sf0.001"


def shuffles(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b for b in blocks.mkString(" ").split() if b.startswith("shuffle_")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before = shuffles(spark)
    path = scratch(spark, "t")
    assert stored(df, path).count() == 7 and spark.read.parquet(path).count() == 7
    # the count above has an exchange of its own, of a row a task; that of the grouping is gone
    left = shuffles(spark) - before
    assert len({b.split("_")[1] for b in left}) <= 2


def test_layers_are_stored_when_they_are_read(spark):
    t = Tables(spark, SF)
    assert t.mem.schemas.count() == 5
    assert not {"links", "facts", "passages"} & set(t.__dict__)
    before = shuffles(spark)
    facts = t.mem.facts
    assert not shuffles(spark) - before
    assert "passages" not in t.__dict__ and facts.count() == 3780


def test_packed_ids_come_back(spark):
    ids = ["chunk-" + "0123456789abcdef" * 2, "chunk-" + "0123456789ABCDEF" * 2, "chunk-" + "0" * 33, "chunk-" + "0" * 32 + "\n", "chunk-", "", "e1", "é\x00", None]
    df = spark.createDataFrame([(x,) for x in ids], "i string").select("i", packed(F.col("i"), "chunk-").alias("p"))
    assert [r.o for r in df.select(unpacked(F.col("p"), "chunk-").alias("o")).collect()] == ids
    assert df.select(F.countDistinct("p")).first()[0] == len(ids) - 1
    assert df.select(packed(hash_id(F.lit("x"), "chunk-"), "chunk-").alias("p")).first().p[1:].hex() == df.select(F.md5(F.lit("x"))).first()[0]


def test_lines_without_part_or_supplier_keep_their_other_triples(spark):
    t = Tables(spark, SF)
    all_ = t.triples.groupBy("relation").count().collect()
    t = Tables(spark, SF)
    t.__dict__["part"], t.__dict__["region"] = t.part.where("p_partkey % 2 = 0"), t.region.limit(0)
    some = {r["relation"]: r["count"] for r in t.triples.groupBy("relation").count().collect()}
    want = {r["relation"]: r["count"] for r in all_} | {"has brand": t.lineitem.where("l_partkey % 2 = 0").count()}
    del want["part of"]
    assert some == want


def test_keys_of_ascii_labels_fold_all_whitespace(spark):
    from trilayer.functions.canonical import _key, canonical

    labels = [a + x + b for x in ["", " ", "  ", "`", *(chr(c) for c in range(1, 32))] for a in ("", " ", "Ab", "A b ") for b in ("", " ", "C d", "\n")]
    got = canonical(spark.createDataFrame([(x,) for x in labels], "c string"), {"c": "k"}).collect()
    assert [r.k for r in got] == [_key(r.c) for r in got]
