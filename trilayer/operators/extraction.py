"""Extraction as a checkpointed job around user-supplied batch functions.

A batch function takes and returns a pandas frame and runs inside
``mapInPandas``; everything around it is DataFrame code.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trilayer.functions.session import materialise, stored, without_leftovers

EXTRACTION = "chunk_id string, passage string, entities array<string>, triples array<struct<head:string,relation:string,tail:string>>, failed boolean, error string"
BatchFn = Callable[[pd.DataFrame], pd.DataFrame]


def is_hit() -> Column:
    """A record that needn't be extracted again: flagged good, or unflagged (older) and not empty."""
    some = (F.coalesce(F.size("entities"), F.lit(-1)) > 0) | (F.coalesce(F.size("triples"), F.lit(-1)) > 0)
    return F.when(F.col("failed").isNull(), some).otherwise(~F.col("failed"))


def missing_chunks(chunks: DataFrame, extractions: DataFrame) -> DataFrame:
    """Chunks without a usable record."""
    return chunks.join(extractions.where(is_hit()).select("chunk_id"), "chunk_id", "left_anti")


def run_batches(df: DataFrame, fn: BatchFn, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)

    return df.mapInPandas(run, schema)


def call_twice(df: DataFrame, fn: BatchFn, schema: str, ok: Column) -> DataFrame:
    """Replies of ``fn`` over ``df``, whose columns they keep; those that aren't ``ok`` are asked for once more.

    Both rounds are checkpointed, so that no reply is asked for again when it is
    read again.  What fails twice stays as the second reply has it.
    """
    first = materialise(run_batches(df, fn, schema))
    good = F.coalesce(ok, F.lit(False))
    again = materialise(run_batches(first.where(~good).select(df.columns), fn, schema))
    return first.where(good).unionByName(again)


def extract_batch(entities: Callable[[str], list[str]], triples: Callable[[str, list[str]], list[tuple[str, str, str]]]) -> BatchFn:
    """Two steps a row: entities, then triples given them; an exception makes a failed row."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for chunk_id, passage in zip(b["chunk_id"], b["content"], strict=True):
            try:
                found = entities(passage)
                facts = [dict(zip(("head", "relation", "tail"), t, strict=True)) for t in triples(passage, found)]
                rows.append((chunk_id, passage, found, facts, False, None))
            except Exception as e:  # noqa: BLE001  the model's failure is the row's result
                rows.append((chunk_id, passage, [], [], True, str(e)))
        return pd.DataFrame(rows, columns=["chunk_id", "passage", "entities", "triples", "failed", "error"])

    return run


#: Rows of one call of the batch function.
SUB_BATCH = 64


def cached(spark: SparkSession, cache_path: str) -> DataFrame:
    """All committed good records.  A folder without a manifest isn't read."""
    try:
        done = [r["folder"] for r in spark.read.schema("folder string").json(f"{cache_path}/manifests").collect()]  # a row a wave
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = []
    return spark.read.schema(EXTRACTION).parquet(*[f"{cache_path}/attempts/{x}" for x in done]).where("not failed") if done else spark.createDataFrame([], EXTRACTION)


def commit(records: DataFrame, cache_path: str) -> None:
    """Write good records to an attempt folder of their own, then its manifest, which makes them count."""
    folder = uuid.uuid4().hex
    records.where("not failed").write.parquet(f"{cache_path}/attempts/{folder}")
    _count_in(records.sparkSession, cache_path, folder)


def _count_in(spark: SparkSession, cache_path: str, folder: str) -> None:
    spark.createDataFrame([(folder,)], "folder string").coalesce(1).write.mode("append").json(f"{cache_path}/manifests")


def sub_batches(chunks: DataFrame, rows: int) -> DataFrame:
    """``chunks`` (materialised) with ``sub``: numbers of batches of ``rows``, counted on over the partitions."""
    c = materialise(chunks.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = materialise(c.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")))  # a row a partition
    first = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = c.join(F.broadcast(sizes.select("_part", first.alias("_first"))), part == F.col("_part"))
    number = F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return place.select(*chunks.columns, F.floor(number / rows).alias("sub"))


#: Sub-batches of one job, for each core.
JOB_SUBS = 64
#: A task's file counts when the task ends, whether or not its job does.
TASK_COMMIT = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def extract(chunks: DataFrame, cache_path: str, fn: BatchFn, rows: int = SUB_BATCH, parallel: int | None = None) -> DataFrame:
    """Extract (chunk_id, content) that the cache lacks; returns the failures, which aren't cached.

    ``fn`` is called with sub-batches of ``rows``, each a task that writes one
    file, and a file counts from then on: the run's folder has its manifest before
    the first.  So a run that is killed repeats the sub-batches that were under
    way, one for each core; a lost executor's sub-batch is called again.  With
    ``parallel`` less than the cores, that many are under way at a time.
    """
    spark = chunks.sparkSession
    todo = missing_chunks(chunks.select("chunk_id", "content").dropDuplicates(["chunk_id"]), cached(spark, cache_path))
    todo = stored(sub_batches(todo, rows))  # in order of sub, so that a job reads its own part
    cores = spark.sparkContext.defaultParallelism
    at_once = parallel if parallel and parallel < cores else JOB_SUBS * cores
    last = todo.agg(F.max("sub")).first()[0]
    if last is None:
        return spark.createDataFrame([], EXTRACTION)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if own := [b for b in batches if len(b)]:
            yield fn(pd.concat(own, ignore_index=True)[["chunk_id", "content"]])

    name = uuid.uuid4().hex
    folder = f"{cache_path}/attempts/{name}"
    spark.createDataFrame([], EXTRACTION).write.parquet(folder)
    _count_in(spark, cache_path, name)
    for first in range(0, last + 1, at_once):
        n = min(at_once, last + 1 - first)
        job = todo.where(F.col("sub").between(first, first + n - 1)).repartitionById(n, (F.col("sub") - first).cast("int"))
        with without_leftovers(spark):
            job.mapInPandas(run, EXTRACTION).write.mode("append").options(**TASK_COMMIT).parquet(folder)
    return spark.read.schema(EXTRACTION).parquet(folder).where("failed")


class ExtractionError(RuntimeError):
    """Chunks failed twice; all others are cached."""


def retry_failed(failed: DataFrame, fn: BatchFn, cache_path: str) -> DataFrame:
    """Second attempt for failed rows: recovered ones are appended to the cache and returned.

    Rows that fail again are an error, raised after the others are cached; they
    stay out of the cache, so the next run tries them once more.
    """
    again = materialise(run_batches(failed.select("chunk_id", F.col("passage").alias("content")), fn, EXTRACTION))
    good = again.where("not failed")
    commit(again, cache_path)
    bad = again.where("failed").agg(F.count("*").alias("n"), F.min(F.struct("chunk_id", "error")).alias("x")).first()
    if bad["n"]:
        raise ExtractionError(f"{bad['n']} of {again.count()} chunks failed twice, {bad['x']['chunk_id']}: {bad['x']['error']}")
    return good


def normalise_entities(raw: Column) -> Column:
    """Names from a JSON array of strings or of objects with name, entity or text: trimmed, not blank, distinct in order."""
    items = F.from_json(raw, "array<string>")
    name = lambda x: F.when(F.startswith(F.ltrim(x), F.lit("{")), F.coalesce(*[F.nullif(F.get_json_object(x, f"$.{k}"), F.lit("")) for k in ("name", "entity", "text")])).otherwise(x)
    named = F.filter(F.transform(items, lambda x: F.trim(name(x))), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.array_distinct(named), F.array().cast("array<string>"))


def _slots(x: Column, keys: tuple[str, ...]) -> Column:
    paths = [F.from_json(F.get_json_object(x, f"$.{k}"), "array<string>") for k in keys]
    paths = [F.when(F.size(p) == 3, p) for p in paths]
    bare = F.when(F.startswith(F.ltrim(x), F.lit("[")), F.from_json(x, "array<string>"))
    return F.coalesce(F.when(F.size(bare) == 3, bare), *paths)


def _structs(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.struct(r[0].alias("head"), r[1].alias("relation"), r[2].alias("tail")))


def normalise_triples(raw: Column) -> Column:
    """Triples from a JSON array of 3-lists or objects; every slot trimmed and not blank."""
    items = F.from_json(raw, "array<string>")
    found = F.filter(F.transform(items, lambda x: _slots(x, ("triple", "processed_triple", "raw_triple"))), lambda r: r.isNotNull())
    found = F.transform(found, lambda r: F.transform(r, lambda x: F.trim(x)))
    return F.coalesce(_structs(F.filter(found, lambda r: F.forall(r, lambda s: s.isNotNull() & (s != "")))), F.array().cast("array<struct<head:string,relation:string,tail:string>>"))


def parse_triples(raw: Column) -> Column:
    """As ``normalise_triples`` without the blank check, and also from a tuple literal under triple_str."""
    literal = lambda x: F.transform(F.regexp_extract_all(F.get_json_object(x, "$.triple_str"), F.lit(r"""['"]([^'"]*)['"]"""), F.lit(1)), lambda s: s)
    one = lambda x: F.coalesce(_slots(x, ("processed_triple", "triple", "raw_triple")), F.when(F.size(literal(x)) == 3, literal(x)))
    return _structs(F.filter(F.transform(F.from_json(raw, "array<string>"), one), lambda r: r.isNotNull()))


def explode_triples(extractions: DataFrame) -> DataFrame:
    """(chunk_id, pos, head, relation, tail) of all good records."""
    e = extractions.where(~F.coalesce("failed", F.lit(False))).select("chunk_id", F.posexplode("triples").alias("pos", "t"))
    return e.select("chunk_id", "pos", "t.head", "t.relation", "t.tail")
