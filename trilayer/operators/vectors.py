"""Vectors: exact and approximate search, hash embedding, maintenance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trilayer.functions.session import materialise
from trilayer.operators.keyed import delete_ids, upsert

#: Bytes of a block, of the question blocks that may be broadcast, and of the vectors of one cell beyond that.
BLOCK_BYTES, QUERY_BYTES, CELL_BYTES = 1 << 20, 32 << 20, 256 << 20
#: Rows that a task's heaps may hold before it hands them on.
HEAP_ROWS = 2_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; a zero vector gives null."""
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def searchable(vector: Column) -> Column:
    """Not null, without null or non-finite components, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, flat values, usable) of a list column, as ``searchable`` judges each row; a null list has length -1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null entry is not a number
    row = np.repeat(np.arange(len(length)), np.maximum(length, 0))
    bad = np.bincount(row, weights=~np.isfinite(flat), minlength=len(length))
    some = np.bincount(row, weights=flat != 0, minlength=len(length))
    return length, flat, (length > 0) & (bad == 0) & (some > 0)


def _pack(batches: Iterator[pa.RecordBatch], block_bytes: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Usable vectors at unit length in blocks of equal dimension: (dim, ids, matrix)."""
    for batch in batches:
        ids, (length, flat, ok) = batch.column(0), rows_of(batch.column(1))
        first = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
        for d in np.unique(length[ok]).tolist():
            rows = np.flatnonzero(ok & (length == d))
            step = max(1, block_bytes // (8 * d))
            for part in (rows[a : a + step] for a in range(0, len(rows), step)):
                m = flat[first[part][:, None] + np.arange(d)]
                m /= np.abs(m).max(axis=1, keepdims=True)  # squares of any size stay finite
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                own = ids.take(pa.array(part))
                lists = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), own)
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), lists, pa.array([m.tobytes()], pa.binary())], names=names)


class _Heaps:
    """The k best vectors of each question of some blocks, ties by id; bounded, for it is emptied beyond a size."""

    def __init__(self, k: int, least: float | None):
        self.k, self.least, self.held, self.rows = k, -np.inf if least is None else least, {}, 0

    def add(self, block: int, questions: pa.Array, q: np.ndarray, ids: pa.Array, v: np.ndarray) -> None:
        score = (q @ v.T).round(12)
        top, kth = self.held.get(block, (None, np.full(len(q), self.least)))
        if score.shape[1] > self.k:  # ties of the k-th score stay, the sort below breaks them by id
            floor = np.maximum(kth, np.partition(score, -self.k, axis=1)[:, -self.k])
        else:
            floor = kth
        qi, vi = np.nonzero(score >= floor[:, None])
        if not len(qi) and top is not None:
            return
        new = pa.table({"q": pa.array(qi.astype(np.int32)), "score": score[qi, vi], "query_id": questions.take(pa.array(qi)), "id": ids.take(pa.array(vi))})
        self.rows += len(new)
        if top is not None:
            self.rows -= len(top) + len(new)
            new = pa.concat_tables([top, new]).combine_chunks()
            self.rows += len(new)
        new = new.take(pc.sort_indices(new, [("q", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start"))
        at = new.column("q").to_numpy()
        place = np.arange(len(at)) - np.searchsorted(at, at)
        self.rows -= int((place >= self.k).sum())
        new = new.filter(pa.array(place < self.k)).combine_chunks()
        last = place[place < self.k] == self.k - 1
        kth = np.full(len(q), self.least)
        kth[new.column("q").to_numpy()[last]] = new.column("score").to_numpy()[last]
        self.held[block] = (new, kth)

    def empty(self) -> Iterator[pa.RecordBatch]:
        for top, _ in self.held.values():
            yield from top.select(["query_id", "id", "score"]).to_batches()
        self.held, self.rows = {}, 0


def _top(batches: Iterator[pa.RecordBatch], k: int, least: float | None) -> Iterator[pa.RecordBatch]:
    """Rows (block, dim, questions, matrix, ids, matrix) to the k best of each question."""
    heaps = _Heaps(k, least)
    for batch in batches:
        for i in range(batch.num_rows):
            block, dim, questions, q, ids, v = (batch.column(c) for c in range(6))
            matrix = lambda c: np.frombuffer(c[i].as_buffer(), np.float64).reshape(-1, dim[i].as_py())  # noqa: B023, E731
            heaps.add(block[i].as_py(), questions[i].values, matrix(q), ids[i].values, matrix(v))
            if heaps.rows > HEAP_ROWS:
                yield from heaps.empty()
    yield from heaps.empty()


def _blocks(df: DataFrame, name: str, block_bytes: int) -> DataFrame:
    kind = df.schema[name].dataType
    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("m", T.BinaryType())])
    return df.select(name, "embedding").mapInArrow(lambda it: _pack(it, block_bytes, ["dim", "ids", "m"]), schema)


def knn(queries: DataFrame, vectors: DataFrame, k: int, min_score: float | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k nearest vectors of each question by cosine, ties by id.

    Both sides are packed where they lie into matrices of about a megabyte; a
    block of questions meets each block of vectors once, and a task keeps k
    rows a question, so neither the product nor a row of each block is shuffled.
    The vectors are scanned once whatever the number of questions.  Blocks of
    questions whose measured size allows it are broadcast; more of them are
    dealt to cells of the vectors by a shuffle.

    Vectors and questions that are null, zero or hold null or non-finite
    components have no neighbours and are none; neither are vectors of another
    dimension than the question's.  ``min_score`` leaves out lower scores.
    """
    asked = materialise(_blocks(queries, "query_id", BLOCK_BYTES).withColumn("block", F.monotonically_increasing_id()))
    size = asked.agg(F.sum(F.octet_length("m") + 32 * F.size("ids"))).first()[0] or 0
    v = _blocks(vectors, "id", BLOCK_BYTES).select(F.col("dim").alias("vdim"), F.col("ids").alias("vids"), F.col("m").alias("vm"))
    if size <= QUERY_BYTES:
        pairs = v.join(F.broadcast(asked), F.col("vdim") == F.col("dim"))
    else:
        dims = vectors.agg(F.sum(F.greatest(F.size("embedding"), F.lit(0)))).first()[0] or 0
        cells = max(1, -(-8 * dims // CELL_BYTES))
        v = v.withColumn("vcell", F.pmod(F.xxhash64("vm"), F.lit(cells)))
        asked = asked.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
        pairs = v.join(asked.hint("merge"), (F.col("vdim") == F.col("dim")) & (F.col("vcell") == F.col("cell")))
    hit = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", vectors.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    hits = pairs.select("block", "dim", "ids", "m", "vids", "vm").mapInArrow(lambda it: _top(it, k, min_score), hit)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def knn_ivf(queries: DataFrame, vectors: DataFrame, k: int, cells: int = 32, nprobe: int = 8, sample: int = 20_000, seed: int = 7) -> DataFrame:
    """Approximate search: cells fitted on a bounded sample, every vector indexed, ``nprobe`` cells searched.

    Cells are assigned where the vectors lie and joined by number; within a
    cell the search is exact.  Vectors that ``searchable`` refuses are left out.
    """
    queries, vectors = (df.where(searchable(F.col("embedding"))) for df in (queries, vectors))
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = lambda df: df.withColumn("unit", F.expr("transform(embedding, x -> double(x) / sqrt(aggregate(embedding, 0D, (s, y) -> s + double(y) * y)))"))
    fit = unit(vectors.orderBy(F.xxhash64("id")).limit(sample)).select(array_to_vector("unit").alias("features"))
    centres = [c.tolist() for c in KMeans(k=cells, seed=seed, maxIter=10).fit(fit).clusterCenters()]
    near = F.array_sort(F.array(*[F.struct((-dot(F.col("unit"), F.array(*[F.lit(x) for x in c]))).alias("d"), F.lit(n).alias("cell")) for n, c in enumerate(centres)]))
    v = unit(vectors).select("id", F.col("unit").alias("v"), near[0]["cell"].alias("cell"))
    q = unit(queries).select("query_id", F.col("unit").alias("q"), F.explode(F.slice(near, 1, nprobe)).alias("p")).select("query_id", "q", "p.cell")
    hits = q.join(v, "cell").select("query_id", "id", dot(F.col("q"), F.col("v")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def _bags(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Word lists to unit vectors of bucket counts; each distinct word of a batch is hashed once."""
    for batch in batches:
        lists = batch.column(1)
        count = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        bucket = np.array([hashlib.md5(w.encode(), usedforsecurity=False).digest()[0] % dim for w in coded.dictionary.to_pylist()], np.int64)
        words = bucket[coded.indices.to_numpy()] if len(bucket) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(count)), count)
        c = np.bincount(row * dim + words, minlength=len(count) * dim).reshape(-1, dim).astype(np.float64)
        c[count == 0, 0] = 1.0
        c /= np.sqrt((c * c).sum(axis=1, keepdims=True))
        offsets = pa.array(np.arange(len(count) + 1, dtype=np.int32) * dim)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(c.ravel()))], names=["id", "embedding"])


def hash_embed(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """(id, embedding): bag of ``[a-z0-9]+`` words by the first md5 byte, unit length; wordless text: first axis."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    return df.select(F.col(id_col).alias("id"), words.alias("w")).mapInArrow(lambda it: _bags(it, dim), schema)


def upsert_vectors(vectors: DataFrame, changes: DataFrame, version: str = "version") -> DataFrame:
    """Add or replace vectors; one without an embedding is an error."""
    ok = F.when(F.col("embedding").isNull(), F.raise_error(F.lit("a vector needs an embedding"))).otherwise(F.col("embedding"))
    return upsert(vectors.withColumn(version, F.lit(0)), changes.withColumn("embedding", ok), "id", version).drop(version)


def delete_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return delete_ids(vectors, ids, "id")


def dimension_report(vectors: DataFrame, dim: int) -> DataFrame:
    """(vectors, wrong): how many don't have the configured dimension."""
    return vectors.agg(F.count("*").alias("vectors"), F.count_if(F.size("embedding") != dim).alias("wrong"))


def assert_dim(vectors: DataFrame, dim: int) -> None:
    if dimension_report(vectors, dim).first()["wrong"]:
        raise ValueError(f"stored vectors don't all have {dim} dimensions")


def embed_changes(changes: DataFrame, texts: DataFrame, fn, vectors: DataFrame) -> DataFrame:  # noqa: ANN001
    """Embed only added ids (id, change), drop orphans, keep the rest."""
    added = changes.where("change = 'added'").join(texts, "id").select("id", "text")
    new = added.mapInPandas(lambda it: (fn(b) for b in it), "id string, embedding array<double>")
    kept = vectors.join(changes.where("change = 'kept'").select("id"), "id", "left_semi").select("id", "embedding")
    return kept.unionByName(new)
