"""A stored inverted file with product-quantised residuals.

Cells and codebooks are fitted once on a bounded sample and kept; every vector
is indexed with them, upserts and deletions only append.  A vector is listed in
the ``SPILL`` cells nearest to it, a few bytes each, so that a question finds it
though it looks into a quarter of the cells.  Candidates are ranked by their
codes, and a shortlist exactly by the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trilayer.functions.session import materialise
from trilayer.operators.vectors import rows_of, searchable

#: Vectors that the fit may see, bytes of all centres, cells that list a vector, bytes of a code.
SAMPLE, CENTRE_BYTES, SPILL, CODE = 50_000, 32 << 20, 5, 16
#: Entries and questions of one group; larger cells are split.
CELL_ROWS, CELL_QUESTIONS = 50_000, 2_048


def _unit(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of the usable vectors of dimension d."""
    length, flat, ok = rows_of(column)
    at = np.flatnonzero(ok & (length == d))
    first = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
    m = flat[first[at][:, None] + np.arange(d)]
    m /= np.abs(m).max(axis=1, keepdims=True, initial=1e-300)
    return at, m / np.linalg.norm(m, axis=1, keepdims=True)


def _means(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12) -> np.ndarray:
    """k-means of the rows of x; an empty centre takes a row."""
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(steps):
        near = (x @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return c


@dataclass(frozen=True)
class Quantiser:
    """Centres of the cells and, for each part of the dimensions, the residuals' codebook."""

    centres: np.ndarray
    books: np.ndarray  # part, code, dimensions of a part (padded)

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, seed: int = 7) -> Quantiser:
        rng = np.random.default_rng(seed)
        centres = _means(x, cells, rng)
        rest = cls._parts(x - centres[cls._near(x, centres, 1)[:, 0]])
        return cls(centres, np.stack([_means(r, 256, rng) for r in rest]))

    @staticmethod
    def _near(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
        score = x @ centres.T - (centres * centres).sum(axis=1) / 2
        n = min(n, score.shape[1])
        return np.argsort(-score, axis=1, kind="stable")[:, :n]

    @staticmethod
    def _parts(x: np.ndarray) -> np.ndarray:
        """(part, row, dimensions): dimensions cut into CODE parts, the last padded with zeros."""
        width = -(-x.shape[1] // CODE)
        padded = np.zeros((len(x), width * CODE))
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), CODE, width).transpose(1, 0, 2)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) entries flattened as cells of each row, and their codes."""
        cells = self._near(x, self.centres, SPILL)
        rest = self._parts((x[:, None, :] - self.centres[cells]).reshape(-1, x.shape[1]))
        codes = np.stack([(r @ b.T - (b * b).sum(axis=1) / 2).argmax(axis=1) for r, b in zip(rest, self.books, strict=True)], axis=1)
        return cells, codes.astype(np.uint8)

    def scores(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Estimated inner products of questions and the entries of a cell."""
        out = np.repeat((q @ self.centres[cell])[:, None], len(codes), axis=1)
        for part, (x, book) in enumerate(zip(self._parts(q), self.books, strict=True)):
            out += (x @ book.T)[:, codes[:, part]]
        return out


class VectorIndex:
    """The index below ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, vectors: DataFrame, path: str, cells: int | None = None) -> VectorIndex:
        """Fit on at most SAMPLE of ``vectors`` (id, embedding), the first by hash, and index all of them.

        The dimension is the most common one; vectors that are null, zero or
        hold null or non-finite entries, or of another dimension, are left out.
        About the root of their number of cells, as far as CENTRE_BYTES allow.
        """
        v = vectors.where(searchable(F.col("embedding")))
        d = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        if d is None:
            raise ValueError("no vector to fit an index on")
        v, d = v.where(F.size("embedding") == d["d"]), d["d"]
        n = v.count()
        cells = cells or max(1, min(round(n**0.5), CENTRE_BYTES // (8 * d)))
        seen = v.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow().column(0)
        fitted = Quantiser.fit(_unit(seen, d)[1], cells)
        row = (d, cells, fitted.centres.tobytes(), fitted.books.tobytes())
        vectors.sparkSession.createDataFrame([row], "d int, cells int, centres binary, books binary").coalesce(1).write.parquet(f"{path}/model")
        index = cls(vectors.sparkSession, path)
        index.upsert(vectors, 0)
        return index

    @cached_property
    def model(self) -> Quantiser:
        r = self.spark.read.parquet(f"{self.path}/model").first()
        return Quantiser(np.frombuffer(r["centres"]).reshape(r["cells"], r["d"]), np.frombuffer(r["books"]).reshape(CODE, 256, -1))

    def upsert(self, vectors: DataFrame, version: int) -> None:
        """Add or replace (id, embedding); versions rise, and one that is repeated replaces what it wrote."""
        quantiser, d = self.model, self.model.centres.shape[1]
        kind = vectors.schema["id"].dataType
        entry = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("id", kind), T.StructField("code", T.BinaryType())])

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, x = _unit(b.column(1), d)
                if len(at):
                    cells, codes = quantiser.encode(x)
                    ids = b.column(0).take(pa.array(np.repeat(at, cells.shape[1])))
                    yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), ids, pa.array([c.tobytes() for c in codes], pa.binary())], names=["cell", "id", "code"])

        # of several rows of an id one counts, whichever way it is read
        one = vectors.groupBy("id").agg(F.max("embedding").alias("embedding")) if version else vectors.dropDuplicates(["id"])
        one = materialise(one.select("id", F.col("embedding").cast("array<double>").alias("embedding")))
        one.select("id", "embedding").mapInArrow(encode, entry).write.mode("overwrite").parquet(f"{self.path}/entries/version={version}")
        one.write.mode("overwrite").parquet(f"{self.path}/vectors/version={version}")

    def delete(self, ids: DataFrame, version: int) -> None:
        kind = self.spark.read.parquet(f"{self.path}/vectors").schema["embedding"].dataType
        gone = ids.select("id").distinct().withColumn("embedding", F.lit(None).cast(kind))
        gone.write.mode("overwrite").parquet(f"{self.path}/vectors/version={version}")

    def live(self) -> DataFrame:
        """(id, version, embedding) as they are now."""
        v = self.spark.read.parquet(f"{self.path}/vectors")
        last = v.groupBy("id").agg(F.max(F.struct("version", "embedding")).alias("v"))
        return last.where("v.embedding is not null").select("id", "v.version", "v.embedding")

    def search(self, queries: DataFrame, k: int, nprobe: int | None = None, shortlist: int | None = None) -> DataFrame:
        """(query_id, id, score, rank): about the k nearest by cosine, from the ``nprobe`` nearest cells (a quarter of them if not given).

        The ``shortlist`` (20 k) best by code are scored exactly.  A cell with
        more than CELL_ROWS entries is looked at in parts, and so are the
        questions beyond CELL_QUESTIONS, so no group grows with either.
        """
        quantiser, (cells, d) = self.model, self.model.centres.shape
        nprobe, shortlist = nprobe or max(1, cells // 4), shortlist or 20 * k
        qkind, kind = queries.schema["query_id"].dataType, self.spark.read.parquet(f"{self.path}/vectors").schema["id"].dataType
        asked_schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("query_id", qkind), T.StructField("q", T.BinaryType())])

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, x = _unit(b.column(1), d)
                if len(at):
                    near = np.argsort(-(x @ quantiser.centres.T), axis=1, kind="stable")[:, :nprobe]
                    raw = [r.tobytes() for r in x.astype(np.float32)]
                    ids = b.column(0).take(pa.array(np.repeat(at, near.shape[1])))
                    yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), ids, pa.array([raw[i] for i in np.repeat(np.arange(len(at)), near.shape[1])], pa.binary())], names=["cell", "query_id", "q"])

        live = materialise(self.live())
        entries = self.spark.read.parquet(f"{self.path}/entries").join(live.select("id", "version"), ["id", "version"], "left_semi")
        entries = materialise(entries.select("cell", "id", "code"))
        size = entries.groupBy("cell").agg(F.count("*").alias("n"))
        asked = materialise(queries.select("query_id", "embedding").mapInArrow(ask, asked_schema))
        count = asked.groupBy("cell").agg(F.count("*").alias("m"))
        parts = size.join(count, "cell").select("cell", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("rows"), F.ceil(F.col("m") / CELL_QUESTIONS).cast("int").alias("asks"))
        parts = F.broadcast(materialise(parts))  # a row a cell
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        e = entries.join(parts, "cell").select("cell", "id", "code", F.pmod(F.xxhash64("id"), F.col("rows")).cast("int").alias("row"), every("asks").alias("ask"))
        a = asked.join(parts, "cell").select("cell", "query_id", "q", F.pmod(F.xxhash64("query_id", "q"), F.col("asks")).cast("int").alias("ask"), every("rows").alias("row"))
        hit = T.StructType([T.StructField("query_id", qkind), T.StructField("id", kind), T.StructField("s", T.DoubleType())])
        each = max(k, shortlist // 4)

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return pa.table([pa.array([], f.type) for f in (right.schema.field("query_id"), left.schema.field("id"), pa.field("s", pa.float64()))], names=["query_id", "id", "s"])
            codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(-1, CODE)
            q = np.frombuffer(b"".join(right.column("q").to_pylist()), np.float32).reshape(-1, d).astype(np.float64)
            s = quantiser.scores(q, left.column("cell")[0].as_py(), codes)
            n = min(each, s.shape[1])
            top = np.argpartition(-s, n - 1, axis=1)[:, :n]
            rows = np.repeat(np.arange(len(q)), n)
            return pa.table([right.column("query_id").take(pa.array(rows)), left.column("id").take(pa.array(top.ravel())), pa.array(s[rows, top.ravel()])], names=["query_id", "id", "s"])

        keys = ["cell", "row", "ask"]
        found = e.groupBy(*keys).cogroup(a.groupBy(*keys)).applyInArrow(lambda x, y: meet(x, y), hit)
        found = found.groupBy("query_id", "id").agg(F.max("s").alias("s"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("s").desc(), "id"))
        found = found.withColumn("place", place).where(F.col("place") <= shortlist).select("query_id", "id")
        pairs = found.join(live.select("id", "embedding"), "id").join(queries.select("query_id", F.col("embedding").cast("array<double>").alias("asked")), "query_id")
        scored = T.StructType([T.StructField("query_id", qkind), T.StructField("id", kind), T.StructField("score", T.DoubleType())])

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, x = _unit(b.column(2), d)
                _, y = _unit(b.column(3), d)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((x * y).sum(axis=1).round(12))], names=["query_id", "id", "score"])

        out = pairs.select("query_id", "id", "embedding", "asked").mapInArrow(exact, scored)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
        return out.withColumn("rank", rank).where(F.col("rank") <= k)
