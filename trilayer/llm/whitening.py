"""Whitening of embeddings on distributed block matrices.

Rows are centred exactly and indexed, and become blocks of a few megabytes; the
transpose times the matrix gives the scatter, whose eigenvectors are found
locally (it is as large as the dimension squared), and a second product projects
the rows.  The product over the rows is split, so that a task multiplies a few
blocks and only partial scatters meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trilayer.llm._spark import cut

#: Bytes of a block, and how many blocks one task multiplies.
BLOCK_BYTES, TASK_BLOCKS = 2 << 20, 8
#: Components whose variance is a smaller share of the largest are rounding, not data.
LEAST_SHARE = 1e-10


def usable(vector: Column) -> Column:
    """Not null, not empty, every entry a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def quantised(vector: Column) -> Column:
    """Entries c as longs floor(64 c) + 1000000."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * 64) + 1_000_000)


def _indexed(rows: DataFrame) -> DataFrame:
    """``rows`` (materialised, with ``_at`` from monotonically_increasing_id) with ``_index`` from 0, without gaps."""
    part = F.shiftright("_at", 33)
    sizes = cut(rows.groupBy(part.alias("_part")).count())  # a row a partition
    before = F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(starts), part == F.col("_part")).select(*[c for c in rows.columns if c != "_at"], (F.col("_start") + place).alias("_index"))


def _times(a: BlockMatrix, b: BlockMatrix, parts: int) -> BlockMatrix:
    """a b, the sum over the inner blocks split in ``parts`` (Spark's multiply, whose Python form lacks that argument)."""
    product = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(product, a.rowsPerBlock, b.colsPerBlock)


def _second_moment(m: BlockMatrix, n: int) -> np.ndarray:
    """m'm / n, a local matrix of its columns' number."""
    parts = max(1, -(-m.numRowBlocks // TASK_BLOCKS))
    v = _times(m.transpose(), m, parts).toLocalMatrix().toArray() / n
    return (v + v.T) / 2


def _rows(blocks: Iterator, height: int) -> Iterator[tuple[int, list[float]]]:
    for (i, _), block in blocks:
        for r, row in enumerate(block.toArray().tolist()):
            yield i * height + r, row


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each usable row and component.

    Entries are quantised to longs x.  ``n`` counts the usable rows, S are their
    sums, ``deviation`` is the sum over the dimensions of (n x - S)^2, exact, as
    decimal(38,0).  Components are unit eigenvectors of the covariance (divisor
    n), numbered from 1 by falling eigenvalue e, at most ``components``;
    ``whitened`` is x - S / n projected on one, over sqrt(e); ``explained`` is e
    over the trace; ``identity_error`` the largest absolute entry of the
    covariance of what was projected, less the identity.

    Null and empty vectors and those with null or non-finite entries are left
    out; so are vectors of another length than the most common one (of equally
    common ones the longer).  Null ids, ties and repeated rows: each row counts
    and is returned.  Components without variance (below 1e-10 of the largest)
    don't exist, so one row, or copies of one, give no rows, as does an empty
    table.  Columns not named are left out, so none can clash.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{vector_col}`").alias("_v")).where(usable(F.col("_v")))
    rows = cut(rows.select("_id", quantised(F.col("_v")).alias("_x"), F.monotonically_increasing_id().alias("_at")))
    sizes = rows.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kinds = {"component": T.IntegerType(), "n": T.LongType(), "deviation": T.DecimalType(38, 0), "whitened": T.DoubleType(), "explained": T.DoubleType(), "identity_error": T.DoubleType()}
    out = T.StructType([T.StructField(id_col, vectors.schema[id_col].dataType), *[T.StructField(c, t) for c, t in kinds.items()]])
    if sizes is None:
        return spark.createDataFrame([], out)
    d = sizes["d"]
    if rows.where(F.size("_x") != d).limit(1).count():
        rows = cut(rows.where(F.size("_x") == d).drop("_at").withColumn("_at", F.monotonically_increasing_id()))
    total = rows.agg(F.count("*").alias("n"), *[F.sum(F.col("_x")[i]).alias(f"s{i}") for i in range(d)]).first()
    n, sums = total["n"], F.array(*[F.lit(total[f"s{i}"]).cast("long") for i in range(d)])

    centred = F.zip_with("_x", sums, lambda x, s: x * F.lit(n).cast("long") - s)
    rows = _indexed(rows).select("_index", "_id", centred.alias("_y"))
    square = lambda y: (y.cast("decimal(19,0)") * y.cast("decimal(19,0)")).cast("decimal(38,0)")
    deviation = F.aggregate("_y", F.lit(0).cast("decimal(38,0)"), lambda s, y: (s + square(y)).cast("decimal(38,0)"))
    rows = cut(rows.select("_index", "_id", deviation.alias("deviation"), F.transform("_y", lambda y: y / F.lit(float(n))).alias("_c")))

    height = max(256, BLOCK_BYTES // (8 * d))
    frame = MLUtils.convertVectorColumnsFromML(rows.select("_index", array_to_vector("_c").alias("v")), "v")
    matrix = IndexedRowMatrix(frame, n, d).toBlockMatrix(height, d)
    v = _second_moment(matrix, n)
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    k = int(min(components, (e > max(e[0], 0.0) * LEAST_SHARE).sum())) if e[0] > 0 else 0
    if not k:
        return spark.createDataFrame([], out)
    weights = axes[:, :k] / np.sqrt(e[:k])
    projection = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(d, k, weights.flatten("F")))], 1), d, k, d, k)
    projected = _times(matrix, projection, 1)
    error = float(np.abs(_second_moment(projected, n) - np.eye(k)).max())

    white = spark.createDataFrame(projected.blocks.mapPartitions(lambda it: _rows(it, height)), "_index long, _w array<double>")
    explained = F.array(*[F.lit(float(x)) for x in e[:k] / np.trace(v)])
    each = rows.select("_index", "_id", "deviation").join(white, "_index").select("_id", "deviation", F.posexplode("_w").alias("_k", "whitened"))
    return each.select(
        F.col("_id").alias(id_col),
        (F.col("_k") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("_k")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
