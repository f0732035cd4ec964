"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows times row bytes up to which a side may be broadcast.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs on one machine (tests) is one made.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="trilayer-"))
        return context.getCheckpointDir()
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def mounted_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one as a path that workers can open.

    Memory-mapped files need a file system that every executor mounts.
    """
    url = urlparse(shared_dir(spark))
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {url.scheme}://")
    return f"{url.path.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` (already materialised) with a broadcast hint if it is proven small."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def _weight(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return sum((_weight(c[f.name], f.dataType) for f in kind), F.lit(8))
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.NumericType):
            return F.coalesce(F.size(c), F.lit(0)) * 8 + 24
        return F.coalesce(F.aggregate(c, F.lit(24).cast("long"), lambda n, x: n + _weight(x, kind.elementType)), F.lit(24))
    return F.lit(8)


def measured(df: DataFrame) -> DataFrame:
    """``df`` (already materialised) with a broadcast hint if its rows are measured to be small."""
    total = df.agg(F.sum(sum((_weight(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(8)).cast("long"))).first()[0]
    return F.broadcast(df) if (total or 0) <= BROADCAST_BYTES else df


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (id, root) per vertex.

    Root is the smallest vertex of the component.  Alternates the large-star
    and small-star steps, each a grouped minimum (combined before the shuffle)
    and a join; a checkpoint after each round cuts the lineage.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(rounds):
        sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u")
        e = cut(
            star.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", "m"))
            .where("u <> v")
            .distinct()
        )
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("id"), "root").union(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
