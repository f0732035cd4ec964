"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors are turned by a fixed random rotation and split into a few blocks
of dimensions.  Two vectors whose cosine meets the threshold lie within a
squared distance of 2 - 2 * threshold, so in at least one block they lie within
that block's proportional share.  Each block is joined by ranges of its first
coordinate (own range against itself and the next), candidates within the
block's budget are verified exactly in double precision, and a pair counts in the
first block that holds it.  Large ranges are compared in tiles of bounded size.
Tiles give link counts and forests, never pairs.  Equal vectors are one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trilayer.llm._forest import local_roots
from trilayer.llm._spark import components, cut

BLOCKS, TILE = 4, 4096
_SLACK, _SLAB = 1e-9, 50_000


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(20_11).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_edges(dim: int, blocks: int) -> list[tuple[int, int]]:
    edge = np.linspace(0, dim, min(blocks, dim) + 1).astype(int)
    return list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))


def _turned(raw: np.ndarray) -> np.ndarray:
    return (raw / np.linalg.norm(raw, axis=1, keepdims=True)) @ rotation(raw.shape[1])


def _ranges(batches: Iterator[pa.RecordBatch], budget: float, blocks: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dim = batch.column("dim").to_numpy()
        rid, vector = batch.column("rid").to_numpy(), batch.column("vector")
        for d in sorted(set(dim.tolist())):
            at = np.flatnonzero(dim == d)
            x = _turned(np.array(vector.take(pa.array(at)).to_pylist(), np.float64))
            for b, (lo, hi) in enumerate(block_edges(d, blocks)):
                width = np.sqrt(budget * (hi - lo) / d + 2 * _SLACK) * (1 + 1e-9)
                place = np.floor(x[:, lo] / width).astype(np.int64)
                for side in (0, 1):
                    yield pa.RecordBatch.from_arrays([pa.array(rid[at]), pa.array(np.full(len(at), b, np.int32)), pa.array(place + side), pa.array(np.full(len(at), side, np.int32))], names=["rid", "block", "place", "side"])


def _tile(rid: np.ndarray, copies: np.ndarray, side: np.ndarray, chunk: np.ndarray, raw: np.ndarray, block: int, pair: tuple[int, int], threshold: float, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(linked rows, their smallest connected row, links of each row) of one tile."""
    dim = raw.shape[1]
    edges, x, norm = block_edges(dim, blocks), _turned(raw), np.sqrt((raw * raw).sum(axis=1))
    budget = 2 - 2 * threshold
    left, right = np.flatnonzero(chunk == pair[0]), np.flatnonzero(chunk == pair[1])
    lo, hi = edges[block]
    links, p_all, q_all = np.zeros(len(rid), np.int64), [], []
    own = x[:, lo:hi]
    square = (own * own).sum(axis=1)
    for k in range(0, len(left), 256):
        rows = left[k : k + 256]
        near = square[rows][:, None] + square[right][None, :] - 2 * own[rows] @ own[right].T <= budget * (hi - lo) / dim + 2 * _SLACK
        near &= (side[rows][:, None] + side[right][None, :]) < 2  # a row that looks on is met in its own range
        if pair[0] == pair[1]:
            near &= rows[:, None] < right[None, :]
        a, b = np.nonzero(near)
        a, b = rows[a], right[b]
        for s in range(0, len(a), _SLAB):
            p, q = a[s : s + _SLAB], b[s : s + _SLAB]
            ok = (raw[p] * raw[q]).sum(axis=1) / (norm[p] * norm[q]) >= threshold
            ok &= rid[p] != rid[q]
            p, q = p[ok], q[ok]
            for e, (e0, e1) in enumerate(edges[: block + 1]):  # counts in the first block whose budget it keeps
                away = np.zeros(len(p))
                for c in range(e0, e1):
                    away += (x[p, c] - x[q, c]) ** 2
                ok = (away <= budget * (e1 - e0) / dim + _SLACK) == (e == block)
                p, q = p[ok], q[ok]
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            p_all.append(p)
            q_all.append(q)
    if not p_all or not (links > 0).any():
        none = np.zeros(0, np.int64)
        return none, none, none
    root = local_roots(len(rid), np.concatenate(p_all), np.concatenate(q_all))
    least = rid.copy()
    np.minimum.at(least, root, rid)
    at = np.flatnonzero(links)
    return rid[at], least[root[at]], links[at]


def _join(batches: Iterator[pa.RecordBatch], threshold: float, blocks: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile: links and forests of each tile."""
    key, parts = None, []

    def flush() -> pa.RecordBatch | None:
        if sum(len(p[0]) for p in parts) < 2:
            return None
        rid, copies, side, chunk, raw = (np.concatenate(x) for x in zip(*parts, strict=True))
        a, root, n = _tile(rid, copies, side, chunk, raw, key[2], key[4:], threshold, blocks)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(root), pa.array(n)], names=["a", "b", "n"]) if len(a) else None

    for batch in batches:
        keys = list(zip(*[batch.column(c).to_pylist() for c in ("label", "dim", "block", "place", "i", "j")], strict=True))
        cols = [batch.column(c).to_numpy() for c in ("rid", "copies", "side", "chunk")]
        edge = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if a == b:
                continue
            if keys[a] != key:
                if (made := flush()) is not None:
                    yield made
                key, parts = keys[a], []
            raw = batch.column("vector").slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            parts.append((*[c[a:b] for c in cols], raw.reshape(b - a, key[1])))
    if (made := flush()) is not None:
        yield made


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite and not null, not all zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def join(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, blocks: int = BLOCKS) -> DataFrame:
    """Links and components of ``vectors``, one row each: (id, n_links, component_id, kept).

    Two rows link if their labels are equal and not null, their vectors have as
    many dimensions, and their cosine is ``threshold`` or more in double
    precision.  n_links counts the other rows linked directly, component_id is
    the smallest id reachable, kept marks the row whose id that is.

    Vectors that are null, empty, zero or hold null or non-finite components,
    and rows without a label, link with nothing.  Repeated rows are rows of
    their own and link with each other.  Null ids: the smallest other id names
    the component, null if there is none.  Empty table: no rows.  Columns not
    named are left out, so none can clash.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    rows = rows.withColumn("ok", usable(F.col("vector")) & F.col("label").isNotNull())
    reps = rows.where("ok").groupBy("label", "vector").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    reps = cut(reps.select("*", F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("rid")))
    budget = 2 - 2 * threshold
    met = reps.select("rid", "dim", "vector").mapInArrow(lambda it: _ranges(it, budget, blocks), "rid long, block int, place long, side int")
    met = met.join(reps, "rid")
    group = ["label", "dim", "block", "place"]
    sizes = met.groupBy(*group).agg(F.count("*").alias("rows")).where("rows > 1").select(*group, F.ceil(F.col("rows") / TILE).cast("int").alias("parts"))
    tiles = met.join(sizes, group).withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
    tiles = tiles.select("*", F.explode(F.expr("sequence(0, parts - 1)")).alias("other"))
    tiles = tiles.select(*group, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "rid", "copies", "side", "chunk", "vector")
    tile = [*group, "i", "j"]
    seen = tiles.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(lambda it: _join(it, threshold, blocks), "a long, b long, n long")
    seen = cut(seen)
    links = seen.groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("linked"))
    roots = components(seen.select("a", "b")).withColumnRenamed("id", "rid")
    classes = reps.join(roots, "rid", "left").join(links, "rid", "left")
    classes = cut(classes.select("label", "vector", "least", "copies", F.coalesce("root", "rid").alias("root"), F.coalesce("linked", F.lit(0)).alias("linked")))
    names = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(names, "root").select("label", "vector", "component_id", (F.col("copies") - 1 + F.col("linked")).alias("n_links"))
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = rows.where("ok").join(classes, ["label", "vector"]).select("id", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
