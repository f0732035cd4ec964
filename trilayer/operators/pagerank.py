"""Personalised PageRank by pushing residuals between blocks of nodes.

The scores of a question solve x = s + d P'x.  Kept are an estimate x, its
residual r = s + d P'x - x and the last change: a round changes x where the
residual is large enough, takes that from r and sends d P' times it to the
neighbours' residuals, which stay exact whatever is left out.  The error in the
sum of absolute differences is at most |r| / (1 - d), so the rounds end when
that is below the bound asked for.  Each change also carries a share of the one
before (second-order Richardson): on a symmetrised graph the residual then falls
by about .27 a round for d = .5, where plain pushing halves it.

Nodes are dealt to blocks of about a million edges.  A block's edges are
packed once and stay where they are; between rounds only blocks of x, r and sums
combined by receiver move.  A hub's edges are dealt to replicas in several
blocks; what is sent to the hub goes to each of them, and as they add it up in
the same order, all of them know its residual.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trilayer.functions.session import materialise

#: Edges of a block, edges of a node from which it is a hub, questions pushed at once, rounds between looks at the residual.
BLOCK_EDGES, HUB, QUESTIONS, ROUNDS = 1 << 20, 1 << 19, 32, 3
#: Blocks up to which each hash partition is given as many; more of them fall evenly enough.
EVEN_BLOCKS = 1024
#: Rounds after which a residual that hasn't fallen below the bound is an error.
MOST_ROUNDS = 300

_PACKED = "block long, src binary, dst binary, p binary, degree binary, copy binary, dst_block binary, dst_local binary, dst_copy binary"
_STATE = "block long, kind int, a binary, b binary, c binary, left array<double>, pushed long"


@dataclass(frozen=True)
class BlockGraph:
    """``nodes`` (node_id, block, local) and ``edges``, packed by block; can be kept for any number of questions."""

    nodes: DataFrame
    edges: DataFrame
    n_edges: int
    width: int


def _pack(group: pa.Table) -> pa.Table:
    """The edges of one block as arrays: parallel ones summed, receivers once each in the order of their blocks."""
    col = lambda c: group.column(c).to_numpy()
    to, at = np.unique((col("dblock").astype(np.int64) << 33) | (col("dlocal").astype(np.int64) << 1) | (col("dpart") > 0), return_inverse=True)
    pair, first, which = np.unique((col("slocal").astype(np.int64) << 32) | at, return_index=True, return_inverse=True)
    src = (pair >> 32).astype(np.int32)
    p = np.bincount(which, weights=col("weight")) / col("strength")[first]
    degree, copy = np.zeros(int(src.max()) + 1, np.int64), np.zeros(int(src.max()) + 1, bool)
    degree[src], copy[src] = col("degree")[first], col("spart")[first] > 0
    arrays = (src, (pair & 0xFFFFFFFF).astype(np.int32), p, degree, copy, to >> 33, ((to >> 1) & 0xFFFFFFFF).astype(np.int32), (to & 1).astype(bool))
    return pa.table([[group.column("block")[0].as_py()], *[[a.tobytes()] for a in arrays]], names=[c.split()[0] for c in _PACKED.split(", ")])


def _even_names(spark: SparkSession, width: int, each: int) -> Column:
    """Names of ``each`` times ``width`` blocks of which each of ``width`` hash partitions holds as many."""
    held: dict[int, list[int]] = {k: [] for k in range(width)}
    for a in range(0, 1 << 40, 8 * each * width):
        for r in spark.range(a, a + 8 * each * width).select("id", F.pmod(F.hash("id"), F.lit(width)).alias("k")).collect():  # a few times the blocks
            if len(held[r["k"]]) < each:
                held[r["k"]].append(r["id"])
        if all(len(x) == each for x in held.values()):
            break
    return F.array(*[F.lit(x).cast("long") for x in sorted(sum(held.values(), []))])


def _placed(e: DataFrame, places: DataFrame, on: list[str], cols: list[str]) -> DataFrame:
    """``e`` with ``cols`` of the hub's replicas where its end is a hub, else as they are."""
    found = places.select(*on, F.struct(*cols).alias("_new"))
    found = F.broadcast(found) if places.count() <= 100_000 else found
    e = e.join(found, on, "left")
    return e.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in cols else c for c in e.columns if c != "_new"])


def block_graph(edges: DataFrame, block_edges: int | None = None, hub: int | None = None) -> BlockGraph:
    """Number the nodes of (src, dst, weight) by block and pack the edges, once for any number of questions.

    Edges have no direction and need a positive weight; parallel ones add up.  A
    node with more than ``hub`` edges has a replica for each ``hub`` of them.
    """
    block_edges, hub = block_edges or BLOCK_EDGES, hub or HUB
    width = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = edges.where("weight > 0").select("src", "dst", F.col("weight").cast("double").alias("weight"))
    ends = F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))
    nodes = materialise(e.select(F.explode(ends).alias("node_id"), "weight").groupBy("node_id").agg(F.sum("weight").alias("strength"), F.count("*").alias("degree")))
    total = nodes.agg(F.sum("degree")).first()[0] or 0
    each = max(1, -(-total // (block_edges * width)))
    place = F.xxhash64("node_id", "part")
    if each * width <= EVEN_BLOCKS:
        names = _even_names(edges.sparkSession, width, each)
        place = F.get(names, F.pmod(place, F.size(names)).cast("int"))
    else:
        place = F.pmod(place, F.lit(each * width))
    parts = F.greatest(F.lit(1), F.ceil(F.col("degree") / hub)).cast("int")
    nodes = nodes.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    nodes = nodes.withColumn("block", place)
    local = F.row_number().over(Window.partitionBy("block").orderBy("node_id", "part")) - 1
    nodes = materialise(nodes.withColumn("local", local))
    whole = nodes.where("part = 0")

    end = lambda c: whole.select(F.col("node_id").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("block", "local", "parts", "strength", "degree")])
    e = e.join(end("src"), "src").join(end("dst"), "dst")
    way = lambda a, b: F.struct(
        F.col(f"{a}_block").alias("block"), F.col(f"{a}_local").alias("slocal"), F.lit(0).alias("spart"), F.col(f"{b}_block").alias("dblock"), F.col(f"{b}_local").alias("dlocal"), F.lit(0).alias("dpart"),
        "weight", F.col(f"{a}_strength").alias("strength"), F.col(f"{a}_degree").alias("degree"), F.when((F.col(f"{a}_parts") > 1) | (F.col(f"{b}_parts") > 1), F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.col(f"{a}_parts").alias("parts"))).alias("ends"),
    )
    both = F.when(F.col("src") == F.col("dst"), F.array(way("src", "dst"))).otherwise(F.array(way("src", "dst"), way("dst", "src")))
    e = e.select(F.explode(both).alias("w")).select("w.*")
    copies = nodes.where("parts > 1")
    if not copies.isEmpty():
        # edges of hubs: one replica has each that leads away, all have those that lead to them
        e, plain = materialise(e.where("ends is not null")), e.where("ends is null")
        source = copies.select(F.col("node_id").alias("src"), F.col("part").alias("spart"), "block", F.col("local").alias("slocal"))
        target = copies.select(F.col("node_id").alias("dst"), F.col("part").alias("dpart"), F.col("block").alias("dblock"), F.col("local").alias("dlocal"))
        e = e.withColumn("src", F.col("ends.src")).withColumn("dst", F.col("ends.dst")).withColumn("spart", F.pmod(F.xxhash64("dst"), F.col("ends.parts")).cast("int"))
        e = _placed(_placed(e, source, ["src", "spart"], ["block", "slocal"]), target, ["dst"], ["dpart", "dblock", "dlocal"])
        e = plain.unionByName(e.select(plain.columns))
    e = e.drop("ends")
    packed = materialise(e.repartition(width, "block").groupBy("block").applyInArrow(_pack, _PACKED).repartition(width, "block"))
    return BlockGraph(nodes.select("node_id", "block", "local", "part"), packed, total, width)


def _floats(x: bytes, q: int) -> np.ndarray:
    return np.frombuffer(x, np.float64).reshape(-1, q)


class _Round:
    """One round of one block."""

    def __init__(self, q: int, damping: float, least: float):
        self.q, self.d, self.least = q, damping, least
        self.share = 2 / (1 + math.sqrt(1 - damping * damping))

    def run(self, edges: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(rows):
            self._step(edges.to_pylist()[0] if len(edges) else None, rows, out)
        return pa.Table.from_pylist([dict(zip([c.split()[0] for c in _STATE.split(", ")], r, strict=True)) for r in out], schema=pa.schema([("block", pa.int64()), ("kind", pa.int32()), *[(c, pa.binary()) for c in "abc"], ("left", pa.list_(pa.float64())), ("pushed", pa.int64())]))

    def _step(self, e: dict | None, rows: pa.Table, out: list[tuple]) -> None:
        block, q = rows.column("block")[0].as_py(), self.q
        own = np.frombuffer(e["degree"], np.int64) if e else np.zeros(0, np.int64)
        got, x, r, last = [], np.zeros((0, q)), np.zeros((0, q)), np.zeros((0, q))
        for kind, a, b, c in zip(*[rows.column(n).to_pylist() for n in ("kind", "a", "b", "c")], strict=True):
            if kind == 0:
                x, r, last = _floats(a, q), _floats(b, q), _floats(c, q)
            else:
                got.append((int.from_bytes(c, "little"), np.frombuffer(a, np.int32), _floats(b, q)))
        m = max([len(x), len(own), *[int(i.max(initial=-1)) + 1 for _, i, _ in got]])
        grown = lambda v: np.concatenate([v, np.zeros((m - len(v), *v.shape[1:]), v.dtype)])
        x, r, last, degree = grown(x), grown(r), grown(last), grown(own)
        for _, i, v in sorted(got, key=lambda g: g[0]):  # by sender: replicas add in one order
            r[i] += v  # a message names a node once
        copy = grown(np.frombuffer(e["copy"], bool)) if e else np.zeros(m, bool)

        moves = np.abs(r).max(axis=1) > self.least * degree
        change = np.where(moves[:, None], self.share * r + (self.share - 1) * last, 0)
        x, r = x + change, r - change
        out.append((block, 0, x.tobytes(), r.tobytes(), change.tobytes(), np.abs(r[~copy]).sum(axis=0).tolist(), int(moves.sum())))
        if e and moves.any():
            self._send(block, e, change, moves, out)

    def _send(self, sender: int, e: dict, change: np.ndarray, moves: np.ndarray, out: list[tuple]) -> None:
        """d P' times the change, one row for each block that receives any of it."""
        src, to, p = np.frombuffer(e["src"], np.int32), np.frombuffer(e["dst"], np.int32), np.frombuffer(e["p"], np.float64)
        block, local, copy = np.frombuffer(e["dst_block"], np.int64), np.frombuffer(e["dst_local"], np.int32), np.frombuffer(e["dst_copy"], bool)
        if not moves.all():
            on = moves[src]
            src, to, p = src[on], to[on], p[on]
        sums = np.stack([np.bincount(to, weights=p * change[src, k], minlength=len(block)) for k in range(self.q)], axis=1) * self.d
        some = np.flatnonzero((sums != 0).any(axis=1))
        name = sender.to_bytes(8, "little")
        for part in np.split(some, np.flatnonzero(np.diff(block[some])) + 1):
            if len(part):
                out.append((int(block[part[0]]), 1, local[part].tobytes(), sums[part].tobytes(), name, np.abs(sums[part][~copy[part]]).sum(axis=0).tolist(), 0))


def _start(q: int):  # noqa: ANN202
    def pack(group: pa.Table) -> pa.Table:
        at, slot = group.column("local").to_numpy(), group.column("slot").to_numpy()
        r = np.zeros((int(at.max()) + 1, q))
        np.add.at(r, (at, slot), group.column("mass").to_numpy())
        zero = np.zeros_like(r).tobytes()
        return pa.table([[group.column("block")[0].as_py()], pa.array([0], pa.int32()), [zero], [r.tobytes()], [zero], [np.abs(r).sum(axis=0).tolist()], [0]], names=[c.split()[0] for c in _STATE.split(", ")])

    return pack


def _unpack(batches: Iterator[pa.RecordBatch], q: int) -> Iterator[pa.RecordBatch]:
    """(block, local, slot, mass) of what has mass; a message's sums count at their node."""
    for b in batches:
        for block, kind, a, c in zip(*[b.column(n).to_pylist() for n in ("block", "kind", "a", "b")], strict=True):
            if kind == 0:
                v = _floats(a, q) + _floats(c, q)
                i, k = np.nonzero(v)
                local = i
            else:
                v = _floats(c, q)
                i, k = np.nonzero(v)
                local = np.frombuffer(a, np.int32)[i]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), block, np.int64)), pa.array(local.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(v[i, k])], names=["block", "local", "slot", "mass"])


def push(reset: DataFrame, graph: BlockGraph, damping: float = 0.5, bound: float = 1e-6) -> DataFrame:
    """Personalised PageRank of all questions: (query_id, node_id, mass) of nodes with mass.

    ``reset`` (query_id, node_id, mass) sums to one a question.  Returned is x of
    x = (1 - d) reset + d (P'x + lone reset), where ``lone`` is the mass on nodes
    that have no edges; of each question the absolute differences from the
    exact x sum to ``bound`` at most.  Questions are pushed ``QUESTIONS`` at a time.
    """
    r = materialise(reset.where("mass > 0").select("query_id", "node_id", "mass"))
    linked = materialise(r.join(graph.nodes, "node_id", "left"))  # a row for each replica
    lone = linked.where("block is null").groupBy("query_id").agg(F.sum("mass").alias("lone"))
    # nodes without edges gain nothing from others: what they hold together follows from the reset alone
    source = linked.join(lone, "query_id", "left").withColumn("lone", F.coalesce("lone", F.lit(0.0)))
    held = (1 - damping) * F.col("lone") / (1 - damping * F.col("lone"))
    source = materialise(source.withColumn("mass", F.col("mass") * ((1 - damping) + damping * held)))
    asked = materialise(materialise(r.select("query_id").distinct()).withColumn("n", F.monotonically_increasing_id()))
    # numbers without gaps: a partition's rows follow each other
    starts = asked.groupBy(F.shiftright("n", 33).alias("part")).agg(F.count("*").alias("rows"))
    first = F.coalesce(F.sum("rows").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("part", first.alias("first"))  # a row a partition
    number = F.col("first") + F.col("n").bitwiseAND(F.lit((1 << 33) - 1))
    asked = materialise(asked.join(F.broadcast(starts), F.shiftright("n", 33) == F.col("part")).select("query_id", F.floor(number / QUESTIONS).alias("batch"), (number % QUESTIONS).cast("int").alias("slot")))
    total, out = asked.count(), source.where("block is null").select("query_id", "node_id", "mass")
    for batch in range(-(-total // QUESTIONS)):
        mine = asked.where(F.col("batch") == batch)
        q = min(QUESTIONS, total - batch * QUESTIONS)
        seeds = source.where("block is not null").join(mine, "query_id").select("block", "local", "slot", "mass")
        state = seeds.groupBy("block").applyInArrow(_start(q), _STATE)
        scores = _settle(state, graph, q, damping, bound)
        scores = scores.mapInArrow(lambda it, q=q: _unpack(it, q), "block long, local int, slot int, mass double")
        scores = scores.groupBy("block", "local", "slot").agg(F.sum("mass").alias("mass")).where("mass > 0")
        out = out.unionByName(scores.join(graph.nodes.where("part = 0"), ["block", "local"]).join(mine, "slot").select("query_id", "node_id", "mass"))
    return out


def _settle(state: DataFrame, graph: BlockGraph, q: int, damping: float, bound: float) -> DataFrame:
    """Rounds until the residual keeps the bound; a few of them make one job."""
    step = _Round(q, damping, bound * (1 - damping) / 2 / max(1, graph.n_edges))
    for _ in range(0, MOST_ROUNDS, ROUNDS):
        for _ in range(ROUNDS):
            state = graph.edges.groupBy("block").cogroup(state.repartition(graph.width, "block").groupBy("block")).applyInArrow(lambda e, rows: step.run(e, rows), _STATE)
        state = materialise(state)
        left = state.select(F.posexplode("left").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).agg(F.max("v")).first()[0] or 0.0
        if left / (1 - damping) <= bound:
            return state
    raise RuntimeError(f"{left / (1 - damping)} after {MOST_ROUNDS} rounds, {bound} wanted")
