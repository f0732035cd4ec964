"""Ranked lexical search as exact inner-product search in sparse ball trees.

A document is a sparse integer vector over the terms that items use, an item is
the 0/1 vector of its terms, and a score is their inner product.  Documents stay
in the partitions they are read in; a task takes them in shards of bounded size,
builds a ball tree over each and searches every item in it best-first.  A node
has a centre and radii: of its ball and, for each term, of its interval around
the centre.  No document below a node scores more than

    q.c + min(|q| R, sum of r_t over the item's terms t)

Radii are rounded up so that this holds for the rounded centre, sums are widened
by what their rounding can lose, and leaves are scored in integers, so the result
is exact.  A sample of the documents gives each item a score that ten documents
reach; shards return nothing below it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trilayer.llm._spark import cut
from trilayer.llm._text import buffers, pieces, spans_of, word_hashes, words

#: Bytes of item text searched in one pass over the documents.
BLOCK_BYTES = 4 << 20
#: Documents and vector entries of one tree, documents of a leaf.
SHARD_ROWS, SHARD_ENTRIES, LEAF = 32_768, 4 << 20, 32
#: Documents (expected) of the sample that gives first thresholds.
SAMPLE = 50_000
_EPS = float(np.finfo(np.float64).eps)


@dataclass
class Vocabulary:
    """Distinct terms of some items, by hash; each item's terms as places in it."""

    hashes: np.ndarray
    data: np.ndarray
    first: np.ndarray
    length: np.ndarray
    alike: int  # most terms of one hash
    items: list[np.ndarray]

    @classmethod
    def of(cls, texts: list[str | None]) -> Vocabulary:
        low, s, e, wf = words(*buffers(pa.array(texts, pa.large_string())))
        h, raw = word_hashes(low, s, e), low.tobytes()
        found = [(int(h[i]), raw[s[i] : e[i]]) for i in range(len(s))]
        terms = sorted(set(found))
        place = {t: i for i, t in enumerate(terms)}
        items = [np.unique(np.array([place[t] for t in found[a:b]], np.int64)) for a, b in zip(wf[:-1].tolist(), wf[1:].tolist(), strict=True)]
        length = np.array([len(t) for _, t in terms], np.int64)
        hashes = np.array([x for x, _ in terms], np.uint64)
        alike = int(np.unique(hashes, return_counts=True)[1].max(initial=0))
        return cls(hashes, np.frombuffer(b"".join(t for _, t in terms), np.uint8), np.cumsum(length) - length, length, alike, items)

    def places(self, low: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, place) of the words that are terms; hashes propose, bytes decide."""
        h = word_hashes(low, s, e)
        at = np.searchsorted(self.hashes, h)
        words_, places = [], []
        for shift in range(self.alike):
            p = at + shift
            w = np.flatnonzero(p < len(self.hashes))
            w = w[self.hashes[p[w]] == h[w]]
            w = w[self.length[p[w]] == (e - s)[w]]
            if len(w):
                n = (e - s)[w]
                same = low[spans_of(s[w], n)] == self.data[spans_of(self.first[p[w]], n)]
                w = w[np.logical_and.reduceat(same, np.cumsum(n) - n)]
            words_.append(w)
            places.append(p[w])
        return np.concatenate([np.zeros(0, np.int64), *words_]), np.concatenate([np.zeros(0, np.int64), *places])


def _vectors(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """(_id, n, terms, counts): number of terms of each document, and those among the vocabulary with their numbers."""
    size = max(1, len(vocabulary.hashes))
    for batch in batches:
        for i, j, data, off in pieces(batch.column(1)):
            low, s, e, wf = words(data, off)
            w, place = vocabulary.places(low, s, e)
            key, count = np.unique((np.searchsorted(wf, w, side="right") - 1) * size + place, return_counts=True)
            border = pa.array(np.searchsorted(key, np.arange(j - i + 1) * size).astype(np.int32))
            lists = [pa.ListArray.from_arrays(border, pa.array(x.astype(np.int32))) for x in (key % size, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(wf).astype(np.int64)), *lists], names=["_id", "n", "terms", "counts"])


def _up(x: np.ndarray) -> np.ndarray:
    """The next larger single-precision numbers."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


class Tree:
    """A ball tree over sparse rows of non-negative integers (below 2^50), each with an entry at least."""

    def __init__(self, first: np.ndarray, terms: np.ndarray, values: np.ndarray, leaf: int = LEAF):
        count = np.diff(first)
        self.left, self.right, self.begin, self.end = [], [], [], []
        order = np.arange(len(count))
        self._square = np.add.reduceat(values.astype(np.float64) ** 2, first[:-1])
        self._point = np.zeros(int(terms.max()) + 1)
        stack = [(0, len(order), -1)]
        while stack:
            a, b, parent = stack.pop()
            me = len(self.begin)
            self.begin.append(a), self.end.append(b), self.left.append(-1), self.right.append(-1)
            if parent >= 0:
                side = self.left if self.left[parent] < 0 else self.right
                side[parent] = me
            if b - a > leaf:
                order[a:b] = order[a:b][self._halves(order[a:b], first[:-1], count, terms, values)]
                mid = (a + b) // 2
                stack += [(mid, b, me), (a, mid, me)]
        self.order = order
        at = spans_of(first[:-1][order], count[order])
        self.terms, self.values = terms[at], values[at]
        self.first = np.concatenate(([0], np.cumsum(count[order])))
        self._balls()

    def _halves(self, rows: np.ndarray, first: np.ndarray, count: np.ndarray, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Order of ``rows`` along the line in which they spread most (two power steps from a line between far rows)."""
        n = count[rows]
        at, border = spans_of(first[rows], n), np.cumsum(n) - n
        t, v, line = terms[at], values[at].astype(np.float64), self._point

        def far(i: int) -> np.ndarray:
            own = slice(border[i], border[i] + n[i])
            line[t[own]] = v[own]
            product = np.add.reduceat(v * line[t], border)
            line[t[own]] = 0
            return self._square[rows] - 2 * product + self._square[rows[i]]

        a = far(int(far(0).argmax()))
        along = far(int(a.argmax())) - a
        for _ in range(2):
            along = along - along.mean()
            along /= np.abs(along).max() or 1.0
            np.add.at(line, t, v * np.repeat(along, n))
            along = np.add.reduceat(v * line[t], border)
            line[t] = 0
        return np.argsort(along, kind="stable")

    def _balls(self) -> None:
        """Centres and radii from the leaves up, kept by term; ``self.radius`` is the ball's."""
        nodes = len(self.begin)
        made: list = [None] * nodes
        self.radius = np.zeros(nodes)
        for k in range(nodes - 1, -1, -1):  # children have larger numbers
            own = slice(self.first[self.begin[k]], self.first[self.end[k]])
            if self.left[k] < 0:
                by = np.argsort(self.terms[own], kind="stable")
                t, v = self.terms[own][by], self.values[own][by].astype(np.float64)
                cut_ = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
                everywhere = np.diff(np.append(cut_, len(t))) == self.end[k] - self.begin[k]
                t, most, least = t[cut_], np.maximum.reduceat(v, cut_), np.where(everywhere, np.minimum.reduceat(v, cut_), 0.0)
            else:
                (t1, most1, least1), (t2, most2, least2) = made[self.left[k]], made[self.right[k]]
                t = np.union1d(t1, t2)
                most, least = np.zeros(len(t)), np.zeros(len(t))
                i1, i2 = np.searchsorted(t, t1), np.searchsorted(t, t2)
                most[i1] = most1
                most[i2] = np.maximum(most[i2], most2)
                both = np.intersect1d(i1, i2)
                least[both] = np.minimum(least1[np.searchsorted(t1, t[both])], least2[np.searchsorted(t2, t[both])])
            made[k] = (t, most, least)
            centre = ((most + least) / 2).astype(np.float32).astype(np.float64)
            self.radius[k] = self._reach(k, own, t, centre)
        size = np.array([len(m[0]) for m in made])
        t = np.concatenate([m[0] for m in made])
        most, least = np.concatenate([m[1] for m in made]), np.concatenate([m[2] for m in made])
        by = np.argsort(t, kind="stable")
        self.node = np.repeat(np.arange(nodes), size)[by]
        self.centre = ((most + least) / 2).astype(np.float32)[by]
        c = self.centre.astype(np.float64)
        self.spread = _up(np.maximum(most[by] - c, c - least[by]))
        self.posting, self.posted = np.unique(t[by], return_index=True)
        self.posted = np.append(self.posted, len(t))

    def _reach(self, k: int, own: slice, t: np.ndarray, centre: np.ndarray) -> float:
        """Upper bound of the distance from the centre to any row below node k."""
        v, c = self.values[own].astype(np.float64), centre[np.searchsorted(t, self.terms[own])]
        border = self.first[self.begin[k] : self.end[k]] - own.start
        rest = float(centre @ centre) - np.add.reduceat(c * c, border)
        inside = np.add.reduceat((v - c) ** 2, border)
        # each sum of m squares is off by m eps of its size at most
        lost = 4 * _EPS * (len(t) + 4) * (float(centre @ centre) + inside)
        return float(np.nextafter(math.sqrt(float((np.maximum(rest, 0) + inside + lost).max())) * (1 + 4 * _EPS), np.inf))

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """For each node what no row below it exceeds in the sum over the terms of ``query``."""
        p = np.searchsorted(self.posting, query)
        p = p[p < len(self.posting)]
        p = p[np.isin(self.posting[p], query)]
        at = spans_of(self.posted[p], self.posted[p + 1] - self.posted[p])
        nodes = len(self.begin)
        along = np.bincount(self.node[at], weights=self.centre[at], minlength=nodes)
        spread = np.bincount(self.node[at], weights=self.spread[at], minlength=nodes)
        ball = math.sqrt(len(query)) * (1 + 2 * _EPS) * self.radius
        return (along + np.minimum(ball, spread)) * (1 + 4 * _EPS * (len(query) + 4))

    def best(self, query: np.ndarray, k: int, least: int, tie: np.ndarray, mask: np.ndarray) -> tuple[list[tuple[int, int, int]], int]:
        """The k best rows of at least ``least`` as (-score, tie, row), and the number of leaves scored.

        ``tie`` orders rows of equal score; ``mask`` is a cleared bool array over all terms.
        """
        bound = self.bounds(query).tolist()
        mask[query] = True
        heap, found, leaves = [(-bound[0], 0)], [], 0
        while heap and -heap[0][0] >= least:
            b, node = heapq.heappop(heap)
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    if bound[child] >= least:
                        heapq.heappush(heap, (max(b, -bound[child]), child))
                continue
            leaves += 1
            begin, end = self.begin[node], self.end[node]
            own = slice(self.first[begin], self.first[end])
            score = np.add.reduceat(np.where(mask[self.terms[own]], self.values[own], 0), self.first[begin:end] - own.start)
            rows = np.flatnonzero(score >= least)
            if len(rows):
                at = self.order[begin + rows]
                found = sorted([*found, *zip((-score[rows]).tolist(), tie[at].tolist(), at.tolist(), strict=True)])[:k]
                if len(found) == k:
                    least = max(least, -found[-1][0])
        mask[query] = False
        return found, leaves


def entry_values(n: np.ndarray, counts: np.ndarray, weights: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Vector entries in 64-bit integers: weight times (10^9 tf) div (1000 tf + 8 m), m = 10 + (90 n N) div L."""
    m = 10 + (90 * n * documents) // total
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 8 * m))


@dataclass
class Ranking:
    """What the search of one block of items needs in every task; its size is bounded by the block's."""

    vocabulary: Vocabulary
    weights: np.ndarray
    documents: int
    total: int
    least: np.ndarray

    def search(self, batches: Iterator[pa.RecordBatch], k: int, names: list[str]) -> Iterator[pa.RecordBatch]:
        """(_q, _id, score): the k best of each shard and item that reach the item's threshold."""
        held, rows, entries = [], 0, 0
        for batch in batches:
            for a in range(0, batch.num_rows, SHARD_ROWS):
                part = batch.slice(a, SHARD_ROWS)
                held.append(part)
                rows += part.num_rows
                entries += len(part.column(2).flatten())
                if rows >= SHARD_ROWS or entries >= SHARD_ENTRIES:
                    yield from self._shard(pa.Table.from_batches(held).combine_chunks(), k, names)
                    held, rows, entries = [], 0, 0
        if rows:
            yield from self._shard(pa.Table.from_batches(held).combine_chunks(), k, names)

    def _shard(self, shard: pa.Table, k: int, names: list[str]) -> Iterator[pa.RecordBatch]:
        ids, n, terms, counts = (shard.column(i).combine_chunks() for i in range(4))
        first = np.concatenate(([0], np.cumsum(pc.list_value_length(terms).to_numpy()))).astype(np.int64)
        terms, counts = terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64)
        values = entry_values(np.repeat(n.to_numpy(), np.diff(first)), counts, self.weights[terms], self.documents, self.total)
        tie = np.empty(len(ids), np.int64)
        tie[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
        tree, mask = Tree(first, terms, values), np.zeros(len(self.weights), bool)
        asked, scores, rows = [], [], []
        for q, query in enumerate(self.vocabulary.items):
            if len(query):
                for score, _, row in tree.best(query, k, int(self.least[q]), tie, mask)[0]:
                    asked.append(q), scores.append(-score), rows.append(row)
        yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int32()), ids.take(pa.array(rows, pa.int64())), pa.array(scores, pa.int64())], names=names)


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """Rows (id, text) of ``items`` in runs of about ``block_bytes``; an item is never cut."""
    rows = cut(items.select("item", "text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    dealt = cut(rows.withColumn("b", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)))) if n > 1 else rows.withColumn("b", F.lit(0))
    for b in range(n):
        yield [(r["item"], r["text"]) for r in dealt.where(F.col("b") == b).collect()]


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item, rank, doc, score): the k documents of the highest scores above 0 for each row of ``items``.

    Terms are maximal runs of ASCII letters and digits and characters beyond
    ASCII, A-Z lower-cased.  N counts the documents with a term, L their terms,
    n those of one document, df the documents that hold a term and tf its number
    in one.  A term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))); with
    m = 10 + (90 n N) div L a document scores the sum over the item's distinct
    terms of w ((10^9 tf) div (1000 tf + 8 m)), in 64-bit integers.  Equal
    scores go by id, null last.

    Null or termless text: no document.  Null or termless item: no rows.  Null
    ids: rows like others.  Repeated documents rank each on its own; repeated
    items have their own ranks each.  Long texts count whole.  Empty tables: no
    rows.  Columns not named are left out, so none can clash.

    Items are searched in blocks of about ``block_bytes`` of text, documents
    being read once for each; the terms of a block are what its tasks are given.
    """
    spark = docs.sparkSession
    id_field = T.StructField("_id", docs.schema[id_col].dataType)
    vector = T.StructType([id_field, T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])
    hit = T.StructType([T.StructField("_q", T.IntegerType()), id_field, T.StructField("score", T.LongType())])
    item_type = items.schema[item_col].dataType
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    out = None
    for block in _blocks(items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text_col}`").alias("text")), block_bytes):
        vocabulary = Vocabulary.of([text for _, text in block])
        vectors = cut(texts.mapInArrow(lambda it, v=vocabulary: _vectors(it, v), vector))
        documents, total = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        vectors = vectors.where(F.size("terms") > 0)
        df = np.zeros(len(vocabulary.hashes), np.int64)
        for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term of the block
            df[r["t"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        ranking = Ranking(vocabulary, weights, documents, max(1, total), np.ones(len(block), np.int64))
        names = [f.name for f in hit]
        best = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("_q").orderBy(F.col("score").desc(), F.col("_id").asc_nulls_last()))).where(F.col("rank") <= k)
        sample = vectors.sample(min(0.05, SAMPLE / max(1, documents)), seed=7).mapInArrow(lambda it, r=ranking: r.search(it, k, names), hit)
        least = np.ones(len(block), np.int64)
        for r in best(sample).where(F.col("rank") == k).collect():  # a row an item of the block
            least[r["_q"]] = r["score"]
        ranking = Ranking(vocabulary, weights, documents, max(1, total), least)
        hits = best(vectors.mapInArrow(lambda it, r=ranking: r.search(it, k, names), hit))
        named = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], T.StructType([T.StructField("_q", T.IntegerType()), T.StructField("_item", item_type)]))
        part = hits.join(F.broadcast(named), "_q").select(F.col("_item").alias(item_col), "rank", F.col("_id").alias(id_col), "score")
        out = part if out is None else out.unionByName(part)
    return out
