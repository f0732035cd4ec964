"""N-gram Jaccard join by chosen paths.

Texts become sets of hashed word shingles, sets become 64 min-wise slots.  Each
run starts at a root path and, level by level, lets every set follow each of its
tokens (slot, value) with the probability that leaves 1/threshold children on
average; sets that chose the same tokens meet in a bucket.  Buckets of one set
vanish, small ones are compared whole, large ones are split further, and runs
repeat until a pair at the threshold meets with the target probability.

Buckets compare sketches and give, for each, only enough pairs to keep linked
sets connected.  Connected candidates are then verified exactly against each
other in tiles of bounded size, which count links without emitting pairs.  Equal
texts are one row throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trilayer.llm._forest import local_roots
from trilayer.llm._spark import components, cut, small
from trilayer.llm._text import gram_hashes, mix64, pieces, word_hashes, words

SLOTS = 64
_SIG = 2 * SLOTS
#: Rows of one bucket up to which it is compared at once, and of a tile's side.
BUCKET, TILE = 1000, 512
_PAIRS = 100_000


def runs_for(threshold: float, depth: int, recall: float) -> int:
    """Runs after which a pair at the threshold has met with the target probability.

    depth: levels that a pair may have to survive.  The shared children of a
    pair that agrees in k slots number k / (threshold * SLOTS) on average at
    each node, so it survives a level with 1 - exp(-that * survival of the
    rest).  k is binomial.
    """
    if recall >= 1:
        raise ValueError("no number of runs is certain to meet a pair")
    k = np.arange(SLOTS + 1)
    weight = np.array([math.comb(SLOTS, int(x)) * threshold**x * (1 - threshold) ** (SLOTS - x) for x in k.tolist()])
    q = np.ones(SLOTS + 1)
    for _ in range(depth):
        q = 1 - np.exp(-q * k / (threshold * SLOTS))
    runs = 1
    while weight @ (1 - q) ** runs > 1 - recall:
        runs += 1
    return runs


def row_shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of one text's shingles; a shorter text that has words is one shingle."""
    return gram_hashes(h, min(size, len(h))) if len(h) else np.zeros(0, np.uint64)


def _sketch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    keys = (mix64(np.arange(1, SLOTS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    salt = np.arange(SLOTS, dtype=np.uint64) << np.uint64(32)
    for batch in batches:
        n, sigs = np.zeros(batch.num_rows, np.int64), []
        for i, j, data, off in pieces(batch.column("text")):
            low, s, e, wf = words(data, off)
            h = word_hashes(low, s, e)
            grams = (gram_hashes(h, size) >> np.uint64(32)).astype(np.uint32)
            for r in range(j - i):
                a, b = wf[r], wf[r + 1]
                x = grams[a : b - size + 1] if b - a >= size else (row_shingles(h[a:b], size) >> np.uint64(32)).astype(np.uint32)
                n[i + r] = len(x)
                if not len(x):
                    sigs.append(None)
                    continue
                low_ = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
                for k in range(0, len(x), 4096):
                    np.minimum(low_, (keys[:, None] * x[None, k : k + 4096]).min(axis=1), out=low_)
                sigs.append((mix64(low_.astype(np.uint64) | salt) >> np.uint64(48)).astype(np.uint16).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("id"), pa.array(n), pa.array(sigs, pa.binary())], names=["h", "id", "n", "sig"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), SLOTS)


def step_paths(path: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Children of each (path, set): (row of the parent, path of the child)."""
    slot = mix64(np.arange(SLOTS, dtype=np.uint64) + np.uint64(77))
    limit = np.uint64(int(2**64 / (threshold * SLOTS)))
    rows, paths = [], []
    for k in range(0, len(path), 4096):
        token = mix64((path[k : k + 4096, None] ^ slot[None, :]) + sig[k : k + 4096].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        r, c = np.nonzero(token < limit)
        rows.append(r + k)
        paths.append(mix64(token[r, c] + np.uint64(1)))
    return np.concatenate(rows), np.concatenate(paths)


def _paths(batches: Iterator[pa.RecordBatch], runs: int, depth: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rid, sig = batch.column("rid").to_numpy(), _matrix(batch.column("sig"))
        for run in range(runs):
            row, path = np.arange(len(rid)), np.full(len(rid), mix64(np.array([run + 1], np.uint64))[0])
            for _ in range(depth):
                if len(row):
                    k, path = step_paths(path, sig[row], threshold)
                    row = row[k]
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(rid[row])], names=["path", "rid"])


def _deeper(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            k, path = step_paths(batch.column("path").to_numpy().view(np.uint64), _matrix(batch.column("sig")), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(batch.column("rid").to_numpy()[k])], names=["path", "rid"])


class Leaders:
    """Connects the rows of one large bucket in a single pass.

    A row is joined to the leaders within the threshold's distance plus a
    leader's radius (plus slack for the sketch), and becomes a leader when none
    lies within the radius.  Distances obey the triangle inequality, so of two
    linked rows the later meets the earlier one's leader.  Pairs form a forest:
    a row gives one, and two leaders that a row joins give one at most.
    """

    def __init__(self, near: float, radius: float = 0.1):
        self.lowest, self.close = math.floor((near - radius) * SLOTS), math.ceil((1 - radius) * SLOTS)
        self.rid, self.sig = np.zeros(0, np.int64), np.zeros((0, SLOTS), np.uint16)
        self.group = np.zeros(0, np.int64)

    def _same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(a), len(b)), np.int16)
        for s in range(SLOTS):
            out += a[:, s, None] == b[None, :, s]
        return out

    def add(self, rid: np.ndarray, sig: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        edges = []
        for k in range(0, len(rid), 256):
            r, s = rid[k : k + 256], sig[k : k + 256]
            same = self._same(s, self.sig)
            todo = np.flatnonzero(~(same >= self.close).any(axis=1)) if len(self.rid) else np.arange(len(r))
            new = []
            while len(todo):
                new.append(todo[0])
                todo = todo[self._same(s[todo], s[todo[:1]])[:, 0] < self.close]
            self.rid, self.sig = np.concatenate([self.rid, r[new]]), np.concatenate([self.sig, s[new]])
            same = np.concatenate([same, self._same(s, s[new])], axis=1)
            a, b = np.nonzero(same >= self.lowest)
            first = np.concatenate(([True], a[1:] != a[:-1])) if len(a) else np.zeros(0, bool)
            edges.append((r[a[first]], self.rid[b[first]]))
            self.group = np.concatenate([self.group, np.arange(len(self.group), len(self.rid))])
            more = np.flatnonzero(~first)
            if len(more):
                lead = b[np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))][more]
                x, y = self.group[lead], self.group[b[more]]
                apart = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)[x != y], axis=0)
                if len(apart):
                    edges.append((self.rid[apart[:, 0]], self.rid[apart[:, 1]]))
                    self.group = local_roots(len(self.rid), apart[:, 0], apart[:, 1])[self.group]
        return edges


def _meet(batches: Iterator[pa.RecordBatch], near: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by path: pairs that keep alike sets of each bucket connected."""
    need = math.floor(near * SLOTS)
    path, rid, sig = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, SLOTS), np.uint16)
    open_: Leaders | None = None

    def stars(at: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Connected rows, each with the smallest rid of its part: buckets that hold the same sets give the same pairs."""
        root = local_roots(len(at), a, b)
        least = rid[at].copy()
        np.minimum.at(least, root, rid[at])
        return rid[at], least[root]

    def small_groups(first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for s in sorted(set(size.tolist())):
            at = first[size == s][:, None] + np.arange(s)[None, :]
            x, y = np.triu_indices(s, 1)
            for k in range(0, len(at), max(1, _PAIRS // len(x))):
                part = at[k : k + max(1, _PAIRS // len(x))]
                ok = (sig[part[:, x]] == sig[part[:, y]]).sum(axis=2) >= need
                g, c = np.nonzero(ok)
                yield stars(part.ravel(), g * s + x[c], g * s + y[c])

    def groups(last: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nonlocal path, rid, sig, open_
        if not len(path):
            return
        first = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
        size = np.diff(np.concatenate((first, [len(path)])))
        if open_ is not None:
            yield from open_.add(rid[: size[0]], sig[: size[0]])
            if len(first) > 1 or last:
                open_ = None
            first, size = first[1:], size[1:]
        keep = len(path) if last or not len(first) else int(first[-1])
        whole = slice(None) if last or not len(first) else slice(-1)
        f, z = first[whole], size[whole]
        yield from small_groups(f[(z > 1) & (z <= 48)], z[(z > 1) & (z <= 48)])
        for a, n in zip(f[z > 48], z[z > 48], strict=True):
            pairs = Leaders(near).add(rid[a : a + n], sig[a : a + n])
            order = np.argsort(rid[a : a + n])
            place = lambda x, a=a, n=n, order=order: order[np.searchsorted(rid[a : a + n], x, sorter=order)]
            yield stars(np.arange(a, a + n), *(place(np.concatenate(x)) for x in zip(*pairs, strict=True)))
        if not last and len(path) - keep > 20_000:
            open_ = Leaders(near)
            yield from open_.add(rid[keep:], sig[keep:])
            keep = len(path)
        path, rid, sig = path[keep:], rid[keep:], sig[keep:]

    def out(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for a, b in pairs:
            a, b = a[a != b], b[a != b]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        p = batch.column("path").to_numpy()
        if open_ is not None and p[0] != open_path:
            open_ = None
        path, rid, sig = np.concatenate([path, p]), np.concatenate([rid, batch.column("rid").to_numpy()]), np.concatenate([sig, _matrix(batch.column("sig"))])
        yield from out(groups(False))
        open_path = p[-1]
    yield from out(groups(True))


def link_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, ratio: Fraction) -> np.ndarray:
    """Boolean matrix (left x right) of set pairs with Jaccard >= ratio, exactly."""
    size = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), size)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    change = np.concatenate(([True], flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, bool)
    col = np.cumsum(change) - 1
    count = np.bincount(col) if len(col) else np.zeros(0, np.int64)
    shared = count[col] > 1 if len(col) else np.zeros(0, bool)
    row, col = row[shared], col[shared]
    col = np.cumsum(np.concatenate(([True], col[1:] != col[:-1]))) - 1 if len(col) else col
    inter = np.zeros((len(left), len(right)), np.int64)
    place = np.full(len(sets), -1, np.int64)
    place[left] = np.arange(len(left))
    other = np.full(len(sets), -1, np.int64)
    other[right] = np.arange(len(right))
    width = 2048
    for a in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        lo, hi = np.searchsorted(col, (a, a + width))
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        r, c = row[lo:hi], col[lo:hi] - a
        x[place[r[place[r] >= 0]], c[place[r] >= 0]] = 1
        y[other[r[other[r] >= 0]], c[other[r] >= 0]] = 1
        inter += np.rint(x @ y.T).astype(np.int64)
    total = size[left][:, None] + size[right][None, :]
    return (inter * (ratio.numerator + ratio.denominator) >= ratio.numerator * total) & (total > 0)


def _tile(rid: list[int], copies: list[int], chunk: np.ndarray, pair: tuple[int, int], texts: list[str], size: int, ratio: Fraction) -> tuple[list, list, list]:
    sets = []
    for _, _, data, off in pieces(pa.array(texts, pa.large_string())):
        low, s, e, wf = words(data, off)
        h = word_hashes(low, s, e)
        for r in range(len(off) - 1):
            g = np.sort(row_shingles(h[wf[r] : wf[r + 1]], size))
            sets.append(g[np.concatenate(([True], g[1:] != g[:-1]))] if len(g) else g)
    left, right = (np.flatnonzero(chunk == c) for c in pair)
    linked = link_counts(sets, left, right, ratio)
    weight = np.array(copies, np.int64)
    n = np.zeros(len(rid), np.int64)
    if pair[0] == pair[1]:
        np.fill_diagonal(linked, False)
        n[left] = linked @ weight[right]
    else:
        n[left], n[right] = linked @ weight[right], linked.T @ weight[left]
    ids = np.array(rid, np.int64)
    a, b, c = ids[n > 0].tolist(), [None] * int((n > 0).sum()), n[n > 0].tolist()
    # a tree through each connected part: the first row of each side reached from the other
    todo = linked.any(axis=1)
    while todo.any():
        rows = np.zeros(len(left), bool)
        rows[np.argmax(todo)] = True
        cols = np.zeros(len(right), bool)
        while True:
            grown = cols | linked[rows].any(axis=0)
            if pair[0] == pair[1]:
                rows_ = rows | grown
            else:
                rows_ = rows | linked[:, grown].any(axis=1)
            if (grown == cols).all() and (rows_ == rows).all():
                break
            rows, cols = rows_, grown
        part = sorted({*left[rows].tolist(), *right[cols].tolist()})
        a += [int(ids[part[0]])] * (len(part) - 1)
        b += [int(ids[x]) for x in part[1:]]
        c += [0] * (len(part) - 1)
        todo &= ~rows
    return a, b, c


def _verify(batches: Iterator[pa.RecordBatch], size: int, ratio: Fraction) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (root, i, j, rid): links of each row and trees of linked rows."""
    key, rows = None, []

    def flush() -> pa.RecordBatch | None:
        if len(rows) < 2:
            return None
        rid, copies, chunk, texts = (list(x) for x in zip(*rows, strict=True))
        a, b, c = _tile(rid, copies, np.array(chunk), key[1:], texts, size, ratio)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["a", "b", "n"]) if a else None

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("root", "i", "j", "rid", "copies", "chunk", "text")]
        for root, i, j, rid, copies, chunk, text in zip(*cols, strict=True):
            if (root, i, j) != key:
                if (made := flush()) is not None:
                    yield made
                key, rows = (root, i, j), []
            if not rows or rows[-1][0] != rid:  # repeated rows of one text
                rows.append((rid, copies, chunk, text))
    if (made := flush()) is not None:
        yield made


def text_key(text: Column) -> Column:
    """16-byte key of a text; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_: int = 5, threshold: float = 0.8, recall: float = 0.995, depth: int = 4, extra_levels: int = 2) -> DataFrame:
    """Classes of near-duplicate texts, one row per distinct text.

    Returns (h, id, copies, class_id, n_links, root): h is the key of the text
    (``text_key``), id the smallest id among its copies, class_id the smallest
    id reachable by links, n_links the other documents whose set of ``words_``
    word shingles has Jaccard similarity of ``threshold`` or more, and root a
    number of the class that is unique even when ids are null.  Links are
    verified exactly; a pair at the threshold is met with probability
    ``recall`` at least.

    Words are runs of letters and digits, A-Z lower-cased; a text of fewer
    words than a shingle has but one shingle.  Null or wordless texts link with
    nothing, not even their copies (n_links 0; ``label`` makes each its own
    class).  Repeated rows are copies.  Null ids: the smallest other id names
    the class, null if there is none.  Empty table: no rows.  Columns not named
    are left out, so none can clash.
    """
    ratio = Fraction(str(threshold))
    near = threshold - 0.25
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("h", text_key(F.col("text")))
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("h", T.BinaryType()), T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("sig", T.BinaryType())])
    sketched = src.mapInArrow(lambda it: _sketch(it, words_), schema)
    reps = sketched.groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    reps = cut(reps.withColumn("rid", F.monotonically_increasing_id()))
    sets = reps.where("n > 0").select("rid", "sig")

    runs = runs_for(threshold, depth + extra_levels, recall)  # buckets that stay large are met at the last level only
    met = sets.mapInArrow(lambda it: _paths(it, runs, depth, threshold), "path long, rid long")
    edges = None
    for level in range(extra_levels + 1):
        sized = met.select("path", "rid", F.count("*").over(Window.partitionBy("path")).alias("n")).where("n > 1")
        sized = cut(sized.join(sets, "rid"))
        final = sized if level == extra_levels else sized.where(F.col("n") <= BUCKET)
        found = final.select("path", "rid", "sig").repartition("path").sortWithinPartitions("path").mapInArrow(lambda it: _meet(it, near), "a long, b long").distinct()
        edges = found if edges is None else edges.union(found)
        large = sized.where(F.col("n") > BUCKET)
        if level == extra_levels or large.isEmpty():
            break
        met = large.mapInArrow(lambda it: _deeper(it, threshold), "path long, rid long")
    groups = cut(components(edges))

    sizes = groups.groupBy("root").agg(F.count("*").alias("members"))
    parts = F.ceil(F.col("members") / TILE).cast("int")
    members = groups.join(sizes, "root").withColumn("parts", parts).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    members = members.select(F.col("id").alias("rid"), "root", "chunk", "parts").join(reps.select("rid", "h", F.col("id").alias("first"), "copies"), "rid")
    members = cut(members)
    tiles = src.join(small(members, 120), "h").where(F.col("id").eqNullSafe(F.col("first")))
    tiles = tiles.select("root", "rid", "copies", "chunk", "text", F.explode(F.expr("sequence(0, parts - 1)")).alias("other"))
    tiles = tiles.select("root", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "rid", "copies", "chunk", "text")
    seen = tiles.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "rid").mapInArrow(lambda it: _verify(it, words_, ratio), "a long, b long, n long")
    seen = cut(seen)
    links = seen.where("b is null").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("linked"))
    classes = components(seen.where("b is not null").select("a", "b"))

    rows = reps.join(classes.withColumnRenamed("id", "rid"), "rid", "left").join(links, "rid", "left")
    rows = cut(rows.select("h", "id", "copies", "n", F.coalesce("root", "rid").alias("root"), F.coalesce("linked", F.lit(0)).alias("linked")))
    names = rows.groupBy("root").agg(F.min("id").alias("class_id"))
    own = F.when(F.col("n") > 0, F.col("copies") - 1 + F.col("linked")).otherwise(F.lit(0)).cast("long")
    return rows.join(names, "root").select("h", "id", "copies", F.col("n").alias("n_shingles"), "class_id", own.alias("n_links"), "root")


def label(docs: DataFrame, joined: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_links, kept) for each row of ``docs``; kept marks the smallest id of a class."""
    d = docs.select(F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("h"))
    rows = d.join(joined.select("h", "class_id", "n_links", "n_shingles"), "h")
    cls = F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("_id"))
    return rows.select(F.col("_id").alias(id_col), cls.alias("class_id"), "n_links", F.col("_id").eqNullSafe(cls).alias("kept"))
