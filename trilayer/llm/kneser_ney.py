"""LM scoring with an interpolated modified Kneser-Ney trigram model.

Counting is three grouped jobs.  Words first: tasks count the words of a few
million tokens at a time and send each shard (a range of word hashes) its sorted
part; shards add up.  A word's id is its place in its shard.  Then trigrams as
ids, sharded by their middle word, so that a shard holds all that surrounds a
word: how often each trigram is seen, how many words precede each pair, how the
followers of each pair are spread.  Middle words with more than a shard's share
of all tokens are spread over shards by their last word; what their shards know
of a pair as a context is added up in the last job.  That job also gives each
word how many words precede it and how its own followers are spread.

Shards are stored in the shared folder, one file each, as sorted hash arrays:
the leading bits of a key choose a cell of 16 to 32 keys, the next 32 are
stored.  So a key that isn't there is taken for another one in up to 8 of 10^9
look-ups, at every size.  Pairs that occur once as a context aren't stored as
such: a pair that some word precedes, and that has no entry, has one follower,
seen once.  Workers map the files into memory.  The files stay in that folder,
since the scores are computed lazily.
"""

from __future__ import annotations

import json
import math
import os
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trilayer.llm._spark import cut, mounted_dir
from trilayer.llm._text import SPACED, mix64, pieces, word_hashes, words

#: Tokens counted or looked up in one go by a task (three ids of them fit in 63 bits), tokens that one shard should hold.
FLUSH, SHARD_TOKENS = 2_000_000, 1_500_000
#: Shard files that a worker keeps mapped.
OPEN = 4096
# Reserved hashes: the end of a text and what precedes its first word.
END, BEGIN = np.uint64(0xE0D0_0000_0000_0001), np.uint64(0xB000_0000_0000_0001)
# Ids: words that training doesn't hold, what precedes a text, the first word.
NONE, START, FIRST = 0, 1, 2
_PER_CELL = 32


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token with an end after each text, hash before it, hash before that, token offsets)."""
    low, s, e, wf = words(data, off, SPACED)
    n = len(off) - 1
    seq = np.full(len(s) + n, END, np.uint64)
    at = np.arange(len(s)) + np.repeat(np.arange(n), np.diff(wf))
    seq[at] = word_hashes(low, s, e)
    first = wf + np.arange(n + 1)
    before = np.empty_like(seq)
    before[1:] = seq[:-1]
    before[first[:-1]] = BEGIN
    second = np.empty_like(seq)
    second[1:] = before[:-1]
    second[first[:-1]] = BEGIN
    return seq, before, second, first


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Range of hashes that a key belongs to."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def starts(*x: np.ndarray) -> np.ndarray:
    """Places where sorted rows change."""
    new = np.zeros(len(x[0]), bool)
    new[:1] = True
    for c in x:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def lengths(at: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(at, n))


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their counts."""
    x = np.sort(x)
    at = starts(x)
    return x[at], lengths(at, len(x))


def sorted_by(*x: np.ndarray) -> np.ndarray:
    """Order of rows by the first column, then the next ones."""
    sizes = [int(c.max()) + 1 if len(c) else 1 for c in x]
    if math.prod(sizes) >= 1 << 63:
        return np.lexsort(x[::-1])
    key = np.zeros(len(x[0]), np.int64)
    for c, n in zip(x, sizes, strict=True):
        key = key * n + c
    return np.argsort(key)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Tokens with the two before each, at most ``FLUSH`` at a time."""
    held, size = [], 0

    def flush() -> Iterator[tuple[np.ndarray, ...]]:
        all_ = [np.concatenate(x) for x in zip(*held, strict=True)]
        for i in range(0, len(all_[0]), FLUSH):
            yield tuple(x[i : i + FLUSH] for x in all_)

    for batch in batches:
        for _, _, data, off in pieces(batch.column(0)):
            part = tokens(data, off)[:3]
            if held and size + len(part[0]) > FLUSH:
                yield from flush()
                held, size = [], 0
            held.append(part)
            size += len(part[0])
    if held:
        yield from flush()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted words of a task and their counts, in parts of about ``FLUSH`` distinct words at most."""
    w, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for seq, _, _ in _texts(batches):
        more = distinct(seq)
        both = np.concatenate((w, more[0]))
        order = np.argsort(both)
        at = starts(both[order])
        w, n = both[order][at], np.add.reduceat(np.concatenate((n, more[1]))[order], at)
        if len(w) >= FLUSH // 2:
            yield w, n
            w, n = w[:0], n[:0]
    if len(w):
        yield w, n


def _count_words(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for w, n in _word_counts(batches):
        edge = np.searchsorted(shard_of(w, shards), np.arange(shards + 1))
        some = np.flatnonzero(np.diff(edge))
        cut_ = lambda x: pa.array([x[edge[k] : edge[k + 1]].tobytes() for k in some], pa.binary())  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), cut_(w), cut_(n.astype(np.uint32))], names=["shard", "w", "n"])


def _save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of several arrays, written aside and renamed, so that a task that runs twice does no harm."""
    os.makedirs(folder, exist_ok=True)
    aside, at, head = f"{folder}/.{name}-{os.getpid()}-{os.urandom(4).hex()}", 0, {}
    for k, x in arrays.items():
        head[k] = (x.dtype.str, x.shape, at)
        at += -(-x.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    with open(aside, "wb") as f:
        f.write(np.uint64(len(text)).tobytes() + text)
        for x in arrays.values():
            f.write(np.ascontiguousarray(x).tobytes() + bytes(-x.nbytes % 8))
    os.replace(aside, f"{folder}/{name}")


class Tables:
    """The stored shards of one model, mapped into memory when asked for; the ones not used for longest are closed."""

    def __init__(self, folder: str):
        self.folder, self.open = folder, OrderedDict()

    def get(self, name: str) -> dict[str, np.ndarray]:
        """Arrays of a file, none if there is no such file (a shard without words)."""
        if name in self.open:
            self.open.move_to_end(name)
            return self.open[name]
        path, out = f"{self.folder}/{name}", {}
        if os.path.exists(path):
            data = np.memmap(path, np.uint8, "r")
            base = 8 + int(data[:8].view(np.uint64)[0])
            for k, (kind, shape, at) in json.loads(bytes(data[8:base])).items():
                out[k] = np.frombuffer(data, np.dtype(kind), math.prod(shape), base + at).reshape(shape)
        self.open[name] = out
        if len(self.open) > OPEN:
            self.open.popitem(last=False)
        return out


@lru_cache(maxsize=2)
def _tables(folder: str) -> Tables:
    return Tables(folder)


def _least(x: np.ndarray) -> np.ndarray:
    """In the narrowest type that holds the values."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def hash_array(name: str, keys: np.ndarray, values: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted hash array of distinct keys and their values.

    Values are bytes, larger ones are kept aside; rows of several columns are stored once each.
    """
    order = np.argsort(keys)
    keys = keys[order]
    bits = max(1, (len(keys) // _PER_CELL).bit_length())
    cell = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    out = {f"{name}_cell": cell.astype(np.uint32), f"{name}_key": (keys >> np.uint64(32 - bits)).astype(np.uint32)}
    if values.ndim == 1:
        values = values[order]
        large = np.flatnonzero(values >= 255)
        return out | {f"{name}_val": np.minimum(values, 255).astype(np.uint8), f"{name}_at": large.astype(np.uint32), f"{name}_large": values[large]}
    # narrow rows are told apart by a packed key, wide ones are all kept
    narrow = (values < 1 << 15).all(axis=1)
    packed = np.where(narrow, values @ (1 << 15 * np.arange(4)), (1 << 61) + np.arange(len(values)))
    _, some, code = np.unique(packed, return_index=True, return_inverse=True)
    return out | {f"{name}_val": _least(code[order]), f"{name}_row": values[some]}


def find(arrays: dict[str, np.ndarray], name: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, found) of keys in a stored hash array."""
    if f"{name}_cell" not in arrays or not len(arrays[f"{name}_key"]):
        return np.zeros((len(keys), 4) if name == "context" else len(keys), np.int64), np.zeros(len(keys), bool)
    cell, stored, value = arrays[f"{name}_cell"], arrays[f"{name}_key"], arrays[f"{name}_val"]
    bits = (len(cell) - 1).bit_length() - 1
    own = (keys >> np.uint64(64 - bits)).astype(np.int64)
    low, high = cell[own].astype(np.int64), cell[own + 1].astype(np.int64)
    end, short = high, (keys >> np.uint64(32 - bits)).astype(np.uint32)
    for _ in range(int((high - low).max()).bit_length()):
        mid = (low + high) >> 1
        less = stored[np.minimum(mid, len(stored) - 1)] < short
        less &= low < high
        low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
    at = np.minimum(low, len(stored) - 1)
    ok = (low < end) & (stored[at] == short)
    got = value[at].astype(np.int64)
    if f"{name}_row" in arrays:
        got = arrays[f"{name}_row"][got]
        return np.where(ok[:, None], got, 0), ok
    large = np.flatnonzero(got == 255)
    if len(large):
        got[large] = arrays[f"{name}_large"][np.searchsorted(arrays[f"{name}_at"], at[large])]
    return np.where(ok, got, 0), ok


def key_of(*ids: np.ndarray) -> np.ndarray:
    out = np.full(len(ids[0]), len(ids), np.uint64)
    for x in ids:
        out = mix64(out + x.astype(np.uint64) + np.uint64(0x51ED270B))
    return out


def _joined(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _add_words(table: pa.Table, folder: str) -> pa.Table:
    """One shard's words and counts go to a file; its totals come back."""
    shard = table.column("shard")[0].as_py()
    w, n = _joined(table.column("w"), np.uint64), _joined(table.column("n"), np.uint32).astype(np.int64)
    order = np.argsort(w)
    at = starts(w[order])
    w, n = w[order][at], np.add.reduceat(n[order], at)
    _save(folder, f"words{shard}", {"w": w, "c": n})
    return pa.table({"n": pa.array([int(n.sum())]), "types": pa.array([len(w)])})


def word_ids(w: np.ndarray, m: dict, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """(ids, training counts) of sorted distinct word hashes; the start counts once a text."""
    ids, c = np.full(len(w), NONE, np.int64), np.zeros(len(w), np.int64)
    edge = np.searchsorted(shard_of(w, m["shards"]), np.arange(m["shards"] + 1))
    for k in np.flatnonzero(np.diff(edge)).tolist():
        stored = t.get(f"words{k}")
        if stored:
            s = slice(edge[k], edge[k + 1])
            at = np.minimum(np.searchsorted(stored["w"], w[s]), len(stored["w"]) - 1)
            ok = stored["w"][at] == w[s]
            ids[s] = np.where(ok, FIRST + k * m["cap"] + at, NONE)
            c[s] = np.where(ok, stored["c"][at], 0)
    start = w == BEGIN
    ids[start], c[start] = START, m["docs"]
    return ids, c


def widths(c: np.ndarray, m: dict) -> np.ndarray:
    """Shards over which the trigrams around a word are spread: one for each shard's share of tokens."""
    return np.minimum(m["shards"], c * m["shards"] // max(1, m["tokens"]) + 1)


def placed(v: np.ndarray, w: np.ndarray, width: np.ndarray, m: dict) -> np.ndarray:
    """Shard of trigrams: by their middle word, and for frequent ones also by the last."""
    home = np.maximum(v - FIRST, 0) // m["cap"]
    return (home + (mix64(w.astype(np.uint64)) % width.astype(np.uint64)).astype(np.int64)) % m["shards"]


def _bytes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _numbers(x: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(x) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(x, np.uint8).reshape(-1, width)
    return out.view("<i8").ravel()


def _few(x: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as bytes, and those that don't fit."""
    return np.minimum(x, 255).astype(np.uint8).tobytes(), x[x >= 255].astype(np.uint32).tobytes()


def _all(few: bytes, many: bytes) -> np.ndarray:
    out = np.frombuffer(few, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(many, np.uint32)
    return out


_SENT = ["v", "v_run", "w", "w_run", "w_more", "u", "n", "n_more"]


def _count_trigrams(batches: Iterator[pa.RecordBatch], m: dict) -> Iterator[pa.RecordBatch]:
    """A row for each shard: middle words, the last words after each, the first words before each such pair."""
    t = _tables(m["folder"])
    for seq, before, second in _texts(batches):
        h = distinct(np.concatenate((seq, before[:1], second[:2], [BEGIN])))[0]
        ids, c = word_ids(h, m, t)
        width, size = widths(c, m), len(h)
        v, w, u = (np.searchsorted(h, x) for x in (before, seq, second))
        del seq, before, second
        key, n = distinct((v * size + w) * size + u)
        pair, u = np.divmod(key, size)
        v, w = np.divmod(pair, size)
        del key, pair
        shard = placed(ids[v], ids[w], width[v], m)
        order = np.argsort(shard, kind="stable")
        shard, v, w, u, n = (x[order] for x in (shard, v, w, u, n))
        edge = np.searchsorted(shard, np.arange(m["shards"] + 1))
        rows = []
        for k in np.flatnonzero(np.diff(edge)).tolist():
            s = slice(edge[k], edge[k + 1])
            ends = edge[k + 1] - edge[k]
            at = starts(v[s], w[s])
            head = starts(v[s][at])
            rows.append((k, _bytes(ids[v[s][at][head]], m["bytes"]), lengths(head, len(at)).astype(np.uint32).tobytes(), _bytes(ids[w[s][at]], m["bytes"]), *_few(lengths(at, ends)), _bytes(ids[u[s]], m["bytes"]), *_few(n[s])))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows, strict=True))], names=["shard", *_SENT])


def _classes(n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each run of counts: how many are one, two, more; and their sum."""
    return np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (n == 1, n == 2, n > 2, n)], axis=1) if len(at) else np.zeros((0, 4), np.int64)


def _seen(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


#: What trigram shards give: words before a word, followers of a word, numbers of all, followers of a pair.
_BEFORE, _FOLLOW, _SPREAD, _CONTEXT = range(4)
_NOT_A_WORD = 0xFFFFFFFF


def _add_trigrams(table: pa.Table, m: dict) -> pa.Table:
    """One shard's trigrams go to a file; what words and spread pairs need of them comes back, by shard."""
    shard = table.column("shard")[0].as_py()
    parts = []
    for row in table.select(_SENT).to_pylist():
        w_run, u = _all(row["w_run"], row["w_more"]), _numbers(row["u"], m["bytes"])
        v = np.repeat(_numbers(row["v"], m["bytes"]), np.frombuffer(row["v_run"], np.uint32))
        parts.append((np.repeat(v, w_run), np.repeat(_numbers(row["w"], m["bytes"]), w_run), u, _all(row["n"], row["n_more"])))
    v, w, u, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    # small numbers for the ids of this shard keep sort keys short
    names = [distinct(x)[0] for x in (v, w, u)]
    v, w, u = (np.searchsorted(a, x) for a, x in zip(names, (v, w, u), strict=True))
    order = sorted_by(v, w, u)
    v, w, u, n = v[order], w[order], u[order], n[order]
    at = starts(v, w, u)
    v, w, u, n = v[at], w[at], u[at], np.add.reduceat(n, at)
    arrays = hash_array("trigram", key_of(names[2][u], names[0][v], names[1][w]), n)
    order = sorted_by(v, u)
    at = starts(v[order], u[order])
    context, first, mid = _classes(n[order], at), names[2][u[order[at]]], names[0][v[order[at]]]
    spread = _seen(n)
    at = starts(v, w)
    before = lengths(at, len(v))
    v, w = v[at], w[at]
    arrays |= hash_array("pair", key_of(names[0][v], names[1][w]), before)
    # pairs whose middle word is spread are known only in part here
    wide = np.isin(mid, names[0][_width_of(names[0], m) > 1])
    keep = ~wide & (context[:, 3] > 1)
    arrays |= hash_array("context", key_of(first[keep], mid[keep]), context[keep])
    _save(m["folder"], f"trigrams{shard}", arrays)
    rows = [(0, _SPREAD, b"", np.array([*spread, *_seen(before)], np.int64).tobytes())]
    at = starts(v)
    last, times = distinct(w)
    for kind, keys, values in ((_BEFORE, names[1][last], times[:, None]), (_FOLLOW, names[0][v[at]], _classes(before, at))):
        home, place = np.divmod(np.maximum(keys - FIRST, 0), m["cap"])
        rows += _dealt(kind, np.where(keys == START, _NOT_A_WORD, place).astype(np.uint32), values, home, m["shards"])
    if wide.any():
        keys = key_of(first[wide], mid[wide])
        rows += _dealt(_CONTEXT, keys, context[wide], shard_of(keys, m["shards"]), m["shards"])
    cols = list(zip(*rows, strict=True))
    return pa.table({"shard": pa.array(cols[0], pa.int64()), "kind": pa.array(cols[1], pa.int32()), "keys": pa.array(cols[2], pa.binary()), "vals": pa.array(cols[3], pa.binary())})


def _width_of(ids: np.ndarray, m: dict) -> np.ndarray:
    """Over how many shards each word is spread, by its stored count."""
    t, c = _tables(m["folder"]), np.full(len(ids), m["docs"], np.int64)
    place = np.maximum(ids - FIRST, 0)
    for k in np.unique(place // m["cap"]).tolist():
        own = (place // m["cap"] == k) & (ids >= FIRST)
        if own.any():
            c[own] = t.get(f"words{k}")["c"][place[own] % m["cap"]]
    return widths(c, m)


def _dealt(kind: int, keys: np.ndarray, values: np.ndarray, shard: np.ndarray, shards: int) -> list[tuple[int, int, bytes, bytes]]:
    order = np.argsort(shard, kind="stable")
    edge = np.searchsorted(shard[order], np.arange(shards + 1))
    part = lambda x, k: np.ascontiguousarray(x[order[edge[k] : edge[k + 1]]])
    return [(k, kind, part(keys, k).tobytes(), part(values, k).astype(np.uint32).tobytes()) for k in np.flatnonzero(np.diff(edge)).tolist()]


def _finish(table: pa.Table, m: dict) -> pa.Table:
    """To one shard's words: the words before each and the spread of its followers; and its spread pairs."""
    shard, kinds = table.column("shard")[0].as_py(), table.column("kind").to_numpy()
    part = lambda kind, col, dtype: _joined(table.filter(pa.array(kinds == kind)).column(col), dtype)
    stored = Tables(m["folder"]).get(f"words{shard}")
    size = len(stored["w"]) if stored else 0
    before, follow, begin = np.zeros(size, np.int64), np.zeros((size, 4), np.int64), np.zeros(4, np.int64)
    place, vals = part(_BEFORE, "keys", np.uint32), part(_BEFORE, "vals", np.uint32)
    np.add.at(before, place, vals.astype(np.int64))
    place, vals = part(_FOLLOW, "keys", np.uint32), part(_FOLLOW, "vals", np.uint32).reshape(-1, 4).astype(np.int64)
    word = place != _NOT_A_WORD
    begin += vals[~word].sum(axis=0)
    np.add.at(follow, place[word], vals[word])
    arrays = {"before": before, "follow": follow}
    keys, vals = part(_CONTEXT, "keys", np.uint64), part(_CONTEXT, "vals", np.uint32).reshape(-1, 4).astype(np.int64)
    if len(keys):
        order = np.argsort(keys)
        at = starts(keys[order])
        vals = np.add.reduceat(vals[order], at, axis=0)
        several = vals[:, 3] > 1
        arrays |= hash_array("context", keys[order][at][several], vals[several])
    _save(m["folder"], f"more{shard}", arrays)
    spread = part(_SPREAD, "vals", np.int64).reshape(-1, 8).sum(axis=0)
    row = [*spread.tolist(), *_seen(before), int((before > 2).sum()), int(before.sum()), *begin.tolist()]
    return pa.table({f"x{k}": pa.array([int(x)]) for k, x in enumerate(row)})


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more.

    Where the counts give none (no item seen once, or a value not above zero),
    half the count is taken off, so that something is left for what is unseen.
    """
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else 2 * y, 3 - 4 * y * n4 / n3 if n3 else 3 * y) if n1 else (0.0, 0.0, 0.0)
    return tuple(min(x, float(k)) if x > 0 else k / 2 for k, x in enumerate(d, 1))


def held_out(id_: Column) -> Column:
    """Rows that the model doesn't learn from; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def count(docs: DataFrame, text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> dict:
    """Count a model over all rows of ``docs`` and store it: the facts that scoring needs.

    A null text is empty and still has its end.
    """
    spark = docs.sparkSession
    folder = mounted_dir(spark, "kneser-ney")
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = texts.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    shards = max(1, math.ceil((bounds[1] / 6 + bounds[0]) / shard_tokens))
    counted = texts.mapInArrow(lambda it: _count_words(it, shards), "shard long, w binary, n binary")
    sizes = cut(counted.groupBy("shard").applyInArrow(lambda t: _add_words(t, folder), "n long, types long"))
    total, types, cap = (int(x or 0) for x in sizes.agg(F.sum("n"), F.sum("types"), F.max("types")).first())
    m = {"folder": folder, "shards": shards, "cap": max(1, cap), "tokens": total, "types": types, "docs": bounds[0]}
    m["bytes"] = ((FIRST + shards * m["cap"]).bit_length() + 7) // 8
    sent = texts.mapInArrow(lambda it: _count_trigrams(it, m), "shard long, " + ", ".join(f"{c} binary" for c in _SENT))
    given = sent.groupBy("shard").applyInArrow(lambda t: _add_trigrams(t, m), "shard long, kind int, keys binary, vals binary")
    names = [f"x{k}" for k in range(18)]
    done = cut(given.groupBy("shard").applyInArrow(lambda t: _finish(t, m), ", ".join(f"{n} long" for n in names)))
    x = [int(v or 0) for v in done.agg(*[F.sum(n) for n in names]).first()]
    return m | {"trigrams": discounts(*x[:4]), "pairs": discounts(*x[4:8]), "words": discounts(*x[8:12]), "word_spread": (x[8], x[9], x[12]), "word_pairs": x[13], "begin": x[14:18]}


def _less(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """Counts after the discount."""
    return np.maximum(n - np.array([0.0, *d])[np.minimum(n, 3)], 0)


def _blend(n: np.ndarray, spread: np.ndarray, d: tuple[float, float, float], low: np.ndarray) -> np.ndarray:
    """Discounted share of a count in its context, plus what the discounts leave for the lower order."""
    p = (_less(n, d) + (spread[:, :3] @ np.array(d)) * low) / np.maximum(spread[:, 3], 1)
    return np.where(spread[:, 3] > 0, p, low)


def _by_shard(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    edge = np.searchsorted(shard[order], np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(edge)).tolist():
        yield k, order[edge[k] : edge[k + 1]]


def log_probabilities(seq: np.ndarray, before: np.ndarray, second: np.ndarray, m: dict, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """(log10 probability, training count) of each of at most ``FLUSH`` tokens."""
    h = distinct(np.concatenate((seq, before[:1], second[:2], [BEGIN])))[0]
    ids, c = word_ids(h, m, t)
    width, size, known = widths(c, m), len(h), ids != NONE
    prior, follow = np.zeros(size, np.int64), np.zeros((size, 4), np.int64)
    for k, own in _by_shard(np.maximum(ids - FIRST, 0) // m["cap"], m["shards"]):
        more = t.get(f"more{k}")
        own = own[ids[own] >= FIRST]
        if len(own):
            prior[own], follow[own] = more["before"][(ids[own] - FIRST) % m["cap"]], more["follow"][(ids[own] - FIRST) % m["cap"]]
    follow[ids == START] = m["begin"]
    share = sum(x * y for x, y in zip(m["words"], m["word_spread"], strict=True))
    low = (_less(prior, m["words"]) + share / (m["types"] + 1)) / m["word_pairs"] if m["word_pairs"] else np.full(size, 1 / (m["types"] + 1))

    # distinct pairs; the two words before a token are the pair of the token before it, but for the first of a text or piece
    w, v, u = (np.searchsorted(h, x) for x in (seq, before, second))
    n, edge = len(seq), np.flatnonzero((before == BEGIN) | (np.arange(len(seq)) == 0))
    code = np.concatenate((v * size + w, u[edge] * size + v[edge]))
    order = np.argsort(code)
    at = starts(code[order])
    place = np.empty(len(code), np.int64)
    place[order] = np.repeat(np.arange(len(at)), lengths(at, len(code)))
    one, two = np.divmod(code[order[at]], size)
    own, above = place[:n], np.concatenate(([0], place[: n - 1]))
    above[edge] = place[n:]

    real = np.flatnonzero(known[one] & known[two])
    key = key_of(ids[one[real]], ids[two[real]])
    times, context, met = np.zeros(len(one), np.int64), np.zeros((len(one), 4), np.int64), np.zeros(len(one), bool)
    for k, s in _by_shard(placed(ids[one[real]], ids[two[real]], width[one[real]], m), m["shards"]):
        times[real[s]], met[real[s]] = find(t.get(f"trigrams{k}"), "pair", key[s])
    start, end = ids[one] == START, h[two] == END
    met |= start & (ids[two] == START) & (m["docs"] > 0)
    context[met & ~end] = (1, 0, 0, 1)
    narrow = width[two[real]] == 1
    for name, some, shard in (("trigrams", narrow, np.maximum(ids[two[real]] - FIRST, 0) // m["cap"]), ("more", ~narrow, shard_of(key, m["shards"]))):
        some = np.flatnonzero(some & met[real])
        for k, s in _by_shard(shard[some], m["shards"]):
            s = some[s]
            got, ok = find(t.get(f"{name}{k}"), "context", key[s])
            context[real[s[ok]]] = got[ok]
    middle = _blend(times, follow[one], m["pairs"], low[two])

    # a trigram can be known only if both of its pairs are
    tried = np.flatnonzero((times[own] > 0) & met[above])
    iu, iv, iw = ids[u[tried]], ids[v[tried]], ids[w[tried]]
    key, found = key_of(iu, iv, iw), np.zeros(n, np.int64)
    for k, s in _by_shard(placed(iv, iw, width[v[tried]], m), m["shards"]):
        found[tried[s]] = find(t.get(f"trigrams{k}"), "trigram", key[s])[0]
    return np.log10(_blend(found, context[above], m["trigrams"], middle[own])), c[w]


_ADDED = [("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("lm_score", "double")]


def _score(batches: Iterator[pa.RecordBatch], text: str, m: dict) -> Iterator[pa.RecordBatch]:
    t = _tables(m["folder"])
    scale = math.log10(m["tokens"] + 0.1 * (m["types"] + 1))
    for batch in batches:
        n = batch.num_rows
        size, known, base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        for i, j, data, off in pieces(batch.column(text)):
            *three, first = tokens(data, off)
            parts = [log_probabilities(*[x[a : a + FLUSH] for x in three], m, t) for a in range(0, len(three[0]), FLUSH)]
            log, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            size[i:j] = np.diff(first)
            known[i:j] = np.add.reduceat((c > 0).astype(np.int64), first[:-1])
            base[i:j] = np.add.reduceat(np.log10(c + 0.1) - scale, first[:-1])
            score[i:j] = np.add.reduceat(log, first[:-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(known), pa.array(base), pa.array(score)], names=[*batch.schema.names, *[x for x, _ in _ADDED]])


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens, n_known, base_score and lm_score of each whole text.

    lm_score is the model's log10 probability of the text with its end,
    base_score that of add-0.1 unigrams, n_known the tokens that training holds.

    Null text: empty, one end token.  Repeated rows score alike; null ids
    don't matter.  Very long texts are looked up a few million tokens at a time.  A
    model counted over an empty table gives every token the same probability.
    Empty table: no rows.  All columns pass through; the added names must not
    be taken.
    """
    if clash := {x for x, _ in _ADDED} & set(docs.columns):
        raise ValueError(f"columns already there: {sorted(clash)}")
    added = T._parse_datatype_string(", ".join(f"{a} {b}" for a, b in _ADDED))
    return docs.mapInArrow(lambda it: _score(it, text_col, model), T.StructType(docs.schema.fields + added.fields))
