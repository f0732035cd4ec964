"""Benchmark decontamination with an FM-index per shard of documents.

A shard is a run of words of bounded size inside a task: whole documents, or a
part of a very long one that overlaps the next by what a phrase needs.  All of
its words are indexed, once: each distinct word is a symbol, suffixes are
ordered by prefix doubling over the groups that are not yet told apart, the
Burrows-Wheeler transform is a wavelet matrix with block ranks, and every
eighth suffix position is kept.  All blocks of phrases are searched backward in
the same index, their rows located by walking to a kept position, and the word
spans merged per document.  The documents are read in one pass, whatever the
benchmark's size, and stay in their rows: no shuffle.

A benchmark whose measured size fits one block travels to the tasks; a larger
one is cut into blocks of bounded text by Spark, each a file in the shared
folder that a task opens when it searches it.
"""

from __future__ import annotations

import os
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trilayer.llm._spark import cut, mounted_dir
from trilayer.llm._text import pieces, spans_of, text_word_hashes, word_hashes, words

WINDOW = 13
#: Bytes of benchmark text in one block of phrases.
BLOCK_CHARS = 2_000_000
#: Words in one index.
SHARD_WORDS = 1 << 20
_RATE = 8


class WaveletMatrix:
    """Rank over a sequence of integers, one bit vector per level."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.n, self.levels = len(seq), []
        for b in range(bits - 1, -1, -1):
            bit = ((seq >> b) & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            blocks = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            zeros = self.n - int(bit.sum())
            self.levels.append((b, packed, blocks, zeros))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def _ones(self, level: tuple, i: np.ndarray) -> np.ndarray:
        _, packed, blocks, _ = level
        q, r = i >> 6, (i & 63).astype(np.uint64)
        return blocks[q] + np.bitwise_count(packed[q] & ((np.uint64(1) << r) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol[k] is among the first i[k] items."""
        start = np.zeros(len(i), np.int64)
        for level in self.levels:
            one = (symbol >> level[0]) & 1 == 1
            a, b = self._ones(level, start), self._ones(level, i)
            start, i = np.where(one, level[3] + a, start - a), np.where(one, level[3] + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for level in self.levels:
            b, packed, _, zeros = level
            one = (packed[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1
            a = self._ones(level, i)
            out |= one.astype(np.int64) << b
            i = np.where(one, zeros + a, i - a)
        return out


class FMIndex:
    """Index of a sequence over symbols 1..sigma in which 0 separates texts.

    Separators differ from each other, in order of position, so no match and no
    common prefix runs across one.
    """

    def __init__(self, seq: np.ndarray, sigma: int):
        n = len(seq)
        sep = seq == 0
        rank = np.where(sep, np.cumsum(sep) - 1, seq + int(sep.sum()))
        order = np.argsort(rank)
        rows, key, rank, h = np.arange(n), rank[order], np.empty(n, np.int64), 1
        suffix = order
        while True:
            new = np.concatenate(([True], key[1:] != key[:-1]))
            rank[suffix] = np.maximum.accumulate(np.where(new, rows, 0))  # first row of the group
            rows = rows[~(new & np.concatenate((new[1:], [True])))]
            if not len(rows):
                break
            suffix = order[rows]
            after = np.where(suffix + h < n, rank[np.minimum(suffix + h, n - 1)] + 1, 0)
            key = (rank[suffix] << 32) | after
            by = np.argsort(key)
            suffix, key = suffix[by], key[by]
            order[rows] = suffix
            h *= 2
        self.n = n
        bwt = seq[order - 1]
        self.wavelet = WaveletMatrix(bwt, max(1, int(sigma).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=sigma + 1))))
        # Suffixes that start with a separator keep their positions: a walk never goes past one.
        kept = (order % _RATE == 0) | sep[order] | (bwt == 0)
        self.kept = WaveletMatrix(kept.astype(np.int64), 1)
        self.positions = order[kept]

    def search(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step for each interval."""
        base = self.first[symbol]
        return base + self.wavelet.rank(symbol, lo), base + self.wavelet.rank(symbol, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        one = np.ones(len(rows), np.int64)
        while len(at):
            done = self.kept.access(rows) == 1
            if done.any():
                out[at[done]] = self.positions[self.kept.rank(one[: int(done.sum())], rows[done])] + steps
            at, rows = at[~done], rows[~done]
            symbol = self.wavelet.access(rows)
            rows = self.first[symbol] + self.wavelet.rank(symbol, rows)
            steps += 1
        return out


@dataclass
class Phrases:
    """Windows of one block of benchmark items over its own alphabet."""

    alphabet: np.ndarray  # sorted word hashes; symbol = place + 1
    symbols: np.ndarray  # of all windows, one after another
    first: np.ndarray
    length: np.ndarray
    owner_first: np.ndarray  # items of each window
    owner_count: np.ndarray
    owners: np.ndarray
    items: list[str]

    @classmethod
    def of(cls, rows: list[tuple], size: int) -> Phrases:
        known: dict[bytes, int] = {}
        owners: list[set[int]] = []
        grams: list[np.ndarray] = []
        items = sorted({i for i, _ in rows})
        number = {x: k for k, x in enumerate(items)}
        for item, text in rows:
            h = text_word_hashes(text)
            for k in range(max(1, len(h) - size + 1) if len(h) else 0):
                g = h[k : k + size]
                w = known.setdefault(g.tobytes(), len(grams))
                if w == len(grams):
                    grams.append(g)
                    owners.append(set())
                owners[w].add(number[item])
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        alphabet = np.sort(every)
        alphabet = alphabet[np.concatenate(([True], alphabet[1:] != alphabet[:-1]))] if len(alphabet) else alphabet
        length = np.array([len(g) for g in grams], np.int64)
        count = np.array([len(o) for o in owners], np.int64)
        start = lambda c: np.concatenate(([0], np.cumsum(c)))[:-1].astype(np.int64)
        flat = np.array([x for o in owners for x in sorted(o)], np.int64)
        return cls(alphabet, np.searchsorted(alphabet, every) + 1, start(length), length, start(count), count, flat, items)


class Shard:
    """Index of the words of consecutive documents; row_first: where documents start."""

    def __init__(self, h: np.ndarray, row_first: np.ndarray):
        self.alphabet, symbol = np.unique(h, return_inverse=True)
        begins = np.zeros(len(h), np.int64)
        begins[row_first] = 1
        begins[0] = 1
        # separator, document, separator, document, ..., separator
        to = np.arange(len(h)) + np.cumsum(begins)
        seq = np.zeros(len(h) + int(begins.sum()) + 1, np.int64)
        self.origin = np.full(len(seq), -1, np.int64)
        seq[to], self.origin[to] = symbol + 1, np.arange(len(h))
        self.index = FMIndex(seq, len(self.alphabet))

    def find(self, ph: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of all phrases: (first word, phrase)."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(ph.length):
            return none
        place = np.minimum(np.searchsorted(self.alphabet, ph.alphabet), len(self.alphabet) - 1)
        symbols = np.where(self.alphabet[place] == ph.alphabet, place + 1, 0)[ph.symbols - 1]
        live = np.flatnonzero(np.minimum.reduceat(symbols, ph.first))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.index.n, np.int64)
        found, step = [], 0
        while len(live):
            lo, hi = self.index.search(lo, hi, symbols[ph.first[live] + ph.length[live] - 1 - step])
            step += 1
            some = lo < hi
            live, lo, hi = live[some], lo[some], hi[some]
            whole = ph.length[live] == step
            if whole.any():
                found.append((live[whole], lo[whole], hi[whole]))
                live, lo, hi = live[~whole], lo[~whole], hi[~whole]
        if not found:
            return none
        p, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
        return self.origin[self.index.locate(spans_of(lo, hi - lo))], np.repeat(p, hi - lo)


_ADDED = [("n_words", "bigint"), ("spans", "array<struct<first:bigint,end:bigint>>"), ("items", "array<string>")]
_SPAN = pa.struct([("first", pa.int64()), ("end", pa.int64())])


def _load(block: Phrases | str) -> Phrases:
    if isinstance(block, Phrases):
        return block
    with open(block, "rb") as f:
        return pickle.load(f)


def _runs(on: np.ndarray, wf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked words inside a row: (row, first, end), words counted from the row's start."""
    begin, border = on.copy(), wf[:-1][wf[:-1] < len(on)]
    begin[1:] &= ~on[:-1]
    begin[border] |= on[border]
    close = on.copy()
    close[:-1] &= ~on[1:] | begin[1:]
    a, b = np.flatnonzero(begin), np.flatnonzero(close) + 1
    row = np.searchsorted(wf, a, side="right") - 1
    return row, a - wf[row], b - wf[row]


def _shards(col: pa.Array, blocks: list[Phrases | str], size: int, shard_words: int) -> Iterator[tuple]:
    """For each piece of a text column: first row, words of each row, spans (row, first, end) and items (row, item)."""
    for i, _, data, off in pieces(col):
        low, s, e, wf = words(data, off)
        h = word_hashes(low, s, e)
        edge, items = np.zeros(len(h) + 1, np.int64), set()
        for a in range(0, len(h), shard_words):
            b = min(len(h), a + shard_words + size - 1)  # a phrase that starts here ends here
            shard = Shard(h[a:b], np.unique(wf[np.searchsorted(wf, a) : np.searchsorted(wf, b)]) - a)
            for block in blocks:
                ph = _load(block)
                start, phrase = shard.find(ph)
                start = start + a
                np.add.at(edge, start, 1)
                np.add.at(edge, start + ph.length[phrase], -1)
                n = ph.owner_count[phrase]
                pair = np.unique((np.repeat(np.searchsorted(wf, start, side="right") - 1, n) << 32) | ph.owners[spans_of(ph.owner_first[phrase], n)])
                items.update((x >> 32, ph.items[x & 0xFFFFFFFF]) for x in pair.tolist())
        yield i, np.diff(wf), *_runs(np.cumsum(edge)[:-1] > 0, wf), sorted(items)


def _scan(batches: Iterator[pa.RecordBatch], blocks: list[Phrases | str], text: str, names: list[str], size: int, shard_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        n_words, spans, items = np.zeros(n, np.int64), [[] for _ in range(n)], [[] for _ in range(n)]
        for i, count, row, a, b, found in _shards(batch.column(text), blocks, size, shard_words):
            n_words[i : i + len(count)] = count
            for r, x, y in zip((row + i).tolist(), a.tolist(), b.tolist(), strict=True):
                spans[r].append({"first": x, "end": y})
            for r, x in found:
                items[i + r].append(x)
        fields = [pa.array(n_words), pa.array(spans, pa.list_(_SPAN)), pa.array(items, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *fields], names=[*batch.schema.names, *names])


def phrase_blocks(benchmark: DataFrame, item: str, text: str, window: int, chars: int) -> list[Phrases | str]:
    """Windows of the benchmark in blocks of about ``chars`` bytes of text.

    One block comes as it is, for its size is measured; of several, the paths of
    their files.  An item is never cut, so one longer than a block is a block.
    """
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text")).where(F.length("text") > 0)
    rows = cut(rows.distinct())
    total = rows.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    if total <= chars:
        return [Phrases.of([tuple(r) for r in rows.collect()], window)]
    folder, n = mounted_dir(rows.sparkSession, "phrases"), -(-total // chars)

    def save(group: pd.DataFrame) -> pd.DataFrame:
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/{group['block'].iloc[0]}"
        aside = f"{path}-{uuid.uuid4().hex}"
        with open(aside, "wb") as f:
            pickle.dump(Phrases.of(list(zip(group["item"], group["text"], strict=True)), window), f, protocol=5)
        os.replace(aside, path)  # a repeated task leaves the same file
        return pd.DataFrame({"path": [path]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    return sorted(r["path"] for r in dealt.groupBy("block").applyInPandas(save, "path string").collect())


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, names: tuple[str, str, str] = ("n_words", "spans", "items"), block_chars: int = BLOCK_CHARS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with the word spans that any benchmark window covers.

    Adds n_words (long), spans (merged, in words from 0, end exclusive) and
    items (sorted ids, as strings, of the items with an occurring window) under
    ``names``, which must not be columns of ``docs`` yet.  A window is
    ``window`` consecutive words of an item; a shorter item that has words is
    one window.

    Null or wordless text: no words, no spans.  Null or wordless item: no
    window.  Null item_id: the item is called ``null``.  Repeated items count
    once by id.  Repeated rows and null ids of ``docs``: each row has its own
    result.  Very long texts are cut into overlapping shards.  Empty tables: nothing
    is marked.  All other columns of ``docs`` pass through.
    """
    names_ = list(names)
    if clash := set(names_) & set(docs.columns):
        raise ValueError(f"columns already there: {sorted(clash)}")
    schema = T.StructType(docs.schema.fields + [T.StructField(n, T._parse_datatype_string(t)) for n, (_, t) in zip(names_, _ADDED, strict=True)])
    blocks = phrase_blocks(benchmark, item_col, item_text_col, window, block_chars)
    return docs.mapInArrow(lambda it: _scan(it, blocks, text_col, names_, window, shard_words), schema)


def hit_words(spans: str = "spans") -> Column:
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])


def contaminated(spans: str = "spans", n_words: str = "n_words") -> Column:
    """The rule: at least one word in twenty lies in a window."""
    n = hit_words(spans)
    return (n > 0) & (20 * n >= F.col(n_words))
