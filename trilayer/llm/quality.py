"""Quality classifier over supervised subword embeddings.

Words and character n-grams of a text are hashed to learned vectors and averaged
(a word equal to the one before also counts as a repeat); a softmax over the
average gives the class.  An n-gram lies in one word and may take in the
separator on either side of it.  The vectors are trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows, inside one task.  The
softmax is linear in the average, so scoring needs one number per bucket: the
fitted table is half a megabyte whatever the corpus, and every text is scored
where it lies, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trilayer.llm._text import pieces, word_hashes, words

#: Labelled rows that the classifier is fitted on at most, by hash order.
SAMPLE = 3000
BITS, DIM, EPOCHS, RATE = 16, 8, 8, 0.2
_WORD, _CHAR = 0, 1 << BITS
_REPEAT = 2 << BITS
TABLE = _REPEAT + 1
_CASED = np.arange(256, dtype=np.uint8)
_CASED[[0x20, *range(0x09, 0x0E)]] = 0


def _chars(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each character, offsets in characters); separators are 0x20, stray bytes join the character before."""
    x = data.astype(np.uint32)
    if len(data) and data.max() >= 0x80:
        inner = np.append(data & 0xC0 == 0x80, np.zeros(3, bool))
        wide, at = np.append(x, np.zeros(3, np.uint32)), np.flatnonzero(~inner[:-3])
        x, more = x[at], np.ones(len(at), bool)
        for k in (1, 2, 3):
            more = more & inner[at + k]
            x = np.where(more, (x << np.uint32(8)) | wide[at + k], x)
        off = np.searchsorted(at, off)
    x[(x >= 9) & (x <= 13)] = 32
    return x, off


def _grams(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places where an n-gram starts, their buckets, first place of each row and the total) for three and four characters."""
    x, off = _chars(data, off)
    shift, prime = np.uint32(32 - BITS), np.uint32(16777619)
    letter = x != 32
    g, inside = x, np.ones(len(x), bool)
    for n in (2, 3, 4):
        if len(x) < n:
            return
        g = g[:-1] * prime + x[n - 1 :]
        inside = inside[:-1] & letter[n - 2 : -1] if n > 2 else inside[:-1]
        if n > 2:
            whole = inside.copy()
            for k in range(1, n):  # not across rows
                border = off[1:-1] - k
                whole[border[(border >= 0) & (border < len(whole))]] = False
            at = np.flatnonzero(whole)
            yield at, (g[at] * np.uint32(2654435761)) >> shift, np.searchsorted(at, off)


def _sums(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of values[first:end] for each row; rows don't overlap."""
    out = np.zeros(len(first))
    some = np.flatnonzero(end > first)
    if len(some):
        at = np.empty(2 * len(some), np.int64)
        at[0::2], at[1::2] = first[some], end[some]
        out[some] = np.add.reduceat(np.append(values, 0.0), at)[0::2]
    return out


def _word_buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, whether it repeats the word before, word offsets)."""
    low, s, e, wf = words(data, off, _CASED)
    h = word_hashes(low, s, e)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[wf[:-1][wf[:-1] < len(h)]] = False
    return (h >> np.uint64(64 - BITS)).astype(np.int64), same, wf


def logits(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Difference of the two classes' logits, without the bias, for each row."""
    bucket, same, wf = _word_buckets(data, off)
    n_words = np.diff(wf)
    word = _sums(table[_WORD:_CHAR][bucket] + same * float(table[_REPEAT]), wf[:-1], wf[1:])
    char, n_char = np.zeros(len(off) - 1), np.zeros(len(off) - 1, np.int64)
    for _, b, first in _grams(data, off):
        char += _sums(table[_CHAR:_REPEAT][b], first[:-1], first[1:])
        n_char += np.diff(first)
    return 0.5 * word / np.maximum(n_words, 1) + 0.5 * char / np.maximum(n_char, 1)


def _bag(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of one text and their weights in the average."""
    off = np.array([0, len(data)])
    bucket, same, wf = _word_buckets(data, off)
    count = np.bincount(bucket, minlength=_CHAR).astype(float)
    count = np.concatenate([count, np.zeros(_CHAR), [float(same.sum())]]) * (0.5 / max(len(bucket), 1))
    grams = [b for _, b, _ in _grams(data, off)]
    total = sum(len(b) for b in grams)
    for b in grams:
        count[_CHAR:_REPEAT] += np.bincount(b, minlength=_CHAR) * (0.5 / max(total, 1))
    f = np.flatnonzero(count)
    return f, count[f]


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Train vectors and softmax by AdaGrad steps over one text at a time: (table, bias)."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (TABLE, DIM))
    seen = np.full(TABLE, 1e-6)
    out, bias = np.zeros((DIM, 2)), np.zeros(2)
    seen_out = 1e-6
    for _ in range(EPOCHS):
        for k in rng.permutation(len(bags)):
            f, v = bags[k]
            h = v @ vectors[f]
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = out @ p
            g_out = np.outer(h, p)
            seen_out += float((g_out**2).mean() + (p**2).mean())
            if len(f):
                g2 = v * v * float((back**2).mean())
                seen[f] += g2
                vectors[f] -= (RATE * v / np.sqrt(seen[f]))[:, None] * back
            out -= RATE * g_out / np.sqrt(seen_out)
            bias -= RATE * p / np.sqrt(seen_out)
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bags, labels = [], []
    for batch in batches:
        labels += batch.column("label").to_pylist()
        for i, j, data, off in pieces(batch.column("text")):
            bags += [_bag(data[off[r] : off[r + 1]]) for r in range(j - i)]
    table, bias = fit(bags, np.array(labels, np.int64)) if bags else (np.zeros(TABLE, np.float32), 0.0)
    yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])


def id_crc(id_: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary"))


def held_out(id_: Column) -> Column:
    return F.pmod(id_crc(id_), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fit on at most ``sample`` labelled rows that aren't held out.

    The sample is the first ids by hash.  Labels other than 0 and 1, null
    labels and null ids are left out; of an id's several labels the smallest counts.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    picked = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    rows = texts.groupBy("id", "label").agg(F.min("text").alias("text")).select("label", "text").coalesce(1).mapInArrow(_fit_task, "weights binary, bias double")
    best = rows.first()
    return (np.frombuffer(best["weights"], np.float32), best["bias"]) if best else (np.zeros(TABLE, np.float32), 0.0)


def _score(batches: Iterator[pa.RecordBatch], text: str, table: np.ndarray, bias: float, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = np.zeros(batch.num_rows)
        for i, j, data, off in pieces(batch.column(text)):
            score[i:j] = 1 / (1 + np.exp(-np.clip(logits(data, off, table) + bias, -60, 60)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, name])


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability (0 to 1) of label 1 under ``name``.

    Only the text is read.  Null or empty text has no features and gets the
    bias alone.  Repeated rows score alike; a text of any length is scored
    whole.  Without usable labels every score is 0.5.  Empty table: no rows.
    All columns pass through; ``name`` must not be taken.
    """
    if name in docs.columns:
        raise ValueError(f"column already there: {name}")
    table, bias = model
    return docs.mapInArrow(lambda it: _score(it, text_col, table, bias, name), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
