"""License scans as an exact set-similarity join.

Text blocks are joined with license templates where the block's words contain at
least the threshold's share of a template's words.  Blocks are lines and, for
notices that are wrapped, windows over several lines of as many words as the
template has (in whole paragraphs, short templates are found scattered).  Tokens are put in
one global order, rarest first, by the number of blocks of the whole corpus that
hold them.  A block qualifies only if it holds a token of the template's prefix
(prefix filter), is long enough (length filter) and has enough tokens left from
its first shared token on (positional filter); the rest is verified exactly.
Templates are found from their prefixes' tokens by an inverted index, so a block
meets only those it shares a rare token with, however many there are.
Both passes stream over whole texts; only blocks of templates of at most
``TEMPLATE_CHARS`` characters, and one count per template token, travel to the
tasks.  More blocks follow each other on the same rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trilayer.llm._text import ALNUM, pieces, spans_of, text_word_hashes, word_hashes, words

# Phrases whose places are counted, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# License notices, and their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
#: Characters of template text that one step holds in a task; more templates take further steps.
TEMPLATE_CHARS = 1_000_000


class Templates:
    """Templates and phrases over one sorted vocabulary of word hashes."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], threshold: float):
        sets = [(label, sorted(set(text_word_hashes(t).tolist()))) for label, t in templates]
        self.length = [n for n in (len(text_word_hashes(t)) for _, t in templates) if n]
        self.phrases = [(label, text_word_hashes(p)) for p, label in phrases.items()]
        every = sorted({x for _, s in sets for x in s} | {int(x) for _, p in self.phrases for x in p}) or [0]  # a place that no template or phrase has
        self.vocabulary = np.array(every, np.uint64)
        self.labels = [label for label, s in sets if s]
        self.sets = [np.searchsorted(self.vocabulary, np.array(s, np.uint64)) for _, s in sets if s]
        self.size = np.array([len(s) for s in self.sets], np.int64)
        self.need = np.array([math.ceil(threshold * n - 1e-9) for n in self.size.tolist()], np.int64)
        self.sequences = [(label, np.searchsorted(self.vocabulary, p)) for label, p in self.phrases]
        self._index(np.arange(len(every)))

    def _index(self, rank: np.ndarray) -> None:
        """Inverted index of the prefixes (size - need + 1 rarest tokens), and all members by template and token."""
        self.rank = rank
        entries = [(t, int(x), p) for t, s in enumerate(self.sets) for p, x in enumerate(s[np.argsort(rank[s])].tolist())]
        every = np.array(entries, np.int64).reshape(-1, 3)
        keys = every[:, 0] * len(rank) + every[:, 1]
        by = np.argsort(keys)
        self.member, self.place = keys[by], every[by, 2]
        prefix = every[every[:, 2] <= (self.size - self.need)[every[:, 0]]]
        prefix = prefix[np.argsort(prefix[:, 1], kind="stable")]
        self.template_of, self.place_of = prefix[:, 0], prefix[:, 2]
        self.count_of = np.bincount(prefix[:, 1], minlength=len(rank))
        self.first_of = np.cumsum(self.count_of) - self.count_of

    def places(self, template: np.ndarray | int, token: np.ndarray) -> np.ndarray:
        """Place of each token in the order of its template; -1 if it isn't there."""
        key = template * len(self.rank) + token
        at = np.minimum(np.searchsorted(self.member, key), len(self.member) - 1)
        return np.where(self.member[at] == key, self.place[at], -1)

    def postings(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into token, posting) of all prefixes that hold a token."""
        n = self.count_of[token]
        return np.repeat(np.arange(len(token)), n), spans_of(self.first_of[token], n)

    def order(self, blocks: dict[int, int]) -> Templates:
        """Take the global order from the number of blocks that hold each token."""
        by = sorted(range(len(self.vocabulary)), key=lambda t: (blocks.get(t, 0), int(self.vocabulary[t])))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        self._index(rank)
        return self


def _blocks(col: pa.Array, tp: Templates) -> Iterator[tuple]:
    """Pieces of a text column: first row, word offsets, vocabulary ids (-1: none), block of each word, first blocks."""
    for i, _, data, off in pieces(col):
        low, s, e, wf = words(data, off, ALNUM)
        h = word_hashes(low, s, e)
        at = np.minimum(np.searchsorted(tp.vocabulary, h), len(tp.vocabulary) - 1)
        ids = np.where(tp.vocabulary[at] == h, at, -1)
        begin = np.sort(np.concatenate([off[:-1], np.flatnonzero(data == 10) + 1]))
        yield i, wf, ids, np.searchsorted(begin, s, side="right") - 1, np.searchsorted(begin, off[:-1], side="right") - 1, len(begin)


def _pairs(block: np.ndarray, token: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (block, token), sorted."""
    key = np.sort(block * width + token)
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return key // width, key % width


def _count(batches: Iterator[pa.RecordBatch], tp: Templates) -> Iterator[pa.RecordBatch]:
    n = np.zeros(len(tp.vocabulary), np.int64)
    for batch in batches:
        for _, _, ids, block, _, _ in _blocks(batch.column(0), tp):
            _, token = _pairs(block[ids >= 0], ids[ids >= 0], len(n))
            n += np.bincount(token, minlength=len(n))
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["token", "blocks"])


def _match(block: np.ndarray, token: np.ndarray, words_in: np.ndarray, tp: Templates) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(template, blocks, shared tokens) that meet the threshold; pairs are sorted by (block, rank)."""
    at, posting = tp.postings(token)
    if not len(at):
        return
    t, p = tp.template_of[posting], tp.place_of[posting]
    _, first = np.unique(block[at] * len(tp.sets) + t, return_index=True)  # the first shared token of block and template
    at, t, p = at[first], t[first], p[first]
    left = np.searchsorted(block, block[at], side="right") - at  # known tokens of the block from this one on
    ok = (words_in[block[at]] >= tp.need[t]) & (np.minimum(tp.size[t] - p, left) >= tp.need[t])
    candidates, t = block[at[ok]], t[ok]
    lo, hi = np.searchsorted(block, candidates), np.searchsorted(block, candidates, side="right")
    owner = np.repeat(np.arange(len(candidates)), hi - lo)
    member = tp.places(t[owner], token[spans_of(lo, hi - lo)]) >= 0
    shared = np.bincount(owner[member], minlength=len(candidates))
    ok = shared >= tp.need[t]
    for k in np.unique(t[ok]).tolist():
        mine = ok & (t == k)
        yield k, candidates[mine], shared[mine]


def _windows(ids: np.ndarray, wf: np.ndarray, block: np.ndarray, lines: dict[int, tuple[np.ndarray, np.ndarray]], tp: Templates) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(template, first words, last words, shared tokens) of windows over several lines that share more than each of these alone.

    lines: by template, the lines that meet the threshold and their shared tokens.
    A window starts and ends with a word of the template and lies in one row.
    """
    known = np.flatnonzero(ids >= 0)
    token = ids[known]
    for t in np.unique(tp.template_of[tp.postings(np.unique(token))[1]]).tolist():
        members, need = tp.sets[t], int(tp.need[t])
        p = tp.places(t, token)
        at, p = known[p >= 0], p[p >= 0]
        if not len(at):
            continue
        end = np.minimum(at + tp.length[t], wf[np.searchsorted(wf, at, side="right")])
        hi = np.searchsorted(at, end)
        rare = np.concatenate(([0], np.cumsum(p <= len(members) - need)))
        lo = np.arange(len(at))
        ok = (hi - lo >= need) & (rare[hi] > rare[lo]) & (block[at] != block[at[hi - 1]])
        lo, hi = lo[ok], hi[ok]
        if not len(lo):
            continue
        owner = np.repeat(np.arange(len(lo)), hi - lo)
        shared = np.bincount(_pairs(owner, p[spans_of(lo, hi - lo)], len(members))[0], minlength=len(lo))
        ok = shared >= need
        if t in lines:
            hits, alone = lines[t]
            a, b = np.searchsorted(hits, block[at[lo]]), np.searchsorted(hits, block[at[hi - 1]], side="right")
            for k in np.flatnonzero(ok & (a < b)).tolist():
                ok[k] = shared[k] > alone[a[k] : b[k]].max()
        if ok.any():
            yield t, at[lo[ok]], at[hi[ok] - 1], shared[ok]


def _best(first: np.ndarray, last: np.ndarray, shared: np.ndarray) -> list[tuple[int, int, int]]:
    """Of windows that overlap, sorted by their first words, the one that shares most, the first of equal ones."""
    out, reach = [], -1
    for w in zip(first.tolist(), last.tolist(), shared.tolist(), strict=True):
        if w[0] > reach:
            out.append(w)
        elif w[2] > out[-1][2]:
            out[-1] = w
        reach = max(reach, w[1])
    return out


_PLACE = pa.struct([("label", pa.string()), ("word", pa.int64())])
_MATCH = pa.struct([("label", pa.string()), ("block", pa.int64()), ("containment", pa.float64())])
_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("containment", pa.float64())])


def _template_blocks(templates: list[tuple[str, str]], most: int) -> list[list[tuple[str, str]]]:
    """Consecutive templates of at most ``most`` characters together; a longer one is alone, none at all are one empty block."""
    out, size = [[]], 0
    for label, text in templates:
        if out[-1] and size + len(text) > most:
            out.append([])
            size = 0
        out[-1].append((label, text))
        size += len(text)
    return out


def _scan(batches: Iterator[pa.RecordBatch], tp: Templates, text: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        count, places, matches, spans = np.zeros(n, np.int64), *([[] for _ in range(n)] for _ in range(3))
        for i, wf, ids, block, first, n_blocks in _blocks(batch.column(text), tp):
            count[i : i + len(wf) - 1] = np.diff(wf)
            for label, seq in tp.sequences:
                at = np.flatnonzero(ids[: len(ids) - len(seq) + 1] == seq[0]) if len(ids) >= len(seq) else np.zeros(0, np.int64)
                for k in range(1, len(seq)):
                    at = at[ids[at + k] == seq[k]]
                row = np.searchsorted(wf, at, side="right") - 1
                inside = at + len(seq) <= wf[row + 1]
                for r, w in zip(row[inside].tolist(), (at - wf[row])[inside].tolist(), strict=True):
                    places[i + r].append((w, label))
            known = ids >= 0
            b, ranked = _pairs(block[known], tp.rank[ids[known]], len(tp.vocabulary))
            token = np.argsort(tp.rank)[ranked]
            words_in = np.bincount(block, minlength=n_blocks)
            lines = {}
            for t, hits, shared in _match(b, token, words_in, tp):
                lines[t] = hits, shared
                row = np.searchsorted(first, hits, side="right") - 1
                for r, x, s in zip(row.tolist(), (hits - first[row]).tolist(), shared.tolist(), strict=True):
                    matches[i + r].append((x, tp.labels[t], s / len(tp.sets[t])))
            for t, *found in _windows(ids, wf, block, lines, tp):
                for a, z, s in _best(*found):
                    r = int(np.searchsorted(wf, a, side="right")) - 1
                    spans[i + r].append((int(block[a] - first[r]), int(block[z] - first[r]), tp.labels[t], s / len(tp.sets[t])))
        arrays = [
            pa.array(count),
            pa.array([[{"label": b, "word": a} for a, b in sorted(p)] for p in places], pa.list_(_PLACE)),
            pa.array([[{"label": b, "block": a, "containment": c} for a, b, c in sorted(m)] for m in matches], pa.list_(_MATCH)),
            pa.array([[{"label": c, "first": a, "last": b, "containment": d} for a, b, c, d in sorted(m)] for m in spans], pa.list_(_SPAN)),
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=names)


def scan(docs: DataFrame, text_col: str = "text", templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, threshold: float = 0.8, template_chars: int = TEMPLATE_CHARS) -> DataFrame:
    """``docs`` with license phrases and template matches of each row.

    Adds n_words (long), places (array of label and word: where a phrase's words
    stand consecutively), matches (array of label, block and containment: lines
    whose word set holds ``threshold`` or more of a template's) and spans (array
    of label, first, last and containment: the lines of the best of overlapping
    windows of the template's number of words, that hold more than each line alone).
    Words are runs of letters and digits, A-Z lower-cased.

    Null or empty text: no words, nothing found.  Templates without words, and
    none at all, match nothing.  Templates of more than ``template_chars``
    characters together are joined in blocks, one step after the other on the same
    rows, with equal results.  Repeated rows and null ids: each row has its own result.  A block
    that meets several templates, and ties between blocks, are all reported.
    Empty table: no rows.  All columns pass through; the four added names must
    not be taken.
    """
    if clash := {"n_words", "places", "matches", "spans"} & set(docs.columns):
        raise ValueError(f"columns already there: {sorted(clash)}")
    blocks = _template_blocks(TEMPLATES if templates is None else templates, template_chars)
    found = ("places", "matches", "spans")
    added = T._parse_datatype_string("n_words long, places array<struct<label:string,word:long>>, matches array<struct<label:string,block:long,containment:double>>, spans array<struct<label:string,first:long,last:long,containment:double>>").fields
    taken = {c.lower() for c in docs.columns}
    stem = next(s for k in itertools.count() if not any(c.startswith(s := f"_found{k}_") for c in taken))
    out, names = docs, []
    for k, block in enumerate(blocks):
        tp = Templates(block, (PHRASES if phrases is None else phrases) if k == 0 else {}, threshold)
        counts = docs.select(text_col).mapInArrow(lambda it, tp=tp: _count(it, tp), "token long, blocks long").groupBy("token").agg(F.sum("blocks").alias("blocks"))
        tp.order({r["token"]: r["blocks"] for r in counts.collect()})  # one row per template word at most
        new = [T.StructField(f"{stem}{k}_{f.name}" if len(blocks) > 1 else f.name, f.dataType) for f in added]
        schema = T.StructType(out.schema.fields + new)
        out = out.mapInArrow(lambda it, tp=tp, schema=schema: _scan(it, tp, text_col, schema.names), schema)
        names.append([f.name for f in new])
    if len(blocks) == 1:
        return out
    joined = [F.array_sort(F.concat(*[F.col(n[j]) for n in names])).alias(c) for j, c in enumerate(found, 1)]
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(names[0][0]).alias("n_words"), *joined)
