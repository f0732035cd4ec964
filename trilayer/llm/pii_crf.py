"""Personal data: patterns plus a linear-chain conditional random field.

The patterns give the base spans.  The field labels whitespace-separated tokens
by their word shapes (begin/inside of each kind, or outside), is trained from
the small labelled table below by gradient ascent on the conditional likelihood,
and is decoded by Viterbi over padded numpy batches of lines.  It finds forms
that the patterns miss, such as phone numbers without a plus sign or dotted
card numbers; its spans never replace a base span.  A decoded span counts if the
field gives it a probability of at least ``LEAST``, and if it can be what its kind
means: octets up to 255, digits of a telephone number, the check digit of a card.

Lines of more than ``PART`` tokens are decoded in overlapping parts, so memory
doesn't grow with a line.

Every kind holds a digit or an ``@``, so lines without either are outside
throughout and aren't decoded.  Documents keep their rows: no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trilayer.llm._text import pieces

KINDS = ("email", "ip", "card", "phone")
#: Probability that a span of the field needs.
LEAST = 0.5
#: Tokens of a line that are decoded together, tokens around them, and tokens of one batch of lines.
PART, OVERLAP, BATCH = 2048, 64, 50_000

# The labelled table.  [kind:...] marks a span.
LABELLED = """
write to [email:ana.lee@example.org] before noon
contact: [email:sales+eu@shop.example.com], or call [phone:+44 20 7946 0958].
his address is [email:j_doe77@mail.example.net] and hers is unknown
mail <[email:help-desk@example.co.uk]> for help
reach us at [phone:(555) 010-4477] today
call [phone:555-010-2231] or [phone:555.010.9921] after five
phone: [phone:(212) 555 0147], fax: [phone:(212) 555 0148]
her number, [phone:020 7946 0123], was busy
tel. [phone:+1 (415) 555-0100] ext 4
my mobile [phone:0171 5550 199] is new
dial [phone:1-800-555-0199] for the desk
the server [ip:192.168.10.4] did not answer
ping [ip:10.0.0.12], then [ip:172.16.254.1].
traffic from [ip:203.0.113.77]:8080 was cut
card [card:4111 1111 1111 1111] was charged
paid with [card:5500-0000-0000-0004] on monday
number [card:4012.8888.8888.1881] expires soon
visa [card:4222222222222] or [card:4111111111111111], both fine
card no. [card:3782 822463 10005] was refused
licensed under the apache license, version 2.0.
released in 2019 and again in 2021, see page 412
version 3.11.4 fixes 17 bugs in 2.0 and 1.4.2
the price rose from 12.50 to 1 300.00 in 2020
token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" was found
on 2023-04-17 at 10:45 we met 12 people
chapter 7, section 3.2, lines 100-220
sum of 48 and 952 is 1000, not 10000
isbn 978-3-16 was out of print by 1999
room 101, floor 3, building 12
call me at 5 or at 6
call him in 1999 about number 7
a record of 100000 units in 12 months
cc by-nc 4.0 and gpl 3 apply
order 12345678 shipped, invoice 2020-000341 follows
@home and @work are tags, not mail
see figure 2.3.1 and table 4.1
the word and the other word of the same line
there is nothing here, only words, and more words
42 is the answer
he ran 10 km in 50:12 and 5 km in 24:08
""".strip()

# ---- patterns -------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive runs and the look-behind change no match, they only keep long digit runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def is_card(s: str) -> bool:
    d = _digits(s)
    return 14 <= len(d) <= 19 and luhn(d)


def is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in s.split("."))


def is_phone(s: str, least: int = 10, most: int = 15) -> bool:
    return least <= len(_digits(s)) <= most


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches around each ``@``: the longest local part left of it, a dotted domain right of it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all patterns, sorted."""
    found = [(a, 0, b) for a, b in emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if is_ip(m.group())]
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if is_card(m.group())]
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if is_phone(m.group())]
    return sorted(found)


# ---- the field ------------------------------------------------------------

_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_N = len(_LABELS)
FEATURES = 1 << 12


def shape(token: str) -> str:
    """Word shape: runs of letters and digits with their lengths in classes, signs as they are."""
    out, k = [], 0
    while k < len(token) and len(out) < 24:
        c = token[k]
        kind = "9" if "0" <= c <= "9" else "a" if c.isalpha() else c
        n = 1
        if kind in "9a":
            while k + n < len(token) and (("0" <= token[k + n] <= "9") if kind == "9" else token[k + n].isalpha()):
                n += 1
            out.append(kind + ("" if kind == "a" else str(n) if n <= 5 else "m" if n <= 11 else "c" if n <= 19 else "x"))
        else:
            out.append(kind)
        k += n
    return "".join(out)


def _hash(s: str) -> int:
    h = 2166136261
    for b in s.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h % FEATURES


@lru_cache(maxsize=100_000)
def _shape_features(s: str) -> tuple[int, ...]:
    core = s.strip("\"'<>[](){},;:.!?")
    return tuple(_hash(f) for f in (f"s={s}", f"c={core}", f"@={'@' in s}", f"+={s[:1] == '+'}", f"d={'9' in s}{'a' in s}", f"l={len(s)}", f"p={s.count('.')}{s.count('-')}"))


@lru_cache(maxsize=100_000)
def _near_features(s: str, where: str) -> tuple[int, ...]:
    return _hash(f"{where}s={s}"), _hash(f"{where}d={'9' in s}{'a' in s}")


def features(tokens: list[str]) -> list[tuple[int, ...]]:
    """Hashed shape features of each token and its neighbours; the word before counts when it has no digit."""
    shapes = [shape(t) for t in tokens]
    out = []
    for k, s in enumerate(shapes):
        before, after = shapes[k - 1] if k else "^", shapes[k + 1] if k + 1 < len(shapes) else "$"
        word = tokens[k - 1].lower().strip(".:,") if k and "9" not in before else ""
        out.append((*_shape_features(s), *_near_features(before, "<"), *_near_features(after, ">"), _hash(f"w={word[:20]}"), 0))
    return out


def _labelled() -> list[tuple[list[str], list[int]]]:
    rows = []
    for line in LABELLED.splitlines():
        text, marks, at = "", [], 0
        for m in re.finditer(r"\[(email|ip|card|phone):([^\]]*)\]", line):
            text += line[at : m.start()]
            marks.append((len(text), len(text) + len(m[2]), m[1]))
            text += m[2]
            at = m.end()
        text += line[at:]
        tokens, labels = [], []
        for m in _TOKEN.finditer(text):
            label = 0
            for a, b, kind in marks:
                if m.start() < b and a < m.end():
                    label = _LABELS.index(("B-" if m.start() <= a else "I-") + kind)
            tokens.append(m.group())
            labels.append(label)
        rows.append((tokens, labels))
    return rows


def _forbidden() -> np.ndarray:
    """Inside a kind only after its begin or inside."""
    bad = np.zeros((_N, _N))
    for j, x in enumerate(_LABELS):
        if x[0] == "I":
            for i, y in enumerate(_LABELS):
                bad[i, j] = 0 if y[1:] == x[1:] and y != "O" else -1e4
    return bad


@lru_cache(maxsize=1)
def train(steps: int = 120, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x labels) and transitions, by AdaGrad on the log likelihood."""
    rows = [(np.array(features(t)), np.array(y)) for t, y in _labelled()]
    w, trans, bad = np.zeros((FEATURES, _N)), np.zeros((_N + 1, _N)), _forbidden()
    start_bad = np.array([-1e4 if x[0] == "I" else 0.0 for x in _LABELS])
    sq_w, sq_t = np.full_like(w, 1e-8), np.full_like(trans, 1e-8)
    for _ in range(steps):
        gw, gt = -decay * w, -decay * trans
        for f, y in rows:
            em = w[f].sum(axis=1)
            n = len(y)
            tr = trans[:_N] + bad
            alpha = np.empty((n, _N))
            alpha[0] = em[0] + trans[_N] + start_bad
            for k in range(1, n):
                alpha[k] = em[k] + np.logaddexp.reduce(alpha[k - 1][:, None] + tr, axis=0)
            beta = np.zeros((n, _N))
            for k in range(n - 2, -1, -1):
                beta[k] = np.logaddexp.reduce(tr + em[k + 1] + beta[k + 1], axis=1)
            z = np.logaddexp.reduce(alpha[-1])
            d = -np.exp(alpha + beta - z)
            gt[_N] += d[0]
            d[np.arange(n), y] += 1
            gt[_N, y[0]] += 1
            np.add.at(gw, f, d[:, None, :])
            for k in range(1, n):
                gt[:_N] -= np.exp(alpha[k - 1][:, None] + tr + em[k] + beta[k] - z)
                gt[y[k - 1], y[k]] += 1
        sq_w += gw * gw
        sq_t += gt * gt
        w += rate * gw / np.sqrt(sq_w)
        trans += rate * gt / np.sqrt(sq_t)
    trans[:_N] += bad
    trans[_N] += start_bad
    return w, trans


def viterbi(emission: np.ndarray, length: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels of a padded batch (lines x tokens x labels)."""
    m, n, _ = emission.shape
    score = emission[:, 0] + trans[_N]
    back = np.zeros((m, n, _N), np.int8)
    final = score.copy()
    for k in range(1, n):
        step = score[:, :, None] + trans[None, :_N]
        back[:, k] = step.argmax(axis=1)
        score = step.max(axis=1) + emission[:, k]
        ends = length == k + 1
        final[ends] = score[ends]
    labels = np.zeros((m, n), np.int64)
    at = final.argmax(axis=1)
    for k in range(n - 1, -1, -1):
        inside = k < length
        labels[inside, k] = at[inside]
        if k:
            at = np.where(inside, back[np.arange(m), k, at], at)
    return labels


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def span_probabilities(emission: np.ndarray, trans: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Probability that each (begin label, first, end) is a whole span of one line's labelling."""
    n, inner = len(emission), trans[:_N]
    alpha, beta = np.empty((n, _N)), np.zeros((n, _N))
    alpha[0] = emission[0] + trans[_N]
    for k in range(1, n):
        alpha[k] = emission[k] + _lse(alpha[k - 1][:, None] + inner, 0)
    for k in range(n - 2, -1, -1):
        beta[k] = _lse(inner + (emission[k + 1] + beta[k + 1])[None], 1)
    z, out = _lse(alpha[-1], 0), np.empty(len(spans))
    for i, (begin, a, b) in enumerate(spans):
        inside, score = begin + 1, alpha[a, begin]
        for k in range(a + 1, b):
            score += inner[begin if k == a + 1 else inside, inside] + emission[k, inside]
        if b < n:  # what follows doesn't go on with the span
            after = inner[begin if b == a + 1 else inside] + emission[b] + beta[b]
            after[inside] = -1e30
            score += _lse(after, 0)
        out[i] = np.exp(min(0.0, score - z))
    return out


_STRIP = "\"'<>[]{},;:!?."
_CHECKS = (
    lambda s: (m := next(emails(s), None)) is not None and m == (0, len(s)),
    lambda s: re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", s) is not None and is_ip(s),
    is_card,
    is_phone,
)


def _parts(lines: list[tuple[int, int, str]]) -> Iterator[tuple]:
    """(owner, offset, line, tokens, first, end): spans that begin at tokens first..end-1 are this part's."""
    for owner, offset, line in lines:
        tokens, first = [], 0
        for m in _TOKEN.finditer(line):
            tokens.append((m.start(), m.end()))
            if len(tokens) == PART + 2 * OVERLAP:
                yield owner, offset, line, tokens, first, PART + OVERLAP
                tokens, first = tokens[PART:], OVERLAP
        if len(tokens) > first:
            yield owner, offset, line, tokens, first, len(tokens)


def _decode(rows: list[tuple], weights: np.ndarray, trans: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    rows.sort(key=lambda r: len(r[3]))
    k = 0
    while k < len(rows):
        shortest, j = len(rows[k][3]), k + 1
        while j < len(rows) and len(rows[j][3]) <= 2 * shortest + 8:
            j += 1
        part, k = rows[k:j], j
        length = np.array([len(r[3]) for r in part])
        emission = np.zeros((len(part), int(length.max()), _N))
        for i, (_, _, line, tokens, _, _) in enumerate(part):
            emission[i, : length[i]] = weights[np.array(features([line[x:y] for x, y in tokens]))].sum(axis=1)
        for i, labels in enumerate(viterbi(emission, length, trans)):
            owner, offset, line, tokens, first, end = part[i]
            n, spans = int(length[i]), []
            at = np.flatnonzero(labels[first:end] % 2) + first  # begins have odd numbers
            for a in at.tolist():
                b = a + 1
                while b < n and labels[b] == labels[a] + 1:
                    b += 1
                x, y = tokens[a][0], tokens[b - 1][1]
                while x < y and line[x] in _STRIP:
                    x += 1
                while x < y and line[y - 1] in _STRIP:
                    y -= 1
                kind = (int(labels[a]) - 1) // 2
                if x < y and _CHECKS[kind](line[x:y]):
                    spans.append((int(labels[a]), a, b, x, kind, y))
            if spans:
                sure = span_probabilities(emission[i, :n], trans, [r[:3] for r in spans]) >= LEAST
                yield from ((owner, offset + x, kind, offset + y) for (*_, x, kind, y), ok in zip(spans, sure.tolist(), strict=True) if ok)


def field_spans(lines: list[tuple[int, int, str]], weights: np.ndarray, trans: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(owner, start, kind, end) that the field finds in lines (owner, offset, text)."""
    found, rows, size = [], [], 0
    for row in _parts(lines):
        rows.append(row)
        size += len(row[3])
        if size >= BATCH:
            found += _decode(rows, weights, trans)
            rows, size = [], 0
    return found + list(_decode(rows, weights, trans))


_MARKS = np.zeros(256, bool)
_MARKS[[*range(0x30, 0x3A), 0x40]] = True
_SPAN = pa.struct([("kind", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def _find(batches: Iterator[pa.RecordBatch], text: str, weights: np.ndarray, trans: np.ndarray, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans: list[list] = [[] for _ in range(batch.num_rows)]
        for i, _, data, off in pieces(batch.column(text)):
            marked = np.flatnonzero(_MARKS[data])
            for r in np.flatnonzero(np.diff(np.searchsorted(marked, off))).tolist():
                s = data[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace")
                base = base_spans(s)
                lines, at = [], 0
                for line in s.split("\n"):
                    if re.search("[0-9@]", line):
                        lines.append((r, at, line))
                    at += len(line) + 1
                starts, reach = [x for x, _, _ in base], [0, *accumulate((y for _, _, y in base), max)]
                extra = [(a, kind, b) for _, a, kind, b in field_spans(lines, weights, trans) if reach[bisect_left(starts, b)] <= a]
                rows = sorted([(*x, True) for x in base] + [(*x, False) for x in extra])
                spans[i + r] = [{"kind": KINDS[k], "first": a, "end": b, "base": own} for a, k, b, own in rows]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, pa.list_(_SPAN))], names=[*batch.schema.names, name])


def find(docs: DataFrame, text_col: str = "text", name: str = "pii") -> DataFrame:
    """``docs`` with an array of (kind, first, end, base) spans under ``name``.

    Offsets are code points, end exclusive; spans go by start, then kind as in
    ``KINDS``.  base tells pattern spans from those that the field adds.

    Null or empty text: no spans.  Repeated rows and null ids: each row has its
    own result.  Overlapping spans of different kinds are all reported; a field
    span that touches a base span is not.  Empty table: no rows.  All columns
    pass through; ``name`` must not be taken.
    """
    if name in docs.columns:
        raise ValueError(f"column already there: {name}")
    weights, trans = train()
    added = T._parse_datatype_string(f"`{name}` array<struct<kind:string,first:long,end:long,base:boolean>>")
    return docs.mapInArrow(lambda it: _find(it, text_col, weights, trans, name), T.StructType(docs.schema.fields + added.fields))
