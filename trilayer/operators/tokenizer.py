"""A hook for tokenizers: token borders come from a user's tokenizer, texts are cut at them.

A tokenizer is a small object that is sent to the workers and gives, for a
batch of texts, the character offsets at which tokens begin and end.  Windows,
counts and cuts use offsets alone, so what they return is always a part of the
text itself.  Whitespace tokens without a hook stay column functions
(``functions.text.word_tokens``, ``chunking.chunk_fixed``).
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Tokenizer(Protocol):
    def offsets(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text where its tokens begin and end, in characters."""


@dataclass(frozen=True)
class PatternTokens:
    """Tokens are the matches of a pattern; runs without ASCII blanks if none is given."""

    pattern: str = r"[^ \t\n\x0b\f\r]+"

    def offsets(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        find = re.compile(self.pattern).finditer
        spans = [np.array([m.span() for m in find(t)], np.int64).reshape(-1, 2) for t in texts]
        return [(s[:, 0], s[:, 1]) for s in spans]


@dataclass(frozen=True)
class BytePairTokens:
    """Byte pairs by a file of ranks (base64 and rank a line) and a pattern of pieces.

    Its tokens cover the text without gaps.  A token that ends inside a character
    ends in front of it, so some may be empty and every cut is between characters.
    ``path`` must be readable by every executor.
    """

    path: str
    pattern: str

    @cached_property
    def _encoding(self):  # noqa: ANN202
        import tiktoken

        with open(self.path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})

    def __getstate__(self) -> dict:
        return {"path": self.path, "pattern": self.pattern}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._encoding.encode_ordinary(t) for t in texts]

    def decode(self, tokens: list[list[int]]) -> list[str]:
        return [self._encoding.decode(t) for t in tokens]

    def offsets(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for text, tokens in zip(texts, self.encode(texts), strict=True):
            first = np.array(self._encoding.decode_with_offsets(tokens)[1], np.int64)
            out.append((first, np.append(first[1:], len(text))[: len(first)]))
        return out


def _mapped(df: DataFrame, text_col: str, schema: T.StructType, one: Callable[[str, np.ndarray, np.ndarray], list[tuple]], tokenizer: Tokenizer) -> DataFrame:
    """Rows of ``df`` without its texts but with what ``one`` gives for each (null: nothing), any number of rows."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for i, text in enumerate(b.column(at).to_pylist()):
                if text is not None:
                    for r in one(text, *tokenizer.offsets([text])[0]):
                        rows.append(i), found.append(r)
            kept = [c.take(pa.array(rows, pa.int64())) for k, c in enumerate(b.columns) if k != at]
            new = [pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=schema.names)

    return df.mapInArrow(run, schema)


def chunk_tokens(docs: DataFrame, tokenizer: Tokenizer, size: int, overlap: int = 0, id_col: str = "doc_id", text_col: str = "text", strip: bool = True) -> DataFrame:
    """Windows of ``size`` tokens every size - overlap: (id, chunk_order, tokens, content).

    Content is the text from the first token's begin to the last one's end,
    blanks at its ends aside with ``strip``.  Null and blank texts give none.
    """
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the window")

    def one(text: str, first: np.ndarray, last: np.ndarray) -> list[tuple]:
        if not text.strip():
            return []
        out = []
        for order, a in enumerate(range(0, len(first), size - overlap)):
            b = min(a + size, len(first))
            content = text[first[a] : last[b - 1]]
            out.append((order, b - a, content.strip() if strip else content))
        return out

    schema = T.StructType([docs.schema[id_col], T.StructField("chunk_order", T.IntegerType()), T.StructField("tokens", T.IntegerType()), T.StructField("content", T.StringType())])
    return _mapped(docs.select(id_col, text_col), text_col, schema, one, tokenizer)


def token_counts(docs: DataFrame, tokenizer: Tokenizer, most: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens, kept): tokens of each text and the text up to its ``most``-th token; null text: 0 and null."""
    cut = lambda text, last: text if most is None or len(last) <= most else text[: last[most - 1]] if most else ""
    rows = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias(text_col), F.col(text_col).isNull().alias("_none"))
    schema = T.StructType([docs.schema[id_col], T.StructField("_none", T.BooleanType()), T.StructField("_row", T.IntegerType()), T.StructField("tokens", T.IntegerType()), T.StructField("kept", T.StringType())])
    out = _mapped(rows, text_col, schema, lambda text, first, last: [(0, len(first), cut(text, last))], tokenizer)
    return out.select(id_col, "tokens", F.when(~F.col("_none"), F.col("kept")).alias("kept"))
