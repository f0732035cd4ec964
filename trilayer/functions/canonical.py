"""Matching keys of labels.

ASCII labels are folded by Spark's own functions.  Others need Unicode
normalisation, which Spark lacks: their distinct values go through one Arrow
step and are joined back, so Python sees each label once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trilayer.functions.session import materialise
from trilayer.functions.text import FOLD_FROM, FOLD_TO, FOLD_WIDE, collapse, fold_answer

_TABLE = str.maketrans(dict(zip(FOLD_FROM, FOLD_TO, strict=True)) | FOLD_WIDE)


def _without_marks(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def _key(s: str) -> str:
    return " ".join(_without_marks(unicodedata.normalize("NFKC", s).translate(_TABLE)).casefold().split())


#: Whitespace of ASCII labels but the blank, and what typography folds; two blanks.
_ODD = ["  ", "`", *"\t\n\x0b\f\r\x1c\x1d\x1e\x1f"]


def _ascii_key(c: Column) -> Column:
    """Most labels hold nothing to fold but case: they need no pattern."""
    odd = F.contains(c, F.lit(_ODD[0]))
    for x in _ODD[1:]:
        odd = odd | F.contains(c, F.lit(x))
    return F.lower(F.when(odd, collapse(F.translate(c, "`", "'"))).otherwise(F.trim(c)))


def _map_labels(df: DataFrame, pairs: dict[str, str], ascii_form: Callable[[Column], Column], python_form: Callable[[str], str]) -> DataFrame:
    """Add ``pairs`` (column: new column); only distinct non-ASCII labels pass through Python."""
    plain = lambda c: ~F.rlike(c, F.lit(r"[^\x00-\x7f]"))
    labels = df.select(F.explode(F.array(*[F.col(c) for c in pairs])).alias("_label")).where(F.col("_label").isNotNull() & ~plain(F.col("_label"))).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(_form=b["_label"].map(python_form))

    forms = materialise(labels.mapInPandas(run, "_label string, _form string"))
    if forms.isEmpty():
        return df.withColumns({new: F.coalesce(ascii_form(F.col(c)), F.lit("")) for c, new in pairs.items()})
    out = df
    for c, new in pairs.items():
        f = forms.select(F.col("_label").alias(f"_l_{new}"), F.col("_form").alias(f"_f_{new}"))
        out = out.join(f, F.col(c) == F.col(f"_l_{new}"), "left")
        out = out.withColumn(new, F.when(F.col(c).isNull(), F.lit("")).when(plain(F.col(c)), ascii_form(F.col(c))).otherwise(F.col(f"_f_{new}"))).drop(f"_l_{new}", f"_f_{new}")
    return out


def canonical(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Add matching keys: compatibility form, typography, accents, case and whitespace folded. Null: empty."""
    return _map_labels(df, pairs, _ascii_key, _key)


def canonical_triples(triples: DataFrame) -> DataFrame:
    """Add head_key, rel_key and tail_key to (head, relation, tail)."""
    return canonical(triples, {"head": "head_key", "relation": "rel_key", "tail": "tail_key"})


def strip_accents(df: DataFrame, column: str, new: str) -> DataFrame:
    """Add ``new``: the column without combining marks."""
    return _map_labels(df, {column: new}, lambda c: c, _without_marks)


def nfkc(df: DataFrame, column: str, new: str) -> DataFrame:
    """Add ``new``: the column's compatibility form."""
    return _map_labels(df, {column: new}, lambda c: c, lambda s: unicodedata.normalize("NFKC", s))


def compatible(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with strings and string arrays folded and in their compatibility form, null ones as they are.

    Texts pass whole through one Arrow step; those that are normal already, as
    ASCII ones are, stay as they are.
    """
    kinds = {c: isinstance(df.schema[c].dataType, T.ArrayType) for c in columns}
    fold = lambda c: F.when(F.col(c).isNotNull(), F.transform(c, lambda x: F.when(x.isNotNull(), fold_answer(x))) if kinds[c] else fold_answer(F.col(c)))
    df = df.withColumns({c: fold(c) for c in columns})

    def form(column: pa.Array) -> pa.Array:
        at = np.flatnonzero(~pc.fill_null(pc.string_is_ascii(column), True).to_numpy(zero_copy_only=False))
        at = [(i, x) for i, x in zip(at.tolist(), column.take(pa.array(at)).to_pylist(), strict=True) if not unicodedata.is_normalized("NFKC", x)]
        if not at:
            return column
        other = np.zeros(len(column), bool)
        other[[i for i, _ in at]] = True
        return pc.replace_with_mask(column, pa.array(other), pa.array([unicodedata.normalize("NFKC", x) for _, x in at], column.type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, col in zip(b.schema.names, b.columns, strict=True):
                if kinds.get(name):
                    length = pc.fill_null(pc.list_value_length(col), 0).to_numpy()
                    offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
                    col = pa.ListArray.from_arrays(pa.array(offsets), form(col.flatten()), mask=col.is_null())
                elif name in kinds:
                    col = form(col)
                out.append(col)
            yield pa.RecordBatch.from_arrays(out, names=b.schema.names)

    return df.mapInArrow(run, df.schema)
