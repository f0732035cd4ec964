"""Mixing sources to target weights.

Documents get a hash-random key and are range-sorted by it within their source;
a distributed prefix sum of their sizes tells where each source's budget ends.
Prefix sums run in two levels: the leading hex digits of the key name a range
(`source`, `slot`), ranges are summed and accumulated per source, and only then
are the rows of one range ordered and accumulated.  A source with a third of
all rows is so spread over all of its ranges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trilayer.llm._spark import cut

#: Rows that one range should hold.
RANGE_ROWS = 20_000


def word_count(text: Column) -> Column:
    """Maximal runs of characters other than space and \\x09-\\x0D; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Budgets of sources from (source, source_size): adds ``target`` (double).

    Sources by code point, null last, take ``weights`` in turn and share the sum
    of all sizes; a target stops at ``most`` times its source's size and the
    excess goes to the others by weight until none is above.  Sources stop in
    the order of size over weight, so one ordered pass finds them: source i
    stops iff its limit over its weight is at most the level that the rest
    share.  The frame has one row per source.
    """
    every = Window.partitionBy()
    turn = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = Window.partitionBy().orderBy("ratio", "turn")
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    s = sizes.select("source", "source_size", F.row_number().over(turn).alias("turn"), w.alias("w"), (F.lit(most) * F.col("source_size")).cast("double").alias("most"))
    s = s.withColumn("ratio", F.col("most") / F.col("w"))
    s = s.select("*", (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))).alias("left_over"), F.sum("w").over(rest).alias("w_rest"))
    s = s.withColumn("stops", F.col("ratio") <= F.col("left_over") / F.col("w_rest"))
    # the first source that doesn't stop sets the level for itself and all after it
    first = F.min(F.when(~F.col("stops"), F.struct("ratio", "turn", "left_over", "w_rest"))).over(every)
    level = first["left_over"] * F.col("w") / first["w_rest"]
    open_ = first.isNotNull() & (F.struct("ratio", "turn") >= F.struct(first["ratio"], first["turn"]))
    return s.select("source", "source_size", F.when(open_, F.least("most", level)).otherwise(F.col("most")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, extra: tuple[str, ...] = ()) -> DataFrame:
    """Words that a mix of all sources takes from each row of ``docs``.

    Returns (id, [extra], size, source, source_size, target, taken); ids,
    sources and extra columns keep their values.  Each whole epoch
    that fits a source's target takes all of its rows; what is left is taken in
    key order, and the row on the border gives only the words up to the exact
    budget (the target rounded down).  The key is the md5 of the id, so reruns
    agree.

    Null text: size 0, takes 0.  Null source: a source of its own, last.  Null
    id: key of the empty text.  Repeated rows: each counts, ties go by size.
    Empty table: no rows.  Columns not named are left out, so none can clash.
    """
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_x{i}") for i, c in enumerate(extra)], F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"))
    rows = cut(rows)
    n = rows.count()
    digits = max(1, min(8, math.ceil(math.log(max(1, n / RANGE_ROWS), 16))))
    slot = F.substring("key", 1, digits)
    ranges = rows.groupBy("source", slot.alias("slot")).agg(F.sum("size").alias("slot_size"), F.count("*").alias("slot_rows"))
    ranges = cut(ranges)
    targets = source_targets(ranges.groupBy("source").agg(F.sum("slot_size").alias("source_size")), weights, most)
    along = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("source", "slot", F.coalesce(F.sum("slot_size").over(along), F.lit(0)).alias("before"))
    t, r = targets.alias("t"), ranges.alias("r")
    ranges = r.join(t, F.col("r.source").eqNullSafe(F.col("t.source"))).select(F.col("r.source").alias("source"), "slot", "before", "source_size", "target")
    inside = Window.partitionBy("source", "slot").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("slot", slot).withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    p, r = placed.alias("p"), ranges.alias("r")
    placed = p.join(r, F.col("p.source").eqNullSafe(F.col("r.source")) & (F.col("p.slot") == F.col("r.slot"))).select("p.*", "r.before", "r.source_size", "r.target")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    left = budget - epochs * F.col("source_size") - F.col("before") - F.col("inner")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return placed.select(F.col("_id").alias(id_col), *[F.col(f"_x{i}").alias(c) for i, c in enumerate(extra)], "size", "source", "source_size", "target", taken.cast("long").alias("taken"))
