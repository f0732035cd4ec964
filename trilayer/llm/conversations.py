"""Chat formatting by cumulative-snapshot collapse.

A chat logged after each turn leaves many conversations that are prefixes of a
longer one.  Every turn gets the rolling hash of the turns up to it; a
conversation whose whole hash is some other one's proper prefix goes (anti-join),
and of equal conversations the one with the smallest id stays.  What is left is
rendered.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _part(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)")


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text, p1, p2, n): each turn with the hash of its prefix.

    The rolling hash is the running sum of two 60-bit parts of the md5 of
    (position, md5 of the role, md5 of the text); position makes it depend on
    the order, and hashing each part keeps any character in them from moving
    the border between the two.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = turns.select("conv_id", "turn", "role", "text").withColumn("pos", F.row_number().over(order))
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    t = t.withColumn("d", F.md5(F.concat_ws("-", F.col("pos").cast("string"), F.md5(mark("role")), F.md5(mark("text")))))
    along = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("conv_id")
    return t.select(
        "conv_id", "pos", "role", "text",
        F.sum(_part(F.col("d"), 1)).over(along).alias("p1"),
        F.sum(_part(F.col("d"), 16)).over(along).alias("p2"),
        F.count("*").over(whole).alias("n"),
    )


def render(role: Column, text: Column) -> Column:
    """One turn in the role-marked template; a null role or text is empty."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def collapse(turns: DataFrame) -> DataFrame:
    """Maximal conversations of (conv_id, turn, role, text), rendered.

    Returns (conv_id, n_turns, n_copies, rendered): n_copies counts the equal
    conversations that this one stands for, itself included.

    Turns go by (turn, role, text), nulls first, so ties and repeated turns have
    one order; a repeated row is a turn of its own.  A null conv_id is a
    conversation of its own.  Null role or text differ from empty ones when
    conversations are compared and render as empty.  Empty table: no rows.
    Columns not named are left out, so none can clash.
    """
    t = turn_prefixes(turns)
    ends = t.where("pos = n").groupBy("pos", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = t.where("pos < n").select("pos", "p1", "p2").distinct()
    kept = ends.join(inner, ["pos", "p1", "p2"], "left_anti").select("conv_id", "n_copies")
    k, a = kept.alias("k"), t.alias("a")
    rows = a.join(k, F.col("a.conv_id").eqNullSafe(F.col("k.conv_id"))).select("a.conv_id", "pos", "n_copies", render(F.col("role"), F.col("text")).alias("piece"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "")
    return rows.groupBy("conv_id", "n_copies").agg(F.count("*").alias("n_turns"), whole.alias("rendered")).select("conv_id", "n_turns", "n_copies", "rendered")
