"""Conversation tables: messages (thread_id, turn, role, text) and threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trilayer.functions.text import collapse

# Roles that a stored message may have.
ROLES = ["user", "assistant"]


def titles(messages: DataFrame, most: int = 120, default: str = "New chat") -> DataFrame:
    """(thread_id, title): the first user message, collapsed and cut; none: the default."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    t = messages.groupBy("thread_id").agg(collapse(F.coalesce(first, F.lit(""))).alias("t"))
    cut = F.when(F.length("t") > most, F.concat(F.substring("t", 1, most), F.lit("…"))).otherwise(F.col("t"))
    return t.select("thread_id", F.when(F.col("t") == "", F.lit(default)).otherwise(cut).alias("title"))


def list_threads(threads: DataFrame, owner: str, limit: int, offset: int = 0) -> DataFrame:
    """An owner's threads, last updated first, with the total."""
    d = threads.where(F.col("owner") == owner)
    page = d.orderBy(F.col("updated_at").desc(), F.col("thread_id").desc()).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(d.agg(F.count("*").alias("total"))))


def thread_messages(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """Messages of the given threads, numbered in order."""
    n = F.row_number().over(Window.partitionBy("thread_id").orderBy("turn", "role", "text"))
    return messages.join(ids.select("thread_id"), "thread_id", "left_semi").withColumn("number", n)


def last_activity(messages: DataFrame) -> DataFrame:
    return messages.groupBy("thread_id").agg(F.max("turn").alias("updated_at"), F.count("*").alias("messages"))


def split_roles(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(F.col("role").isin(ROLES), F.lit(False))
    return messages.where(ok), messages.where(~ok)


def delete_threads(threads: DataFrame, messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Threads go with their messages."""
    gone = ids.select("thread_id")
    return threads.join(gone, "thread_id", "left_anti"), messages.join(gone, "thread_id", "left_anti")


def evict(messages: DataFrame, budget: int, tool_role: str = "tool") -> DataFrame:
    """Blank the oldest tool results until a thread fits: adds cost, evicted.

    A message costs its token estimate plus four; a tool result goes while the
    total minus what earlier ones saved is above the budget.
    """
    cost = F.greatest(F.lit(1), F.floor(F.length(F.coalesce("text", F.lit(""))) / 4)) + 4
    saved = F.when(F.col("role") == tool_role, F.col("cost") - 5).otherwise(F.lit(0))
    w = Window.partitionBy("thread_id")
    before = w.orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    m = messages.withColumn("cost", cost.cast("long"))
    over = F.sum("cost").over(w) - F.coalesce(F.sum(saved).over(before), F.lit(0)) > budget
    return m.withColumn("evicted", (F.col("role") == tool_role) & over)
