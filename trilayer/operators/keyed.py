"""Keyed tables: upsert, lookup, missing keys, deletion, status filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """``base`` with whole records replaced or added; of several changes the greatest version wins."""
    last = Window.partitionBy(key).orderBy(F.col(version).desc())
    new = changes.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return base.join(new.select(key), key, "left_anti").unionByName(new)


def lookup(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``base`` for (pos, key) in the order of pos; a missing key gives nulls."""
    return ids.select("pos", key).join(base, key, "left")


def missing_keys(ids: DataFrame, base: DataFrame, key: str) -> DataFrame:
    return ids.select(key).distinct().join(base.select(key), key, "left_anti")


def delete_ids(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``base`` without the given keys; absent ones don't matter."""
    return base.join(ids.select(key), key, "left_anti")


def by_status(table: DataFrame, statuses: list[str], column: str = "status") -> DataFrame:
    return table.where(F.col(column).isin(statuses))


def clear(table: DataFrame, namespace: str, by: str = "namespace") -> DataFrame:
    """What is left when a namespace is cleared; rows of no namespace stay."""
    return table.where(~F.col(by).eqNullSafe(F.lit(namespace)))
