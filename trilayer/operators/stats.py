"""Operational statistics over request and call logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_rank(df: DataFrame, col: str, qs: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """The ceil(q n)-th smallest value for each q (named p50 ...), 0 for no rows."""
    aggs = [F.coalesce(F.expr(f"percentile_disc({q}) within group (order by `{col}`)"), F.lit(0.0)).alias(f"p{round(100 * q)}") for q in qs]
    return df.groupBy(*(by or [])).agg(*aggs)


def latency_summary(log: DataFrame, by: list[str], col: str = "value") -> DataFrame:
    """count, mean, p50, p95, p99, min, max."""
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by `{col}`)")
    return log.groupBy(*by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.min(col).alias("min"), F.max(col).alias("max"))


def throughput(log: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    """Requests a second between the first and the last, errors counted too."""
    wall = (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / 1e6
    return log.groupBy(*by).agg(F.count("*").alias("requests"), F.coalesce(F.count("*") / F.nullif(wall, F.lit(0.0)), F.lit(0.0)).alias("per_second"))


def cost_per_query(calls: DataFrame) -> DataFrame:
    """Calls and tokens a query of (query_id, tokens); no query: 0."""
    q = F.nullif(F.count_distinct("query_id"), F.lit(0))
    return calls.agg(F.coalesce(F.count("*") / q, F.lit(0.0)).alias("calls_per_query"), F.coalesce(F.sum("tokens") / q, F.lit(0.0)).alias("tokens_per_query"))
