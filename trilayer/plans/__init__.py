"""Plans: the derived tables that queries share, and the registered queries."""

from __future__ import annotations


def load_queries() -> tuple[dict, dict]:
    """(queries, SQL) of all operators outside ``llm``."""
    from trilayer.plans import io_queries, memory_queries, registry, retrieval_queries, text_queries  # noqa: F401  importing registers

    return registry.QUERIES, registry.SQL
