"""Queries over the driver tables and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import build, cards, graph, search, store, streams, tables, temporal, text

_PARTS = (temporal, store, text, search, graph, tables, cards, streams, build)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for part in _PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for part in _PARTS for name, q in part.ORACLES.items()}
