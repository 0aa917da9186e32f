"""The registered queries, each with an equivalent SQL text for the checking database."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tradebook.registry import analysis, audits, layouts, requests, rows, session, streams

Query = Callable[[SparkSession, str], DataFrame]

_PARTS = (analysis, rows, audits, requests, streams, session, layouts)


def queries() -> dict[str, Query]:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: text for part in _PARTS for name, text in part.ORACLES.items()}
