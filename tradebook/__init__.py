"""Retail analytics and change processing as Spark jobs."""

from tradebook.schema import KEYS, SCHEMAS, Tables

__all__ = ["KEYS", "SCHEMAS", "Tables"]
