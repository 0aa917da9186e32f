"""Text predicates shared by the filters of reports and request operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def equals(column: str, value: str, collation: str | None = None) -> Column:
    """Equality; binary unless a collation such as ``UTF8_LCASE`` or ``UNICODE_CI_AI`` is named."""
    if collation is None:
        return F.col(column) == F.lit(value)
    return F.collate(F.col(column), collation) == F.collate(F.lit(value), collation)


def contains_pattern(column: str, part: str) -> Column:
    """Substring match of the trimmed text, in which ``%`` and ``_`` stay wildcards."""
    return F.col(column).like("%" + part.strip(" ") + "%")


def is_blank(column: Column) -> Column:
    """Given but empty once spaces are trimmed."""
    return F.coalesce(F.trim(column) == "", F.lit(False))


def byte_length_is_not(column: Column, size: int) -> Column:
    """NULL, or of another length in bytes once spaces are trimmed."""
    return F.coalesce(F.octet_length(F.trim(column)) != size, F.lit(True))
