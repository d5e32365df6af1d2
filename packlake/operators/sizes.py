"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast; beyond it Spark picks the join.
SMALL_ROWS = 20_000


def small(side: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``side`` marked for broadcast if it has at most ``rows`` rows, by count."""
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side


def one_row(side: DataFrame) -> DataFrame:
    """The single row of a global aggregate, marked for broadcast."""
    return F.broadcast(side)
