"""JSON lines: tagged events, result envelopes, and which file changes matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds of file events after which the configuration is read again.
RELOADING = ("create", "modify", "remove")


def event(kind: str, **fields: Column) -> Column:
    """A tagged JSON line."""
    return F.to_json(F.struct(F.lit(kind).alias("event"), *[c.alias(k) for k, c in fields.items()]))


def envelope(data: Column, error: Column | None = None) -> Column:
    """The last line of a command: ok with data, or the error."""
    error = F.lit(None).cast("string") if error is None else error
    return F.to_json(F.struct(error.isNull().alias("ok"), error.alias("error"), F.when(error.isNull(), data).alias("data")))


def parsed(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Lines as columns; fields that a line lacks are null, lines that aren't JSON go."""
    rows = lines.select(F.from_json(column, schema).alias("e")).where("e is not null")
    return rows.select("e.*")


def reloads(kind: Column, paths: Column, config: Column) -> Column:
    """Whether a file event concerns the configuration; events without paths do."""
    return kind.isin(*RELOADING) & ((F.size(paths) == 0) | F.array_contains(paths, config))
