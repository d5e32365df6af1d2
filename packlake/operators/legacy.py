"""Archives of the older kind: listing, import queue, outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake.functions.names import parts
from packlake.schemas import IMPORT_RETRY_SECONDS


def archives(listing: DataFrame) -> DataFrame:
    """destination, archive, job, created of names that parse."""
    return listing.select("destination", F.inline(parts(F.col("archive"))))


def recent_failures(failures: DataFrame, now: Column) -> DataFrame:
    return failures.where(now - F.col("at") < IMPORT_RETRY_SECONDS).select("destination", "archive")


def import_queue(found: DataFrame, failures: DataFrame) -> DataFrame:
    """archive, created, destinations: what to import; an archive lies on a configured handful of
    destinations, so its list is short. ``in_order`` sorts it."""
    open_ = found.join(failures, ["destination", "archive"], "left_anti")
    return open_.groupBy("archive").agg(F.min("created").alias("created"), F.array_sort(F.collect_list("destination")).alias("destinations"))


def in_order(queue: DataFrame) -> DataFrame:
    return queue.orderBy(F.asc_nulls_first("created"), "archive")


def feeders(copies: DataFrame) -> DataFrame:
    """archive, feeder: the first copy that matches its checksum feeds all holders."""
    return copies.where("checksum = expected").groupBy("archive").agg(F.min_by("destination", "position").alias("feeder"))
