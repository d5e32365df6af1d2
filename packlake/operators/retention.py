"""Retention: milestones stay, of the rest the newest or the youngest."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packlake.schemas import MILESTONE_DAYS


def age_days(created: Column, now: datetime) -> Column:
    """Whole days, rounded towards zero."""
    seconds = F.unix_timestamp(F.lit(now).cast("timestamp_ntz").cast("timestamp")) - F.unix_timestamp(created.cast("timestamp"))
    return F.expr("cast(0 as bigint)") + F.floor(seconds / 86_400)


def bucket(days: Column) -> Column:
    """Milestone of an age: null while young, then ever wider, then by year."""
    *first, year = MILESTONE_DAYS
    out = F.when(days >= year, F.lit(len(first)) + F.floor((days - year) / 365))
    for i in range(len(first) - 1, -1, -1):
        out = out.when(days >= first[i], F.lit(i))
    return out.cast("bigint")


def judged(snapshots: DataFrame, now: datetime) -> DataFrame:
    """``snapshots`` with ``bucket`` and ``keeper``, the oldest of its bucket.

    Of equally old ones the greatest name is the keeper.
    """
    aged = snapshots.withColumn("bucket", bucket(age_days(F.col("created"), now)))
    order = Window.partitionBy("job", "bucket").orderBy("created", F.desc("name"))
    return aged.withColumn("keeper", F.col("bucket").isNotNull() & (F.row_number().over(order) == 1))


def milestone_keepers(snapshots: DataFrame, now: datetime) -> DataFrame:
    return judged(snapshots, now).where("keeper").select("job", "name", "bucket")


def removals_by_count(snapshots: DataFrame, now: datetime, count: int) -> DataFrame:
    """Names beyond each job's newest ``count``; milestones are exempt and don't count."""
    order = Window.partitionBy("job", "keeper").orderBy(F.desc("created"), F.desc("name"))
    ranked = judged(snapshots, now).withColumn("rn", F.row_number().over(order))
    return ranked.where(~F.col("keeper") & (F.col("rn") > count)).select("job", "name")


def removals_by_age(snapshots: DataFrame, now: datetime, seconds: int) -> DataFrame:
    """Names older than the limit; milestones are exempt."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {int(seconds)} seconds")
    return judged(snapshots, now).where(~F.col("keeper") & (F.col("created") < cutoff)).select("job", "name")


def apply(snapshots: DataFrame, now: datetime, count: int | None = None, seconds: int | None = None) -> DataFrame:
    """The snapshots that stay; all of them without a rule."""
    if count is None and seconds is None:
        return snapshots
    gone = removals_by_count(snapshots, now, count) if count is not None else removals_by_age(snapshots, now, seconds)
    return snapshots.join(gone, ["job", "name"], "left_anti")
