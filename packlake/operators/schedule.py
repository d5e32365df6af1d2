"""Slots: the latest one due for each job, and retries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packlake.functions.durations import Cron


def slot_table(spark: SparkSession, jobs: list[tuple[str, str]], now: datetime) -> DataFrame:
    """job, slot: each configured job's latest slot not after ``now``."""
    rows = [(name, Cron(cron).previous(now)) for name, cron in jobs]
    return spark.createDataFrame(rows, "job string, slot timestamp_ntz")


def daily_slot(at: Column, hour: int) -> Column:
    """The latest daily slot not after a time, as NTZ."""
    shifted = at - F.expr(f"interval {int(hour)} hours")
    return F.date_trunc("day", shifted).cast("timestamp_ntz") + F.expr(f"interval {int(hour)} hours")


def latest_slots(slots: DataFrame, now: Column) -> DataFrame:
    """job, slot: many missed slots count as the latest one."""
    return slots.where(F.col("slot") <= now).groupBy("job").agg(F.max("slot").alias("slot"))


def unhandled(slots: DataFrame, schedule: DataFrame) -> DataFrame:
    """Slots later than what each job last ran; all of those that never ran."""
    return slots.join(schedule, "job", "left").where(F.col("last").isNull() | (F.col("last") < F.col("slot"))).select("job", "slot")


def due(slots: DataFrame, retries: DataFrame, now: Column) -> DataFrame:
    """Unhandled slots to run: a retry holds back its own slot only, until it is due."""
    held = retries.select("job", F.col("slot").alias("retry_slot"), "next_retry")
    joined = slots.join(held, "job", "left")
    waits = F.coalesce((F.col("retry_slot") == F.col("slot")) & (F.col("next_retry") > now), F.lit(False))
    return joined.withColumn("due", ~waits).select("job", "slot", "due")


def next_check(next_due: Column, now: Column, pause: int = 60) -> Column:
    return F.least(F.coalesce(next_due, now + pause), now + pause)
