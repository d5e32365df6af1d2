"""Runs and deliveries: reads, and changes as new versions of the tables.

Parquet has no row update, so a change is a function from tables to tables; the
caller writes the result as the next version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake.functions.names import renamed, retry_delay


# -- reads

def due(deliveries: DataFrame, now: Column) -> DataFrame:
    return deliveries.where(~F.col("delivered") & (F.col("next_retry") <= now))


def pending(runs: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Open deliveries with their runs, by run time and destination."""
    return runs.join(deliveries.where("not delivered"), "run_id").orderBy("created_at", "destination")


def next_due(deliveries: DataFrame) -> DataFrame:
    """One row; null when nothing is open."""
    return deliveries.where("not delivered").agg(F.min("next_retry").alias("next_due"))


def status(runs: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Runs that aren't complete with their open deliveries, 0 included."""
    counts = deliveries.where("not delivered").groupBy("run_id").agg(F.count(F.lit(1)).alias("pending"))
    open_runs = runs.where("completed_at is null").join(counts, "run_id", "left")
    return open_runs.withColumn("pending", F.coalesce("pending", F.lit(0).cast("bigint")))


def ready(runs: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Incomplete runs without open deliveries, those without any included."""
    return runs.where("completed_at is null").join(deliveries.where("not delivered"), "run_id", "left_anti")


def history(runs: DataFrame, job: str | None = None) -> DataFrame:
    """Completed runs; ``orderBy`` newest completion first where order matters."""
    out = runs.where("completed_at is not null")
    return out if job is None else out.where(F.col("job") == job)


def purgeable(runs: DataFrame, cutoff: Column) -> DataFrame:
    return runs.where(F.col("completed_at") < cutoff)


def outcome(deliveries: DataFrame) -> DataFrame:
    """run_id, delivered, failed, ok, errors: a run is lost only if all fail."""
    failed = ~F.col("delivered")
    return deliveries.groupBy("run_id").agg(
        F.count_if("delivered").alias("delivered"),
        F.count_if(failed).alias("failed"),
        (F.count_if("delivered") > 0).alias("ok"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(failed, F.struct("destination", "last_error")))), lambda x: F.concat_ws(": ", x["destination"], x["last_error"])), "; ").alias("errors"),
    )


# -- changes

def registered(run: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Deliveries of new runs (run_id, destinations): done, failed with a first
    retry, or pending at once where no result came in (run_id, destination, ok, error)."""
    wanted = run.select("run_id", F.explode("destinations").alias("destination"))
    joined = wanted.join(results, ["run_id", "destination"], "left")
    return joined.select(
        "run_id",
        "destination",
        F.coalesce("ok", F.lit(False)).alias("delivered"),
        F.when(F.col("ok").isNull(), 0).otherwise(1).alias("attempts"),
        F.when(F.col("ok").isNull(), now).when(~F.col("ok"), now + retry_delay(F.lit(1))).alias("next_retry"),
        F.when(~F.col("ok"), F.col("error")).alias("last_error"),
    )


def marked(deliveries: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Deliveries after attempts (run_id, destination, ok, error); results of
    deliveries that aren't there change nothing."""
    joined = deliveries.join(results, ["run_id", "destination"], "left")
    tried, failed = F.col("ok").isNotNull(), F.col("ok").isNotNull() & ~F.col("ok")
    attempts = F.when(tried, F.col("attempts") + 1).otherwise(F.col("attempts"))
    return joined.select(
        "run_id",
        "destination",
        F.coalesce("ok", "delivered").alias("delivered"),
        attempts.alias("attempts"),
        F.when(failed, now + retry_delay(attempts)).otherwise(F.col("next_retry")).alias("next_retry"),
        F.when(failed, F.col("error")).when(tried, F.lit(None)).otherwise(F.col("last_error")).alias("last_error"),
    )


def completed(runs: DataFrame, deliveries: DataFrame, now: Column) -> DataFrame:
    """Runs, with those that are ready complete as of ``now``."""
    done = ready(runs, deliveries).select("run_id", F.lit(True).alias("done"))
    joined = runs.join(done, "run_id", "left")
    return joined.withColumn("completed_at", F.when(F.col("done"), now).otherwise(F.col("completed_at"))).drop("done")


def purged(runs: DataFrame, deliveries: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    gone = purgeable(runs, cutoff).select("run_id")
    return runs.join(gone, "run_id", "left_anti"), deliveries.join(gone, "run_id", "left_anti")


def forgotten(runs: DataFrame, deliveries: DataFrame, job: str) -> tuple[DataFrame, DataFrame]:
    """Without the job's incomplete runs; its history stays."""
    gone = runs.where((F.col("job") == job) & F.col("completed_at").isNull()).select("run_id")
    return runs.join(gone, "run_id", "left_anti"), deliveries.join(gone, "run_id", "left_anti")


def upserted(table: DataFrame, changes: DataFrame, keys: list[str], delete: Column | None = None) -> DataFrame:
    """``table`` with changed rows put in place of those with their keys."""
    kept = table.join(changes.select(*keys), keys, "left_anti")
    return kept.unionByName(changes if delete is None else changes.where(~delete).select(*table.columns))


def renamed_job(runs: DataFrame, deliveries: DataFrame, schedule: DataFrame, old: str, new: str, moves: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs and deliveries move to the new name; the schedule is copied unless
    there is one. ``moves`` (destination, target) tells folders that follow."""
    own = F.col("job") == old
    runs_out = runs.withColumns({"archive_name": F.when(own, F.coalesce(renamed(F.col("archive_name"), old, new), "archive_name")).otherwise(F.col("archive_name")), "job": F.when(own, new).otherwise(F.col("job"))})
    deliveries_out = deliveries
    if moves is not None:
        mine = runs.where(own).select("run_id", F.lit(True).alias("mine"))
        deliveries_out = deliveries.join(mine, "run_id", "left").join(moves, "destination", "left")
        deliveries_out = deliveries_out.withColumn("destination", F.when(F.col("mine"), F.coalesce("target", "destination")).otherwise(F.col("destination"))).select(*deliveries.columns)
    copied = schedule.where(own).withColumn("job", F.lit(new)).join(schedule.select("job"), "job", "left_anti")
    return runs_out, deliveries_out, schedule.unionByName(copied)


def blocked_rename(runs: DataFrame, deliveries: DataFrame, job: str) -> DataFrame:
    """One row: whether open deliveries forbid renaming the job."""
    return pending(runs, deliveries).agg((F.count_if(F.col("job") == job) > 0).alias("blocked"))
