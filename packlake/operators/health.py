"""Health: problems of each job from its schedule, deliveries, checks and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake.functions.names import parsed_job
from packlake.schemas import BUSY_GRACE_SECONDS, GRACE_SECONDS, OVERDUE_SECONDS, VERIFY_SECONDS


def problem(rows: DataFrame, text: Column) -> DataFrame:
    return rows.select("job", text.alias("problem"))


def missed(slots: DataFrame, schedule: DataFrame, now: Column, busy: bool) -> DataFrame:
    """Jobs whose latest slot wasn't run within the grace time (epoch seconds)."""
    grace = BUSY_GRACE_SECONDS if busy else GRACE_SECONDS
    joined = slots.join(schedule, "job", "left")
    late = (F.col("last").isNull() | (F.col("last") < F.col("slot"))) & (now - F.col("slot") > grace)
    return problem(joined.where(late), F.lit("missed its schedule"))


def undelivered(runs: DataFrame, deliveries: DataFrame, now: Column) -> DataFrame:
    """Jobs with deliveries that stay open beyond the grace time."""
    rows = runs.join(deliveries.where("not delivered"), "run_id").where(now - F.col("created_at") > GRACE_SECONDS)
    return problem(rows.groupBy("job").agg(F.count(F.lit(1)).alias("n")), F.concat(F.col("n").cast("string"), F.lit(" deliveries pending")))


def overdue(destinations: DataFrame, verified: DataFrame, now: Column, limit: int = OVERDUE_SECONDS) -> DataFrame:
    """job, destination pairs whose last verification is too long ago. What was
    never verified has just been seen, so its clock starts now."""
    rows = destinations.join(verified, "destination").where(now - F.col("at") > limit)
    return problem(rows, F.concat(F.lit("verification overdue: "), F.col("destination").cast("string")))


def verify_failed(destinations: DataFrame, problems: DataFrame) -> DataFrame:
    return problem(destinations.join(problems, "destination"), F.concat(F.col("destination").cast("string"), F.lit(": "), F.col("problem")))


def import_failed(jobs: DataFrame, failures: DataFrame) -> DataFrame:
    """Failures belong to the job that their archive's name tells."""
    named = failures.withColumn("job", parsed_job(F.col("archive"))).join(jobs.select("job"), "job", "left_semi")
    return problem(named, F.concat(F.lit("import failed: "), F.col("archive")))


def shrank(shrunk: DataFrame) -> DataFrame:
    return problem(shrunk, F.concat(F.lit("shrank from "), F.col("previous_size").cast("string"), F.lit(" to "), F.col("size").cast("string")))


def report(jobs: DataFrame, problems: list[DataFrame]) -> DataFrame:
    """job, healthy, problems: every configured job with its sorted problems."""
    found = problems[0]
    for more in problems[1:]:
        found = found.unionByName(more)
    listed = found.groupBy("job").agg(F.array_sort(F.collect_list("problem")).alias("problems"))
    none = F.array().cast("array<string>")
    return jobs.select("job").join(listed, "job", "left").select("job", F.col("problems").isNull().alias("healthy"), F.coalesce("problems", none).alias("problems"))


def orphans(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """job, pending: open runs of jobs that left the configuration."""
    return runs.join(jobs.select("job"), "job", "left_anti").groupBy("job").agg(F.count(F.lit(1)).alias("pending"))


def first_to_verify(destinations: DataFrame, verified: DataFrame, now: Column) -> DataFrame:
    """The first configured destination that is due, at most one row."""
    rows = destinations.join(verified, "destination").where(now - F.col("at") >= VERIFY_SECONDS)
    return rows.orderBy("position").limit(1).select("destination")


def maintenance_step(destinations: DataFrame, verified: DataFrame, now: Column) -> DataFrame:
    """destination, at, verify: the table of checks after one step. What is seen for
    the first time starts its clock now; the first destination that is due, at most
    one, is verified, and the attempt's time is kept whatever comes of it."""
    seen = destinations.join(verified, "destination", "left").withColumn("at", F.coalesce("at", now))
    chosen = first_to_verify(seen.select("destination", "position"), seen.select("destination", "at"), now)
    marked = seen.join(chosen.withColumn("verify", F.lit(True)), "destination", "left").withColumn("verify", F.coalesce("verify", F.lit(False)))
    return marked.select("destination", F.when(F.col("verify"), now).otherwise(F.col("at")).alias("at"), "verify")
