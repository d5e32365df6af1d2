"""The control loop as streams: dedup, failure counts, stalls, hourly ticks."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packlake.schemas import BACKOFF_SECONDS, STATE_ERROR_SECONDS

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 64) -> DataFrame:
    """The event table as a stream; its folder also holds other tables."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", str(files_per_trigger)).parquet(sf_dir)


def distinct(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once over the whole stream; the state holds all keys seen."""
    return stream.select(*keys).dropDuplicates(keys)


def distinct_within(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Each key once within a delay; older keys leave the state."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def failures(stream: DataFrame, job: str, failed: Column) -> DataFrame:
    return stream.groupBy(F.col(job).alias("job")).agg(F.count_if(failed).alias("failures"))


def drained(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """The result over everything there is now, read from a folder that all
    executors share; its checkpoint lies beside it. In complete mode the last
    batch's table counts."""
    spark = stream.sparkSession
    root = f"{shared_root(spark)}/stream-{name}-{uuid.uuid4().hex}"
    if mode == "append":
        to_folder(stream, f"{root}/rows", f"{root}/checkpoint")
    else:
        each_batch(stream, lambda rows, _: rows.write.mode("overwrite").parquet(f"{root}/rows"), f"{root}/checkpoint", mode=mode)
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local master, which has one disk, may leave it unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="packlake-")
    return root.rstrip("/")


def to_folder(stream: DataFrame, path: str, checkpoint: str) -> None:
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None, mode: str = "append") -> None:
    """Run ``step`` on every micro-batch: once over what is there, or forever."""
    writer = stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)
    writer.start().awaitTermination()


def retries(stream: DataFrame, job: str, failed: str, time: str) -> DataFrame:
    """job, attempts, next_retry after each batch: failures grow the delay and a
    success clears it. ``failed`` is a boolean column, ``time`` epoch seconds."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        attempts = state.get[0] if state.exists else 0
        last = 0
        for frame in frames:
            for bad, at in frame.sort_values("at")[["failed", "at"]].itertuples(index=False):
                attempts, last = (attempts + 1 if bad else 0), at
        state.update((attempts,))
        wait = BACKOFF_SECONDS[min(attempts, len(BACKOFF_SECONDS)) - 1] if attempts else None
        yield pd.DataFrame({"job": [key[0]], "attempts": [attempts], "next_retry": pd.array([last + wait if wait else None], dtype="Int64")})

    rows = stream.select(F.col(job).cast("bigint").alias("job"), F.col(failed).alias("failed"), F.col(time).cast("bigint").alias("at"))
    return rows.groupBy("job").applyInPandasWithState(update, "job bigint, attempts int, next_retry bigint", "attempts int", "update", "NoTimeout")


def gaps(events: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """Pauses longer than the limit; ``gap`` in whole seconds, halves to the even one as SQL casts."""
    before = F.lag(time).over(Window.partitionBy(key).orderBy(time))
    exact = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return events.select(key, time, F.rint(exact / 1_000_000).cast("bigint").alias("gap")).where(F.col("gap") > seconds)


def hourly(events: DataFrame, time: str, kind: str) -> DataFrame:
    return events.groupBy(F.date_trunc("hour", time).cast("timestamp_ntz").alias("hour"), kind).agg(F.count(F.lit(1)).alias("n"))


def kept_running(step: Callable[[], None], failed: Callable[[Exception], None], stop: Callable[[], bool], pause: float = STATE_ERROR_SECONDS, sleep: Callable[[float], None] = time.sleep) -> None:
    """Run ``step`` until ``stop`` says so. An error ends no loop: it is told, and
    the step rests for a while, so that a lasting one doesn't run at every tick."""
    while not stop():
        try:
            step()
        except Exception as e:  # noqa: BLE001  whatever it is, the loop goes on
            failed(e)
            sleep(pause)
