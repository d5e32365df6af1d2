"""Helpers shared by the training-data operators: the shared folder, staging
of intermediate tables, range shards and skew-safe group minima.

Null keys lie in the first shard. Helper columns take names that the input lacks.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Keys that one task of ``ranges_of`` adds up.
RANGE_KEYS = 4_000_000
#: A group's rows are dealt over this many salts before they meet.
SALTS = 64


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see.

    It lies below ``spark.checkpoint.dir``. Only a local master, whose one
    process has one disk, may leave that unset.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="packlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{root.rstrip('/')}/packlake-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends
    there, so a lost executor costs no more than the files' next read."""
    path = shared_dir(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def discard(*staged: DataFrame | None) -> None:
    """Delete what ``stage`` wrote, once nothing reads it any more; other tables stay."""
    for df in staged:
        path = getattr(df, "_staged", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def fresh(taken: list[str], *names: str) -> list[str]:
    """``names``, lengthened until none is among the columns ``taken``, in any case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI (file, hdfs, s3, gs) or a plain path."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def publish(fs: pafs.FileSystem, temporary: str, final: str) -> None:
    """Rename a finished file. Two attempts of one task write the same bytes,
    so whichever comes last may replace the other's."""
    try:
        fs.move(temporary, final)
    except OSError:
        if fs.get_file_info(final).type == pafs.FileType.NotFound:
            raise
        fs.delete_file(temporary)


#: Bytes of rows that go to Python at once, where the session has Spark's default.
ARROW_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Send rows to Python in smaller Arrow batches: long texts are wide rows, and
    each batch is held by the JVM and by the worker. Settings made by the user stay."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(name)).rstrip("bB")) == 64 << 20:
        spark.conf.set(name, str(ARROW_BYTES))


def release() -> None:
    """Give a worker's unused memory back: it stays alive beside the next stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@dataclass(frozen=True)
class Ranges:
    """Ranges of an integer key, in order: all but the first begin at an edge."""

    edges: tuple[int, ...]

    @property
    def shards(self) -> int:
        return len(self.edges) + 1


def ranges_of(weights: DataFrame, shards: int) -> Ranges:
    """Ranges that cut a key into at most ``shards`` shards of about equal weight,
    the same on every run. ``weights`` has k, a long or null, and w.

    Weights are added up in key order: per range partition, over the partitions
    (one row each), then within each. A shard begins with the first key before
    which its share of the weight lies, so the driver gets one key for each shard.
    A key's rows stay in one shard.
    """
    rows = weights.where("k is not null").groupBy("k").agg(F.sum("w").alias("w"))
    count = rows.count()
    if not count:
        return Ranges(())
    tasks = max(1, -(-count // RANGE_KEYS))
    placed = stage(rows.repartitionByRange(tasks, "k").withColumn("p", F.spark_partition_id()), "ranges")
    parts = placed.groupBy("p").agg(F.sum("w").alias("whole"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("whole").over(before), F.lit(0)))
    total = parts.agg(F.sum("whole")).first()[0] or 1
    inside = Window.partitionBy("p").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    done = placed.withColumn("done", F.coalesce(F.sum("w").over(inside), F.lit(0))).join(parts, "p")
    shard = F.floor((F.col("base") + F.col("done")).cast("decimal(38,0)") * shards / F.lit(total).cast("decimal(38,0)"))
    found = done.groupBy(shard.alias("shard")).agg(F.min("k").alias("k")).orderBy("k").collect()
    discard(placed)
    return Ranges(tuple(r["k"] for r in found[1:]))


def shard_of(key: str, ranges: Ranges) -> Column:
    """The number of the shard that holds ``key``; nulls lie in the first.

    The edges are one literal array, in which the range is found by halving.
    """
    n, size = len(ranges.edges), 1
    if not n:
        return F.lit(0)
    while size < n:
        size *= 2
    edges = F.split(F.lit(",".join(map(str, ranges.edges))), ",").cast("array<bigint>")
    halves = F.array(*[F.lit(size >> i) for i in range(size.bit_length())])
    value = F.col(key).cast("long")
    place = F.aggregate(halves, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(edges, at + step - 1) <= value), at + step).otherwise(at))
    return F.when(value.isNull(), F.lit(0)).otherwise(place)


def group_min(df: DataFrame, keys: list[str], value: str, out: str, count: str | None = None) -> DataFrame:
    """``df`` with ``out``, the least ``value`` among rows of equal ``keys``, and
    on request ``count``, the number of these rows.

    A group may hold a third of all rows: rows carry a salt, are aggregated by
    key and salt, and the group's minimum returns to each of its at most
    ``SALTS`` pairs of key and salt, so no task meets a whole group.
    """
    salt, less, some, every, salts = fresh([*df.columns, out, *([count] if count else [])], "salt", "least", "some", "all", "salts")
    salted = df.withColumn(salt, F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int"))
    partial = salted.groupBy(*keys, salt).agg(F.min(value).alias(less), F.count(F.lit(1)).alias(some))
    least = partial.groupBy(*keys).agg(F.min(less).alias(out), F.sum(some).alias(every), F.collect_set(salt).alias(salts))
    more = [F.col(every).alias(count)] if count else []
    spread = least.select(*keys, out, *more, F.explode(salts).alias(salt))
    return salted.join(spread, [*keys, salt], "left").drop(salt)
