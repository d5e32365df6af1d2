"""Catalog scans: changes between two, hard links, exclusions, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packlake.functions.ignore import excluded
from packlake.operators.sizes import one_row, small
from packlake.schemas import CHANGED_PATHS_SHOWN, STALE_PARTIAL_SECONDS


def fingerprint() -> Column:
    """A hash of a file row; every part is length-prefixed, so parts can't shift."""
    parts = [F.col(c).cast("string") for c in ("kind", "len", "dev", "ino", "nlink", "mtime", "mtime_ns", "ctime", "ctime_ns", "mode", "uid", "gid", "link_target")]
    sized = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    attrs = F.transform(
        F.array_sort("xattrs"), lambda x: F.concat(F.octet_length(x["name"]).cast("string"), F.lit(":"), x["name"], F.octet_length(x["value"]).cast("string"), F.lit(":"), F.hex(x["value"]))
    )
    return F.sha2(F.concat_ws("|", *sized, F.array_join(F.coalesce(attrs, F.array().cast("array<string>")), "|")), 256)


def changed_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths that came, went or differ between two scans (path, hash)."""
    old, new = before.select("path", F.col("hash").alias("old")), after.select("path", F.col("hash").alias("new"))
    return old.join(new, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("path", "old", "new")


def changed_summary(changes: DataFrame, shown: int = CHANGED_PATHS_SHOWN) -> DataFrame:
    """total and the first paths; only ``shown`` rows are ever gathered."""
    some = changes.select("path").orderBy("path").limit(shown).agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return changes.agg(F.count(F.lit(1)).alias("total")).join(one_row(some))


def hardlink_targets(files: DataFrame) -> DataFrame:
    """path, target: later names of a file that an earlier path holds."""
    group = Window.partitionBy("dev", "ino").orderBy("path")
    marked = files.where("nlink > 1").withColumn("target", F.first("path").over(group))
    return marked.where("path <> target").select("path", "target")


def exclude(files: DataFrame, lines: list[str]) -> DataFrame:
    return files.where(~excluded(F.col("path"), F.col("kind") == "dir", lines))


def without_mounts(files: DataFrame, mounts: DataFrame, root_dev: int) -> DataFrame:
    """Rows on the root's device that lie at or below no mount point.

    ``mounts`` is the machine's mount table.
    """
    below = (F.col("path") == F.col("mount")) | F.col("path").startswith(F.concat(F.col("mount"), F.lit("/")))
    return files.where(F.col("dev") == root_dev).join(small(mounts), below, "left_anti")


def is_temporary(name: Column) -> Column:
    return name.rlike(r"^\..*\.partial$") | name.rlike(r"^\.[a-z]+-write-test-")


def stale_partials(files: DataFrame, now: Column, seconds: int = STALE_PARTIAL_SECONDS) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(is_temporary(name) & (F.col("modified") < now - F.expr(f"interval {int(seconds)} seconds")))


def usage(files: DataFrame) -> DataFrame:
    """destination, files, bytes."""
    return files.groupBy("destination").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("len"), F.lit(0)).cast("bigint").alias("bytes"))
