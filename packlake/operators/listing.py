"""Listings: what each snapshot added, newest first, and what shrank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packlake.operators.sizes import one_row


def with_previous(snapshots: DataFrame) -> DataFrame:
    """``previous``: the name of the job's snapshot before each."""
    order = Window.partitionBy("job").orderBy("created", "name")
    return snapshots.withColumn("previous", F.lag("name").over(order))


def new_chunks(snapshots: DataFrame, chunks: DataFrame) -> DataFrame:
    """name, chunk, size: distinct chunks that the job's previous snapshot lacks.

    A chunk that vanished and came back is new again, as only the immediate
    predecessor counts.
    """
    own = chunks.groupBy("name", "chunk").agg(F.min("size").alias("size"))
    linked = with_previous(snapshots).select("name", "previous").join(own, "name")
    before = own.select(F.col("name").alias("previous"), "chunk")
    return linked.join(before, ["previous", "chunk"], "left_anti").select("name", "chunk", "size")


def list_sized(snapshots: DataFrame, chunks: DataFrame) -> DataFrame:
    """All snapshots with ``new_size``, 0 for those that add nothing."""
    added = new_chunks(snapshots, chunks).groupBy("name").agg(F.sum("size").alias("new_size"))
    return snapshots.join(added, "name", "left").withColumn("new_size", F.coalesce("new_size", F.lit(0).cast("bigint")))


def list_sized_stored(snapshots: DataFrame, chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """``list_sized`` with ``new_stored``: null if the index lacks a new chunk."""
    stored = entries.groupBy("chunk").agg(F.min_by("stored", "pack").alias("stored"))
    added = (
        new_chunks(snapshots, chunks)
        .join(stored, "chunk", "left")
        .groupBy("name")
        .agg(F.sum("size").alias("new_size"), F.when(F.count_if(F.col("stored").isNull()) == 0, F.sum("stored")).alias("known"), F.lit(True).alias("any"))
    )
    zero = F.lit(0).cast("bigint")
    joined = snapshots.join(added, "name", "left")
    return joined.withColumns({"new_size": F.coalesce("new_size", zero), "new_stored": F.when(F.col("any"), F.col("known")).otherwise(zero)}).drop("known", "any")


def newest_first(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy(F.desc("created"), F.desc("name"))


def ranked(snapshots: DataFrame) -> DataFrame:
    """``place``: 1 for a job's newest snapshot, and so on."""
    order = Window.partitionBy("job").orderBy(F.desc("created"), F.desc("name"))
    return snapshots.withColumn("place", F.row_number().over(order))


def across(listings: list[DataFrame]) -> DataFrame:
    """Listings of the destinations that answered, as one."""
    if not listings:
        raise ValueError("no destination is reachable")
    out = listings[0]
    for more in listings[1:]:
        out = out.unionByName(more)
    return newest_first(out)


def latest(listing: DataFrame, local: Column) -> DataFrame:
    """Every copy of the newest snapshot, local ones first.

    The newest is one row of an aggregate, so the join broadcasts a single row.
    """
    newest = listing.agg(F.max(F.struct("created", "name")).alias("m")).select(F.col("m.name").alias("name"))
    return listing.join(one_row(newest), "name").orderBy(~local, "destination")


def shrunk(history: DataFrame) -> DataFrame:
    """Jobs whose newest run is less than half of the one before it."""
    order = Window.partitionBy("job").orderBy(F.desc("created"), F.desc("name"))
    ranked = history.withColumns({"rn": F.row_number().over(order), "previous_size": F.lead("size").over(order)})
    return ranked.where((F.col("rn") == 1) & (F.col("size") * 2 < F.col("previous_size"))).select("job", "name", "size", "previous_size")
