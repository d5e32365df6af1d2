"""The chunk store: membership, dedup, completeness, packs, garbage collection."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packlake.operators.sizes import one_row, small
from packlake.schemas import LIVE_PERCENT, PACK_TARGET, PROGRESS_BYTES, YOUNG_PACK_SECONDS


# -- membership and dedup

def tagged(stream: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``stream`` (chunk, seq) with tag: Data where a chunk comes first and isn't
    known yet, else Reference."""
    first = stream.groupBy("chunk").agg(F.min("seq").alias("seq"))
    if known is not None:
        first = first.join(known.select("chunk").distinct(), "chunk", "left_anti")
    # the join is by chunk and place, so a chunk that fills the stream meets in no one task
    rows = stream.join(first.withColumn("fresh", F.lit(True)), ["chunk", "seq"], "left")
    return rows.withColumn("tag", F.when(F.col("fresh"), "Data").otherwise("Reference")).drop("fresh").select(*stream.columns, "tag")


def dedup_stats(stream: DataFrame) -> DataFrame:
    """Rows, distinct chunks, all bytes and bytes kept, in one aggregation."""
    each = stream.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("size"))
    return each.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("chunks"), F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("size").alias("kept_bytes")
    )


def known_everywhere(holdings: DataFrame) -> DataFrame:
    """Chunks that every destination holds."""
    pairs = holdings.select("destination", "chunk").distinct()
    total = pairs.agg(F.count_distinct("destination").alias("total"))
    return pairs.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).join(one_row(total), F.col("n") == F.col("total"), "left_semi").select("chunk")


def missing(wanted: DataFrame, destinations: DataFrame, holdings: DataFrame) -> DataFrame:
    """destination, chunk: what each destination lacks of a snapshot.

    ``destinations`` is the configured list; the product with it is what has to
    be sent at most.
    """
    need = wanted.select("chunk").distinct().join(small(destinations.select("destination").distinct()))
    return need.join(holdings.select("destination", "chunk").distinct(), ["destination", "chunk"], "left_anti")


def fan_out(stream: DataFrame, destinations: DataFrame, holdings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What to put where, and the references that a destination can't resolve."""
    lacking = missing(stream, destinations, holdings)
    put = stream.where("tag = 'Data'").select("chunk").distinct().join(lacking, "chunk").select("destination", "chunk")
    first = stream.where("tag = 'Data'").select("chunk").distinct()
    failed = lacking.join(first, "chunk", "left_anti").select("destination", "chunk")
    return put, failed


def incomplete(chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """name, missing: snapshots with chunks that no pack holds, by occurrence."""
    return chunks.join(entries.select("chunk").distinct(), "chunk", "left_anti").groupBy("name").agg(F.count(F.lit(1)).alias("missing"))


def unique_missing(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """chunk, seq: what a copy has to fetch, in order of first use."""
    return chunks.join(known.select("chunk").distinct(), "chunk", "left_anti").groupBy("chunk").agg(F.min("seq").alias("seq"))


def merged_index(old: DataFrame, new: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Index rows of both, each pack once, without removed packs."""
    fresh = new.join(old.select("pack").distinct(), "pack", "left_anti")
    out = old.unionByName(fresh)
    return out if removed is None else out.join(removed.select("pack").distinct(), "pack", "left_anti")


def unindexed(packs: DataFrame, entries: DataFrame) -> DataFrame:
    """Packs that no index lists; their directories are read instead."""
    return packs.join(entries.select("pack").distinct(), "pack", "left_anti")


# -- packs

def offsets(rows: DataFrame, group: str, seq: str, length: str) -> DataFrame:
    """``offset``: bytes before each row of its group."""
    before = Window.partitionBy(group).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("bigint"))


def assign_packs(rows: DataFrame, group: str = "destination", seq: str = "seq", length: str = "stored", target: int = PACK_TARGET) -> DataFrame:
    """``pack_no``: a pack closes after the chunk that fills it.

    The fold is sequential within a group, so it streams over sorted partitions
    and holds one running sum, whatever a group's size.
    """
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", pack_no bigint"

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, number, filled = object(), 0, 0
        for frame in frames:
            keys, ends = frame[group].to_numpy(), np.cumsum(frame[length].to_numpy(np.int64))
            out = np.empty(len(keys), np.int64)
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for at, stop in pairwise(edges if len(keys) else []):
                if keys[at] != current:
                    current, number, filled = keys[at], 0, 0
                while at < stop:
                    if filled >= target:
                        number, filled = number + 1, 0
                    before = ends[at - 1] if at else 0
                    # up to the chunk that fills the pack
                    last = min(int(np.searchsorted(ends, before + target - filled)) + 1, stop)
                    out[at:last] = number
                    filled += int(ends[last - 1] - before)
                    at = last
            frame["pack_no"] = out
            yield frame

    return rows.repartition(group).sortWithinPartitions(group, seq).select(*names).mapInPandas(fold, schema)


def progress(rows: DataFrame, group: str = "run_id", seq: str = "seq", length: str = "size", step: int = PROGRESS_BYTES) -> DataFrame:
    """group, seq, done: a row whenever ``step`` more bytes have gone since the last."""
    schema = f"`{group}` {rows.schema[group].dataType.simpleString()}, `{seq}` {rows.schema[seq].dataType.simpleString()}, done bigint"

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, done, told = object(), 0, 0
        for frame in frames:
            out = []
            for key, at, size in zip(frame[group], frame[seq], frame[length], strict=True):
                if key != current:
                    current, done, told = key, 0, 0
                done += size
                if done - told >= step:
                    told = done
                    out.append((key, at, done))
            yield pd.DataFrame(out, columns=[group, seq, "done"])

    return rows.select(group, seq, length).repartition(group).sortWithinPartitions(group, seq).mapInPandas(fold, schema)


# -- garbage collection

def live_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk").distinct()


def gc_plan(entries: DataFrame, live: DataFrame, percent: int = LIVE_PERCENT, unread: DataFrame | None = None) -> DataFrame:
    """pack, total, used, verdict. A live chunk counts in its least pack only, but
    for copies in ``unread``, which never count where there is another one."""
    copies = entries if unread is None else entries.join(unread, ["pack", "chunk"], "left_anti")
    keeper = copies.groupBy("chunk").agg(F.min("pack").alias("keeper"))
    marked = entries.join(keeper, "chunk", "left").join(live.select("chunk").distinct().withColumn("live", F.lit(True)), "chunk", "left")
    kept = F.col("live").isNotNull() & (F.col("keeper") == F.col("pack"))
    sums = marked.groupBy("pack").agg(F.sum("stored").alias("total"), F.coalesce(F.sum(F.when(kept, F.col("stored"))), F.lit(0)).cast("bigint").alias("used"))
    verdict = F.when(F.col("used") == 0, "dead").when(F.col("used") * 100 < F.col("total") * percent, "sparse").otherwise("keep")
    return sums.withColumn("verdict", verdict)


def old_enough(packs: DataFrame, now: Column, seconds: int = YOUNG_PACK_SECONDS) -> DataFrame:
    """Packs that garbage collection may judge; late writers keep theirs."""
    return packs.where(F.col("modified") < now - F.expr(f"interval {int(seconds)} seconds"))


def repack_moves(entries: DataFrame, live: DataFrame, plan: DataFrame) -> DataFrame:
    """pack, chunk, stored: live chunks that only packs to be rewritten or
    removed hold, from the least of them."""
    doomed = plan.where("verdict <> 'keep'").select("pack")
    wanted = entries.join(live.select("chunk").distinct(), "chunk", "left_semi")
    safe = wanted.join(doomed, "pack", "left_anti").select("chunk").distinct()
    return wanted.join(doomed, "pack", "left_semi").join(safe, "chunk", "left_anti").groupBy("chunk").agg(F.min("pack").alias("pack"), F.min_by("stored", "pack").alias("stored"))


def collect_garbage(entries: DataFrame, live: DataFrame, new_pack: Column, percent: int = LIVE_PERCENT) -> DataFrame:
    """The index after collection: kept packs, and moved chunks in ``new_pack``."""
    plan = gc_plan(entries, live, percent)
    kept = entries.join(plan.where("verdict = 'keep'").select("pack"), "pack", "left_semi")
    moved = repack_moves(entries, live, plan).withColumn("pack", new_pack)
    return kept.select("pack", "chunk", "stored").unionByName(moved.select("pack", "chunk", "stored"))
