"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, block by block, in each of a few
passes. A pass counts scores in ``BINS`` bins of each query's current interval;
the sums over all partitions tell which bin holds the k-th highest score, and
that bin is the next interval. Once a bin is one integer wide, the k-th score
is known exactly; a last pass keeps the scores above it and, of those equal to
it, the candidates with the smallest ids.

A partition reports bins from its own k-th score upward only: the k-th score
over all can't lie lower, so lower bins never matter.

Scores are exact integers, whatever the size of the components: a block is cut
into limbs of ``LIMB`` bits, whose products are sums that a double holds exactly,
and these are added in 64 bits where the scores fit and as Python's integers else.
Ranks follow the exact scores; one that 64 bits can't hold is returned as the
nearest long.

Vectors that are null or hold a null or non-finite component take no part, nor do
rows without id. All others do, empty vectors too; components that a shorter
vector lacks count as 0. Of rows that repeat a query's id, the one with the
smallest components is the query; as candidates all rows count, except those with
the query's own id. Equal scores rank by the smaller id; rows of one id and score
fill a rank each. An empty table gives no rows. Only the two named columns are read.

Queries and their intervals are files in the shared folder, read by each task a
block at a time, so nothing is broadcast and no pairs are formed as rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packlake.llm import common

BINS = 1024
#: Queries in a block, candidates in a block, components in a segment of candidates.
QUERY_BLOCK, BLOCK, SEGMENT = 512, 8192, 1 << 23
#: Bits of a limb where a component is too large for products in one piece.
LIMB = 20
LONG = (1 << 63) - 1


def sound(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and x, the components as they are, of rows that take part."""
    x = F.col(embedding)
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    kind = "array<float>" if table.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(finite, x).cast(kind).alias("x"))
    return rows.where("vec_id is not null and x is not null")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled with 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten())
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), flat.dtype)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def floors(x: np.ndarray, scale: float) -> np.ndarray:
    """The floors of the scaled components, whole numbers in a floating type."""
    x = x.astype(np.float64)
    if x.size and float(np.abs(x).max()) > 2.0**1000 / scale:
        x = x.astype(np.longdouble)  # so that scaling can't overflow
    return np.floor(x * scale)


def limbs(v: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(shift, part) with v the sum of part * 2**shift, each part below 2**LIMB."""
    out, shift, base = [], 0, 2.0**LIMB
    while v.any():
        low = np.fmod(v, base)
        if low.any():
            out.append((shift, low.astype(np.float64)))
        v, shift = (v - low) / base, shift + LIMB
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two matrices of whole numbers, exactly; int64,
    or Python's integers where a sum might not fit."""
    width = max(1, a.shape[1])
    most = lambda m: int(np.abs(m).max()) if m.size else 0
    bound = width * most(a) * most(b)
    if bound < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    out = np.zeros((len(a), len(b)), np.int64 if bound < 1 << 62 else object)
    step = 1 << (52 - 2 * LIMB)  # so many products of limbs add up exactly
    for i, x in limbs(a):
        for j, y in limbs(b):
            for at in range(0, width, step):
                part = (x[:, at : at + step] @ y[:, at : at + step].T).astype(np.int64)
                out += (part if out.dtype != object else part.astype(object)) * (1 << (i + j))
    return out


class Search:
    """What the tasks need. ``steps`` are the widths of a bin in each pass so far;
    a query's interval starts where its bins of these passes tell, from ``-bound``."""

    def __init__(self, width: int, bound: int, k: int, scale: float):
        self.width, self.bound, self.k, self.scale = width, bound, k, scale
        self.exact = bound <= LONG // 4

    def segments(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates in segments, ordered by id, their components scaled."""
        ids, rows, n = [], [], 0
        for batch in batches:
            ids.append(np.asarray(batch.column(0)))
            rows.append(matrix(batch.column(1), self.width))
            n += len(ids[-1]) * max(1, self.width)
            if n >= SEGMENT:
                yield self._joined(ids, rows)
                ids, rows, n = [], [], 0
        if n:
            yield self._joined(ids, rows)

    def _joined(self, ids: list, rows: list) -> tuple[np.ndarray, np.ndarray]:
        ids, rows = np.concatenate(ids), np.concatenate(rows)
        order = np.argsort(ids, kind="stable")
        return ids[order], floors(rows[order], self.scale)

    def queries(self, path: str, steps: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of query ids, vectors and interval starts."""
        fs, root = common.open_fs(path)
        from pyarrow.fs import FileSelector

        for info in sorted(fs.get_file_info(FileSelector(root)), key=lambda i: i.path):
            if info.path.endswith(".parquet"):
                with fs.open_input_file(info.path) as f:
                    for batch in pq.ParquetFile(f).iter_batches(QUERY_BLOCK, columns=["query_id", "x", "bins"]):
                        lo = [sum((b * s for b, s in zip(bins, steps, strict=True)), -self.bound) for bins in batch.column(2).to_pylist()]
                        yield np.asarray(batch.column(0)), floors(matrix(batch.column(1), self.width), self.scale), np.array(lo, np.int64 if self.exact else object)

    def scores(self, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of a block and which of them count."""
        s = products(queries, rows)
        valid = np.ones(s.shape, bool)
        first, last = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
        for q in np.flatnonzero(first < last):
            valid[q, first[q] : last[q]] = False
        return s, valid


def _histogram_pass(vectors: DataFrame, search: Search, path: str, steps: list[int], span: int, step: int) -> DataFrame:
    """query_id, bin, n of scores in [lo, lo + span), in bins of ``step``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in search.segments(batches):
            for query_ids, queries, lo in search.queries(path, steps):
                found: dict[int, int] = {}
                floor = np.full(len(query_ids), -1, np.int64)
                for at in range(0, len(ids), BLOCK):
                    s, valid = search.scores(query_ids, queries, ids[at : at + BLOCK], rows[at : at + BLOCK])
                    place = s - lo[:, None]
                    valid &= ((place >= 0) & (place < span)).astype(bool)
                    place[~valid] = 0
                    bins = (place // step).astype(np.int64)
                    bins[~valid] = -1
                    if bins.shape[1] >= search.k:
                        own = np.partition(bins, bins.shape[1] - search.k, axis=1)[:, bins.shape[1] - search.k]
                        floor = np.maximum(floor, own)
                    q, c = np.nonzero(bins >= np.maximum(floor, 0)[:, None])
                    keys, counts = np.unique(q * BINS + bins[q, c], return_counts=True)
                    for key, n in zip(keys.tolist(), counts.tolist(), strict=True):
                        found[key] = found.get(key, 0) + n
                rows_out = [(int(query_ids[key // BINS]), key % BINS, n) for key, n in found.items() if key % BINS >= floor[key // BINS]]
                if rows_out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows_out, strict=True)], names=["query_id", "bin", "n"])

    return vectors.mapInArrow(run, "query_id long, bin long, n long")


def _last_pass(vectors: DataFrame, search: Search, path: str, steps: list[int]) -> DataFrame:
    """query_id, vec_id, score of what lies above the k-th score, and of the
    ties with it the ``k`` smallest ids of each block. ``place`` orders the scores
    that 64 bits might not hold."""
    digits = len(f"{2 * search.bound:x}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in search.segments(batches):
            for query_ids, queries, lo in search.queries(path, steps):
                ties = np.zeros(len(query_ids), np.int64)
                for at in range(0, len(ids), BLOCK):
                    here = ids[at : at + BLOCK]
                    s, valid = search.scores(query_ids, queries, here, rows[at : at + BLOCK])
                    above, equal = valid & (s > lo[:, None]).astype(bool), valid & (s == lo[:, None]).astype(bool)
                    for q in np.flatnonzero(equal.any(axis=1)):
                        at_tie = np.flatnonzero(equal[q])[: max(0, search.k - int(ties[q]))]
                        ties[q] += len(at_tie)
                        above[q, at_tie] = True
                    q, c = np.nonzero(above)
                    if len(q):
                        found = [int(x) for x in s[q, c]]
                        place = [None if search.exact else f"{x + search.bound:0{digits}x}" for x in found]
                        score = [max(-LONG - 1, min(LONG, x)) for x in found]
                        yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(here[c]), pa.array(score, pa.int64()), pa.array(place, pa.string())], names=["query_id", "vec_id", "score", "place"])

    return vectors.mapInArrow(run, "query_id long, vec_id long, score long, place string")


def _state(bins: DataFrame, queries: DataFrame, blocks: int) -> tuple[DataFrame, str]:
    """Queries with the bins of their intervals as files for the tasks."""
    path = common.shared_dir(bins.sparkSession, "topk-state")
    joined = bins.join(queries, "query_id").select("query_id", "x", "bins", "above")
    joined.repartition(blocks).write.parquet(path)
    return bins.sparkSession.read.schema(joined.schema).parquet(path), path


def search(table: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The ``k`` best of all rows for each query (rows whose id ``every``
    divides): query_id, rank, vec_id, score."""
    spark = table.sparkSession
    vectors = common.stage(sound(table, vec_id, embedding).repartition(common.partitions(spark)), "topk-vectors")
    sizes = vectors.agg(F.max(F.size("x")).alias("d"), F.max(F.array_max(F.transform("x", lambda c: F.abs(c.cast("double"))))).alias("m")).first()
    width, most = sizes["d"] or 0, math.ceil(Fraction(sizes["m"] or 0.0) * Fraction(scale))
    bound = max(1, width * most * most)
    own = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    queries = common.stage(own.select(F.col("vec_id").alias("query_id"), "x"), "topk-queries")
    blocks = max(1, -(-queries.count() // (8 * QUERY_BLOCK)))
    find = Search(width, bound, k, scale)

    steps, span = [], 2 * bound + 1
    state, path = _state(queries.select("query_id", F.array().cast("array<long>").alias("bins"), F.lit(0).cast("long").alias("above")), queries, blocks)
    while span > 1:
        step = -(-span // BINS)
        bins = _histogram_pass(vectors, find, path, list(steps), span, step).groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counted = bins.withColumn("down", F.sum("n").over(down)).join(state.select("query_id", "bins", "above"), "query_id")
        enough = F.col("above") + F.col("down") >= k
        # the highest bin that completes k, else the lowest there is
        chosen = counted.groupBy("query_id").agg(
            F.coalesce(F.max(F.when(enough, F.col("bin"))), F.min("bin")).alias("bin"), F.first("bins").alias("bins"), F.first("above").alias("above"), F.collect_list(F.struct("bin", "n")).alias("all")
        )
        above = F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + F.when(x["bin"] > F.col("bin"), x["n"]).otherwise(F.lit(0)))
        state, path = _state(chosen.select("query_id", F.array_append("bins", F.col("bin")).alias("bins"), (F.col("above") + above).alias("above")), queries, blocks)
        steps.append(step)
        span = step
    best = Window.partitionBy("query_id").orderBy(F.desc("place"), F.desc("score"), "vec_id")
    ranked = _last_pass(vectors, find, path, steps).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
