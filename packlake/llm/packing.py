"""Best-fit packing of documents into fixed-length sequences by a grouping
genetic algorithm on islands.

Documents become pieces: those longer than a sequence are cut so that all but
the first piece are full. Full pieces are sequences of their own. The other
pieces are dealt over islands of about ``ISLAND`` pieces; on each, a population
of packings evolves: crossover injects whole well-filled bins of one parent
into the other, bins that would then hold a piece twice are opened, and the
pieces they lose are placed again best-fit. Between epochs each island's elite
bins, as lists of lengths, migrate to the next island, which builds them from
its own pieces of those lengths. The pieces of an island's emptiest bins, at most
a quarter of it, are pooled on fewer islands, until one holds the rest; all other
bins are closed, full or not. No piece is dropped, but each level may leave waste
in the bins it closes, and the number of sequences may depend on that of islands.

Null and empty texts are one piece with the end id only. Repeated rows and ids
are pieces of their own; a null doc_id comes back null. Only the named columns are
read; an empty table gives no rows. A text is encoded whole, however long. A piece's
ids stay with its document: packing moves only lengths.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packlake.llm import common, tokens

CAPACITY = 2048
ISLAND = 16_384
POPULATION, OFFSPRING, ELITES = 6, 60, 64
#: One in so many of an island's pieces may move on to the next level.
OPEN = 4


class Spare:
    """Bins by the room they have left; the best fit is the lowest set bit."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.mask = capacity, [[] for _ in range(capacity + 1)], 0

    def add(self, b: int, room: int) -> None:
        if room > 0:
            self.bins[room].append(b)
            self.mask |= 1 << room

    def place(self, length: int, fresh: int) -> tuple[int, bool]:
        """The bin for a piece; a new one, named ``fresh``, if none has room."""
        m = self.mask >> length
        if m:
            room = length + (m & -m).bit_length() - 1
            b = self.bins[room].pop()
            if not self.bins[room]:
                self.mask ^= 1 << room
            self.add(b, room - length)
            return b, False
        self.add(fresh, self.capacity - length)
        return fresh, True


def best_fit(lengths: np.ndarray, order: np.ndarray, bins: np.ndarray, fills: np.ndarray, capacity: int) -> np.ndarray:
    """Place the pieces ``order`` into the given bins and new ones."""
    spare = Spare(capacity)
    for b in np.flatnonzero(fills < capacity)[::-1].tolist():
        spare.add(b, capacity - int(fills[b]))
    fresh, where = len(fills), []
    for length in lengths[order].tolist():
        b, new = spare.place(length, fresh)
        fresh += new
        where.append(b)
    bins = bins.copy()
    bins[order] = where
    return bins


def exact_fill(lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A packing that closes each bin exactly where one, two or three pieces
    can: the largest piece opens a bin, and shifted bit sets of the lengths
    at hand find the pairs that sum to the room left."""
    pools: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in rng.permutation(len(lengths)).tolist():
        pools[int(lengths[i])].append(i)
    have = sum(1 << x for x in range(1, capacity + 1) if pools[x])
    mirror = sum(1 << (capacity - x) for x in range(1, capacity + 1) if pools[x])
    bins, b = np.empty(len(lengths), np.int64), 0

    def take(x: int) -> None:
        nonlocal have, mirror
        bins[pools[x].pop()] = b
        if not pools[x]:
            have ^= 1 << x
            mirror ^= 1 << (capacity - x)

    def pair(room: int) -> int:
        both = have & (mirror >> (capacity - room)) & ((1 << room) - 1)
        while both > 1:
            x = both.bit_length() - 1
            if 2 * x != room or len(pools[x]) > 1:
                return x
            both ^= 1 << x
        return 0

    while have:
        x = have.bit_length() - 1
        take(x)
        room = capacity - x
        while room and (fit := have & ((1 << (room + 1)) - 1)) > 1:
            if fit >> room:
                take(room)
                room = 0
            elif x := pair(room):
                take(x)
                take(room - x)
                room = 0
            else:
                first, tries = fit.bit_length() - 1, 0
                y = first
                while fit > 1 and tries < 6:
                    y, tries = fit.bit_length() - 1, tries + 1
                    fit ^= 1 << y
                    if pair(room - y) and (len(pools[y]) > 2 or 2 * y != room):
                        break
                else:
                    y = first
                take(y)
                room -= y
        b += 1
    return bins


def tidy(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int64)


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first; then the fuller ones the better."""
    fills = np.bincount(bins, lengths)
    return -len(fills), float(np.square(fills / capacity).sum())


def inject(lengths: np.ndarray, bins: np.ndarray, group: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Bring whole bins into a packing. ``group``: per piece, the number of its
    injected bin, or -1. Bins that hold an injected piece are opened, as are a
    few of the emptiest, and the displaced pieces are placed best-fit."""
    injected = group >= 0
    fills = np.bincount(bins, lengths).astype(np.int64)
    opened = np.zeros(len(fills), bool)
    opened[bins[injected]] = True
    loose = np.flatnonzero((fills < capacity) & ~opened)
    if len(loose):
        opened[rng.permutation(loose)[: max(2, len(loose) // 4)]] = True
    displaced = opened[bins] & ~injected
    new = np.where(injected, group + len(fills), np.where(displaced, -1, bins))
    count = len(fills) + int(group.max(initial=-1)) + 1
    fills = np.bincount(new[~displaced], lengths[~displaced], count).astype(np.int64)
    fills[np.bincount(new[~displaced], minlength=count) == 0] = capacity  # gone, not empty
    at = np.flatnonzero(displaced)
    order = at[np.argsort(-(lengths[at] + rng.random(len(at)) * rng.choice([0.0, 32.0])), kind="stable")]
    return tidy(best_fit(lengths, order, new, fills, capacity))


def crossover(lengths: np.ndarray, taker: np.ndarray, giver: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    fills = np.bincount(giver, lengths)
    good = np.flatnonzero(fills >= min(capacity, np.quantile(fills, 0.5)))
    chosen = np.full(len(fills), -1)
    some = rng.permutation(good)[: max(1, len(good) // 3)]
    chosen[some] = np.arange(len(some))
    return inject(lengths, taker, chosen[giver], capacity, rng)


def settle(lengths: np.ndarray, bins: np.ndarray, patterns: list[tuple[int, ...]], capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Build migrant bins from own pieces of their lengths, where there are such."""
    pools: dict[int, list[int]] = {}
    wanted = {x for p in patterns for x in p}
    for i in rng.permutation(np.flatnonzero(np.isin(lengths, list(wanted)))).tolist():
        pools.setdefault(int(lengths[i]), []).append(i)
    group, n = np.full(len(lengths), -1), 0
    for p in patterns:
        if all(len(pools.get(x, ())) >= c for x, c in Counter(p).items()):
            for x in p:
                group[pools[x].pop()] = n
            n += 1
    return inject(lengths, bins, group, capacity, rng) if n else bins


def evolve(lengths: np.ndarray, resident: np.ndarray | None, migrants: list[tuple[int, ...]], capacity: int, rng: np.random.Generator, population: int = POPULATION, offspring: int = OFFSPRING, told: Counter | None = None) -> np.ndarray:
    """The best packing of one island after an epoch; ``told`` counts crossovers
    and migrations. Where a seed meets the lower bound there is nothing to search."""
    told = Counter() if told is None else told
    empty, none = np.zeros(0, np.int64), np.full(len(lengths), -1, np.int64)
    least = -(-int(lengths.sum()) // capacity)
    order = np.argsort(-lengths, kind="stable")
    herd = [tidy(resident)] if resident is not None else [tidy(best_fit(lengths, order, none, empty, capacity))]
    herd.append(tidy(exact_fill(lengths, capacity, rng)))
    if migrants:
        herd.append(settle(lengths, herd[0], migrants, capacity, rng))
        told["migrations"] += 1
    noise = 16.0
    while len(herd) < population and -fitness(lengths, herd[0], capacity)[0] > least:
        order = np.argsort(-(lengths + rng.random(len(lengths)) * noise), kind="stable")
        herd.append(tidy(best_fit(lengths, order, none, empty, capacity)))
        noise *= 3
    herd.sort(key=lambda g: fitness(lengths, g, capacity), reverse=True)
    for _ in range(offspring):
        if -fitness(lengths, herd[0], capacity)[0] <= least or len(herd) < 2:
            break
        a, b = rng.choice(len(herd), 2, replace=False)
        child = crossover(lengths, herd[min(a, b)], herd[max(a, b)], capacity, rng)
        herd.append(child)
        told["crossovers"] += 1
        herd.sort(key=lambda g: fitness(lengths, g, capacity), reverse=True)
        herd = herd[:population]
    return herd[0]


def elite(lengths: np.ndarray, bins: np.ndarray, capacity: int, rng: np.random.Generator, count: int = ELITES) -> list[list[int]]:
    """Lengths of some full bins of several pieces."""
    fills, sizes = np.bincount(bins, lengths), np.bincount(bins)
    full = np.flatnonzero((fills == capacity) & (sizes > 1))
    chosen = rng.permutation(full)[:count]
    index = np.argsort(bins, kind="stable")
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return [sorted(lengths[index[starts[b] : starts[b + 1]]].tolist(), reverse=True) for b in chosen]


PIECE = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and cut; ``uid`` is unique among the rows."""
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, uid = tokens.load(path), TaskContext.get().partitionId() << 33
        for batch in batches:
            columns: list[list] = [[] for _ in schema]
            for key, found in zip(batch.column(0).to_pylist(), bpe.encode_batch(batch.column(1)), strict=True):
                ids = found.astype("<u4").tobytes() + tail
                n = len(ids) // 4
                start, stop, piece = 0, n % capacity or min(n, capacity), 0
                while start < n:
                    row = (uid, key, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]))
                    for c, x in zip(columns, row, strict=True):
                        c.append(x)
                    uid, piece, start, stop = uid + 1, piece + 1, stop, stop + capacity
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        common.release()

    return docs.select(F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, PIECE)


STATE = f"{PIECE}, island long, bin long, open boolean, pattern array<long>"


def _epoch(rows: DataFrame, level: int, epoch: int, islands: int, last: bool, capacity: int, seed: int) -> DataFrame:
    """One epoch on all islands. Rows without uid are migrants; an epoch gives
    the pieces with their bins, and the migrants for the next."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        island = int(frame["island"].iloc[0])
        rng = np.random.default_rng([seed, level, epoch, island])
        own = frame[frame["uid"].notna()].sort_values("uid").reset_index(drop=True)
        migrants = sorted(tuple(int(x) for x in p) for p in frame.loc[frame["uid"].isna(), "pattern"])
        columns = [c.split()[0] for c in STATE.replace("array<long>", "array").split(", ")]
        if own.empty:
            return pd.DataFrame(columns=columns)
        lengths = own["length"].to_numpy(np.int64)
        resident = own["bin"].to_numpy(np.int64) if own["bin"].notna().all() else None
        bins = evolve(lengths, resident, migrants, capacity, rng)
        fills = np.bincount(bins, lengths).astype(np.int64)
        opened = np.zeros(len(fills), bool)
        if last and islands > 1:
            worst = np.argsort(fills, kind="stable")
            worst = worst[fills[worst] < capacity]
            held = np.cumsum(np.bincount(bins)[worst])
            opened[worst[held <= max(1, len(own) // OPEN)]] = True
        own["bin"], own["open"], own["pattern"] = bins, opened[bins], None
        out = [own[columns]]
        if islands > 1 and (found := elite(lengths, bins, capacity, rng)):
            more = pd.DataFrame({"pattern": found, "island": (island + 1) % islands, "open": False})
            out.append(more.reindex(columns=columns))
        return pd.concat(out, ignore_index=True).astype({c: "Int64" for c in columns if c not in ("open", "pattern")})

    return rows.groupBy("island").applyInPandas(run, STATE)


def pack(found: DataFrame, capacity: int = CAPACITY, island: int = ISLAND, epochs: int = 2, seed: int = 7) -> DataFrame:
    """``found`` with sequence_id and offset."""
    whole = found.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    done = [whole]
    blank = {"bin": F.lit(None).cast("long"), "open": F.lit(False), "pattern": F.lit(None).cast("array<long>")}
    rows = found.where(F.col("length") < capacity).withColumns(blank)
    left, level, migrants = rows.count(), 0, None
    while left:
        islands = max(1, -(-left // island))
        dealt = F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(islands))
        state = rows.withColumn("island", dealt)
        if migrants is not None:
            state = state.unionByName(migrants.withColumn("island", F.pmod("island", F.lit(islands))))
        columns = [f.name for f in state.schema.fields]
        rounds = epochs if islands > 1 and level == 0 else 1
        for epoch in range(rounds):
            before, state = state, common.stage(_epoch(state.select(columns), level, epoch, islands, epoch == rounds - 1, capacity, seed), f"packing-{level}-{epoch}")
            if epoch:
                common.discard(before)
        own = state.where("uid is not null")
        closed = own.where("not open").withColumn("sequence_id", F.lit((level + 1) << 56) + F.shiftleft(F.col("island"), 28) + F.col("bin"))
        done.append(closed)
        rows = own.where("open").withColumns(blank)
        migrants = state.where("uid is null")
        left, level = (rows.count() if islands > 1 else 0), level + 1
    out = [whole.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")]
    for closed in done[1:]:
        out.append(_offsets(closed))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def _offsets(closed: DataFrame) -> DataFrame:
    """Places in the sequence, by uid; a sequence has at most its capacity of pieces."""
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1))
    return closed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.coalesce(before, F.lit(0)).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, island: int = ISLAND, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    common.bounded_batches(docs.sparkSession)
    return pack(common.stage(pieces(docs, path, capacity, doc_id=doc_id, text=text), "pieces"), capacity, island)
