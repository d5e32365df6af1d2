"""Token-ID files: rANS-coded ids in sharded files with checkpoints.

A file holds whole documents in ascending doc_id order. One static frequency
table, counted over all ids of the file, is shared by its blocks. Each block of
``BLOCK`` ids is coded by up to ``LANES`` interleaved rANS states, so it decodes
alone and with vector operations; the block index gives its byte offset, first
id, length and CRC-32 (the checkpoints), the document index ids and lengths.

Shards are ranges of doc_id of about ``SHARD_BYTES``, fixed by the data. A task
streams its shard, starts a new file at ``FILE_TOKENS`` ids, writes it under a
temporary name and renames it; only files in the manifest are read. A task that
runs twice writes the same bytes under the same names.

Null texts are empty and have the end id only. A null doc_id sorts first and
comes back null. Rows of one doc_id are ordered by their text and lie in one
shard. Only the two named columns are read; an empty table gives no file and no
rows. A text is encoded whole and a file holds at least one document, so a task's
memory follows ``FILE_TOKENS`` and the longest text.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packlake.llm import common, tokens

MAGIC = b"PLTOKEN1"
BLOCK, LANES = 1 << 18, 1024
FILE_TOKENS = 4_000_000
SHARD_BYTES = 256 << 20
#: Ids below this are counted and looked up in dense arrays.
DENSE = 1 << 22
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
MASK = np.uint64(0xFFFFFFFF)


class Table:
    """Frequencies scaled to a power of two; every seen id has at least one slot."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray, bits: int):
        self.ids, self.freq, self.bits = ids.astype("<u4"), freq.astype(np.uint64), bits
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64) if len(ids) else np.zeros(0, np.uint64)
        self._slots: np.ndarray | None = None
        self._places: np.ndarray | None = None

    @classmethod
    def count(cls, ids: np.ndarray) -> Table:
        if len(ids) and int(ids.max()) < DENSE:
            counts = np.bincount(ids)
            seen = np.flatnonzero(counts)
            counts = counts[seen]
        else:
            seen, counts = np.unique(ids, return_counts=True)
        bits = max(16, min(24, int(len(seen)).bit_length() + 4))
        if not len(seen):
            return cls(seen, counts, bits)
        exact = counts * ((1 << bits) - len(seen)) / counts.sum()
        freq = np.floor(exact).astype(np.int64) + 1
        left = (1 << bits) - int(freq.sum())
        freq[np.argsort(-(exact % 1), kind="stable")[:left]] += 1
        return cls(seen, freq, bits)

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Where each id stands in the table."""
        if not len(self.ids) or int(self.ids[-1]) >= DENSE:
            return np.searchsorted(self.ids, ids)
        if self._places is None:
            self._places = np.zeros(int(self.ids[-1]) + 1, np.int32)
            self._places[self.ids] = np.arange(len(self.ids))
        return self._places[ids]

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.ids), dtype=np.int64), self.freq.astype(np.int64))
        return self._slots


def encode_block(table: Table, ids: np.ndarray) -> bytes:
    """States of the lanes, then the words in the order of decoding."""
    n = len(ids)
    lanes = min(LANES, n)
    at = table.places(ids)
    freq, cum, bits = table.freq[at], table.cum[at], np.uint64(table.bits)
    limit = (LOW >> bits) << WORD
    state = np.full(lanes, LOW, np.uint64)
    words = []
    for start in range((n - 1) // lanes * lanes, -1, -lanes):
        f, c = freq[start : start + lanes], cum[start : start + lanes]
        x = state[: len(f)]
        full = x >= f * limit
        if full.any():
            words.append((x[full] & MASK).astype("<u4"))
            x = np.where(full, x >> WORD, x)
        q = x // f
        state[: len(f)] = (q << bits) + (x - q * f) + c
    return state.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words))


def decode_block(table: Table, data: bytes, n: int) -> np.ndarray:
    lanes = min(LANES, n)
    state = np.frombuffer(data, "<u8", lanes).astype(np.uint64)
    words = np.frombuffer(data, "<u4", offset=8 * lanes).astype(np.uint64)
    out, place, bits = np.empty(n, np.int64), 0, np.uint64(table.bits)
    mask, slots = np.uint64((1 << table.bits) - 1), table.slots
    for start in range(0, n, lanes):
        x = state[: min(lanes, n - start)]
        slot = x & mask
        s = slots[slot.astype(np.int64)]
        out[start : start + len(x)] = s
        x = table.freq[s] * (x >> bits) + slot - table.cum[s]
        low = np.flatnonzero(x < LOW)
        if len(low):
            x[low] = (x[low] << WORD) | words[place : place + len(low)]
            place += len(low)
        state[: len(x)] = x
    if place != len(words) or (state != LOW).any():
        raise ValueError("a block of token ids is damaged")
    return table.ids[out]


def file_bytes(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """A whole file: blocks, table, document index, block index, footer."""
    table, out = Table.count(ids), io.BytesIO()
    out.write(MAGIC)
    index = []
    for first in range(0, len(ids), BLOCK):
        part = np.ascontiguousarray(ids[first : first + BLOCK], "<u4")
        data = encode_block(table, part)
        index.append((out.tell(), len(data), first, len(part), zlib.crc32(part.tobytes())))
        out.write(data)
    sections = {}
    for name, array in (
        ("ids", np.diff(table.ids.astype("<i8"), prepend=0).astype("<u4")), ("freq", table.freq.astype("<u4")), ("null", np.array([d is None for d in doc_ids], "u1")),
        ("doc_ids", np.array([d or 0 for d in doc_ids], "<i8")), ("lengths", lengths.astype("<i8")), ("blocks", np.array(index, "<i8").reshape(-1, 5)),
    ):
        data = zlib.compress(array.tobytes(), 6)
        sections[name] = [out.tell(), len(data), zlib.crc32(data)]
        out.write(data)
    footer = json.dumps({"bits": table.bits, "tokens": len(ids), "sections": sections}).encode()
    out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
    return out.getvalue()


class TokenFile:
    """Random access to a file: any range of ids needs only its own blocks."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file")
        length = int.from_bytes(tail[:8], "little")
        source.seek(size - 16 - length)
        self.footer = json.loads(source.read(length))
        self.tokens = self.footer["tokens"]
        self.table = Table(np.cumsum(self._section("ids", "<u4").astype(np.int64)), self._section("freq", "<u4"), self.footer["bits"])
        self.blocks = self._section("blocks", "<i8").reshape(-1, 5)
        self.lengths = self._section("lengths", "<i8")
        null = self._section("null", "u1")
        self.doc_ids = [None if x else int(d) for d, x in zip(self._section("doc_ids", "<i8"), null, strict=True)]

    def _section(self, name: str, kind: str) -> np.ndarray:
        offset, length, crc = self.footer["sections"][name]
        self.source.seek(offset)
        data = self.source.read(length)
        if zlib.crc32(data) != crc:
            raise ValueError(f"section {name} of a token file is damaged")
        return np.frombuffer(zlib.decompress(data), kind)

    def block(self, k: int) -> np.ndarray:
        offset, length, _, n, crc = map(int, self.blocks[k])
        self.source.seek(offset)
        ids = decode_block(self.table, self.source.read(length), n)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {k} of a token file is damaged")
        return ids

    def read(self, start: int, length: int) -> np.ndarray:
        if not length:
            return np.zeros(0, "<u4")
        k, end, parts = start // BLOCK, start + length, []
        while k * BLOCK < end:
            ids = self.block(k)
            parts.append(ids[max(0, start - k * BLOCK) : end - k * BLOCK])
            k += 1
        return np.concatenate(parts)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, place in the file and ids, with one block in memory beside
        the document's own ids."""
        ids, first, place = np.zeros(0, "<u4"), 0, 0
        k = 0
        for doc_id, length in zip(self.doc_ids, self.lengths.tolist(), strict=True):
            parts, need = [], length
            while need:
                if first >= len(ids):
                    ids, first, k = self.block(k), 0, k + 1
                part = ids[first : first + need]
                parts.append(part)
                first += len(part)
                need -= len(part)
            yield doc_id, place, (parts[0] if len(parts) == 1 else np.concatenate(parts)) if parts else np.zeros(0, "<u4")
            place += length


def write(docs: DataFrame, out: str, path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode and write all documents below ``out``; the manifest, one row per file."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    weights = common.stage(rows.select(F.col("doc_id").alias("k"), (F.octet_length("text") + 64).alias("w")), "tokens-weights")
    total = weights.agg(F.sum("w")).first()[0] or 0
    ranges = common.ranges_of(weights, max(2 * common.partitions(spark), -(-total // SHARD_BYTES)))
    common.discard(weights)
    dealt = rows.withColumn("shard", common.shard_of("doc_id", ranges)).repartitionById(ranges.shards, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "text")
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokens.load(path)
        fs, root = common.open_fs(out)
        fs.create_dir(root, recursive=True)
        shard, seq, pending, ids, lengths = None, 0, [], bytearray(), []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq, pending, lengths
            if not pending:
                return
            data = file_bytes(np.frombuffer(ids, "<u4"), pending, np.array(lengths))
            name = f"tokens-{shard:08d}-{seq:06d}.pltk"
            temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(temporary) as f:
                f.write(data)
            common.publish(fs, temporary, f"{root}/{name}")
            row = {"shard": shard, "seq": seq, "file": name, "docs": len(pending), "tokens": sum(lengths), "bytes": len(data), "crc32": zlib.crc32(data)}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64()), ("crc32", pa.int64())]))
            seq, pending, lengths = seq + 1, [], []

        for batch in batches:
            for key, found, place in zip(batch.column(0).to_pylist(), bpe.encode_batch(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if place != shard or len(ids) >= 4 * file_tokens:
                    yield from flush()
                    ids = bytearray()
                    if place != shard:
                        shard, seq = place, 0
                ids += found.astype("<u4").tobytes()
                ids += tail
                pending.append(key)
                lengths.append(len(found) + 1)
        yield from flush()

    return common.stage(dealt.mapInArrow(run, "shard int, seq int, file string, docs long, tokens long, bytes long, crc32 long"), "tokens-manifest")


def read(spark: SparkSession, out: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Places are sums over the manifest: over the shards, one row each, and within
    a shard over its files.
    """
    shards = manifest.groupBy("shard").agg(F.sum("tokens").alias("n"))
    sooner = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(sooner), F.lit(0)).alias("base"))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("before", before).join(shards, "shard")
    files = files.select("file", "bytes", (F.col("base") + F.col("before")).alias("start")).repartition(max(1, manifest.count()), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.open_fs(out)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for file in batch.to_pylist():
                with fs.open_input_file(f"{root}/{file['file']}") as source:
                    rows: list[list] = [[], [], [], []]
                    for doc_id, place, ids in TokenFile(source).documents():
                        for column, value in zip(rows, (doc_id, file["start"] + place, len(ids), zlib.crc32(ids.tobytes())), strict=True):
                            column.append(value)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], schema=schema)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
