"""Content-defined chunking after FastCDC (Xia et al.), and cutting by tokens.

Cuts depend on the bytes alone. The gear table follows from a seed, so chunks
are stable within this engine but not those of other implementations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packlake.schemas import CHUNK_AVG, CHUNK_MAX, CHUNK_MIN

WINDOW = 64


def gear(seed: int = 0x5EED) -> np.ndarray:
    """256 random words from SHA-256 in counter mode."""
    data = b"".join(hashlib.sha256(f"{seed}:{i}".encode()).digest() for i in range(64))
    return np.frombuffer(data, "<u8").copy()


GEAR = gear()


def masks(average: int, level: int = 1) -> tuple[int, int]:
    """The mask before the average size, with more bits, and the one after it."""
    bits = average.bit_length() - 1
    word = lambda n: sum(1 << (63 - i) for i in range(n))
    return word(bits + level), word(bits - level)


def rolling(data: bytes) -> np.ndarray:
    """The gear hash after each byte: a sum of the last 64 shifted words."""
    g = GEAR[np.frombuffer(data, np.uint8)]
    out, span = g.copy(), 1
    while span < WINDOW:  # doubling: a window of 2n is one of n plus an older one, shifted
        shifted = np.zeros_like(out)
        shifted[span:] = out[:-span] << np.uint64(span)
        out = out + shifted
        span *= 2
    return out


def cut_points(data: bytes, least: int = CHUNK_MIN, average: int = CHUNK_AVG, most: int = CHUNK_MAX) -> list[int]:
    """Ends of the chunks. The hash looks back 64 bytes and no chunk is shorter,
    so the whole text is hashed at once and cuts are looked up."""
    if not data:
        return []
    hard, easy = masks(average)
    h = rolling(data)
    strict = np.flatnonzero((h & np.uint64(hard)) == 0) + 1
    loose = np.flatnonzero((h & np.uint64(easy)) == 0) + 1
    cuts, start, n = [], 0, len(data)
    while n - start > least:
        middle, last = min(start + average, n), min(start + most, n)
        i = np.searchsorted(strict, start + least + 1)
        if i < len(strict) and strict[i] <= middle:
            cut = int(strict[i])
        else:
            i = np.searchsorted(loose, middle + 1)
            cut = int(loose[i]) if i < len(loose) and loose[i] <= last else last
        cuts.append(cut)
        start = cut
    if start < n:
        cuts.append(n)
    return cuts


def chunked(files: DataFrame, path: str = "path", data: str = "bytes", least: int = CHUNK_MIN, average: int = CHUNK_AVG, most: int = CHUNK_MAX, keep_bytes: bool = False) -> DataFrame:
    """path, seq, offset, size, chunk and, on request, the bytes of each chunk."""
    kind = files.schema[path].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            for key, value in zip(paths, batch.column(1), strict=True):
                content = value.as_py() or b""
                ends = cut_points(content, least, average, most)
                starts = [0, *ends[:-1]]
                parts = [content[a:b] for a, b in zip(starts, ends, strict=True)] if ends else []
                columns = [
                    pa.array([key] * len(ends), batch.column(0).type), pa.array(range(len(ends)), pa.int32()), pa.array(starts if ends else [], pa.int64()),
                    pa.array([len(p) for p in parts], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()),
                ]
                names = ["path", "seq", "offset", "size", "chunk"]
                if keep_bytes:
                    columns.append(pa.array(parts, pa.binary()))
                    names.append("bytes")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return files.select(path, F.col(data).cast("binary").alias("_data")).mapInArrow(run, f"path {kind}, seq int, offset bigint, size bigint, chunk string" + ", bytes binary" * keep_bytes)


def token_chunks(docs: DataFrame, key: str, text: str, modulus: int = 16) -> DataFrame:
    """key, seq, chunk, size: texts cut after words whose hash says so, all in SQL."""
    words = docs.select(key, F.posexplode(F.split(text, " ")).alias("pos", "word"))
    ends = F.conv(F.substring(F.md5("word"), 1, 4), 16, 10).cast("bigint") % modulus == 0
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    numbered = words.withColumn("seq", F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0)).cast("bigint"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    cut = numbered.groupBy(key, "seq").agg(joined.alias("part"))
    return cut.select(key, "seq", F.sha2("part", 256).alias("chunk"), F.octet_length("part").cast("bigint").alias("size"))


def stream_hash(data: Column) -> Column:
    return F.sha2(data, 256)
