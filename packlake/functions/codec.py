"""LZ4 by Arrow's codecs: blocks for chunks, frames for exported streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stored_form(data: bytes) -> tuple[bytes, bool]:
    """The smaller of raw and compressed; raw unless compression strictly wins."""
    packed = pa.compress(data, codec="lz4_raw", asbytes=True) if data else data
    return (packed, True) if len(packed) < len(data) else (data, False)


def restored(data: bytes, size: int, compressed: bool) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="lz4_raw", asbytes=True) if compressed else data


def frame(data: bytes) -> bytes:
    return pa.compress(data, codec="lz4", asbytes=True)


def unframe(source) -> Iterator[bytes]:
    """The content of an LZ4 frame file, by pieces."""
    with pa.CompressedInputStream(source, "lz4") as f:
        while data := f.read(1 << 20):
            yield data


@F.pandas_udf(T.StructType([T.StructField("stored", T.BinaryType()), T.StructField("compressed", T.BooleanType())]))
def compress(data: pd.Series) -> pd.DataFrame:
    forms = [stored_form(bytes(x)) if x is not None else (None, None) for x in data]
    return pd.DataFrame(forms, columns=["stored", "compressed"])


@F.pandas_udf(T.BinaryType())
def decompress(stored: pd.Series, size: pd.Series, compressed: pd.Series) -> pd.Series:
    return pd.Series([restored(bytes(x), int(n), bool(c)) if x is not None else None for x, n, c in zip(stored, size, compressed, strict=True)])


@F.pandas_udf(T.LongType())
def stored_size(data: pd.Series) -> pd.Series:
    return pd.Series([len(stored_form(bytes(x))[0]) if x is not None else None for x in data], dtype="Int64")
