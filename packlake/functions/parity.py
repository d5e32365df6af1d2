"""Two parity pieces over 64 data pieces: P is their XOR, Q their XOR weighted
by powers of 2 in GF(256). Any two lost pieces come back."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packlake.schemas import DATA_PIECES, PARITY_PIECES

POLYNOMIAL = 0x11D


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers and logarithms of 2 in GF(256)."""
    exp, log, x = np.zeros(512, np.uint8), np.zeros(256, np.int64), 1
    for i in range(255):
        exp[i], log[x] = x, i
        x = x << 1 ^ (POLYNOMIAL if x & 0x80 else 0)
    exp[255:510] = exp[:255]
    return exp, log


EXP, LOG = tables()


def times(a: np.ndarray, b: int) -> np.ndarray:
    if not b:
        return np.zeros_like(a)
    out = EXP[LOG[a] + LOG[b]]
    out[a == 0] = 0
    return out


def inverse(a: int) -> int:
    return int(EXP[255 - LOG[a]])


def piece_length(size: int) -> int:
    each = max(-(-size // DATA_PIECES), 2)
    return each + each % 2


def split(data: bytes) -> np.ndarray:
    """The data pieces, the last ones padded with zeros."""
    n = piece_length(len(data))
    out = np.zeros(DATA_PIECES * n, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(DATA_PIECES, n)


#: Bytes of each piece that are worked on at once.
BLOCK = 1 << 15


def parity(pieces: np.ndarray) -> np.ndarray:
    out, shift = np.empty((PARITY_PIECES, pieces.shape[1]), np.uint8), np.arange(len(pieces))[:, None]
    for at in range(0, pieces.shape[1], BLOCK):
        part = pieces[:, at : at + BLOCK]
        weighted = EXP[LOG[part] + shift]
        weighted[part == 0] = 0
        out[0, at : at + BLOCK] = np.bitwise_xor.reduce(part, axis=0)
        out[1, at : at + BLOCK] = np.bitwise_xor.reduce(weighted, axis=0)
    return out


def seal(data: bytes) -> tuple[list[bytes], list[str]]:
    """All 66 pieces and their hashes."""
    pieces = split(data)
    every = [*pieces, *parity(pieces)]
    blobs = [x.tobytes() for x in every]
    return blobs, [hashlib.sha256(x).hexdigest() for x in blobs]


def unseal(pieces: list[bytes], hashes: list[str], size: int) -> tuple[bytes, int]:
    """The data and how many pieces were rebuilt; raises if more than two are bad."""
    n = piece_length(size)
    bad = [i for i, (x, h) in enumerate(zip(pieces, hashes, strict=True)) if x is None or len(x) != n or hashlib.sha256(x).hexdigest() != h]
    if len(bad) > PARITY_PIECES:
        raise ValueError(f"{len(bad)} of {DATA_PIECES + PARITY_PIECES} pieces are damaged")
    data = np.zeros((DATA_PIECES, n), np.uint8)
    for i in range(DATA_PIECES):
        if i not in bad:
            data[i] = np.frombuffer(pieces[i], np.uint8)
    lost = [i for i in bad if i < DATA_PIECES]
    have_p, have_q = DATA_PIECES not in bad, DATA_PIECES + 1 not in bad
    given = [np.frombuffer(pieces[DATA_PIECES + i], np.uint8) if ok else None for i, ok in ((0, have_p), (1, have_q))]
    left = parity(data)
    if len(lost) == 1 and have_p:
        data[lost[0]] = left[0] ^ given[0]
    elif len(lost) == 1:
        data[lost[0]] = times(left[1] ^ given[1], inverse(int(EXP[lost[0]])))
    elif len(lost) == 2:
        a, b = lost
        p, q = left[0] ^ given[0], left[1] ^ given[1]
        data[b] = times(q ^ times(p, int(EXP[a])), inverse(int(EXP[a] ^ EXP[b])))
        data[a] = p ^ data[b]
    return data.tobytes()[:size], len(bad)


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def sealed(data: pd.Series) -> pd.Series:
    """The 66 pieces of each value."""
    return pd.Series([seal(bytes(x))[0] if x is not None else None for x in data])


@F.pandas_udf(T.StringType())
def parity_digest(data: pd.Series) -> pd.Series:
    """A hash of both parity pieces."""
    return pd.Series([hashlib.sha256(parity(split(bytes(x))).tobytes()).hexdigest() if x is not None else None for x in data])


@F.pandas_udf(T.BinaryType())
def healed(data: pd.Series, first: pd.Series, count: pd.Series) -> pd.Series:
    """Each value after ``count`` of its pieces, from ``first`` on, were damaged and
    rebuilt; null where they were too many."""

    def one(x: bytes | None, at: int, n: int) -> bytes | None:
        if x is None:
            return None
        pieces, hashes = seal(bytes(x))
        for i in range(n):
            pieces[(at + 31 * i) % len(pieces)] = None
        try:
            return unseal(pieces, hashes, len(x))[0]
        except ValueError:
            return None

    return pd.Series([one(x, int(at), int(n)) for x, at, n in zip(data, first, count, strict=True)])


def pack_seals(rows: DataFrame) -> DataFrame:
    """pack, length, hashes, p, q of packs (pack, chunk, stored): the seal of a
    pack's chunks in the order of their ids. A pack is bounded, and a task's group."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        data = b"".join(bytes(x) for x in frame.sort_values("chunk")["stored"])
        pieces, hashes = seal(data)
        return pd.DataFrame([(frame["pack"].iloc[0], len(data), hashes, *pieces[DATA_PIECES:])], columns=["pack", "length", "hashes", "p", "q"])

    return rows.select("pack", "chunk", "stored").groupBy("pack").applyInPandas(one, "pack string, length bigint, hashes array<string>, p binary, q binary")


def healed_packs(rows: DataFrame, seals: DataFrame) -> DataFrame:
    """pack, chunk, stored of packs that their seals could rebuild. ``rows`` (pack,
    chunk, length, stored) are what the index lists, with the bytes that are left."""

    def one(frame: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        frame, out = frame.sort_values("chunk"), []
        left = [(bytes(x) if x is not None else b"")[:n].ljust(n, b"\0") for x, n in zip(frame["stored"], frame["length"], strict=True)]
        if len(found) == 1 and len(data := b"".join(left)) == found["length"].iloc[0]:
            pieces = [*(x.tobytes() for x in split(data)), bytes(found["p"].iloc[0]), bytes(found["q"].iloc[0])]
            try:
                data, at = unseal(pieces, list(found["hashes"].iloc[0]), len(data))[0], 0
                for pack, chunk, n in zip(frame["pack"], frame["chunk"], frame["length"], strict=True):
                    out.append((pack, chunk, data[at : at + n]))
                    at += n
            except ValueError:
                pass  # too many pieces are damaged
        return pd.DataFrame(out, columns=["pack", "chunk", "stored"])

    packs = rows.select("pack", "chunk", "length", "stored").groupBy("pack")
    return packs.cogroup(seals.groupBy("pack")).applyInPandas(one, "pack string, chunk string, stored binary")
