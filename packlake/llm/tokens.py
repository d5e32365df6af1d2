"""Byte-level BPE by the tokenizers library, over Arrow batches.

A pre-token never begins before a space that stands alone between two other
characters, so the texts of a batch are cut there and each distinct piece is
encoded once by the library; what it gave is remembered in Arrow arrays, and the
pieces not used for longest are forgotten first. A text where white space meets a
space is encoded whole. Both give the ids of encoding the whole text.

The ids are the library's own. A tokenizer file (``.json``) may list added tokens,
which the library finds in any text: texts that hold one are encoded whole too.
A rank file (``.tiktoken``) has none, so such strings are ordinary text there.

Null texts count as empty and have no ids. Repeated rows are encoded alike, an
empty table gives no rows, and only the named columns are read.
Texts are encoded whole; memory follows the longest text, ``SLICE_BYTES`` and ``KNOWN``,
and what a batch took beyond that is given back after it.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from packlake.llm import common

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Texts that aren't cut: white space beside a space, at either end, or the mark.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WHOLE = rf"^ | $| {_SPACE}|{_SPACE} |\x01"
#: Stands before a text's first piece, which has no space before it.
MARK = "\x01"
#: Bytes of text that are cut at once, pieces that are remembered, and new ones that the library gets at once.
SLICE_BYTES, KNOWN, LEARN = 4 << 20, 1_000_000, 4096
#: Longer pieces are hashed by Python, shorter ones eight bytes at a time.
LONG = 64
MIX, HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)
#: The first n bytes of a little-endian word.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def byte_table() -> tuple[dict[int, str], dict[str, int]]:
    """Bytes to printable characters and back: printable Latin-1 stands for
    itself, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {b: chr(b) for b in own}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(own))
    return table, {c: b for b, c in table.items()}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[str, str]]:
    """Every pair of known parts of every token, by the token's rank: merging
    the pair of lowest rank first is then what ranks alone ask for."""
    table, _ = byte_table()
    text = lambda b: "".join(table[x] for x in b)
    out = []
    for token in sorted(ranks, key=ranks.__getitem__):
        for i in range(1, len(token)):
            if token[:i] in ranks and token[i:] in ranks:
                out.append((text(token[:i]), text(token[i:])))
    return out


def _lots(pieces: pa.Array) -> Iterator[str]:
    """The pieces in lots, each joined by spaces."""
    ends = np.minimum(np.arange(0, len(pieces) + LEARN, LEARN), len(pieces))
    for lot in pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces), pa.scalar(" ", pa.large_string())):
        yield lot.as_py()


def hashes_of(pieces: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string. Different ones may share it."""
    if not len(pieces):
        return np.zeros(0, np.uint64)
    _, offsets, data = pieces.buffers()
    ends = np.frombuffer(offsets, np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    raw = np.zeros(int(ends[-1] - ends[0]) + 8, np.uint8)
    if len(raw) > 8:
        raw[:-8] = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    words = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    starts, sizes = ends[:-1] - ends[0], np.diff(ends)
    out, at = sizes.astype(np.uint64) * MIX, 0
    rest = np.flatnonzero((sizes > 0) & (sizes <= LONG))
    while len(rest):
        x = (out[rest] ^ (words[starts[rest] + at] & FIRST[np.minimum(sizes[rest] - at, 8)])) * MIX
        out[rest] = x ^ (x >> HALF)
        at += 8
        rest = rest[sizes[rest] > at]
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = hash(raw[starts[i] : starts[i] + sizes[i]].tobytes()) & (1 << 64) - 1
    return out


class Known:
    """Pieces and their ids. A lookup finds places by hash and compares the strings,
    so it costs by what is looked up; a value set of Arrow's is hashed anew each time."""

    def __init__(self):
        self.pieces = pa.array([], pa.large_string())
        self.ids = pa.LargeListArray.from_arrays(pa.array([0], pa.int64()), pa.array([], pa.uint32()))
        #: In the order of the hashes; by place, when a piece was last used.
        self.hashes, self.places, self.used, self.clock = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), 0

    def __len__(self) -> int:
        return len(self.pieces)

    def find(self, pieces: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The place of each piece, or -1."""
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        inside = np.flatnonzero(at < len(self))
        hit = inside[self.hashes[at[inside]] == hashes[order[inside]]]
        asked, found = order[hit], self.places[at[hit]]
        same = np.asarray(pc.equal(self.pieces.take(pa.array(found)), pieces.take(pa.array(asked))))
        places = np.full(len(pieces), -1, np.int64)
        places[asked[same]] = found[same]
        return places

    def add(self, pieces: pa.Array, hashes: np.ndarray, ids: pa.Array) -> None:
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.places = np.insert(self.places, at, len(self) + order)
        self.used = np.concatenate([self.used, np.full(len(pieces), self.clock, np.int32)])
        self.pieces = pa.concat_arrays([self.pieces, pieces])
        self.ids = pa.concat_arrays([self.ids, ids])

    def touch(self, places: np.ndarray) -> None:
        """These were used; if there are more than ``KNOWN``, half as many stay, those used last."""
        self.used[places] = self.clock
        self.clock += 1
        if len(self) > KNOWN:
            keep = np.sort(np.argsort(-self.used, kind="stable")[: KNOWN // 2])
            moved = np.full(len(self), -1, np.int32)
            moved[keep] = np.arange(len(keep))
            stay = moved[self.places] >= 0
            self.hashes, self.places, self.used = self.hashes[stay], moved[self.places[stay]], self.used[keep]
            self.pieces, self.ids = self.pieces.take(pa.array(keep)), self.ids.take(pa.array(keep))


class Bpe:
    """A vocabulary file as an encoder and decoder; ``.tiktoken`` files hold
    ranks, ``.json`` files a tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

        table, back = byte_table()
        if path.endswith(".tiktoken"):
            import public_tokenizers

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            vocab = {"".join(table[x] for x in token): rank for token, rank in ranks.items()}
            self.lib = Tokenizer(models.BPE(vocab=vocab, merges=merges_of(ranks), ignore_merges=True))
            self.lib.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            )
            self.lib.decoder = decoders.ByteLevel()
        else:
            self.lib = Tokenizer.from_file(path)
            vocab = self.lib.get_vocab()
        added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        if any(" " in t for t in added) or self.lib.normalizer is not None:
            self.whole = ""  # a token or a normalizer may reach over a cut, so no text is cut
        else:
            self.whole = "|".join([WHOLE, *(re.escape(t) for t in added if t)])
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.sizes = np.array([len(x) for x in self.bytes_of], np.int64)
        self.known = Known()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        """What the library holds of a text, many times the ids, goes at once."""
        return [np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Encode unknown pieces; their places among the known ones."""
        first = np.asarray(pc.starts_with(new, MARK))
        plain, marked = new.filter(pa.array(~first)), new.filter(pa.array(first))
        ids = [x for lot in _lots(plain) for x in self._ids([" " + lot])]
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        ends = np.cumsum(np.asarray(pc.binary_length(plain)).astype(np.int64) + 1)
        reached = np.cumsum(self.sizes[flat])
        upto = np.searchsorted(reached, ends)
        if len(ends) and not (reached[upto] == ends).all():
            raise AssertionError("a token crosses the end of a piece")
        heads = [x for i in range(0, len(marked), LEARN) for x in self._ids([y[1:] for y in marked.slice(i, LEARN).to_pylist()])]
        offsets = np.concatenate([[0], upto + 1, len(flat) + np.cumsum([len(x) for x in heads], dtype=np.int64)])
        lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(np.concatenate([flat, *heads]), pa.uint32()))
        base, places = len(self.known), np.empty(len(new), np.int64)
        places[~first] = base + np.arange(len(plain))
        places[first] = base + len(plain) + np.arange(len(heads))
        self.known.add(pa.concat_arrays([plain, marked]), np.concatenate([hashes[~first], hashes[first]]), lists)
        return places

    def _encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = pc.match_substring_regex(texts, self.whole)
        odd = np.flatnonzero(np.asarray(whole))
        mark, none = pa.scalar(MARK, pa.large_string()), pa.scalar("", pa.large_string())
        split = pc.split_pattern(pc.binary_join_element_wise(mark, pc.if_else(whole, none, texts) if len(odd) else texts, none), " ")
        coded = split.flatten().dictionary_encode()
        hashes = hashes_of(coded.dictionary)
        places = self.known.find(coded.dictionary, hashes)
        unknown = places < 0
        if unknown.any():
            places[unknown] = self._learn(coded.dictionary.filter(pa.array(unknown)), hashes[unknown])
        pieces = self.known.ids.take(pa.array(places[np.asarray(coded.indices)]))
        self.known.touch(places)
        counts = np.concatenate([[0], np.cumsum(np.asarray(pieces.value_lengths()).astype(np.int64))])
        ids, offsets = np.asarray(pieces.flatten()), counts[np.asarray(split.offsets).astype(np.int64) - int(split.offsets[0].as_py())]
        if not len(odd):
            return ids, offsets
        parts = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        for i in odd.tolist():
            parts[i] = np.array(self.lib.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])

    def encode_batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.cumsum(np.asarray(pc.binary_length(texts)))
        at = 0
        while at < len(texts):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
            ids, offsets = self._encode_slice(texts.slice(at, stop - at))
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                yield ids[a:b]
            at = stop
        if len(ends) and ends[-1] >= SLICE_BYTES:
            common.release()

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_batch(pa.array([text], pa.large_string())))

    def encode_with_offsets(self, text: str | None) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and, for each, the range of characters that its bytes touch."""
        e = self.lib.encode(text or "", add_special_tokens=False)
        return e.ids, e.offsets

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text by token: a character that is split over tokens comes with the
        last of them, and bytes that are no UTF-8 as U+FFFD."""
        import codecs

        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield decoder.decode(self.bytes_of[i])
        if rest := decoder.decode(b"", True):
            yield rest


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One encoder per worker process and file."""
    return Bpe(path)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """doc_id, ids (array of int) and, on request, start and end characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids, starts, ends = [], [], []
            if offsets:
                for value in batch.column(1):
                    found, spans = bpe.encode_with_offsets(value.as_py())
                    ids.append(found)
                    starts.append([a for a, _ in spans])
                    ends.append([b for _, b in spans])
            else:
                ids = [x.astype(np.int32) for x in bpe.encode_batch(batch.column(1))]
            columns = [batch.column(0), pa.array(ids, pa.list_(pa.int32()))]
            names = [doc_id, "ids"]
            if offsets:
                columns += [pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))]
                names += ["starts", "ends"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[doc_id].dataType.simpleString()
    more = ", starts array<int>, ends array<int>" if offsets else ""
    return docs.select(doc_id, text).mapInArrow(run, f"{doc_id} {kind}, ids array<int>{more}")


def decode(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            values = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], names=[doc_id, "bytes"])

    kind = encoded.schema[doc_id].dataType.simpleString()
    return encoded.select(doc_id, ids).mapInArrow(run, f"{doc_id} {kind}, bytes binary")


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode in one pass; digests of the ids and the bytes."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        decimal = [str(i) for i in range(len(bpe.bytes_of))]
        for batch in batches:
            n, ids_digest, text_digest = [], [], []
            for found in bpe.encode_batch(batch.column(1)):
                ids = found.tolist()
                n.append(len(ids))
                ids_digest.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_digest.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[doc_id, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"{doc_id} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
