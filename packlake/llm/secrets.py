"""Secret scans: plain patterns, then structural confirmation.

The patterns report by form. Structural confirmation decodes base64 and hex
candidates and reports them only if the bytes parse: private keys in DER
(PKCS #1, PKCS #8, SEC 1) or OpenSSH form, whose nested lengths must tile the
value, and signed tokens whose first part is a JSON header naming an algorithm.
Keys in base64 may be wrapped at any width, by line breaks or by "\\n" and
"\\r\\n" written out, with indented lines; one may start at any character of a run,
and hex at any digit.

Null and empty texts have no spans, and an empty table gives no rows. Repeated
rows are scanned each by itself; other columns are not read. Texts are scanned
whole, one at a time, so memory follows the longest text; time follows its length,
as each run of base64 is decoded at most once for each of its four phases.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from packlake.llm import common

# The base patterns and their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "key", "jwt")

# DER of a key begins with 0x30 and a length of one byte, or 0x81 to 0x84 before it; an OpenSSH key with its name.
KEY_START = re.compile(r"M(?=[A-H]|I[E-T])|b(?=3Bl)")
LINE = re.compile(r"[A-Za-z0-9+/_-]++")
BREAK = re.compile(r"(?:\r?\n|(?:\\{1,2}r)?\\{1,2}n)[\x20\t]*+(?=[A-Za-z0-9+/_-])")
PADDING = re.compile(r"={0,2}")
LEAST_KEY = 27  # bytes: SEC 1 of a 160-bit key without parameters
MOST_PARTS = 16  # items of a key: PKCS #1 has ten, the others fewer
HEX_START = re.compile(rb"0|openssh-key-v1\0")
HEX_RUN = re.compile(r"[0-9a-fA-F]{64,}+")
# The second and third part; the first is read backwards from the dot, so that each part is tried as a first one.
TOKEN_REST = re.compile(r"\.(?=([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]{8,}+))")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Matches per kind, leftmost first; those too short are dropped, and what
    they covered stays covered."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def der_item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the value at ``at``, or None if it doesn't fit."""
    if at + 2 > end:
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if length & 0x80:
        count = length & 0x7F
        if not 1 <= count <= 4 or at + count > end:
            return None
        length, at = int.from_bytes(data[at : at + count], "big"), at + count
        if length < 0x80:
            return None
    return (tag, at, at + length) if at + length <= end else None


def der_children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The items that tile a constructed value, or None; also where they are
    more than any key has."""
    out = []
    while at < end:
        item = der_item(data, at, end)
        if item is None or len(out) == MOST_PARTS:
            return None
        out.append(item)
        at = item[2]
    return out


def der_key(data: bytes, at: int = 0, end: int | None = None) -> int:
    """Length of the private key in DER that stands at ``at``, or 0."""
    end = len(data) if end is None else end
    # every layout below is a sequence that begins with an integer or a sequence, which two bytes tell
    if end - at < 3 or data[at] != 0x30:
        return 0
    first = at + 2 + (data[at + 1] & 0x7F if data[at + 1] & 0x80 else 0)
    if first >= end or data[first] not in (0x02, 0x30):
        return 0
    top = der_item(data, at, end)
    if top is None:
        return 0
    parts = der_children(data, top[1], top[2])
    if not parts:
        return 0
    tags, size = [p[0] for p in parts], top[2] - at
    small = tags[0] == 0x02 and parts[0][2] - parts[0][1] == 1 and data[parts[0][1]] <= 1
    named = lambda p: (x := der_children(data, p[1], p[2])) and x[0][0] == 0x06
    if small and len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return size
    if small and len(tags) >= 3 and tags[1:3] == [0x30, 0x04] and named(parts[1]):
        inner = der_item(data, parts[2][1], parts[2][2])
        return size if inner and inner[0] in (0x30, 0x04) and inner[2] == parts[2][2] else 0
    if small and len(tags) >= 2 and tags[1] == 0x04 and parts[1][2] - parts[1][1] in (20, 24, 28, 32, 48, 66) and set(tags[2:]) <= {0xA0, 0xA1}:
        return size
    if len(tags) == 2 and tags == [0x30, 0x04] and named(parts[0]):
        return size
    return 0


MAGIC = b"openssh-key-v1\0"


def openssh_key(data: bytes, at: int = 0, end: int | None = None) -> int:
    """Length of the OpenSSH private key that stands at ``at``, or 0."""
    start, end = at, len(data) if end is None else end
    if not data.startswith(MAGIC, at, end):
        return 0
    at += len(MAGIC)

    def field(at: int) -> int:
        if at + 4 > end:
            return -1
        stop = at + 4 + int.from_bytes(data[at : at + 4], "big")
        return stop if stop <= end else -1

    for _ in range(3):
        if (at := field(at)) < 0:
            return 0
    if at + 4 > end:
        return 0
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= 16:
        return 0
    for _ in range(keys + 1):
        if (at := field(at)) < 0:
            return 0
    return at - start


def key_length(data: bytes, at: int = 0, end: int | None = None) -> int:
    return der_key(data, at, end) if data[at] == 0x30 else openssh_key(data, at, end)


def _base64(text: str) -> bytes:
    text = text.replace("-", "+").replace("_", "/").rstrip("=")
    if len(text) % 4 == 1:
        text = text[:-1]
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _json(part: str) -> object:
    try:
        return json.loads(_base64(part))
    except (ValueError, RecursionError):
        return None


class Run:
    """Base64 characters from a place of the text on, over line breaks."""

    def __init__(self, text: str, at: int):
        self.starts, self.offsets, parts, held = [], [0], [], 0
        while m := LINE.match(text, at):
            self.starts.append(m.start())
            parts.append(m[0])
            held += len(m[0])
            self.offsets.append(held)
            at = self.end = m.end()
            if not (m := BREAK.match(text, at)):
                break
            at = m.end()
        self.chars = "".join(parts).replace("-", "+").replace("_", "/")
        self.phases: dict[int, bytes] = {}
        self.last: dict[int, int] = {}

    def line(self, offset: int) -> int:
        return bisect.bisect_right(self.offsets, offset) - 1

    def place(self, offset: int) -> int:
        """Where in the text the character ``offset`` stands."""
        k = self.line(offset)
        return self.starts[k] + offset - self.offsets[k]

    def offset(self, place: int) -> int:
        k = bisect.bisect_right(self.starts, place) - 1 if len(self.starts) > 1 else 0
        return self.offsets[k] + place - self.starts[k]

    def after_key(self, offset: int) -> int:
        """The offset after the key that starts at ``offset``, or 0."""
        phase = offset % 4
        if phase not in self.phases:
            chars = self.chars[phase:]
            self.phases[phase] = base64.b64decode(chars + "A" * (-len(chars) % 4))
        end = (len(self.chars) - phase) * 3 // 4
        at = (offset - phase) // 4 * 3
        size = key_length(self.phases[phase], at, end) if end - at >= LEAST_KEY else 0
        return offset - (-size * 4 // 3) if size else 0

    def after_keys(self, offset: int) -> int:
        """The offset after all keys that follow each other from ``offset`` on."""
        seen = []
        while offset not in self.last and (after := self.after_key(offset)):
            seen.append(offset)
            offset = after
        end = self.last.get(offset, offset)
        for x in seen:
            self.last[x] = end
        return end


def base64_keys(text: str) -> list[Span]:
    """Keys in base64, also several in a row. What holds one line only must end
    with a key."""
    out: list[Span] = []
    done, run = 0, None
    for m in KEY_START.finditer(text):
        if m.start() < done:
            continue
        if run is None or m.start() >= run.end:
            run = Run(text, m.start())
        at = run.offset(m.start())
        if len(run.chars) - at < LEAST_KEY * 4 // 3 or (end := run.after_keys(at)) == at:
            continue
        inside = end < len(run.chars) and run.line(end) == run.line(end - 1)
        if inside and run.line(at) == len(run.starts) - 1:
            continue
        while at < end:
            after = run.after_key(at)
            stop = run.place(after - 1) + 1
            out.append(("key", run.place(at), PADDING.match(text, stop).end()))
            at, done = after, out[-1][2]
    return out


def hex_keys(text: str) -> list[Span]:
    """Keys in hex that end with their run of digits."""
    out = []
    for m in HEX_RUN.finditer(text):
        found = None
        for phase in (0, 1):
            digits = m[0][phase:]
            data = bytes.fromhex(digits[: len(digits) // 2 * 2])
            for start in HEX_START.finditer(data):
                at = start.start()
                if len(data) - at >= LEAST_KEY and key_length(data, at) == len(data) - at:
                    place = m.start() + phase + 2 * at
                    found = min(found or (len(text), 0), (place, place + 2 * (len(data) - at)))
                    break
        if found:
            out.append(("key", *found))
    return out


def confirmed_spans(text: str) -> list[Span]:
    """Candidates whose decoded bytes parse as a key or a signed token."""
    out = base64_keys(text) + hex_keys(text)
    for m in TOKEN_REST.finditer(text):
        at = m.start()
        while at and (c := text[at - 1]).isascii() and (c.isalnum() or c in "_-"):
            at -= 1
        if text[at - 1 : at + 1] == "\\n":
            at += 1
        header = text[at : m.start()]
        if len(header) < 8:
            continue
        found = _json(header)
        if isinstance(found, dict) and isinstance(found.get("alg"), str) and found["alg"].lower() != "none" and _json(m[1]) is not None and len(_base64(m[2])) >= 6:
            out.append(("jwt", at, m.end(2)))
    return out


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, by start, then kind."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=order)
    return base, sorted(base + confirmed_spans(text), key=order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: base counts and digest, all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
        for batch in batches:
            columns: list[list] = [[] for _ in range(5)]
            for value in batch.column(1):
                base, spans = scan(value.as_py() or "")
                for i, kind in enumerate(KINDS[:3]):
                    columns[i].append(sum(s[0] == kind for s in base))
                columns[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
                columns[4].append(joined(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, t.type) for c, t in zip(columns, list(schema)[1:], strict=True)]], schema=schema)

    return docs.select(doc_id, text).mapInArrow(run, SCHEMA)


def without_secrets(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with each found span replaced by ``mask``; all rows and columns stay."""
    names = docs.columns
    at = names.index(text)

    def redact(value: str | None) -> str | None:
        if not value:
            return value
        _, spans = scan(value)
        if not spans:
            return value
        out, end = [], 0
        for _, a, b in spans:
            if a >= end:
                out += [value[end:a], mask]
            end = max(end, b)
        return "".join(out) + value[end:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pa.array([redact(v.as_py()) for v in batch.column(at)], batch.column(at).type)
            yield pa.RecordBatch.from_arrays([column if i == at else batch.column(i) for i in range(batch.num_columns)], schema=batch.schema)
        common.release()

    return docs.mapInArrow(run, docs.schema)
