"""WARC: a deterministic sharded writer and its reader.

Pages are cut into ranges of page_id of about equal bytes, fixed by the data,
and sorted within. Each range is written as one or more files of gzip members,
one member a record; a file rolls once its compressed size reaches a bound.
Headers and digests are made anew from the payload. A file is written under a
temporary name and renamed when complete, and the manifest, itself committed as
a table, lists the files that count. A task that runs twice writes the same
bytes under the same names.

Payloads that occur more than once are stored once: the record of the smallest
page_id is a response, later ones are revisit records that refer to it. Null
html is an empty payload. Rows that repeat the smallest page_id of their payload
are responses too, as nothing comes before them. A null page_id is written first,
as a response unless an equal payload has a page_id. Null urls are written as
an empty target. An empty table gives no files. Only the three named columns are
read. A payload is held whole by the task that writes it; a page_id's rows lie in
one shard, all other shards hold about ``SHARD_BYTES`` and are a task each.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlake.llm import common

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A fixed date: files are a function of their rows.
DATE = "1970-01-01T00:00:00Z"
ROLL_BYTES = 512 << 20
SHARD_BYTES = 512 << 20
LEVEL = 4


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url or ""}')}>"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def clean(value: str) -> str:
    """A header value on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None) -> bytes:
    """One record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", "revisit" if refers_to is not None else "response"),
        ("WARC-Record-ID", record_id(page_id, url)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", clean(url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, refers_url)), ("WARC-Refers-To-Target-URI", clean(refers_url or "")), ("X-Refers-To-Page-ID", str(refers_to))]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without time or name."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != VERSION:
        raise ValueError(f"not a {VERSION} record")
    headers = {k.lower(): v for k, v in (line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)}
    length = int(headers["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    return headers, rest[:length]


def members(source, size: int = 1 << 20) -> Iterator[bytes]:
    """The uncompressed members of a file, one at a time."""
    z, out = zlib.decompressobj(31), []
    while data := source.read(size):
        while data:
            out.append(z.decompress(data))
            data = b""
            if z.eof:
                data = z.unused_data
                yield b"".join(out)
                z, out = zlib.decompressobj(31), []
    if out:
        raise ValueError("a file ends within a member")


def write(pages: DataFrame, out: str, page_id: str = "page_id", url: str = "url", html: str = "html", roll_bytes: int = ROLL_BYTES, least_bytes: int = 0) -> DataFrame:
    """Write all pages below ``out``; the manifest, one row per file.

    Equal payloads shorter than ``least_bytes`` are all written as responses.
    """
    spark = pages.sparkSession
    common.bounded_batches(spark)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("html"))
    digests = common.stage(rows.select("page_id", "url", F.octet_length("html").alias("n"), F.sha2("html", 256).alias("digest")), "warc-digests")
    weights = digests.select(F.col("page_id").alias("k"), (F.col("n") + 512).alias("w"))
    total = weights.agg(F.sum("w")).first()[0] or 0
    ranges = common.ranges_of(weights, max(2 * common.partitions(spark), -(-total // SHARD_BYTES)))

    own = F.when(F.col("page_id").isNotNull(), F.struct("page_id", F.coalesce("url", F.lit("")).alias("url")))
    first = common.group_min(digests.withColumn("own", own), ["digest"], "own", "first")
    revisits = first.where((F.col("n") >= least_bytes) & ~F.col("first.page_id").eqNullSafe(F.col("page_id")) & F.col("first").isNotNull())
    # one row per page_id: equal rows of one page_id refer to the same first page unless their payloads differ
    revisits = revisits.select("page_id", "digest", "first").distinct()
    keyed = rows.withColumn("digest", F.sha2("html", 256)).withColumn("shard", common.shard_of("page_id", ranges))
    links = revisits.select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "first").withColumn("shard", common.shard_of("r_page", ranges))
    # pages and links meet by the shard, in one task's sorted stream, not by a join on the digest
    pages_side = keyed.select("page_id", "url", "html", "digest", "shard", F.lit(None).cast("struct<page_id:bigint,url:string>").alias("first"), F.lit(1).alias("is_page"))
    links_side = links.select(F.col("r_page").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"), F.col("r_digest").alias("digest"), "shard", "first", F.lit(0).alias("is_page"))
    dealt = pages_side.unionByName(links_side).repartitionById(ranges.shards, "shard")
    dealt = dealt.sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", "is_page", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.open_fs(out)
        fs.create_dir(root, recursive=True)
        schema = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("crc32", pa.int64())])
        shard, seq, file, held, link = None, 0, None, None, None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal file, held, seq
            if file is None:
                return
            file.close()
            common.publish(fs, held.pop("temporary"), f"{root}/{held['file']}")
            yield pa.RecordBatch.from_pylist([held], schema=schema)
            file, seq = None, seq + 1

        for batch in batches:
            keys, urls, digests, shards, firsts, kinds = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6))
            payloads = batch.column(2)
            for i, place in enumerate(shards):
                if not kinds[i]:
                    link = (keys[i], digests[i], firsts[i])
                    continue
                if place != shard or (file is not None and held["bytes"] >= roll_bytes):
                    yield from close()
                    if place != shard:
                        shard, seq = place, 0
                if file is None:
                    name = f"pages-{shard:08d}-{seq:06d}.warc.gz"
                    held = {"shard": shard, "seq": seq, "file": name, "records": 0, "bytes": 0, "crc32": 0, "temporary": f"{root}/.{name}.{uuid.uuid4().hex}"}
                    file = fs.open_output_stream(held["temporary"], compression=None)
                refers = link[2] if link and link[:2] == (keys[i], digests[i]) else None
                data = member(record(keys[i], urls[i], payloads[i].as_py(), refers and refers["page_id"], refers and refers["url"]))
                file.write(data)
                held["records"] += 1
                held["bytes"] += len(data)
                held["crc32"] = zlib.crc32(data, held["crc32"])
        yield from close()

    manifest = common.stage(dealt.mapInArrow(run, "shard int, seq int, file string, records long, bytes long, crc32 long"), "warc-manifest")
    common.discard(digests)
    return manifest


def read(spark: SparkSession, out: str, manifest: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of
    each record; lengths and digests are checked against the bytes."""
    files = manifest.select("file", "bytes")
    files = files.repartition(max(1, files.count()), "file")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.open_fs(out)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for data in members(source):
                        headers, block = parse(data)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        said = headers["warc-payload-digest"].removeprefix("sha1:")
                        if headers["warc-type"] == "response" and (len(payload) != size or digest(payload) != said):
                            raise ValueError(f"{name}: a payload is damaged")
                        if digest(block) != headers["warc-block-digest"].removeprefix("sha1:"):
                            raise ValueError(f"{name}: a block is damaged")
                        number = lambda k: int(headers[k]) if headers.get(k) else None  # noqa: B023, E731
                        rows.append((number("x-page-id"), headers["warc-target-uri"], size, said, headers["warc-type"], number("x-refers-to-page-id")))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
