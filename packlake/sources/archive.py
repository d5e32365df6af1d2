"""TAR archives in LZ4 frames: export, restore to a folder, import of old ones.

Export and restore stream chunk by chunk through the driver, as they write one
local file or folder; import decodes archives on the executors. Modes, times,
owners, extended attributes, links and empty folders go along; owners are set
only where the user may.
"""

from __future__ import annotations

import hashlib
import io
import os
import shutil
import tarfile
import uuid
from collections.abc import Iterator
from decimal import ROUND_FLOOR, Decimal
from itertools import chain, groupby
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from packlake.functions.codec import unframe
from packlake.functions.names import first_token, is_archive_name, parsed_created, parsed_job
from packlake.operators.legacy import in_order

if TYPE_CHECKING:
    from packlake.sources.tables import Store


#: Bytes that a partition holds at most on its way through the driver.
STREAMED = 64 << 20
XATTR = "SCHILY.xattr."
TYPES = {"dir": tarfile.DIRTYPE, "symlink": tarfile.SYMTYPE, "file": tarfile.REGTYPE}


class Joined(io.RawIOBase):
    """The chunks of a file in a row, read as one stream."""

    def __init__(self, first: Row, rest: Iterator[Row]):
        self.rows, self.left = chain([first], rest), memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.left and (row := next(self.rows, None)) is not None:
            if row["piece"] is not None and row["bytes"] is None:
                raise ValueError(f"{row['path']}: chunks are lost")
            self.left = memoryview(bytes(row["bytes"] or b""))
        n = min(len(buffer), len(self.left))
        buffer[:n], self.left = self.left[:n], self.left[n:]
        return n


def _ordered(store: Store, name: str, *peers: Store) -> Iterator[Row]:
    """The entries of a snapshot by path, each beside its chunks in order."""
    entries, pieces = store.entries(name), store.pieces(name, *peers).withColumnRenamed("seq", "piece")
    total = entries.agg(F.sum("size")).first()[0] or 0
    rows = entries.join(pieces, "path", "left").repartitionByRange(total // STREAMED + 1, "path", "piece")
    return rows.sortWithinPartitions("path", "piece").toLocalIterator()


def _header(row: Row) -> tarfile.TarInfo:
    info = tarfile.TarInfo(row["path"])
    info.type, info.linkname = TYPES[row["kind"]], row["link_target"] or ""
    info.size = row["size"] if row["kind"] == "file" else 0
    if row["hard_target"] is not None:
        info.type, info.linkname, info.size = tarfile.LNKTYPE, row["hard_target"], 0
    if row["mode"] is not None:
        info.mode, info.uid, info.gid, info.mtime = row["mode"] & 0o7777, row["uid"], row["gid"], row["mtime"]
        if row["mtime_ns"]:
            info.pax_headers["mtime"] = f"{row['mtime'] + Decimal(row['mtime_ns']).scaleb(-9):f}"
    info.pax_headers |= {XATTR + x["name"]: bytes(x["value"]).decode("utf-8", "surrogateescape") for x in row["xattrs"] or []}
    return info


def export(store: Store, name: str, path: str) -> int:
    """Write a snapshot as one archive, complete or not at all; the files in it."""
    partial, count = f"{os.path.dirname(path) or '.'}/.{os.path.basename(path)}.{uuid.uuid4().hex}.partial", 0
    try:
        with open(partial, "wb", opener=lambda p, f: os.open(p, f, 0o600)) as raw, pa.CompressedOutputStream(raw, "lz4") as packed, tarfile.open(fileobj=packed, mode="w|", format=tarfile.PAX_FORMAT) as tar:
            for _, rows in groupby(_ordered(store, name), key=lambda row: row["path"]):
                first = next(rows)
                tar.addfile(_header(first), io.BufferedReader(Joined(first, rows)))
                count += first["kind"] == "file"
        os.replace(partial, path)
    finally:
        if os.path.exists(partial):
            os.unlink(partial)
    return count


def _inside(base: str, path: str) -> str:
    """Where a path of a snapshot goes below a folder; it may not leave it, not by
    a link either."""
    target = os.path.join(base, path)
    parent = os.path.realpath(os.path.dirname(target))
    if os.path.basename(target) in ("", ".", "..") or (parent != base and not parent.startswith(base.rstrip(os.sep) + os.sep)):
        raise ValueError(f"{path}: outside of the folder")
    return os.path.join(parent, os.path.basename(target))


def _dress(target: str, row: Row) -> None:
    """Give a restored path its owner, mode, attributes and time."""
    if row["mode"] is None:
        return
    if os.geteuid() == 0:
        os.chown(target, row["uid"], row["gid"], follow_symlinks=False)
    if row["kind"] != "symlink":
        os.chmod(target, row["mode"] & 0o7777)
    for x in row["xattrs"] or []:
        try:
            os.setxattr(target, x["name"], bytes(x["value"]), follow_symlinks=False)
        except OSError:
            pass  # the file system has no such attributes
    at = row["mtime"] * 10**9 + (row["mtime_ns"] or 0)
    os.utime(target, ns=(at, at), follow_symlinks=False)


def restore_to(store: Store, name: str, folder: str, *peers: Store) -> int:
    """Write a snapshot's files below a folder; none may leave it. Links come after
    the files, and folders get their modes last."""
    base, count = os.path.realpath(folder), 0
    os.makedirs(base, exist_ok=True)
    entries = store.entries(name)
    for row in entries.where("kind = 'dir'").orderBy("path").toLocalIterator():
        os.makedirs(_inside(base, row["path"]), exist_ok=True)
    for path, rows in groupby(_ordered(store, name, *peers), key=lambda row: row["path"]):
        first = next(rows)
        if first["kind"] != "file" or first["hard_target"] is not None:
            continue
        target = _inside(base, path)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        partial = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}.partial"
        try:
            with open(partial, "wb") as f:
                shutil.copyfileobj(io.BufferedReader(Joined(first, rows)), f)
            _dress(partial, first)
            os.replace(partial, target)
        finally:
            if os.path.exists(partial):
                os.unlink(partial)
        count += 1
    for row in entries.where("hard_target is not null or kind = 'symlink'").orderBy(F.col("hard_target").isNull(), "path").toLocalIterator():
        target = _inside(base, row["path"])
        os.makedirs(os.path.dirname(target), exist_ok=True)
        if os.path.lexists(target):
            os.unlink(target)
        if row["hard_target"] is not None:
            os.link(_inside(base, row["hard_target"]), target, follow_symlinks=False)
            count += 1
        else:
            os.symlink(row["link_target"], target)
            _dress(target, row)
    for row in entries.where("kind = 'dir'").orderBy(F.desc("path")).toLocalIterator():
        _dress(_inside(base, row["path"]), row)
    return count


def originals(spark: SparkSession, root: str) -> DataFrame:
    """archive, bytes, expected: old archives with the checksum of the file beside them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.lz4").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select(name.alias("archive"), F.col("content").alias("bytes")).where(is_archive_name(F.col("archive")))
    sums = spark.read.option("pathGlobFilter", "*.sha256").option("wholetext", "true").option("recursiveFileLookup", "true").text(root)
    sums = sums.select(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.sha256$", "").alias("archive"), first_token(F.col("value")).alias("expected"))
    return found.join(sums, "archive", "left")


def unpacked(archives: DataFrame) -> DataFrame:
    """archive, path, bytes, error of what is in each archive, with kind, mode,
    times, owners, links and attributes. An archive that doesn't match its checksum, or
    doesn't decode, gives one row with the error."""
    schema = pa.schema([
        ("archive", pa.string()), ("path", pa.string()), ("bytes", pa.binary()), ("error", pa.string()), ("kind", pa.string()), ("mode", pa.int32()), ("mtime", pa.int64()),
        ("mtime_ns", pa.int64()), ("uid", pa.int32()), ("gid", pa.int32()), ("link_target", pa.string()), ("hard_target", pa.string()),
        ("xattrs", pa.list_(pa.struct([("name", pa.string()), ("value", pa.binary())]))),
    ])

    def row(archive: str, tar: tarfile.TarFile, m: tarfile.TarInfo) -> tuple:
        kind = "dir" if m.isdir() else "symlink" if m.issym() else "file"
        data = tar.extractfile(m).read() if m.isfile() else None
        at = Decimal(m.pax_headers.get("mtime", m.mtime))
        seconds = at.to_integral_value(ROUND_FLOOR)
        attrs = [{"name": k[len(XATTR) :], "value": v.encode("utf-8", "surrogateescape")} for k, v in m.pax_headers.items() if k.startswith(XATTR)]
        return archive, m.name, data, None, kind, m.mode, int(seconds), int((at - seconds) * 10**9), m.uid, m.gid, m.linkname if m.issym() else None, m.linkname if m.islnk() else None, attrs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, data, expected in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                content, rows = data.as_py(), []
                try:
                    if expected is not None and hashlib.sha256(content).hexdigest() != expected:
                        raise ValueError("the checksum doesn't match")
                    plain = b"".join(unframe(io.BytesIO(content)))
                    with tarfile.open(fileobj=io.BytesIO(plain), mode="r:") as tar:
                        rows = [row(archive, tar, m) for m in tar if m.isfile() or m.isdir() or m.issym() or m.islnk()]
                except (ValueError, OSError, tarfile.TarError, pa.ArrowException) as e:
                    rows = [(archive, None, None, str(e), *[None] * 9)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return archives.select("archive", "bytes", "expected").mapInArrow(run, "archive string, path string, bytes binary, error string, kind string, mode int, mtime bigint, mtime_ns bigint, uid int, gid int, link_target string, hard_target string, xattrs array<struct<name:string,value:binary>>")


def import_into(stores: list[Store], archives: DataFrame) -> list[tuple[str, str, str | None]]:
    """(archive, root of the store, error or null) of old archives, oldest first.

    ``archives`` (archive, bytes, expected, and position where a name has several
    copies) holds each copy; the first that matches its checksum feeds every store
    that lacks it, under its own name. A store's outcome is judged on its own,
    after its chunks were read back; only then may its original go. A name that
    doesn't parse is an error of its own.
    """
    out = []
    if "position" not in archives.columns:
        archives = archives.withColumn("position", F.lit(0))
    listed = archives.select("archive").distinct().select("archive", parsed_job(F.col("archive")).alias("job"), parsed_created(F.col("archive")).alias("created"))
    for archive, job, created in [(r["archive"], r["job"], r["created"]) for r in in_order(listed).collect()]:
        lacking = [s for s in stores if not s.table("snapshot").where(F.col("name") == archive).limit(1).count()]
        if job is None or created is None:
            out += [(archive, s.root, "the name doesn't parse") for s in stores]
            continue
        if not lacking:
            continue
        copies, error = archives.where(F.col("archive") == archive), "there is no copy"
        for position in [r["position"] for r in copies.select("position").distinct().orderBy("position").collect()]:
            with lacking[0]._staged(unpacked(copies.where(F.col("position") == position))) as rows:
                bad = rows.where("error is not null").select("error").first()
                error = bad["error"] if bad else None
                if error is None:
                    entries = rows.withColumn("disposition", F.lit("stored"))
                    for store in lacking:
                        out.append((archive, store.root, _imported(store, archive, job, created, rows, entries)))
                    break
        if error is not None:
            out += [(archive, s.root, error) for s in lacking]
    return out


def _imported(store: Store, name: str, job: str, created, rows: DataFrame, entries: DataFrame) -> str | None:
    """The error of one store's import, or null once its chunks read."""
    files = rows.where("kind = 'file' and hard_target is null").select("path", F.coalesce("bytes", F.lit(b"")).alias("bytes"))
    try:
        store.ingest(files, job, created, entries=entries, name=name)
    except (ValueError, RuntimeError) as e:
        return str(e)
    lost = store.pieces(name).where("bytes is null").limit(1).count()
    return "chunks are lost" if lost else None
