"""Directory scans as a Spark data source.

``spark.read.format("packlake_files").option("root", path).load()`` lists a
folder, or one file, without following links. Exclusions prune while walking:
an excluded folder is never entered. Each row has a disposition: stored, or why
it isn't (mount, special, unreadable). Folders are opened from the root downwards
until there are enough of them to deal, so one large folder below the root is
walked by many tasks too; all of them must see the root.
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from packlake.functions.ignore import compiled
from packlake.schemas import FILE


def mount_points(text: str | None = None) -> set[str]:
    """Mount points of this machine, escapes decoded."""
    if text is None:
        try:
            with open("/proc/self/mountinfo") as f:
                text = f.read()
        except OSError:
            return set()
    fields = (line.split() for line in text.splitlines())
    return {re.sub(r"\\([0-7]{3})", lambda m: chr(int(m[1], 8)), f[4]) for f in fields if len(f) > 4}


class Excluder:
    """The last pattern that matches decides."""

    def __init__(self, lines: list[str]):
        self.patterns = [(re.compile(p.regex), p) for line in lines if (p := compiled(line))]

    def __call__(self, path: str, folder: bool) -> bool:
        out = False
        for regex, p in self.patterns:
            if regex.search(path) and (folder or not p.folders_only):
                out = not p.include
        return out


class Part(InputPartition):
    """Paths to walk below the root, and folders to list by themselves."""

    def __init__(self, names: list[str], alone: list[str]):
        self.names, self.alone = names, alone


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.path.abspath(options["root"])
        if os.path.islink(self.root):
            raise ValueError(f"the source is a symbolic link: {self.root}")
        self.exclude = [x for x in options.get("exclude", "").split("\n") if x]
        self.tasks = int(options.get("tasks", "16"))

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.root):
            return [Part([""], [])]
        excluded, mounts = Excluder(self.exclude), mount_points()
        device, names, alone, closed = os.lstat(self.root).st_dev, sorted(os.listdir(self.root)), [], []

        def children(name: str) -> list[str] | None:
            """The entries of a folder that the scan enters, else null."""
            path = os.path.join(self.root, name)
            try:
                info = os.lstat(path)
                if not stat.S_ISDIR(info.st_mode) or info.st_dev != device or path in mounts or excluded(name, True):
                    return None
                return [f"{name}/{x}" for x in sorted(os.listdir(path))]
            except OSError:
                return None

        # level by level: what isn't a folder stays as it is
        while names and len(names) + len(closed) < self.tasks * 4:
            below = []
            for name in names:
                found = children(name)
                if found is None:
                    closed.append(name)
                else:
                    alone.append(name)
                    below += found
            names = below
        names = sorted(names + closed)
        return [Part(part, alone[i :: self.tasks]) for i in range(self.tasks) if (part := names[i :: self.tasks]) or alone[i :: self.tasks]] or [Part([], [])]

    def read(self, partition: Part) -> Iterator[tuple]:
        excluded, mounts = Excluder(self.exclude), mount_points()
        device = os.lstat(self.root).st_dev

        def visit(path: str, relative: str, below: bool = True) -> Iterator[tuple]:
            try:
                info = os.lstat(path)
            except OSError as e:
                yield (relative, *[None] * 14, "unreadable", str(e))
                return
            folder = stat.S_ISDIR(info.st_mode)
            if relative and excluded(relative, folder):
                return
            if folder and relative and (path in mounts or info.st_dev != device):
                yield (relative, "dir", *[None] * 13, "mount", "another file system")
                return
            kind = "dir" if folder else "file" if stat.S_ISREG(info.st_mode) else "symlink" if stat.S_ISLNK(info.st_mode) else None
            if kind is None:
                yield (relative, *[None] * 14, "special", "not a file, folder or link")
                return
            try:
                target = os.readlink(path) if kind == "symlink" else None
                attrs = [(n, os.getxattr(path, n, follow_symlinks=False)) for n in sorted(os.listxattr(path, follow_symlinks=False))] if hasattr(os, "listxattr") else []
                names = sorted(os.listdir(path)) if folder else []
            except OSError as e:
                yield (relative, kind, *[None] * 13, "unreadable", str(e))
                return
            yield (
                relative, kind, info.st_size, info.st_dev, info.st_ino, info.st_nlink, info.st_mtime_ns // 10**9, info.st_mtime_ns % 10**9, info.st_ctime_ns // 10**9, info.st_ctime_ns % 10**9,
                info.st_mode, info.st_uid, info.st_gid, target, attrs, "stored", None,
            )
            for name in names if below else []:
                yield from visit(os.path.join(path, name), f"{relative}/{name}" if relative else name)

        for name in partition.alone:
            yield from visit(os.path.join(self.root, name), name, False)
        for name in partition.names:
            yield from visit(os.path.join(self.root, name) if name else self.root, name or os.path.basename(self.root))


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packlake_files"

    def schema(self) -> str:
        return FILE

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return Reader(dict(self.options))


def scan(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(FilesSource)
    return spark.read.format("packlake_files").option("root", root).option("exclude", "\n".join(exclude or [])).load()


def contents(spark: SparkSession, root: str) -> DataFrame:
    """path and bytes of the files below a root, of any store Spark reads."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    relative = F.regexp_replace("path", "^.*?" + re.escape(base.split("://")[-1]) + "/?", "")
    return files.select(relative.alias("path"), F.col("content").alias("bytes"), F.col("modificationTime").alias("modified"))


def listing(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """path, modified, length of the visible files with a suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def log_lines(spark: SparkSession, root: str, follow: bool = False) -> DataFrame:
    """Lines of a log folder; with ``follow`` as a stream."""
    return (spark.readStream if follow else spark.read).format("text").load(root)


def responses(spark: SparkSession, root: str, prefix: str, schema: str) -> DataFrame:
    """Prefixed JSON lines among other output, parsed."""
    lines = spark.read.text(root).where(F.col("value").startswith(prefix))
    return lines.select(F.from_json(F.substring("value", F.lit(len(prefix) + 1), F.length("value")), schema).alias("r")).select("r.*")
