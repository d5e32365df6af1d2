"""Probes of sources and destinations, and folders that follow a renamed job.

A place is a path or any URI that Spark's file systems open; ``ssh://`` places
are probed by a function of the caller's.
"""

from __future__ import annotations

import os
import stat
import uuid
from collections.abc import Callable
from urllib.parse import urlsplit

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from packlake.sources.config import Job

PROBE = ".packlake-write-test-"


def _file_system(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place if "://" in place else f"file://{place}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _source(spark: SparkSession, place: str) -> str | None:
    if "://" in place:
        fs, path = _file_system(spark, place)
        return None if fs.exists(path) else "the source isn't there"
    mode = os.lstat(place).st_mode
    if stat.S_ISLNK(mode):
        return "the source is a symbolic link"
    return None if stat.S_ISDIR(mode) or stat.S_ISREG(mode) else "the source is neither a file nor a folder"


def _destination(spark: SparkSession, place: str) -> str | None:
    """The folder is made where it lacks, and a file written and taken away again."""
    fs, path = _file_system(spark, place)
    if fs.exists(path) and not fs.getFileStatus(path).isDirectory():
        return "the destination isn't a folder"
    fs.mkdirs(path)
    probe = spark._jvm.org.apache.hadoop.fs.Path(path, PROBE + uuid.uuid4().hex)
    fs.create(probe, False).close()
    fs.delete(probe, False)
    return None


def problems(spark: SparkSession, jobs: list[Job], remote: Callable[[str], str | None] | None = None) -> list[tuple[str, str, str]]:
    """(job, place, problem) of everything that can't be used as configured.

    ``remote`` tells what is wrong with an ``ssh://`` place, or null; one place
    stands for all of its user, host and port.
    """
    out, asked = [], {}
    for job in jobs:
        for check, place in [(_source, job.source), *((_destination, d) for d in job.destinations)]:
            try:
                if place.startswith("ssh://"):
                    parts = urlsplit(place)
                    key = (parts.username, parts.hostname, parts.port)
                    if key not in asked:
                        asked[key] = remote(place) if remote else "there is no way to probe it"
                    wrong = asked[key]
                else:
                    wrong = check(spark, place)
            except OSError as e:
                wrong = e.strerror or str(e)
            except Py4JJavaError as e:
                wrong = str(e.java_exception.getMessage() or e.java_exception.toString())
            if wrong:
                out.append((job.name, place, wrong))
    return out


def move(spark: SparkSession, moves: list[tuple[str, str]]) -> None:
    """Rename folders (old, new) that are there; nothing is moved onto another
    folder, and all of them go back when one can't go."""
    todo, done = [], []
    for old, new in moves:
        fs, path = _file_system(spark, old)
        target = _file_system(spark, new)[1]
        if fs.exists(target):
            raise ValueError(f"{new}: there is such a folder")
        if fs.exists(path):
            todo.append((fs, path, target))
    try:
        for fs, path, target in todo:
            if not fs.rename(path, target):
                raise OSError(f"{path.toString()} can't be renamed")
            done.append((fs, path, target))
    except (OSError, Py4JJavaError):
        for fs, path, target in reversed(done):
            fs.rename(target, path)
        raise
