"""Session settings that the operators expect."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: UTC keeps NTZ fixtures and epoch seconds alike; AQE sizes, coalesces and splits shuffles.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """A session with ``SETTINGS``; cluster properties stay with the cluster."""
    builder = SparkSession.builder.appName("packlake").config(map=SETTINGS | settings)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so they can
    import it wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_packlake_shipped", False):
        return
    folder = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="packlake-"), "packlake.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(folder):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(base, name)
                    z.write(path, os.path.join("packlake", os.path.relpath(path, folder)))
    context.addPyFile(archive)
    context._packlake_shipped = True
