"""The driver's tables in the roles of snapshots, chunks, packs and deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job, name, created, size, done."""
    size = F.round("o_totalprice").cast("bigint")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("name"), F.col("o_orderdate").alias("created"), size.alias("size"), (F.col("o_orderstatus") == "F").alias("done")
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, seq, chunk, size."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("name"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("chunk"), F.round("l_quantity").cast("bigint").alias("size")
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack, chunk, stored: 40 packs that share chunks."""
    rows = table(spark, sf_dir, "lineitem").select(
        ((F.col("l_partkey") * 7 + F.col("l_orderkey") % 3) % 40).alias("pack"), F.col("l_partkey").alias("chunk"), F.round("l_quantity").cast("bigint").alias("stored")
    )
    return rows.groupBy("pack", "chunk").agg(F.min("stored").alias("stored"))


ENTRIES_SQL = """SELECT (l_partkey * 7 + l_orderkey % 3) % 40 AS pack, l_partkey AS chunk, min(CAST(round(l_quantity) AS BIGINT)) AS stored FROM lineitem GROUP BY 1, 2"""


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """destination, chunk: three destinations."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 3).alias("destination"), F.col("l_partkey").alias("chunk")).distinct()


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, job, size, created_at, completed_at (set where the order is filled)."""
    when = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("job"), F.round("o_totalprice").cast("bigint").alias("size"), when.alias("created_at"), F.when(F.col("o_orderstatus") == "F", when + F.expr("interval 1 day")).alias("completed_at")
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, destination, delivered, next_retry."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("destination"), (F.col("l_linestatus") == "F").alias("delivered"), F.col("l_shipdate").alias("next_retry")
    )
    return rows.groupBy("run_id", "destination").agg(F.bool_and("delivered").alias("delivered"), F.max("next_retry").alias("next_retry"))


RUNS_SQL = """SELECT o_orderkey AS run_id, o_custkey AS job, CAST(round(o_totalprice) AS BIGINT) AS size, o_orderdate AS created_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END AS completed_at FROM orders"""
DELIVERIES_SQL = """SELECT l_orderkey AS run_id, l_suppkey AS destination, bool_and(l_linestatus = 'F') AS delivered, max(l_shipdate) AS next_retry FROM lineitem GROUP BY 1, 2"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, chunk, size, destination of the documents as a stream of files."""
    text = F.col("text")
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("seq"), F.sha2(text, 256).alias("chunk"), F.octet_length(text).cast("bigint").alias("size"), F.col("source").alias("destination")
    )


CONTENT_SQL = """SELECT doc_id AS seq, sha256(text) AS chunk, octet_length(encode(text)) AS size, source AS destination FROM documents"""
