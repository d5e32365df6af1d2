"""Connected components of a graph given as edges, by alternating large and
small stars: a few joins and aggregations of the edge list each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlake.llm import common


def _large(edges: DataFrame) -> DataFrame:
    """Each vertex ties its larger neighbours to its least neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Each vertex ties its smaller neighbours and itself to their least."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v", name: str = "components") -> DataFrame:
    """u, component: each vertex that an edge to another one touches, with the
    least vertex of its component. Vertices are longs; edges may repeat or join a
    vertex to itself, which says nothing; no edges give no rows."""
    now = common.stage(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct(), name)
    mark = None
    while True:
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
        before, now = now, common.stage(_small(_large(now)), name)
        common.discard(before)
    star = now.select("u", F.col("v").alias("component"))
    return star.unionByName(star.select(F.col("component").alias("u"), "component").distinct())
