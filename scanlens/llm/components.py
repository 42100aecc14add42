"""Connected components of a link table, distributed.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce
and Beyond", 2014): every step is one aggregation by vertex and one join back, so no component,
however large, meets in one task, and no link reaches the driver. Steps are checkpointed to the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import tidy


def _large_star(e: DataFrame) -> DataFrame:
    """e: (u, v) with u > v. Every larger neighbour of a vertex moves to the vertex's minimum."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a vertex, and the vertex itself, moves to the minimum."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has a link.

    ``links`` holds pairs of longs; direction, repeats and self-links do not matter. An empty
    table gives an empty result.
    """
    checkpoint_dir(links.sparkSession)
    e = (links.where(F.col(a) != F.col(b))
         .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().checkpoint())
    state = None
    while True:
        e = _small_star(_large_star(e)).checkpoint()
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == state:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        state = (now.n, now.h)
        tidy(links.sparkSession)
