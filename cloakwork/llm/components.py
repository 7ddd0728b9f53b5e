"""Connected components by alternating minimum labels and pointer jumping.

Every step is a shuffle join or an aggregation over (vertex, label) rows, each
written to the shared folder, so nothing is collected and a lost executor only
repeats a step.  Hot vertices are pre-aggregated on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, materialize


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: then each component is a star around its least vertex."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    by = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not by.where("up > 1 or (up > 0 and down > 0)").limit(1).count()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b: long) -> (v, component): the least vertex each one reaches.

    Self loops and repeated edges are harmless; vertices without an edge do not
    appear.  Nulls in either column are ignored.  The large-star and small-star
    steps keep, at each vertex, one edge for each neighbour at most.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = e.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    cur = materialize(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    for _ in range(max_rounds):
        if _stars(cur):
            break
        # large star: every neighbour above u points at the least vertex near u
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "cc")
        # small star: what lies below u, and u itself, points at the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        nxt = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u != v")
            .distinct()
        )
        nxt = materialize(nxt, "cc")
        drop_path(large)
        drop_path(cur)
        cur = nxt
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("v").alias("u"), "v").distinct()
    return cur.unionByName(roots).select(F.col("u").alias("v"), F.col("v").alias("component"))
