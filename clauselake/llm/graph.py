"""Connected components by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); a component is named by its smallest node.

    Each round hangs every node's larger neighbours under its smallest one, then its smaller ones, until what is left is a star per
    component. Rounds grow with the logarithm of the longest path. The nodes' minima are a table of their own, so a hub's
    larger neighbours meet its minimum in a plain join of two exchanges, which Spark splits where it is skewed. A round's tables go
    when the next one stands. No edges give no rows.
    """
    e = C.stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = C.stage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m")), "low")
        large = C.stage(e.join(low, "v").select("u", F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = C.stage(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        C.release(e, low, large)
        e = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether every node of distinct edges (u, v), u > v, either hangs under one other or has others under it, not both."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    both = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return both.filter("up + down > 1").isEmpty()
