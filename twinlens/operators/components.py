"""Connected components of an edge table, without bringing it to the driver.

Alternating large-star and small-star rounds (Kiveris et al., SoCC 2014): every round hangs each node's larger, then its
smaller neighbours under the smallest one, so that depth falls about logarithmically and a hot node's work stays a
map-side minimum and a join.  Each round is a written table; the loop ends when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.sources.scratch import drop_path, written


def _signature(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("n", "x") if large else edges.toDF("n", "x")
    least = both.groupBy("n").agg(F.least(F.min("x"), F.first("n")).alias("m"))
    if large:
        out = both.where("x > n").join(least.hint("merge"), "n").select(F.col("x").alias("u"), F.col("m").alias("v"))
    else:
        out = both.join(least.hint("merge"), "n").select(F.col("x").alias("u"), F.col("m").alias("v")).union(least.select("n", "m"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node it reaches.

    ``edges`` has two columns of ids.  Loops, repeated edges and either direction are allowed; nulls are left out.
    """
    a, b = edges.columns[:2]
    current = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    current = written(current)
    seen = _signature(current)
    while seen[0]:
        new = written(_star(_star(current, True), False))
        drop_path(new.sparkSession, current.scratch_path)
        current, before = new, seen
        seen = _signature(current)
        if seen == before:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(current.select("v", "v").distinct())
