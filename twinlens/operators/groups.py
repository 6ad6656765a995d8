"""Duplicate groups: components of scored pairs, the file to keep, and what to say about each other file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.functions.expressions import area
from twinlens.operators.components import components

STRATEGIES = ("largest", "oldest", "newest", "highest_res")


def duplicate_components(pairs: DataFrame, min_score: float = 0.80) -> DataFrame:
    """(path, component) of every image in a pair that scores at least ``min_score``; component is the smallest path."""
    return components(pairs.where(F.col("final_score") >= min_score).select("path_a", "path_b")).toDF("path", "component")


def keep_keys(strategy: str) -> list[Column]:
    """What is compared, most important first, greater wins.  An image without a record has zeros throughout, so under
    ``oldest`` it wins against any record."""
    pixels, size, mtime = area(F.col("width"), F.col("height")).cast("double"), F.col("file_size").cast("double"), F.col("mtime")
    order = {"oldest": [-mtime, pixels, size], "newest": [mtime, pixels, size]}.get(strategy, [pixels, size, -mtime])
    return [F.coalesce(k, F.lit(0.0)) for k in order]


def canonical(members: DataFrame, records: DataFrame, strategy: str = "largest") -> DataFrame:
    """(component, canonical): the image of each component to keep; ties by path."""
    known = members.join(records.select("path", "width", "height", "file_size", "mtime").hint("merge"), "path", "left")
    order = Window.partitionBy("component").orderBy(*(k.desc() for k in keep_keys(strategy)), F.col("path"))
    return known.withColumn("place", F.row_number().over(order)).where("place = 1").select("component", F.col("path").alias("canonical"))


def group_members(pairs: DataFrame, records: DataFrame, min_score: float = 0.80, strategy: str = "largest") -> DataFrame:
    """(component, path, canonical) for every image in a group."""
    members = duplicate_components(pairs, min_score)
    return members.join(canonical(members, records, strategy).hint("merge"), "component")


def duplicate_groups(pairs: DataFrame, records: DataFrame, min_score: float = 0.80, strategy: str = "largest") -> DataFrame:
    """A row per group: component, canonical, size, greatest and least score; large groups and high scores first."""
    kept = pairs.where(F.col("final_score") >= min_score)
    members = group_members(pairs, records, min_score, strategy)
    size = members.groupBy("component", "canonical").agg(F.count(F.lit(1)).alias("size"))
    scores = kept.join(members.select(F.col("path").alias("path_a"), "component").hint("merge"), "path_a").groupBy("component").agg(F.max("final_score").alias("max_score"), F.min("final_score").alias("min_score"))
    return size.join(scores.hint("merge"), "component").orderBy(F.desc("size"), F.desc("max_score"), "component")


def member_attribution(pairs: DataFrame, members: DataFrame, min_score: float = 0.80) -> DataFrame:
    """The pair whose score each duplicate shows.

    Its pair with the kept file if there is one; else its best pair, those that touch a file with such a direct pair
    before the others, then by score, ties by paths.
    """
    kept = pairs.where(F.col("final_score") >= min_score)
    ends = kept.withColumn("path", F.explode(F.array("path_a", "path_b"))).join(members.hint("merge"), "path").withColumn("other", F.when(F.col("path") == F.col("path_a"), F.col("path_b")).otherwise(F.col("path_a")))
    direct = ends.where(F.col("other") == F.col("canonical")).select(F.col("path").alias("other")).distinct().withColumn("other_direct", F.lit(True))
    ends = ends.where(F.col("path") != F.col("canonical")).join(direct.hint("merge"), "other", "left")
    is_direct = F.col("other") == F.col("canonical")
    order = Window.partitionBy("path").orderBy(is_direct.desc(), F.coalesce("other_direct", F.lit(False)).desc(), F.desc("final_score"), "path_a", "path_b")
    best = ends.withColumn("place", F.row_number().over(order)).where("place = 1")
    return best.select("component", "path", "canonical", "path_a", "path_b", "final_score", is_direct.alias("direct"), *(c for c in ("modification_hints", "crop_bbox", "crop_score") if c in pairs.columns))


def clean_plan(pairs: DataFrame, records: DataFrame, min_score: float = 0.90, strategy: str = "largest") -> DataFrame:
    """Files that a clean-up would move to the trash: path, kept file, bytes, whether a pair links the two directly."""
    members = group_members(pairs, records, min_score, strategy)
    told = member_attribution(pairs, members, min_score)
    return told.join(records.select("path", "file_size").hint("merge"), "path", "left").select("component", "path", "canonical", F.coalesce("file_size", F.lit(0)).alias("file_size"), "direct", "final_score")
