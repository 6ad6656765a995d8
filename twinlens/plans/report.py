"""Reports of duplicate groups: summary, text and JSON."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.functions import expressions as X
from twinlens.operators import groups as G


def summary(records: DataFrame, plan: DataFrame) -> DataFrame:
    """One row: images, groups, duplicates, reclaimable bytes."""
    told = plan.agg(F.countDistinct("component").alias("groups"), F.count(F.lit(1)).alias("duplicates"), F.coalesce(F.sum("file_size"), F.lit(0)).cast("bigint").alias("reclaimable"))
    return records.agg(F.count(F.lit(1)).alias("images")).join(told, F.lit(True))


def member_rows(pairs: DataFrame, records: DataFrame, min_score: float = 0.80, strategy: str = "largest") -> DataFrame:
    """A row per file of a group: its part (original or duplicate), size, and for duplicates score, hints and box."""
    members = G.group_members(pairs, records, min_score, strategy)
    told = G.member_attribution(pairs, members, min_score).drop("component", "canonical")
    known = records.select("path", "width", "height", "file_size", "mtime", *(c for c in ("is_raw",) if c in records.columns))
    rows = members.join(told.hint("merge"), "path", "left").join(known.hint("merge"), "path", "left")
    return rows.withColumn("is_original", F.col("path") == F.col("canonical"))


def _file(name: str = "") -> F.Column:
    return F.struct("path", "file_size", "width", "height", "mtime")


def groups_json(pairs: DataFrame, records: DataFrame, min_score: float = 0.80, strategy: str = "largest") -> DataFrame:
    """A JSON text per group: canonical, scores, duplicates.  (component, size, max_score, group)"""
    rows = member_rows(pairs, records, min_score, strategy)
    box = F.col("crop_bbox") if "crop_bbox" in rows.columns else F.lit(None).cast("struct<x: int, y: int, w: int, h: int>")
    entry = F.struct("path", "file_size", "width", "height", "mtime", F.coalesce(F.round("final_score", 4), F.lit(0.0)).alias("score"), F.coalesce("modification_hints", F.array().cast("array<string>")).alias("modification_hints"), box.alias("crop_bbox"))
    nested = rows.groupBy("component").agg(
        F.max(F.when(F.col("is_original"), _file())).alias("canonical"),
        F.array_sort(F.collect_list(F.when(~F.col("is_original"), entry))).alias("duplicates"),
        F.count(F.lit(1)).alias("size"),
        F.round(F.max("final_score"), 4).alias("max_score"),
    )
    body = F.to_json(F.struct("canonical", F.col("size"), "max_score", "duplicates"), {"ignoreNullFields": "false"})
    return nested.select("component", "size", "max_score", body.alias("group"))


def export_json(pairs: DataFrame, records: DataFrame, path: str, min_score: float = 0.80, strategy: str = "largest") -> None:
    """Write the report as one JSON document; groups stream through the driver one partition at a time."""
    groups = groups_json(pairs, records, min_score, strategy).orderBy(F.desc("size"), F.desc("max_score"), "component")
    total = groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("duplicates")).first()
    with open(path, "w", encoding="utf-8") as out:
        out.write('{"generated_at": "%s", "total_groups": %d, "total_duplicates": %d, "groups": [' % (datetime.now(timezone.utc).isoformat(), total["groups"], total["duplicates"]))
        for k, row in enumerate(groups.toLocalIterator()):
            out.write((",\n" if k else "\n") + row["group"])
        out.write("\n]}\n")


def text_lines(pairs: DataFrame, records: DataFrame, min_score: float = 0.80, strategy: str = "largest", show_hints: bool = True):
    """Lines of the text report, group by group; the largest groups first."""
    rows = member_rows(pairs, records, min_score, strategy)
    order = G.duplicate_groups(pairs, records, min_score, strategy).select("component", F.col("size").alias("group_size"), "max_score")
    shown = rows.join(order.hint("merge"), "component").select(
        "component", "is_original", "path", "group_size", "max_score", "modification_hints" if "modification_hints" in rows.columns else F.array().cast("array<string>").alias("modification_hints"),
        F.col("crop_bbox") if "crop_bbox" in rows.columns else F.lit(None).cast("struct<x: int, y: int, w: int, h: int>").alias("crop_bbox"),
        "final_score", X.score_band(F.col("final_score")).alias("band"), X.format_bytes(F.col("file_size")).alias("bytes"), X.format_dimensions(F.col("width"), F.col("height")).alias("dimensions"), F.coalesce("file_size", F.lit(0)).alias("file_size"),
    ).orderBy(F.desc("group_size"), F.desc("max_score"), "component", F.desc("is_original"), "path")
    groups = duplicates = size = 0
    for row in shown.toLocalIterator():
        if row.is_original:
            groups += 1
            yield f"Group {groups} ({row.group_size} files)"
            yield f"  original   {row.path}  {row.dimensions or '?'}  {row.bytes or '?'}"
        else:
            duplicates += 1
            size += row.file_size
            hints = f"  [{', '.join(row.modification_hints or [])}]" if show_hints and row.modification_hints else ""
            box = f"  at {row.crop_bbox.x},{row.crop_bbox.y} {row.crop_bbox.w}x{row.crop_bbox.h}" if row.crop_bbox else ""
            yield f"  duplicate  {row.path}  {row.dimensions or '?'}  {row.bytes or '?'}  {row.final_score:.2f} {row.band}{hints}{box}"
    yield f"{groups} groups, {duplicates} duplicates, {plain_bytes(size)} reclaimable" if groups else "No duplicates found."


def plain_bytes(n: int) -> str:
    """The text of functions.expressions.format_bytes for one number."""
    power = min(4, max(0, (max(n, 1).bit_length() - 1) // 10))
    return f"{n >> (10 * power)}.0 {('B', 'KB', 'MB', 'GB', 'TB')[power]}"
