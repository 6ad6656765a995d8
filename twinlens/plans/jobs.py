"""The four jobs: scan, find, report, clean.  Each takes and returns plain values; printing is the command line's."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.operators import candidates, features, groups, scoring
from twinlens.plans import report
from twinlens.sources.images import decode, load
from twinlens.sources.listing import scan_directories
from twinlens.sources.scratch import drop_path, written
from twinlens.sources.store import ImageStore


def scan(store: ImageStore, paths: list[str], workers: int = 8) -> dict:
    """Hash new and changed images below the paths; what is stored and unchanged is left alone.

    Returns counts and the first ten errors.  Features are written once before they are split, so nothing is hashed
    twice and an interrupted scan leaves the store as it was.
    """
    began = time.time()
    listing = written(scan_directories(store.spark, paths).dropDuplicates(["path"]))
    status = written(store.uncached(listing))
    counts = status.agg(F.count(F.lit(1)).alias("all"), F.count_if("cached").alias("cached")).first()
    todo = status.where("not cached").drop("cached").repartition(workers)
    out = {"files": counts["all"], "cached": counts["cached"], "hashed": 0, "failed": 0, "errors": []}
    if counts["all"] > counts["cached"]:
        # pixels are hashed where they were decoded; only features are joined to the listing
        found = features.hash_images(load(todo).withColumn("file_size", F.lit(0).cast("long")).withColumn("mtime", F.lit(0.0)))
        joined = todo.join(found.drop("file_size", "mtime"), "path", "left")
        missing = F.lit("ValueError: no reader for this file, or it is broken")
        hashed = written(joined.withColumn("error", F.when(F.col("error").isNotNull() | F.col("phash").isNull(), F.coalesce("error", missing))))
        records, tiles, errors = features.split_features(hashed)
        store.put(records, tiles)
        out |= {"hashed": records.count(), "failed": errors.count(), "errors": [tuple(r) for r in errors.orderBy("path").limit(10).collect()]}
        drop_path(store.spark, hashed.scratch_path)
    for done in (listing, status):
        drop_path(store.spark, done.scratch_path)
    return out | {"seconds": time.time() - began}


def find(store: ImageStore, thresholds: dict[str, int] | None = None, min_score: float = 0.80, crops: bool = True, find_crops: bool = False, crop_ratio: float = 4.0, crops_per_image: int = 20, crop_inliers: int = scoring.CANDIDATE_INLIERS) -> dict | None:
    """Find and score pairs; None for an empty store.  Stored results are replaced, also by none."""
    began = time.time()
    records, tiles = store.read("image_records"), store.read("tile_hashes")
    if records.isEmpty():
        return None
    pairs = written(candidates.query_candidates(records, tiles, thresholds))
    copies = None
    if find_crops:
        copies = written(scoring.shrunk(decode(records.select("path", "file_size", "mtime"))))
        mismatched = candidates.size_mismatch_candidates(records, pairs, crop_ratio, crops_per_image)
        pairs = written(pairs.unionByName(scoring.verified_mismatches(mismatched, copies, least_inliers=crop_inliers)))
    store.write("candidate_pairs", pairs)
    n = pairs.count()
    if not n:
        store.write("scored_pairs", store.spark.createDataFrame([], store.TABLES["scored_pairs"]))
        return {"candidates": 0, "scored": 0, "failed": 0, "duplicates": 0, "refined": 0, "seconds": time.time() - began}
    if copies is None:
        used = pairs.select(F.explode(F.array("path_a", "path_b")).alias("path")).distinct()
        copies = written(scoring.shrunk(decode(records.join(used, "path", "left_semi").select("path", "file_size", "mtime"))))
    scored, errors = scoring.score_pairs(pairs, records, copies)
    failed = errors.count()
    scored = written(scored)
    if crops:
        scored = written(scoring.refine_crops(scored, records, copies))
    store.write("scored_pairs", scored)
    stats = scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("final_score") >= min_score).alias("alike"), F.count_if(F.col("crop_bbox").isNotNull()).alias("boxes")).first()
    for done in (pairs, copies, scored):
        drop_path(store.spark, done.scratch_path)
    return {"candidates": n, "scored": stats["n"], "failed": failed, "duplicates": stats["alike"], "refined": stats["boxes"], "seconds": time.time() - began}


def show(store: ImageStore, min_score: float = 0.80, keep: str = "largest", json_path: str | None = None):
    """Lines of the text report, or None without scored pairs; also writes the JSON report if asked."""
    pairs, records = store.read("scored_pairs"), store.read("image_records")
    if pairs.isEmpty():
        return None
    if json_path:
        report.export_json(pairs, records, json_path, min_score, keep)
    return report.text_lines(pairs, records, min_score, keep)


def clean(store: ImageStore, min_score: float = 0.90, keep: str = "largest", remove: Callable[[str], None] | None = None) -> dict:
    """What a clean-up moves away; ``remove`` is called for each file, and only if given.  The store isn't changed."""
    plan = written(groups.clean_plan(store.read("scored_pairs"), store.read("image_records"), min_score, keep))
    total = plan.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("size")).first()
    removed, failed = 0, 0
    if remove:
        for row in plan.select("path").orderBy("path").toLocalIterator():
            try:
                remove(row.path)
                removed += 1
            except OSError:
                failed += 1
    return {"files": total["n"], "bytes": total["size"], "removed": removed, "failed": failed, "plan": plan}


def move_to_trash(path: str) -> None:
    """Into the desktop's trash folder of the user, with the note that lets it be put back."""
    from urllib.parse import quote

    home = os.environ.get("XDG_DATA_HOME") or os.path.expanduser("~/.local/share")
    files, notes = os.path.join(home, "Trash/files"), os.path.join(home, "Trash/info")
    os.makedirs(files, exist_ok=True)
    os.makedirs(notes, exist_ok=True)
    name, k = os.path.basename(path), 0
    while os.path.exists(os.path.join(files, name if not k else f"{k}-{name}")):
        k += 1
    name = name if not k else f"{k}-{name}"
    with open(os.path.join(notes, f"{name}.trashinfo"), "x", encoding="utf-8") as f:
        f.write(f"[Trash Info]\nPath={quote(os.path.abspath(path))}\nDeletionDate={time.strftime('%Y-%m-%dT%H:%M:%S')}\n")
    import shutil

    shutil.move(path, os.path.join(files, name))


def open_store(spark: SparkSession, folder: str) -> ImageStore:
    return ImageStore(spark, folder if ":" in folder else "file://" + os.path.abspath(folder))
