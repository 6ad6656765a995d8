"""Scoring of candidate pairs and refinement of those where one image may lie in the other.

Each distinct image is decoded and shrunk once; pairs then meet the small copies.  Metrics come from NumPy kernels, their
combination is SQL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.functions import expressions as X
from twinlens.kernels import crops, pixels
from twinlens.operators.candidates import with_records

COMPARE_SIDE, CROP_SIDE = 512, 1024
#: Inliers that a crop candidate and a refinement need.
CANDIDATE_INLIERS, REFINE_INLIERS = 12, 15


def shrunk(decoded: DataFrame) -> DataFrame:
    """Copies of decoded images: square (512 x 512) for comparison, and at most 1024 long for crops."""
    from twinlens.sources.images import to_rgb

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8):
                out = []
                for r in batch.slice(at, 8).to_pylist():
                    try:
                        rgb = to_rgb(r)
                        h, w = rgb.shape[:2]
                        s = min(CROP_SIDE / max(w, h), 1.0)
                        view = rgb if s == 1.0 else pixels.resize(rgb, max(1, int(w * s)), max(1, int(h * s)))
                        out.append((r["path"], pixels.resize(rgb, COMPARE_SIDE, COMPARE_SIDE).tobytes(), view.tobytes(), view.shape[1], view.shape[0], None))
                    except Exception as e:  # noqa: BLE001
                        out.append((r["path"], None, None, None, None, f"{type(e).__name__}: {e}"))
                kinds = (pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["path", "square", "view", "view_w", "view_h", "load_error"])

    return decoded.mapInArrow(run, "path string, square binary, view binary, view_w int, view_h int, load_error string")


def compare(a: np.ndarray, b: np.ndarray) -> dict:
    """Metrics of two RGB images in 0..1."""
    return {"ssim": pixels.ssim(a, b), "hist_corr": pixels.histogram_correlation(a, b), "lum_corr": pixels.luminance_correlation(a, b), "mse": pixels.normalized_mse(a, b), "gray_a": pixels.is_grayscale(a), "gray_b": pixels.is_grayscale(b)}


_METRICS = (("ssim", pa.float64()), ("hist_corr", pa.float64()), ("lum_corr", pa.float64()), ("mse", pa.float64()), ("gray_a", pa.bool_()), ("gray_b", pa.bool_()), ("error", pa.string()))


def _added(batch: pa.RecordBatch, drop: list[str], rows: list[dict], kinds) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c not in drop]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array([r.get(n) for r in rows], k) for n, k in kinds)], [*kept, *(n for n, _ in kinds)])


def _measure(batches):
    def load(data):
        return np.frombuffer(data, np.uint8).reshape(COMPARE_SIDE, COMPARE_SIDE, 3).astype(np.float32) / 255

    for whole in batches:
        for at in range(0, whole.num_rows, 8):
            batch, rows = whole.slice(at, 8), []
            for r in batch.select(["square_a", "square_b", "load_error_a", "load_error_b"]).to_pylist():
                try:
                    if r["square_a"] is None or r["square_b"] is None:
                        raise ValueError(r["load_error_a"] or r["load_error_b"] or "not decoded")
                    rows.append(compare(load(r["square_a"]), load(r["square_b"])))
                except Exception as e:  # noqa: BLE001
                    rows.append({"error": f"{type(e).__name__}: {e}"})
            yield _added(batch, ["square_a", "square_b", "load_error_a", "load_error_b"], rows, _METRICS)


def score_pairs(candidates: DataFrame, records: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scored, errors).  Pairs without a record go; an image that can't be compared makes its pairs errors."""
    pairs = with_records(candidates, records, ["width", "height", "file_size", "mtime"])
    for side in "ab":
        pairs = pairs.join(copies.select(*(F.col(c).alias(f"{c}_{side}") for c in ("path", "square", "load_error"))), f"path_{side}", "left")
    kept = [f for f in pairs.schema.fields if f.name not in ("square_a", "square_b", "load_error_a", "load_error_b")]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + ["ssim double, hist_corr double, lum_corr double, mse double, gray_a boolean, gray_b boolean, error string"])
    measured = pairs.mapInArrow(_measure, schema)
    a, b = (X.area(F.col(f"width_{s}"), F.col(f"height_{s}")) for s in "ab")
    one_gray = F.col("gray_a") != F.col("gray_b")
    score = X.base_score(F.col("ssim"), F.col("hist_corr"), F.col("lum_corr"), F.col("mse"), F.col("hash_agreement"), one_gray)
    hints = X.modification_hints(F.col("gray_a"), F.col("gray_b"), a, b, F.col("path_a"), F.col("path_b"))
    box = "struct<x: int, y: int, w: int, h: int>"
    scored = measured.where("error is null").select(
        "path_a", "path_b", "ssim", F.when(one_gray, F.col("lum_corr")).otherwise(F.col("hist_corr")).alias("histogram_corr"), F.col("mse").alias("normalized_mse"),
        F.lit(None).cast("double").alias("crop_score"), F.lit(None).cast(box).alias("crop_bbox"), score.alias("final_score"), hints.alias("modification_hints"),
        "via_tile", "via_orb", a.alias("area_a"), b.alias("area_b"),
    )
    return scored, measured.where("error is not null").select("path_a", "path_b", "error")


def compare_region(large: np.ndarray, small: np.ndarray, box: crops.Box) -> tuple[float, float, float]:
    """Metrics of a region of the large image, shrunk to the small one's size; (0, 0, 1) for a region below 8 pixels."""
    x, y, w, h = box
    x0, y0, x1, y1 = max(0, x), max(0, y), min(large.shape[1], x + w), min(large.shape[0], y + h)
    if x1 - x0 < 8 or y1 - y0 < 8:
        return 0.0, 0.0, 1.0
    part = pixels.shrink_area(large[y0:y1, x0:x1], small.shape[1], small.shape[0]) / 255.0
    other = small / 255.0
    return pixels.ssim(part, other), pixels.histogram_correlation(part, other), pixels.normalized_mse(part, other)


def locate(large: np.ndarray, small: np.ndarray) -> tuple[float, crops.Box | None]:
    """Keypoints first; the template search replaces them where it does better, box or not."""
    score, box = crops.detect_keypoints(large, small, least=REFINE_INLIERS)
    if box is None or score < 0.5:
        other, other_box = crops.detect_template(large, small)
        if other > score:
            score, box = other, other_box
    return score, box


_CROP = (("found_score", pa.float64()), ("bx", pa.int32()), ("by", pa.int32()), ("bw", pa.int32()), ("bh", pa.int32()), ("c_ssim", pa.float64()), ("c_hist", pa.float64()), ("c_mse", pa.float64()), ("crop_error", pa.string()))
_PIXELS = [f"{c}_{s}" for c in ("view", "view_w", "view_h", "width", "height") for s in "ab"]


def _refine(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, 4):
            batch, rows = whole.slice(at, 4), []
            for r in batch.select([*_PIXELS, "area_a", "area_b"]).to_pylist():
                try:
                    image = {s: np.frombuffer(r[f"view_{s}"], np.uint8).reshape(r[f"view_h_{s}"], r[f"view_w_{s}"], 3) for s in "ab"}
                    big, little = ("a", "b") if r["area_a"] >= r["area_b"] else ("b", "a")
                    score, box = locate(image[big], image[little])
                    row: dict = {"found_score": score}
                    if box is not None:
                        full = crops.scale_box(box, image[big].shape[:2], (r[f"height_{big}"], r[f"width_{big}"]))
                        row |= dict(zip(("bx", "by", "bw", "bh"), full, strict=True))
                        row |= dict(zip(("c_ssim", "c_hist", "c_mse"), compare_region(image[big], image[little], box), strict=True))
                    rows.append(row)
                except Exception as e:  # noqa: BLE001
                    rows.append({"crop_error": f"{type(e).__name__}: {e}"})
            yield _added(batch, _PIXELS, rows, _CROP)


def refine_crops(scored: DataFrame, records: DataFrame, copies: DataFrame) -> DataFrame:
    """Scored pairs with crop score, box and a score that a located crop can only raise.

    Only pairs that call for it are looked at; a pair that has a box already, or fails, stays as it is.
    """
    key = ["path_a", "path_b"]
    wanted = X.wants_crop_check(F.col("area_a"), F.col("area_b"), F.col("final_score"), F.col("via_tile"), F.col("via_orb"))
    todo = with_records(scored.where(wanted & F.col("crop_bbox").isNull()).select(*key, "area_a", "area_b"), records, ["width", "height"])
    for side in "ab":
        todo = todo.join(copies.select(*(F.col(c).alias(f"{c}_{side}") for c in ("path", "view", "view_w", "view_h"))), f"path_{side}")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in todo.schema.fields if f.name not in _PIXELS)
    found = todo.mapInArrow(_refine, f"{kept}, found_score double, bx int, by int, bw int, bh int, c_ssim double, c_hist double, c_mse double, crop_error string").drop("area_a", "area_b")
    both = scored.join(found, key, "left")
    located = F.col("bx").isNotNull()
    alignment = X.crop_alignment(F.col("c_ssim"), F.col("c_hist"), F.col("c_mse"))
    box = F.struct(*(F.col(f"b{n}").alias(n) for n in "xywh"))
    hints = F.when(located & ~F.array_contains("modification_hints", "crop"), F.array_append("modification_hints", F.lit("crop"))).otherwise(F.col("modification_hints"))
    return both.select(
        *(c for c in scored.columns if c not in ("crop_score", "crop_bbox", "final_score", "modification_hints")),
        F.when(F.col("found_score") > 0, F.col("found_score")).otherwise(F.col("crop_score")).alias("crop_score"),
        F.when(located, box).otherwise(F.col("crop_bbox")).alias("crop_bbox"),
        F.when(located, X.refined_score(alignment, F.col("found_score"), F.col("final_score"))).otherwise(F.col("final_score")).alias("final_score"),
        hints.alias("modification_hints"),
    )


def verified_mismatches(pairs: DataFrame, copies: DataFrame, least_confidence: float = 0.5, least_inliers: int = CANDIDATE_INLIERS) -> DataFrame:
    """Size-mismatch pairs whose small image is found in the large one by keypoints, as candidates."""
    joined = pairs
    for side in ("small", "large"):
        joined = joined.join(copies.select(*(F.col(c).alias(f"{side}_{c}") for c in ("path", "view", "view_w", "view_h"))), f"{side}_path")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4):
                batch, rows = whole.slice(at, 4), []
                for r in batch.to_pylist():
                    try:
                        large, small = (np.frombuffer(r[f"{s}_view"], np.uint8).reshape(r[f"{s}_view_h"], r[f"{s}_view_w"], 3) for s in ("large", "small"))
                        score, box = crops.detect_keypoints(large, small, least=least_inliers)
                    except Exception:  # noqa: BLE001  an image that can't be searched is no candidate
                        score, box = 0.0, None
                    rows.append(score >= least_confidence and box is not None)
                yield batch.select(["path_a", "path_b"]).filter(pa.array(rows, pa.bool_()))

    found = joined.mapInArrow(run, "path_a string, path_b string")
    return found.select("path_a", "path_b", F.lit(64).alias("min_hash_dist"), F.lit(0.0).alias("hash_agreement"), F.lit(False).alias("via_tile"), F.lit(True).alias("via_orb"))
