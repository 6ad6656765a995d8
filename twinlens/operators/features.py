"""Features of decoded images: hashes, colour histogram, tiles.  Pixels never leave the kernel as rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.functions.expressions import area, is_raw
from twinlens.kernels import crops, pixels
from twinlens.sources.store import TILE_MIN_AREA

_HASHES = pa.struct([("phash", pa.int64()), ("dhash", pa.int64()), ("whash", pa.int64())])


def tile_regions(images: DataFrame) -> DataFrame:
    """Tiles of images of at least ``TILE_MIN_AREA`` pixels, as the scan cuts them: path, tile_idx, tx, ty, tw, th."""

    def run(batches):
        for batch in batches:
            found = [pixels.tiles(w, h) for w, h in zip(batch.column("width").to_pylist(), batch.column("height").to_pylist(), strict=True)]
            paths = pa.array(np.repeat(np.arange(len(found)), [len(t) for t in found]))
            rows = np.concatenate([np.zeros((0, 5), np.int64), *found])
            yield pa.RecordBatch.from_arrays([batch.column("path").take(paths), *(pa.array(rows[:, k], pa.int32()) for k in range(5))], ["path", "tile_idx", "tx", "ty", "tw", "th"])

    large = images.where(area(F.col("width"), F.col("height")) >= TILE_MIN_AREA)
    return large.select("path", "width", "height").mapInArrow(run, "path string, tile_idx int, tx int, ty int, tw int, th int")


def kernel_values(images: DataFrame, kernel, shape: tuple[int, ...], kind: str = "float64") -> DataFrame:
    """What a kernel gives for one image, or for two: path, value.  Images are arrays of numbers in columns ``a`` and ``b``."""
    sql = {"float64": "double", "int64": "long", "bool": "boolean"}.get(kind, kind)
    arrow = pa.list_(pa.float64()) if kind == "array<double>" else getattr(pa, {"float64": "float64", "int64": "int64", "bool": "bool_"}[kind])()
    names = [c for c in ("a", "b") if c in images.columns]

    def run(batches):
        for batch in batches:
            columns = [[np.array(x).reshape(shape) for x in batch.column(c).to_pylist()] for c in names]
            found = [kernel(*x) for x in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([x.tolist() if isinstance(x, np.ndarray) else x for x in found], arrow)], ["path", "value"])

    return images.select("path", *names).mapInArrow(run, f"path string, value {sql}")


def locate_in_gray_arrays(images: DataFrame, side: int) -> DataFrame:
    """Finds each image, doubled in size, in a larger one that holds it: path, confidence, x, y."""

    def run(batches):
        for batch in batches:
            found = []
            for p in batch.column("pixels").to_pylist():
                small = np.kron(np.array(p, np.uint8).reshape(side, side), np.ones((2, 2), np.uint8))
                large = np.full((6 * side, 6 * side), 128, np.uint8)
                large[3 : 3 + 2 * side, 5 : 5 + 2 * side] = small
                found.append(crops.detect_template(large, small, (1.0,)))
            box = [b or (-1, -1, 0, 0) for _, b in found]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([round(c, 6) for c, _ in found]), pa.array([b[0] for b in box], pa.int64()), pa.array([b[1] for b in box], pa.int64())], ["path", "confidence", "x", "y"])

    return images.select("path", "pixels").mapInArrow(run, "path string, confidence double, x long, y long")


_FEATURES = "path string, file_size long, mtime double, width int, height int, phash long, dhash long, whash long, color_hist array<float>, tiles array<struct<tile_idx: int, tx: int, ty: int, tw: int, th: int, phash: long, dhash: long, whash: long>>, error string"
_TILE = pa.struct([(n, pa.int32()) for n in ("tile_idx", "tx", "ty", "tw", "th")] + [(n, pa.int64()) for n in ("phash", "dhash", "whash")])


def image_features(rgb: np.ndarray) -> dict:
    """Everything that is kept of one image."""
    height, width = rgb.shape[:2]
    found = []
    if width * height >= TILE_MIN_AREA:
        for number, x, y, w, h in pixels.tiles(width, height).tolist():
            found.append((number, x, y, w, h, *pixels.hashes(rgb[y : y + h, x : x + w])))
    names = ("tile_idx", "tx", "ty", "tw", "th", "phash", "dhash", "whash")
    return dict(zip(("phash", "dhash", "whash"), pixels.hashes(rgb), strict=True)) | {"width": width, "height": height, "color_hist": pixels.color_histogram(rgb), "tiles": [dict(zip(names, t, strict=True)) for t in found]}


def hash_images(decoded: DataFrame) -> DataFrame:
    """Features of decoded images (see sources.images), a row each; what can't be hashed has an ``error`` instead."""
    from twinlens.sources.images import to_rgb

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                rows = []
                for r in batch.slice(at, 16).to_pylist():
                    row = {"path": r["path"], "file_size": r["file_size"], "mtime": r["mtime"], "error": None}
                    try:
                        row |= image_features(to_rgb(r))
                    except Exception as e:  # noqa: BLE001  an image's failure is its row's value
                        row["error"] = f"{type(e).__name__}: {e}"
                    rows.append(row)
                get = lambda name: [x.get(name) for x in rows]
                columns = [pa.array(get("path"), pa.string()), pa.array(get("file_size"), pa.int64()), pa.array(get("mtime"), pa.float64()), pa.array(get("width"), pa.int32()), pa.array(get("height"), pa.int32())]
                columns += [pa.array(get(n), pa.int64()) for n in ("phash", "dhash", "whash")]
                columns += [pa.array([None if h is None else h.tolist() for h in get("color_hist")], pa.list_(pa.float32())), pa.array(get("tiles"), pa.list_(_TILE)), pa.array(get("error"), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ("path", "file_size", "mtime", "width", "height", "phash", "dhash", "whash", "color_hist", "tiles", "error")])

    return decoded.mapInArrow(run, _FEATURES)


def split_features(features: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, tiles, errors) of hashed images."""
    good = features.where("error is null")
    records = good.select("path", "file_size", "mtime", "phash", "dhash", "whash", "width", "height", is_raw(F.col("path")).alias("is_raw"), F.unix_micros(F.current_timestamp()).cast("double").alias("scanned_at"), "color_hist", F.lit(True).alias("tiles_computed"))
    return records, good.select("path", F.inline("tiles")), features.where("error is not null").select("path", "error")
