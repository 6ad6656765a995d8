"""Decoded images, by the JVM's readers through Spark's ``image`` source.

Formats without a reader there (WebP, HEIC, camera raw) and broken files come out with an error; so do files whose
names start with a dot or an underscore, which Spark's sources don't read.
"""

from __future__ import annotations

import os
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plain_path(column):
    """A file URI as a plain path; ``image.origin`` is percent-encoded and a plus stands for itself."""
    text = F.regexp_replace(column, "^file:/+", "/")
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


#: Files that are named to Spark one by one; beyond, their folders are.
NAMED = 100_000


def _quoted(path: str) -> str:
    """A path whose characters stand for themselves in Spark's file sources."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def load(listing: DataFrame) -> DataFrame:
    """Pixels of the listing's images: path, height, width, channels, data; files that aren't decoded are missing.

    Only the listed files are read, if there are at most ``NAMED``; else the folders that hold them, whose other files are
    decoded in vain.
    """
    spark, paths = listing.sparkSession, listing.select("path").distinct()
    named = [r.path for r in paths.limit(NAMED + 1).collect()]
    if len(named) > NAMED:
        named = [r.folder for r in paths.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).distinct().collect()]
        named = [p or "/" for p in named if os.path.isdir(p or "/")]
    else:
        named = [p for p in named if os.path.exists(p) and not os.path.basename(p).startswith((".", "_"))]
    schema = "path string, height int, width int, channels int, data binary"
    if not named:
        return spark.createDataFrame([], schema)
    loaded = spark.read.format("image").option("dropInvalid", False).load([_quoted(p) for p in named])
    return loaded.where("image.height > 0").select(plain_path(F.col("image.origin")).alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def decode(listing: DataFrame) -> DataFrame:
    """The listing's images with pixels: path, file_size, mtime, height, width, channels, data (null if not decoded)."""
    return listing.dropDuplicates(["path"]).join(load(listing), "path", "left").select("path", "file_size", "mtime", "height", "width", "channels", "data")


def to_rgb(row: dict) -> np.ndarray:
    """Pixels of a decoded row as RGB; alpha is dropped, gray is repeated."""
    if row["data"] is None:
        raise ValueError("no reader for this file, or it is broken")
    image = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["channels"])
    return np.repeat(image, 3, 2) if row["channels"] == 1 else np.ascontiguousarray(image[:, :, 2::-1])
