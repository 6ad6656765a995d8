"""Feature store: Parquet tables with fixed schemas in one folder.

A table is a folder of versions and a pointer, a small file that names the present one.  A table is replaced by writing its
next version and then the pointer in one step; the version before stays for jobs that still read it.  So a job may read
what it replaces, and one that breaks off leaves the table as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinlens import schemas
from twinlens.functions.expressions import area
from twinlens.sources.scratch import children, drop_path, exists, put_text, read_text

#: Images of fewer pixels get no tiles.
TILE_MIN_AREA = 250_000


def needs_tiles() -> F.Column:
    return area(F.col("width"), F.col("height")) >= TILE_MIN_AREA


def cache_status(listing: DataFrame, records: DataFrame, tiled_paths: DataFrame | None = None) -> DataFrame:
    """The listing with ``cached``: an exact match of path, size and time, with a histogram and, if large, its tiles.

    Tiles count as there when the record says they were computed (an image too thin for any tile has none) or when
    ``tiled_paths`` holds the path.
    """
    known = records.select("path", "file_size", "mtime", (F.col("color_hist").isNotNull()).alias("has_hist"), needs_tiles().alias("large"), F.col("tiles_computed") if "tiles_computed" in records.columns else F.lit(None).cast("boolean").alias("tiles_computed"))
    joined = listing.join(known, ["path", "file_size", "mtime"], "left")
    tiled = F.coalesce("tiles_computed", F.lit(False))
    if tiled_paths is not None:
        joined = joined.join(tiled_paths.select("path").distinct().withColumn("tiled", F.lit(True)), "path", "left")
        tiled = tiled | F.coalesce("tiled", F.lit(False))
    cached = F.coalesce(F.col("has_hist") & (~F.col("large") | tiled), F.lit(False))
    return joined.select(*listing.columns, cached.alias("cached"))


def upserted(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key; within ``new`` the last scanned wins."""
    last = Window.partitionBy(key).orderBy(F.desc("scanned_at"), F.desc("mtime"), F.desc("file_size"))
    rows = new.withColumn("__place", F.row_number().over(last)).where("__place = 1").drop("__place")
    return old.join(rows.select(key), key, "left_anti").unionByName(rows)


def replaced(old: DataFrame, new: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    """``old`` without the rows of ``keys``, and ``new``: a re-hashed image loses its old tiles even if it has none now."""
    return old.join(keys.select(key).distinct(), key, "left_anti").unionByName(new)


class ImageStore:
    """The engine's tables in a folder that driver and executors share."""

    TABLES = {"image_records": schemas.IMAGE_RECORDS, "tile_hashes": schemas.TILE_HASHES, "candidate_pairs": schemas.CANDIDATE_PAIRS, "scored_pairs": schemas.SCORED_PAIRS}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _present(self, table: str) -> str | None:
        pointer = f"{self.folder}/{table}/PRESENT"
        return read_text(self.spark, pointer) if exists(self.spark, pointer) else None

    def read(self, table: str) -> DataFrame:
        """A table; empty until it is first written."""
        schema, version = self.TABLES[table], self._present(table)
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}/{version}")

    def write(self, table: str, rows: DataFrame) -> None:
        """Replace a table, by rows that may come from it."""
        fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.TABLES[table].fields]
        before, new = self._present(table), f"version-{uuid.uuid4().hex}"
        rows.select(*fields).write.parquet(f"{self.folder}/{table}/{new}")
        put_text(self.spark, f"{self.folder}/{table}/PRESENT", new)
        for name in children(self.spark, f"{self.folder}/{table}"):
            if name.startswith("version-") and name not in (before, new):
                drop_path(self.spark, f"{self.folder}/{table}/{name}")

    def uncached(self, listing: DataFrame) -> DataFrame:
        return cache_status(listing, self.read("image_records"), self.read("tile_hashes"))

    def put(self, records: DataFrame, tiles: DataFrame) -> None:
        """Records and tiles of newly hashed images."""
        old_tiles = self.read("tile_hashes")
        self.write("tile_hashes", replaced(old_tiles, tiles.select(*old_tiles.columns), records))
        old = self.read("image_records")
        self.write("image_records", upserted(old, records.select(*old.columns)))
