"""Incremental scans: new listing rows as a stream, hashed and stored batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.operators.features import hash_images, split_features
from twinlens.sources.scratch import drop_path, written
from twinlens.sources.store import ImageStore


def hash_stream(decoded: DataFrame, store: ImageStore, checkpoint: str):
    """Hash a stream of decoded images (the columns of sources.images.decode) into the store; returns the query.

    A batch that runs again replaces its own rows, so each image is stored once.
    """

    def put(batch: DataFrame, _: int) -> None:
        hashed = written(hash_images(batch))
        records, tiles, _errors = split_features(hashed)
        store.put(records, tiles)
        drop_path(batch.sparkSession, hashed.scratch_path)

    return decoded.where(F.col("path").isNotNull()).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
