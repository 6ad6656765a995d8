"""File listing."""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from twinlens import schemas
from twinlens.functions.expressions import SUPPORTED_EXTENSIONS


def walk(root: str, extensions: Iterable[str] = SUPPORTED_EXTENSIONS) -> Iterator[tuple[str, int, float]]:
    """(absolute path, size, time) of the files below a root, or of the root itself if it is a file.

    Names are taken in order, hidden ones too; links to folders aren't followed; what can't be asked is left out.
    """
    wanted, root = {x.lower() for x in extensions}, os.path.abspath(root)
    fits = lambda name: os.path.splitext(name)[1].lower() in wanted
    if os.path.isfile(root):
        names = [root] if fits(root) else []
    else:
        names = (os.path.join(d, n) for d, n in _names(root) if fits(n))
    for path in names:
        try:
            found = os.stat(path)
        except OSError:
            continue
        yield path, found.st_size, found.st_mtime


def _names(root: str) -> Iterator[tuple[str, str]]:
    for folder, inner, names in os.walk(root):
        inner.sort()
        for name in sorted(names):
            yield folder, name


def scan_directories(spark: SparkSession, paths: Iterable[str], extensions: Iterable[str] = SUPPORTED_EXTENSIONS) -> DataFrame:
    """Listing of all roots, a task per root; a file below two roots occurs twice."""
    wanted, roots = tuple(extensions), [os.path.abspath(p) for p in paths]

    def listed(batches):
        for batch in batches:
            for root in batch.column("root").to_pylist():
                found = walk(root, wanted)
                while some := list(itertools.islice(found, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.string()), pa.array([r[1] for r in some], pa.int64()), pa.array([r[2] for r in some], pa.float64())], ["path", "file_size", "mtime"])

    if not roots:
        return spark.createDataFrame([], schemas.FILE_LISTING)
    frame = spark.createDataFrame([(r,) for r in roots], "root string").repartition(len(roots))
    return frame.mapInArrow(listed, schemas.FILE_LISTING)
