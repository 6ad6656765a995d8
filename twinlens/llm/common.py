"""Pieces that several corpus operators share.

Every operator takes any DataFrame, picks the id and text columns by name and ignores the rest, so extra
columns (whatever they are called) never reach it.  Text columns may be null; a null text counts as empty.
"""

from __future__ import annotations

import ctypes
import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.sources.scratch import drop_path, scratch_dir, shuffles_freed, trim_jvm, written  # noqa: F401

#: What separates words in the licence and benchmark operators: every ASCII byte but digits and letters.
_WORD_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


#: Bytes of text that a worker holds as Python objects at a time, unless a single text has more.
PART_BYTES = 1_000_000
SPACE_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: The words of alnum_words in a text that isn't lower-cased: A-Z belong to words too.
ALNUM_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def alnum_words(data: bytes) -> list[bytes]:
    r"""Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a UTF-8 text after lower-casing A-Z."""
    return data.translate(_WORD_TABLE).split()


def space_words(data: bytes) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+``: ``bytes.split`` cuts at exactly these six bytes."""
    return data.split()


def fold(doc_id="doc_id", folds: int = 5):
    """crc32 of the id's decimal text, modulo ``folds``: the held-out rule of the learning operators."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs, text as UTF-8 bytes and never null."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )


def buckets_for(n_bytes: float, per_bucket: float, least: int = 1) -> int:
    """Buckets so that each holds about ``per_bucket`` bytes: their number grows with the input, their size doesn't."""
    return max(least, math.ceil(n_bytes / per_bucket))


def cut_spans(data: bytes, word: re.Pattern, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of some sorted spans [start, end); a span takes what follows it up to the next word."""
    begins = [m.start() for m in word.finditer(data)] + [len(data)]
    out, at = [], 0
    for start, end in spans:
        out.append(data[at : begins[start]])
        at = begins[end]
    out.append(data[at:])
    return b"".join(out).rstrip() if spans and spans[-1][1] == len(begins) - 1 else b"".join(out)


def with_text(table: pa.Table, text_col: str, texts: list[bytes | None], keep: list[bool]) -> list[pa.RecordBatch]:
    """A table's rows that stay, with new texts."""
    at = table.schema.get_field_index(text_col)
    table = table.set_column(at, table.schema.field(at), pa.array(texts, pa.binary()).cast(table.schema.field(at).type))
    return table.filter(pa.array(keep, pa.bool_())).combine_chunks().to_batches()


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def parts(batch: pa.RecordBatch, column: str = "text", rows: int = 2000, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most so much text (or one row), so that a worker turns little into Python objects at a time."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)) if batch.num_rows else []
    at = 0
    while at < batch.num_rows:
        before = int(sizes[at - 1]) if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(sizes, before + most, "right"))))
        yield batch.slice(at, end - at)
        at = end


def trim() -> None:
    """Hand unused memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trim_driver(spark: SparkSession) -> None:
    """The same for the driver's two processes, after work that took much of their memory for a short time."""
    trim()
    trim_jvm(spark)


def tidy(run):
    """A task's function that hands unused memory back to the system when it is done: reused workers stay small."""
    if run.__code__.co_argcount == 1:

        @functools.wraps(run)
        def outer(batches):
            yield from run(batches)
            trim()

    else:  # of a group, with its key

        @functools.wraps(run)
        def outer(key, batches):
            yield from run(key, batches)
            trim()

    return outer
