"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A word is removed when a window that covers it starts earlier too, in a smaller doc_id or earlier in the same document;
windows are judged on the input.  Overlapping windows merge into maximal removal intervals.

How the rows move:

1. A task hashes its documents' windows (polynomials of words' bytes, then of words' hashes), and keeps the first occurrence of each hash within the task.  Later ones are repeats whatever else the corpus holds:
   they become intervals at once, so a passage in a third of all documents sends one entry per task.
2. First occurrences go to buckets by hash, as sorted, compressed arrays of (hash, check, doc_id, start); the number of buckets
   follows the input's size.  A bucket counts its hashes and returns every occurrence but the first.
3. Repeats go on packed, by parts of the documents, are merged there per document and joined to the texts by doc_id.

A window is known by 92 bits, polynomials modulo two primes at random points: over n windows unequal ones agree with a
chance of about n * n / 2 ** 93, whatever the texts hold.

Defined cases: null and empty texts have no words; rows that share a doc_id count as one document, so the same window at
the same place of them repeats nothing; a row without a doc_id neither loses words nor causes a removal; extra columns
are ignored; texts of any length are handled whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.common import SPACE_WORD, buckets_for, cut_spans, id_and_text, parts, space_words, text_bytes, with_text, written
from twinlens.llm.hashing import mix, window_hashes

#: Words after which a task closes a block; bytes of text that make a bucket's share.
BLOCK_WORDS = 1_000_000
BUCKET_BYTES = 16_000_000


def _pack(*columns: np.ndarray) -> bytes:
    """Columns byte plane by byte plane, compressed: high bytes of sorted or narrow columns nearly vanish."""
    import zstandard

    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(data: bytes, n: int | list[int], kinds) -> list[np.ndarray]:
    """Columns of n values each, or of a number of values of their own."""
    import zstandard

    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), 0, []
    for kind, rows in zip(map(np.dtype, kinds), [n] * len(kinds) if isinstance(n, int) else n, strict=True):
        size = rows * kind.itemsize
        out.append(np.ascontiguousarray(raw[at : at + size].reshape(kind.itemsize, rows).T).view(kind).ravel())
        at += size
    return out


_KINDS = (np.uint64, np.uint32, np.int64, np.int32)
_ROWS = ["bucket", "part", "n", "data"]
_SCHEMA = "bucket int, part int, n long, data binary"


def _row(bucket: int, part: int | None, n: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], _ROWS)


def _marks(doc: np.ndarray, start: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows as packed (doc_id, start), a row per part of the documents."""
    part = (mix(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((start, doc, part))
    doc, start, part = doc[order], start[order], part[order]
    edges = np.searchsorted(part, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)).tolist():
        some = slice(edges[p], edges[p + 1])
        yield _row(p, p, edges[p + 1] - edges[p], _pack(doc[some], start[some].astype(np.int32)))


def _hash_blocks(width: int, buckets: int):
    def run(batches):
        texts, ids, words = [], [], 0

        def flush():
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            hashes, check, text, start = window_hashes([texts[k] for k in order], width)
            doc = np.array(ids, np.int64)[order][text]
            by = np.argsort(hashes)
            sorted_hashes = hashes[by]
            same = sorted_hashes[1:] == sorted_hashes[:-1]
            if (same & (check[by[1:]] != check[by[:-1]])).any():  # unequal windows of one hash
                by = np.lexsort((check, hashes))
                same &= check[by[1:]] == check[by[:-1]]
            begin = np.flatnonzero(np.r_[True, ~same]) if len(by) else np.zeros(0, np.int64)
            first = np.minimum.reduceat(by, begin) if len(by) else by
            # repeats inside the block: every other occurrence that isn't the same place of the same document
            later = np.ones(len(by), bool)
            later[first] = False
            leader = np.empty(len(by), np.int64)
            leader[by] = np.repeat(first, np.diff(np.r_[begin, len(by)]))
            later &= (doc != doc[leader]) | (start != start[leader])
            yield from _marks(doc[later], start[later], buckets)
            # one entry per distinct hash, bucket after bucket
            keys = sorted_hashes[begin]
            edges = np.searchsorted(_bucket_of(keys, buckets), np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)):
                part = slice(edges[b], edges[b + 1])
                data = _pack(keys[part], check[first[part]], doc[first[part]], start[first[part]].astype(np.int32))
                yield _row(int(b), None, len(keys[part]), data)

        for batch in batches:
            for i, data in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(i)
                texts.append(data)
                words += len(data) // 5
                if words >= BLOCK_WORDS:
                    yield from flush()
                    texts, ids, words = [], [], 0
        if texts:
            yield from flush()

    return run


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash's upper half, so that buckets of sorted hashes are sorted."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _count_bucket(buckets: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for part, n, data in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if part is None:
                    found.append(_unpack(data, n, _KINDS))
                else:  # repeats that a task found itself
                    yield _row(part, part, n, data)
        if not found:
            return
        hashes = np.concatenate([f[0] for f in found])
        ordered = np.sort(hashes)
        repeated = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(repeated):
            return
        del ordered
        at = np.minimum(np.searchsorted(repeated, hashes), len(repeated) - 1)
        some = np.flatnonzero(repeated[at] == hashes)
        group = at[some]
        check, doc, start = (np.concatenate([f[k] for f in found])[some] for k in (1, 2, 3))
        by = np.lexsort((start, doc, check, group))
        group, check, doc, start = group[by], check[by], doc[by], start[by]
        begin = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (check[1:] != check[:-1])])
        leader = np.repeat(begin, np.diff(np.r_[begin, len(group)]))
        later = (doc != doc[leader]) | (start != start[leader])
        yield from _marks(doc[later], start[later], buckets)

    return run


def _gather(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's marks as one row per document."""
    found = [_unpack(d, n, _KINDS[2:]) for b in batches for n, d in zip(b.column("n").to_pylist(), b.column("data").to_pylist(), strict=True)]
    doc, start = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    for at in range(0, len(first), 1000):
        edges = np.r_[first[at : at + 1001], len(doc)][: min(1000, len(first) - at) + 1]
        starts = pa.ListArray.from_arrays(pa.array(edges - edges[0], pa.int32()), pa.array(start[edges[0] : edges[-1]], pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(doc[first[at : at + 1000]], pa.int64()), starts], ["doc_id", "starts"])


def repeated_starts(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``starts``: first words of the windows that also start earlier; a row per document that has any."""
    texts = id_and_text(docs, id_col, text_col).where("doc_id is not null")
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = buckets_for(total, BUCKET_BYTES)
    blocks = texts.mapInArrow(_hash_blocks(width, buckets), _SCHEMA)
    marks = blocks.groupBy("bucket").applyInArrow(_count_bucket(buckets), _SCHEMA)
    return marks.groupBy("part").applyInArrow(_gather, "doc_id long, starts array<int>")


def intervals(starts: list[int], width: int, n_words: int) -> np.ndarray:
    """Which words the windows with these starts cover."""
    edge = np.zeros(n_words + 1, np.int64)
    at = np.asarray(starts, np.int64)
    at = at[at < n_words]
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + width, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(width: int, keep_text: bool):
    def run(batches):
        for batch in (p for b in batches for p in parts(b)):
            out, rows = [], batch.select(["text", "starts"]).to_pylist()
            for row in rows:
                words = space_words(row["text"])
                if row["starts"]:
                    gone = intervals(row["starts"], width, len(words))
                    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).reshape(-1, 2).tolist()
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    edges, kept = [], words
                line = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), line if keep_text else hashlib.sha256(line).hexdigest(), [{"start": a, "end": b} for a, b in edges]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kept = pa.array(columns[2], pa.binary() if keep_text else pa.string())
            new = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), kept.cast(pa.string()), pa.array(columns[3], span)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *new], ["doc_id", "n_words", "n_removed", "kept", "spans"])

    return run


def substring_dedup(docs: DataFrame, width: int = 20, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (words that stay, or their SHA-256), spans of removed words."""
    starts = written(repeated_starts(docs, width, id_col, text_col))
    joined = id_and_text(docs, id_col, text_col).join(starts, "doc_id", "left")
    return joined.mapInArrow(_cut(width, not digest), "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start: long, end: long>>")


def removal_digests(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256."""
    return substring_dedup(docs, digest=True, **options).select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def _cut_rows(width: int, text_col: str):
    def run(batches):
        for batch in (p for b in batches for p in parts(b, text_col)):
            texts, keep = text_bytes(batch.column(text_col)), []
            starts = batch.column(_STARTS).to_pylist()
            for k, (data, found) in enumerate(zip(texts, starts, strict=True)):
                keep.append(True)
                if data and found:
                    gone = intervals(found, width, len(space_words(data)))
                    spans = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).reshape(-1, 2).tolist()
                    if spans:
                        texts[k] = cut_spans(data, SPACE_WORD, spans)
                        keep[-1] = not gone.all()
            yield from with_text(pa.Table.from_batches([batch]).drop_columns([_STARTS]), text_col, texts, keep)

    return run


#: Name of the column that carries window starts beside a caller's own.
_STARTS = "__twinlens_starts"


def cut_rows(docs: DataFrame, columns: list[str], width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``columns`` of ``docs`` with repeated words cut out of the texts; rows that lose all their words go."""
    starts = written(repeated_starts(docs, width, id_col, text_col))
    per_doc = starts.select(F.col("doc_id").alias("__twinlens_id"), F.col("starts").alias(_STARTS))
    docs = docs.select(*columns)
    joined = docs.join(per_doc, F.col(id_col).cast("long") == F.col("__twinlens_id"), "left").drop("__twinlens_id")
    return joined.mapInArrow(_cut_rows(width, text_col), docs.schema)
