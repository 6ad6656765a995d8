"""Benchmark decontamination with an FM-index per shard of the training texts.

A window is ``width`` consecutive words of a benchmark item (the whole item if it has fewer words).  Each task gathers
its documents into shards of bounded size, indexes a shard, searches all windows backward through it, locates their
occurrences and merges them into removal spans.

An occurrence consists of benchmark words only.  So a shard's index holds just the runs of benchmark words that are long
enough for the shortest window, cut wherever another word stands; that loses no occurrence and keeps the index small.

The benchmark may be of any size: its items are dealt into blocks of ``block_bytes``, tasks write their windows in slices
of at most about ``SLICE`` to the shared folder, and a worker maps one slice after the other for each shard.  Documents are
read once, row by row, and every row has its own spans.  A word is known by its 61-bit polynomial hash.

Defined cases: null and empty texts have no words and no hits; an item without words never occurs; words in windows of an
item without id are hit, but such an item isn't listed; items with equal windows all count; repeated rows, rows without a
doc_id and rows that share one each give a row with its own hits; texts and items of any length are taken whole; an empty
benchmark leaves everything clean, an empty table gives no row; columns other than those named are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.common import _WORD_TABLE, ALNUM_WORD, buckets_for, cut_spans, id_and_text, parts, scratch_dir, text_bytes, tidy, with_text
from twinlens.llm.fm_index import FmIndex
from twinlens.llm.hashing import word_hashes
from twinlens.llm.shards import load, save

#: Symbols in a shard's index, at most about.
SHARD = 400_000
#: Bytes of text after which a shard is searched, however few of its words stand in the benchmark.
SHARD_BYTES = 64_000_000
#: Windows that a worker holds at a time; pairs of a document and an item that it makes at a time.
SLICE, PAIRS = 100_000, 1_000_000


@dataclass
class Windows:
    """A benchmark's windows in the shared folder."""

    folder: str
    slices: list[str]
    shortest: int
    width: int

    def vocabulary(self) -> np.ndarray:
        return load(self.folder, "words", "u8") if self.slices else np.zeros(0, np.uint64)


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes([t.translate(_WORD_TABLE) for t in texts])


def _words(batches):
    for batch in (p for b in batches for p in parts(b)):
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_hashes(batch.column("text").to_pylist())[0]).view(np.int64))], ["word"])


def _save_words(folder: str):
    def run(batches):
        words = np.sort(np.concatenate([np.zeros(0, np.int64), *(np.asarray(b.column("word")) for b in batches)]).view(np.uint64))
        save(folder, "words", words)
        yield pa.RecordBatch.from_arrays([pa.array([len(words)], pa.int64())], ["n"])

    return run


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All places of some ranges, one after the other."""
    size = high - low
    return np.arange(int(size.sum())) + np.repeat(low - np.cumsum(size) + size, size)


def _save_block(folder: str, width: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(folder, "words", "u8")
        made = 0
        patterns, lengths, owners, items, size = [], [], [], [], 0

        def flush():
            nonlocal made, patterns, lengths, owners, items, size
            rows = np.c_[np.concatenate(patterns), np.concatenate(lengths)]
            kinds, kind = np.unique(rows, axis=0, return_inverse=True)
            pairs = np.unique(kind.ravel().astype(np.int64) << 32 | np.concatenate(owners))
            name = f"{key[0].as_py()}-{made}"
            save(folder, f"{name}-patterns", kinds[:, :-1].astype(np.int32))
            save(folder, f"{name}-lengths", kinds[:, -1].astype(np.int32))
            save(folder, f"{name}-owner_at", np.searchsorted(pairs >> 32, np.arange(len(kinds) + 1)).astype(np.int64))
            save(folder, f"{name}-owners", (pairs & 0xFFFFFFFF).astype(np.int32))
            save(folder, f"{name}-items", np.frombuffer(json.dumps(items).encode(), np.uint8))
            shortest = int(kinds[:, -1].min())
            made, patterns, lengths, owners, items, size = made + 1, [], [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([shortest], pa.int64())], ["name", "shortest"])

        for batch in (p for b in batches for p in parts(b)):
            hashes, at = _hashes(batch.column("text").to_pylist())
            symbols = np.searchsorted(vocabulary, hashes) + 1
            for k, item in enumerate(batch.column("item").to_pylist()):
                own = symbols[at[k] : at[k + 1]]
                if not len(own):
                    continue
                if len(own) < width:
                    own = np.r_[own, np.zeros(width - len(own), np.int64)]
                windows = np.lib.stride_tricks.sliding_window_view(own, width)
                for low in range(0, len(windows), SLICE):
                    some = windows[low : low + SLICE]
                    patterns.append(some)
                    lengths.append((some > 0).sum(1))
                    owners.append(np.full(len(some), len(items), np.int64))
                    items.append(item)
                    size += len(some)
                    if size >= SLICE:
                        yield flush()
        if size:
            yield flush()

    return tidy(run)


def benchmark_windows(benchmark: DataFrame, width: int = 10, block_bytes: int = 1_000_000, item_col: str = "item_id", text_col: str = "text") -> Windows:
    """Write a benchmark's windows to the shared folder."""
    folder = scratch_dir(benchmark.sparkSession)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    words = items.select("text").mapInArrow(_words, "word long").distinct()
    if not sum(r.n for r in words.repartition(1).mapInArrow(_save_words(folder), "n long").collect()):
        return Windows(folder, [], width, width)
    blocks = buckets_for(items.agg(F.sum(F.length("text"))).first()[0], block_bytes)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    rows = dealt.groupBy("block").applyInArrow(_save_block(folder, width), "name string, shortest long").collect()
    return Windows(folder, sorted(r.name for r in rows), min(r.shortest for r in rows), width)


class Shard:
    """Documents gathered for one index."""

    def __init__(self, windows: Windows, vocabulary: np.ndarray):
        self.windows, self.vocabulary = windows, vocabulary
        self.docs, self.bytes, self.size = 0, 0, 0
        self.n_words, self.symbols, self.doc_of, self.place = [], [], [], []

    def add(self, texts: list[bytes]) -> None:
        hashes, at = _hashes(texts)
        counts = np.diff(at)
        self.n_words.append(counts)
        self.bytes += sum(map(len, texts))
        if len(self.vocabulary) and len(hashes):
            kinds, back = np.unique(hashes, return_inverse=True)
            found = np.minimum(np.searchsorted(self.vocabulary, kinds), len(self.vocabulary) - 1)
            ids = np.where(self.vocabulary[found] == kinds, found + 1, 0)[back]
            known = ids > 0
            starts = np.zeros(len(ids) + 1, bool)
            starts[at] = True  # runs end where texts do
            begin = np.flatnonzero(known & (starts[:-1] | ~np.r_[False, known[:-1]]))
            end = np.flatnonzero(known & (starts[1:] | ~np.r_[known[1:], False])) + 1
            long = end - begin >= self.windows.shortest
            begin, end = begin[long], end[long]
            if len(begin):
                places = _ranges(begin, end + 1)  # a run, and the separator behind it
                symbols = np.r_[ids, 0][places]
                last = np.cumsum(end - begin + 1) - 1
                symbols[last] = 0
                doc = np.repeat(np.repeat(np.arange(len(texts)), counts)[begin], end - begin + 1)
                self.symbols.append(symbols)
                self.doc_of.append(doc + self.docs)
                self.place.append(places - at[doc])
                self.size += len(symbols)
        self.docs += len(texts)

    def full(self, most: int) -> bool:
        return self.size >= SHARD or self.bytes >= most

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
        """Merged spans (document, start, end) sorted, and the items that occur in each document."""
        items: list[set[str]] = [set() for _ in range(self.docs)]
        none = np.zeros(0, np.int64)
        if not self.size:
            return none, none, none, items
        text, doc_of, place = np.concatenate(self.symbols), np.concatenate(self.doc_of), np.concatenate(self.place)
        kinds, text = np.unique(text, return_inverse=True)  # symbol 0, the separator, stays 0
        index = FmIndex(text, len(kinds) - 1)
        cover = np.zeros(len(text) + 1, np.int64)
        for name in self.windows.slices:
            self._search(name, kinds, index, doc_of, cover, items)
        covered = np.cumsum(cover[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
        begin, end = edges[::2], edges[1::2]
        return doc_of[begin], place[begin], place[begin] + (end - begin), items

    def _search(self, name: str, kinds: np.ndarray, index: FmIndex, doc_of: np.ndarray, cover: np.ndarray, items: list[set[str]]) -> None:
        """Search a slice's windows; what they cover and whose they are is added."""
        folder = self.windows.folder
        lengths = np.asarray(load(folder, f"{name}-lengths", "i4")).astype(np.int64)
        patterns = np.asarray(load(folder, f"{name}-patterns", "i4")).reshape(len(lengths), self.windows.width)
        local = np.minimum(np.searchsorted(kinds, patterns), len(kinds) - 1)
        able = np.flatnonzero((kinds[local] == patterns).all(1))  # other windows hold a word that the shard lacks
        lengths = lengths[able]
        low, high = index.search(local[able], lengths)
        count = high - low
        if not count.sum():
            return
        window = np.repeat(np.arange(len(count)), count)
        at = index.locate(_ranges(low, high))
        np.add.at(cover, at, 1)
        np.add.at(cover, at + lengths[window], -1)
        pairs = np.unique(doc_of[at] << 32 | able[window])
        doc, window = pairs >> 32, pairs & 0xFFFFFFFF
        owner_at, owners = load(folder, f"{name}-owner_at", "i8"), load(folder, f"{name}-owners", "i4")
        names = json.loads(np.asarray(load(folder, f"{name}-items", "u1")).tobytes())
        size = owner_at[window + 1] - owner_at[window]
        step = np.cumsum(size) // PAIRS
        for k in range(int(step[-1]) + 1):
            some = step == k
            owned = np.repeat(doc[some], size[some]) << 32 | owners[_ranges(owner_at[window[some]], owner_at[window[some] + 1])].astype(np.int64)
            for pair in np.unique(owned).tolist():
                if names[pair & 0xFFFFFFFF] is not None:
                    items[pair >> 32].add(names[pair & 0xFFFFFFFF])


def _search(shared):
    def run(batches):
        windows: Windows = shared.value
        vocabulary = windows.vocabulary()
        shard, ids = Shard(windows, vocabulary), []

        def flush():
            doc, start, end, items = shard.spans()
            at = np.searchsorted(doc, np.arange(shard.docs + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["start", "end"])
            columns = [pa.array(ids, pa.int64()), pa.array(np.concatenate(shard.n_words), pa.int64()), pa.ListArray.from_arrays(pa.array(at), spans), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "spans", "items"])

        for batch in (p for b in batches for p in parts(b)):
            shard.add(batch.column("text").to_pylist())
            ids += batch.column("doc_id").to_pylist()
            if shard.full(SHARD_BYTES):
                yield flush()
                shard, ids = Shard(windows, vocabulary), []
        if shard.docs:
            yield flush()

    return tidy(run)


def benchmark_spans(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, spans array<struct<start, end>> of hit words, items array<string>."""
    shared = docs.sparkSession.sparkContext.broadcast(benchmark_windows(benchmark, width, block_bytes, item_col, item_text_col))
    schema = "doc_id long, n_words long, spans array<struct<start: long, end: long>>, items array<string>"
    return id_and_text(docs, id_col, text_col).mapInArrow(_search(shared), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x.end - x.start)
    return benchmark_spans(docs, benchmark, **options).select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def _cut_rows(shared, text_col: str):
    def run(batches):
        windows: Windows = shared.value
        vocabulary = windows.vocabulary()
        shard, held = Shard(windows, vocabulary), []

        def flush():
            doc, start, end, _ = shard.spans()
            at = np.searchsorted(doc, np.arange(shard.docs + 1)).tolist()
            table, n_words = pa.Table.from_batches(held), np.concatenate(shard.n_words).tolist()
            texts, keep = text_bytes(table.column(text_col)), []
            for k in range(len(texts)):
                spans = list(zip(start[at[k] : at[k + 1]].tolist(), end[at[k] : at[k + 1]].tolist(), strict=True))
                if texts[k] and spans:
                    texts[k] = cut_spans(texts[k], ALNUM_WORD, spans)
                keep.append(not spans or sum(b - a for a, b in spans) < n_words[k])
            return with_text(table, text_col, texts, keep)

        for batch in (p for b in batches for p in parts(b, text_col)):
            held.append(batch)
            shard.add([t or b"" for t in text_bytes(batch.column(text_col))])
            if shard.full(SHARD_BYTES // 4):
                yield from flush()
                shard, held = Shard(windows, vocabulary), []
        if held:
            yield from flush()

    return tidy(run)


def cut_rows(docs: DataFrame, benchmark: DataFrame, columns: list[str], width: int = 10, block_bytes: int = 1_000_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``columns`` of ``docs`` with benchmark words cut out of the texts; rows that lose all their words go."""
    docs = docs.select(*columns)
    shared = docs.sparkSession.sparkContext.broadcast(benchmark_windows(benchmark, width, block_bytes, item_col, item_text_col))
    return docs.mapInArrow(_cut_rows(shared, text_col), docs.schema)
