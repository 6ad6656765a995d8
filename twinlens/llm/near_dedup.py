"""MinHash near-dedup with tensored banding, verified on full shingle sets.

* Texts with equal shingle sets form a class at once, by a 128-bit digest of the set; one representative goes on.
* A representative has two collections of ``groups`` keys, each key made of ``rows`` minhashes.  Table (i, j) is keyed by
  key i of the first and key j of the second: groups * groups tables from 2 * groups * rows minhashes.  Two sets of
  similarity s share a table unless they agree on no key of one of the collections: (1 - s ** rows) ** groups each.  At
  0.8 with 8 groups of 2 that is below 6 in 10 000 in all.
* Candidates are pairs of a bucket, not of a component: every bucket's leader is compared with the bucket's other members.
  Sizes that rule the threshold out, and minhashes that agree so rarely that a linked pair does so once in a million
  times, end a candidate; all others are counted on full sets.  Links join classes; then the leader leaves its bucket, and
  a bucket whose members still belong to several components gets another leader.
* After ``ROUNDS`` leaders what is left of such buckets is compared whole inside tasks: a bucket's members are dealt into
  blocks and each pair of blocks goes to a task, so no task grows with a bucket.  A pair counts in the first table that
  it shares only, and only if it isn't of one component by then; sizes, minhashes and full sets decide as above.  No pair
  becomes a row, and no pair of a bucket stays undecided.
* A leader's partners are dealt into several tasks by their bytes, so a leader of many partners is no hot key.

Defined cases: null, empty and blank texts have no shingles and link with nothing; a text with fewer words than ``width``
is one shingle; rows that share a doc_id are one node, linked by what any of their texts links with; a row without a
doc_id links with nothing and is kept; repeated rows each give a row; an empty table gives none; texts of any length are
compared whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.llm.common import drop_path, id_and_text, parts, tidy, written
from twinlens.llm.hashing import mix, rolling, word_hashes
from twinlens.operators.components import components

#: Bytes of text whose pairs one task counts.
TASK_BYTES = 4_000_000
#: Leaders that a bucket gets before its rest is compared whole.
ROUNDS = 2
#: Chance that minhashes of a pair at the threshold agree too rarely to be counted on full sets.
MISSED = 1e-6
#: Bytes of minhashes in a number; a byte each.
LANES = 7


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within it, and where each text's begin (one entry more)."""
    words, at = word_hashes([t.lower() for t in texts])
    counts = np.diff(at)
    n = np.where(counts >= width, counts - width + 1, 0)
    hashes = rolling(words, width)
    text = np.repeat(np.arange(len(texts)), n)
    start = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    found = hashes[at[text] + start] if len(text) else hashes[:0]
    few = [(k, rolling(words[at[k] : at[k + 1]], int(counts[k]))[0] ^ np.uint64(counts[k])) for k in np.flatnonzero((counts > 0) & (counts < width)).tolist()]
    if few:
        text = np.r_[text, np.array([k for k, _ in few])]
        found = np.r_[found, np.array([h for _, h in few], np.uint64)]
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return found[new], np.searchsorted(text[new], np.arange(len(texts) + 1))


def minhashes(shingles: np.ndarray, at: np.ndarray, count: int, seed: int) -> np.ndarray:
    """``count`` minhashes of each set that isn't empty."""
    full = np.flatnonzero(np.diff(at) > 0)
    out = np.empty((len(full), count), np.uint64)
    if len(full):
        with np.errstate(over="ignore"):
            keys = mix(np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1000))
            for k in range(count):
                x = (shingles ^ keys[k]) * (keys[-1 - k] | np.uint64(1))
                x ^= x >> np.uint64(32)
                x *= np.uint64(0x9FB21C651E98DF25)
                x ^= x >> np.uint64(29)
                out[:, k] = np.minimum.reduceat(x, at[full])
    return out


def _keys(minima: np.ndarray, rows: int, salt: int) -> np.ndarray:
    """One key for each ``rows`` minhashes; its number in the collection is part of it."""
    with np.errstate(over="ignore"):
        out = []
        for g in range(minima.shape[1] // rows):
            x = np.full(len(minima), salt * 1000 + g, np.uint64)
            for r in range(rows):
                x = mix(x ^ minima[:, g * rows + r]) + np.uint64(0x632BE59BD9B4E019)
            out.append(x)
    return np.stack(out, 1).view(np.int64)


def _lanes(minima: np.ndarray) -> list[np.ndarray]:
    """The lowest byte of each minhash, ``LANES`` to a number."""
    low = np.zeros((len(minima), -(-minima.shape[1] // LANES) * LANES), np.int64)
    low[:, : minima.shape[1]] = (minima & np.uint64(0xFF)).astype(np.int64)
    shifts = np.arange(LANES, dtype=np.int64) * 8
    return [(low[:, at : at + LANES] << shifts).sum(1) for at in range(0, low.shape[1], LANES)]


def _sketch(width: int, groups: int, rows: int):
    names = _lane_names(2 * groups * rows)

    def run(batches):
        for batch in (p for b in batches for p in parts(b)):
            shingles, place = shingle_sets(batch.column("text").to_pylist(), width)
            n = np.diff(place)
            full = np.flatnonzero(n > 0)
            digests: list = [None] * len(n)
            for k in full.tolist():
                digests[k] = hashlib.blake2b(shingles[place[k] : place[k + 1]].tobytes(), digest_size=16).digest()
            minima = minhashes(shingles, place, 2 * groups * rows, 7)
            edges = pa.array(np.r_[0, np.cumsum(np.where(n > 0, groups, 0))].astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(_keys(part, rows, salt).ravel() if len(full) else np.zeros(0, np.int64))) for part, salt in ((minima[:, : groups * rows], 1), (minima[:, groups * rows :], 2))]
            lanes = []
            for lane in _lanes(minima):
                column = np.zeros(len(n), np.int64)
                column[full] = lane
                lanes.append(pa.array(column))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), *lists, *lanes],
                ["doc_id", "h", "n_bytes", "n_shingles", "digest", "a", "b", *names],
            )

    return tidy(run)


def _lane_names(minhashes: int) -> list[str]:
    return [f"s{k}" for k in range(-(-minhashes // LANES))]


def _agreeing(names: list[str], count: int) -> Column:
    """How many minhashes of two sketches (columns of ``u`` and ``v``) agree: bytes of their difference that are 0."""
    low, high = sum(0x7F << (8 * k) for k in range(LANES)), sum(0x80 << (8 * k) for k in range(LANES))
    total = F.lit(count)
    for name in names:
        x = F.col(f"u.{name}").bitwiseXOR(F.col(f"v.{name}"))
        total = total - F.bit_count((x.bitwiseAND(F.lit(low)) + F.lit(low)).bitwiseOR(x).bitwiseAND(F.lit(high)))
    return total


def least_agreeing(count: int, similarity: float) -> int:
    """The largest number of agreeing minhashes that a pair of this similarity falls below with a chance of ``MISSED``."""
    below, k = 0.0, 0
    while k < count:
        below += math.comb(count, k) * similarity**k * (1 - similarity) ** (count - k)
        if below > MISSED:
            break
        k += 1
    return k


def _sets_of(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_sets``, a few texts at a time, so that what lies between stays small."""
    out, edges, low, size = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size > 1_000_000 or k == len(texts) - 1:
            shingles, at = shingle_sets(texts[low : k + 1], width)
            out.append(shingles)
            edges.append(at[1:] + edges[-1][-1])
            low, size = k + 1, 0
    return np.concatenate(out), np.concatenate(edges)


def _verify(width: int, percent: int):
    """Pairs (u, v) of a task, counted on the full sets of its texts; those that link."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[int, bytes] = {}
        pairs = []
        for batch in batches:
            for c, t, u, v in zip(*(batch.column(x).to_pylist() for x in ("cid", "text", "u", "v")), strict=True):
                if c is None:
                    pairs.append((v, u))
                else:
                    texts[c] = t
        place = {c: k for k, c in enumerate(texts)}
        shingles, at = _sets_of(list(texts.values()), width)
        del texts
        pairs.sort()
        found: list[tuple[int, int]] = []
        low = 0
        while low < len(pairs):
            high, leader = low, pairs[low][0]
            while high < len(pairs) and pairs[high][0] == leader and high - low < 1000:
                high += 1
            some = np.array([place[u] for _, u in pairs[low:high]])
            own = place[leader]
            shared = _count_shared(shingles, at, own, some)
            linked = 100 * shared >= percent * (at[some + 1] - at[some] + at[own + 1] - at[own] - shared)
            found += [(pairs[low + k][1], leader) for k in np.flatnonzero(linked).tolist()]
            low = high
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["u", "v"])

    return tidy(run)


def _count_shared(shingles: np.ndarray, at: np.ndarray, own: int, some: np.ndarray) -> np.ndarray:
    """How many shingles set ``own`` shares with each of some others."""
    mine, size = shingles[at[own] : at[own + 1]], at[some + 1] - at[some]
    edges = np.r_[0, np.cumsum(size)]
    theirs = shingles[np.arange(edges[-1]) + np.repeat(at[some] - edges[:-1], size)]
    hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
    return np.add.reduceat(hit.astype(np.int64), edges[:-1])


_LOW, _HIGH = (np.int64(sum(x << (8 * k) for k in range(LANES))) for x in (0x7F, 0x80))


def _link_rest(width: int, percent: int, groups: int, count: int):
    """Pairs of blocks of buckets, compared whole; links of members of different components."""
    names, least = _lane_names(count), least_agreeing(count, percent / 100)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        cid, first_row = np.unique(np.asarray(rows.column("cid")), return_index=True)
        member = np.searchsorted(cid, np.asarray(rows.column("cid")))
        one = rows.take(pa.array(first_row))
        shingles, at = _sets_of(one.column("text").to_pylist(), width)
        keys = [np.asarray(one.column(c).combine_chunks().flatten()).reshape(-1, groups) for c in ("a", "b")]
        lanes = np.stack([np.asarray(one.column(n)) for n in names], 1)
        label, size = np.asarray(one.column("label")), np.diff(at)
        bucket, first, second, block = (np.asarray(rows.column(c)) for c in ("key", "first", "second", "block"))
        table = np.asarray(rows.column("number"))
        order = np.lexsort((member, second, first, table, bucket))
        new = np.zeros(len(order), bool)
        for c in (bucket, table, first, second):
            new[1:] |= c[order[1:]] != c[order[:-1]]
        edges = [0, *np.flatnonzero(new).tolist(), len(order)]
        found: list[tuple[int, int]] = []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            group = order[low:high]
            m, side = member[group], block[group]
            x, y = divmod(int(table[group[0]]), groups)
            same = first[group[0]] == second[group[0]]
            kinds, n = np.unique(label[m], return_counts=True)
            stray = label[m] != kinds[n.argmax()]
            for k in np.flatnonzero(stray).tolist():
                i = m[k]
                good = (label[m] != label[i]) & ~(stray & (np.arange(len(m)) < k))
                if not same:
                    good &= side != side[k]
                good &= 100 * np.minimum(size[m], size[i]) >= percent * np.maximum(size[m], size[i])
                some = m[good]
                some = some[~(keys[0][some, :x] == keys[0][i, :x]).any(1) & ~(keys[1][some, :y] == keys[1][i, :y]).any(1)]
                d = lanes[some] ^ lanes[i]
                some = some[count - np.bitwise_count(((d & _LOW) + _LOW | d) & _HIGH).sum(1, dtype=np.int64) >= least]
                if len(some):
                    shared = _count_shared(shingles, at, i, some)
                    found += [(int(cid[i]), int(cid[j])) for j in some[100 * shared >= percent * (size[some] + size[i] - shared)].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], ["u", "v"])

    return tidy(run)


def sketches(docs: DataFrame, width: int, groups: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, hash and bytes of the text, size and digest of its set, its keys, and a byte of each minhash."""
    lanes = ", ".join(f"{x} long" for x in _lane_names(2 * groups * rows))
    schema = f"doc_id long, h long, n_bytes long, n_shingles long, digest binary, a array<long>, b array<long>, {lanes}"
    return _hashed(docs, id_col, text_col).mapInArrow(_sketch(width, groups, rows), schema)


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_and_text(docs, id_col, text_col).withColumn("h", F.xxhash64("text")).withColumn("n_bytes", F.length("text").cast("long"))


class _Search:
    """The classes of a corpus and the links between them."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, percent: int, groups: int, count: int, id_col: str, text_col: str):
        self.classes, self.width, self.percent, self.groups, self.lanes, self.count = classes, width, percent, groups, _lane_names(count), count
        self.spark, self.scratch = docs.sparkSession, []
        # a table's number is part of its keys, since keys of a collection hold their places in it
        keys = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))
        tables = classes.select("cid", F.explode(keys).alias("key"))
        buckets = tables.groupBy("key").agg(F.min("cid").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
        self.open = self.keep(tables.join(buckets.select("key", "leader").hint("merge"), "key"))
        members = classes.join(self.open.select("cid").distinct().hint("merge"), "cid", "left_semi").select("cid", F.col("rep").alias("doc_id"), "h")
        texts = _hashed(docs, id_col, text_col).join(members.hint("merge"), ["doc_id", "h"]).select("cid", "text")
        self.texts = self.keep(self.keep(texts).groupBy("cid").agg(F.first("text").alias("text")))
        self.compared = self.components = None

    def keep(self, df: DataFrame) -> DataFrame:
        out = written(df)
        self.scratch.append(out.scratch_path)
        return out

    def close(self) -> None:
        for path in self.scratch:
            drop_path(self.spark, path)

    def candidates(self, ties: DataFrame) -> DataFrame:
        """(u, v, n_bytes of u) of ties (u, v) that sizes and minhashes leave open and that weren't compared before."""
        ties = ties.distinct()
        if self.compared is not None:
            ties = ties.join(self.compared.hint("merge"), ["u", "v"], "left_anti").join(self.compared.select(F.col("u").alias("v"), F.col("v").alias("u")).hint("merge"), ["u", "v"], "left_anti")
        sketch = F.struct("n_shingles", "n_bytes", *self.lanes)
        both = ties.toDF("a", "b").join(self.classes.select(F.col("cid").alias("a"), sketch.alias("u")).hint("merge"), "a").join(self.classes.select(F.col("cid").alias("b"), sketch.alias("v")).hint("merge"), "b")
        near = both.where(F.least("u.n_shingles", "v.n_shingles") * 100 >= F.greatest("u.n_shingles", "v.n_shingles") * self.percent)
        near = near.where(_agreeing(self.lanes, self.count) >= least_agreeing(self.count, self.percent / 100))
        return near.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("u.n_bytes").alias("n_bytes"))

    def verify(self, ties: DataFrame) -> None:
        """Compare ties (u, v); v is the leader."""
        pairs = self.keep(self.candidates(ties))
        partners = pairs.groupBy("v").agg(F.sum(F.col("n_bytes") + 64).alias("w"))
        tasks = max(1, -(-(pairs.agg(F.sum(F.col("n_bytes") + 64)).first()[0] or 0) // TASK_BYTES))
        dealt = pairs.join(partners.hint("merge"), "v").select("u", "v", F.pmod(F.xxhash64("v"), F.lit(tasks)).alias("task"), F.pmod(F.xxhash64("u"), F.ceil(F.col("w") / TASK_BYTES)).alias("salt"))
        dealt = self.keep(dealt)
        needed = dealt.select("task", "salt", F.col("u").alias("cid")).union(dealt.select("task", "salt", "v")).distinct()
        none = F.lit(None).cast("long")
        rows = needed.join(self.texts.hint("merge"), "cid").select("task", "salt", "cid", "text", none.alias("u"), none.alias("v"))
        rows = rows.union(dealt.select("task", "salt", none, F.lit(None).cast("binary"), "u", "v"))
        self.add(rows.groupBy("task", "salt").applyInArrow(_verify(self.width, self.percent), "u long, v long"))
        compared = pairs.select("u", "v")
        self.compared = compared if self.compared is None else self.compared.union(compared)

    def add(self, links: DataFrame) -> None:
        """Join components up by further links."""
        self.components = self.keep(components(links if self.components is None else self.components.toDF("u", "v").union(links)))

    def next_leaders(self) -> bool:
        """Leaders leave their buckets; buckets that still hold several components get another one.  False if none does."""
        label = F.coalesce("component", "cid").alias("label")
        rest = self.open.where("cid <> leader").select("key", "cid").join(self.components.toDF("cid", "component").hint("merge"), "cid", "left").select("key", "cid", label)
        of = rest.groupBy("key").agg(F.min("label").alias("least"), F.max(F.struct("label", "cid")).alias("m")).where("least <> m.label")
        self.open = self.keep(rest.join(of.select("key", F.col("m.cid").alias("leader"), F.col("m.label").alias("leader_label")).hint("merge"), "key"))
        return not self.open.isEmpty()

    def run(self) -> DataFrame:
        """(node, component) of linked classes."""
        self.verify(self.open.where("cid <> leader").select(F.col("cid").alias("u"), F.col("leader").alias("v")))
        for _ in range(ROUNDS - 1):
            if not self.next_leaders():
                return self.components
            self.verify(self.open.where("label <> leader_label").select(F.col("cid").alias("u"), F.col("leader").alias("v")))
        if self.next_leaders():
            self.whole()
        return self.components

    def whole(self) -> None:
        """Compare what is left of open buckets."""
        of = self.classes.select("cid", "n_bytes", "a", "b", *self.lanes)
        members = self.open.select("key", "cid", "label").join(of.select("cid", "n_bytes").hint("merge"), "cid")
        sizes = members.groupBy("key").agg(F.ceil(F.sum(F.col("n_bytes") + 256) / (TASK_BYTES // 2)).cast("int").alias("blocks"), F.sum(F.col("n_bytes") + 256).alias("w"))
        total = sizes.agg(F.sum(F.col("w") * F.col("blocks"))).first()[0] or 0
        dealt = members.join(sizes.hint("merge"), "key").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("key", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "cid", "label", "block")
        dealt = dealt.join(of.drop("n_bytes").hint("merge"), "cid").join(self.texts.hint("merge"), "cid")
        place = F.array_position(F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y)))), F.col("key")) - 1
        dealt = dealt.withColumn("number", place).withColumn("task", F.pmod(F.xxhash64("key", "first", "second"), F.lit(max(1, -(-total // TASK_BYTES)))))
        self.add(dealt.groupBy("task").applyInArrow(_link_rest(self.width, self.percent, self.groups, self.count), "u long, v long"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, groups: int = 8, rows: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reached through links), kept (doc_id = component_id)."""
    spark = docs.sparkSession
    sketch = written(sketches(docs, width, groups, rows, id_col, text_col))
    lanes = _lane_names(2 * groups * rows)
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    least = full.groupBy("digest").agg(F.min(F.struct("doc_id", "h", "n_bytes", "n_shingles", "a", "b", *lanes)).alias("r"))
    classes = written(least.select(F.monotonically_increasing_id().alias("cid"), "digest", F.col("r.doc_id").alias("rep"), *(f"r.{x}" for x in ("h", "n_bytes", "n_shingles", "a", "b", *lanes))))
    search = _Search(docs, classes, width, percent, groups, 2 * groups * rows, id_col, text_col)
    found = search.run()

    # rows that share a doc_id but not a text tie the classes of their texts
    several = full.groupBy("doc_id").agg(F.min("digest").alias("digest"), F.max("digest").alias("other")).where("digest <> other").select("doc_id")
    of_ids = written(full.join(several.hint("merge"), "doc_id", "left_semi").select("doc_id", "digest").distinct().join(classes.select("digest", "cid").hint("merge"), "digest").select("doc_id", "cid"))
    if not of_ids.isEmpty():
        search.add(of_ids.join(of_ids.groupBy("doc_id").agg(F.min("cid").alias("v")).hint("merge"), "doc_id").select(F.col("cid").alias("u"), "v"))
        found = search.components
    members = found.toDF("cid", "component").join(classes.select("cid", "digest", "rep").hint("merge"), "cid")
    smallest = members.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked_classes = written(members.join(smallest.hint("merge"), "component").select("digest", "component_id"))
    search.close()
    drop_path(spark, of_ids.scratch_path)
    out = sketch.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    out = out.join(classes.select("digest", "rep").join(linked_classes.hint("merge"), "digest", "left").select("digest", F.coalesce("component_id", "rep").alias("component")).hint("merge"), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
