"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays, mapped by workers.

Tokens are words (A-Z lower-cased) and one end per text; begin marks precede a text.  A word is its 64-bit hash, a bigram
or trigram the hash of its words' hashes, in full width.  ``order`` is 2 or 3.

1. Tasks count the words and n-grams of their training texts and send each distinct one once per block, as places in a
   list of the block's words, to shards by the n-gram's hash.  So a context's continuations lie in many shards, and a
   frequent context or word is no hot key.
2. With order 3, a trigram shard adds up and stores its trigrams, and sends on what they say of bigrams: before how many different words
   a bigram stands (its count in the lower order; a text's first bigram keeps its own count), and how often and with how
   many continuations of count 1, 2 and more it is a context.
3. A bigram shard does the same for bigrams and sends on what they say of words.
4. A word shard stores counts, counts of the lowest order and totals as a context.  Discounts come from the counts of
   counts of each order.
5. Scoring looks sorted hashes up in the mapped arrays, a block of texts and one shard at a time.

All n-grams of all training texts are kept, with counts of 64 bits.  A context that occurred once isn't stored: its bigram
tells that it was there, and its only continuation has the count 1.

Defined cases: null and empty texts consist of the end alone; a context that training didn't see leaves the lower order's
probability; without training texts there is one class, the unknown word, of probability 1; repeated rows each count and
each give a row; rows without a doc_id are scored, and aren't trained on; an empty table gives no row; texts of any length
are taken whole; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.common import buckets_for, fold, id_and_text, parts, scratch_dir, shuffles_freed, tidy
from twinlens.llm.hashing import mix, word_hashes
from twinlens.llm.shards import HashArrays, load, save, shard_of
from twinlens.llm.substring_dedup import _pack, _unpack

#: Hashes of the marks (fixed values without meaning).
END, BEGIN = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x1B873593CC9E2D51)
#: Bytes of text that a task counts or scores at a time, and that make a shard's share at most.
BLOCK_BYTES = 8_000_000
SHARD_BYTES = 12_000_000
#: What is kept of a bigram and of a word, in this order.
_BIGRAM = ("lower", "total", "once", "twice", "more")
_WORD = ("count", "lower", "total", "once", "twice", "more")
_SCHEMA = "kind string, shard int, n long, words long, data binary"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, and where each text's begin."""
    words, at = word_hashes([t.lower() for t in texts])
    ends = at[1:] + np.arange(len(texts))
    out = np.empty(len(words) + len(texts), np.uint64)
    out[ends] = END
    rest = np.ones(len(out), bool)
    rest[ends] = False
    out[rest] = words
    return out, np.r_[0, ends + 1]


def before(tokens: np.ndarray, at: np.ndarray, begin) -> tuple[np.ndarray, np.ndarray]:
    """The two tokens before each."""
    one, two = np.empty_like(tokens), np.empty_like(tokens)
    one[1:], two[2:] = tokens[:-1], tokens[:-2]
    one[at[:-1]] = two[at[:-1]] = begin
    second = at[:-1] + 1
    two[second[second < at[1:]]] = begin
    return two, one


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence of two."""
    return mix(mix(a + np.uint64(0x9E3779B97F4A7C15)) ^ b)


def _blocks(batches):
    """Texts and ids in blocks of about BLOCK_BYTES."""
    ids, texts, size = [], [], 0
    for batch in (p for b in batches for p in parts(b)):
        ids += batch.column("doc_id").to_pylist()
        texts += batch.column("text").to_pylist()
        size += sum(map(len, texts[len(texts) - batch.num_rows :])) + 8 * batch.num_rows
        if size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


def _row(kind: str, shard: int, n: int, words: int, data: bytes) -> pa.RecordBatch:
    values = zip((kind, shard, n, words, data), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], _NAMES)


def _send(kind: str, bits: int, keys: np.ndarray, words: list[np.ndarray], counts: list[np.ndarray]):
    """A row per shard: the words that occur, n-grams as places among them, and counts."""
    shard = shard_of(keys, bits)
    order = np.argsort(shard.astype(np.uint16 if bits <= 16 else np.uint32), kind="stable")
    edges = np.searchsorted(shard[order], np.arange((1 << bits) + 1))
    for s in np.flatnonzero(np.diff(edges)).tolist():
        some = order[edges[s] : edges[s + 1]]
        kinds, place = np.unique(np.concatenate([w[some] for w in words]), return_inverse=True)
        place = place.astype(np.uint32).reshape(len(words), len(some))
        by = np.lexsort(place[::-1])
        data = _pack(kinds, *place[:, by], *(c[some[by]].astype(np.uint64) for c in counts))
        yield _row(kind, s, len(some), len(kinds), data)


def _received(batches, words: int, counts: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """N-grams and counts of all rows of a shard."""
    out: list[list[np.ndarray]] = [[] for _ in range(words + counts)]
    for batch in batches:
        for n, m, data in zip(*(batch.column(c).to_pylist() for c in ("n", "words", "data")), strict=True):
            kinds, *columns = _unpack(data, [m] + [n] * (words + counts), [np.uint64] + [np.uint32] * words + [np.uint64] * counts)
            for k, c in enumerate(columns):
                out[k].append(kinds[c] if k < words else c)
    columns = [np.concatenate(c) for c in out]
    return columns[:words], columns[words:]


def _added(keys: np.ndarray, columns: list[np.ndarray], firsts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct keys in order, sums of the columns, and the first of what goes with the key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[begin], [np.add.reduceat(c[order], begin) for c in columns], [f[order[begin]] for f in firsts]


def _distinct(places: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of places below ``size``, and how often each occurs."""
    if len(places) * size.bit_length() >= 64:
        rows, count = np.unique(np.stack(places), axis=1, return_counts=True)
        return list(rows), count
    numbers = places[0]
    for p in places[1:]:
        numbers = numbers * np.uint64(size) + p
    numbers, count = np.unique(numbers, return_counts=True)
    out = []
    for _ in places[1:]:
        numbers, p = np.divmod(numbers, np.uint64(size))
        out.append(p)
    return [numbers, *reversed(out)], count


def _count(bits: int, order: int):
    def run(batches):
        for _, texts in _blocks(batches):
            tokens, at = token_hashes(texts)
            kinds, place, counts = np.unique(np.r_[tokens, BEGIN], return_inverse=True, return_counts=True)
            counts = counts.astype(np.uint64)
            begin = place[-1]
            counts[begin] -= np.uint64(1)
            place = place[:-1].astype(np.uint64)
            yield from _send("word", bits, kinds, [kinds], [counts, *[np.zeros(len(kinds), np.uint64)] * 5])
            two, one = before(place, at, begin)
            grams, count = _distinct([two, one, place][3 - order :], len(kinds))
            grams = [kinds[x] for x in grams]
            if order == 3:
                yield from _send("trigram", bits, joined(joined(*grams[:2]), grams[2]), grams, [count])
            else:
                yield from _send("bigram", bits, joined(*grams), grams, [count, *[np.zeros(len(count), np.uint64)] * 4])

    return tidy(run)


def _stat(order: str, shard: int, lower: np.ndarray, **more: int) -> pa.RecordBatch:
    """Counts of counts of an order's shard."""
    says = {"order": order, "shard": shard, "of": [int((lower == k).sum()) for k in (1, 2, 3, 4)], "distinct": int((lower > 0).sum()), "sum": int(lower.sum())}
    return _row("stat", shard, 0, 0, json.dumps(says | more).encode())


def _kinds_of(c: np.ndarray) -> list[np.ndarray]:
    return [(c == 1).astype(np.uint64), (c == 2).astype(np.uint64), (c > 2).astype(np.uint64)]


def _trigrams(folder: str, bits: int, shard: int, batches):
    (a, b, c), (count,) = _received(batches, 3, 1)
    keys, (count,), (a, b, c) = _added(joined(joined(a, b), c), [count], [a, b, c])
    HashArrays(folder, "trigram", bits, {"count": "u1"}).save(shard, keys, {"count": count})
    yield _stat("trigram", shard, count)
    none = np.zeros(len(keys), np.uint64)
    # of the bigram behind the first word, and of the bigram before the last
    lower = np.where((a == BEGIN) & (b == BEGIN), count, 1).astype(np.uint64)
    first, second = np.r_[b, a], np.r_[c, b]
    columns = [np.r_[x, y] for x, y in zip([lower, *[none] * 4], [none, count, *_kinds_of(count)], strict=True)]
    del a, b, c, keys
    keys, columns, (first, second) = _added(joined(first, second), columns, [first, second])
    yield from _send("bigram", bits, keys, [first, second], columns)


def _bigrams(folder: str, bits: int, shard: int, batches):
    (a, b), columns = _received(batches, 2, len(_BIGRAM))
    keys, columns, (a, b) = _added(joined(a, b), columns, [a, b])
    lower, total = columns[:2]
    HashArrays(folder, "bigram", bits, {"lower": "u1"}).save(shard, keys, {"lower": lower})
    several = np.flatnonzero(total > 1)  # none with order 2
    HashArrays(folder, "context", bits, dict.fromkeys(_BIGRAM[1:], "u1")).save(shard, keys[several], {n: c[several] for n, c in zip(_BIGRAM[1:], columns[1:], strict=True)})
    yield _stat("bigram", shard, lower)
    seen = lower > 0  # the pair of begin marks is a context only
    a, b, lower = a[seen], b[seen], lower[seen]
    none = np.zeros(len(a), np.uint64)
    sums = [np.r_[x, y] for x, y in zip([none, np.ones(len(a), np.uint64), *[none] * 4], [none, none, lower, *_kinds_of(lower)], strict=True)]
    words, sums, _ = _added(np.r_[b, a], sums, [])
    yield from _send("word", bits, words, [words], sums)


def _words(folder: str | None, bits: int, shard: int, batches):
    (words,), columns = _received(batches, 1, len(_WORD))
    words, columns, _ = _added(words, columns, [])
    if folder is None:  # others may still add to them
        yield from _send("word", bits, words, [words], columns)
        return
    save(folder, f"word-{shard}-key", words)
    for name, column in zip(_WORD, columns, strict=True):
        save(folder, f"word-{shard}-{name}", column)
    yield _stat("word", shard, columns[1], tokens=int(columns[0].sum()), words=int((columns[0] > 0).sum()))


def _store(folder: str, bits: int, last: bool):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, shard = key[0].as_py(), key[1].as_py()
        if kind == "stat":
            yield from batches
        elif kind == "trigram":
            yield from _trigrams(folder, bits, shard, batches)
        elif kind == "bigram":
            yield from _bigrams(folder, bits, shard, batches)
        else:
            yield from _words(folder if last else None, bits, shard, batches)

    return tidy(run)


def _discounts(n: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from the counts of counts."""
    if not all(n):
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0, *(min(k, max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3))])


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_inverse=True)


class KneserNey:
    """A fitted model; small itself, with its arrays in the shared folder."""

    def __init__(self, folder: str, bits: int, order: int, stats: list[dict]):
        self.folder, self.bits, self.order = folder, bits, order
        self.present = {o: frozenset(s["shard"] for s in stats if s["order"] == o) for o in ("trigram", "bigram", "word")}
        add = lambda order, field: sum(s[field] for s in stats if s["order"] == order)
        of = {o: [sum(s["of"][k] for s in stats if s["order"] == o) for k in range(4)] for o in self.present}
        self.discount = {o: _discounts(n) for o, n in of.items()}
        self.tokens, self.words = add("word", "tokens"), add("word", "words")
        self.pairs = add("word", "sum")
        n1, n2 = of["word"][:2]
        spread = self.discount["word"][1:] @ np.array([n1, n2, add("word", "distinct") - n1 - n2])
        self.rest = float(spread) / self.pairs if self.pairs else 1.0

    def _word(self, words: np.ndarray) -> dict[str, np.ndarray]:
        """What is stored of some sorted words; 0 where a word is unknown."""
        out = {c: np.zeros(len(words), np.uint64) for c in _WORD}
        edges = np.searchsorted(shard_of(words, self.bits), np.arange((1 << self.bits) + 1))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            if s in self.present["word"]:
                part = slice(edges[s], edges[s + 1])
                keys = load(self.folder, f"word-{s}-key", "u8")
                at = np.minimum(np.searchsorted(keys, words[part]), len(keys) - 1)
                hit = keys[at] == words[part]
                for c in _WORD:
                    out[c][part] = np.where(hit, load(self.folder, f"word-{s}-{c}", "u8")[at], 0)
        return out

    def _direct(self, order: str, count: np.ndarray) -> np.ndarray:
        return np.maximum(count.astype(float) - self.discount[order][np.minimum(count, 3).astype(np.int64)], 0)

    def _spare(self, order: str, x: dict[str, np.ndarray]) -> np.ndarray:
        d = self.discount[order]
        return d[1] * x["once"] + d[2] * x["twice"] + d[3] * x["more"]

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: tokens, known tokens, base score, score."""
        tokens, at = token_hashes(texts)
        kinds, place = _sorted(np.r_[tokens, BEGIN])
        word = self._word(kinds)
        two, one = before(place[:-1], at, place[-1])
        place = place[:-1]
        base = np.log10((word["count"] + 0.5) / (self.tokens + 0.5 * (self.words + 1)))
        p = (self._direct("word", word["lower"]) / max(1, self.pairs) + self.rest / (self.words + 1))[place]
        # bigrams: the last two words, and the first two as a context
        ends, contexts = joined(kinds[one], kinds[place]), joined(kinds[two], kinds[one])
        pairs, where = _sorted(np.r_[ends, contexts] if self.order == 3 else ends)
        known, found = HashArrays(self.folder, "bigram", self.bits, {"lower": "u1"}).find(pairs, self.present["bigram"])
        total = word["total"][one].astype(float)
        direct = self._direct("bigram", found["lower"])[where[: len(place)]]
        p = np.where(total > 0, (direct + self._spare("bigram", word)[one] * p) / np.maximum(total, 1), p)
        if self.order == 3:
            p = self._third(kinds[place], contexts, pairs, where[len(place) :], known, p)
        sums = [np.add.reduceat(x, at[:-1]) for x in ((word["count"] > 0)[place].astype(np.int64), base[place], np.log10(p))]
        return np.diff(at), *sums


    def _third(self, last: np.ndarray, contexts: np.ndarray, pairs: np.ndarray, where: np.ndarray, known: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Probabilities of the last words after contexts (at ``where`` in ``pairs``); a context of one occurrence has one
        continuation."""
        stored, context = HashArrays(self.folder, "context", self.bits, dict.fromkeys(_BIGRAM[1:], "u1")).find(pairs, self.present["bigram"])
        spare = np.where(stored, self._spare("trigram", context), self.discount["trigram"][1])
        total = np.where(stored, context["total"], 1).astype(float)
        triples, number = _sorted(joined(contexts, last))
        _, found = HashArrays(self.folder, "trigram", self.bits, {"count": "u1"}).find(triples, self.present["trigram"])
        direct = self._direct("trigram", found["count"])[number]
        return np.where(known[where], (direct + spare[where] * p) / total[where], p)


def fit(docs: DataFrame, order: int = 2, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> KneserNey:
    """Counts over all rows whose fold isn't ``held_out``; order 2 or 3."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    train = id_and_text(docs, id_col, text_col).where(fold() != held_out)
    size = train.agg(F.sum(F.length("text") + 8)).first()[0] or 0
    bits, folder = (buckets_for(size, SHARD_BYTES) - 1).bit_length(), scratch_dir(spark)
    rows = train.mapInArrow(_count(bits, order), _SCHEMA)
    for last in (False,) * (order - 1) + (True,):
        rows = rows.groupBy("kind", "shard").applyInArrow(_store(folder, bits, last), _SCHEMA)
    with shuffles_freed(spark):
        stats = rows.where("kind = 'stat'").select("data").collect()
    return KneserNey(folder, bits, order, [json.loads(bytes(r.data)) for r in stats])


def _score(shared):
    def run(batches):
        model: KneserNey = shared.value
        for ids, texts in _blocks(batches):
            n, known, base, score = model.score(texts)
            columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return tidy(run)


def score(docs: DataFrame, model: KneserNey, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = id_and_text(docs, id_col, text_col).mapInArrow(_score(shared), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    held = F.coalesce(fold() == held_out, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
