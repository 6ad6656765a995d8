"""Toxicity by nearest labelled examples: exact TF-IDF cosine over all words, block-max inverted lists.

Examples.  Labelled training rows (fold not 0) of equal text are one example with all their labels.  At most ``examples``
of them are fitted, half of each class if both have as many, those of smallest id hash, and at most ``example_bytes`` of
text; both bounds are parameters.  A class that was cut down counts in full where the score is calibrated.

Vectors.  A text's terms are all its words (A-Z lower-cased), none chosen and none left out.  A term weighs
(1 + ln of its count) * idf * (1 + strength): idf is taken over all documents, strength is the root of the log-likelihood
ratio by which the word speaks for label 1 among the examples, 0 if it doesn't.  Words that no example holds count in a
text's length, as words of one document.  Vectors have length 1.

Index.  Examples are ordered by their heaviest word, so that alike ones lie together, and cut into blocks of ``BLOCK``.
A query sums the inverted lists of its rarer words; for the ``HEAD`` most frequent ones, whose lists are as long as a
column, it takes each block's largest weights.  Both give a bound for every block.  The blocks of highest bound are summed
up first; a block whose bound stays below the k-th best is skipped, all others are summed, in single precision.  Sums within
rounding of the k-th best are made again in double precision.  So the k nearest are exact.

Score.  Votes of the k nearest weigh similarity / (distance + a little), more for texts that several rows have; their share of
label 1 is shrunk towards that of all examples.  By how much its log-odds leave those of all examples, times a slope, the
score's log-odds leave those of the base rate; the slope is fitted on the examples, each without its own vote.

Defined cases: a text that shares no word with any example, such as a null or empty one, scores the base rate; ties in
similarity are ordered by example; repeated rows each give a row; texts of any length are taken whole; without documents
there is no row; without examples, or with those of one class only, the slope is 1 (and without labels nothing is toxic);
labels that aren't 0 or 1, and rows without a doc_id, teach nothing; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlens.llm.common import _WORD_TABLE, fold, id_and_text, parts, text_bytes, tidy, trim, trim_driver
from twinlens.llm.hashing import word_hashes

#: Similarities within this of each other count as equal votes.
CLOSE = 0.02
#: Weight of the share of all examples among the votes.
PRIOR = 0.5
#: Examples of a block; most frequent words, whose weights stand in columns; texts asked at once.
BLOCK, HEAD, ASKED = 32, 256, 32
#: Blocks that are summed up first.
FIRST = 4
#: Beyond rounding in single precision.
MARGIN = 1e-5
#: Bytes of text that are made into vectors together.
PIECE_BYTES = 200_000


def term_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of some texts as sorted hashes; and each text's words: text, place among the hashes, count."""
    words, at = word_hashes([t.translate(_WORD_TABLE) for t in texts])
    kinds, word = np.unique(words, return_inverse=True)
    text = np.repeat(np.arange(len(texts)), np.diff(at))
    keys, counts = np.unique(text * max(1, len(kinds)) + word, return_counts=True)
    text, word = np.divmod(keys, max(1, len(kinds)))
    return kinds, text, word, counts


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of some ranges one after the other, and each range's size."""
    size = high - low
    return np.arange(int(size.sum())) + np.repeat(low - np.cumsum(size) + size, size), size


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys, -1 where there is none."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


class BlockMaxIndex:
    """Exact nearest of unit vectors, given as (terms, weights)."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.n = len(vectors)
        term = np.concatenate([np.zeros(0, np.int32), *(t for t, _ in vectors)])
        value = np.concatenate([np.zeros(0, np.float32), *(v.astype(np.float32) for _, v in vectors)])
        df = np.bincount(term, minlength=n_terms)
        head = np.sort(np.argsort(-df, kind="stable")[:HEAD])
        self.column = np.full(n_terms, -1, np.int16)
        self.column[head] = np.arange(len(head))
        #: Which vector stands in each row, and its row.
        self.vector = np.array(sorted(range(self.n), key=lambda i: int(vectors[i][0][vectors[i][1].argmax()]) if len(vectors[i][0]) else -1), np.int64)
        self.row = np.argsort(self.vector)
        owner = self.row[np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])] if self.n else np.zeros(0, np.int64)
        column = self.column[term]
        inside = column >= 0
        self.blocks = -(-self.n // BLOCK)
        self.dense = np.zeros((self.blocks * BLOCK, len(head)), np.float32)
        self.dense[owner[inside], column[inside]] = value[inside]
        self.most = self.dense.reshape(self.blocks, BLOCK, len(head)).max(1)
        rest = np.flatnonzero(~inside)
        rest = rest[np.lexsort((owner[rest], term[rest]))]
        df[head] = 0
        self.begin = np.r_[0, np.cumsum(df)].astype(np.int32)
        self.owner, self.weight = owner[rest].astype(np.int32), value[rest]

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per query the k most similar vectors (fewer if fewer share a term) and similarities, most similar first."""
        if not self.n:
            yield from ((np.zeros(0, np.int64), np.zeros(0)) for _ in queries)
            return
        for low in range(0, len(queries), ASKED):
            yield from self._asked(queries[low : low + ASKED], k)

    def _asked(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, rows = len(queries), len(self.dense)
        wide = np.zeros((n, self.dense.shape[1]))
        places, values = [], []
        for i, (t, v) in enumerate(queries):
            column = self.column[t]
            wide[i, column[column >= 0]] = v[column >= 0]
            listed = column < 0
            place, size = _ranges(self.begin[t[listed]], self.begin[t[listed] + 1])
            places.append(place)
            values.append(np.repeat(v[listed], size))
        place, of = np.concatenate(places), np.repeat(np.arange(n) * rows, [len(x) for x in places])
        lists = np.bincount(of + self.owner[place], self.weight[place] * np.concatenate(values), n * rows).astype(float, copy=False).reshape(n, self.blocks, BLOCK)
        single, dense = wide.astype(np.float32), self.dense.reshape(self.blocks, BLOCK, self.dense.shape[1])
        bounds = lists.max(2) + single @ self.most.T
        sums, done = lists.copy(), np.zeros((n, self.blocks), bool)
        first = min(self.blocks, max(FIRST, -(-k // BLOCK) + 1))
        best = np.argpartition(-bounds, first - 1, axis=1)[:, :first]
        least = np.empty(n)
        for i, some in enumerate(best):
            sums[i, some] += dense[some] @ single[i]
            least[i] = np.partition(sums[i, some], first * BLOCK - k, axis=None)[first * BLOCK - k]
            done[i, some] = True
        live = (bounds >= least[:, None] - MARGIN) & ~done
        for b in np.flatnonzero(live.any(0)).tolist():
            some = np.flatnonzero(live[:, b])
            sums[some, b] += single[some] @ dense[b].T
        sums[~(done | live)] = 0
        sums = sums.reshape(n, rows)
        least = np.maximum(np.partition(sums, rows - k, axis=1)[:, rows - k] - MARGIN, 0) if rows > k else np.zeros(n)
        for i in range(n):
            near = np.flatnonzero((sums[i] >= least[i]) & (sums[i] > 0))
            yield self._best(near, lists[i].ravel()[near] + self.dense[near].astype(float) @ wide[i], k)

    def _best(self, rows: np.ndarray, sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best, by sums in double precision."""
        found, sims = self.vector[rows], np.round(sums, 12)
        order = np.lexsort((found, -sims))[:k]
        return found[order], sims[order]

    def nearest(self, terms: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return next(self.nearest_of([(terms, values)], k))

    def vectors(self, low: int, high: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Vectors low to high, put together again."""
        out, head = [], np.flatnonzero(self.column >= 0)
        wanted = np.full(len(self.dense), -1)
        wanted[self.row[low:high]] = np.arange(high - low)
        place = np.flatnonzero(wanted[self.owner] >= 0)
        of, term = wanted[self.owner[place]], np.searchsorted(self.begin, place, "right") - 1
        for i in range(high - low):
            mine = of == i
            dense = self.dense[self.row[low + i]]
            t = np.r_[term[mine], head[dense > 0]]
            order = np.argsort(t)
            out.append((t[order], np.r_[self.weight[place[mine]], dense[dense > 0]].astype(float)[order]))
        return out


class Examples:
    """Vocabulary, weights and the index of examples: what workers hold."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, unknown: float, examples: list[tuple], k: int):
        """vocabulary: sorted hashes; unknown: weight of any other word; examples: (doc_id, rows, rows of label 1, rows of
        the corpus that each row stands for, places in the vocabulary, counts)."""
        self.vocabulary, self.weights, self.unknown, self.k = vocabulary, weights.astype(np.float32), unknown, k
        examples = sorted(examples, key=lambda e: e[0])
        self.doc = np.array([e[0] for e in examples], np.int64)
        self.rows, self.toxic, self.stands = (np.array([e[c] for e in examples], float) for c in (1, 2, 3))
        self.index = BlockMaxIndex([self.vector(e[4], e[5]) for e in examples], len(vocabulary))
        total = (self.rows * self.stands).sum()
        self.base = float(((self.toxic * self.stands).sum() + 0.5) / (total + 1)) if total else 0.0
        #: The share of label 1 among the examples' rows: what neighbours that have nothing to say vote.
        self.neutral = float((self.toxic.sum() + 0.5) / (self.rows.sum() + 1)) if total else 0.0

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vector over the vocabulary; words outside (-1) only take their share of the length."""
        known = terms >= 0
        tf = 1 + np.log(counts)
        values = tf[known] * self.weights[terms[known]]
        norm = math.sqrt(float(values @ values) + self.unknown**2 * float(tf[~known] @ tf[~known]))
        return terms[known], values / norm if norm else values

    def vectors(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [self.vector(t, c) for t, c in _per_text(texts, self.vocabulary)]

    def share(self, near: np.ndarray, sims: np.ndarray, without: int = -1, label: int = 0) -> float:
        """Shrunk share of label 1 among the nearest; ``without``: an example that has one row of ``label`` less."""
        rows, toxic = self.rows[near], self.toxic[near]
        if without >= 0:
            own = near == without
            rows, toxic = rows - own, toxic - own * label
        # rows of one text count less than as many different ones
        weight = np.sqrt(np.maximum(rows, 0)) * sims / (1 - sims + CLOSE)
        share = np.divide(toxic, rows, out=np.zeros(len(rows)), where=rows > 0)
        return float(((weight * share).sum() + PRIOR * self.neutral) / (weight.sum() + PRIOR))


def _per_text(texts: list[bytes], vocabulary: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's words, as places in the vocabulary (-1: not in it), and their counts."""
    kinds, text, word, counts = term_counts(texts)
    place, edges = _find(vocabulary, kinds)[word], np.searchsorted(text, np.arange(len(texts) + 1))
    return [(place[a:b], counts[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _pieces(batches, text_col: str = "text"):
    """Batches in slices of about PIECE_BYTES of text, and their texts."""
    for batch in (p for b in batches for p in parts(b, text_col, most=PIECE_BYTES)):
        yield batch, [t or b"" for t in text_bytes(batch.column(text_col))]


class Model:
    """Examples, as workers have them, and their calibration."""

    def __init__(self, spark, examples: Examples):
        self.examples, self.slope = examples, 1.0
        self.shared = spark.sparkContext.broadcast(examples)
        if 0 < examples.toxic.sum() < examples.rows.sum():
            n = len(examples.rows)
            rows = spark.range(0, n, 1, -(-n // 500)).mapInArrow(_own(self.shared), "id long, label int, rows double, share double").toArrow().sort_by([("id", "ascending"), ("label", "descending")])
            self._calibrate(*(np.array(rows.column(c)) for c in ("share", "label", "rows")))

    def close(self) -> None:
        """Workers may forget the examples."""
        self.shared.unpersist()

    def _calibrate(self, shares: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        x, a = np.array([_logit(p) for p in shares.tolist()]) - _logit(self.examples.neutral), 1.0
        for _ in range(50):  # Newton steps of a logistic regression with a slight pull towards 1
            p = 1 / (1 + np.exp(-np.clip(a * x + _logit(self.examples.base), -30, 30)))
            step = ((w * (p - y) * x).sum() + a - 1) / ((w * p * (1 - p) * x * x).sum() + 1)
            a -= step
            if abs(step) < 1e-9:
                break
        if math.isfinite(a) and a > 0:
            self.slope = float(a)

    def scorer(self):
        """A function from texts to scores and evidence (doc_id, similarity, share of label 1), for workers."""
        shared, slope = self.shared, self.slope

        def run(texts: list[bytes]):
            known: Examples = shared.value
            out = []
            for near, sims in known.index.nearest_of(known.vectors(texts), known.k):
                x = slope * (_logit(known.share(near, sims)) - _logit(known.neutral)) + _logit(known.base)
                x = min(30.0, max(-30.0, x))
                evidence = [(int(known.doc[i]), float(s), float(known.toxic[i] / known.rows[i])) for i, s in zip(near[:5].tolist(), sims[:5].tolist(), strict=True)]
                out.append((1 / (1 + math.exp(-x)), evidence))
            return out

        return run


def _own(shared):
    """Shares of the examples' own texts, without their votes."""

    def run(batches):
        known: Examples = shared.value
        for batch in batches:
            ids = batch.column("id").to_pylist()
            queries = known.index.vectors(ids[0], ids[-1] + 1) if ids else []
            out = []
            for i, (near, sims) in zip(ids, known.index.nearest_of(queries, known.k), strict=True):
                for label, n in ((1, known.toxic[i]), (0, known.rows[i] - known.toxic[i])):
                    if n:
                        out.append((i, label, float(n * known.stands[i]), known.share(near, sims, i, label)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            types = (pa.int64(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "label", "rows", "share"])

    return tidy(run)


def _logit(p: float) -> float:
    p = min(1 - 1e-4, max(1e-4, p))
    return math.log(p / (1 - p))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, examples: int, example_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id (the smallest), text, how many labelled training rows (n) and rows of label 1 (n1) have the text, and how many
    rows each of them stands for, for a bounded number of distinct texts.  Texts meet by their SHA-256; only those picked
    are read whole."""
    picked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    picked = picked.where(fold() != 0).groupBy("doc_id").agg(F.min("label").alias("label"))
    texts = id_and_text(docs, id_col, text_col).withColumn("digest", F.sha2("text", 256))
    rows = texts.select("doc_id", "digest", F.length("text").alias("size")).join(picked, "doc_id").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("label").alias("n"), F.sum("label").cast("long").alias("n1"), F.max("size").alias("size"))
    rows = rows.withColumn("kind", F.col("n1") * 2 >= F.col("n"))
    of_kind = {r.kind: r for r in rows.groupBy("kind").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("rows")).collect()}
    least = min((r.texts for r in of_kind.values()), default=0) if len(of_kind) > 1 else 0
    most = {k: max(examples // 2, examples - least) if r.texts > examples // 2 else r.texts for k, r in of_kind.items()}
    order = Window.partitionBy("kind").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    kept = None
    for kind, r in of_kind.items():
        some = rows.where(F.col("kind") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[kind])
        some = some.withColumn("before", F.sum("size").over(order)).where((F.col("before") <= example_bytes // 2) | (F.col("before") == F.col("size")))
        some = some.withColumn("stands", F.lit(float(r.rows)) / F.sum("n").over(Window.partitionBy("kind")))
        kept = some if kept is None else kept.union(some)
    if kept is None:
        kept = rows.withColumn("stands", F.lit(1.0)).limit(0)
    kept = F.broadcast(kept.select("doc_id", "digest", "n", "n1", "stands"))
    return texts.join(kept, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).select("doc_id", "text", "n", "n1", "stands")


def _vectors(batches):
    """Each example's words and counts."""
    for batch, texts in _pieces(batches):
        kinds, text, word, counts = term_counts(texts)
        edges = np.searchsorted(text, np.arange(len(texts) + 1))
        words = [kinds[word[a:b]].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        sizes = [counts[a:b].astype(np.int32).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n", "n1", "stands")), pa.array(words, pa.binary()), pa.array(sizes, pa.binary())], ["doc_id", "n", "n1", "stands", "words", "counts"])


def strengths(rows: list[tuple], vocabulary: np.ndarray) -> np.ndarray:
    """How strongly each word speaks for label 1: the root of the log-likelihood ratio of how many examples of the two
    classes hold it, 0 if it doesn't.  An example with both labels counts in part for each."""
    k0, k1, n0, n1 = np.zeros(len(vocabulary)), np.zeros(len(vocabulary)), 0.0, 0.0
    for _, n, toxic, _, places, _ in rows:
        k0[places] += 1 - toxic / n
        k1[places] += toxic / n
        n0, n1 = n0 + 1 - toxic / n, n1 + toxic / n
    if not n0 or not n1:
        return np.zeros(len(vocabulary))
    return np.where(k1 / n1 > k0 / n0, np.sqrt(np.maximum(_likelihood_ratio(k0, k1, n0, n1), 0)), 0)


def _likelihood_ratio(k0: np.ndarray, k1: np.ndarray, n0: float, n1: float) -> np.ndarray:
    """Twice the log-likelihood ratio of two binomials against one."""
    p = (k0 + k1) / (n0 + n1)
    part = lambda k, expected: k * np.log(np.maximum(k, 1e-9) / np.maximum(expected, 1e-9))
    return 2 * (part(k0, p * n0) + part(n0 - k0, (1 - p) * n0) + part(k1, p * n1) + part(n1 - k1, (1 - p) * n1))


def _document_frequencies(shared):
    def run(batches):
        vocabulary = shared.value
        df, n = np.zeros(len(vocabulary), np.int64), 0
        for _, texts in _pieces(batches):
            kinds, _, word, _ = term_counts(texts)
            place = _find(vocabulary, kinds)
            df[place[place >= 0]] += np.bincount(word, minlength=len(kinds))[place >= 0]
            n += len(texts)
        held = np.flatnonzero(df)
        for at in range(0, len(held), 100_000):
            some = held[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(df[some])], ["term", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([n], pa.int64())], ["term", "n"])

    return tidy(run)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", examples: int = 8_000, example_bytes: int = 40_000_000, k: int = 25, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from labelled rows whose fold isn't 0, with document frequencies over all of ``docs``."""
    spark = docs.sparkSession
    sample = training_sample(docs, labels, label, examples, example_bytes, id_col, text_col)
    made = sample.mapInArrow(_vectors, "doc_id long, n long, n1 long, stands double, words binary, counts binary").toArrow()
    words = [np.frombuffer(w.as_py(), np.uint64) for w in made.column("words")]
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]))
    counts = [np.frombuffer(c.as_py(), np.int32) for c in made.column("counts")]
    rows = list(zip(*(made.column(c).to_pylist() for c in ("doc_id", "n", "n1", "stands")), [np.searchsorted(vocabulary, w).astype(np.int32) for w in words], counts, strict=True))
    del made, words
    shared = spark.sparkContext.broadcast(vocabulary)
    frequency = id_and_text(docs, id_col, text_col).select("text").mapInArrow(_document_frequencies(shared), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    term, n = np.array(frequency.column("term")), np.array(frequency.column("n"))
    df, total = np.zeros(len(vocabulary)), int(n[term < 0].sum())
    df[term[term >= 0]] = n[term >= 0]
    idf = np.log((total + 1) / (df + 1)) + 1
    unknown = math.log((total + 1) / 2) + 1
    del frequency, term, n, df
    trim_driver(spark)
    known = Examples(vocabulary, idf * (1 + strengths(rows, vocabulary)), unknown, rows, k)
    del rows, counts, vocabulary, idf
    trim()
    return Model(spark, known)


def _score(scorer):
    def run(batches):
        for batch, texts in _pieces(batches):
            out = scorer(texts)
            evidence = [[{"doc_id": i, "similarity": x, "share": y} for i, x, y in e] for _, e in out]
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s for s, _ in out], pa.float64()), pa.array(evidence, kind)], ["doc_id", "score", "evidence"])

    return tidy(run)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, evidence."""
    scored = id_and_text(docs, id_col, text_col).mapInArrow(_score(model.scorer()), "doc_id long, score double, evidence array<struct<doc_id: long, similarity: double, share: double>>")
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def filter_rows(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``.  Only texts go to workers, only scores come back."""
    scorer = model.scorer()

    @F.arrow_udf("double")
    def score_of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            yield pa.array([s for _, texts in _pieces([batch]) for s, _ in scorer(texts)], pa.float64())
            trim()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.where(score_of(text) < threshold)
