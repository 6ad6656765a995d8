"""Quality classifier from weak labels.

Overlapping heuristic labellers vote low, good or nothing on each text.  Expectation-maximisation (Dawid and Skene, 1979)
estimates from the votes alone how each labeller votes on good and on low texts; it works on the histogram of vote
patterns of all documents, whose size is bounded by 3 ** labellers.  The posterior of its pattern is a text's soft label.
Soft labels of at most ``sample`` texts and ``sample_bytes`` of text (those of smallest id hash; both are parameters) train
a logistic scorer over hashed features: words, word shapes and binned measures.  Both classes weigh the same in training;
the log-odds of the classes in the sample are added to the score afterwards, so that a text which says little, such as a
very short one, is judged by how common good texts are.  Every document is scored, by the scorer alone.

Defined cases: null and empty texts have no features but their emptiness and are voted low; repeated rows each count and
each give a row; texts of any length are scored whole; rows without a doc_id are scored and counted for the labellers, but
not sampled; without documents nothing is fitted and there is no row; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlens.llm.common import id_and_text, parts, tidy
from twinlens.llm.quality_rules import STOP_WORDS

LOW, GOOD, NONE = 0, 1, 2
_STOP = frozenset(w.encode() for w in STOP_WORDS)
_SYMBOLS, _CAPITALS = b"#*$%&|<>", bytes(range(65, 91))
_SHAPE = (re.compile(rb"[\x80-\xff]+|[a-z]+"), re.compile(rb"[A-Z]+"), re.compile(rb"[0-9]+"))


def measures(data: bytes, words: list[bytes]) -> dict[str, float]:
    """What the labellers look at."""
    n = max(1, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = max(1, sum(map(len, words)))
    counts = Counter(words)
    return {
        "words": len(words),
        "symbols": (len(data) - len(data.translate(None, _SYMBOLS))) / n,
        "stop": sum(counts[w] for w in counts if w.lower() in _STOP) / n,
        "distinct": len(counts) / n ** 0.9,
        "capitals": (len(data) - len(data.translate(None, _CAPITALS))) / letters,
        "length": letters / n,
        "stutter": sum(map(bytes.__eq__, words, words[1:])) / n,
        "repeated_lines": 1 - len(set(lines)) / max(1, len(lines)),
        "most": max(counts.values(), default=0) / n if len(words) >= 20 else 0.1,
    }


def _vote(low: bool, good: bool) -> int:
    return LOW if low else GOOD if good else NONE


#: Labellers: name and vote on the measures.
LABELLERS = (
    ("empty", lambda m: _vote(m["words"] == 0, m["words"] >= 1)),
    ("symbols", lambda m: _vote(m["words"] >= 10 and m["symbols"] > 0.1, m["symbols"] < 0.01)),
    ("stop_words", lambda m: _vote(m["words"] >= 20 and m["stop"] < 0.06, m["stop"] > 0.15)),
    ("distinct", lambda m: _vote(m["words"] >= 20 and m["distinct"] < 0.5, m["distinct"] > 0.9)),
    ("capitals", lambda m: _vote(m["words"] >= 10 and m["capitals"] > 0.3, m["capitals"] < 0.1)),
    ("word_length", lambda m: _vote(m["words"] >= 10 and not 2.5 <= m["length"] <= 9, 4 <= m["length"] <= 7)),
    ("stutter", lambda m: _vote(m["words"] >= 10 and m["stutter"] > 0.15, m["stutter"] < 0.03)),
    ("lines", lambda m: _vote(m["repeated_lines"] > 0.5, False)),
)


def pattern(m: dict[str, float]) -> int:
    """All votes as one number in base 3."""
    code = 0
    for _, vote in LABELLERS:
        code = 3 * code + vote(m)
    return code


def votes_of(code: int) -> list[int]:
    return [code // 3 ** (len(LABELLERS) - 1 - k) % 3 for k in range(len(LABELLERS))]


def estimate(histogram: dict[int, int], rounds: int = 200) -> tuple[dict[int, float], np.ndarray, float]:
    """Posterior of good for each pattern, vote distributions (labeller, class, vote) and the share of good texts.

    To abstain is a third vote: labellers that only ever say one thing tell the classes apart by when they say nothing.
    """
    codes = sorted(histogram)
    votes = np.array([votes_of(c) for c in codes]).reshape(len(codes), len(LABELLERS))
    weight = np.array([histogram[c] for c in codes], float)
    hot = (votes[:, :, None] == np.arange(3)).astype(float)
    table = np.tile(np.array([[0.35, 0.15, 0.5], [0.1, 0.5, 0.4]]), (len(LABELLERS), 1, 1))  # better than chance
    share, post = 0.8, np.zeros(len(codes))
    for _ in range(rounds if len(codes) else 0):
        scores = np.einsum("pkv,kcv->pc", hot, np.log(table)) + np.log([1 - share, share])
        new = 1 / (1 + np.exp(np.clip(scores[:, 0] - scores[:, 1], -500, 500)))
        # counts to start from keep every probability above 0 and a labeller from changing sides
        for c, p in ((0, 1 - new), (1, new)):
            counts = np.einsum("p,pkv->kv", weight * p, hot) + 2 * np.array([0.35, 0.15, 0.5] if c == 0 else [0.1, 0.5, 0.4])
            table[:, c] = counts / counts.sum(1, keepdims=True)
        share = float(((weight * new).sum() + 4) / (weight.sum() + 5))
        done, post = np.abs(new - post).max() < 1e-9, new
        if done:
            break
    return dict(zip(codes, post.tolist(), strict=True)), table, share


class Features:
    """Hashed features of a text as sorted places and unit-length values."""

    def __init__(self, bits: int):
        self.mask, self.seen = (1 << bits) - 1, {}

    def _of(self, word: bytes) -> tuple[int, int]:
        got = self.seen.get(word)
        if got is None:
            shape = _SHAPE[2].sub(b"0", _SHAPE[1].sub(b"A", _SHAPE[0].sub(b"a", word)))[:12]
            got = (zlib.crc32(b"w" + word.lower()) & self.mask, zlib.crc32(b"s" + shape) & self.mask)
            if len(self.seen) < 200_000 and len(word) <= 64:
                self.seen[word] = got
        return got

    def vector(self, words: list[bytes], m: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        sums: dict[int, float] = {}
        for word, n in Counter(words).items():
            for place in self._of(word):
                sums[place] = sums.get(place, 0.0) + n
        norm = math.sqrt(sum(x * x for x in sums.values())) or 1.0
        out = {k: x / norm for k, x in sums.items()}
        for name, value in m.items():
            step = min(12, int(4 * math.log2(1 + 4 * value)) if name != "words" else int(math.log2(1 + value)))
            place = zlib.crc32(f"m{name}{step}".encode()) & self.mask
            out[place] = out.get(place, 0.0) + 0.5
        keys = sorted(out)
        return np.array(keys, np.int32), np.array([out[k] for k in keys])


def _patterns(batches):
    counts: Counter = Counter()
    for batch in (p for b in batches for p in parts(b)):
        for data in batch.column("text").to_pylist():
            counts[pattern(measures(data, data.split()))] += 1
    yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int32()), pa.array(counts.values(), pa.int64())], ["pattern", "n"])


def _sampled(bits: int):
    def run(batches):
        features = Features(bits)
        for batch in (p for b in batches for p in parts(b)):
            out = []
            for data in batch.column("text").to_pylist():
                words = data.split()
                m = measures(data, words)
                out.append((pattern(m), *features.vector(words, m)))
            columns = [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.list_(pa.int32())), pa.array([o[2] for o in out], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["pattern", "places", "values"])

    return tidy(run)


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, bits: int, rounds: int = 200, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets, classes balanced, by Adagrad over the whole sample; then the classes' log-odds."""
    weight, shift = np.zeros(1 << bits), 0.0
    if not rows:
        return weight, shift
    place, value = np.concatenate([p for p, _ in rows]), np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), [len(p) for p, _ in rows])
    seen, seen_shift = np.full(1 << bits, 1e-8), 1e-8
    balance = np.where(target >= 0.5, 0.5 / max(1, (target >= 0.5).sum()), 0.5 / max(1, (target < 0.5).sum())) * len(rows)
    for _ in range(rounds):
        z = np.bincount(row, weight[place] * value, len(rows)) + shift
        error = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        gradient = np.bincount(place, error[row] * value, 1 << bits) + decay * weight
        seen += gradient * gradient
        weight -= 0.5 * gradient / np.sqrt(seen)
        seen_shift += error.sum() ** 2
        shift -= 0.5 * error.sum() / math.sqrt(seen_shift)
    good = int((target >= 0.5).sum())
    return weight, shift + (math.log(good / (len(rows) - good)) if 0 < good < len(rows) else 0.0)


class Model:
    def __init__(self, posterior: dict[int, float], table: np.ndarray, share: float, weight: np.ndarray, shift: float, bits: int):
        self.posterior, self.table, self.share, self.weight, self.shift, self.bits = posterior, table, share, weight, shift, bits

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """Per labeller: chance of a right vote on a low and on a good text, given that it votes."""
        return {name: (float(t[0, LOW] / (t[0, LOW] + t[0, GOOD])), float(t[1, GOOD] / (t[1, LOW] + t[1, GOOD]))) for (name, _), t in zip(LABELLERS, self.table, strict=True)}


def fit(docs: DataFrame, sample: int = 8_000, sample_bytes: int = 64_000_000, bits: int = 16, id_col: str = "doc_id", text_col: str = "text") -> Model:
    texts = id_and_text(docs, id_col, text_col)
    histogram = {r.pattern: r.n for r in texts.select("text").mapInArrow(_patterns, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    posterior, table, share = estimate(histogram)
    sizes = texts.where("doc_id is not null").groupBy("doc_id").agg(F.sum(F.length("text")).alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    before = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    ids = sizes.withColumn("before", before).where((F.col("before") <= sample_bytes) | (F.col("before") == F.col("size"))).select("doc_id")
    picked = texts.join(F.broadcast(ids), "doc_id", "left_semi").select("text").mapInArrow(_sampled(bits), "pattern int, places array<int>, values array<double>").toArrow()
    rows = [(np.asarray(p, np.int32), np.asarray(v)) for p, v in zip(picked.column("places").to_pylist(), picked.column("values").to_pylist(), strict=True)]
    target = np.array([posterior.get(c, 0.5) for c in picked.column("pattern").to_pylist()])
    return Model(posterior, table, share, *train(rows, target, bits), bits)


def _score(shared):
    def run(batches):
        model: Model = shared.value
        features = Features(model.bits)
        for batch in (p for b in batches for p in parts(b)):
            n, weak, scores = [], [], []
            for data in batch.column("text").to_pylist():
                words = data.split()
                m = measures(data, words)
                places, values = features.vector(words, m)
                n.append(len(words))
                weak.append(model.posterior.get(pattern(m), model.share))
                z = float(model.weight[places] @ values) + model.shift
                judged = 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))
                scores.append(judged)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(weak, pa.float64()), pa.array(scores, pa.float64())], ["doc_id", "n_words", "weak_label", "score"])

    return tidy(run)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, weak_label (posterior of good), score, predicted (1: good), kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = id_and_text(docs, id_col, text_col).mapInArrow(_score(shared), "doc_id long, n_words long, weak_label double, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("kept", F.col("score") >= 0.5)
