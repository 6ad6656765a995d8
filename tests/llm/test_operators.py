"""Every operator against a plain second implementation, on a corpus with nulls, empties, copies and long texts."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import corpus
from twinlens.llm import bpe, decontamination, hashing, kneser_ney, license_scan, near_dedup, quality_classifier, quality_rules, substring_dedup, token_counts, toxicity
from twinlens.llm import common
from twinlens.llm.common import ALNUM_WORD, SPACE_WORD, alnum_words, cut_spans
from twinlens.llm.fm_index import FmIndex, suffix_array
from twinlens.llm.queries import tokenizer
from twinlens.llm.shards import HashArrays

ROWS = corpus.documents()
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    """The corpus over several partitions, with columns whose names clash with what operators use inside."""
    frame = spark.createDataFrame(ROWS, SCHEMA)
    return frame.select("*", *(F.lit(1).alias(c) for c in ("row", "n", "piece", "starts", "bucket", "digest", "score", "words"))).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, repr(r[1:])))


def data(t):
    return (t or "").encode()


def test_token_counts(spark, docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    want = [(i, len(data(t)), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in ROWS]
    assert key(token_counts.count_tokens(docs, path, head_size=50).collect()) == key(want)
    assert token_counts.count_tokens(empty, path).count() == 0
    odd = " a  b \n c\td\r\n e 　f g'll <|endoftext|> \n\n"
    split = token_counts.pre_tokenizer(path)
    parts = [p for r in token_counts.runs(odd.encode()) for p in token_counts.split_run(r, split)]
    assert b"".join(parts).decode() == odd
    han = "日本語の文章。句読点で、分かれる！１２３ и слова".encode()
    assert len([p for r in token_counts.runs(han) for p in token_counts.split_run(r, split)]) >= 8
    long = "=" * 90 + " " + "字" * 70
    rows = [(1, long), (1, long), (2, long + " end"), (None, long), (None, long)]
    want = [(i, len(t.encode()), n := len(tok.encode(t, add_special_tokens=False).ids), n > 512) for i, t in rows]
    for size in (0, 2, 50):
        assert key(token_counts.count_tokens(spark.createDataFrame(rows, SCHEMA).repartition(3), path, head_size=size).collect()) == key(want)


def test_bpe(spark, docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [tok.encode(t or "", add_special_tokens=False).ids for _, t in ROWS]
    want = [(i, len(x), sha(" ".join(map(str, x))), sha(tok.decode(x, skip_special_tokens=False))) for (i, _), x in zip(ROWS, ids, strict=True)]
    assert key(bpe.round_trip_digests(docs, path).collect()) == key(want)
    got = bpe.encode(docs.where("doc_id = 607"), path).first()
    assert got.ids == ids[[i for i, _ in ROWS].index(607)] and got.decoded == tok.decode(got.ids, skip_special_tokens=False)
    assert bpe.encode(empty, path).count() == 0
    own = bpe.WordBpe(path)
    latin = [chr(c) for c in range(0x21, 0x180)] + ["".join(random.Random(k).choices("abcst'DS1!éÀ½ß", k=8)) for k in range(3000)]
    assert own._prepared(latin) == [own._parts(r) for r in latin]


def test_segment_trees_take_the_leftmost_lowest_pair():
    rng = random.Random(1)
    pairs = bpe.PairRanks([(a, b, 10 + 10 * a + b) for a, b in rng.sample(list(itertools.product(range(7), repeat=2)), 25)])

    def plain(ids):
        ids = list(ids)
        while True:
            found = [(pairs.table[ids[i] << 32 | ids[i + 1]][0], i) for i in range(len(ids) - 1) if (ids[i] << 32 | ids[i + 1]) in pairs.table]
            if not found:
                return ids
            _, i = min(found)
            ids[i : i + 2] = [pairs.table[ids[i] << 32 | ids[i + 1]][1]]

    words = [[rng.randint(0, 6) for _ in range(rng.randint(1, 40))] for _ in range(300)]
    assert bpe.merge_forest(words, pairs) == [plain(w) for w in words] == [bpe.merge_one(w, pairs) for w in words]


def test_license_scan(spark, docs, empty):
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    for i, t in ROWS:
        w = alnum_words(data(t))
        places = sorted((k, label) for label, p in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == [x.encode() for x in p.split()])
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        best = 0.0
        for label, x in license_scan.TEMPLATES:
            m, half = {y.encode() for y in x.split()}, max(32, 1 << (len(x.split()) - 1).bit_length())
            for b in range(0, len(w), half):
                share = len(m & set(w[b : b + 2 * half])) / len(m)
                if share >= 0.8:
                    best = max(best, share)
                    assert label in r.labels.split(",")
        assert r.score == pytest.approx(1.0 if places else best)
    assert got[502].labels == "gpl-3" and got[600].score == 0
    assert license_scan.license_scan(empty).count() == 0


def test_decontamination(spark, docs, empty):
    items = list(enumerate(corpus.BENCHMARK)) + [(10, corpus.BENCHMARK[0]), (None, "same same same same same same same same same same same")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = alnum_words(data(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].update([str(i)] if i is not None else [])
    want = []
    for i, t in ROWS:
        w, hit, found = alnum_words(data(t)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert sum(x[-1] for x in want) == 4
    assert key(decontamination.contamination(docs, bench).collect()) == key(want)
    assert key(decontamination.contamination(docs, bench, block_bytes=40).collect()) == key(want)
    assert decontamination.contamination(empty, bench).count() == 0
    assert not decontamination.contamination(docs, bench.limit(0)).where("contaminated").count()


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination_cuts_each_row_for_itself(spark, block_bytes):
    """Rows that share an id, and rows without one; the benchmark in one block and in several."""
    passage = corpus.BENCHMARK[0]
    clean = "one two three four five six seven eight nine ten eleven twelve " * 2
    rows = [(7, f"before {passage} after"), (7, clean), (None, f"nobody {passage}"), (8, passage), (9, None), (10, "")]
    bench = spark.createDataFrame([*enumerate(corpus.BENCHMARK), (50, "one two other words " * 9)], "item_id long, text string")
    frame = spark.createDataFrame([(*r, 5, 1) for r in rows], "doc_id long, text string, n_words long, spans long").repartition(2)
    got = decontamination.cut_rows(frame, bench, frame.columns, block_bytes=block_bytes)
    assert got.columns == frame.columns
    assert sorted(((r.doc_id or 0, r.text or "") for r in got.collect())) == sorted([(0, "nobody"), (7, "before after"), (7, clean), (9, ""), (10, "")])


def test_decontamination_in_many_shards_and_slices(monkeypatch, tmp_path):
    """The tasks' functions themselves, with limits so small that every text is a shard and every few windows a slice."""
    monkeypatch.setattr(decontamination, "SHARD", 3)
    monkeypatch.setattr(decontamination, "SLICE", 4)
    monkeypatch.setattr(decontamination, "PAIRS", 2)
    monkeypatch.setattr(common.parts, "__defaults__", ("text", 1, 1_000_000))
    folder, items = f"file://{tmp_path}", ["a b c d e f g", "c d e", "x y", "a b c d e f g"]
    texts = ["z a b c d e q c d e", "x y x y", "b c d e f g", "nothing at all", "c d e"]
    item_rows = pa.RecordBatch.from_pydict({"item": [str(k) for k in range(len(items))], "text": [data(x) for x in items]})
    found = [np.asarray(b.column("word")) for b in decontamination._words(iter([item_rows]))]
    list(decontamination._save_words(folder)(iter([pa.RecordBatch.from_pydict({"word": np.unique(np.concatenate(found))})])))
    slices = pa.Table.from_batches(list(decontamination._save_block(folder, 4)((pa.scalar(0),), iter([item_rows]))))
    windows = decontamination.Windows(folder, slices.column("name").to_pylist(), min(slices.column("shortest").to_pylist()), 4)
    assert len(windows.slices) >= 2

    class Shared:
        value = windows

    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": [data(t) for t in texts]})
    got = pa.Table.from_batches(list(decontamination._search(Shared)(iter([rows]))))
    assert [[(x["start"], x["end"]) for x in r] for r in got.column("spans").to_pylist()] == [[(1, 6), (7, 10)], [(0, 4)], [(0, 6)], [], [(0, 3)]]
    assert got.column("items").to_pylist() == [["0", "1", "3"], ["2"], ["0", "1", "3"], [], ["1"]]


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 4, 400)
    text[50:90] = text[150:190]
    text[-1] = 0
    separators = text == 0
    distinct = text + separators.sum()
    distinct[separators] = np.arange(separators.sum())
    assert suffix_array(distinct).tolist() == sorted(range(400), key=lambda i: distinct[i:].tolist())
    index = FmIndex(text, 3)
    for n in range(1, 8):
        patterns = rng.integers(1, 4, (40, n))
        low, high = index.search(patterns, np.full(40, n))
        for p, a, b in zip(patterns.tolist(), low, high, strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(400) if text[i : i + n].tolist() == p]


def test_substring_dedup(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 20_000)
    first = {}
    for i, t in ROWS:
        w = data(t).split()
        for k in range(len(w) - 19 if i is not None else 0):
            first[x] = min(first.get(x := tuple(w[k : k + 20]), (i, k)), (i, k))
    want, texts = [], {}
    for i, t in ROWS:
        w, gone = data(t).split(), set()
        for k in range(len(w) - 19 if i is not None else 0):
            if first[tuple(w[k : k + 20])] < (i, k):
                gone.update(range(k, k + 20))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
        if not gone or len(gone) < len(w):
            texts[i] = kept.split()
    assert sum(x[2] > 0 for x in want) >= 12
    assert key(substring_dedup.removal_digests(docs).collect()) == key(want)
    cut = {r.doc_id: data(r.text).split() for r in substring_dedup.cut_rows(docs, ["text", "doc_id"]).collect()}
    assert cut == texts
    assert substring_dedup.removal_digests(empty).count() == 0


def test_rolling_hashes():
    rng = np.random.default_rng(2)
    w = rng.integers(0, 2**64, 60, dtype=np.uint64)
    for n in (1, 2, 5, 20, 60):
        plain = [sum(int(x) * pow(hashing.WINDOW_POINT, j, hashing.PRIME) for j, x in enumerate(w[i : i + n])) % hashing.PRIME for i in range(61 - n)]
        assert hashing.rolling(w, n).tolist() == hashing.mix(np.array(plain, np.uint64)).tolist()
        assert len(hashing.checks(w, n)) == 61 - n


def _thue_morse(doublings):
    a = b"a"
    for _ in range(doublings):
        a += bytes(195 - x for x in a)
    return a, bytes(195 - x for x in a)


def test_words_that_agree_modulo_powers_of_two_differ(spark, monkeypatch):
    for doublings in (10, 11, 12):
        a, b = _thue_morse(doublings)
        x, y = (int(hashing.word_hashes([t])[0][0]) for t in (a, b))
        total = sum((c + 1) * pow(hashing.WORD_POINT, k, hashing.PRIME) for k, c in enumerate(a)) % hashing.PRIME
        assert x != y and x == int(hashing.mix(np.array([total], np.uint64))[0])
        with monkeypatch.context() as m:
            m.setattr(hashing, "_LONGEST", 700)
            assert x == int(hashing.word_hashes([a])[0][0])
    tail = " ".join(f"w{k}" for k in range(19))
    docs = spark.createDataFrame([(k, f"{t.decode()} {tail}") for k, t in enumerate(_thue_morse(11))], SCHEMA)
    assert [r.n_removed for r in substring_dedup.removal_digests(docs).orderBy("doc_id").collect()] == [0, 0]


def _linked(sets):
    """Smallest id of each id's component, by all pairs."""
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in sets}


def _shingles(t, width):
    w = data(t).lower().split()
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


@pytest.mark.parametrize("rounds, task_bytes", [(near_dedup.ROUNDS, near_dedup.TASK_BYTES), (1, 900)])
def test_near_dedup(spark, docs, empty, monkeypatch, rounds, task_bytes):
    monkeypatch.setattr(near_dedup, "TASK_BYTES", task_bytes)
    monkeypatch.setattr(near_dedup, "ROUNDS", rounds)
    sets = {i: _shingles(t, 4) for i, t in ROWS}
    root = _linked({i: x for i, x in sets.items() if i is not None})
    want = [(i, len(sets[i]), None if i is None else root[i], i is None or root[i] == i) for i, _ in ROWS]
    assert sum(not r[3] for r in want) >= 10
    assert key(near_dedup.near_duplicates(docs, width=4).collect()) == key(want)
    if rounds > 1:
        assert near_dedup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("rounds, task_bytes", [(near_dedup.ROUNDS, near_dedup.TASK_BYTES), (1, 3000)])
def test_near_dedup_of_clusters_around_the_threshold(spark, monkeypatch, rounds, task_bytes):
    """Variants of some texts, many just above or below the threshold: recall against all pairs, and no false link."""
    monkeypatch.setattr(near_dedup, "TASK_BYTES", task_bytes)
    monkeypatch.setattr(near_dedup, "ROUNDS", rounds)
    rng = random.Random(8)
    rows = []
    for _ in range(12):
        base = corpus.words(rng, rng.choice([60, 120, 250]))
        for _ in range(25):
            copy = list(base)
            for k in rng.sample(range(len(copy)), rng.randint(0, len(copy) // 16)):
                copy[k] = "".join(rng.choices("abcdef", k=6))
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    root = _linked({i: _shingles(t, 5) for i, t in rows})
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert sum(got[i] == root[i] for i in root) >= 0.99 * len(root)
    assert all(root[got[i]] == root[i] for i in root)


def test_near_dedup_takes_rows_of_one_id_as_one_node(spark):
    rng = random.Random(5)
    a, b, c = (corpus.text(rng, 60) for _ in range(3))
    rows = [(7, a), (7, b), (5, b + " tail"), (6, a + " tail"), (8, c), (9, c)]
    for order in (rows, rows[::-1]):
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(order, SCHEMA).repartition(3)).collect()}
        assert got == {5: 5, 6: 5, 7: 5, 8: 8, 9: 8}


def test_sketches_agree_where_minhashes_do(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64, (40, 32), dtype=np.uint64)
    b = np.where(rng.random((40, 32)) < 0.5, a, a + np.uint64(1))
    names = near_dedup._lane_names(32)
    rows = [[tuple(int(x[k]) for x in near_dedup._lanes(m)) for m in (a, b)] for k in range(40)]
    lanes = ", ".join(f"{n}: long" for n in names)
    got = spark.createDataFrame(rows, f"u struct<{lanes}>, v struct<{lanes}>").select(near_dedup._agreeing(names, 32).alias("n")).collect()
    assert [r.n for r in got] == (a == b).sum(1).tolist()
    assert near_dedup.least_agreeing(32, 0.8) == 13


def test_quality_rules(spark, docs, empty):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in ROWS:
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {p for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert "symbols" in got[603].failed and not got[604].kept and quality_rules.quality_rules(empty).count() == 0
    plan = quality_rules.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney(spark, docs, empty, monkeypatch, order):
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 30_000)
    tokens = [(i, [*data(t).lower().split(), "</s>"]) for i, t in ROWS]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    train = [w for i, w in tokens if i is not None and not held(i)]
    tri = Counter(p for w in train for p in zip(["<s>", "<s>", *w], ["<s>", *w], w))
    uni = Counter(x for w in train for x in w)
    n, v = sum(uni.values()), len(uni)
    big, under = Counter(), Counter()
    for (a, b, c), k in tri.items():
        big[b, c] += k if a == b == "<s>" or order == 2 else 1
    for a, b in big:
        under[b] += 1
    context, kinds = Counter(), defaultdict(list)
    for (a, b, c), k in tri.items():
        context[a, b] += k
        kinds[a, b].append(k)
    for (a, b), k in big.items():
        context[a] += k
        kinds[a].append(k)
    d3, d2, d1 = (kneser_ney._discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]) for c in (tri, big, under))
    total = sum(under.values())
    rest = sum(d1[min(c, 3)] for c in under.values()) / total

    def level(d, count, ctx, below):
        if ctx not in context:
            return below
        return max(count - d[min(count, 3)], 0) / context[ctx] + sum(d[min(c, 3)] for c in kinds[ctx]) / context[ctx] * below

    def p(a, b, c):
        below = max(under[c] - d1[min(under[c], 3)], 0) / total + rest / (v + 1)
        below = level(d2, big[b, c], b, below)
        return level(d3, tri[a, b, c], (a, b), below) if order == 3 else below

    model = kneser_ney.fit(docs, order=order)
    assert model.bits >= 2
    scored = kneser_ney.score(docs, model)
    got = defaultdict(list)
    for r in scored.collect():
        got[r.doc_id].append(r)
    for i, w in tokens:
        r = got[i].pop()
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(uni[x] > 0 for x in w), n, held(i))
        assert r.base_score == pytest.approx(sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r.score == pytest.approx(sum(math.log10(p(a, b, c)) for a, b, c in zip(["<s>", "<s>", *w], ["<s>", *w], w)), rel=1e-9)
    some = max((c for c in context if isinstance(c, tuple)), key=context.get)
    unknown = p(*some, None)
    assert sum(p(*some, b) for b in uni) + unknown == pytest.approx(1)
    texts = [data(t) for _, t in ROWS]
    whole = model.score(texts)
    apart = [model.score([t]) for t in texts]
    assert [x[3][0] for x in apart] == pytest.approx(whole[3].tolist())
    nothing = kneser_ney.score(docs.limit(3), kneser_ney.fit(empty)).collect()
    assert all(r.score == 0 for r in nothing) and kneser_ney.score(empty, model).count() == 0


def test_kneser_ney_in_several_blocks(spark, docs, monkeypatch):
    """Blocks of a task add up: the counting function itself, with blocks of a few texts."""
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(len(ROWS))), "text": [data(t) for _, t in ROWS]})
    sums = []
    for size in (kneser_ney.BLOCK_BYTES, 20_000):
        monkeypatch.setattr(kneser_ney, "BLOCK_BYTES", size)
        monkeypatch.setattr(common.parts, "__defaults__", ("text", 5, 1_000_000))
        sent = [b for b in kneser_ney._count(0, 3)(iter([rows])) if b.column("kind")[0].as_py() == "trigram"]
        (a, b, c), (n,) = kneser_ney._received(sent, 3, 1)
        keys, (n,), _ = kneser_ney._added(kneser_ney.joined(kneser_ney.joined(a, b), c), [n], [])
        sums.append((len(sent), keys.tolist(), n.tolist()))
    assert sums[0][0] == 1 < sums[1][0] and sums[0][1:] == sums[1][1:]


def test_hash_arrays(tmp_path):
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    count = rng.integers(1, 400, len(keys)).astype(np.uint64)
    arrays = HashArrays(f"file://{tmp_path}", "x", 2, {"count": "u1"})
    shard = keys >> np.uint64(62)
    for s in (0, 1, 3):
        arrays.save(s, keys[shard == s], {"count": count[shard == s]})
    asked = np.sort(np.r_[keys[::3], rng.integers(0, 2**64, 500, dtype=np.uint64)])
    want = dict(zip(keys.tolist(), count.tolist()))
    found, got = arrays.find(asked, frozenset({0, 1, 3}))
    assert got["count"].tolist() == [want.get(k, 0) if k >> 62 != 2 else 0 for k in asked.tolist()]
    assert found.tolist() == [k in want and k >> 62 != 2 for k in asked.tolist()]


def _toxic_corpus(seed=9, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = corpus.words(rng, rng.choice([10, 40, 120]))
        bad = i % 8 == 0
        for k in range(rng.randint(2, 6) if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(["zornig", "zorn" + corpus.words(rng, 1)[0]])
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity(spark, empty):
    rows = _toxic_corpus()
    docs = spark.createDataFrame([r[:2] for r in rows] + [(9001, None), (9002, ""), (None, "zornig zornig")], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert sum(got[i].predicted == y for i, _, y in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[9001].score == got[9002].score < 0.5 and got[None].predicted == 1
    kept = {r.doc_id for r in toxicity.filter_rows(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r.predicted == 0}
    assert toxicity.score(empty, model).count() == 0
    blank = toxicity.fit(docs, labels.limit(0))
    assert all(r.score == pytest.approx(1e-4) for r in toxicity.score(docs, blank).collect()) and toxicity.filter_rows(docs, blank).count() == docs.count()


def test_block_max_index_is_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "HEAD", 8)
    rng = np.random.default_rng(6)
    vectors = []
    for _ in range(700):
        t = np.sort(rng.choice(60, rng.integers(1, 7), replace=False, p=np.arange(60, 0, -1) / 1830))
        v = rng.random(len(t)) ** 3 + 0.01
        vectors.append((t, v / np.linalg.norm(v)))
    index = toxicity.BlockMaxIndex(vectors, 60)
    dense = np.zeros((700, 60))
    for i, (t, v) in enumerate(vectors):
        dense[i, t] = v
    for k in (1, 10, 90):
        for i, (near, sims) in enumerate(index.nearest_of(vectors[:80], k)):
            exact = dense @ dense[i]
            want = np.sort(exact[exact > 0])[::-1][:k]
            assert sims == pytest.approx(want, abs=1e-6) and exact[near] == pytest.approx(sims, abs=1e-6)
    back = index.vectors(100, 140)
    for (t, v), (x, y) in zip(vectors[100:140], back, strict=True):
        assert x.tolist() == t.tolist() and y == pytest.approx(v, abs=1e-6)


def test_quality_classifier(spark, docs, empty):
    rng = random.Random(4)
    good = [(i, " ".join(rng.choice(["the", "of", "and", "to", *corpus.words(rng, 4)]) for _ in range(rng.choice([30, 90, 200])))) for i in range(150)]
    bad = [(1000 + i, " ".join(rng.choice([w + "###", w + "$$$", "|"]) for w in corpus.words(rng, 60))) for i in range(30)]
    bad += [(2000 + i, " ".join(w for w in corpus.words(rng, 12) for _ in range(5))) for i in range(20)]
    frame = spark.createDataFrame([*good, *bad, (5000, None), (5001, "two words")], SCHEMA)
    model = quality_classifier.fit(frame)
    got = {r.doc_id: r for r in quality_classifier.score(frame, model).collect()}
    assert sum(got[i].kept for i, _ in good) >= 0.97 * len(good) and sum(not got[i].kept for i, _ in bad) >= 0.9 * len(bad)
    assert model.accuracies()["symbols"][1] > 0.9
    assert quality_classifier.score(docs, model).count() == len(ROWS)
    rows = [*good, *bad, (5000, None), (5001, "two words")]
    features = quality_classifier.Features(model.bits)
    for i, t in rows:
        w = data(t).split()
        places, values = features.vector(w, quality_classifier.measures(data(t), w))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-(sum(model.weight[p] * v for p, v in zip(places, values)) + model.shift))))
    clashing = spark.createDataFrame([(1, "a b", 5, 6, 7), (1, "a b", 5, 6, 7)], "doc_id long, text string, pattern int, size int, before int")
    assert [r.n_words for r in quality_classifier.score(clashing, quality_classifier.fit(clashing)).collect()] == [2, 2]
    assert quality_classifier.score(empty, quality_classifier.fit(empty)).count() == 0


def test_expectation_maximisation():
    """Against a plain second implementation, pattern by pattern, and on voters of known accuracy."""
    rng = random.Random(3)
    labellers, histogram, truth = len(quality_classifier.LABELLERS), Counter(), defaultdict(Counter)
    right = [0.95, 0.9, 0.85, 0.8, 0.9, 0.75, 0.7, 0.6]
    for _ in range(3000):
        y, code = int(rng.random() < 0.7), 0
        for k in range(labellers):
            code = 3 * code + (2 if rng.random() < 0.2 else y if rng.random() < right[k] else 1 - y)
        histogram[code] += 1
        truth[code][y] += 1
    post, table, share = quality_classifier.estimate(histogram)
    begin = ((0.35, 0.15, 0.5), (0.1, 0.5, 0.4))
    say, prior, belief = [[list(begin[c]) for c in (0, 1)] for _ in range(labellers)], 0.8, {}
    for _ in range(200):
        new = {}
        for code in histogram:
            odds = [1 - prior, prior]
            for k, v in enumerate(quality_classifier.votes_of(code)):
                for c in (0, 1):
                    odds[c] *= say[k][c][v]
            new[code] = odds[1] / sum(odds)
        for k in range(labellers):
            for c in (0, 1):
                counts = [2 * x for x in begin[c]]
                for code, n in histogram.items():
                    counts[quality_classifier.votes_of(code)[k]] += n * (new[code] if c else 1 - new[code])
                say[k][c] = [x / sum(counts) for x in counts]
        prior = (sum(n * new[c] for c, n in histogram.items()) + 4) / (sum(histogram.values()) + 5)
        done = belief and max(abs(new[c] - belief[c]) for c in new) < 1e-9
        belief = new
        if done:
            break
    assert all(post[c] == pytest.approx(belief[c], abs=1e-6) for c in histogram) and share == pytest.approx(prior, abs=1e-6)
    assert table.ravel().tolist() == pytest.approx([x for k in say for c in k for x in c], abs=1e-6)
    for k in range(labellers):
        assert table[k, 1, 1] / (table[k, 1, 0] + table[k, 1, 1]) == pytest.approx(right[k], abs=0.04)
    assert sum(truth[c][int(post[c] >= 0.5)] for c in truth) > 0.97 * 3000


def test_cutting_spans_keeps_the_rest():
    assert cut_spans(b"a, b c.\nd", SPACE_WORD, [(1, 3)]) == b"a, d"
    assert cut_spans(b"One, two three", ALNUM_WORD, [(0, 1)]) == b"two three"
    assert cut_spans(b"a b c", SPACE_WORD, [(0, 1), (2, 3)]) == b"b"


def test_words_hash_alike_in_pieces(monkeypatch):
    texts = [data(t) for _, t in ROWS]
    whole = hashing.word_hashes(texts)
    monkeypatch.setattr(hashing, "PIECE", 50)
    for a, b in zip(whole, hashing.word_hashes(texts), strict=True):
        assert a.tolist() == b.tolist()
    assert whole[1].tolist() == np.cumsum([0, *(len(t.split()) for t in texts)]).tolist()


def test_toxicity_counts_every_word_of_rare_groups(spark):
    """Two toxic examples of a word family are far below any significance; a text like them finds them all the same."""
    rng = random.Random(12)
    plain = [(i, " ".join(corpus.words(rng, 40)), 0) for i in range(300)]
    bad = [(1000 + i, " ".join([*corpus.words(rng, 40), "zornig", "zornig"]), 1) for i in range(40)]
    rare = "xqua yber wolg hunt jelk dwar"
    train = [i for i in range(2000, 2100) if zlib.crc32(str(i).encode()) % 5][:2]
    rows = [*plain, *bad, *((i, rare, 1) for i in train[:1]), (train[1], rare + " pfol", 1)]
    asked = [(5000, "wolg hunt xqua jelk"), (5001, " ".join(corpus.words(rng, 6)))]
    docs = spark.createDataFrame([*(r[:2] for r in rows), *asked], SCHEMA).repartition(3)
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))).collect()}
    assert {e.doc_id for e in got[5000].evidence[:2]} == set(train) and got[5000].score > 2 * got[5001].score


def test_toxicity_scores_match_dense_cosine(spark):
    """Every score against a plain second implementation: dense vectors, all similarities, votes, calibration's inputs."""
    rows = _toxic_corpus(seed=21, n=250)
    asked = [(8000, None), (8001, "nothing known here"), (8002, rows[3][1] * 40), (8003, rows[16][1]), (8003, rows[16][1])]
    docs = spark.createDataFrame([*(r[:2] for r in rows), *asked], SCHEMA)
    docs = docs.select("*", *(F.lit(1).alias(c) for c in ("label", "digest", "n", "kind", "size", "term"))).repartition(4)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    words = lambda t: Counter(alnum_words(data(t)))
    everyone = [words(t) for _, t in [*(r[:2] for r in rows), *asked]]
    df = Counter(w for c in everyone for w in c)
    by_text = defaultdict(list)
    for i, t, y in rows:
        if zlib.crc32(str(i).encode()) % 5:
            by_text[t].append((i, y))
    examples = sorted((min(x)[0], len(x), sum(y for _, y in x), words(t)) for t, x in by_text.items())
    held, bad = Counter(), Counter()
    for _, n, n1, c in examples:
        for w in c:
            held[w] += 1 - n1 / n
            bad[w] += n1 / n
    n1 = sum(e[2] / e[1] for e in examples)
    n0 = len(examples) - n1

    def part(k, expected):
        return k * math.log(max(k, 1e-9) / max(expected, 1e-9))

    weight = {}
    for w in {w for e in examples for w in e[3]}:
        p = (held[w] + bad[w]) / (n0 + n1)
        ratio = 2 * (part(held[w], p * n0) + part(n0 - held[w], (1 - p) * n0) + part(bad[w], p * n1) + part(n1 - bad[w], (1 - p) * n1))
        strength = math.sqrt(max(ratio, 0)) if bad[w] / n1 > held[w] / n0 else 0
        weight[w] = (math.log((len(everyone) + 1) / (df[w] + 1)) + 1) * (1 + strength)
    unknown = math.log((len(everyone) + 1) / 2) + 1

    def vector(c):
        v = {w: (1 + math.log(n)) * weight.get(w, unknown) for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vectors = [vector(e[3]) for e in examples]
    base = (sum(e[2] for e in examples) + 0.5) / (sum(e[1] for e in examples) + 1)

    def score(t):
        q = vector(words(t))
        sims = sorted(((-sum(x * v.get(w, 0) for w, x in q.items()), k) for k, v in enumerate(vectors)))[:25]
        votes = [(math.sqrt(examples[k][1]) * -s / (1 + s + toxicity.CLOSE), examples[k][2] / examples[k][1]) for s, k in sims if s < 0]
        prior = toxicity.PRIOR
        share = (sum(w * y for w, y in votes) + prior * base) / (sum(w for w, _ in votes) + prior)
        return 1 / (1 + math.exp(-(model.slope * (toxicity._logit(share) - toxicity._logit(base)) + toxicity._logit(base))))

    assert model.examples.base == model.examples.neutral == pytest.approx(base) and model.slope > 0
    got = defaultdict(list)
    for r in toxicity.score(docs, model).collect():
        got[r.doc_id].append(r.score)
    assert len(got[8003]) == 2 and got[8001][0] == pytest.approx(base)
    for i, t in [*(r[:2] for r in rows), *asked]:
        assert got[i].pop() == pytest.approx(score(t), abs=2e-4), i


def test_toxicity_counts_all_labels_of_equal_texts(spark):
    """Repeated texts take one place of the bound, and every row's label counts."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, "same old words", int(k > 0)) for k, i in enumerate(ids[:30])] + [(i, f"other text {i}", 0) for i in ids[30:40]]
    docs = spark.createDataFrame([r[:2] for r in rows], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, examples=11)
    assert sorted(zip(model.examples.rows.tolist(), model.examples.toxic.tolist())) == [(1, 0)] * 10 + [(30, 29)]
    model = toxicity.fit(docs, labels, examples=5)
    assert sorted(zip(model.examples.rows.tolist(), model.examples.toxic.tolist(), model.examples.stands.tolist())) == [(1, 0, 2.5)] * 4 + [(30, 29, 1)]


def test_license_scan_finds_templates_longer_than_a_block(spark):
    rng = random.Random(2)
    long = " ".join(f"term{i}" for i in range(150))
    whole = max((x for k, x in license_scan.TEMPLATES if k == "mit"), key=len)
    docs = spark.createDataFrame([(1, " ".join([*corpus.words(rng, 70), long, *corpus.words(rng, 90)])), (2, " ".join(corpus.words(rng, 300))), (3, " ".join([*corpus.words(rng, 200), whole.upper(), *corpus.words(rng, 30)]))], SCHEMA)
    got = {r.doc_id: r for r in license_scan.license_scan(docs, templates=(("long", long), ("none", " , "))).collect()}
    assert got[1].labels == "long" and got[1].score == 1 and got[2].labels == ""
    assert license_scan.license_scan(docs.where("doc_id = 3")).first().labels == "mit"


def test_license_filters_lose_no_match():
    """Prefix, length and positional filters against plain containment, on random records around the threshold."""
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(40)]
    rank = {w.encode(): k for k, w in enumerate(vocabulary)}
    for threshold in (0.5, 0.8, 1.0):
        templates = [license_scan.Template(str(k), " ".join(rng.sample(vocabulary, rng.randint(1, 12))), threshold, False, rank) for k in range(30)]
        index = license_scan.Index(32, templates)
        for _ in range(400):
            base = rng.choice(templates).order
            record = sorted({*rng.sample(base, rng.randint(0, len(base))), *rng.sample(range(40), rng.randint(0, 10))})
            want = {(t.label, n) for t in templates if (n := len(set(record) & set(t.order))) >= threshold * len(t.order) - 1e-9}
            assert {(t.label, n) for t, n in index.matches(record)} == want
