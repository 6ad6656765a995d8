"""The pipeline's stages: columns, decisions, and what must stay."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from collections import Counter

from tests.llm import corpus
from tests.llm.test_operators import _linked, _shingles, data
from twinlens.llm import toxicity
from twinlens.llm.common import ALNUM_WORD, SPACE_WORD, alnum_words, cut_spans
from twinlens.llm.queries import tokenizer

ROWS = corpus.documents()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    bad = [(900 + i, f"zorn{'abcdef'[i % 6]} " * 3 + corpus.text(corpus.random.Random(i), 40)) for i in range(60)]
    rows = [(i, t, "xx", "src", len(t or "")) for i, t in [*ROWS, *bad]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int("zorn" in (t or ""))) for i, t, *_ in rows if i is not None], "doc_id long, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(list(enumerate(corpus.BENCHMARK)), "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_stages_in_order(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "bpe encoding and decoding":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        from twinlens.llm.common import written

        docs = written(out)
        seen.append({r.doc_id: r.text if "text" in docs.columns else r.ids for r in docs.collect()})
    toxic, near, cut, clean, ids = seen
    assert not any("zorn" in (t or "") for t in toxic.values()) and {i for i, _ in ROWS} <= set(toxic)
    assert 5 in near and not {200, 201, 202, 203} & set(near) and 12 in near and not {100, 101} & set(near)
    passages = [i for i in range(300, 305) if ROWS[[r[0] for r in ROWS].index(300)][1].split()[40] in (cut[i] or "")]
    assert 300 in passages and len(cut[301]) < len(near[301])
    assert 401 not in clean and clean[400].endswith("tail") and len(clean[400]) < len(cut[400])
    assert clean[0] == ROWS[0][1] and ids.keys() == clean.keys()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    assert all(tok.encode(clean[i] or "", add_special_tokens=False).ids == x for i, x in ids.items())


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and out.where(F.col("ids").isNull()).count() == 0


def _stretches(gone, n):
    """Maximal runs of marked places as [start, end)."""
    out = []
    for k in range(n):
        if k in gone:
            if out and out[-1][1] == k:
                out[-1][1] = k + 1
            else:
                out.append([k, k + 1])
    return [tuple(x) for x in out]


def _brute(kept, benchmark):
    """The stages after the first, plainly: (doc_id, text) of what is encoded in the end."""
    root = _linked({i: _shingles(t, 5) for i, t in kept if i is not None})
    rows = [(i, t) for i, t in kept if i is None or root[i] == i]
    first = {}
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda r: r[0]):
        w = data(t).split()
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            first[x] = min(first.get(x, (i, k)), (i, k))
    cut = []
    for i, t in rows:
        w, gone = data(t).split(), set()
        for k in range(len(w) - 19 if i is not None else 0):
            if first[tuple(w[k : k + 20])] < (i, k):
                gone.update(range(k, k + 20))
        if not gone or len(gone) < len(w):
            cut.append((i, cut_spans(data(t), SPACE_WORD, _stretches(gone, len(w))).decode() if gone else t))
    windows = set()
    for t in benchmark:
        w = alnum_words(data(t))
        windows.update(tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0))
    out = []
    for i, t in cut:
        w, gone = alnum_words(data(t)), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    gone.update(range(k, k + n))
        if not gone or len(gone) < len(w):
            out.append((i, cut_spans(data(t), ALNUM_WORD, _stretches(gone, len(w))).decode() if gone else t))
    return out


def test_run_matches_brute_force(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    kept = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id not in toxic]
    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    want = Counter()
    for i, t in _brute(kept, corpus.BENCHMARK):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(ids), tok.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in corpus_pipeline.run(spark, folder).collect()) == want


@pytest.mark.parametrize("missing", ["documents", "labels", "benchmark"])
def test_empty_tables_and_extra_columns(spark, folder, tmp_path, missing):
    for name in ("documents", "labels", "benchmark"):
        frame = spark.read.parquet(f"{folder}/{name}.parquet")
        frame = frame.where("doc_id in (5, 200, 300, 301, 400, 600)") if name == "documents" else frame
        frame = frame.withColumn("starts", F.lit("mine")).withColumn("digest", F.lit(1)) if name == "documents" else frame
        (frame.limit(0) if name == missing else frame).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert sorted(docs.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars", "starts", "digest"])
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == (set() if missing == "documents" else {5, 300, 301, 400, 600})
    if got:
        assert {r.starts for r in got.values()} == {"mine"} and got[600].text is None
        assert (corpus.BENCHMARK[0].upper() in got[400].text) == (missing == "benchmark")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(got)
