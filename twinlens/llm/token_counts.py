"""Token counts without token ids.

Pieces are counted once per distinct pre-token of the corpus, by the tokenizers library, and each text's count is the sum
of frequency times pieces over its pre-tokens:

1. count the corpus's distinct pre-tokens (map-side counts, one shuffle of distinct strings);
2. count the pieces of each distinct pre-token, write that table;
3. join it to the per-document frequencies.  The most frequent ``head_size`` pre-tokens are held as a broadcast table of
   bounded size; all others, each of them rarer than those, go through an ordinary shuffle join.

A pre-token of more than ``LONG`` bytes goes by its 192-bit digest, so that length keeps none out of the head and no long
frequent one is a hot key.  Documents meet their sums by doc_id and a 64-bit digest of the text.

Texts are first cut into runs at single spaces and line ends, borders that the tokenizer's pattern never matches across
(where white space stands beside white space there is no cut).  A run of Latin characters is split by that pattern, one of
any other script by the library's own pre-tokenizer; only a run that may hold a special string stays whole.  What runs
split into is remembered in a bounded table.

Defined cases: null text counts as empty; empty texts have 0 tokens; repeated rows each give a row; an empty table gives
none; texts of any length are counted whole; special strings in a text are counted as the library does by default; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.common import id_and_text, parts, tidy, written

#: Longest pre-token that stands for itself, in bytes; with head_size it bounds the broadcast.
LONG = 64
#: Bytes of text whose runs are counted together.
TEXTS = 4_000_000
#: Distinct pre-tokens that a task counts before it hands them on.
FLUSH = 150_000


#: Bytes that only rarely occur and may mean white space other than the space and the line end.
_RARE = (b"\t", b"\x0b", b"\x0c", b"\r", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
#: A space or line end whose neighbours aren't white space: the only place where a text with rare white space is cut.
_BORDER = re.compile(r"(?<=\S)(?=[ \n]\S)")
_LATIN = re.compile("[\n -~\u00a1-\u017f]*")
_LETTERS = "".join(chr(c) for c in range(0x180) if unicodedata.category(chr(c))[0] == "L")
_NUMBERS = "".join(chr(c) for c in range(0x180) if unicodedata.category(chr(c))[0] == "N")
#: The byte-level pattern for such characters (its fixed alternatives, in their order).
_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\\s{_LETTERS}{_NUMBERS}]+|\\s+(?!\\S)|\\s+")
#: Runs of at most ``LONG`` bytes that a worker remembers.
KNOWN = 300_000


def runs(data: bytes) -> list[bytes]:
    """A UTF-8 text cut at clean borders.  The space before a run goes without saying (``b"\\x00"`` first says there is
    none); a line end before it is its first byte."""
    if not data:
        return []
    if b"\x00" in data or b"  " in data or b"\n\n" in data or b" \n" in data or b"\n " in data or any(x in data for x in _RARE):
        return [b"\x00" + p.encode() for p in _BORDER.split(data.decode("utf-8", "replace"))]
    found = data.replace(b"\n", b" \n").split(b" ")
    if data[0] == 10:
        return found[1:]
    found[0] = b"\x00" + found[0]
    return found


def split_run(run: bytes, pre_tokenize) -> tuple[bytes, ...]:
    """The pre-tokens of a run, concatenating to it.  ``pre_tokenize`` is the library's."""
    run = run[1:] if run[:1] == b"\x00" else run if run[:1] == b"\n" else b" " + run
    text = run.decode("utf-8", "replace")
    if "<|" in text:
        return (run,)
    if _LATIN.fullmatch(text):
        return tuple([p.encode() for p in _PATTERN.findall(text)])
    return tuple([text[a:b].encode() for _, (a, b) in pre_tokenize(text)])


def pre_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str


def key_of(piece: bytes) -> bytes:
    """What a pre-token goes by; no pre-token begins with the byte that marks digests."""
    return piece if len(piece) <= LONG else b"\xff" + hashlib.blake2b(piece, digest_size=24).digest()


class Splitter(dict):
    """Run to pre-tokens, remembered for short runs up to a bound."""

    def __init__(self, pre_tokenize):
        self.pre_tokenize = pre_tokenize

    def __missing__(self, run: bytes) -> tuple[bytes, ...]:
        found = split_run(run, self.pre_tokenize)
        if len(run) <= LONG and len(self) < KNOWN:
            self[run] = found
        return found


class Sizes:
    """What the head's table gives for a text, and frequencies of the pre-tokens that it lacks."""

    def __init__(self, known: dict[bytes, int], pre_tokenize):
        self.known, self.pre_tokenize = known, pre_tokenize
        #: Runs whose pre-tokens are all in the head, up to a bound.
        self.whole: dict[bytes, int] = {}

    def of(self, data: bytes) -> tuple[int, Counter]:
        found = runs(data)
        got = list(map(self.whole.get, found))
        if None not in got:
            return sum(got), Counter()
        total, rest = sum(filter(None, got)), Counter()
        for run, n in Counter([r for r, x in zip(found, got, strict=True) if x is None]).items():
            size, whole = 0, True
            for piece in split_run(run, self.pre_tokenize):
                if len(piece) > LONG:
                    piece = key_of(piece)
                pieces = self.known.get(piece)
                if pieces is None:
                    rest[piece] += n
                    whole = False
                else:
                    size += pieces
            total += n * size
            if whole and len(run) <= LONG and len(self.whole) < KNOWN:
                self.whole[run] = size
        return total, rest


def _distinct(path: str):
    def run(batches):
        counts: Counter = Counter()

        def flush():
            texts = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array(map(key_of, texts), pa.binary()), pa.array([t if len(t) > LONG else None for t in texts], pa.binary()), pa.array(counts.values(), pa.int64())], ["piece", "whole", "n"])
            counts.clear()

        split = Splitter(pre_tokenizer(path))
        for batch in batches:
            for part in parts(batch, most=TEXTS):
                seen: Counter = Counter()
                for data in part.column("text").to_pylist():
                    seen.update(runs(data))
                for run, n in seen.items():
                    for piece in split[run]:
                        counts[piece] += n
                if len(counts) > FLUSH:
                    yield from flush()
        yield from flush()

    return tidy(run)


def _count_pieces(path: str):
    def run(batches):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        for batch in (p for b in batches for p in parts(b, "whole", 10_000)):
            pieces = [w or p for w, p in zip(batch.column("whole").to_pylist(), batch.column("piece").to_pylist(), strict=True)]
            sizes: list[int] = []
            for k in range(0, len(pieces), 2000):
                texts = [p.decode("utf-8", "replace") for p in pieces[k : k + 2000]]
                sizes += [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("n"), pa.array(sizes, pa.int64())], ["piece", "n", "pieces"])

    return tidy(run)


def _per_document(head, path: str):
    def run(batches):
        sizes = Sizes(head.value, pre_tokenizer(path))
        for batch in (p for b in batches for p in parts(b, most=TEXTS)):
            base, tail_at, tail_piece, tail_n = [], [0], [], []
            texts = batch.column("text").to_pylist()
            for data in texts:
                total, rest = sizes.of(data)
                tail_piece += rest.keys()
                tail_n += rest.values()
                base.append(total)
                tail_at.append(len(tail_piece))
            entries = pa.StructArray.from_arrays([pa.array(tail_piece, pa.binary()), pa.array(tail_n, pa.int64())], ["piece", "n"])
            digests = np.frombuffer(b"".join([hashlib.blake2b(t, digest_size=8).digest() for t in texts]), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(digests), pa.array(map(len, texts), pa.int64()), pa.array(base, pa.int64()), pa.ListArray.from_arrays(pa.array(tail_at, pa.int32()), entries)],
                ["doc_id", "digest", "n_bytes", "base", "tail"],
            )

    return tidy(run)


def piece_table(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What distinct pre-tokens of the corpus go by, corpus frequency ``n`` and number of ``pieces``, in the shared folder."""
    texts = id_and_text(docs, id_col, text_col).select("text")
    distinct = texts.mapInArrow(_distinct(tokenizer_path), "piece binary, whole binary, n long").groupBy("piece").agg(F.max("whole").alias("whole"), F.sum("n").alias("n"))
    return written(distinct.mapInArrow(_count_pieces(tokenizer_path), "piece binary, n long, pieces long"))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, head_size: int = 300_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    spark = docs.sparkSession
    table = piece_table(docs, tokenizer_path, id_col, text_col)
    rows = table.orderBy(F.desc("n"), "piece").limit(head_size).select("piece", "pieces").toArrow()
    head = spark.sparkContext.broadcast(dict(zip(rows.column("piece").to_pylist(), rows.column("pieces").to_pylist(), strict=True)))
    mapped = id_and_text(docs, id_col, text_col).mapInArrow(_per_document(head, tokenizer_path), "doc_id long, digest long, n_bytes long, base long, tail array<struct<piece: binary, n: long>>")
    # a first entry of each row carries what the head gave; its key is a row's own and matches no pre-token
    none = F.lit(None).cast("long")
    own = F.struct(F.concat(F.lit(b"\xfe"), F.col("digest").cast("string").cast("binary")).alias("piece"), none.alias("n"), F.col("base").alias("add"), F.col("n_bytes").alias("n_bytes"))
    rest = F.transform("tail", lambda x: F.struct(x.piece.alias("piece"), x.n.alias("n"), none.alias("add"), none.alias("n_bytes")))
    entries = mapped.select("doc_id", "digest", F.explode(F.concat(F.array(own), rest)).alias("e")).select("doc_id", "digest", "e.*")
    joined = entries.join(table.select("piece", "pieces"), "piece", "left")
    total = F.coalesce(F.sum("add"), F.lit(0)) + F.coalesce(F.sum(F.col("n") * F.col("pieces")), F.lit(0))
    # repeated rows have their sums together
    summed = joined.groupBy("doc_id", "digest").agg(F.max("n_bytes").alias("n_bytes"), F.count("add").alias("rows"), total.alias("total"))
    each = summed.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    n_tokens = F.expr("total div rows")
    return each.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
