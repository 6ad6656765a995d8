"""BPE encoding and decoding by a segment tree over adjacent pair ranks.

The leaves hold, for every place where a symbol meets its right neighbour, the merge rank of that pair (or none).  The
root is the smallest (rank, place), so it names the leftmost pair of lowest rank.  A merge changes at most three leaves:
its own and those of the two neighbours, each a logarithmic update, until the root says that no pair is mergeable.

Words are encoded once per worker: those that a batch brings and that aren't in the worker's table go into one *forest*,
a tree per word in the rows of a NumPy array, where each step merges one pair in every word at once.  Long runs use a
tree of their own.  The table of known words is bounded.

Text preparation (normaliser, pre-tokenizer, special strings) is the tokenizer file's own; it acts on runs between white
space, since this kind of vocabulary drops white space and never joins across it.

A word's tokens are decoded when it is encoded; since decoding puts a space between tokens, a text's decoded words with
spaces between are the text decoded.

Defined cases: a null or empty text has no ids; a row of the input gives a row of the output, repeated rows too; an empty
table gives none; texts are taken whole, very long runs cost n log n; columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from twinlens.llm.common import id_and_text, parts, tidy

#: Symbols in the widest forest; longer runs get a tree each.
WIDEST = 64
#: Words that a worker remembers at most, and the longest of them in bytes: together they bound the tables.
KNOWN, LONGEST = 400_000, 64
#: Texts whose new words are encoded together.
SLICE = 1000
_NONE = np.int64(2**62)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others for the code points from 256 on, in byte order."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


#: The text preparation of the one kind of file for which Latin runs are prepared without the library.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Runs of printable ASCII, Latin-1 and Latin Extended-A but the dotted capital I, whose lower case is two characters.
_LATIN = re.compile("[!-~\u00a1-\u012f\u0131-\u017f]*")
_LETTERS = "".join(chr(c) for c in range(0x180) if unicodedata.category(chr(c))[0] == "L" and chr(c) not in "-]^\\")
_NUMBERS = "".join(chr(c) for c in range(0x180) if unicodedata.category(chr(c))[0] == "N")
_PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
_TO_SYMBOLS = dict(enumerate(byte_symbols()))


class PairRanks:
    """Merge table: (left id, right id) to (rank, merged id), as sorted arrays."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        left, right, merged = (np.array(x, np.int64) for x in zip(*merges, strict=True)) if merges else (np.zeros(0, np.int64),) * 3
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], np.arange(len(keys), dtype=np.int64)[order], merged[order]
        self.table = {int(k): (int(r), int(m)) for k, r, m in zip(self.keys, self.ranks, self.merged, strict=True)}

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or -1) and merged id of each pair."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        if not len(self.keys):
            return np.full(len(keys), -1), np.full(len(keys), -1)
        found = self.keys[at] == keys
        return np.where(found, self.ranks[at], -1), self.merged[at]


def merge_one(ids: list[int], pairs: PairRanks) -> list[int]:
    """Merge one run with a segment tree of its own."""
    n = len(ids)
    if n < 2:
        return list(ids)
    ids, nxt, prv = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    size = 1 << (n - 1).bit_length()
    tree: list = [(_NONE, 0)] * (2 * size)

    def leaf(i: int):
        hit = pairs.table.get(ids[i] << 32 | ids[nxt[i]]) if nxt[i] < n else None
        return (hit[0], i) if hit else (_NONE, i)

    for i in range(n):
        tree[size + i] = leaf(i)
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def update(i: int, value) -> None:
        i += size
        tree[i] = value
        while i > 1:
            i //= 2
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

    while tree[1][0] < _NONE:
        i = tree[1][1]
        j = nxt[i]
        ids[i] = pairs.table[ids[i] << 32 | ids[j]][1]
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        update(j, (_NONE, j))
        update(i, leaf(i))
        if prv[i] >= 0:
            update(prv[i], leaf(prv[i]))
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = nxt[i]
    return out


def merge_forest(words: list[list[int]], pairs: PairRanks) -> list[list[int]]:
    """Merge many short runs at once: a tree per row."""
    lengths = np.array([len(w) for w in words])
    rows, width = len(words), 1 << max(1, int(lengths.max() - 1).bit_length())
    ids = np.full((rows, width + 1), -1, np.int64)
    ids[np.arange(width + 1)[None, :] < lengths[:, None]] = np.concatenate([np.array(w, np.int64) for w in words])
    place = np.arange(width, dtype=np.int64)
    nxt = np.minimum(np.tile(place + 1, (rows, 1)), np.maximum(lengths, 1)[:, None])
    prv = np.tile(place - 1, (rows, 1))
    tree = np.full((rows, 2 * width), _NONE, np.int64)  # rank * width + place
    r, i = np.nonzero((place[None, :] + 1) < lengths[:, None])
    rank, _ = pairs.find(ids[r, i], ids[r, i + 1])
    tree[r, width + i] = np.where(rank >= 0, rank * width + i, _NONE)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2

    def update(r: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
        i = i + width
        tree[r, i] = value
        while i[0] > 1:  # all are on the same level
            i = i >> 1
            tree[r, i] = np.minimum(tree[r, 2 * i], tree[r, 2 * i + 1])

    def leaf(r: np.ndarray, i: np.ndarray) -> np.ndarray:
        j = nxt[r, i]
        rank, _ = pairs.find(ids[r, i], ids[r, np.minimum(j, width)])
        return np.where((rank >= 0) & (j < lengths[r]), rank * width + i, _NONE)

    r = np.flatnonzero(tree[:, 1] < _NONE)
    while len(r):
        i = tree[r, 1] % width
        j = nxt[r, i]
        _, ids[r, i] = pairs.find(ids[r, i], ids[r, j])
        after = nxt[r, j]
        nxt[r, i] = after
        has = after < lengths[r]
        prv[r[has], after[has]] = i[has]
        update(r, j, np.full(len(r), _NONE))
        update(r, i, leaf(r, i))
        before = prv[r, i]
        has = before >= 0
        if has.any():
            update(r[has], before[has], leaf(r[has], before[has]))
        r = r[tree[r, 1] < _NONE]
    alive = np.zeros((rows, width), bool)
    at, r = np.zeros(rows, np.int64), np.flatnonzero(lengths > 0)
    while len(r):
        alive[r, at[r]] = True
        at[r] = nxt[r, at[r]]
        r = r[at[r] < lengths[r]]
    flat, counts = ids[:, :width][alive].tolist(), alive.sum(1).tolist()
    out, k = [], 0
    for c in counts:
        out.append(flat[k : k + c])
        k += c
    return out


class WordBpe:
    """Encoder and decoder for a word-level BPE vocabulary with an end-of-word suffix, from its tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.tok = spec["model"], Tokenizer.from_file(path)
        if model["type"] != "BPE" or spec["decoder"] is not None or model.get("ignore_merges"):
            raise ValueError(f"{path} isn't a word-level BPE vocabulary without a decoder")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = PairRanks([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: s for s, i in (self.vocab | self.special).items()}
        self.digits = {i: str(i) for i in self.token}
        #: What a run between white space and what a pre-token gives: number of ids, ids, tokens.
        self.known: dict[bytes, tuple[int, str, str]] = {}
        self.words: dict[str | int, tuple[int, str, str]] = {}
        self.long: list[bytes] = []
        self.held_long = False
        self.blank = False
        self.plain = spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == _PRE_TOKENIZER

    def _parts(self, run: str) -> list[str | int]:
        """Pre-tokens of a run without white space, special strings as their ids."""
        found, parts = [run], []
        for content, i in self.special.items():
            found = [y for x in found for y in (_cut(x, content, i) if isinstance(x, str) else [x])]
        for x in found:
            if isinstance(x, str):
                x = self.tok.normalizer.normalize_str(x) if self.tok.normalizer else x
                parts += [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(x)]
            else:
                parts.append(x)
        return parts

    def _symbols(self, word: str) -> list[int]:
        return [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.suffix]]

    def _prepared(self, runs: list[str]) -> list[list[str | int]]:
        """Pre-tokens of many runs.  Latin runs without special strings take a way of their own with the same outcome."""
        if not self.plain:
            return [self._parts(r) for r in runs]
        out: list[list[str | int]] = []
        for r in runs:
            if r.isascii() and r.isalpha():
                out.append([r.lower()])
            elif _LATIN.fullmatch(r) and "<|" not in r:
                r = r.lower() if r.isascii() else unicodedata.normalize("NFC", r).lower()
                parts = _PRE_TOKEN.findall(r)
                out.append(parts if r.isascii() else [p.encode().decode("latin-1").translate(_TO_SYMBOLS) for p in parts])
            else:
                out.append(self._parts(r))
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of pre-tokens, all merged together in forests by width."""
        symbols = [self._symbols(w) for w in words]
        done: list = [s if len(s) == 1 else None for s in symbols]
        by_width: dict[int, list[int]] = {}
        for k, s in enumerate(symbols):
            if len(s) > WIDEST:
                done[k] = merge_one(s, self.pairs)
            elif len(s) > 1:
                by_width.setdefault((len(s) - 1).bit_length(), []).append(k)
        for group in by_width.values():
            for at in range(0, len(group), 8192):
                some = group[at : at + 8192]
                for k, ids in zip(some, merge_forest([symbols[k] for k in some], self.pairs), strict=True):
                    done[k] = ids
        return done

    def learn(self, runs: set[bytes], bounded: bool = True) -> bool:
        """Put runs into the table of known ones: number of ids, ids and tokens as text.

        True if the table was full: then the later half, which is rare runs for the most part, was forgotten first.  Long
        runs are remembered up to the next call only.
        """
        for long in self.long:
            self.known.pop(long, None)
        self.long = [r for r in runs if len(r) > LONGEST]
        if full := bounded and len(self.known) + len(runs) > KNOWN:
            _forget(self.known)
        if len(self.words) > KNOWN:
            _forget(self.words)
        for long in [p for p in self.words if isinstance(p, str) and len(p) > LONGEST] if self.held_long else []:
            del self.words[long]
        self.held_long = bool(self.long)
        order = list(runs)
        for at in range(0, len(order), 20_000):
            some = order[at : at + 20_000]
            parts = self._prepared([r.decode("utf-8", "replace") for r in some])
            new = list({p for x in parts for p in x if p not in self.words})
            fresh = [p for p in new if isinstance(p, str)]
            for p, ids in zip(fresh, self.encode_words(fresh), strict=True):
                self.words[p] = (len(ids), " ".join([self.digits[i] for i in ids]), self.decode(ids))
            self.words.update((p, (1, str(p), self.decode([p]))) for p in new if isinstance(p, int))
            for run, x in zip(some, parts, strict=True):
                if len(x) == 1:
                    self.known[run] = self.words[x[0]]
                elif len(x) == 2:  # a word and what stands behind or before it
                    (n, ids, text), (m, more, rest) = self.words[x[0]], self.words[x[1]]
                    self.known[run] = (n + m, f"{ids} {more}", f"{text} {rest}")
                else:
                    got = [self.words[p] for p in x]
                    self.known[run] = (sum([g[0] for g in got]), " ".join([g[1] for g in got]), " ".join([g[2] for g in got]))
                    self.blank |= not got
        return full

    def encode(self, text: str) -> list[int]:
        runs = text.encode("utf-8", "replace").split()
        self.learn(set(runs))
        return [int(i) for r in runs for i in self.known[r][1].split()]

    def decode(self, ids: Iterable[int]) -> str:
        """As the library without a decoder: tokens with a space between; unknown ids are left out."""
        return " ".join([self.token[i] for i in ids if i in self.token])


def _cut(text: str, content: str, i: int) -> list[str | int]:
    out: list[str | int] = []
    for k, part in enumerate(text.split(content)):
        out += ([i] if k else []) + ([part] if part else [])
    return out


def _forget(table: dict) -> None:
    for k in list(itertools.islice(table, KNOWN // 2, None)):
        del table[k]


_CODERS: dict[str, WordBpe] = {}


def coder(path: str) -> WordBpe:
    """One coder per worker and file, so that what it has learnt serves the next task too."""
    if path not in _CODERS:
        _CODERS[path] = WordBpe(path)
    return _CODERS[path]


def _encode(path: str, digest: bool):
    def run(batches):
        bpe = coder(path)
        for batch in (p for b in batches for p in parts(b, most=4_000_000)):
            texts = batch.column("text").to_pylist()
            counts, ids, decoded = [], [], []
            for at in range(0, len(texts), SLICE):
                split = [t.split() for t in texts[at : at + SLICE]]
                new = set().union(*split)
                new.difference_update(bpe.known)
                if new and bpe.learn(new):  # some that are needed now may have gone
                    bpe.learn(set().union(*split).difference(bpe.known), bounded=False)
                for s in split:
                    got = list(map(bpe.known.__getitem__, s))
                    if bpe.blank:  # some run has no ids
                        got = [x for x in got if x[0]]
                    counts.append(sum([x[0] for x in got]))
                    line, text = " ".join([x[1] for x in got]), " ".join([x[2] for x in got])
                    ids.append(hashlib.sha256(line.encode()).hexdigest() if digest else list(map(int, line.split())))
                    decoded.append(hashlib.sha256(text.encode()).hexdigest() if digest else text)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string() if digest else pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))])

    return tidy(run)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids array<int>, decoded string."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_encode(tokenizer_path, False), "doc_id long, n_tokens long, ids array<int>, decoded string")


def round_trip_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens and the SHA-256 of the ids and of the decoded text."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_encode(tokenizer_path, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
