"""Licence scan: an exact set-similarity join of text blocks with templates.

Blocks.  A template of m words is looked for in blocks of 2 * m' words that start every m' words, m' being the next power
of two from ``LEAST_HALF`` on; so every passage of m' words, and thus every copy, lies whole in some block.  A block
matches when it holds at least ``threshold`` of the template's distinct words (containment).

Join.  Words are ordered by how many documents hold them, rarest first.  A block's record is its distinct template words
in that order (others can't add to an overlap).

* Prefix filter: of a template of t distinct words, ``need`` must occur; a block without its first t - need + 1 has too few.
* Length filter: a record of fewer than ``need`` words is no candidate.
* Positional filter: when the first word that both hold stands at place i of the template and j of the record, the overlap
  is at most 1 + min(t - i - 1, length of the record - j - 1).

What passes is counted in full.  Phrases are templates of threshold 1 whose candidates are then checked for places where
the words stand consecutively.

Templates are a parameter; they are few and their size is checked.  Word frequencies are counted over all documents.

Defined cases: null and empty texts have no words, no labels and score 0; ties in frequency are ordered by word; repeated
rows each give a row; an empty table gives none; texts and templates of any length are taken whole; templates without words
match nothing; columns other than those named are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.common import alnum_words, id_and_text, parts, tidy

#: Words of half a block, at least.
LEAST_HALF = 32
#: Words of all templates together, at most.
MOST_WORDS = 100_000

#: Phrases that label a text wherever their words stand consecutively.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: Texts of common licences and notices, matched by containment: whole ones of those that are short, else the sentence or
#: notice that stands for them.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution share alike 4 0 international license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
        "or the use or other dealings in the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all rights"),
)


def half_of(words: int) -> int:
    """Words between the blocks in which a template of so many words is looked for."""
    return max(LEAST_HALF, 1 << max(0, words - 1).bit_length())


class Template:
    """A template's distinct words by their ranks in the global order, and how many of them a block needs."""

    def __init__(self, label: str, text: str, threshold: float, phrase: bool, rank: dict[bytes, int]):
        self.label, self.words, self.phrase = label, alnum_words(text.encode()), phrase
        self.order = sorted({rank[w] for w in self.words})
        self.need = max(1, math.ceil(threshold * len(self.order) - 1e-9))
        self.prefix = self.order[: len(self.order) - self.need + 1]
        self.half = half_of(len(self.words))


class Index:
    """Prefixes of the templates of one block size: rank to (template, place in it)."""

    def __init__(self, half: int, templates: list[Template]):
        self.half = half
        self.lists: dict[int, list[tuple[Template, int]]] = {}
        for t in templates:
            for i, r in enumerate(t.prefix):
                self.lists.setdefault(r, []).append((t, i))

    def matches(self, record: list[int]) -> list[tuple[Template, int]]:
        """Templates that a block's record holds enough of, and how many words they share."""
        seen, out, whole = set(), [], set(record)
        for j, r in enumerate(record):
            for t, i in self.lists.get(r, ()):
                if id(t) in seen:
                    continue  # decided at an earlier word
                seen.add(id(t))
                if len(record) < t.need or 1 + min(len(t.order) - i - 1, len(record) - j - 1) < t.need:
                    continue
                shared = len(whole.intersection(t.order))
                if shared >= t.need:
                    out.append((t, shared))
        return out


def indexes(templates: list[Template]) -> list[Index]:
    sizes = sorted({t.half for t in templates})
    return [Index(half, [t for t in templates if t.half == half]) for half in sizes]


def scan(words: list[bytes], rank: dict[bytes, int], by_size: list[Index]) -> tuple[set[str], list[tuple[int, str]], float, list[tuple[int, str, float]]]:
    """Labels of templates, places of phrases, best containment and the blocks that matched a template."""
    labels, places, best, blocks = set(), set(), 0.0, []
    held = [(i, r) for i, w in enumerate(words) if (r := rank.get(w)) is not None]
    for index in by_size:
        half = index.half
        halves: dict[int, set[int]] = {}
        prefixed = set()
        for i, r in held:
            halves.setdefault(i // half, set()).add(r)
            if r in index.lists:
                prefixed.add(i // half)
        for b in sorted({x for h in prefixed for x in (h - 1, h) if x >= 0}):
            for t, shared in index.matches(sorted(halves.get(b, set()) | halves.get(b + 1, set()))):
                if t.phrase:
                    low, n = b * half, len(t.words)
                    part = words[low : low + 2 * half]
                    found = [low + k for k in range(len(part) - n + 1) if part[k] == t.words[0] and part[k : k + n] == t.words]
                    if found:
                        places.update((k, t.label) for k in found)
                        best = 1.0
                else:
                    labels.add(t.label)
                    best = max(best, shared / len(t.order))
                    blocks.append((b * half, t.label, shared / len(t.order)))
    return labels, sorted(places), best, blocks


def _frequencies(vocabulary: frozenset[bytes]):
    def run(batches):
        counts: Counter = Counter()
        for batch in (p for b in batches for p in parts(b)):
            for data in batch.column("text").to_pylist():
                counts.update(vocabulary.intersection(alnum_words(data)))
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    return run


def word_frequencies(docs: DataFrame, vocabulary: frozenset[bytes], id_col: str = "doc_id", text_col: str = "text") -> dict[bytes, int]:
    """In how many texts of ``docs`` each word of a bounded vocabulary occurs."""
    if len(vocabulary) > MOST_WORDS:
        raise ValueError(f"{len(vocabulary)} template words; the scan holds {MOST_WORDS} at most")
    texts = id_and_text(docs, id_col, text_col).select("text")
    rows = texts.mapInArrow(_frequencies(vocabulary), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


def _scan(templates: list[Template], rank: dict[bytes, int]):
    by_size = indexes(templates)
    keys = frozenset(w for w, r in rank.items() if any(r in x.lists for x in by_size))

    def run(batches):
        for batch in (p for b in batches for p in parts(b)):
            out = []
            for i, data in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = alnum_words(data)
                labels, places, best, blocks = (set(), [], 0.0, []) if keys.isdisjoint(words) else scan(words, rank, by_size)
                out.append((i, len(words), [{"word": k, "label": x} for k, x in places], sorted(labels), best, [{"word": k, "label": x, "containment": c} for k, x, c in blocks]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            place = pa.struct([("word", pa.int64()), ("label", pa.string())])
            block = pa.struct([("word", pa.int64()), ("label", pa.string()), ("containment", pa.float64())])
            types = (pa.int64(), pa.int64(), pa.list_(place), pa.list_(pa.string()), pa.float64(), pa.list_(block))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "n_words", "places", "template_labels", "score", "blocks"])

    return tidy(run)


def license_blocks(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, places of phrases, labels and blocks of templates, score (best containment)."""
    texts = [x for _, x in (*phrases, *templates)]
    vocabulary = frozenset(w for x in texts for w in alnum_words(x.encode()))
    frequency = word_frequencies(docs, vocabulary, id_col, text_col)
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    made = [Template(k, x, 1.0, True, rank) for k, x in phrases] + [Template(k, x, threshold, False, rank) for k, x in templates]
    schema = "doc_id long, n_words long, places array<struct<word: long, label: string>>, template_labels array<string>, score double, blocks array<struct<word: long, label: string, containment: double>>"
    return id_and_text(docs, id_col, text_col).mapInArrow(_scan([t for t in made if t.order], rank), schema)


def license_scan(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    return license_blocks(docs, **options).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("template_labels"))), ",").alias("labels"),
        "score",
    )
