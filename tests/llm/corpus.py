"""A small corpus with every awkward case."""

import random

BENCHMARK = ["north wind carries seven silver lanterns over the quiet harbour while old sailors count the fading stars again", "short item here", "", None]


def words(rng, n):
    parts = ["ka", "lo", "mi", "ne", "ru", "so", "ta", "vi", "é", "ß"]
    return ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)]


def text(rng, n):
    out = words(rng, n)
    for k in range(9, n, 10):
        out[k] += rng.choice([".", ",", ".\n"])
    return " ".join(out)


def documents(seed=3):
    """Rows (doc_id, text): plain, copies, near copies, shared passages, benchmark passages, licences, junk, nulls."""
    rng = random.Random(seed)
    rows = [(i, text(rng, rng.choice([5, 60, 150, 400]))) for i in range(60)]
    passage = text(rng, 55)
    near = rows[12][1].split(" ")
    for k in range(6):
        copy = list(near)
        copy[3 * k] = "changed"
        rows.append((100 + k, " ".join(copy)))
    rows += [(200 + k, rows[5][1]) for k in range(4)]
    rows += [(300 + k, text(rng, 30) + " " + passage + " " + text(rng, 20)) for k in range(5)]
    rows += [(400, text(rng, 20) + " " + BENCHMARK[0].upper() + " tail"), (401, "short, ITEM: here!"), (402, " ".join(BENCHMARK[0].split()[3:14]))]
    rows += [(500, "Released under the MIT License. " * 3), (501, "cc by-nc 4.0 and Apache License, Version 2"), (502, "This work is licensed under the GNU General Public License, version 3.")]
    rows += [(600, None), (601, ""), (602, " \n\t "), (603, "#### $$$$ %%%% " * 30), (604, "same same same same same " * 20), (605, "A b"), (606, "a B")]
    rows += [(607, "İ x\x1cy\x85z 日本語 １２ ½ 🙂 don't I'LL <|endoftext|> <|startoftext|>a\x00b  two\n\nlines  wide"), (608, "x" * 3000 + " " + "lo" * 40)]
    rows += [(700, text(rng, 9000)), (None, rows[20][1]), (701, rows[21][1]), (701, rows[21][1])]
    return rows


def labels(rows):
    """Every second document has a label; toxic ones hold a bad word or a word that begins badly."""
    return [(i, 1, int(t is not None and "zorn" in t)) for i, t in rows if i is not None and i % 2 == 0]
