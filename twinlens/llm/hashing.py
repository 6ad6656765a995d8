"""Rabin-Karp hashes of words and of windows of words, by polynomials modulo primes.

A word's hash is its bytes' polynomial modulo 2 ** 61 - 1 at a random point, mixed to 64 bits; a window's is the
polynomial of its words' hashes at another point.  Two unequal sequences of n items agree for at most n of the 2 ** 61
points, whatever they hold (powers modulo 2 ** 64 lack this: Thue-Morse words agree for every odd base).  ``checks``
gives 31 further bits, modulo 2 ** 31 - 1, for tables that are too large for 61.
"""

from __future__ import annotations

import re

import numpy as np

PRIME, SMALL_PRIME = (1 << 61) - 1, (1 << 31) - 1
#: Points at which the polynomials are taken (fixed values, drawn at random).
WORD_POINT, WINDOW_POINT, CHECK_POINT = 0x0DB7A7D6E24B9C35, 0x1A40C97B53F1E86D, 0x5C1E9A37
_P, _M = np.uint64(PRIME), np.uint64(SMALL_PRIME)
#: Items that are worked on together, so that what lies between stays in a processor's cache.
_CHUNK = 1 << 15
#: Bytes whose words are hashed together: bounds the arrays beside a text of any length.
PIECE = 1_000_000
#: A word's letters whose products add up without overflow.
_LONGEST = 1 << 24
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold(x: np.ndarray) -> np.ndarray:
    """Modulo 2 ** 61 - 1."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def times(x: np.ndarray, c: int) -> np.ndarray:
    """x * c modulo 2 ** 61 - 1, for x below it: halves of 31 and 30 bits, since 2 ** 61 is 1."""
    c1, c0 = np.uint64(c >> 31), np.uint64(c & SMALL_PRIME)
    x1, x0 = x >> np.uint64(31), x & _M
    middle, low = x1 * c0 + x0 * c1, x0 * c0
    middle = (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31))
    return fold(np.uint64(2) * x1 * c1 + middle + (low & _P) + (low >> np.uint64(61)))


def _fold_small(x: np.ndarray) -> np.ndarray:
    """Modulo 2 ** 31 - 1, for x below 2 ** 62."""
    x = (x & _M) + (x >> np.uint64(31))
    x = (x & _M) + (x >> np.uint64(31))
    return np.where(x >= _M, x - _M, x)


def _powers(n: int) -> np.ndarray:
    """The first n powers of the word point, doubled until there are enough."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, times(out, pow(WORD_POINT, len(out), PRIME))])
    return out[:n]


_TABLE = _powers(256)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin (one more entry than texts)."""
    data = b" ".join(texts)
    text_at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    hashes, begins, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        end = _SPACE.search(data, at + PIECE) if at + PIECE < len(data) else None  # pieces end where a word does
        end = end.start() if end else len(data)
        found, begin = _hash_piece(np.frombuffer(data, np.uint8, end - at, at))
        hashes.append(found)
        begins.append(begin + at)
        at = end
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), text_at)


def _hash_piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a piece's words and their first bytes' places."""
    solid = ~_SPACES[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = np.flatnonzero(first)
    if not len(begins):
        return np.zeros(0, np.uint64), begins
    return spans_hashed(data[solid], np.flatnonzero(first[solid])), begins


def spans_hashed(letters: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of words that stand one after the other in ``letters`` and begin at ``at``."""
    lengths = np.diff(np.r_[at, len(letters)])
    longest = int(lengths.max())
    if longest > _LONGEST:  # several pieces of a word are put together
        return np.array([_long_word(letters[a : a + n]) for a, n in zip(at.tolist(), lengths.tolist(), strict=True)], np.uint64)
    table = _TABLE if longest <= len(_TABLE) else _powers(longest)
    powers = table[np.arange(len(letters)) - np.repeat(at, lengths)]
    letters = letters.astype(np.uint64) + np.uint64(1)
    high = fold(np.add.reduceat(letters * (powers >> np.uint64(30)), at))
    low = np.add.reduceat(letters * (powers & np.uint64((1 << 30) - 1)), at)
    high = ((high & _M) << np.uint64(30)) + (high >> np.uint64(31))  # times 2 ** 30
    return mix(fold(high + fold(low)))


def _long_word(letters: np.ndarray) -> int:
    total, table = 0, _powers(min(len(letters), _LONGEST))
    for at in range(0, len(letters), _LONGEST):
        part = letters[at : at + _LONGEST].astype(np.uint64) + np.uint64(1)
        high, low = (int((part * x).sum()) for x in (table[: len(part)] >> np.uint64(30), table[: len(part)] & np.uint64((1 << 30) - 1)))
        total = (total + ((high << 30) + low) * pow(WORD_POINT, at, PRIME)) % PRIME
    return int(mix(np.array([total], np.uint64))[0])


def _windows(words: np.ndarray, width: int, product, reduce, point: int, prime: int) -> np.ndarray:
    """Sum of word * point ** place over each window, put together from windows of 1, 2, 4, ... words."""
    n = len(words) - width + 1
    out = np.empty(max(0, n), np.uint64)
    for at in range(0, n, _CHUNK):
        m = min(_CHUNK, n - at)
        part, size, done, total = reduce(words[at : at + m + width - 1]), 1, 0, None
        while True:
            if width & size:
                piece = part[done : done + m]
                total = piece if total is None else reduce(total + product(piece, pow(point, done, prime)))
                done += size
            if 2 * size > width:
                break
            part = reduce(part[:-size] + product(part[size:], pow(point, size, prime)))
            size *= 2
        out[at : at + m] = total
    return out


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each window of ``width`` words."""
    return mix(_windows(words, width, times, fold, WINDOW_POINT, PRIME))


def checks(words: np.ndarray, width: int) -> np.ndarray:
    """31 further bits of each window, from other bits of the words at another point of another prime."""
    small = mix(words ^ np.uint64(0xD6E8FEB86659FD93))
    return _windows(small >> np.uint64(2), width, lambda x, c: _fold_small(x * np.uint64(c)), _fold_small, CHECK_POINT, SMALL_PRIME).astype(np.uint32)


def window_hashes(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, check, text number and first word of every window that lies within one text."""
    words, at = word_hashes(texts)
    counts = np.maximum(np.diff(at) - width + 1, 0)
    text = np.repeat(np.arange(len(texts)), counts)
    start = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(text):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), text, start
    place = at[text] + start
    return rolling(words, width)[place], checks(words, width)[place], text, start
