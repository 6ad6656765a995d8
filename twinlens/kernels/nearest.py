"""The most similar larger images of each small one, by the dot product of their vectors."""

from __future__ import annotations

import numpy as np

#: Numbers in a matrix of similarities.
TILE = 2_000_000


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products row by row, summed from the first number on as the SQL does."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def top_larger(small: np.ndarray, small_area: np.ndarray, large: np.ndarray, large_area: np.ndarray, order: np.ndarray, known: tuple[np.ndarray, np.ndarray], ratio: float, count: int):
    """(rows of small, rows of large, similarity): for each small image the ``count`` most similar of at least ``ratio``
    (over 1) times its area, ties by ``order``; ``known`` has pairs (rows of small, rows of large) to leave out.

    A matrix product, whose sums depend on where a row stands, finds who can be among them; they are summed again.
    """
    by_area = np.argsort(-large_area, kind="stable")
    place = np.empty(len(by_area), np.int64)
    place[by_area] = np.arange(len(by_area))
    large, order, falling = large[by_area].astype(np.float64), order[by_area], -large_area[by_area].astype(np.float64)
    todo = np.flatnonzero(small_area > 0)
    todo = todo[np.argsort(small_area[todo], kind="stable")]
    reach = np.searchsorted(falling, -(ratio * small_area[todo].astype(np.float64)), "right")
    todo, reach = todo[reach > 0], reach[reach > 0]
    by_small = np.argsort(known[0], kind="stable")
    known_small, known_large = known[0][by_small], place[known[1][by_small]]
    norm = np.sqrt(np.max(np.einsum("ij,ij->i", large, large), initial=0))
    found, at = [], 0
    while at < len(todo):
        wide = reach[at]  # the smallest image of the tile reaches farthest
        rows = todo[at : at + max(1, TILE // wide)]
        mine = small[rows].astype(np.float64)
        near = mine @ large[:wide].T
        near[np.arange(wide) >= reach[at : at + len(rows), None]] = -np.inf
        first, last = np.searchsorted(known_small, rows, "left"), np.searchsorted(known_small, rows, "right")
        for r in np.flatnonzero(last > first):
            out = known_large[first[r] : last[r]]
            near[r, out[out < wide]] = -np.inf
        at += len(rows)
        slack = 4 * (small.shape[1] + 1) * np.finfo(float).eps * norm * np.sqrt(np.einsum("ij,ij->i", mine, mine))
        least = np.partition(near, wide - count, axis=1)[:, wide - count] - slack if wide > count else np.full(len(rows), -np.inf)
        r, c = np.nonzero((near >= least[:, None]) & (near > -np.inf))
        exact = np.concatenate([_dots(mine[r[k : k + 100_000]], large[c[k : k + 100_000]]) for k in range(0, len(r), 100_000)] or [np.zeros(0)])
        ranked = np.lexsort((order[c], -exact, r))
        r, c, exact = r[ranked], c[ranked], exact[ranked]
        kept = np.arange(len(r)) - np.searchsorted(r, r, "left") < count
        found.append((rows[r[kept]], by_area[c[kept]], exact[kept]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
