"""Arrays in the shared folder: written by tasks, memory-mapped by workers."""

from __future__ import annotations

import uuid

import numpy as np


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array under a name of its own and move it in place, so that a task run twice does no harm."""
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(array).tobytes())
    system.move(part, f"{path}/{name}")


def load(folder: str, name: str, kind) -> np.ndarray:
    """A written array: mapped where the shared folder is mounted, else read.  Mapping ends with the array."""
    from pyarrow import fs

    system, path = _open(folder)
    if isinstance(system, fs.LocalFileSystem):
        import os

        return np.memmap(f"{path}/{name}", dtype=kind, mode="r") if os.path.getsize(f"{path}/{name}") else np.zeros(0, kind)
    with system.open_input_stream(f"{path}/{name}") as f:
        return np.frombuffer(f.read(), kind)


class HashArrays:
    """Columns of counts beside sorted 64-bit hashes, in 2 ** ``bits`` range shards.

    A shard is cut into buckets by the bits after the shard's own; a hash is stored as the 40 bits after those, so that it
    takes 5 bytes and a share of the buckets' offsets.  Narrow columns are stored in a byte; greater values stand apart.
    """

    REST = 40
    #: Hashes of a bucket, as a power of two.
    FILL = 3

    def __init__(self, folder: str, kind: str, bits: int, columns: dict[str, str]):
        self.folder, self.kind, self.bits, self.columns = folder, kind, bits, columns

    def _name(self, shard: int, column: str) -> str:
        return f"{self.kind}-{shard}-{column}"

    def _rest(self, keys: np.ndarray, buckets: int) -> np.ndarray:
        return keys << np.uint64(self.bits + buckets) >> np.uint64(64 - self.REST)

    def save(self, shard: int, keys: np.ndarray, values: dict[str, np.ndarray]) -> None:
        buckets = max(0, len(keys).bit_length() - self.FILL)
        rest = self._rest(keys, buckets)
        begin = np.searchsorted(_bucket(keys, self.bits, buckets), np.arange((1 << buckets) + 1))
        save(self.folder, self._name(shard, "begin"), begin.astype(np.uint32))
        save(self.folder, self._name(shard, "high"), (rest >> np.uint64(8)).astype(np.uint32))
        save(self.folder, self._name(shard, "low"), rest.astype(np.uint8))
        for c, kind in self.columns.items():
            v = values[c]
            if kind == "u1":
                large = np.flatnonzero(v > 254)
                save(self.folder, self._name(shard, f"{c}-at"), large.astype(np.uint32))
                save(self.folder, self._name(shard, f"{c}-large"), v[large].astype(np.uint64))
                v = np.minimum(v, 255)
            save(self.folder, self._name(shard, c), v.astype(kind))

    def find(self, keys: np.ndarray, present: frozenset[int]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Which of some sorted hashes are there, and their values (0 where absent).  One shard is open at a time."""
        found, out = np.zeros(len(keys), bool), {c: np.zeros(len(keys), np.uint64) for c in self.columns}
        edges = np.searchsorted(shard_of(keys, self.bits), np.arange((1 << self.bits) + 1))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            if s in present:
                part = slice(edges[s], edges[s + 1])
                place, hit = self._search(s, keys[part])
                found[part] = hit
                for c, kind in self.columns.items():
                    v = load(self.folder, self._name(s, c), kind)[place].astype(np.uint64)
                    if kind == "u1" and (v == 255).any():
                        at, large = load(self.folder, self._name(s, f"{c}-at"), "u4"), load(self.folder, self._name(s, f"{c}-large"), "u8")
                        v[v == 255] = large[np.searchsorted(at, place[v == 255])]
                    out[c][part] = np.where(hit, v, 0)
        return found, out

    def _search(self, shard: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes in a shard, and whether they are there."""
        begin = load(self.folder, self._name(shard, "begin"), "u4")
        high, low = load(self.folder, self._name(shard, "high"), "u4"), load(self.folder, self._name(shard, "low"), "u1")
        if not len(high):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        buckets = (len(begin) - 1).bit_length() - 1
        bucket, rest = _bucket(keys, self.bits, buckets), self._rest(keys, buckets)
        at, end = begin[bucket].astype(np.int64), begin[bucket + 1].astype(np.int64)
        stored = lambda i: high[i].astype(np.uint64) << np.uint64(8) | low[i]
        last = end
        for _ in range(int((end - at).max(initial=0)).bit_length()):
            middle = (at + end) >> 1
            less = (at < end) & (stored(np.minimum(middle, len(high) - 1)) < rest)
            at, end = np.where(less, middle + 1, at), np.where(less, end, middle)
        place = np.minimum(at, len(high) - 1)
        return place, (at < last) & (stored(place) == rest)


def _bucket(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    return (keys << np.uint64(bits) >> np.uint64(64 - buckets)).astype(np.int64) if buckets else np.zeros(len(keys), np.int64)


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """Range shard: the first bits."""
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
