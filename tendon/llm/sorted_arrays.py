"""Sorted hash arrays: shards of 64-bit keys with columns beside them, written once by tasks and memory-mapped by others.

A shard holds the keys with the same leading bits, so the shards in order are one sorted array. There are at least as
many shards as shuffle partitions; a task holds one shard at a time.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tendon.llm.shared import mapped_path, put_file

#: Distinct keys that a task gathers before it sends them on.
GATHER = 1_500_000


def shard_bits(partitions: int) -> int:
    return max(1, (max(partitions, 2) - 1).bit_length())


def shard_bounds(bits: int) -> np.ndarray:
    """The first key of each shard."""
    return np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)


def write_column(folder: str, name: str, shard: int, values: np.ndarray) -> None:
    out = io.BytesIO()
    np.save(out, values)
    put_file(f"{folder}/{name}-{shard:06d}.npy", out.getvalue())


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their counts."""
    keys = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.uint64)
    counts = np.concatenate([p[1] for p in parts]).astype(np.int64) if parts else np.empty(0, np.int64)
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


SENT = "shard long, keys binary, counts binary"


def sent(keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """One row per shard that has some of the sorted keys."""
    cut = np.append(np.searchsorted(keys, shard_bounds(bits)), len(keys))
    some = np.flatnonzero(np.diff(cut))
    small = counts.astype(np.uint32) if not len(counts) or counts.max() < 2**32 else counts.astype(np.uint64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(some),
            pa.array([keys[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()),
            pa.array([small[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()),
        ],
        ["shard", "keys", "counts"],
    )


def counted(found: Iterator[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Counts of the keys in a task's arrays, gathered before they are sent to their shards."""
    parts, held = [], 0
    for keys in found:
        one, n = np.unique(keys, return_counts=True)
        parts.append((one, n))
        held += len(one)
        if held > GATHER:
            parts = [summed(parts)]
            held = len(parts[0][0])
            if held > GATHER / 2:
                yield sent(*parts[0], bits)
                parts, held = [], 0
    if parts:
        yield sent(*summed(parts), bits)


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Shard by shard, what tasks have sent; the rows must be sorted by shard."""
    now, parts = None, []
    for batch in batches:
        for shard, keys, counts in zip(*(batch.column(i) for i in range(3))):
            k = np.frombuffer(keys.as_buffer(), np.uint64)
            c = np.frombuffer(counts.as_buffer(), np.uint32 if len(counts.as_buffer()) == 4 * len(k) else np.uint64)
            if now is not None and shard.as_py() != now:
                yield now, parts
                parts = []
            now = shard.as_py()
            parts.append((k.copy(), c.copy()))
    if now is not None:
        yield now, parts


def dealt(rows: DataFrame, partitions: int) -> DataFrame:
    """Rows of the same shard in one task, shard after shard."""
    return rows.repartition(partitions, "shard").sortWithinPartitions("shard")


class Mapped:
    """Reads shards through memory maps; ``sizes`` has the number of keys of each shard."""

    def __init__(self, folder: str, sizes: list[int], key: str = "key"):
        self.folder, self.sizes, self.key = folder, sizes, key
        self.bits = shard_bits(len(sizes))
        self.before = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self._open: dict[tuple[str, int], np.ndarray] = {}

    def __reduce__(self):
        return Mapped, (self.folder, self.sizes, self.key)

    def shard(self, name: str, shard: int) -> np.ndarray:
        at = (name, shard)
        if at not in self._open:
            self._open[at] = np.load(mapped_path(f"{self.folder}/{name}-{shard:06d}.npy"), mmap_mode="r")
        return self._open[at]

    def _cuts(self, sorted_values: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
        cut = np.append(np.searchsorted(sorted_values, bounds), len(sorted_values))
        for i in np.flatnonzero(np.diff(cut)):
            yield int(i), int(cut[i]), int(cut[i + 1])

    def positions(self, keys: np.ndarray) -> np.ndarray:
        """Places of sorted keys in the whole array; -1 where a key isn't there."""
        out = np.full(len(keys), -1, np.int64)
        for i, lo, hi in self._cuts(keys, shard_bounds(self.bits)):
            if self.sizes[i]:
                have = self.shard(self.key, i)
                at = np.minimum(np.searchsorted(have, keys[lo:hi]), len(have) - 1)
                out[lo:hi] = np.where(have[at] == keys[lo:hi], at + self.before[i], -1)
        return out

    def values(self, name: str, places: np.ndarray, dtype: type = np.int64) -> np.ndarray:
        """A column at places that rise apart from those that are -1, where it is 0."""
        known = np.flatnonzero(places >= 0)
        out, found, at = np.zeros(len(places), dtype), np.zeros(len(known), dtype), places[known]
        for i, lo, hi in self._cuts(at, self.before[:-1]):
            if self.sizes[i]:
                found[lo:hi] = self.shard(name, i)[at[lo:hi] - self.before[i]]
        out[known] = found
        return out
