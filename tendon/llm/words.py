"""Words of whole texts, found and hashed in blocks of bytes.

A word is a run of bytes other than the ASCII white space \\x20 and \\x09-\\x0D. UTF-8 keeps those bytes for
these characters alone, so runs of bytes are runs of code points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes of texts handled at a time.
CHUNK = 1 << 22
#: Words of more bytes are hashed one by one.
LONG = 256

_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    """Words of some texts: byte ranges in ``data``; text i has words first[i] to first[i + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_ids(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.offsets])

    def hashes(self, table: np.ndarray = LOWER) -> np.ndarray:
        """64-bit hashes of the words, after ``table`` is applied to each byte.

        Eight bytes at a time go through a bijection; words of up to eight bytes and one length never share a hash.
        """
        sizes = self.ends - self.starts
        padded = np.concatenate([table[self.data], np.zeros(8, np.uint8)])
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        out = mix(sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = np.flatnonzero(sizes <= LONG)
        done = 0
        while len(at):
            part = eight[self.starts[at] + done] & _KEEP[np.minimum(sizes[at] - done, 8)]
            out[at] = mix(out[at] ^ mix(part + np.uint64(done)))
            done += 8
            at = at[sizes[at] > done]
        for i in np.flatnonzero(sizes > LONG):
            out[i] = xxhash.xxh64_intdigest(padded[self.starts[i] : self.ends[i]].tobytes())
        return out

    def codes(self, table: np.ndarray = SAME) -> np.ndarray:
        """Numbers of the words, equal for equal words alone: words that share a hash are compared by their bytes."""
        key = self.hashes(table)
        order = np.argsort(key, kind="stable")
        same = np.diff(key[order]) == 0
        code = np.empty(len(key), np.int64)
        code[order] = np.concatenate([[0], np.cumsum(~same)]) if len(key) else []
        one, two = order[:-1][same], order[1:][same]
        sizes = self.ends - self.starts
        unlike = sizes[one] != sizes[two]
        for lo in range(0, len(one), 1 << 16):
            a, b = one[lo : lo + (1 << 16)], two[lo : lo + (1 << 16)]
            n = np.minimum(sizes[a], sizes[b])
            ends = np.cumsum(n)
            step = np.arange(ends[-1]) - np.repeat(ends - n, n)
            left, right = np.repeat(self.starts[a], n) + step, np.repeat(self.starts[b], n) + step
            unlike[lo : lo + len(a)] |= np.add.reduceat(table[self.data[left]] != table[self.data[right]], ends - n) > 0
        if unlike.any():  # tell the words with these hashes apart one by one
            known: dict[bytes, int] = {}
            low = len(key)
            for i in np.flatnonzero(np.isin(key, key[one[unlike]])):
                code[i] = known.setdefault(table[self.data[self.starts[i] : self.ends[i]]].tobytes(), low + len(known))
        return code


def words_of(column: pa.Array) -> Words:
    """Words of a string column; a null text has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = (np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8))[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~WHITE[data]
    fresh, last = inside.copy(), inside.copy()
    fresh[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    if len(data):
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        fresh[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def chunks(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK):
    """Slices of a batch whose texts hold about ``most`` bytes, or one longer text."""
    sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end
