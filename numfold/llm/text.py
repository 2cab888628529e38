"""Vectorised words and hashes over the flat bytes of an Arrow string column.

A word is a run of bytes outside space and \\t..\\r, which in UTF-8 is the same as
`[^\\x20\\x09-\\x0D]+` over code points. A word has a keyed 128-bit hash in two halves: its
length and its bytes, eight at a time, go through a non-linear mixer, so no two words of up
to eight bytes share a half by construction of their bytes, and repeated halves (as those
that defeat polynomials modulo 2^64) have no effect. Words over LONG bytes take a keyed
cryptographic digest. Sequences of words combine both halves by independent random weights.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LONG = 256
_rng = np.random.Generator(np.random.PCG64(20240229))
KEYS = _rng.integers(1, 2**63, 4, dtype=np.uint64) * U(2) + U(1)
WEIGHTS = _rng.integers(1, 2**63, (2, 64), dtype=np.uint64) * U(2) + U(1)
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
BASES = (0xD1B54A32D192ED03 | 3, 0x8CB92BA72F3D8DD7 | 3)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0..n and its inverses modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 18)
        pair = []
        for b in (base, pow(base, -1, 2**64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            pair.append(np.cumprod(steps, dtype=np.uint64))
        have = _powers[base] = (pair[0], pair[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the keyed hash of byte spans."""
    lane = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    size = end - start
    one, two = (KEYS[k] ^ (size.astype(np.uint64) * KEYS[k + 2]) for k in (0, 1))
    open_ = np.flatnonzero(size <= LONG)
    at, left = start[open_], size[open_]
    while len(open_):
        x = lane[at] & FIRST[np.minimum(left, 8)]
        one[open_] = mix(one[open_] ^ x)
        two[open_] = mix(two[open_] + x * KEYS[2])
        more = left > 8
        open_, at, left = open_[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=16, key=KEYS.tobytes()).digest()
        one[i], two[i] = np.frombuffer(digest, np.uint64)
    return one, two


class Rolling:
    """Hash of any slice of a uint64 sequence from prefix sums."""

    def __init__(self, values: np.ndarray, base: int):
        up, self.down = powers(base, len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h + (end - start).astype(np.uint64) * U(0xA24BAED4963EE407))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])), offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Ranges of at most `rows` documents with about `limit` bytes; always whole documents."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + rows)
        yield lo, hi
        lo = hi


class Words:
    """Words of the documents lo..hi of a flat column: byte spans, hashes, offsets by document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, lower: bool):
        self.off = offsets[lo : hi + 1] - offsets[lo]
        self.data = data[offsets[lo] : offsets[hi]]
        inside = ~SPACE[self.data]
        first, last = inside.copy(), inside.copy()
        if len(inside):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            full = self.off[1:] > self.off[:-1]
            a, b = self.off[:-1][full], self.off[1:][full] - 1
            first[a], last[b] = inside[a], inside[b]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.start, self.off)
        self.hash, self.hash2 = span_hash(LOWER[self.data] if lower else self.data, self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), self.counts)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words that begin at each word but the last k - 1, over document ends."""
        n = max(len(self.hash) - k + 1, 0)
        total = np.full(n, U(k))
        for j in range(k):
            total += self.hash[j : j + n] * WEIGHTS[0, j]
            total += self.hash2[j : j + n] * WEIGHTS[1, j]
        return mix(total)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k-word shingles and offsets by document; a shorter document is one shingle."""
        n = self.counts
        per = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
        so = np.zeros(len(n) + 1, np.int64)
        np.cumsum(per, out=so[1:])
        start = np.arange(so[-1]) - np.repeat(so[:-1] - self.at[:-1], per)
        whole = self.grams(k)
        out = whole[np.minimum(start, len(whole) - 1)] if len(whole) else np.zeros(len(start), np.uint64)
        for m in range(1, k):
            short = np.flatnonzero(n == m)
            if len(short):
                out[so[short]] = self.grams(m)[self.at[short]]
        return out, so


def sorted_distinct(x: np.ndarray) -> np.ndarray:
    """np.unique by sorting, which is several times faster than its hashing for these arrays."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def distinct(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each document, and their offsets."""
    parts = [sorted_distinct(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    out = np.zeros(len(offsets), np.int64)
    np.cumsum([len(p) for p in parts], out=out[1:])
    return (np.concatenate(parts) if parts else hashes[:0]), out


def binaries(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One binary per slice of a contiguous array."""
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * data.itemsize).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
