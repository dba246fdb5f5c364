"""Whole Arrow batches of texts as numpy arrays: words, hashes, windows. No loop over rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Text bytes that are worked on at once; a longer text is a slice of its own.
SLICE = 1 << 20


def table(pattern_bytes: list[int]) -> np.ndarray:
    """True for the bytes that separate words."""
    out = np.zeros(256, bool)
    out[pattern_bytes] = True
    return out


SPACE = table([0x20, *range(0x09, 0x0E)])
#: All ASCII but digits and letters.
NOT_ALNUM = table([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_P = U(0x9E3779B97F4A7C15 | 1)
_PINV = U(pow(int(_P), -1, 1 << 64))
#: Masks of the first 0 to 8 bytes of eight.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
_pw, _ipw = np.ones(1, U), np.ones(1, U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n."""
    global _pw, _ipw
    while len(_pw) < n:
        k = len(_pw)
        _pw = np.concatenate([_pw, _pw * U(pow(int(_P), k, 1 << 64))])
        _ipw = np.concatenate([_ipw, _ipw * U(pow(int(_PINV), k, 1 << 64))])
    return _pw[:n], _ipw[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of rows with at most `limit` bytes of text or a single row. A null is empty."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column))
        text = pc.fill_null(text.cast(pa.large_binary()), b"")
        off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        i = 0
        while i < len(text):
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def runs_of(texts: list[bytes], limit: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of runs of texts with at most `limit` bytes or a single text."""
    i = 0
    while i < len(texts):
        j, size = i + 1, len(texts[i])
        while j < len(texts) and size + len(texts[j]) <= limit:
            size += len(texts[j])
            j += 1
        yield np.frombuffer(b"".join(texts[i:j]), np.uint8), np.cumsum([0, *map(len, texts[i:j])])
        i = j


class Words:
    """The words of a slice: start and end bytes, and where each text's words begin (`first`, one more than texts)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, gaps: np.ndarray = SPACE, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.gaps, self.off = gaps, off
        solid = ~gaps[self.data]
        before = np.empty(len(data) + 1, bool)
        before[0], before[1:] = False, solid
        before[off] = False  # a text's end ends a word
        self.start = np.flatnonzero(solid & ~before[:-1])
        after = np.empty(len(data) + 1, bool)
        after[-1], after[:-1] = False, solid
        after[off[off < len(data)]] = False
        self.end = np.flatnonzero(solid & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, off)
        self.solid = solid

    def hashes(self) -> np.ndarray:
        """64 bits of each word."""
        return piece_hash(eights_of(self.data), self.start, self.end, 8)


def eights_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))


def piece_hash(x: np.ndarray, start: np.ndarray, stop: np.ndarray, step: int = 1) -> np.ndarray:
    """64 bits of each span start:stop, which must not be empty, the same wherever it stands: its numbers are mixed one by one,
    each with its place, and added. step 8 takes x as eights_of() bytes. A polynomial modulo 2^64 would not do: there are
    sequences on which it is equal whatever the base."""
    size = stop - start
    if not len(size):
        return np.zeros(0, U)
    pieces = -(-size // step)
    place = spread(pieces)
    at = np.repeat(start, pieces) + step * place
    v = x[at]
    if step > 1:
        v = v & _KEEP[np.minimum(np.repeat(stop, pieces) - at, 8)]
    v = mix(v ^ (place.astype(U) + U(1)) * _P)
    return mix(np.add.reduceat(v, np.cumsum(pieces) - pieces) + size.astype(U) * _P)


def prefix_sums(x: np.ndarray) -> np.ndarray:
    """H with H[0] = 0, for span_hash()."""
    out = np.zeros(len(x) + 1, U)
    np.cumsum(x * powers(len(x))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The hash of x[start:stop], the same wherever it stands."""
    return mix((sums[stop] - sums[start]) * powers(len(sums))[1][start] + (stop - start).astype(U))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def sliding_first_min(x: np.ndarray, w: int) -> np.ndarray:
    """For each i with i + w <= len(x): where the least x of x[i:i+w] stands, the first of equals (compared by 40 bits)."""
    n = len(x)
    if n < w:
        return np.zeros(0, np.int64)
    mask = U((1 << 24) - 1)
    if n > int(mask):  # a slice of one very long text
        step = int(mask) - w
        return np.concatenate([sliding_first_min(x[i : i + step + w - 1], w) + i for i in range(0, n - w + 1, step)])
    v = np.full(-(-n // w) * w, np.iinfo(U).max, U)
    v[:n] = (x & ~mask) | np.arange(n, dtype=U)
    v = v.reshape(-1, w)
    right = np.minimum.accumulate(v, axis=1).ravel()
    left = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(left[: n - w + 1], right[w - 1 : n]) & mask).astype(np.int64)


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
