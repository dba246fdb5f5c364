"""Suffix-array dedup: every byte covered by a `window`-byte string that also starts anywhere else is removed.

The starts that can repeat, of copies two of each, are gathered by repeats.py; a start is removed only if the order of
suffixes finds its neighbour. A task sorts the suffixes at its starts in two stages. Suffixes that
are smaller than their successors are sorted directly, by their first `window` bytes. The rest is induced: buckets (first
bytes) are scanned in ascending order, and each sorted suffix hands its predecessor, if that is larger than its
successor, to the predecessor's bucket; the larger suffixes of a bucket come before the smaller ones. A bucket's scan is
a few array operations, not a loop over suffixes; runs of one byte take one wave for each byte. A segment's end counts
as smaller than every byte, and a segment's last start brings along what follows it up to the next directly sorted
suffix. Starts whose common prefix with a neighbour in the order is `window` bytes or more are repeats.

Edge cases: null texts are empty; texts shorter than the window lose nothing; very long texts are cut into pieces of
segments, never shortened; overlaps count; ties and repeated rows and equal texts of at least the window's length are removed
whole; bytes are bytes, a removed run may cut a character (the kept bytes are hashed as they are); rows without an id take
part; an empty table gives an empty result; other columns are not looked at, whatever their names. doc_id must be a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from countloom.llm.common import Scratch
from countloom.llm.repeats import covered, finer_grams, keyed, repeated, with_spans
from countloom.llm.words import slices, spread

WINDOW, GRAM = 400, 48


def suffix_order(own: list[bytes], n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first n starts of each segment, ordered by their first `depth` bytes, and the text they are
    positions in: segments as numbers 1..256, each with a 0 behind it."""
    raw = b"\0".join([*own, b""])
    size = np.array([len(x) for x in own], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    end = begin + size
    t = np.frombuffer(raw, np.uint8).astype(np.int16) + 1
    t[end] = 0
    # smaller than the successor: by the next place where two neighbours differ
    places = np.where(np.append(t[:-1] != t[1:], True), np.arange(len(t)), len(t))
    places = np.minimum.accumulate(places[::-1])[::-1]
    small = np.append(t, -1)[places] < np.append(t, -1)[places + 1]
    small[end] = True
    used = np.zeros(len(t), bool)
    used[np.repeat(begin, n) + spread(n)] = True
    next_small = np.minimum.accumulate(np.where(small, np.arange(len(t)), len(t))[::-1])[::-1]
    last = begin + n - 1
    more = next_small[last] - last  # 0 if the last start is sorted directly
    used[np.repeat(last + 1, more) + spread(more)] = True
    # first stage
    direct = np.flatnonzero(used & small & (t > 0))
    stop = np.minimum(direct + depth, end[np.searchsorted(end, direct)])
    keys = [raw[a:b] for a, b in zip(direct.tolist(), stop.tolist(), strict=True)]
    direct = direct[np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)] if keys else direct
    del keys
    bounds = np.searchsorted(t[direct], np.arange(258))
    # second stage
    larger = used & ~small
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    for c in range(257):
        have = waiting[c]
        if have:
            wave = have[-1] if len(have) == 1 else np.concatenate(have)
            have = [wave]
            while len(wave):
                wave = wave[wave > 0] - 1
                wave = wave[larger[wave] & (t[wave] == c)]
                have.append(wave)
        tail = np.flatnonzero(used & (t == 0)) if c == 0 else direct[bounds[c] : bounds[c + 1]]
        row = np.concatenate([*have, tail])
        if not len(row):
            continue
        out.append(row)
        before = row[row > 0] - 1
        before = before[larger[before] & (t[before] > c)]
        if len(before):
            order = np.argsort(t[before], kind="stable")
            before = before[order]
            cuts = np.flatnonzero(np.diff(t[before])) + 1
            for piece in np.split(before, cuts):
                waiting[t[piece[0]]].append(piece)
    every = np.concatenate(out)
    assert len(every) == used.sum()
    start = np.zeros(len(t), bool)
    start[np.repeat(begin, n) + spread(n)] = True
    return every[start[every]], t


def common_prefixes(order: np.ndarray, t: np.ndarray, depth: int) -> np.ndarray:
    """Of each position with the one before it in the order, at most `depth`; each has `depth` numbers to its end."""
    out = np.zeros(len(order), np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(t.astype(np.uint8), depth)  # 256 turns into 0, which no start's depth holds
    for i in range(1, len(order), 8192):
        a, b = order[i - 1 : i + 8191], order[i : i + 8192]
        differ = rows[a[: len(b)]] != rows[b]
        at = differ.argmax(axis=1)
        out[i : i + 8192] = np.where(differ[np.arange(len(b)), at], at, depth)
    return out


def compare(depth: int):
    def marks(own: list[bytes], n: np.ndarray) -> np.ndarray:
        order, t = suffix_order(own, n, depth)
        same = common_prefixes(order, t, depth) >= depth
        hit = np.zeros(len(t), bool)
        hit[order[same]] = True
        hit[order[np.flatnonzero(same) - 1]] = True
        size = np.array([len(x) for x in own], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        return hit[np.repeat(begin, n) + spread(n)]

    return marks


def removed(docs: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM, limit: int = 768 << 10, hot: int = 4000, with_kept: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed: the runs, kept: the bytes that stay, if asked for)."""
    spans = repeated(keyed(docs), scratch, "bytes", window, finer_grams(window, gram), compare(window), limit, hot)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in slices(batches):
            raw, out = data.tobytes(), []
            for d, s in enumerate(part.column(2).to_pylist()):
                text = raw[off[d] : off[d + 1]]
                cut = covered(s, window)
                kept, last = [], 0
                for a, b in cut:
                    kept.append(text[last:a])
                    last = b
                kept = b"".join([*kept, text[last:]])
                out.append((len(text), len(text) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), [{"start": a, "stop": b} for a, b in cut], *([kept] if with_kept else [])))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=False)]], ["doc_id", *names[: len(cols)]])

    return with_spans(docs.select("doc_id", "text"), spans).select("doc_id", "text", "spans").mapInArrow(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,stop:long>>" + ", kept binary" * with_kept)


def op10_suffixes(spark, sf_dir: str) -> DataFrame:
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark), with_kept=False).drop("removed")
