"""What the two substring operators share: gathering the windows of a corpus that may also start elsewhere.

Every window of `window` units (bytes or words) picks an anchor: its k-gram of least hash, the first of equals. Equal
windows pick equal anchors. A run of starts with the same anchor is one segment, and a segment with its anchor's hash and
its own hash is all that is shuffled for most texts. Segments whose anchor occurs once are done. Of every other kind of
segment (anchor and own hash) one text is fetched, and a second one if there is one: whether a start repeats is decided by
the operator's own method, which compares the texts of all kinds of an anchor in one task. An anchor with more than `hot`
kinds would overfill a task: its segments are taken as texts of their own and cut anew by longer grams, at last by whole
windows, so that they are dealt to many tasks and go through the same comparison.

Results depend on a text alone, so they are kept by text (128 bits) and copies are one entry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm.common import Scratch, text_keys
from countloom.llm.words import SPACE, U, Words, byte_values, eights_of, mix, piece_hash, prefix_sums, slices, sliding_first_min, span_hash

PIECE = 1 << 21
KEYS = ["t1", "t2"]


def units(data: np.ndarray, off: np.ndarray, by: str) -> tuple[np.ndarray, np.ndarray, Words | None]:
    """A number for each unit of a slice, and where each text's units begin."""
    if by == "bytes":
        return byte_values(data), off, None
    w = Words(data, off, SPACE)
    return w.hashes(), w.first, w


def span_of(data: np.ndarray, x: np.ndarray, by: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Hashes of spans of units."""
    pieces = eights_of(data) if by == "bytes" else x
    return lambda start, stop: piece_hash(pieces, start, stop, 8 if by == "bytes" else 1)


def segments(x: np.ndarray, first: np.ndarray, window: int, k: int, own_hash: Callable) -> dict[str, np.ndarray]:
    """The segments of a slice: text number, anchor's hash, own hash, first start, number of starts."""
    out: dict[str, list] = {c: [] for c in ("text", "ah", "sh", "p", "n")}
    for base in range(0, max(len(x) - window + 1, 0), PIECE):
        part = x[base : base + PIECE + window - 1]
        sums = prefix_sums(part)
        at = np.arange(len(part) - k + 1)
        grams = span_hash(sums, at, at + k)
        anchor = sliding_first_min(grams, window - k + 1)
        text = np.searchsorted(first, np.arange(base, base + len(anchor)), "right") - 1
        fits = np.arange(base, base + len(anchor)) + window <= first[text + 1]
        new = fits.copy()
        new[1:] &= ~(fits[:-1] & (anchor[1:] == anchor[:-1]))
        start = np.flatnonzero(new)
        stop_at = fits.copy()
        stop_at[:-1] &= ~(fits[1:] & (anchor[1:] == anchor[:-1]))
        stop = np.flatnonzero(stop_at) + 1
        own = mix(own_hash(start + base, stop + window - 1 + base) + (anchor[start] - start).astype(U) * U(0x9E3779B97F4A7C15))
        for c, v in zip(out, (text[start], grams[anchor[start]], own, start + base - first[text[start]], stop - start), strict=True):
            out[c].append(v)
    kinds = (np.int64, U, U, np.int64, np.int64)
    return {c: np.concatenate(v) if v else np.zeros(0, kind) for (c, v), kind in zip(out.items(), kinds, strict=True)}


def all_segments(docs: DataFrame, by: str, window: int, k: int) -> DataFrame:
    """docs: doc_id, t1, t2, text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in slices(batches):
            x, first, _ = units(data, off, by)
            s = segments(x, first, window, k, span_of(data, x, by))
            of = part.select(["doc_id", *KEYS]).take(pa.array(s["text"]))
            yield pa.RecordBatch.from_arrays([*of.columns, pa.array(s["ah"].view(np.int64)), pa.array(s["sh"].view(np.int64)), pa.array(s["p"]), pa.array(s["n"].astype(np.int32))], ["doc_id", *KEYS, "ah", "sh", "p", "n"])

    return docs.mapInArrow(rows, "doc_id long, t1 long, t2 long, ah long, sh long, p long, n int")


def fetched(docs: DataFrame, by: str, window: int) -> DataFrame:
    """docs: text and wanted, a list of (ah, sh, p, n, which, hot). The bytes of each wanted segment."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in slices(batches):
            w = Words(data, off, SPACE) if by == "words" else None
            lists = part.column(part.schema.get_field_index("wanted"))
            flat = lists.flatten()
            text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            p, n = flat.field("p").to_numpy(), flat.field("n").to_numpy()
            if w is None:
                a = off[text] + p
                b = a + n + window - 1
            else:
                a = w.first[text] + p
                a, b = w.start[a], w.end[a + n + window - 2]
            raw = data.tobytes()
            for i in range(0, len(a), 4096):  # batches of a few MB
                own = [raw[s:t] for s, t in zip(a[i : i + 4096].tolist(), b[i : i + 4096].tolist(), strict=True)]
                few = flat.slice(i, 4096)
                yield pa.RecordBatch.from_arrays([few.field("ah"), few.field("sh"), few.field("which"), few.field("n"), few.field("hot"), pa.array(own, pa.binary())], ["ah", "sh", "which", "n", "hot", "bytes"])

    return docs.select("text", "wanted").mapInArrow(rows, "ah long, sh long, which long, n int, hot boolean, bytes binary")


Compare = Callable[[list[bytes], np.ndarray], np.ndarray]


def runs(mask: np.ndarray, n: np.ndarray, own: list[bytes], by: str, window: int) -> pa.ListArray:
    """Per segment of n starts: the runs (start, length, path) of marked starts; path is a hash of what a run covers."""
    first = np.concatenate([[0], np.cumsum(n)])
    before = np.concatenate([[False], mask[:-1]])
    before[first[:-1]] = False
    after = np.concatenate([mask[1:], [False]])
    after[first[1:] - 1] = False
    start, stop = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    of = np.searchsorted(first, start, "right") - 1
    data = np.frombuffer(b"".join(own), np.uint8)
    x, begin, _ = units(data, np.cumsum([0, *map(len, own)]), by)
    at = begin[of] + start - first[of]
    path = span_of(data, x, by)(at, at + stop - start + window - 1)
    values = pa.StructArray.from_arrays([pa.array(start - first[of]), pa.array(stop - start), pa.array(path.view(np.int64))], ["start", "length", "path"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(n) + 1)), pa.int32()), values)


SPANS = "array<struct<start:long,length:long,path:long>>"


def compared(payload: DataFrame, compare: Compare, limit: int, by: str, window: int) -> DataFrame:
    """compare(bytes, n) marks repeated starts; it sees whole anchors, several up to `limit` bytes or a single one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                ah, sh, n, own = (list(x) for x in zip(*held, strict=True))
                n = np.array(n, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ah, pa.int64()), pa.array(sh, pa.int64()), runs(compare(own, n), n, own, by, window)], ["ah", "sh", "spans"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if size >= limit and held[-1][0] != row[0]:
                    yield from flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        yield from flush()

    dealt = payload.select("ah", "sh", "n", "bytes").repartition("ah").sortWithinPartitions("ah", "sh")
    return dealt.mapInArrow(rows, f"ah long, sh long, spans {SPANS}")


def repeated(docs: DataFrame, scratch: Scratch, by: str, window: int, grams: list[int], compare: Compare, limit: int, hot: int, level: int = 0) -> DataFrame:
    """(t1, t2, path, start, length): for each text, the runs of starts whose windows also start elsewhere; runs are of one
    path if they cover equal words or bytes. docs: doc_id, t1, t2, text; rows of equal t1, t2 have equal texts."""
    name = lambda x: f"{x}{level or ''}"
    every = scratch.save(all_segments(docs, by, window, grams[0]), name("segments"))
    anchors = every.groupBy("ah").agg(F.count("*").alias("all")).where("`all` > 1")
    # a table of its own: a join of two plain exchanges is one that adaptive execution may split at a hot anchor
    anchors = scratch.save(anchors.select("ah"), name("anchors"))
    shared = scratch.save(every.join(anchors, "ah"), name("shared"))
    scratch.drop(name("segments"), name("anchors"))
    turn, place = F.xxhash64("doc_id", "t1", "p"), F.struct("doc_id", "t1", "t2", "p")
    kinds = shared.withColumn("turn", turn).withColumn("place", place).groupBy("ah", "sh").agg(F.count("*").alias("c"), F.min("n").alias("n"), F.min_by("place", "turn").alias("one"), F.max_by("place", "turn").alias("two"))
    kinds = scratch.save(kinds, name("kinds"))
    sizes = kinds.groupBy("ah").agg(F.count("*").alias("kinds"))
    if len(grams) > 1:
        sizes = sizes.withColumn("hot", F.col("kinds") > hot)
    else:  # whole windows: an anchor has one kind, unless hashes collide
        sizes = sizes.withColumn("hot", F.lit(False))
    sizes = scratch.save(sizes, name("sizes"))
    # a kind that occurs once, of an anchor without any other, cannot repeat
    asked = kinds.join(sizes, "ah").where("kinds > 1 OR c > 1")
    both = F.when(F.col("c") > 1, F.array("one", "two")).otherwise(F.array("one"))
    asked = asked.select("ah", "sh", "n", "hot", F.posexplode(both).alias("which", "place")).select("ah", "sh", "n", "hot", F.col("which").cast("long").alias("which"), "place.*")
    wanted = asked.groupBy("doc_id", "t1", "t2").agg(F.collect_list(F.struct("ah", "sh", "p", "n", "which", "hot")).alias("wanted"))  # at most a text's segments, twice
    wanted = wanted.select(F.col("doc_id").alias("d"), F.col("t1").alias("w1"), F.col("t2").alias("w2"), "wanted")
    met = docs.join(wanted, (F.col("t1") == F.col("w1")) & (F.col("t2") == F.col("w2")) & F.col("doc_id").eqNullSafe(F.col("d")))
    payload = scratch.save(fetched(met, by, window), name("payload"))
    found = compared(payload.where("not hot"), compare, limit, by, window).where(F.size("spans") > 0).dropDuplicates(["ah", "sh"])
    if not payload.where("hot").isEmpty():
        again = payload.where("hot").select(F.col("which").alias("doc_id"), F.col("ah").alias("t1"), F.col("sh").alias("t2"), F.col("bytes").alias("text"))
        finer = repeated(again, scratch, by, window, grams[1:], compare, limit, hot, level + 1)
        finer = finer.groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "length", "path")).alias("spans"))  # at most a segment's starts
        found = found.unionByName(finer.select(F.col("t1").alias("ah"), F.col("t2").alias("sh"), "spans"))
    found = scratch.save(found, name("found"))
    scratch.drop(name("payload"), name("kinds"), name("sizes"))
    spans = shared.select("ah", "sh", *KEYS, "p").distinct().join(found, ["ah", "sh"]).select("ah", "sh", *KEYS, "p", F.explode("spans").alias("s"))
    return spans.select(*KEYS, "s.path", (F.col("p") + F.col("s.start")).alias("start"), F.col("s.length").alias("length"))


def finer_grams(window: int, k: int) -> list[int]:
    """Grams to cut by: the first, a longer one for hot anchors, and whole windows."""
    return [k, max(k, window * 3 // 4), window]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *text_keys(F.col("text")), "text")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with `spans`, a list of (start, length) of each text, null if it has none."""
    lists = spans.groupBy(*KEYS).agg(F.collect_list(F.struct("start", "length")).alias("spans"))  # at most a text's segments
    keys = [F.col(k).alias(f"s{k}") for k in KEYS]
    lists = lists.select(*keys, "spans")
    base = docs.withColumns(dict(zip(("k1", "k2"), [c for c in text_keys(F.col("text"))], strict=True)))
    return base.join(lists, (F.col("k1") == F.col("st1")) & (F.col("k2") == F.col("st2")), "left").drop("k1", "k2", "st1", "st2")


def covered(spans: list[dict] | None, window: int) -> list[tuple[int, int]]:
    """The maximal runs that windows at these starts cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["start"] + s["length"] + window - 1) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out
