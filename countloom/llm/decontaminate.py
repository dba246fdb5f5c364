"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

Words are runs of ASCII letters and digits and of all non-ASCII bytes, A-Z lower-cased. The automaton holds every run of
words of every item; each state knows the items it occurs in. A document's words stream through it: the state and the
matching length say how long the longest run is that ends at a word and stands in an item. A run of `window` words of an
item, or an item of fewer words, whole, is a window; the words of its occurrences are hit. Words that no item has end
every match, so only the stretches between them that are as long as the shortest window enter the automaton.

An automaton holds at most `items_limit` bytes of item text (or one item) and is built in one task; its size follows the
benchmark, not the corpus. More items than that are several groups: each is built, sent and worked off in a pass of its own,
so that a task holds one automaton at a time. The passes leave the texts that are hit, with places and items, and these meet
the documents in one join. Words are numbered by a hash, and the bytes of hit words are compared with the items'.

Edge cases: null and empty texts and items have no words; items without words have no windows; very long texts are streamed
whole; repeated documents are judged alike; repeated items count by their id; null item ids are left out of items_sha256's list
and count as one item; an empty benchmark hits nothing; an empty table gives an empty result; other columns are not looked at
and stay, whatever their names. doc_id must be a long.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countloom.llm.common import Scratch, fitted, running, text_keys
from countloom.llm.words import NOT_ALNUM, Words, slices

WINDOW = 10


class Automaton:
    """Generalised suffix automaton over word numbers. next, link, size by state; state 0 is the root."""

    def __init__(self, items: list[list[int]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.window = [-1], [0], window
        ends: list[set[int]] = [set()]
        #: state -> items that are a whole window shorter than `window` and end there
        self.short: dict[int, set[int]] = {}
        tails = []
        for number, words in enumerate(items):
            at = 0
            for w in words:
                at = self._grow(at, w, ends)
                ends[at].add(number)
            if 0 < len(words) < window:
                tails.append((number, words))
        for state in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            if self.size[self.link[state]] >= window:  # shorter runs are never asked for
                ends[self.link[state]] |= ends[state]
        self.items = [frozenset(x) if n >= window else frozenset() for x, n in zip(ends, self.size, strict=True)]
        for number, words in tails:
            at = 0
            for w in words:
                at = self.next[at][w]
            self.short.setdefault((at, len(words)), set()).add(number)
        self.least = min((min(len(x), window) for x in items if x), default=0)

    def _grow(self, last: int, w: int, ends: list[set[int]]) -> int:
        nxt, link, size = self.next, self.link, self.size
        if w in nxt[last]:
            q = nxt[last][w]
            return q if size[q] == size[last] + 1 else self._split(last, w, q, ends)
        new = len(size)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        ends.append(set())
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if size[q] == size[p] + 1 else self._split(p, w, q, ends)
        return new

    def _split(self, p: int, w: int, q: int, ends: list[set[int]]) -> int:
        nxt, link, size = self.next, self.link, self.size
        copy = len(size)
        nxt.append(dict(nxt[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        ends.append(set())
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int], list[int]]:
        """Hit spans (start, stop) of the words, the items of the windows that occur, and the longest matching lengths."""
        nxt, link, size, window, short = self.next, self.link, self.size, self.window, self.short
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        lengths = []
        at = n = 0
        for i, w in enumerate(words):
            while at and w not in nxt[at]:
                at = link[at]
                n = size[at]
            if w in nxt[at]:
                at = nxt[at][w]
                n += 1
            lengths.append(n)
            s = at
            if n >= window:
                while size[link[s]] >= window:
                    s = link[s]
                items |= self.items[s]
                spans.append((i + 1 - window, i + 1))
            if short:
                s = at
                while s > 0:
                    for k in range(size[link[s]] + 1, min(size[s], n, window - 1) + 1):
                        if (s, k) in short:
                            items |= short[s, k]
                            spans.append((i + 1 - k, i + 1))
                    s = link[s]
        return spans, items, lengths


class Matcher:
    """Automaton, the vocabulary's hashes (sorted) and words, and the items' ids."""

    def __init__(self, ids: list, texts: list[str | None], window: int = WINDOW):
        raw = [(t or "").encode() for t in texts]
        off = np.cumsum([0, *map(len, raw)])
        w = Words(np.frombuffer(b"".join(raw), np.uint8), off, NOT_ALNUM, lower=True)
        self.vocabulary, one, number = np.unique(w.hashes(), return_index=True, return_inverse=True)
        self.words = [w.data[a:b].tobytes() for a, b in zip(w.start[one].tolist(), w.end[one].tolist(), strict=True)]
        self.automaton = Automaton([number[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:], strict=True)], window)
        self.ids = ids

    def slice(self, data: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray, list[set[int]]]:
        """A slice's words, which of them are hit, and the numbers of the items found by text."""
        w = Words(data, off, NOT_ALNUM, lower=True)
        hit, items = np.zeros(len(w.start), bool), [set() for _ in range(len(off) - 1)]
        if not len(w.start) or not self.automaton.least:
            return w, hit, items
        h = w.hashes()
        number = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = self.vocabulary[number] == h
        edge = np.zeros(len(h) + 1, np.int8)
        edge[1:-1] = known[1:].astype(np.int8) - known[:-1]
        edge[0], edge[-1] = known[0], -int(known[-1])
        cut = w.first[(w.first > 0) & (w.first < len(h))]
        cut = cut[known[cut] & known[cut - 1]]  # a stretch ends with its text
        starts = np.sort(np.concatenate([np.flatnonzero(edge == 1), cut]))
        stops = np.sort(np.concatenate([np.flatnonzero(edge == -1), cut]))
        long = stops - starts >= self.automaton.least
        starts, stops = starts[long], stops[long]
        docs = np.searchsorted(w.first, starts, "right") - 1
        for a, b, d in zip(starts.tolist(), stops.tolist(), docs.tolist(), strict=True):
            own = number[a:b].tolist()
            spans, found, _ = self.automaton.stream(own)
            other = [i for i in {i for x, y in spans for i in range(x, y)} if w.data[w.start[a + i] : w.end[a + i]].tobytes() != self.words[own[i]]]
            if other:  # words of equal hashes: they are none of the items'
                for i in other:
                    own[i] = -1
                spans, found, _ = self.automaton.stream(own)
            if spans:
                items[d] |= found
                for x, y in spans:
                    hit[a + x : a + y] = True
        return w, hit, items


def runs_of_marks(marks: np.ndarray) -> list[dict[str, int]]:
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return [{"start": int(x), "stop": int(y)} for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def groups_of(benchmark: DataFrame, items_limit: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """The items (group, item_id, text) in groups of about `items_limit` bytes of text, and their number; repeated items
    once."""
    once = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.octet_length("text") > 0).distinct()
    size, rows = once.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.count("*")).first()
    n = max(1, -(-size // items_limit))
    if n == 1:
        return once.withColumn("group", F.lit(0).cast("long")), 1
    placed = running(once, [], ["item_id", "text"], F.octet_length("text"), "before", rows)
    return scratch.save(placed.select(F.floor(F.col("before") / items_limit).cast("long").alias("group"), "item_id", "text"), "items"), n


def sent_matcher(items: DataFrame, window: int):
    """A broadcast of the pickled automaton of some items, which one task builds; None for none."""

    def build(table: pa.Table) -> bytes:
        t = table.sort_by([("item_id", "ascending"), ("text", "ascending")])
        return pickle.dumps(Matcher(t.column("item_id").to_pylist(), t.column("text").to_pylist(), window))

    made = fitted(items.select("item_id", "text"), build)
    return None if made is None else items.sparkSession.sparkContext.broadcast(made)


_held: dict = {}


def matcher_of(sent) -> Matcher:
    """The automaton of a broadcast, unpacked once in a worker; the one before it is let go."""
    if sent.value is not _held.get("from"):
        _held.clear()
        _held.update({"from": sent.value, "matcher": pickle.loads(sent.value)})
    return _held["matcher"]


FOUND = "hits array<struct<start:long,stop:long>>, items array<string>"


def matched(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None, kernel, schema: str | T.StructType, window: int = WINDOW, items_limit: int = 2 << 20) -> DataFrame:
    """kernel(rows, words, hit, items by text) over docs; items hold ids as strings. A pass for each group of items."""
    scratch = scratch or Scratch(docs.sparkSession)
    items, n = groups_of(benchmark, items_limit, scratch)
    if n == 1:
        sent = sent_matcher(items, window)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, data, off in slices(batches):
                if sent is None:
                    words = Words(data, off, NOT_ALNUM, lower=True)
                    hit, found, ids = np.zeros(len(words.start), bool), [set() for _ in off[1:]], []
                else:
                    m = matcher_of(sent)
                    ids = m.ids
                    words, hit, found = m.slice(data, off)
                yield kernel(part, words, hit, [{ids[x] for x in f} for f in found])

        return docs.mapInArrow(rows, schema)

    keys = text_keys(F.col("text"), ("__t1", "__t2"))
    texts, parts = docs.select(*keys, "text"), []
    for g in range(n):
        sent = sent_matcher(items.where(F.col("group") == g), window)
        if sent is None:
            continue

        def hits(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part, data, off in slices(batches):
                m = matcher_of(sent)
                words, hit, found = m.slice(data, off)
                at = [d for d, f in enumerate(found) if f]
                marks = [runs_of_marks(hit[words.first[d] : words.first[d + 1]]) for d in at]
                ids = [[m.ids[x] for x in found[d]] for d in at]
                few = part.select([0, 1]).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*few.columns, pa.array(marks, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(ids, pa.list_(pa.string()))], ["t1", "t2", "hits", "items"])

        parts.append(scratch.save(texts.mapInArrow(hits, f"t1 long, t2 long, {FOUND}"), f"hits{g}"))
        sent.unpersist()
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    once = every.groupBy(F.col("t1").alias("__u1"), F.col("t2").alias("__u2")).agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("__hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("__items"))
    both = docs.withColumns(dict(zip(("__t1", "__t2"), text_keys(F.col("text")), strict=True)))
    both = both.join(once, (F.col("__t1") == F.col("__u1")) & (F.col("__t2") == F.col("__u2")), "left").drop("__t1", "__t2", "__u1", "__u2")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in slices(batches):
            words = Words(data, off, NOT_ALNUM, lower=True)
            hit, last = np.zeros(len(words.start), bool), part.num_columns - 2
            for d, spans in enumerate(part.column(last).to_pylist()):
                for s in spans or ():
                    hit[words.first[d] + s["start"] : words.first[d] + s["stop"]] = True
            found = [set(f or ()) for f in part.column(last + 1).to_pylist()]
            yield kernel(part.select(list(range(last))), words, hit, found)

    return both.mapInArrow(joined, schema)


def report(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None, **how) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans): spans are the hit words' runs."""

    def kernel(part, words, hit, items):
        n = np.diff(words.first)
        sums = np.concatenate([[0], np.cumsum(hit)])
        n_hit = sums[words.first[1:]] - sums[words.first[:-1]]
        spans = [[] for _ in items]
        for d in np.flatnonzero(n_hit):
            spans[d] = runs_of_marks(hit[words.first[d] : words.first[d + 1]])
        names = [",".join(sorted(x for x in i if x is not None)) for i in items]
        return pa.RecordBatch.from_arrays([
            part.column(0), pa.array(n), pa.array(n_hit), pa.array([len(i) for i in items], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in names]), pa.array(n_hit > 0),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    return matched(docs.select("doc_id", "text"), benchmark, scratch, kernel, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,stop:long>>", **how)


def cleaned(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None, most: float = 0.5, **how) -> DataFrame:
    """docs without hit words: each run of hit words is cut from its first byte to its last; a document of which more
    than the share `most` of the words is hit goes whole. n_chars, if there is one, is counted anew. Documents without
    hits stay as they are."""
    names, schema = docs.columns, docs.schema

    def kernel(part, words, hit, items):
        sums = np.concatenate([[0], np.cumsum(hit)])
        n_hit = sums[words.first[1:]] - sums[words.first[:-1]]
        keep = n_hit <= most * np.diff(words.first)
        at = names.index("text")
        texts = part.column(at).to_pylist() if n_hit.any() else None
        if texts:
            for d in np.flatnonzero((n_hit > 0) & keep):
                a, b = words.first[d], words.first[d + 1]
                raw, out, base = texts[d].encode(), [], words.off[d]
                last = 0
                for run in runs_of_marks(hit[a:b]):
                    out.append(raw[last : words.start[a + run["start"]] - base])
                    last = words.end[a + run["stop"] - 1] - base
                texts[d] = b"".join([*out, raw[last:]]).decode()
            part = part.set_column(at, names[at], pa.array(texts, part.schema.field(at).type))
            if "n_chars" in names:
                at, cut = names.index("n_chars"), n_hit > 0
                sizes = [len(t) if c else n for t, n, c in zip(texts, part.column(at).to_pylist(), cut, strict=True)]
                part = part.set_column(at, "n_chars", pa.array(sizes, part.schema.field(at).type))
        return part.filter(pa.array(keep))

    return matched(docs, benchmark, scratch, kernel, schema, **how)


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    tables = [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")]
    return report(*tables, Scratch(spark)).drop("spans")
