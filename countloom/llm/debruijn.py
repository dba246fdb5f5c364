"""Substring dedup by De Bruijn compaction: every word covered by a window of `window` words that also starts anywhere
else is removed.

The windows are the edges of the graph, their first and last window - 1 words its nodes. repeats.py gathers the edges
by anchor, so that the edges of a stretch of text meet in one task; a task numbers its words by their bytes and its edges by
their words, and keeps the edges that occur twice or more, as local paths. Paths of different anchors then compact through
joins: where every occurrence of a path is followed by one and the same path, and that is always preceded by it, the two
are one. Chains of such steps are ranked by pointer doubling, one join a round, until only their heads are left: a head has
the length of the whole nonbranching path, and where it starts in a text is the source coordinate of that path. What is
removed are the words of these long paths at their coordinates.

Edge cases: null texts have no words; texts of fewer words lose nothing; very long texts are cut into pieces of segments,
never shortened; overlaps count; ties and repeated rows and equal texts of at least the window's words are removed whole;
words are compared as bytes; rows without an id take part; an empty table gives an empty result; other columns are not
looked at, whatever their names. doc_id must be a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from countloom.llm.common import Scratch
from countloom.llm.repeats import covered, finer_grams, keyed, repeated, with_spans
from countloom.llm.words import U, mix, prefix_sums, slices, span_hash, spread

WINDOW, GRAM = 35, 12


def compare(window: int):
    def marks(own: list[bytes], n: np.ndarray) -> np.ndarray:
        numbers: dict[bytes, int] = {}
        pieces = [[numbers.setdefault(w, len(numbers)) for w in x.split()] for x in own]
        words = np.fromiter((w for p in pieces for w in p), np.int64)
        first = np.cumsum([0, *map(len, pieces)])
        at = np.repeat(first[:-1], n) + spread(n)
        hashes = span_hash(prefix_sums(mix(words.astype(U))), at, at + window)
        _, source, edge = np.unique(hashes, return_index=True, return_inverse=True)
        edges = np.lib.stride_tricks.sliding_window_view(words, window)
        same = np.zeros(len(at), bool)
        for i in range(0, len(at), 16384):
            same[i : i + 16384] = (edges[at[i : i + 16384]] == edges[at[source[edge[i : i + 16384]]]]).all(axis=1)
        if not same.all():  # two edges of one hash
            edge = np.unique(edges[at], axis=0, return_inverse=True)[1].ravel()
        return np.bincount(edge)[edge] > 1

    return marks


def compacted(paths: DataFrame, scratch: Scratch) -> DataFrame:
    """paths (t1, t2, path, start, length) as nonbranching paths (t1, t2, start, length): each from its head, with the length
    of its chain."""
    along = Window.partitionBy("t1", "t2").orderBy("start")
    follows = F.lead("start").over(along) == F.col("start") + F.col("length")
    steps = scratch.save(paths.withColumn("next", F.when(follows, F.lead("path").over(along))), "steps")
    nodes = steps.groupBy("path").agg(F.count("*").alias("n"), F.min("length").alias("length"), F.min("next").alias("next"), F.max("next").alias("most"), F.count("next").alias("followed"))
    into = steps.where("next IS NOT NULL").groupBy("next").agg(F.count("*").alias("n_into")).withColumnRenamed("next", "into")
    counts = nodes.select(F.col("path").alias("into"), F.col("n").alias("n_next"))
    # always followed by one path, which always follows it: the three counts are equal, and no cycle of such steps can exist,
    # as a text comes to an end
    own = nodes.where("followed = n AND next = most").join(counts.join(into, "into").where("n_next = n_into"), F.col("next") == F.col("into")).where("n = n_next")
    plain = own.select("path", F.col("next").alias("to"))
    ranked = nodes.select("path", "length").join(plain, "path", "left")
    inner = plain.select(F.col("to").alias("path")).withColumn("inner", F.lit(True))
    ranked = scratch.save(ranked.join(inner, "path", "left").select("path", "length", "to", F.coalesce("inner", F.lit(False)).alias("inner")), "rank0")
    i = 0
    while not ranked.where("to IS NOT NULL").isEmpty():
        ahead = ranked.select(F.col("path").alias("to"), F.col("length").alias("more"), F.col("to").alias("further"))
        ranked = ranked.join(ahead, "to", "left").select("path", (F.col("length") + F.coalesce("more", F.lit(0))).alias("length"), F.col("further").alias("to"), "inner")
        i += 1
        ranked = scratch.save(ranked, f"rank{i}")
        scratch.drop(f"rank{i - 1}")
    heads = ranked.where("not inner").select("path", F.col("length").alias("whole"))
    return steps.join(heads, "path").select("t1", "t2", "start", F.col("whole").alias("length"))


def removed(docs: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM, limit: int = 768 << 10, hot: int = 4000, with_kept: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed: runs of words, kept: the other words joined by one space, if
    asked for)."""
    spans = compacted(repeated(keyed(docs), scratch, "words", window, finer_grams(window, gram), compare(window), limit, hot), scratch)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in slices(batches):
            raw, out = data.tobytes(), []
            for d, s in enumerate(part.column(2).to_pylist()):
                words = raw[off[d] : off[d + 1]].split()
                cut, kept, last = covered(s, window), [], 0
                for a, b in cut:
                    kept += words[last:a]
                    last = b
                kept += words[last:]
                text = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), [{"start": a, "stop": b} for a, b in cut], *([text.decode()] if with_kept else [])))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.string()]
            names = ["n_words", "n_removed", "kept_sha256", "removed", "kept"]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=False)]], ["doc_id", *names[: len(cols)]])

    return with_spans(docs.select("doc_id", "text"), spans).select("doc_id", "text", "spans").mapInArrow(rows, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,stop:long>>" + ", kept string" * with_kept)


def op6_debruijn(spark, sf_dir: str) -> DataFrame:
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark), with_kept=False).drop("removed")
