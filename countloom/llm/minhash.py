"""Near duplicates by SuperMinHash: signatures, banding, verification on full sets, union-find grouping.

A document's set holds its distinct shingles of `width` words; with fewer words the whole sequence is the one shingle.
SuperMinHash gives every element one pseudorandom permutation of the slots and the ranks j + r, r in [0, 1), along it; a
slot keeps its least rank. The levels j are run for a whole slice at once, and a text stops as soon as no later level
can lower any of its slots: for texts of many words that is after the first.

Equal sets are one class from the start. The classes' signatures are cut into bands; classes that share a band are
candidates. A bucket never emits all its pairs: its members are compared with one hub, and once links are known, members
that are not yet connected are compared with further hubs, those of most links first. The members of buckets that are
still unconnected after `rounds` hubs go through an exact prefix join: with a set's shingles in order of frequency, rare
ones first, two linked sets share a shingle within their first few, so that texts with a passage in common and much text
of their own never meet. Every link is confirmed on the full sets of 64-bit shingle hashes.
With bands of 4 rows and 32 bands, and slots taken as independent, a pair of similarity 0.85 is missed with probability 6e-11, one of 0.8 with 5e-8.

Edge cases: null texts and texts without words have an empty set, link with nothing and are kept; ties and repeated rows
fall into one class; very long texts are read whole; rows without an id get no component and are not kept (deduplicated() keeps
them); an empty table gives an empty result; other columns are not looked at, whatever their names. doc_id must
be a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from countloom.llm.common import Scratch
from countloom.llm.components import components
from countloom.llm.words import SPACE, U, Words, mix, slices

SLOTS, ROWS = 128, 4
_M = np.random.default_rng(7).integers(1, 1 << 62, 64, dtype=np.int64).astype(U) * U(2) + U(1)


def shingles(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within it, and where each text's begin."""
    w = Words(data, off, SPACE, lower=True)
    h = w.hashes()
    n = np.diff(w.first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    s = np.zeros(first[-1], U)
    if len(h) >= width:
        rolled = sum((h[k : len(h) - width + 1 + k] * _M[k] for k in range(1, width)), h[: len(h) - width + 1] * _M[0])
        at = np.arange(first[-1]) + np.repeat(w.first[:-1] - first[:-1], count)
        s = rolled[np.minimum(at, len(rolled) - 1)]
    for d in np.flatnonzero((n > 0) & (n < width)):
        a = w.first[d]
        s[first[d]] = np.append(h[a : a + n[d]] * _M[: n[d]], _M[63:] * U(int(n[d]))).sum(dtype=U)
    s = mix(s)
    for d in np.flatnonzero(count > 1):
        s[first[d] : first[d + 1]].sort()
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    new[first[:-1][count > 0]] = True
    sums = np.concatenate([[0], np.cumsum(new)])
    return s[new], sums[first]


def signatures(s: np.ndarray, first: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures, a row a text; a rank j + r is stored as j << 32 | bits of r."""
    texts = len(first) - 1
    sig = np.full((texts, slots), np.iinfo(U).max, U)
    flat = sig.ravel()
    doc = np.repeat(np.arange(texts), np.diff(first))
    perm = None
    for j in range(slots):
        r = mix(s + _M[j % 64 : j % 64 + 1] * U(j + 1))
        k = (j + ((r & U(0xFFFFFFFF)) * U(slots - j) >> U(32))).astype(np.int64)
        if j == 0:
            slot = k
        else:
            if perm is None:  # after level 0: its swap, made up for
                perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(s), 1))
                perm[np.arange(len(s)), k0] = 0
            e = np.arange(len(s))
            slot = perm[e, k].astype(np.int64)
            perm[e, k] = perm[e, j]
        np.minimum.at(flat, doc * slots + slot, U(j) << U(32) | r >> U(32))
        open_ = sig.max(axis=1) >= U(j + 1) << U(32)
        stay = open_[doc]
        if not stay.any():
            break
        k0 = k[stay] if perm is None else None
        s, doc = s[stay], doc[stay]
        if perm is not None:
            perm = perm[stay]
    return sig


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, g1, g2, bands): g1 and g2 stand for the set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in slices(batches):
            s, first = shingles(data, off, width)
            n = np.diff(first)
            some = n > 0
            g1, g2 = np.zeros(len(n), U), np.zeros(len(n), U)
            if some.any():
                g1[some] = np.add.reduceat(s, first[:-1][some])
                g2[some] = np.add.reduceat(mix(s ^ _M[5]), first[:-1][some])
            sig = signatures(s, first)
            bands = mix((sig.reshape(len(n), -1, ROWS) * _M[:ROWS]).sum(axis=2, dtype=U) + np.arange(SLOTS // ROWS, dtype=U) * _M[62])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(some, SLOTS // ROWS, 0))]), pa.int32()), pa.array(bands[some].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), pa.array(g1.view(np.int64)), pa.array(g2.view(np.int64)), lists], ["doc_id", "n_shingles", "g1", "g2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_shingles long, g1 long, g2 long, bands array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in slices(batches):
            s, first = shingles(data, off, width)
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(s.view(np.int64)))
            g1 = [int(x) for x in np.array([s[a:b].sum(dtype=U) for a, b in zip(first[:-1], first[1:], strict=True)], U).view(np.int64)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(g1, pa.int64()), lists], ["node", "g1", "shingles"])

    return docs.mapInArrow(rows, "node long, g1 long, shingles array<long>")


def prefixes(sets: DataFrame, percent: int, counters: int = 1 << 18) -> DataFrame:
    """(node, n, token, pos): the shingles of each set that a linked larger or smaller set can share first. They are in
    order of frequency, as counted in `counters` buckets of hashes: any order is exact, this one keeps groups small."""
    slot = F.pmod(F.col("s"), F.lit(counters)).cast("int").alias("slot")
    often = np.zeros(counters, np.int32)
    for batch in sets.select(F.explode("shingles").alias("s")).groupBy(slot).agg(F.count("*").alias("c")).where("c > 1").toArrow().to_batches():  # at most `counters` rows
        often[batch.column(0).to_numpy()] = np.minimum(batch.column(1).to_numpy(), np.iinfo(np.int32).max)
    sent = sets.sparkSession.sparkContext.broadcast(often)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, lists = batch.column(0).to_numpy(), batch.column(1)
            flat, off = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            out = []
            for d in range(len(node)):
                s = flat[off[d] : off[d + 1]]
                k = len(s) - -(-len(s) * percent // 100) + 1
                s = s[np.lexsort((s, sent.value[s % counters]))[:k]]
                out.append((np.full(len(s), node[d]), np.full(len(s), off[d + 1] - off[d]), s, np.arange(len(s))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], ["node", "n", "token", "pos"])

    return sets.select("node", "shingles").mapInArrow(rows, "node long, n long, token long, pos long")


def unconnected(tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs (node, hub) of different components that may be linked; tokens: prefixes() with component. In each token's
    group the members of one component stand aside: the others are compared with all."""
    groups = tokens.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).where("lo < hi")
    sizes = tokens.join(groups.select("token"), "token", "left_semi").groupBy("token", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("token").agg(F.max_by("component", F.struct("size", "component")).alias("main"))
    mixed = tokens.join(main, "token")
    few = mixed.where("component <> main")
    hubs = mixed.select("token", F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("pos").alias("hub_pos"), F.col("component").alias("hub_component"))
    need = F.ceil((F.col("n") + F.col("hub_n")) * percent / (100 + percent))
    near = (F.col("pos") + need <= F.col("n")) & (F.col("hub_pos") + need <= F.col("hub_n"))
    return few.join(hubs, "token").where((F.col("component") != F.col("hub_component")) & near).select("node", "hub")


def near_duplicates(docs: DataFrame, scratch: Scratch, percent: int = 80, width: int = 5, rounds: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row: documents with 100 * intersection >= percent * union are
    linked; component_id is the least id that links reach."""
    rows = scratch.save(sketch(docs, width), "sketch")
    known = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = scratch.save(known.groupBy("g1", "g2").agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("n")), "classes")
    # bands of one row of each class
    one = known.join(classes.select("g1", "g2", "node"), ["g1", "g2"]).where("doc_id = node")
    banded = one.select("node", "g1", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("band")
    buckets = scratch.save(banded.join(shared, "band", "left_semi").distinct(), "buckets")
    # the full sets of the classes that share a band with another
    wanted = buckets.select("node", "g1").distinct()
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text").join(wanted.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = full_sets(texts, width).join(wanted, ["node", "g1"], "left_semi").dropDuplicates(["node", "g1"]).drop("g1")
    sets = scratch.save(sets, "sets")
    scratch.settle()

    def confirm(pairs: DataFrame, name: str) -> DataFrame:
        """pairs (a, b) with whether they are linked."""
        left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        union = F.size("sa") + F.size("sb") - both
        return scratch.save(pairs.join(left, "a").join(right, "b").select("a", "b", (both * 100 >= union * percent).alias("linked")), name)

    fits = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent  # a necessary condition
    ordered = lambda df: df.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).where("a <> b").distinct()
    hubs = buckets.groupBy("band").agg(F.min(F.struct("node", "n")).alias("hub")).select("band", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
    tested = confirm(ordered(buckets.join(hubs, "band").where(fits)), "pairs0")
    grouped = scratch.save(components(tested.where("linked"), scratch, "c0_"), "grouped0")
    scratch.settle()
    for i in range(1, rounds + 2):
        labelled = buckets.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
        labelled = labelled.select("band", "node", "n", "component")
        split = labelled.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("band")
        labelled = scratch.save(labelled.join(split, "band", "left_semi"), f"labelled{i}")
        if labelled.isEmpty():
            break
        if i <= rounds:  # one more hub for each bucket, of most links
            links = tested.where("linked")
            degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
            most = F.max_by(F.struct("node", "n", "component"), F.struct(F.coalesce("degree", F.lit(0)), F.xxhash64("node", F.lit(i))))
            hubs = labelled.join(degree, "node", "left").groupBy("band").agg(most.alias("hub")).select("band", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.component").alias("hub_component"))
            offered = labelled.join(hubs, "band").where(fits & (F.col("component") != F.col("hub_component")))
        else:  # whatever is left
            left = labelled.select("node", "component").distinct()
            tokens = scratch.save(prefixes(sets.join(left, "node", "left_semi"), percent).join(left, "node"), "tokens")
            offered = unconnected(tokens, percent)
        fresh = ordered(offered).join(tested.select("a", "b"), ["a", "b"], "left_anti")
        now = confirm(fresh, f"pairs{i}")
        tested = tested.unionByName(now)
        if not now.where("linked").isEmpty():
            grouped = scratch.save(components(tested.where("linked"), scratch, f"c{i}_"), f"grouped{i}")
        scratch.settle()
    where = classes.join(grouped, "node", "left").select("g1", "g2", F.coalesce("component", "node").alias("component"))
    out = rows.drop("bands").join(where, ["g1", "g2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """docs with one row of each group of near duplicates: the one of least id, once if it is repeated (rows of one id are
    one document). Rows without an id all stay."""
    kept = near_duplicates(docs, scratch, **how).where("kept").select("doc_id").distinct()
    rows = docs.join(kept, "doc_id", "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    return rows.withColumn("__first", first).where("__first = 1").drop("__first").unionByName(docs.where("doc_id IS NULL"))


def op1_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark), percent=85)
