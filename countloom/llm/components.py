"""Connected components of a table of links: union-find within partitions, then star contraction by joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from countloom.llm.common import Scratch


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links (a, b) of each batch: a link from every node to its root, the least node it reaches."""
    for batch in batches:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while root.setdefault(top, top) != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        nodes = [x for x in root if find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["a", "b"])


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of every node that has a link (a, b: long); component: the least node it reaches. Rounds of
    large-star and small-star until nothing changes; each is a window over a node's links, so no node's links are
    collected. The links kept between rounds are at most as many as the nodes after the first round."""

    def star(edges: DataFrame) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least("a", F.min("b").over(Window.partitionBy("a")))
        large = both.withColumn("m", least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # every edge now points to a smaller node
        m = F.min("b").over(Window.partitionBy("a"))
        small = large.distinct().withColumn("m", m)
        out = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        return out.distinct()

    edges = scratch.save(links.select("a", "b").where("a <> b").mapInArrow(forest, "a long, b long").distinct(), f"{name}0")
    state, i = None, 0
    while True:
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))).first()
        if tuple(found) == state or not found[0]:
            break
        state, i = tuple(found), i + 1
        edges = scratch.save(star(edges), f"{name}{i}")
        scratch.drop(f"{name}{i - 1}")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
