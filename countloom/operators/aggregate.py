"""Grouped sums over counts: by cell cluster, by feature module, by both; changes; cross-tabulations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_cluster(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """(feature_id, z, n)"""
    return counts.join(cells.select("cell_id", "z"), "cell_id").groupBy("feature_id", "z").agg(F.sum("n").alias("n"))


def by_module(counts: DataFrame, features: DataFrame) -> DataFrame:
    """(y, cell_id, n)"""
    return counts.join(features.select("feature_id", "y"), "feature_id").groupBy("y", "cell_id").agg(F.sum("n").alias("n"))


def by_both(counts: DataFrame, cells: DataFrame, features: DataFrame) -> DataFrame:
    """(y, z, n): modules first, so that what meets the cells is small."""
    return by_module(counts, features).join(cells.select("cell_id", "z"), "cell_id").groupBy("y", "z").agg(F.sum("n").alias("n"))


def totals(counts: DataFrame, axis: str) -> DataFrame:
    """(axis, n); axis: cell_id or feature_id."""
    return counts.groupBy(axis).agg(F.sum("n").alias("n"))


def changed(sums: DataFrame, counts: DataFrame, moves: DataFrame, item: str, label: str) -> DataFrame:
    """sums after some items changed their label; moves: (item, old, new). Only the moved items' counts are read: they
    leave the old group and join the new one."""
    other = next(c for c in sums.columns if c not in (label, "n"))
    moved = counts.join(moves.where("old <> new"), item)
    delta = moved.select(other, F.explode(F.array(F.struct(F.col("old").alias("l"), (-F.col("n")).alias("v")), F.struct(F.col("new").alias("l"), F.col("n").alias("v")))).alias("d"))
    delta = delta.select(other, F.col("d.l").alias(label), F.col("d.v").alias("n"))
    return sums.select(other, label, "n").unionByName(delta).groupBy(other, label).agg(F.sum("n").alias("n")).where("n <> 0")


def cluster_by_sample(cells: DataFrame, k: int) -> DataFrame:
    """(z, sample, cells) for every cluster 1..k and every sample, zeros included."""
    grid = cells.select("sample").distinct().select("sample", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("z"))
    have = cells.groupBy("z", "sample").agg(F.count("*").alias("have"))
    return grid.join(have, ["z", "sample"], "left").select("z", "sample", F.coalesce("have", F.lit(0)).alias("cells"))


def tabulate(items: DataFrame, label: str, levels: int) -> DataFrame:
    """(label, items) for every level 1..levels."""
    grid = items.sparkSession.range(1, levels + 1).select(F.col("id").cast("int").alias(label))
    return grid.join(items.groupBy(label).agg(F.count("*").alias("have")), label, "left").select(label, F.coalesce("have", F.lit(0)).alias("items"))


def module_sizes(features: DataFrame, modules: int) -> DataFrame:
    """(y, genes): features of each module, and one pseudo-feature."""
    return tabulate(features, "y", modules).select("y", (F.col("items") + 1).alias("genes"))


def check_labels(items: DataFrame, label: str, levels: int) -> None:
    """An error if a label is missing or outside 1..levels."""
    bad = items.agg(F.count(F.when(F.col(label).isNull(), 1)), F.min(label), F.max(label)).first()
    if bad[0]:
        raise ValueError(f"{label} is missing for {bad[0]} items")
    if bad[1] is not None and (bad[1] < 1 or bad[2] > levels):
        raise ValueError(f"{label} must lie within 1..{levels}; it runs from {bad[1]} to {bad[2]}")


def filled(sums: DataFrame, left: DataFrame, column: str, levels: int) -> DataFrame:
    """sums with zeros for every row of `left` (one key column) and every level 1..levels of `column`."""
    key = left.columns[0]
    grid = left.select(key, F.explode(F.sequence(F.lit(1), F.lit(levels))).alias(column))
    return grid.join(sums, [key, column], "left").select(key, column, F.coalesce("n", F.lit(0)).alias("n"))
