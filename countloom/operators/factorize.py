"""Views of a clustered matrix as small factors: counts, proportions, posterior means.

A view is (part, row, column, value): parts are sample (cluster by sample), module (feature by cluster or module), cell
(module by cell), cellPopulation (module by cluster) and geneDistribution (module).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from countloom.operators import aggregate
from countloom.sources.matrix import Experiment


def _view(df: DataFrame, part: str, row: str, column: str | Column, value: str | Column = "value") -> DataFrame:
    return df.select(F.lit(part).alias("part"), F.col(row).cast("string").alias("row"), (F.col(column) if isinstance(column, str) else column).cast("string").alias("column"), (F.col(value) if isinstance(value, str) else value).cast("double").alias("value"))


def _share(df: DataFrame, by: str | None, prior: float = 0.0, value: str = "n") -> DataFrame:
    """value + prior by its group's sum; a group of nothing stays at zero."""
    w = Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))
    total = F.sum(F.col(value) + prior).over(w)
    return df.withColumn("value", F.when(total > 0, (F.col(value) + prior) / total).otherwise(F.lit(0.0)))


def _kind(df: DataFrame, kind: str, by: str | None, prior: float, value: str = "n") -> DataFrame:
    if kind == "counts":
        return df.withColumn("value", F.col(value))
    return _share(df, by, prior if kind == "posterior" else 0.0, value)


def sample_part(x: Experiment, kind: str) -> DataFrame:
    table = aggregate.cluster_by_sample(x.cells, x.params["K"])
    return _view(_kind(table, kind, "sample", x.params["alpha"], "cells"), "sample", "z", "sample")


def module_part(x: Experiment, kind: str) -> DataFrame:
    """Features' counts within their own module; the prior goes there only."""
    table = x.features.select("feature_id", "y").join(aggregate.totals(x.counts, "feature_id"), "feature_id")
    return _view(_kind(table, kind, "y", x.params["delta"]), "module", "feature_id", "y")


def gene_part(x: Experiment, kind: str) -> DataFrame:
    table = aggregate.module_sizes(x.features, x.params["L"]).withColumnRenamed("genes", "n")
    return _view(_kind(table, kind, None, x.params["gamma"]), "geneDistribution", "y", F.lit("all"))


def cells_by_cluster(x: Experiment, kind: str) -> DataFrame:
    """Feature by cell cluster."""
    sums = aggregate.by_cluster(x.counts, x.cells)
    if kind == "posterior":
        sums = aggregate.filled(sums, x.features.select("feature_id"), "z", x.params["K"])
    return _view(_kind(sums, kind, "z", x.params["beta"]), "module", "feature_id", "z")


def module_by_cell(x: Experiment, kind: str) -> DataFrame:
    sums = aggregate.by_module(x.counts, x.features)
    if kind == "posterior":
        sums = aggregate.filled(sums, x.cells.select("cell_id"), "y", x.params["L"])
    return _view(_kind(sums, kind, "cell_id", x.params["beta"]), "cell", "y", "cell_id")


def population_part(x: Experiment, kind: str) -> DataFrame:
    sums = aggregate.by_both(x.counts, x.cells, x.features)
    if kind == "posterior":
        grid = x.counts.sparkSession.range(1, x.params["K"] + 1).select(F.col("id").cast("int").alias("z"))
        sums = aggregate.filled(sums, grid, "y", x.params["L"])
    return _view(_kind(sums, kind, "z", x.params["beta"]), "cellPopulation", "y", "z")


def factorized(x: Experiment, model: str, kind: str) -> DataFrame:
    """model: c, g or cg; kind: counts, proportion or posterior. Zeros are left out except from posteriors and from
    sample and geneDistribution; the posterior of cg has no cell part."""
    if kind not in ("counts", "proportion", "posterior"):
        raise ValueError(f"unknown kind {kind!r}")
    parts = {"c": [sample_part, cells_by_cluster], "g": [module_by_cell, module_part, gene_part], "cg": [sample_part, population_part, module_by_cell, module_part, gene_part]}[model]
    views = [p(x, kind) for p in parts if not (model == "cg" and kind == "posterior" and p is module_by_cell)]
    out = views[0]
    for v in views[1:]:
        out = out.unionByName(v)
    return out
