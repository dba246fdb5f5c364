"""A whole analysis in one call, its tables written side by side, and read again."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.operators import aggregate, factorize, filters, rank
from countloom.plans import embed, fits, plots
from countloom.plans.kernels import Priors
from countloom.sources.matrix import Experiment, write_module_table

log = logging.getLogger("countloom")


def log_to(path: str | None, append: bool = False, verbose: bool = True) -> None:
    """Send the run's messages to a file, anew or appended, and to the console if verbose; None stops the file."""
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    handlers: list[logging.Handler] = [logging.StreamHandler()] if verbose else []
    if path is not None:
        handlers.append(logging.FileHandler(path, mode="a" if append else "w"))
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s .. %(message)s"))
        log.addHandler(h)
    log.setLevel(logging.INFO)
    log.propagate = not handlers

TABLES = ("cells", "features", "factors", "module_splits", "cell_splits", "embedding")


def run(x: Experiment, k: int, modules: int, path: str, initial_modules: int = 10, max_modules: int = 150, initial_k: int = 5, max_k: int = 50, min_count: float = 3, min_cell: int = 3, max_features: int = 5000, seed: int = 12345) -> Experiment:
    """Select features, split modules, split clusters, fit both, embed; every table goes to `path`."""
    sub = filters.select_features(x, min_count, min_cell).subset()
    top = aggregate.totals(sub.counts, "feature_id").orderBy(F.desc("n"), "feature_id").limit(max_features).select("feature_id")
    sub = Experiment(sub.counts.join(top, "feature_id", "left_semi"), sub.cells, sub.features.join(top, "feature_id", "left_semi"), dict(x.params))
    sub = Experiment(sub.counts, sub.cells.join(sub.counts.select("cell_id").distinct(), "cell_id", "left_semi"), sub.features, sub.params)
    log.info("splitting modules up to %d", max_modules)
    by_module = fits.recursive_split(sub, "y", min(initial_modules, modules), max(modules, min(max_modules, modules)), temp=100, seed=seed)
    log.info("splitting clusters up to %d", max_k)
    by_cell = fits.recursive_split(sub, "z", min(initial_k, k), max(k, min(max_k, k)), seed=seed)
    done = fits.labelled(sub, fits.cluster_both(sub, k, modules, Priors(), chains=1, seed=seed, init="random"))
    tables = {"cells": done.cells, "features": done.features, "factors": factorize.factorized(done, "cg", "posterior"), "module_splits": by_module, "cell_splits": by_cell, "embedding": embed.embedding(done, "graph", min_size=1)}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
        log.info("wrote %s", name)
    write_module_table(rank.module_table(done.features, aggregate.totals(done.counts, "feature_id"), modules), f"{path}/module_table")
    return done


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}


def results(x: Experiment, dims: DataFrame, features: list[int]) -> dict[str, DataFrame]:
    """The tables behind a report's plots."""
    points, labels = plots.reduced_clusters(x, dims)
    return {"clusters": points, "labels": labels, "modules": plots.reduced_modules(x, dims), "features": plots.reduced_features(x, dims, features), "probability_map": plots.probability_map(x), "module_heatmap": plots.module_heatmap(x, 100, 25), "violin": plots.violin(x, features)}
