"""Feature filters, validation, lookups, recoding, subsets."""

from __future__ import annotations

import warnings
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from countloom.sources.matrix import Experiment, same_counts


def frequent_features(counts: DataFrame, features: DataFrame, cells: DataFrame, min_count: float = 3, min_cell: int = 3) -> DataFrame:
    """Features with a count of min_count or more in min_cell cells or more; a min_count of 0 or less counts zeros."""
    if min_count <= 0:
        return features if cells.count() >= min_cell else features.limit(0)
    often = counts.groupBy("feature_id").agg(F.count_if(F.col("n") >= min_count).alias("often")).where(F.col("often") >= min_cell)
    return features.join(often, "feature_id", "left_semi") if min_cell > 0 else features


def select_features(x: Experiment, min_count: float = 3, min_cell: int = 3, name: str = "featureSubset") -> Experiment:
    """x with a subset that holds the frequent features only."""
    kept = frequent_features(x.counts, x.features, x.cells, min_count, min_cell)
    return x.with_subset(name, Experiment(x.counts.join(kept, "feature_id", "left_semi"), x.cells, kept, dict(x.params)))


def empty_axes(counts: DataFrame, features: DataFrame, cells: DataFrame) -> DataFrame:
    """(axis, id) of features and cells without any count."""
    some = counts.where("n <> 0")
    f = features.join(some, "feature_id", "left_anti").select(F.lit("feature").alias("axis"), F.col("feature_id").alias("id"))
    c = cells.join(some, "cell_id", "left_anti").select(F.lit("cell").alias("axis"), F.col("cell_id").alias("id"))
    return f.unionByName(c)


def validate(counts: DataFrame, features: DataFrame, cells: DataFrame) -> None:
    bad = empty_axes(counts, features, cells).first()
    if bad:
        raise ValueError(f"{bad.axis} {bad.id} has no counts")


def feature_index(wanted: list[str], features: DataFrame, by: str = "name", exact: bool = True, drop_missing: bool = False) -> DataFrame:
    """(query, feature_id): the first feature that is equal to each query, or matches it as a regular expression; null
    where none does. No match at all is an error; queries with several matches or none are warned of."""
    if by not in features.columns:
        raise ValueError(f"features have no column {by!r}")
    asked = features.sparkSession.createDataFrame([(i, w) for i, w in enumerate(wanted)], "position int, query string")
    on = F.col(by) == F.col("query") if exact else F.regexp_like(F.col(by), F.col("query"))
    found = F.broadcast(asked).join(features.select("feature_id", by), on).groupBy("position").agg(F.min("feature_id").alias("feature_id"), F.count("*").alias("matches"))
    matches = dict(found.select("position", "matches").collect())  # a row a query
    if not matches:
        raise ValueError("none of the features was found")
    for what, some in (("match several features; the first is taken", [w for i, w in enumerate(wanted) if matches.get(i, 0) > 1]), ("match no feature", [w for i, w in enumerate(wanted) if i not in matches])):
        if some:
            warnings.warn(f"{', '.join(some)} {what}", stacklevel=2)
    found = found.drop("matches")
    return asked.join(found, "position", "inner" if drop_missing else "left").select("query", "feature_id")


def module_of(wanted: list[str], features: DataFrame, by: str = "name", exact: bool = True) -> DataFrame:
    """(query, feature_id, y)"""
    return feature_index(wanted, features, by, exact).join(features.select("feature_id", "y"), "feature_id", "left").select("query", "feature_id", "y")


def recoded(items: DataFrame, label: str, old: list, new: list) -> DataFrame:
    """items with labels mapped from old to new; others stay. Every old label must be a new one."""
    if len(old) != len(new):
        raise ValueError("there must be as many new labels as old ones")
    if set(old) - set(new):
        raise ValueError(f"{sorted(set(old) - set(new))} would vanish")
    if not old:
        return items
    mapping = F.create_map(*[F.lit(v) for pair in zip(old, new, strict=True) for v in pair])
    return items.withColumn(label, F.coalesce(mapping[F.col(label)], F.col(label)))


def relabelled(cells: DataFrame, label: str = "label", order: str = "cell_id", out: str = "z") -> DataFrame:
    """Labels of any kind as 1..K, in order of their first appearance; fewer than two kinds are an error."""
    first = cells.groupBy(label).agg(F.min(order).alias("first"))
    if first.count() < 2:
        raise ValueError("at least two clusters are needed")
    number = F.row_number().over(Window.orderBy("first")).alias(out)
    return cells.join(first.select(label, number), label)


def subset_runs(runs: DataFrame, params: dict[str, list]) -> DataFrame:
    """Runs whose parameters are among the listed values."""
    for name, values in params.items():
        if name not in runs.columns:
            raise ValueError(f"runs have no parameter {name!r}")
        runs = runs.where(F.col(name).isin(list(values)))
    return runs


def append_runs(a: DataFrame, b: DataFrame, counts_a: DataFrame | None = None, counts_b: DataFrame | None = None) -> DataFrame:
    """Runs of two searches, numbered on; perplexities do not carry over. If the matrices they were made from are given and
    differ, a warning says so."""
    if counts_a is not None and counts_b is not None and not same_counts(counts_a, counts_b, error=False):
        warnings.warn("the runs were made from different counts", stacklevel=2)
    drop = [c for c in a.columns if "perplexity" in c]
    last = a.agg(F.coalesce(F.max("index"), F.lit(0)).alias("last")).first()[0]
    return a.drop(*drop).unionByName(b.drop(*drop).withColumn("index", F.col("index") + last))


def subset_items(x: Experiment, features: list[int] | None = None, cells: list[int] | None = None) -> Experiment:
    """x with listed features and cells only, tables and counts in step."""
    out = x
    if features is not None:
        on = F.col("feature_id").isin(features)
        out = replace(out, counts=out.counts.where(on), features=out.features.where(on))
    if cells is not None:
        on = F.col("cell_id").isin(cells)
        out = replace(out, counts=out.counts.where(on), cells=out.cells.where(on))
    return out


def embedded(cells: DataFrame, dims: DataFrame) -> DataFrame:
    """Cells with both coordinates; cells without are dropped."""
    return cells.join(dims.dropna(subset=["dim1", "dim2"]), "cell_id")


def sample_quota(cells: DataFrame, max_cells: int, min_size: int = 100, seed: int = 12345) -> DataFrame:
    """At most max_cells cells: clusters above min_size lose cells in proportion to what they have above it, by a hash
    order; rounding is made up for in the cluster that loses most."""
    sizes = {r.z: r["count"] for r in cells.groupBy("z").count().collect()}  # a row a cluster
    total = sum(sizes.values())
    if max_cells < total and max_cells / max(min_size, 1) < len(sizes):
        raise ValueError(f"{max_cells} cells cannot be spread over {len(sizes)} clusters of at least {min_size}")
    if max_cells >= total:
        return cells
    spare = {z: max(n - min_size, 0) for z, n in sizes.items()}
    lose = {z: -(-s * (total - max_cells) // max(sum(spare.values()), 1)) for z, s in spare.items()}
    most = max(sorted(lose), key=lambda z: lose[z])
    lose[most] -= sum(lose.values()) - (total - max_cells)
    quota = cells.sparkSession.createDataFrame(list(lose.items()), "z int, lose long")
    turn = F.row_number().over(Window.partitionBy("z").orderBy(F.xxhash64("cell_id", F.lit(seed)), "cell_id"))
    return cells.withColumn("turn", turn).join(F.broadcast(quota), "z").where("turn > lose").drop("turn", "lose")
