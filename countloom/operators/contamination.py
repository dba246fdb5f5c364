"""Steps of the two-component mixture: each count is native to its cell's cluster or ambient from all the others.

profiles(feature_id, z, phi, eta) hold a row for every feature and cluster; theta(cell_id, z, theta) the native share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from countloom.operators import aggregate
from countloom.sources.matrix import Experiment

TINY = 1e-20


def _profiles(weights: DataFrame, features: DataFrame, k: int, start: float, eta: DataFrame | None = None) -> DataFrame:
    """weights (feature_id, z, n) as distributions: phi of each cluster, eta of what the other clusters hold."""
    grid = aggregate.filled(weights, features.select("feature_id"), "z", k).withColumn("n", F.col("n") + start)
    rest = F.sum("n").over(Window.partitionBy("feature_id")) - F.col("n")
    by_z = Window.partitionBy("z")
    grid = grid.withColumn("rest", rest)
    out = grid.select("feature_id", "z", (F.col("n") / F.sum("n").over(by_z)).alias("phi"), (F.col("rest") / F.sum("rest").over(by_z)).alias("eta"))
    return out if eta is None else out.drop("eta").join(eta, "feature_id")


def initial(x: Experiment, theta: DataFrame, eta: DataFrame | None = None) -> DataFrame:
    """Profiles from counts weighted by the native shares."""
    weights = x.counts.join(theta, "cell_id").groupBy("feature_id", "z").agg(F.sum(F.col("n") * F.col("theta")).alias("n"))
    return _profiles(weights, x.features, x.params["K"], TINY, eta)


def background_eta(background: DataFrame, features: DataFrame) -> DataFrame:
    """(feature_id, eta) of empty droplets, the same for every cluster."""
    sums = features.select("feature_id").join(background.groupBy("feature_id").agg(F.sum("n").alias("n")), "feature_id", "left")
    value = F.coalesce("n", F.lit(0)) + F.lit(TINY)
    return sums.select("feature_id", (value / F.sum(value).over(Window.partitionBy(F.lit(0)))).alias("eta"))


def native_share() -> Column:
    """The probability that a count is native."""
    a = (F.col("phi") + TINY) * (F.col("theta") + TINY)
    b = (F.col("eta") + TINY) * (1 - F.col("theta") + TINY)
    return a / (a + b)


def _entries(x: Experiment, theta: DataFrame, profiles: DataFrame) -> DataFrame:
    return x.counts.join(theta, "cell_id").join(profiles, ["feature_id", "z"])


def native_matrix(x: Experiment, theta: DataFrame, profiles: DataFrame) -> DataFrame:
    """counts times their native share."""
    return _entries(x, theta, profiles).select("feature_id", "cell_id", (F.col("n") * native_share()).alias("n"))


def log_likelihood(x: Experiment, theta: DataFrame, profiles: DataFrame) -> DataFrame:
    p = F.col("phi") * F.col("theta") + F.col("eta") * (1 - F.col("theta")) + TINY
    return _entries(x, theta, profiles).agg(F.sum(F.col("n") * F.log(p)).alias("log_lik"))


def shares(x: Experiment, theta: DataFrame, profiles: DataFrame) -> DataFrame:
    """(cell_id, z, n, native, contamination): the cells' side of a step."""
    by_cell = _entries(x, theta, profiles).groupBy("cell_id", "z").agg(F.sum("n").alias("n"), F.sum(F.col("n") * native_share()).alias("native"))
    return by_cell.withColumn("contamination", (F.col("n") - F.col("native")) / F.col("n"))


def new_theta(shares_: DataFrame, delta: tuple[float, float]) -> DataFrame:
    """Native shares smoothed by the prior."""
    return shares_.select("cell_id", "z", ((F.col("native") + delta[0]) / (F.col("n") + delta[0] + delta[1])).alias("theta"))


def new_profiles(x: Experiment, theta: DataFrame, profiles: DataFrame, eta: DataFrame | None = None) -> DataFrame:
    weights = _entries(x, theta, profiles).groupBy("feature_id", "z").agg(F.sum(F.col("n") * native_share()).alias("n"))
    return _profiles(weights, x.features, x.params["K"], 0.0, eta)


def digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y / 42))


def fitted_delta(mean_log: tuple[float, float], start: tuple[float, float], rounds: int = 200) -> tuple[float, float]:
    """Maximum-likelihood Dirichlet over two shares from the means of their logarithms, by fixed-point iteration."""
    a = list(start)
    for _ in range(rounds):
        total = digamma(sum(a))
        new = []
        for m in mean_log:
            y = total + m
            v = math.exp(y) + 0.5 if y >= -2.22 else -1 / (y - digamma(1))
            for _ in range(5):
                v -= (digamma(v) - y) / trigamma(v)
            new.append(v)
        done = max(abs(p - q) for p, q in zip(a, new, strict=True)) < 1e-9
        a = new
        if done:
            break
    return a[0], a[1]


def delta_of(shares_: DataFrame, start: tuple[float, float]) -> tuple[float, float]:
    c = F.least(F.greatest(F.col("contamination"), F.lit(1e-10)), F.lit(1 - 1e-10))
    row = shares_.agg(F.avg(F.log(1 - c)), F.avg(F.log(c))).first()
    return fitted_delta((row[0], row[1]), start)


def marker_percentage(counts: DataFrame, cells: DataFrame, markers: DataFrame, threshold: float = 1) -> DataFrame:
    """(markers, z, percent): of each cluster's cells, how many hold any of a cell type's markers at `threshold` or more.
    markers: cell_type, feature_id."""
    hits = counts.where(F.col("n") >= threshold).join(markers, "feature_id").select("cell_id", "cell_type").distinct()
    have = hits.join(cells.select("cell_id", "z"), "cell_id").groupBy("cell_type", "z").agg(F.count("*").alias("have"))
    sizes = cells.groupBy("z").agg(F.count("*").alias("size"))
    grid = sizes.select("z", "size", F.explode(F.array(*[F.lit(t.cell_type) for t in markers.select("cell_type").distinct().orderBy("cell_type").collect()])).alias("cell_type"))  # a marker list is a user's
    percent = F.bround(F.coalesce("have", F.lit(0)) / F.col("size") * 100, 0)
    return grid.join(have, ["cell_type", "z"], "left").select(F.col("cell_type").alias("markers"), "z", percent.alias("percent"))


def check_markers(markers: dict[str, list[str]], groups: dict[str, list[int]] | None = None) -> list[tuple[str, str]]:
    """Markers as pairs; a cluster that stands in two groups is an error."""
    if not markers or not all(markers.values()):
        raise ValueError("each cell type needs at least one marker")
    if groups:
        every = [z for zs in groups.values() for z in zs]
        if len(every) != len(set(every)):
            raise ValueError("a cluster stands in more than one group")
    return [(t, m) for t, ms in markers.items() for m in ms]


def enrichment(modules: DataFrame, sets: DataFrame, universe: int, fdr: float = 0.05) -> DataFrame:
    """(y, term, overlap, p, adjusted): hypergeometric tail of each term in each module, adjusted by Benjamini-Hochberg
    within the module; modules (feature_id, y), sets (term, feature_id)."""
    from countloom.functions.special import lgamma

    size = modules.groupBy("y").agg(F.count("*").alias("m"))
    terms = sets.join(modules.select("feature_id"), "feature_id", "left_semi").groupBy("term").agg(F.count("*").alias("t"))
    both = modules.join(sets, "feature_id").groupBy("y", "term").agg(F.count("*").alias("overlap")).join(size, "y").join(terms, "term")
    each = both.withColumn("i", F.explode(F.sequence(F.col("overlap"), F.least("m", "t"))))

    def choose(n: Column, k: Column) -> Column:
        return lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0)

    n, m, t, i = F.lit(float(universe)), F.col("m"), F.col("t"), F.col("i")
    p = F.when(n - m - t + i >= 0, F.exp(choose(t, i) + choose(n - t, m - i) - choose(n, m))).otherwise(0.0)
    tail = each.withColumn("one", p).groupBy("y", "term", "overlap").agg(F.least(F.sum("one"), F.lit(1.0)).alias("p"))
    w = Window.partitionBy("y")
    rank = F.row_number().over(w.orderBy("p", "term"))
    raw = tail.withColumn("rank", rank).withColumn("raw", F.col("p") * F.count("*").over(w) / F.col("rank"))
    adjusted = F.least(F.min("raw").over(w.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))
    return raw.withColumn("adjusted", adjusted).where(F.col("adjusted") < fdr).select("y", "term", "overlap", "p", "adjusted")
