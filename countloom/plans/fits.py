"""Model fits: chains, searches and splits of the kernels over a matrix, and DataFrame fits beyond what these hold.

A matrix of at most LIMIT entries is sent to the executors whole, and each run (chain, K, L) is one row of a distributed
table of runs. A larger one is held by the tasks of one barrier job (ranks.py), or stays on the cluster in blocks (blocks.py), with
the same starts, splits and stopping rules; its items are updated all at once. Where items x labels are more than blocks.STATE, cells and features are fitted
by joins alone, from random labels and without split steps; searches and recursive splits raise TooLarge there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.operators import contamination, filters, likelihood, rank
from countloom.plans import ambient, kernels, ranks
from countloom.plans.blocks import STATE, Blocks, Cells
from countloom.plans.kernels import Priors, TooLarge
from countloom.plans.tables import Tables
from countloom.sources.matrix import Experiment, without_cells

LIMIT = 1_000_000
RUN = "index int, chain int, K int, L int, seed int, log_lik double, z array<int>, y array<int>, history array<double>"
RUN_ARROW = pa.schema([("index", pa.int32()), ("chain", pa.int32()), ("K", pa.int32()), ("L", pa.int32()), ("seed", pa.int32()), ("log_lik", pa.float64()), ("z", pa.list_(pa.int32())), ("y", pa.list_(pa.int32())), ("history", pa.list_(pa.float64()))])


@dataclass
class Model:
    """A fitted clustering: labels as tables, the history of log-likelihoods, parameters."""

    kind: str
    params: dict
    log_lik: float
    history: list[float]
    z: DataFrame | None = None
    y: DataFrame | None = None
    names: dict = field(default_factory=dict)


@dataclass
class Matrix:
    """A matrix for the kernels, with the ids of its rows and columns and the numbers of the columns' samples. entries: of one that
    the tasks of a barrier job are to hold, instead of x."""

    x: kernels.Sparse | Blocks | None
    features: np.ndarray
    cells: np.ndarray
    samples: np.ndarray
    entries: DataFrame | None = None

    @property
    def in_blocks(self) -> bool:
        return kernels.at_once(self.x)

    def labels(self, spark: SparkSession, axis: str, values: np.ndarray) -> DataFrame:
        ids, column, label = (self.cells, "cell_id", "z") if axis == "z" else (self.features, "feature_id", "y")
        return spark.createDataFrame(pa.table({column: pa.array(ids), label: pa.array(np.asarray(values, np.int32))}))


def _ids(df: DataFrame, *columns: str) -> pa.Table:
    return df.select(*columns).toArrow().sort_by(columns[0])


def matrix_of(x: Experiment, limit: int | None = None, labels: int | None = None) -> Matrix:
    """The matrix by its entries if these are at most `limit` (LIMIT), in blocks beyond, or, if `labels` says how many labels an axis
    gets at most, as entries for a barrier job whose tasks can hold it. The counts are computed once. A cell or feature without counts
    is an error."""
    limit = LIMIT if limit is None else limit
    spark = x.counts.sparkSession
    tables = Tables(spark)
    counts = tables.save(x.counts.select("feature_id", "cell_id", F.col("n").cast("long").alias("n")), "counts")
    tables.settle()
    size = counts.count()
    most = max(x.cells.count(), x.features.count())
    if most > STATE:
        raise TooLarge(f"{most} items are too many for the driver")
    cells, ids = _ids(x.cells, "cell_id", "sample"), {}
    for axis, own in (("cell_id", cells), ("feature_id", _ids(x.features, "feature_id"))):
        ids[axis] = own.column(0).to_numpy(zero_copy_only=False)
        have = _ids(counts.select(axis).distinct(), axis).column(0).to_numpy(zero_copy_only=False)
        if not np.array_equal(ids[axis], have):
            odd = np.setxor1d(ids[axis], have)[0]
            raise ValueError(f"{axis} {odd} " + ("has no counts" if odd in ids[axis] else "has counts but is not listed"))
    samples = np.unique(cells.column(1).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1]
    if max(size, most) <= limit:
        t = counts.toArrow()
        f, c, n = (t.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        tables.drop("counts")
        whole = kernels.Sparse(np.searchsorted(ids["feature_id"], f), np.searchsorted(ids["cell_id"], c), n, tuple(len(ids[a]) for a in ("feature_id", "cell_id")))
    elif labels is not None and ranks.fits_in(spark, size, most * labels):
        return Matrix(None, ids["feature_id"], ids["cell_id"], samples, counts)
    else:
        whole = Blocks.of(counts, size, ids, tables)
        tables.drop("counts")
    return Matrix(whole, ids["feature_id"], ids["cell_id"], samples)


def grid(params: dict[str, list[int]], chains: int, seed: int) -> list[dict]:
    """All combinations of the parameters, chains varying fastest; chain i is seeded with seed + i - 1."""
    combos: list[dict] = [{}]
    for name, values in params.items():
        combos = [{**c, name: v} for c in combos for v in values]
    out = [{**c, "chain": i, "seed": seed + i - 1} for c in combos for i in range(1, chains + 1)]
    return [{"index": i, **o} for i, o in enumerate(out, 1)]


def fitted(m: Matrix, kind: str, run: dict, priors: Priors, init: str = "random", **how) -> dict:
    """One run by the kernels, as a row of RUN with arrays for lists."""
    rng, k, modules = np.random.default_rng(run["seed"]), run.get("K") or 0, run.get("L") or 0
    z0 = kernels.split_cells(m.x, m.samples, k, priors, rng) if init == "split" and kind in ("c", "cg") else None
    y0 = kernels.split_features(m.x, modules, priors, rng) if init == "split" and kind in ("g", "cg") else None
    if kind == "c":
        f = kernels.fit_cells(m.x, m.samples, k, priors, rng, init=z0, **how)
    elif kind == "g":
        f = kernels.fit_features(m.x, modules, priors, rng, init=y0, **how)
    else:
        f = kernels.fit_both(m.x, m.samples, k, modules, priors, rng, z_init=z0, y_init=y0, **how)
    one = lambda a: None if a is None else (a + 1).astype(np.int32)
    return {"index": run["index"], "chain": run["chain"], "K": k, "L": modules, "seed": run["seed"], "log_lik": float(f.log_lik), "z": one(f.z), "y": one(f.y), "history": [float(v) for v in f.history]}


def _side_by_side(matrix: Matrix, runs: list[dict], work: Callable[[Matrix, dict], object]) -> list:
    """work() of each run over a matrix in blocks, in order. Steps are short jobs that leave executors idle, so runs go side by
    side, as many as have a state that the driver holds; each draws from its own seed."""
    with ThreadPoolExecutor(max(1, min(len(runs), STATE // (8 * max(matrix.x.shape) * _labels(runs))))) as pool:
        return list(pool.map(lambda r: work(replace(matrix, x=matrix.x.apart()), r), runs))


def _held(matrix: Matrix, work: Callable[[Matrix], Iterator[dict]], schema: str, arrow: pa.Schema) -> DataFrame:
    """The rows of work() over a matrix that the tasks of a barrier job hold."""
    samples = matrix.samples

    def run(x: ranks.Held) -> Iterator[pa.RecordBatch]:
        for row in work(Matrix(x, np.zeros(0), np.zeros(0), samples)):
            yield pa.RecordBatch.from_pylist([row], arrow)

    return ranks.held(matrix.entries, {"feature_id": matrix.features, "cell_id": matrix.cells}, run, schema)


def run_all(spark: SparkSession, matrix: Matrix, kind: str, runs: list[dict], priors: Priors, init: str = "random", **how) -> DataFrame:
    """One row a run: in parallel over a matrix that is broadcast, its size having been checked, or over one in blocks,
    some side by side, or one after the other by all tasks that hold one."""
    if matrix.entries is not None:
        return _held(matrix, lambda m: (fitted(m, kind, r, priors, init, **how) for r in runs), RUN, RUN_ARROW)
    if matrix.in_blocks:
        return spark.createDataFrame(pa.Table.from_pylist(_side_by_side(matrix, runs, lambda m, r: fitted(m, kind, r, priors, init, **how)), RUN_ARROW))
    sent = spark.sparkContext.broadcast(matrix)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([fitted(sent.value, kind, run, priors, init, **how)], RUN_ARROW)

    rows = [(r["index"], r["chain"], r.get("K", 0), r.get("L", 0), r["seed"]) for r in runs]
    table = spark.createDataFrame(rows, "index int, chain int, K int, L int, seed int").repartition(len(rows), "index")
    return table.mapInArrow(fit, RUN)


def _rows(runs: DataFrame) -> list[dict]:
    """Rows of runs with their labels as arrays: as many as there are runs, each with a label for each item."""
    table = runs.toArrow()
    own = lambda c, i: None if not c[i].is_valid else c[i].values.to_numpy()
    plain = table.drop_columns(["z", "y"]).to_pylist()
    return [{**r, "z": own(table["z"], i), "y": own(table["y"], i)} for i, r in enumerate(plain)]


def _labels(runs: list[dict]) -> int:
    return max([1, *(r.get(a) or 0 for r in runs for a in ("K", "L"))])


def _best(x: Experiment, kind: str, runs: list[dict], priors: Priors, **how) -> Model:
    spark, m = x.counts.sparkSession, matrix_of(x, labels=_labels(runs))
    best = max(_rows(run_all(spark, m, kind, runs, priors, **how)), key=lambda r: (r["log_lik"], -r["index"]))
    z, y = (None if best[a] is None else m.labels(spark, a, best[a]) for a in ("z", "y"))
    return Model(kind, {**priors.__dict__, **{n: best[n] for n in ("K", "L", "seed")}}, best["log_lik"], list(best["history"]), z, y)


def cluster_cells(x: Experiment, k: int, priors: Priors = Priors(), algorithm: str = "EM", chains: int = 3, seed: int = 12345, init: str = "split", max_iter: int = 200, **how) -> Model:
    """Cells into k populations: the best of some chains."""
    try:
        return _best(x, "c", grid({"K": [k]}, chains, seed), priors, init=init, algorithm=algorithm, max_iter=max_iter, **how)
    except TooLarge:
        own = {"stop_iter": how["stop_iter"]} if "stop_iter" in how else {}
        return max((cluster_cells_distributed(x, k, priors, seed + i, max_iter, algorithm, **own) for i in range(chains)), key=lambda m: m.log_lik)


def cluster_cells_distributed(x: Experiment, k: int, priors: Priors = Priors(), seed: int = 12345, max_iter: int = 200, algorithm: str = "EM", stop_iter: int = 10) -> Model:
    """EM with each step one pass over blocks of whole cells, however many; it ends when a step brings no better likelihood.
    By joins where features and samples x labels are more than blocks.STATE, and for Gibbs."""
    tables = Tables(x.counts.sparkSession)
    ids, samples = (t.select(c).distinct() for t, c in ((x.features.where("feature_id IS NOT NULL"), "feature_id"), (x.cells, F.col("sample").cast("string"))))
    if algorithm != "EM" or (ids := tables.save(ids, "features")).count() * k > STATE or (samples := tables.save(samples, "samples")).count() * k > STATE:
        return cluster_cells_by_joins(x, k, priors, seed, max_iter, algorithm, stop_iter)
    start = x.cells.select("cell_id", "sample", (F.pmod(F.xxhash64("cell_id", F.lit(seed)), F.lit(k)) + 1).alias("z"))
    blocks = Cells(x.counts, start, np.sort(ids.toArrow().column(0).to_numpy()), samples.toArrow().column(0).combine_chunks(), k, tables)
    best = state = None
    value, after = blocks.step(None, priors.alpha, priors.beta)
    history = [value]
    for _ in range(max_iter):
        state = after
        value, after = blocks.step(state, priors.alpha, priors.beta)
        history.append(value)
        if value <= max(history[:-1]):
            break
        best = state
    return Model("c", {**x.params, **priors.__dict__, "K": k}, max(history), history, z=tables.save(blocks.labels(best), "z"))


def cluster_cells_by_joins(x: Experiment, k: int, priors: Priors = Priors(), seed: int = 12345, max_iter: int = 200, algorithm: str = "EM", stop_iter: int = 10) -> Model:
    """EM with each step one join and two aggregations; labels are written between steps, which cuts their lineage. It
    ends when a step brings no better likelihood. Gibbs: all cells draw at once from their conditionals given the labels
    of the step before, which approximates a sequential sweep; it ends after stop_iter steps without a better one."""
    idle = 0
    tables = Tables(x.counts.sparkSession)
    params = {**x.params, **priors.__dict__, "K": k}
    start = x.cells.drop("z").withColumn("z", (F.pmod(F.xxhash64("cell_id", F.lit(seed)), F.lit(k)) + 1).cast("int"))
    now = replace(x, cells=tables.save(start, "cells0"), params=params)
    history, best = [likelihood.log_likelihood(now, "c")], now.cells
    for i in range(1, max_iter + 1):
        if algorithm == "EM":
            labels = rank.best_label(likelihood.cell_scores(now, "c"), "cell_id")
        else:
            labels = rank.drawn_label(likelihood.cell_conditional(now), "cell_id", seed=seed + i)
        now = replace(now, cells=tables.save(now.cells.drop("z").join(labels, "cell_id"), f"cells{i}"))
        value = likelihood.log_likelihood(now, "c")
        history.append(value)
        if value <= max(history[:-1]):
            idle += 1
            if algorithm == "EM" or idle >= stop_iter:
                break
            continue
        best, idle = now.cells, 0
    return Model("c", params, max(history), history, z=best.select("cell_id", "z"))


def cluster_features(x: Experiment, modules: int, priors: Priors = Priors(), chains: int = 3, seed: int = 12345, init: str = "split", **how) -> Model:
    """Features into modules by Gibbs sampling: the best of some chains."""
    try:
        return _best(x, "g", grid({"L": [modules]}, chains, seed), priors, init=init, **how)
    except TooLarge:
        own = {a: b for a, b in how.items() if a in ("max_iter", "stop_iter")}
        return max((modules_distributed(x, 0, modules, priors, seed + i, **own) for i in range(chains)), key=lambda m: m.log_lik)


def modules_distributed(x: Experiment, k: int, modules: int, priors: Priors = Priors(), seed: int = 12345, max_iter: int = 200, algorithm: str = "EM", stop_iter: int = 10) -> Model:
    """Features into modules on DataFrames, and cells into k populations with them unless k is 0. In each step all features
    draw at once from their conditionals given the labels of the step before, which approximates a sequential sweep; then
    cells are assigned on the module sums. It ends after stop_iter steps without a better likelihood."""
    kind = "cg" if k else "g"
    tables, params = Tables(x.counts.sparkSession), {**x.params, **priors.__dict__, "L": modules, **({"K": k} if k else {})}

    def start(items: DataFrame, item: str, label: str, levels: int) -> DataFrame:
        return tables.save(items.drop(label).withColumn(label, (F.pmod(F.xxhash64(item, F.lit(seed)), F.lit(levels)) + 1).cast("int")), f"{label}0")

    now = replace(x, features=start(x.features, "feature_id", "y", modules), cells=start(x.cells, "cell_id", "z", k) if k else x.cells, params=params)
    history, best, idle = [likelihood.log_likelihood(now, kind)], now, 0
    for i in range(1, max_iter + 1):
        y = rank.drawn_label(likelihood.feature_conditional_of_clusters(now) if k else likelihood.feature_conditional(now), "feature_id", "y", seed=seed + i)
        now = replace(now, features=tables.save(now.features.drop("y").join(y, "feature_id"), f"y{i}"))
        if k:
            z = rank.best_label(likelihood.cell_scores(now, "cg"), "cell_id") if algorithm == "EM" else rank.drawn_label(likelihood.cell_conditional_of_modules(now), "cell_id", seed=seed + i)
            now = replace(now, cells=tables.save(now.cells.drop("z").join(z, "cell_id"), f"z{i}"))
        value = likelihood.log_likelihood(now, kind)
        idle = 0 if value > max(history) else idle + 1
        best = now if idle == 0 else best
        history.append(value)
        if idle >= stop_iter:
            break
    return Model(kind, params, max(history), history, best.cells.select("cell_id", "z") if k else None, best.features.select("feature_id", "y"))


def cluster_both(x: Experiment, k: int, modules: int, priors: Priors = Priors(), algorithm: str = "EM", chains: int = 3, seed: int = 12345, init: str = "split", max_iter: int = 200, **how) -> Model:
    """Both at once: the best of some chains."""
    try:
        return _best(x, "cg", grid({"K": [k], "L": [modules]}, chains, seed), priors, init=init, algorithm=algorithm, max_iter=max_iter, **how)
    except TooLarge:
        own = {"stop_iter": how["stop_iter"]} if "stop_iter" in how else {}
        return max((modules_distributed(x, k, modules, priors, seed + i, max_iter, algorithm, **own) for i in range(chains)), key=lambda m: m.log_lik)


def labelled(x: Experiment, model: Model) -> Experiment:
    """x with a model's labels and parameters."""
    cells = x.cells if model.z is None else x.cells.drop("z").join(model.z, "cell_id")
    features = x.features if model.y is None else x.features.drop("y").join(model.y, "feature_id")
    return replace(x, cells=cells, features=features, params={**x.params, **model.params}, models={**x.models, model.kind: model})


def grid_search(x: Experiment, kind: str, params: dict[str, list[int]], chains: int = 3, seed: int = 12345, best_only: bool = True, perplexity: bool = True, priors: Priors = Priors(), fixed: dict | None = None, init: str = "random", **how) -> DataFrame:
    """(index, chain, K, L, seed, log_lik, z, y, history, mean_perplexity): a run for each combination and chain, or the
    best chain of each."""
    allowed = {"c": {"K"}, "g": {"L"}, "cg": {"K", "L"}}[kind]
    if set(params) - allowed or set(fixed or {}) & {"zInit", "yInit", "z_init", "y_init"}:
        raise ValueError(f"parameters to test are {sorted(allowed)}; starting labels cannot be fixed")
    missing = allowed - set(params) - set(fixed or {})
    if missing:
        raise ValueError(f"no value for {sorted(missing)}")
    runs = grid({**{k: [v] for k, v in (fixed or {}).items()}, **params}, chains, seed)
    spark, m = x.counts.sparkSession, matrix_of(x, labels=_labels(runs))
    rows = Tables(spark).save(run_all(spark, m, kind, runs, priors, init, **how), "runs")
    if best_only:
        rows = rank.best_runs(rows, ["K", "L"])
    if not perplexity:
        return rows
    points = resampled_perplexity(spark, m, kind, rows, priors)
    return rows.join(rank.mean_by(points, "perplexity", "index").withColumnRenamed("perplexity", "mean_perplexity"), "index")


POINT_ARROW = pa.schema([("index", pa.int32()), ("K", pa.int32()), ("L", pa.int32()), ("resample", pa.int32()), ("perplexity", pa.float64())])


def resampled_perplexity(spark: SparkSession, matrix: Matrix, kind: str, runs: DataFrame, priors: Priors = Priors(), resamples: int = 0, seed: int = 12345) -> DataFrame:
    """(index, K, L, resample, perplexity): on the matrix itself (resamples = 0) or on redrawn ones, where each cell's
    counts are a multinomial draw with its own total and proportions."""
    if resamples < 0:
        raise ValueError("the number of resamples must not be negative")

    def points(m: Matrix, r: dict) -> list[dict]:
        z, y = (None if r[a] is None else np.asarray(r[a]) - 1 for a in ("z", "y"))
        drawn = [m.x.redrawn([seed, i]) for i in range(resamples)] or [m.x]
        return [{"index": r["index"], "K": r["K"], "L": r["L"], "resample": i, "perplexity": perplexity_of(m, kind, z, y, r["K"], r["L"], priors, x)} for i, x in enumerate(drawn, 1)]

    runs = runs.select("index", "K", "L", "z", "y")
    if matrix.entries is not None:
        known = spark.sparkContext.broadcast(_rows(runs))  # labels of each run
        return _held(matrix, lambda m: (p for r in known.value for p in points(m, r)), "index int, K int, L int, resample int, perplexity double", POINT_ARROW)
    if matrix.in_blocks:
        return spark.createDataFrame(pa.Table.from_pylist([p for some in _side_by_side(matrix, _rows(runs), points) for p in some], POINT_ARROW))
    sent = spark.sparkContext.broadcast(matrix)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(points(sent.value, r), POINT_ARROW)

    return runs.mapInArrow(score, "index int, K int, L int, resample int, perplexity double")


def perplexity_of(m: Matrix, kind: str, z, y, k: int, modules: int, p: Priors, x) -> float:
    """Of the counts x under what the labels make of m."""
    share = lambda a: a / a.sum(axis=0)
    total = int(m.x.sum(axis=0).sum())
    if y is not None:
        n_g = m.x.sum(axis=1)
        psi = (n_g + p.delta) / np.bincount(y, n_g + p.delta, modules)[y]
    if kind == "g":
        phi = np.log(share(kernels.group_sums(m.x.T, y, modules).T + p.beta)).T
        s = x.T @ np.column_stack([np.log(psi), np.eye(modules)[y]])
        return float(np.exp(-(s[:, 0].sum() + (s[:, 1:] * phi).sum()) / total))
    theta = np.log(share(kernels.cross(z, m.samples, k, int(m.samples.max()) + 1) + p.alpha))
    if kind == "c":
        logs = np.log(share(kernels.group_sums(m.x, z, k) + p.beta))
    else:
        logs = np.log(psi[:, None] * share(kernels.group_sums(kernels.group_sums(m.x.T, y, modules).T, z, k) + p.beta)[y])
    s = x.T @ logs + theta[:, m.samples].T
    top = s.max(axis=1)
    return float(np.exp(-(top + np.log(np.exp(s - top[:, None]).sum(axis=1))).sum() / total))


SPLIT = "index int, K int, L int, log_lik double, perplexity double, z array<int>, y array<int>"
SPLIT_ARROW = pa.schema([("index", pa.int32()), ("K", pa.int32()), ("L", pa.int32()), ("log_lik", pa.float64()), ("perplexity", pa.float64()), ("z", pa.list_(pa.int32())), ("y", pa.list_(pa.int32()))])


def recursive_split(x: Experiment, axis: str, first: int, last: int, priors: Priors = Priors(), seed: int = 12345, least: int = 3, other: DataFrame | None = None, temp: int | None = None) -> DataFrame:
    """(index, K, L, log_lik, perplexity, z, y): models of `first` to `last` groups, each made from the one before by its
    best single split and a short fit from there. axis: z for cells, y for features. other: labels of the other axis, on
    whose sums the split is judged; temp: collapse the other axis to so many random groups first."""
    if last < first:
        raise ValueError("the last number of groups is below the first")
    spark, m = x.counts.sparkSession, matrix_of(x)
    fixed = None
    if other is not None:
        t = _ids(other, *other.columns[:2])
        own = t.column(0).to_numpy(zero_copy_only=False)
        fixed = t.column(1).to_numpy()[np.searchsorted(own, m.features if axis == "z" else m.cells)].astype(np.int64) - 1
    if m.in_blocks:
        return spark.createDataFrame(pa.Table.from_pylist(list(splits(m, axis, first, last, priors, seed, least, fixed, temp)), SPLIT_ARROW))
    sent = spark.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for row in splits(sent.value, axis, first, last, priors, seed, least, fixed, temp):
                    yield pa.RecordBatch.from_pylist([row], SPLIT_ARROW)

    return spark.range(1).coalesce(1).mapInArrow(run, SPLIT)  # one model after the other, in one task


def splits(m: Matrix, axis: str, first: int, last: int, priors: Priors, seed: int, least: int, fixed: np.ndarray | None, temp: int | None) -> Iterator[dict]:
    """The models of recursive_split() as rows."""
    from countloom.plans.blocks import Local

    rng, work = np.random.default_rng(seed), m.x
    groups, n = fixed, m.x.shape[0 if axis == "z" else 1]
    if groups is None and temp is not None:
        groups = kernels.random_labels(n, min(temp, n), rng)
    if groups is not None:
        work = kernels.group_sums(m.x.T, groups, int(groups.max()) + 1).T if axis == "z" else kernels.group_sums(m.x, groups, int(groups.max()) + 1)
        work = Local(work) if m.in_blocks else work
    if axis == "z":
        fit = lambda k, init: kernels.fit_cells(work, m.samples, k, priors, rng, init=init, split=False, max_iter=20).z
        judge = lambda trials, k: kernels.lls_cells(work, m.samples, trials, k, priors)
    else:
        fit = lambda k, init: kernels.fit_features(work, k, priors, rng, init=init, split=False, max_iter=5, stop_iter=3).y
        judge = lambda trials, k: kernels.lls_features(work, trials, k, priors)
    halve = lambda labels, groups: kernels.halves(work, m.samples if axis == "z" else None, labels, groups, priors, rng, axis)
    labels = fit(first, None)
    for k in range(first, last + 1):
        if k > first:
            labels, value = kernels.best_single_split(labels, halve, judge, least)
            again = fit(k, labels) if len(np.unique(labels)) == k else labels
            labels = again if len(np.unique(again)) == k and judge([again], k)[0] >= value else labels
        z, y = (labels, fixed) if axis == "z" else (fixed, labels)
        kind = "cg" if fixed is not None else ("c" if axis == "z" else "g")
        big_k, modules = (0 if z is None else int(z.max()) + 1), (0 if y is None else int(y.max()) + 1)
        log_lik = {"c": lambda: kernels.ll_cells(m.x, m.samples, z, big_k, priors), "g": lambda: kernels.ll_features(m.x, y, modules, priors), "cg": lambda: kernels.ll_both(m.x, m.samples, z, y, big_k, modules, priors)}[kind]()
        one = lambda a: None if a is None else (a + 1).astype(np.int32)
        yield {"index": k - first + 1, "K": big_k, "L": modules, "log_lik": float(log_lik), "perplexity": perplexity_of(m, kind, z, y, big_k, modules, priors, m.x), "z": one(z), "y": one(y)}


def split_module(x: Experiment, module: int, n: int = 2, priors: Priors = Priors(), seed: int = 12345) -> Experiment:
    """x with one module divided in n; the first part keeps the label, the others come after the last."""
    members = x.features.where(F.col("y") == module)
    size, last = members.count(), x.params["L"]
    if size < n:
        raise ValueError(f"module {module} has {size} features; it cannot be split in {n}")
    part = replace(x, counts=x.counts.join(members.select("feature_id"), "feature_id", "left_semi"), features=members)
    part = replace(part, cells=x.cells.join(part.counts.select("cell_id").distinct(), "cell_id", "left_semi"))
    y = cluster_features(part, n, priors, 1, seed, init="random").y.withColumnRenamed("y", "part")
    label = F.when(F.col("part") == 1, module).when(F.col("part") > 1, F.lit(last) + F.col("part") - 1).otherwise(F.col("y"))
    return replace(x, features=x.features.join(y, "feature_id", "left").withColumn("y", label.cast("int")).drop("part"), params={**x.params, "L": last + n - 1})


def reordered(x: Experiment, model: str, method: str = "complete") -> Experiment:
    """x with labels renumbered so that similar groups have neighbouring numbers; two groups or fewer stay."""
    from countloom.operators.factorize import factorized

    view = factorized(x, model, "posterior")
    out = x
    for part, axis, levels, side in (("module" if model == "c" else "cellPopulation", "z", x.params["K"], "column"), ("cell" if model == "g" else "cellPopulation", "y", x.params.get("L", 0), "row")):
        if (axis == "z" and model == "g") or (axis == "y" and model == "c") or levels <= 2:
            continue
        table = view.where(F.col("part") == part)
        if side == "column":
            wide = table.groupBy("row").pivot("column", [str(i) for i in range(1, levels + 1)]).agg(F.first("value")).drop("row")
        else:
            wide = table.groupBy("column").pivot("row", [str(i) for i in range(1, levels + 1)]).agg(F.first("value")).drop("column")
        names = wide.columns
        dots = wide.select(*[F.sum(F.col(f"`{a}`") * F.col(f"`{b}`")).alias(f"{a}_{b}") for a in names for b in names]).first()
        gram = np.array([[dots[f"{a}_{b}"] for b in names] for a in names])
        norm = np.sqrt(np.diag(gram))
        order = kernels.complete_order((1 - gram / np.outer(norm, norm)) / 2, method)
        old = [int(i) + 1 for i in order]
        if axis == "z":
            out = replace(out, cells=filters.recoded(out.cells, "z", old, list(range(1, levels + 1))))
        else:
            out = replace(out, features=filters.recoded(out.features, "y", old, list(range(1, levels + 1))))
    return out


@dataclass
class Decontaminated:
    counts: DataFrame
    cells: DataFrame
    delta: tuple[float, float]
    log_lik: list[float]


def remove_ambient(x: Experiment, max_iter: int = 500, delta: tuple[float, float] = (10.0, 10.0), estimate_delta: bool = True, convergence: float = 0.001, every: int = 10, background: DataFrame | None = None, seed: int = 12345) -> Decontaminated:
    """Estimate and take out ambient counts, given cell clusters z (1..K, K >= 2). The native shares begin as seeded Beta
    draws by cell id, and steps repeat until none of them moves by `convergence`. Steps are passes in
    numpy (ambient.py); only beyond blocks.STATE each writes its two small tables to the shared folder. counts are then decontaminated; cells have theta and contamination."""
    if len(delta) != 2 or min(delta) < 0:
        raise ValueError("delta must be two numbers that are not negative")
    if x.params["K"] < 2:
        raise ValueError("at least two clusters are needed")
    spark = x.counts.sparkSession
    tables = Tables(spark)
    counts = x.counts.join(x.cells.select("cell_id"), "cell_id", "left_semi").join(x.features.select("feature_id"), "feature_id", "left_semi")
    x = replace(x, counts=tables.save(counts.select("feature_id", "cell_id", "n"), "counts"))  # read again in every step

    def beta(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(theta=[np.random.default_rng([seed, int(h) & 0x7FFFFFFFFFFFFFFF]).beta(*delta) for h in f.h])[["cell_id", "z", "theta"]]

    id_type = x.cells.schema["cell_id"].dataType.simpleString()
    theta = tables.save(x.cells.select("cell_id", "z", F.xxhash64("cell_id").alias("h")).mapInPandas(beta, f"cell_id {id_type}, z int, theta double"), "theta0")
    eta = None if background is None else tables.save(contamination.background_eta(background, x.features), "eta")
    features = tables.save(x.features.select("feature_id"), "features")
    if max(theta.count(), features.count() * x.params["K"]) <= STATE and theta.where(F.col("z").isNull() | ~F.col("z").between(1, x.params["K"])).isEmpty():
        how = {"max_iter": max_iter, "estimate_delta": estimate_delta, "convergence": convergence, "every": every}
        return _ambient(x, tables, features, theta, eta, delta, how)
    profiles = tables.save(contamination.initial(x, theta, eta), "profiles0")
    history, i, shares = [contamination.log_likelihood(x, theta, profiles).first()[0]], 0, None
    while i < max_iter:
        i += 1
        shares = tables.save(contamination.shares(x, theta, profiles), f"shares{i}")
        delta = contamination.delta_of(shares, delta) if estimate_delta else delta
        fresh = tables.save(contamination.new_theta(shares, delta), f"theta{i}")
        profiles = tables.save(contamination.new_profiles(x, theta, profiles, eta), f"profiles{i}")
        moved = fresh.join(theta.select("cell_id", F.col("theta").alias("before")), "cell_id").agg(F.max(F.abs(F.col("theta") - F.col("before")))).first()[0]
        theta = fresh
        tables.drop(f"theta{i - 1}", f"profiles{i - 1}", f"shares{i - 1}")
        done = moved is None or moved < convergence
        if i % every == 0 or done:
            history.append(contamination.log_likelihood(x, theta, profiles).first()[0])
        if done:
            break
    cells = x.cells.drop("theta", "contamination").join(theta.select("cell_id", "theta"), "cell_id")
    if shares is not None:
        cells = cells.join(shares.select("cell_id", "contamination"), "cell_id")
    return Decontaminated(contamination.native_matrix(x, theta, profiles), cells, delta, history)


def _ambient(x: Experiment, tables: Tables, features: DataFrame, theta: DataFrame, eta: DataFrame | None, delta: tuple[float, float], how: dict) -> Decontaminated:
    """remove_ambient() by passes in numpy: in one task up to ambient.LIMIT entries, beyond by the tasks of one barrier job that hold
    them all, or else in blocks."""
    spark, size, k = x.counts.sparkSession, x.counts.count(), x.params["K"]
    own = lambda t, i: t.column(i).to_numpy(zero_copy_only=False)
    t, f = _ids(theta, "cell_id", "z", "theta"), own(_ids(features, "feature_id"), 0)
    start = ambient.Start(f, own(t, 0), own(t, 1).astype(np.int64) - 1, k, own(t, 2), None if eta is None else own(_ids(eta, "feature_id", "eta"), 1), delta, how)
    if size <= ambient.LIMIT:
        got = ambient.in_one_task(x.counts, start)
    elif ranks.fits_in(spark, size, max(len(start.cells), len(f) * k)):
        got = ambient.in_ranks(x.counts, start)
    else:
        blocks = Blocks.of(x.counts, size, {"feature_id": start.features, "cell_id": start.cells}, tables, np.float64)
        got = ambient.fit(ambient.Spread(blocks, start), start)
    sent = spark.sparkContext.broadcast((f, got["phi"], got["eta"]))  # features x clusters, at most STATE

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, phi, eta = sent.value
        for batch in batches:
            i = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(f[i], k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(i))), pa.array(phi[i].ravel()), pa.array(eta[i].ravel())], ["feature_id", "z", "phi", "eta"])

    id_type = features.schema["feature_id"].dataType.simpleString()
    profiles = tables.save(spark.range(len(f)).mapInArrow(rows, f"feature_id {id_type}, z int, phi double, eta double"), "profiles")
    have = got["have"]
    columns = {"cell_id": t.column(0).filter(pa.array(have)), "z": t.column(1).filter(pa.array(have)), "theta": pa.array(got["theta"][have])}
    if got["contamination"] is not None:
        columns["contamination"] = pa.array(got["contamination"][have])
    theta = tables.save(spark.createDataFrame(pa.table(columns)), "theta")
    cells = x.cells.drop("theta", "contamination").join(theta.drop("z"), "cell_id")
    return Decontaminated(contamination.native_matrix(x, theta.select("cell_id", "z", "theta"), profiles), cells, got["delta"], got["history"])


def remove_ambient_batches(x: Experiment, batch: str, background: DataFrame | None = None, background_batch: str | None = None, **how) -> Decontaminated:
    """Each batch on its own; cluster labels become batch-z. A background is empty droplets (feature_id, cell_id, n and the
    column background_batch, which must be named): those that are cells are taken out, and each batch sees its own."""
    if background is not None and background_batch is None:
        raise ValueError("cells have batches: name the background's batch too")
    if background is not None:
        background = without_cells(background, x.cells)
    names = [r[0] for r in x.cells.select(batch).distinct().orderBy(batch).collect()]
    parts = []
    for name in names:
        cells = x.cells.where(F.col(batch) == name)
        number = filters.relabelled(cells.withColumnRenamed("z", "label"), "label")
        k = number.agg(F.max("z")).first()[0]
        counts = x.counts.join(cells.select("cell_id"), "cell_id", "left_semi")
        own = None if background is None else background.where(F.col(background_batch) == name)
        d = remove_ambient(replace(x, counts=counts, cells=number, params={**x.params, "K": k}), background=own, **how)
        d.cells = d.cells.withColumn("z", F.concat_ws("-", F.lit(str(name)), F.col("label").cast("string")) if len(names) > 1 else F.col("label").cast("string"))
        parts.append(d)
    counts, cells = parts[0].counts, parts[0].cells
    for d in parts[1:]:
        counts, cells = counts.unionByName(d.counts), cells.unionByName(d.cells)
    return Decontaminated(counts, cells, parts[-1].delta, [v for d in parts for v in d.log_lik])


def initial_clusters(x: Experiment, features: int = 2000, seed: int = 12345) -> DataFrame:
    """(cell_id, z): k-means on two principal components of the most variable features, where no labels are given. k-means
    samples its input, which ends tasks early: the points are a written table, without a Python worker that could be stopped."""
    from pyspark.ml.clustering import KMeans

    points = components(x, 2, features)
    model = KMeans(k=2, seed=seed, featuresCol="pc").fit(points)
    return model.transform(points).select("cell_id", (F.col("prediction") + 1).cast("int").alias("z"))


def components(x: Experiment, dims: int, features: int = 2000) -> DataFrame:
    """(cell_id, pc): principal components of log-normalised counts of the most variable features. Rows stay sparse: tasks add up
    products of features, and the driver holds one matrix of features x features. Of each component the largest loading is
    positive. The result is a written table, so what reads only a part of it stops no Python worker."""
    from pyspark.ml.functions import array_to_vector

    from countloom.operators.normalize import log_normalized

    spark, tables = x.counts.sparkSession, Tables(x.counts.sparkSession)
    cells = tables.save(x.cells.select("cell_id"), "cells")
    tables.settle()
    counts = tables.save(x.counts.select("feature_id", "cell_id", "n"), "counts")  # read more than once
    tables.settle()
    values, n = tables.save(log_normalized(counts), "values"), cells.count()
    tables.drop("counts")
    tables.settle()
    top = values.groupBy("feature_id").agg((F.sum(F.col("value") * F.col("value")) - F.sum("value") * F.sum("value") / n).alias("spread"))
    top = [r[0] for r in top.orderBy(F.desc("spread"), "feature_id").limit(features).select("feature_id").collect()]  # at most `features` rows
    at = spark.createDataFrame(list(enumerate(sorted(top))), f"at int, feature_id {x.counts.schema['feature_id'].dataType.simpleString()}")
    rows = values.join(F.broadcast(at), "feature_id").groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("v"))
    rows = tables.save(rows.select("cell_id", F.col("v.at").alias("at"), F.col("v.value").alias("value")), "rows")
    tables.drop("values")
    loadings = _loadings(rows, len(top), n, dims)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, j, v = _entries_of(batch.column(1), batch.column(2))
            pc = np.stack([np.bincount(own, v * w[j], batch.num_rows) for w in loadings.T], axis=1) if loadings.size else np.zeros((batch.num_rows, 0))
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * pc.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pc.ravel())], ["cell_id", "pc"])

    every = cells.join(rows, "cell_id", "left")  # cells with none of these features too
    points = tables.save(every.mapInArrow(place, f"cell_id {x.cells.schema['cell_id'].dataType.simpleString()}, pc array<double>"), "pc")
    tables.drop("rows", "cells")
    return points.select("cell_id", array_to_vector("pc").alias("pc"))


def _entries_of(at: pa.ListArray, value: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the entries of rows that hold a list of columns and one of values, or null."""
    own = np.repeat(np.arange(len(at)), at.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return own, at.flatten().to_numpy(), value.flatten().to_numpy()


def _loadings(rows: DataFrame, size: int, n: int, dims: int, stripe: int = 100) -> np.ndarray:
    """Features x components of the covariance of n rows; those that are not in `rows` (at, value) are zeros."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((size + 1, size))  # and the sums, as products with one
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                own, j, v = _entries_of(*batch.slice(i, 256).columns)
                have, k = np.unique(j, return_inverse=True)
                dense = np.zeros((min(256, batch.num_rows - i), len(have)))
                dense[own, k] = v
                gram[np.ix_(np.append(have, size), have)] += np.concatenate([dense.T @ dense, dense.sum(axis=0)[None]])
        for i in range(0, size + 1, stripe):
            if gram[i : i + stripe].any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([gram[i : i + stripe].tobytes()], pa.binary())], ["i", "part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(part.as_buffer())
        for i, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["i", "part"])

    tasks = rows.sparkSession.sparkContext.defaultParallelism  # each brings a matrix of features x features
    parts = rows.select("at", "value").coalesce(tasks).mapInArrow(products, "i int, part binary")
    gram = np.zeros((size + 1, size))
    for i, part in zip(*parts.repartition(min(tasks, size // stripe + 1), "i").mapInArrow(added, "i int, part binary").toArrow().columns, strict=True):
        own = np.frombuffer(part.as_buffer()).reshape(-1, size)
        gram[i.as_py() : i.as_py() + len(own)] = own
    mean = gram[size] / max(n, 1)
    vectors = np.linalg.eigh((gram[:size] - n * np.outer(mean, mean)) / max(n - 1, 1))[1][:, ::-1][:, : min(dims, size)]
    return vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1) if size else vectors
