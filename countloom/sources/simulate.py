"""Simulated matrices, drawn cell by cell from seeds that depend on the cell's number only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.sources.matrix import Experiment


def dirichlet(rng: np.random.Generator, alpha: np.ndarray) -> np.ndarray:
    """A draw by normalised gammas; if all of them vanish, one category at random."""
    g = rng.gamma(alpha)
    if g.sum() == 0:
        g[rng.integers(len(g))] = 1.0
    return g / g.sum()


def simulate_cells(spark: SparkSession, model: str = "cg", samples: int = 5, cells: tuple[int, int] = (50, 100), depth: tuple[int, int] = (500, 1000), genes: int = 100, k: int = 5, modules: int = 10, alpha: float = 1, beta: float = 1, gamma: float = 5, delta: float = 1, seed: int = 12345) -> Experiment:
    """c: clusters of cells; g: modules of features; cg: both. Features without counts are dropped for g and cg."""
    if model not in ("c", "g", "cg"):
        raise ValueError(f"unknown model {model!r}")
    rng = np.random.default_rng(seed)
    rows: list[tuple[int, str, int]] = []
    for s in range(samples):
        theta = dirichlet(rng, np.full(k, float(alpha)))
        for _ in range(int(rng.integers(cells[0], cells[1] + 1))):
            rows.append((len(rows), f"Sample_{s + 1}", int(rng.choice(k, p=theta)) + 1))
    psi = y = None
    if model in ("g", "cg"):
        share = dirichlet(rng, np.full(modules, float(gamma)))
        y = rng.choice(modules, genes, p=share)
        empty = sorted(set(range(modules)) - set(y.tolist()))
        if empty and model == "g":
            raise ValueError(f"modules {[e + 1 for e in empty]} have no features; a larger gamma avoids that")
        y = np.unique(y, return_inverse=True)[1]
        modules = int(y.max()) + 1
        psi = np.zeros(genes)
        for m in range(modules):
            psi[y == m] = dirichlet(rng, np.full(int((y == m).sum()), float(delta)))
    width = genes if model == "c" else modules
    phi = np.stack([dirichlet(rng, np.full(width, float(beta))) for _ in range(k if model != "g" else 1)])
    low, high = depth

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for c, z in zip(f.cell_id, f.z, strict=True):
                own = np.random.default_rng([seed, int(c)])
                p = phi[z - 1] if model != "g" else dirichlet(own, np.full(width, float(beta)))
                p = p if psi is None else p[y] * psi
                n = own.multinomial(int(own.integers(low, high + 1)), p / p.sum())
                at = np.flatnonzero(n)
                out.append(pd.DataFrame({"feature_id": at, "cell_id": c, "n": n[at]}))
            yield pd.concat(out) if out else pd.DataFrame({"feature_id": [], "cell_id": [], "n": []})

    table = spark.createDataFrame(rows, "cell_id long, sample string, z int").withColumn("name", F.concat(F.lit("Cell_"), F.col("cell_id") + 1))
    counts = table.select("cell_id", "z").mapInPandas(draw, "feature_id long, cell_id long, n long")
    labels = [(g, f"Gene_{g + 1}", 1 if y is None else int(y[g]) + 1) for g in range(genes)]
    features = spark.createDataFrame(labels, "feature_id long, name string, y int")
    if model != "c":
        features = features.join(counts.select("feature_id").distinct(), "feature_id", "left_semi")
    return Experiment(counts, table, features, {"K": k, "L": modules, "alpha": alpha, "beta": beta, "gamma": gamma, "delta": delta, "seed": seed})


def simulate_contamination(spark: SparkSession, cells: int = 300, genes: int = 100, k: int = 3, depth: tuple[int, int] = (500, 1000), beta: float = 0.1, delta: tuple[float, float] = (1, 10), markers: int = 3, seed: int = 12345) -> tuple[Experiment, DataFrame, dict[str, list[str]]]:
    """An experiment of observed counts (with the assay `native`, and contamination among its cells), the native counts,
    and markers: features that only one cluster holds."""
    rng = np.random.default_rng(seed)
    if k < 2:
        raise ValueError("at least two clusters are needed")
    markers = min(markers, genes // k)
    phi = np.stack([dirichlet(rng, np.full(genes, float(beta))) for _ in range(k)])
    names: dict[str, list[str]] = {}
    for z in range(k):
        own = list(range(z * markers, (z + 1) * markers))
        phi[z, own] = np.maximum(phi[z, own], 1 / genes)
        phi[[j for j in range(k) if j != z]][:, own] = 0
        for j in range(k):
            if j != z:
                phi[j, own] = 0
        names[f"CellType_{z + 1}"] = [f"Gene_{g + 1}" for g in own]
    phi /= phi.sum(axis=1, keepdims=True)
    labels = np.concatenate([np.arange(k), rng.integers(0, k, max(cells - k, 0))])[:cells]
    weight = np.bincount(labels, minlength=k)
    eta = np.stack([sum(weight[j] * phi[j] for j in range(k) if j != z) for z in range(k)])
    eta /= eta.sum(axis=1, keepdims=True)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for c, z, share in zip(f.cell_id, f.z, f.contamination, strict=True):
                own = np.random.default_rng([seed, int(c)])
                total = int(own.integers(depth[0], depth[1] + 1))
                ambient = int(own.binomial(total, share))
                a, b = own.multinomial(total - ambient, phi[z - 1]), own.multinomial(ambient, eta[z - 1])
                at = np.flatnonzero(a + b)
                out.append(pd.DataFrame({"feature_id": at, "cell_id": c, "native": a[at], "n": (a + b)[at]}))
            yield pd.concat(out)

    shares = [float(np.random.default_rng([seed, 1, c]).beta(*delta)) for c in range(cells)]
    table = spark.createDataFrame([(c, f"Cell_{c + 1}", "Sample_1", int(labels[c]) + 1, shares[c]) for c in range(cells)], "cell_id long, name string, sample string, z int, contamination double")
    both = table.select("cell_id", "z", "contamination").mapInPandas(draw, "feature_id long, cell_id long, native long, n long")
    features = spark.createDataFrame([(g, f"Gene_{g + 1}") for g in range(genes)], "feature_id long, name string")
    native = both.select("feature_id", "cell_id", F.col("native").alias("n")).where("n > 0")
    x = Experiment(both.select("feature_id", "cell_id", "n"), table, features, {"K": k})
    return x.with_assay("native", native), native, names
