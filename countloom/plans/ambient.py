"""Steps of the contamination mixture in numpy, each one pass over the entries: in one task, by tasks that hold them
between them, or in blocks on the cluster.

An entry's native share is 1 / (1 + ratio * odds), ratio being its feature's and cluster's (eta / phi) and odds its cell's
((1 - theta) / theta), so that a pass reads two numbers an entry. Labels are 0-based here.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from countloom.operators.contamination import TINY, fitted_delta
from countloom.plans.blocks import Block, Blocks
from countloom.plans.ranks import Held, held

#: Entries that one task holds.
LIMIT = 8_000_000


@dataclass
class Start:
    """What a fit begins with: ids in order, clusters and native shares of cells, the ambient profile if it is given."""

    features: np.ndarray
    cells: np.ndarray
    z: np.ndarray
    k: int
    theta: np.ndarray
    eta: np.ndarray | None
    delta: tuple[float, float]
    how: dict


class Entries:
    """All entries in one place, in the order of cells."""

    def __init__(self, f: np.ndarray, c: np.ndarray, n: np.ndarray, start: Start):
        order = np.argsort(c, kind="stable")
        self.c, self.n = c[order].astype(np.int32), n[order].astype(float)
        self.shape = len(start.features), start.k
        self.at = f[order].astype(np.int64) * start.k + start.z[self.c]
        self.cells = len(start.cells)

    def totals(self) -> np.ndarray:
        return np.bincount(self.c, self.n, self.cells)

    def weighted(self, theta: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.n * theta[self.c], np.prod(self.shape)).reshape(self.shape)

    def native(self, ratio: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Native counts by cell, and by feature and cluster."""
        own = ratio.ravel()[self.at]
        own *= odds[self.c]
        own += 1
        np.divide(self.n, own, out=own)
        return np.bincount(self.c, own, self.cells), np.bincount(self.at, own, np.prod(self.shape)).reshape(self.shape)

    def log_lik(self, phi: np.ndarray, eta: np.ndarray, theta: np.ndarray) -> float:
        t = theta[self.c]
        return float((self.n * np.log(phi.ravel()[self.at] * t + eta.ravel()[self.at] * (1 - t) + TINY)).sum())


def _by_feature(b: Block, s: dict) -> np.ndarray:
    """Native counts (or counts times `weight`) of a block's features by cluster."""
    z, k = s["z"][b.j], s["k"]
    n = b.n * s["weight"][b.j] if "weight" in s else b.n / (1 + s["ratio"][b.at[b.own], z] * s["odds"][b.j])
    return np.bincount(b.own * k + z, n, len(b.at) * k).reshape(-1, k)


def _by_cell(b: Block, s: dict) -> np.ndarray:
    return b.reduce(b.n / (1 + s["ratio"][b.j, s["z"][b.at][b.own]] * np.repeat(s["odds"][b.at], np.diff(b.first))))


def _logs(b: Block, s: dict) -> np.ndarray:
    z, t = s["z"][b.at][b.own], np.repeat(s["theta"][b.at], np.diff(b.first))
    return b.reduce(b.n * np.log(s["phi"][b.j, z] * t + s["eta"][b.j, z] * (1 - t) + TINY))


class Spread:
    """The same over blocks on the cluster."""

    def __init__(self, blocks: Blocks, start: Start):
        self.x, self.labels = blocks, {"z": start.z.astype(np.int32), "k": start.k}

    def totals(self) -> np.ndarray:
        return self.x.sum(axis=0)

    def weighted(self, theta: np.ndarray) -> np.ndarray:
        return self.x._gathered(0, _by_feature, {**self.labels, "weight": theta})

    def native(self, ratio: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        state = {**self.labels, "ratio": ratio, "odds": odds}
        if isinstance(self.x, Held):
            return self.x._gathered(1, _by_cell, state), self.x._gathered(0, _by_feature, state)
        with ThreadPoolExecutor(2) as both:
            by_cell, by_feature = both.map(lambda a: self.x._gathered(a[0], a[1], state), ((1, _by_cell), (0, _by_feature)))
        return by_cell, by_feature

    def log_lik(self, phi: np.ndarray, eta: np.ndarray, theta: np.ndarray) -> float:
        return float(self.x._gathered(1, _logs, {**self.labels, "phi": phi, "eta": eta, "theta": theta}).sum())


def _profiles(weights: np.ndarray, eta: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    share = lambda a: a / np.where((s := a.sum(axis=0)) > 0, s, 1)
    return share(weights), share(np.maximum(weights.sum(axis=1, keepdims=True) - weights, 0)) if eta is None else np.repeat(eta[:, None], weights.shape[1], axis=1)


def fit(x: Entries | Spread, start: Start) -> dict:
    """Steps until no native share moves by `convergence`. A cell without counts has no share."""
    delta, theta, (max_iter, estimate, convergence, every) = start.delta, start.theta, (start.how[a] for a in ("max_iter", "estimate_delta", "convergence", "every"))
    n = x.totals().astype(float)
    phi, eta = _profiles(x.weighted(theta) + TINY, start.eta)
    history, contamination = [x.log_lik(phi, eta, theta)], None
    have = n > 0
    for i in range(1, max_iter + 1):
        native, weights = x.native((eta + TINY) / (phi + TINY), (1 - theta + TINY) / (theta + TINY))
        contamination = (n - native) / np.where(have, n, 1)
        if estimate and have.any():
            c = np.clip(contamination[have], 1e-10, 1 - 1e-10)
            delta = fitted_delta((float(np.log(1 - c).mean()), float(np.log(c).mean())), delta)
        fresh = (native + delta[0]) / (n + delta[0] + delta[1])
        phi, eta = _profiles(weights, start.eta)
        done = not have.any() or float(np.abs(fresh - theta)[have].max()) < convergence
        theta = fresh
        if i % every == 0 or done:
            history.append(x.log_lik(phi, eta, theta))
        if done:
            break
    return {"theta": theta, "contamination": contamination, "have": have if contamination is not None else np.ones_like(have), "phi": phi, "eta": eta, "delta": delta, "history": history}


def in_one_task(counts: DataFrame, start: Start) -> dict:
    """fit() over (feature_id, cell_id, n), all of which one task reads."""
    sent = counts.sparkSession.sparkContext.broadcast(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        held = [(np.searchsorted(s.features, b.column(0).to_numpy(zero_copy_only=False)).astype(np.int32), np.searchsorted(s.cells, b.column(1).to_numpy(zero_copy_only=False)).astype(np.int32), b.column(2).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        f, c, n = (np.concatenate(a) for a in zip(*held, strict=True)) if held else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(Entries(f, c, n, s), s), 5)], pa.binary())], ["out"])

    return pickle.loads(counts.select("feature_id", "cell_id", "n").coalesce(1).mapInArrow(run, "out binary").toArrow().column(0)[0].as_buffer())


def in_ranks(counts: DataFrame, start: Start) -> dict:
    """fit() over (feature_id, cell_id, n), which the tasks of one barrier job hold between them."""
    sent = counts.sparkSession.sparkContext.broadcast(start)

    def run(x: Held) -> Iterator[pa.RecordBatch]:
        data = memoryview(pickle.dumps(fit(Spread(x, sent.value), sent.value), 5))
        for i in range(0, len(data), 1 << 24):
            yield pa.RecordBatch.from_arrays([pa.array([data[i : i + (1 << 24)].tobytes()], pa.binary())], ["out"])

    got = held(counts, {"feature_id": start.features, "cell_id": start.cells}, run, "out binary", np.float64).toArrow().column(0)
    return pickle.loads(b"".join(v.as_buffer() for v in got))
