"""t-distributed stochastic neighbours over all cells, by the tasks of one barrier job.

Cells at one point stay at one place, as no force parts them, so the layout is that of the distinct points with the number of
cells at each as weights. Nearest points are found by comparing all pairs; affinities reach to 3 * perplexity other points;
forces that repel are sums over all cells, for more than EXACT points by cubic polynomials on a grid and Fourier transforms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from countloom.plans.ranks import Ranks, barrier

#: Points of which all pairs are summed in every round; numbers of a tile of distances; nodes of the grid by unit of length, and the
#: most along an axis.
EXACT, TILE, NODES, MOST = 4000, 1 << 22, 3, 1200


def distinct(points: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct points in order, which of them each one is, and their weights."""
    points = np.ascontiguousarray(points + 0.0)
    _, at, which = np.unique(points.view(f"V{points.itemsize * points.shape[1]}").ravel() if len(points) else np.zeros(0), return_index=True, return_inverse=True)
    return points[at], which.ravel(), np.bincount(which.ravel(), weight, len(at))


def nearest(points: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the points numbered `own`: the k nearest others, and squared distances."""
    norm, step = (points**2).sum(axis=1), max(1, TILE // len(points))
    near, far = np.zeros((len(own), k), np.int32), np.zeros((len(own), k))
    for i in range(0, len(own), step):
        at = own[i : i + step]
        d = points[at] @ points.T
        d *= -2
        d += norm
        d[np.arange(len(at)), at] = np.inf
        near[i : i + step] = np.argpartition(d, k - 1, axis=1)[:, :k]
        far[i : i + step] = np.maximum(np.take_along_axis(d, near[i : i + step].astype(np.int64), axis=1) + norm[at, None], 0)
    return near, far


def conditionals(far: np.ndarray, many: np.ndarray, alone: np.ndarray, perplexity: float) -> np.ndarray:
    """The affinity of one cell to each cell at the near points. many: cells at these; alone: other cells at its own point."""
    goal, low, high, beta = np.log(perplexity), np.zeros(len(far)), np.full(len(far), np.inf), np.ones(len(far))
    base = np.where(alone > 0, 0, far.min(axis=1))[:, None]
    for _ in range(60):
        e = np.exp(-(far - base) * beta[:, None])
        total = alone + (many * e).sum(axis=1)
        entropy = np.log(total) + beta * (many * e * (far - base)).sum(axis=1) / total
        if (np.abs(entropy - goal) < 1e-5).all():
            break
        wide = entropy > goal
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.minimum(np.where(np.isinf(high), beta * 2, (low + np.where(np.isinf(high), 0, high)) / 2), 1e12)
    return e / total[:, None]


class Grid:
    """Sums over all points of charges times a kernel of the distance, interpolated from the four nearest nodes along each axis."""

    def __init__(self, y: np.ndarray):
        low = y.min(axis=0)
        span = max(float((y.max(axis=0) - low).max()), 1e-12)
        inner = int(np.clip(np.ceil(NODES * span), 150, MOST))
        self.n, self.h = inner + 4, span / inner
        u = (y - low) / self.h + 1
        self.node = u.astype(np.int64) - 1
        t = u - 1 - self.node
        self.share = np.stack([-t * (t - 1) * (t - 2) / 6, (t + 1) * (t - 1) * (t - 2) / 2, -(t + 1) * t * (t - 2) / 2, (t + 1) * t * (t - 1) / 6])

    def _terms(self, rows: slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a in range(4):
            for b in range(4):
                yield (self.node[rows, 0] + a) * self.n + self.node[rows, 1] + b, self.share[a, rows, 0] * self.share[b, rows, 1]

    def field(self, charge: np.ndarray, power: int) -> np.ndarray:
        """The sums at the nodes, for the kernel 1 / (1 + d^2)^power."""
        at, n = np.zeros(self.n * self.n), self.n
        for where, share in self._terms(slice(None)):
            at += np.bincount(where, share * charge, n * n)
        off = np.minimum(np.arange(2 * n), 2 * n - np.arange(2 * n)) * self.h
        kernel = np.fft.rfft2(1 / (1 + off[:, None] ** 2 + off**2) ** power)
        return np.fft.irfft2(kernel * np.fft.rfft2(at.reshape(n, n), (2 * n, 2 * n)), (2 * n, 2 * n))[:n, :n].ravel()

    def at(self, fields: list[np.ndarray], rows: slice) -> list[np.ndarray]:
        out = [np.zeros(rows.stop - rows.start) for _ in fields]
        for where, share in self._terms(rows):
            for o, f in zip(out, fields, strict=True):
                o += share * f[where]
        return out


def repelled(ranks: Ranks, y: np.ndarray, many: np.ndarray, rows: slice) -> list[np.ndarray]:
    """At the points `rows`: sums over all cells of q, of q^2, and of q^2 times their places, q being 1 / (1 + d^2)."""
    if len(y) > EXACT:
        grid, charges = Grid(y), [(many, 1), (many, 2), (many * y[:, 0], 2), (many * y[:, 1], 2)]
        fields = dict(x for some in ranks.gather([(i, grid.field(*c)) for i, c in enumerate(charges) if i % ranks.size == ranks.rank]) for x in some)
        return grid.at([fields[i] for i in range(4)], rows)
    out = [np.zeros(rows.stop - rows.start) for _ in range(4)]
    step = max(1, TILE // len(y))
    for i in range(rows.start, rows.stop, step):
        own = y[i : min(i + step, rows.stop)]
        q = 1 / (1 + (own[:, 0, None] - y[:, 0]) ** 2 + (own[:, 1, None] - y[:, 1]) ** 2)
        part = slice(i - rows.start, i - rows.start + len(own))
        out[0][part] = q @ many
        q *= q
        for o, charge in zip(out[1:], (many, many * y[:, 0], many * y[:, 1]), strict=True):
            o[part] = q @ charge
    return out


def layout(ranks: Ranks, points: np.ndarray, many: np.ndarray, perplexity: float = 20, rounds: int = 500, seed: int = 12345) -> np.ndarray:
    """Places of distinct points, at each of which are `many` cells: the descent of embed.stochastic_neighbours()."""
    m, cells = len(points), float(many.sum())
    if m < 2:
        return np.zeros((m, 2))
    perplexity = min(perplexity, max((cells - 1) / 3, 1))
    cut = m * np.arange(ranks.size + 1) // ranks.size
    rows = slice(int(cut[ranks.rank]), int(cut[ranks.rank + 1]))
    own, k = np.arange(rows.start, rows.stop), min(max(1, int(3 * perplexity)), m - 1)
    near, far = nearest(points, own, k)
    p = conditionals(far, many[near], many[own] - 1, perplexity) if len(own) else far
    edges = np.repeat(own, k).astype(np.int32), near.ravel(), p.ravel()
    del near, far
    to = np.searchsorted(cut, edges[1], "right") - 1
    back = ranks.swap(lambda r: tuple(edges[i][to == r] for i in (1, 0, 2)))
    a, b, w = (np.concatenate([e, *(x[i] for x in back)]) for i, e in enumerate(edges))
    order = np.lexsort((b, a))
    a, b, w = a[order], b[order], w[order]
    w *= many[b] / (2 * cells)
    first, size = np.searchsorted(a, own), np.bincount(a - rows.start, minlength=len(own))
    y = np.random.default_rng(seed).normal(0, 1e-4, (m, 2))
    speed, gain, rate = np.zeros((len(own), 2)), np.ones((len(own), 2)), max(200.0, cells / 12)
    for i in range(rounds):
        q, q2, *pulls = repelled(ranks, y, many, rows)
        total = (np.concatenate(ranks.gather(q)) - 1) @ many
        if len(own):
            gaps = [np.repeat(y[rows, d], size) - y[b, d] for d in (0, 1)]
            f = w / (1 + gaps[0] ** 2 + gaps[1] ** 2) * (4 if i < 100 else 1)
            slope = np.stack([4 * (np.add.reduceat(f * gaps[d], first) - (y[rows, d] * q2 - pulls[d]) / total) for d in (0, 1)], axis=1)
            gain = np.maximum(np.where((slope > 0) == (speed > 0), gain * 0.8, gain + 0.2), 0.01)
            speed = (0.5 if i < 250 else 0.8) * speed - rate * gain * slope
        y = np.concatenate(ranks.gather(y[rows] + speed))
        y -= many @ y / cells
    return y


def places(points: DataFrame, **how) -> DataFrame:
    """(cell_id, dim1, dim2) of points (cell_id, pc array<double>): each task gives the places of the rows that it has read."""

    def run(ranks: Ranks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own = [], [np.zeros((0, 0))]
        for b in batches:
            if b.num_rows:
                ids.append(b.column(0))
                own.append(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1))
        width = max(ranks.gather(own[-1].shape[1]))
        own = np.concatenate([x.reshape(-1, width) for x in own])
        mine, which, many = distinct(own)
        del own
        every = ranks.gather((mine, many))
        known, at, many = distinct(np.concatenate([x for x, _ in every]), np.concatenate([w for _, w in every]))
        before = sum(len(x) for x, _ in every[: ranks.rank])
        at = at[before : before + len(mine)][which]
        del every, mine
        y = layout(ranks, known, many, **how)
        i = 0
        for c in ids:
            own = at[i : i + len(c)]
            i += len(c)
            yield pa.RecordBatch.from_arrays([c, pa.array(y[own, 0]), pa.array(y[own, 1])], ["cell_id", "dim1", "dim2"])

    return barrier(points.select("cell_id", "pc"), run, f"cell_id {points.schema['cell_id'].dataType.simpleString()}, dim1 double, dim2 double", every=True)
