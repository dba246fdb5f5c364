"""Fits in numpy: Gibbs sweeps, EM steps, splits.

A matrix is features x cells of non-negative integers: dense or Sparse, whose Gibbs sweeps go through the items one by one,
or blocks.Blocks, which is marked `at_once`: all its items are drawn from the labels of the step before, groups are halved
together and several vectors of labels are judged in one pass. Labels are 0-based here and 1-based outside. log-gamma of
counts comes from tables, as counts are integers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np


class TooLarge(ValueError):
    pass


def log_gamma(x: np.ndarray) -> np.ndarray:
    """lgamma of positive numbers: Stirling's series from 8 on, and the recurrence below."""
    x, less = np.asarray(x, float), 0.0
    if x.size and x.min() < 8:
        less = np.ones_like(x)
        for _ in range(8):
            low = x < 8
            less[low] *= x[low]
            x = np.where(low, x + 1, x)
        less = np.log(less)
    v = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - v * (1 / 360 - v * (1 / 1260 - v / 1680))) / x - less


class LogGamma:
    """lgamma(n + prior) for integers n >= 0, from a table that grows up to TOP, and by Stirling's series beyond."""

    TOP = 1 << 16

    def __init__(self, prior: float):
        self.prior, self.table = prior, np.array([math.lgamma(prior)])

    def __call__(self, n: np.ndarray | int) -> np.ndarray:
        top = int(np.max(n)) if np.size(n) else 0
        if top >= len(self.table) and len(self.table) < self.TOP:
            k = np.arange(len(self.table), min(max(top + 1, 2 * len(self.table)), self.TOP))
            self.table = np.concatenate([self.table, self.table[-1] + np.cumsum(np.log(k - 1 + self.prior))])
        if top < len(self.table):
            return self.table.take(n)
        v = np.maximum(n, self.TOP) + self.prior
        far = (v - 0.5) * np.log(v) - v + 0.5 * math.log(2 * math.pi) + 1 / (12 * v) - 1 / (360 * v**3)
        return np.where(np.asarray(n) < self.TOP, self.table[np.minimum(n, self.TOP - 1)], far)


class Sparse:
    """A matrix held by its entries in order of column and row: its size goes by entries, not by positions."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int]):
        order = np.lexsort((rows, columns))
        self.rows, self.columns, self.values, self.shape = rows[order].astype(np.int32), columns[order].astype(np.int32), values[order], shape
        self.first = np.searchsorted(self.columns, np.arange(shape[1] + 1))
        self._turned: Sparse | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_turned": None}

    @property
    def T(self) -> Sparse:  # noqa: N802
        if self._turned is None:
            self._turned = Sparse(self.columns, self.rows, self.values, self.shape[::-1])
            self._turned._turned = self
        return self._turned

    def redrawn(self, seed: list[int]) -> Sparse:
        """Each cell drawn again with its own total and proportions; what it has none of is never drawn."""
        own = [self.column(c)[1] for c in range(self.shape[1])]
        values = np.concatenate([np.random.default_rng([*seed, c]).multinomial(v.sum(), v / v.sum()) for c, v in enumerate(own)])
        return Sparse(self.rows, self.columns, values, self.shape)

    def column(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.first[c], self.first[c + 1])
        return self.rows[own], self.values[own]

    def __getitem__(self, key) -> Sparse:
        """Whole rows x[members], or whole columns x[:, members]."""
        if not isinstance(key, tuple):
            return self.T[:, key].T
        members = np.asarray(key[1])
        size = np.diff(self.first)[members]
        at = np.repeat(self.first[:-1][members] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return Sparse(self.rows[at], np.repeat(np.arange(len(members)), size), self.values[at], (self.shape[0], len(members)))

    def sum(self, axis: int) -> np.ndarray:
        of, n = (self.columns, self.shape[1]) if axis == 0 else (self.rows, self.shape[0])
        return np.bincount(of, self.values, n).astype(np.int64)

    def __matmul__(self, dense: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.rows, self.values * dense[self.columns, j], self.shape[0]) for j in range(dense.shape[1])], axis=1)


def at_once(x) -> bool:
    return getattr(x, "axes", None) is not None


def column(x: np.ndarray | Sparse, c: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values of the entries of a column."""
    if isinstance(x, Sparse):
        return x.column(c)
    at = np.flatnonzero(x[:, c])
    return at, x[at, c]


def group_sums(x: np.ndarray | Sparse, labels: np.ndarray, levels: int) -> np.ndarray:
    """Columns of x summed by label."""
    if at_once(x):
        return x.group_sums(labels, levels)
    if isinstance(x, np.ndarray) and x.shape[0] <= 64:
        return np.stack([np.bincount(labels, row, levels) for row in x]).astype(x.dtype) if len(x) else np.zeros((0, levels), x.dtype)
    if isinstance(x, Sparse):
        at = x.rows.astype(np.int64) * levels + labels[x.columns]
        return np.bincount(at, x.values, x.shape[0] * levels).astype(np.int64).reshape(x.shape[0], levels)
    out = np.zeros((x.shape[0], levels), x.dtype)
    np.add.at(out.T, labels, x.T)
    return out


def cross(z: np.ndarray, s: np.ndarray, k: int, samples: int) -> np.ndarray:
    return np.bincount(z * samples + s, minlength=k * samples).reshape(k, samples)


def softmax_draw(scores: np.ndarray, rng: np.random.Generator) -> int:
    p = np.exp(scores - scores.max())
    return int(np.searchsorted(np.cumsum(p) / p.sum(), rng.random()))


def dirichlet_term(sums: np.ndarray, prior: float) -> float:
    """Log marginal of multinomial columns under a symmetric prior."""
    width, groups = sums.shape
    gain = LogGamma(prior)(sums) - math.lgamma(prior)
    ends = LogGamma(width * prior)(sums.sum(axis=0))
    return float(gain.sum() + groups * math.lgamma(width * prior) - ends.sum())


@dataclass
class Priors:
    alpha: float = 1.0
    beta: float = 1.0
    delta: float = 1.0
    gamma: float = 1.0


@dataclass
class Fit:
    log_lik: float
    z: np.ndarray | None = None
    y: np.ndarray | None = None
    history: list[float] = field(default_factory=list)


def ll_cells(x: np.ndarray, s: np.ndarray, z: np.ndarray, k: int, p: Priors) -> float:
    return dirichlet_term(cross(z, s, k, int(s.max()) + 1), p.alpha) + dirichlet_term(group_sums(x, z, k), p.beta)


def module_terms(by_feature: np.ndarray, y: np.ndarray, modules: int, p: Priors) -> float:
    """psi and eta: each module has one pseudo-feature more."""
    size = np.bincount(y, minlength=modules) + 1
    n = np.bincount(y, by_feature, modules).astype(np.int64)
    psi = sum(math.lgamma(a * p.delta) - math.lgamma(b + a * p.delta) for a, b in zip(size.tolist(), n.tolist(), strict=True))
    psi += LogGamma(p.delta)(by_feature).sum() - size.sum() * math.lgamma(p.delta)
    eta = math.lgamma(modules * p.gamma) + sum(math.lgamma(a + p.gamma) for a in size.tolist()) - modules * math.lgamma(p.gamma) - math.lgamma(float((size + p.gamma).sum()))
    return float(psi + eta)


def ll_features(x: np.ndarray, y: np.ndarray, modules: int, p: Priors) -> float:
    return dirichlet_term(group_sums(x.T, y, modules).T, p.beta) + module_terms(x.sum(axis=1), y, modules, p)


def lls_cells(x, s: np.ndarray, trials: list[np.ndarray], k: int, p: Priors) -> list[float]:
    """ll_cells() of several vectors of labels."""
    if not at_once(x):
        return [ll_cells(x, s, z, k, p) for z in trials]
    gains, totals = x.trials(trials, k, p.beta)
    width = x.shape[0] * p.beta
    ends = LogGamma(width)(totals.astype(np.int64)).sum(axis=1)
    return [dirichlet_term(cross(z, s, k, int(s.max()) + 1), p.alpha) + g + k * math.lgamma(width) - e for z, g, e in zip(trials, gains.tolist(), ends.tolist(), strict=True)]


def lls_features(x, trials: list[np.ndarray], modules: int, p: Priors) -> list[float]:
    """ll_features() of several vectors of labels."""
    if not at_once(x):
        return [ll_features(x, y, modules, p) for y in trials]
    gains, _ = x.T.trials(trials, modules, p.beta)
    by_cell, by_feature = x.sum(axis=0), x.sum(axis=1)
    rest = len(by_cell) * math.lgamma(modules * p.beta) - float(LogGamma(modules * p.beta)(by_cell).sum())
    return [g + rest + module_terms(by_feature, y, modules, p) for y, g in zip(trials, gains.tolist(), strict=True)]


def ll_joint(blocks: np.ndarray, by_feature: np.ndarray, s: np.ndarray, z: np.ndarray, y: np.ndarray, k: int, modules: int, p: Priors) -> float:
    """blocks: counts by module and cluster."""
    return dirichlet_term(cross(z, s, k, int(s.max()) + 1), p.alpha) + dirichlet_term(blocks, p.beta) + module_terms(by_feature, y, modules, p)


def ll_both(x: np.ndarray, s: np.ndarray, z: np.ndarray, y: np.ndarray, k: int, modules: int, p: Priors) -> float:
    return ll_joint(group_sums(group_sums(x.T, y, modules).T, z, k), x.sum(axis=1), s, z, y, k, modules, p)


def cell_scores(x: np.ndarray, s: np.ndarray, z: np.ndarray, k: int, p: Priors) -> np.ndarray:
    """Cells x clusters: log posterior means, as the EM step weighs them."""
    phi = group_sums(x, z, k) + p.beta
    theta = cross(z, s, k, int(s.max()) + 1) + p.alpha
    return x.T @ np.log(phi / phi.sum(axis=0)) + np.log(theta / theta.sum(axis=0)).T[s]


def cell_conditionals(x: np.ndarray, s: np.ndarray, z: np.ndarray, k: int, p: Priors, rng: np.random.Generator | None = None) -> np.ndarray:
    """Scores of each cell given all others; with rng a Gibbs sweep in random order that changes z."""
    if at_once(x):
        out = cells_at_once(x, s, z, k, p)
        if rng is not None:
            z[:] = drawn(out, rng)
        return out
    sums, table, total = group_sums(x, z, k), cross(z, s, k, int(s.max()) + 1), None
    total = sums.sum(axis=0)
    lg, lw = LogGamma(p.beta), LogGamma(p.beta * x.shape[0])
    out = np.zeros((x.shape[1], k))
    for c in rng.permutation(x.shape[1]) if rng is not None else range(x.shape[1]):
        at, own = column(x, c)
        n = int(own.sum())
        sums[at, z[c]] -= own
        table[z[c], s[c]] -= 1
        total[z[c]] -= n
        out[c] = np.log(table[:, s[c]] + p.alpha) + (lg(sums[at] + own[:, None]) - lg(sums[at])).sum(axis=0) - lw(total + n) + lw(total)
        if rng is not None:
            z[c] = softmax_draw(out[c], rng)
        sums[at, z[c]] += own
        table[z[c], s[c]] += 1
        total[z[c]] += n
    return out


def feature_conditionals(x: np.ndarray, y: np.ndarray, modules: int, p: Priors, rng: np.random.Generator | None = None) -> np.ndarray:
    """Scores of each feature given all others; with rng a Gibbs sweep in random order that changes y."""
    if at_once(x):
        out = features_at_once(x, y, modules, p)
        if rng is not None:
            y[:] = drawn(out, rng)
        return out
    sums = group_sums(x.T, y, modules)  # columns x modules
    size, total = np.bincount(y, minlength=modules) + 1, sums.sum(axis=0)
    lg, lgam = LogGamma(p.beta), LogGamma(p.gamma)
    out = np.zeros((x.shape[0], modules))
    lgv, turned = np.vectorize(math.lgamma, otypes=[float]), x.T
    for g in rng.permutation(x.shape[0]) if rng is not None else range(x.shape[0]):
        at, own = column(turned, g)
        n = int(own.sum())
        sums[at, y[g]] -= own
        size[y[g]] -= 1
        total[y[g]] -= n
        score = (lg(sums[at] + own[:, None]) - lg(sums[at])).sum(axis=0) + lgam(size + 1) - lgam(size)
        score += lgv((size + 1) * p.delta) - lgv(size * p.delta)
        score += lgv(total + size * p.delta) - lgv(total + n + (size + 1) * p.delta)
        out[g] = score
        if rng is not None:
            y[g] = softmax_draw(score, rng)
        sums[at, y[g]] += own
        size[y[g]] += 1
        total[y[g]] += n
    return out


def drawn(scores: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A draw from each row's log-probabilities, by Gumbel noise."""
    return (scores + rng.gumbel(size=scores.shape)).argmax(axis=1)


def _rows(n: int, size: int = 1 << 18) -> list[slice]:
    return [slice(i, i + size) for i in range(0, n, size)]


def _levels(groups: np.ndarray | None, rows: slice, levels: int) -> np.ndarray:
    return np.arange(levels)[None] if groups is None else 2 * groups[rows, None] + np.arange(2)


def cells_at_once(x, s: np.ndarray, z: np.ndarray, k: int, p: Priors) -> np.ndarray:
    """Scores of each cell given the labels of all others."""
    sums, table, n = group_sums(x, z, k), cross(z, s, k, int(s.max()) + 1), x.sum(axis=0)
    out, total, width = x.T.gains(sums, z, p.beta), sums.sum(axis=0), p.beta * x.shape[0]
    for r in _rows(len(z)):
        mine = z[r, None] == np.arange(k)
        rest, own = total - mine * n[r, None], n[r, None]
        out[r] += np.log(table.T[s[r]] - mine + p.alpha) - log_gamma(rest + own + width) + log_gamma(rest + width)
    return out


def features_at_once(x, y: np.ndarray, modules: int, p: Priors, groups: np.ndarray | None = None) -> np.ndarray:
    """Scores of each feature given the labels of all others. groups: label y is 2 * group + half, and a feature has
    scores for the two halves of its group."""
    sums, n = group_sums(x.T, y, modules), x.sum(axis=1)
    out, all_sizes, total = x.gains(sums, y, p.beta, groups), np.bincount(y, minlength=modules) + 1, sums.sum(axis=0)
    for r in _rows(len(y)):
        levels = _levels(groups, r, modules)
        mine, own = y[r, None] == levels, n[r, None]
        size, rest = all_sizes[levels] - mine, total[levels] - mine * own
        out[r] += np.log(size + p.gamma) + log_gamma((size + 1) * p.delta) - log_gamma(size * p.delta)
        out[r] += log_gamma(rest + size * p.delta) - log_gamma(rest + own + (size + 1) * p.delta)
    return out


def random_labels(n: int, levels: int, rng: np.random.Generator) -> np.ndarray:
    """Uniform labels, each level used at least once if there are enough items."""
    out = rng.integers(0, levels, n)
    for level in range(min(levels, n)):
        if not (out == level).any():
            sizes = np.bincount(out, minlength=levels)
            out[np.flatnonzero(out == sizes.argmax())[0]] = level
    return out


def start_labels(n: int, levels: int, rng: np.random.Generator, init: np.ndarray | None) -> np.ndarray:
    if init is None:
        return random_labels(n, levels, rng)
    init = np.asarray(init, np.int64)
    if len(init) != n or len(np.unique(init)) != levels:
        raise ValueError(f"predefined labels must have length {n} and {levels} levels")
    return init.copy()


def two_way(x: np.ndarray, s: np.ndarray | None, members: np.ndarray, p: Priors, rng: np.random.Generator, axis: str) -> np.ndarray:
    """A division of some cells (or features) in two, by a short fit on them alone: 0 or 1 for each."""
    if axis == "z":
        return fit_cells(x[:, members], np.zeros(len(members), np.int64), 2, p, rng, max_iter=5, split=False).z
    return fit_features(x[members], 2, p, rng, max_iter=5, split=False).y


def halves(x, s: np.ndarray | None, labels: np.ndarray, groups: list[int], p: Priors, rng: np.random.Generator, axis: str, rounds: int = 5) -> dict[int, np.ndarray]:
    """two_way() of several groups; at once if x is so: then labels are 2 * group + half and only the half can change."""
    if not at_once(x):
        return {g: two_way(x, s, np.flatnonzero(labels == g), p, rng, axis) for g in groups}
    labels = np.asarray(labels, np.int64)
    levels, both = 2 * (int(labels.max()) + 1), 2 * labels + rng.integers(0, 2, len(labels))
    for _ in range(rounds if groups else 0):
        if axis == "z":
            phi = group_sums(x, both, levels) + p.beta
            scores = x.T.pair_weights(np.log(phi / phi.sum(axis=0)), labels)
            scores += np.log(np.bincount(both, minlength=levels) + p.alpha).reshape(-1, 2)[labels]
            both = 2 * labels + scores.argmax(axis=1)
        else:
            both = 2 * labels + drawn(features_at_once(x, both, levels, p, labels), rng)
    return {g: both[labels == g] & 1 for g in groups}


def subclusters(x: np.ndarray | Sparse, z: np.ndarray, p: Priors, rng: np.random.Generator, most: int = 10) -> np.ndarray:
    """Features by parts of cell clusters: each cluster in at most `most` parts by a short fit, a small one cell by cell. Modules
    are divided on these, not on whole clusters."""
    out, end = np.zeros(len(z), np.int64), 0
    for g in np.unique(z):
        members = np.flatnonzero(z == g)
        part = np.arange(len(members)) if len(members) <= most else np.unique(fit_cells(x[:, members], np.zeros(len(members), np.int64), most, p, rng, max_iter=5, split=False).z, return_inverse=True)[1]
        out[members] = part + end
        end += int(part.max()) + 1
    return group_sums(x, out, end)


def improve_by_split(labels: np.ndarray, levels: int, scores: np.ndarray, halve, likelihoods, least: int, most: int = 10) -> tuple[np.ndarray, float]:
    """The best of: no change; or dissolve one group into its members' second choices and give its label to one half of
    another group that is divided in two. Candidates are groups in order of what dissolving them costs. halve(labels,
    groups) divides groups; likelihoods(list of labels) judges."""
    sizes = np.bincount(labels, minlength=levels)
    large = [g for g in range(levels) if sizes[g] > least]
    if not large or levels < 3:
        return labels, likelihoods([labels])[0]
    second = scores.copy()
    second[np.arange(len(labels)), labels] = -np.inf
    second = second.argmax(axis=1)
    dissolved = [np.where(labels == g, second, labels) for g in range(levels)]
    value, *costs = likelihoods([labels, *dissolved])
    order = sorted(range(levels), key=lambda g: -costs[g])[:most]
    half = halve(labels, large)
    best, trials = labels, []
    for g in order:
        for j in large:
            if j == g or len(np.unique(half[j])) < 2:
                continue
            trial = dissolved[g].copy()
            trial[np.flatnonzero(labels == j)[half[j] == 1]] = g
            if len(np.unique(trial)) == levels:
                trials.append(trial)
    for i in range(0, len(trials), 64):
        some = trials[i : i + 64]
        for trial, now in zip(some, likelihoods(some), strict=True):
            if now > value:
                best, value = trial, now
    return best, value


def _loop(step, likelihood, split, labels, max_iter: int, stop_iter: int, split_on: int, split_last: bool) -> tuple[list[np.ndarray], float, list[float]]:
    """Iterate until `stop_iter` rounds bring nothing better than all before; the best state counts."""
    history = [likelihood(labels)]
    best, value, idle, i = [a.copy() for a in labels], history[0], 0, 1
    while i <= max_iter and idle <= stop_iter:
        step(labels)
        idle += 1
        now = likelihood(labels)
        last = idle > stop_iter or i == max_iter
        if split is not None and i > 1 and ((split_on > 0 and i % split_on == 0) or (split_last and last)):
            changed = split(labels)
            if changed:
                now, idle = likelihood(labels), 0
        if now > max(history) or i == 1:
            best, value, idle = [a.copy() for a in labels], now, 1
        history.append(now)
        i += 1
    return best, value, history


def fit_cells(x: np.ndarray, s: np.ndarray, k: int, p: Priors, rng: np.random.Generator, algorithm: str = "EM", stop_iter: int = 10, max_iter: int = 200, split_on: int = 10, split_last: bool = True, init: np.ndarray | None = None, split: bool = True, least: int = 3) -> Fit:
    z = start_labels(x.shape[1], k, rng, init)

    def step(labels: list[np.ndarray]) -> None:
        if algorithm == "EM":
            labels[0][:] = cell_scores(x, s, labels[0], k, p).argmax(axis=1)
        else:
            cell_conditionals(x, s, labels[0], k, p, rng)

    def change(labels: list[np.ndarray]) -> bool:
        new, _ = improve_by_split(labels[0], k, cell_scores(x, s, labels[0], k, p), lambda z_, groups: halves(x, s, z_, groups, p, rng, "z"), lambda trials: lls_cells(x, s, trials, k, p), least)
        moved = bool((new != labels[0]).any())
        labels[0][:] = new
        return moved

    stop = 1 if algorithm == "EM" else stop_iter
    (z,), value, history = _loop(step, lambda a: ll_cells(x, s, a[0], k, p), change if split and k > 2 else None, [z], max_iter, stop, split_on, split_last)
    return Fit(value, z=z, history=history)


def fit_features(x: np.ndarray, modules: int, p: Priors, rng: np.random.Generator, stop_iter: int = 10, max_iter: int = 200, split_on: int = 10, split_last: bool = True, init: np.ndarray | None = None, split: bool = True, least: int = 3) -> Fit:
    y = start_labels(x.shape[0], modules, rng, init)

    def step(labels: list[np.ndarray]) -> None:
        feature_conditionals(x, labels[0], modules, p, rng)

    def change(labels: list[np.ndarray]) -> bool:
        scores = feature_conditionals(x, labels[0].copy(), modules, p)
        new, _ = improve_by_split(labels[0], modules, scores, lambda y_, groups: halves(x, None, y_, groups, p, rng, "y"), lambda trials: lls_features(x, trials, modules, p), least)
        moved = bool((new != labels[0]).any())
        labels[0][:] = new
        return moved

    (y,), value, history = _loop(step, lambda a: ll_features(x, a[0], modules, p), change if split and modules > 2 else None, [y], max_iter, stop_iter, split_on, split_last)
    return Fit(value, y=y, history=history)


def fit_both(x: np.ndarray, s: np.ndarray, k: int, modules: int, p: Priors, rng: np.random.Generator, algorithm: str = "EM", stop_iter: int = 10, max_iter: int = 200, split_on: int = 10, split_last: bool = True, z_init: np.ndarray | None = None, y_init: np.ndarray | None = None) -> Fit:
    """Features move on the matrix collapsed to cell clusters, cells on the one collapsed to modules."""
    z, y = start_labels(x.shape[1], k, rng, z_init), start_labels(x.shape[0], modules, rng, y_init)
    by_feature = x.sum(axis=1)

    def collapsed(dense: np.ndarray):
        if not at_once(x):
            return dense
        from countloom.plans.blocks import Local

        return Local(dense)

    def step(labels: list[np.ndarray]) -> None:
        feature_conditionals(collapsed(group_sums(x, labels[0], k)), labels[1], modules, p, rng)
        small = collapsed(group_sums(x.T, labels[1], modules).T)
        if algorithm == "EM":
            labels[0][:] = cell_scores(small, s, labels[0], k, p).argmax(axis=1)
        else:
            cell_conditionals(small, s, labels[0], k, p, rng)

    def change(labels: list[np.ndarray]) -> bool:
        z_, y_ = labels
        new_y, new_z = y_, z_
        if modules > 2:
            dense = group_sums(x, z_, k)
            narrow = collapsed(dense)
            finer = narrow if at_once(x) else subclusters(x, z_, p, rng)
            judge = lambda trials: [ll_joint(group_sums(dense.T, a, modules).T, by_feature, s, z_, a, k, modules, p) for a in trials]
            new_y, _ = improve_by_split(y_, modules, feature_conditionals(narrow, y_.copy(), modules, p), lambda a, groups: halves(finer, None, a, groups, p, rng, "y"), judge, 3)
        if k > 2:
            sums = group_sums(x.T, new_y, modules).T
            small = collapsed(sums)
            judge = lambda trials: [ll_joint(group_sums(sums, a, k), by_feature, s, a, new_y, k, modules, p) for a in trials]
            new_z, _ = improve_by_split(z_, k, cell_scores(small, s, z_, k, p), lambda a, groups: halves(small, s, a, groups, p, rng, "z"), judge, 3)
        moved = bool((new_y != y_).any() or (new_z != z_).any())
        y_[:], z_[:] = new_y, new_z
        return moved

    (z, y), value, history = _loop(step, lambda a: ll_both(x, s, a[0], a[1], k, modules, p), change, [z, y], max_iter, stop_iter, split_on, split_last)
    return Fit(value, z=z, y=y, history=history)


def split_start(n: int, levels: int, rng: np.random.Generator, divide, halve, likelihoods) -> np.ndarray:
    """Labels by splitting: about sqrt(levels) groups, each divided until there are enough; then groups are dissolved one
    by one, each time the one that leaves the best likelihood."""
    first = min(max(2, math.isqrt(levels)), n)
    labels = np.unique(divide(first), return_inverse=True)[1]
    for _ in range(25):
        groups = [g for g in range(labels.max() + 1) if (labels == g).sum() > 3]
        if labels.max() + 1 >= levels or not groups:
            break
        half, new = halve(labels, groups), labels.copy()
        for g in groups:
            new[np.flatnonzero(labels == g)[half[g] == 1]] = new.max() + 1
            if len(np.unique(new)) >= levels + 10:
                break
        labels = np.unique(new, return_inverse=True)[1]
    while labels.max() + 1 > levels:
        trials = []
        for g in range(labels.max() + 1):
            trial = labels.copy()
            rest = [h for h in range(labels.max() + 1) if h != g]
            trial[labels == g] = rest[int(rng.integers(len(rest)))]
            trials.append(np.unique(trial, return_inverse=True)[1])
        values = likelihoods(trials, int(labels.max()))
        labels = trials[max(range(len(trials)), key=lambda g: (values[g], -g))]
    if labels.max() + 1 < levels:
        labels = random_labels(n, levels, rng)
    return labels


def split_cells(x: np.ndarray, s: np.ndarray, k: int, p: Priors, rng: np.random.Generator) -> np.ndarray:
    def divide(parts: int) -> np.ndarray:
        return fit_cells(x, np.zeros(x.shape[1], np.int64), parts, p, rng, max_iter=5, split=False).z

    return split_start(x.shape[1], k, rng, divide, lambda z, groups: halves(x, s, z, groups, p, rng, "z"), lambda trials, levels: lls_cells(x, s, trials, levels, p))


def split_features(x: np.ndarray, modules: int, p: Priors, rng: np.random.Generator, temp: int = 100) -> np.ndarray:
    """On cells collapsed to at most `temp` groups, if x is not in blocks."""
    if x.shape[1] > temp and not at_once(x):
        x = group_sums(x, random_labels(x.shape[1], temp, rng), temp)

    def divide(parts: int) -> np.ndarray:
        return fit_features(x, parts, p, rng, max_iter=3, split=False).y

    return split_start(x.shape[0], modules, rng, divide, lambda y, groups: halves(x, None, y, groups, p, rng, "y"), lambda trials, levels: lls_features(x, trials, levels, p))


def best_single_split(labels: np.ndarray, halve, likelihoods, least: int = 3) -> tuple[np.ndarray, float]:
    """labels with the one group divided in two that gives the best likelihood."""
    new = int(labels.max()) + 1
    groups = [g for g in range(new) if (labels == g).sum() > least]
    half, trials = halve(labels, groups), []
    for g in groups:
        if len(np.unique(half[g])) == 2:
            trial = labels.copy()
            trial[np.flatnonzero(labels == g)[half[g] == 1]] = new
            trials.append(trial)
    if not trials:
        raise ValueError("no group is large enough to be split")
    values = likelihoods(trials, new + 1)
    best = max(range(len(trials)), key=lambda i: (values[i], -i))
    return trials[best], values[best]


#: Linkages that work on squared distances.
SQUARED = ("ward.D2", "centroid", "median")


def _linked(method: str, x: float, y: float, ab: float, na: int, nb: int, nc: int) -> float:
    """The distance of a group to the union of two others."""
    n = na + nb
    if method == "complete":
        return max(x, y)
    if method == "single":
        return min(x, y)
    if method == "average":
        return (na * x + nb * y) / n
    if method == "mcquitty":
        return (x + y) / 2
    if method in ("ward.D", "ward.D2"):
        return ((na + nc) * x + (nb + nc) * y - nc * ab) / (n + nc)
    if method == "centroid":
        return (na * x + nb * y) / n - na * nb * ab / n**2
    if method == "median":
        return (x + y) / 2 - ab / 4
    raise ValueError(f"unknown linkage {method!r}")


def agglomerated(distance: np.ndarray, method: str = "complete", groups: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Leaf order of agglomerative clustering, and the group of each item when `groups` are left, numbered along the
    order. method: complete, single, average, mcquitty, ward.D, ward.D2, centroid or median."""
    n = len(distance)
    d = distance.astype(float) ** (2 if method in SQUARED else 1)
    np.fill_diagonal(d, np.inf)
    leaves, live, cut = {i: [i] for i in range(n)}, set(range(n)), None
    while len(live) > 1:
        if groups is not None and len(live) == groups:
            cut = {i: set(leaves[i]) for i in live}
        idx = sorted(live)
        sub = d[np.ix_(idx, idx)]
        a, b = divmod(int(sub.argmin()), len(idx))
        a, b = sorted((idx[a], idx[b]))
        for c in live - {a, b}:
            d[a, c] = d[c, a] = _linked(method, d[a, c], d[b, c], d[a, b], len(leaves[a]), len(leaves[b]), len(leaves[c]))
        leaves[a] += leaves.pop(b)
        live.remove(b)
    order = np.array(leaves[live.pop()]) if n else np.zeros(0, int)
    member = np.zeros(n, int)
    if cut:
        names = sorted(cut, key=lambda g: min(np.flatnonzero(np.isin(order, list(cut[g])))))
        for k, g in enumerate(names):
            member[list(cut[g])] = k
    return order, member


def complete_order(distance: np.ndarray, method: str = "complete") -> np.ndarray:
    return agglomerated(distance, method)[0]


def gaps(distance: np.ndarray, groups: int, method: str = "complete") -> list[int]:
    """After how many leaves of the order one of `groups` groups ends and the next begins."""
    order, member = agglomerated(distance, method, groups)
    return [int(i) + 1 for i in np.flatnonzero(np.diff(member[order]))]


def cosine_distance(columns: np.ndarray) -> np.ndarray:
    unit = columns / np.sqrt((columns**2).sum(axis=0))
    return (1 - unit.T @ unit) / 2


def smooth(values: np.ndarray) -> np.ndarray:
    """Penalised second differences with the penalty of least generalised cross-validation."""
    n = len(values)
    if n < 4:
        return values.astype(float)
    diff = np.diff(np.eye(n), 2, axis=0)
    best = None
    for power in np.linspace(-4, 6, 41):
        hat = np.linalg.inv(np.eye(n) + 10**power * diff.T @ diff)
        fit = hat @ values
        gcv = ((values - fit) ** 2).mean() / (1 - np.trace(hat) / n) ** 2
        if best is None or gcv < best[0]:
            best = gcv, fit
    return best[1]
