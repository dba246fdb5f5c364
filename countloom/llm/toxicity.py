"""Toxicity by a convolutional text classifier that is trained in numpy.

A word's embedding is the sum of three hashed vectors: of the word and of its first four and five bytes. Filters of
several widths slide over the whole text; each filter keeps its largest response (max pooling), and a logistic layer
turns these into a logit. Training is by Adam with gradients through the pooled places only; one dimension of the
embeddings begins as smoothed log odds of the labels, the others small.

The logits are calibrated by language, on rows of the training part that the network has not seen: each language gets
the threshold that separates its labels best, and the score is shifted so that it is `at` there. The language is guessed
from the text alone, by word frequencies; the columns lang, source, labels and doc_id are no inputs of a score.

The model is fitted on all labelled texts, read whole. Up to `per_label` of each label and ROOM characters of each, one task
fits it. Beyond, learners of about LEARNER characters each take their share by a hash: counts of words, by label and by language,
are sums over all of them; the network is trained in ROUNDS, in each of which every learner goes through its texts from
the common model and the changes are averaged, those of an embedding over the learners that changed it; thresholds come from
the logits of all texts set aside, rounded to 1/1000. Languages beyond the LANGUAGES of most labelled texts have no
frequencies of their own there, and so no threshold of their own.

Edge cases: null texts are empty; empty texts and texts without words get the score of a text of unknown words; without
labelled rows every score is 0; ties in the sample go by id; several labels of a document count as toxic if any is; repeated
rows get equal scores, and each counts while learning; very long texts are read whole; an empty table gives an empty result; other
columns are not looked at; a column toxic_score of the documents is replaced by scored() and kept by clean().
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countloom.llm.common import Scratch, fitted, give_back
from countloom.llm.langid import held_out
from countloom.llm.words import NOT_ALNUM, U, Words, mix, runs_of, slices

WIDTHS, FILTERS, DIM = (1, 2, 3), 6, 8
BUCKETS = (1 << 16, 1 << 15, 1 << 15)
AT = 0.7
ROOM = 64 << 20
LEARNER, ROUNDS, LANGUAGES = 8 << 20, (2, 2, 1), 256
#: Embeddings of a piece of a sum over learners.
PIECE = 1 << 13


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three rows of the embedding table for each word, and where each text's words begin."""
    w = Words(data, off, NOT_ALNUM, lower=True)
    h = w.hashes()
    size = w.end - w.start
    head, out, base = np.zeros(len(h), U), np.empty((len(h), 3), np.int32), 0
    out[:, 0] = (h >> U(64 - BUCKETS[0].bit_length() + 1)).astype(np.int32)
    base = BUCKETS[0]
    for k in range(5):
        byte = w.data[np.minimum(w.start + k, len(w.data) - 1)] if len(h) else np.zeros(0, np.uint8)
        head = head << U(8) | np.where(size > k, byte, 0).astype(U)
        if k >= 3:
            out[:, k - 2] = base + (mix(head + U(k)) >> U(64 - BUCKETS[k - 2].bit_length() + 1)).astype(np.int32)
            base += BUCKETS[k - 2]
    return out, w.first


@dataclass
class Model:
    table: np.ndarray  # embedding
    filters: list[np.ndarray]  # by width: (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    language: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), np.float32))  # by word bucket: log frequency by language
    shift: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def projected(self) -> np.ndarray:
        """The table times every filter's slices: convolving is then gathering and adding."""
        return np.concatenate([self.table @ f[k] for f in self.filters for k in range(len(f))], axis=1)

    def respond(self, proj: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The responses of all filters at each word, a row a filter; what lies beyond a text's end counts as nothing."""
        e = proj[words[:, 0]]
        e += proj[words[:, 1]]
        e += proj[words[:, 2]]
        e = np.ascontiguousarray(e.T)
        out, at = np.empty((len(WIDTHS) * FILTERS, len(words)), np.float32), 0
        last = first[1:][np.diff(first) > 0]
        begin = np.repeat(first[:-1], np.diff(first))[last - 1] if len(last) else last
        for i, width in enumerate(WIDTHS):
            z = e[at : at + FILTERS].copy()
            at += FILTERS
            for k in range(1, width):
                part = e[at : at + FILTERS]
                at += FILTERS
                z[:, :-k] += part[:, k:]
                for j in range(k):  # taken from the next text: give it back
                    tail = last - 1 - j
                    tail = tail[(tail >= begin) & (tail + k < len(words))]
                    z[:, tail] -= part[:, tail + k]
            out[i * FILTERS : (i + 1) * FILTERS] = z
        return out

    def logits(self, proj: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = np.diff(first)
        pooled = np.zeros((len(n), len(self.bias)), np.float32)
        if len(words):
            pooled[n > 0] = np.maximum.reduceat(self.respond(proj, words, first), first[:-1][n > 0], axis=1).T
        return np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias

    def languages(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = np.diff(first)
        total = np.zeros((len(n), self.language.shape[1]))
        if len(words):
            total[n > 0] = np.add.reduceat(self.language[words[:, 0]], first[:-1][n > 0], axis=0, dtype=np.float64)
        return total.argmax(axis=1)

    def score(self, proj: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        words, first = features(data, off)
        z = self.logits(proj, words, first) - self.shift[self.languages(words, first)]
        return 1 / (1 + np.exp(-np.clip(z + np.log(AT / (1 - AT)), -40, 40)))


def parts(first: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The words of some texts."""
    n = first[texts + 1] - first[texts]
    return np.repeat(first[texts] - np.cumsum(n) + n, n) + np.arange(n.sum())


def seen_by_label(words: np.ndarray, first: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Texts of each label that hold a bucket."""
    rows, seen, i = sum(BUCKETS), np.zeros((2, sum(BUCKETS))), 0
    while i < len(y):  # some texts at a time, as pairs are wide
        k = max(i + 1, int(np.searchsorted(first, first[i] + (1 << 18), "right")) - 1)
        own, doc = words[first[i] : first[k]], np.repeat(np.arange(k - i), np.diff(first[i : k + 1]))
        for j in range(3 if len(own) else 0):
            pair = np.unique(doc * rows + own[:, j])
            for label in (0, 1):
                seen[label] += np.bincount(pair[y[i:k][pair // rows] == label] % rows, minlength=rows)
        i = k
    return seen


def begun(seen: np.ndarray, total: np.ndarray, rng: np.random.Generator) -> Model:
    """The untrained model; total: texts by label."""
    odds = np.log((seen[1] + 2) / (total[1] + 4)) - np.log((seen[0] + 2) / (total[0] + 4))
    odds[seen.sum(axis=0) == 0] = 0
    table = np.zeros((sum(BUCKETS), DIM), np.float32)
    table[:, 0] = odds / 4
    known = seen.sum(axis=0) > 0
    table[known, 1:] = rng.normal(0, 0.02, (known.sum(), DIM - 1))
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, :] = np.abs(f[:, 0, :]) + 0.4 / len(f)
    return Model(table, filters, np.full(len(WIDTHS) * FILTERS, -0.2, np.float32), np.full(len(WIDTHS) * FILTERS, 0.3, np.float32), -2.0)


def train(words: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 5, batch: int = 48, rate: float = 0.01, seed: int = 2, start: Model | None = None, total: np.ndarray | None = None) -> Model:
    """A model of some texts, or `start` trained further on them, total being the texts by label that all learners have."""
    rng = np.random.default_rng(seed)
    n = np.diff(first)
    total = np.array([(y == 0).sum(), (y == 1).sum()]) if total is None else total
    if start is None:
        m = begun(seen_by_label(words, first, y), total, rng)
    else:
        m = replace(start, table=start.table.copy(), filters=[f.copy() for f in start.filters], bias=start.bias.copy(), out=start.out.copy())
    params = [m.table, *m.filters, m.bias, m.out]
    first_m, second_m = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    bias_m = bias_v = 0.0
    weight = np.where(y == 1, total.sum() / (2 * max(total[1], 1)), total.sum() / (2 * max(total[0], 1)))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(n))
        for i in range(0, len(order), batch):
            step += 1
            texts = order[i : i + batch]
            own = words[parts(first, texts)]
            bounds = np.concatenate([[0], np.cumsum(n[texts])])
            some = n[texts] > 0
            z = np.zeros((len(texts), len(m.bias)), np.float32)
            at = np.zeros((len(texts), len(m.bias)), np.int64)
            if len(own):
                # projections of this batch's words only
                used, back = np.unique(own, return_inverse=True)
                small = Model(m.table[used], m.filters, m.bias, m.out, m.out_bias)
                r = small.respond(small.projected(), back.reshape(own.shape), bounds)
                z[some] = np.maximum.reduceat(r, bounds[:-1][some], axis=1).T
                for d in np.flatnonzero(some):
                    at[d] = bounds[d] + r[:, bounds[d] : bounds[d + 1]].argmax(axis=1)
            pooled = np.maximum(z + m.bias, 0)
            logit = pooled @ m.out + m.out_bias
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            g = ((p - y[texts]) * weight[texts] / len(texts)).astype(np.float32)
            g_pool = g[:, None] * m.out * (pooled > 0)
            grads = [np.zeros_like(x) for x in m.filters]
            touched: list[np.ndarray] = []
            values: list[np.ndarray] = []
            for fi, width in enumerate(WIDTHS):
                cols = slice(fi * FILTERS, (fi + 1) * FILTERS)
                for k in range(width):
                    place = at[:, cols] + k
                    inside = (place < bounds[1:][:, None]) & some[:, None]
                    gp = np.where(inside, g_pool[:, cols], 0)
                    w3 = own[np.minimum(place, max(len(own) - 1, 0))] if len(own) else np.zeros((*place.shape, 3), np.int64)
                    vec = m.table[w3].sum(axis=2)  # (texts, FILTERS, DIM)
                    grads[fi][k] = np.einsum("tfd,tf->df", vec, gp)
                    back_ = gp[:, :, None] * m.filters[fi][k].T[None]
                    live = gp != 0
                    for j in range(3):
                        touched.append(w3[live][:, j])
                        values.append(back_[live])
            ids = np.concatenate(touched)
            keys, inv = np.unique(ids, return_inverse=True)
            row_grad = np.zeros((len(keys), DIM), np.float32)
            np.add.at(row_grad, inv, np.concatenate(values))
            c1, c2 = 1 - 0.9**step, 1 - 0.999**step
            a, b = first_m[0], second_m[0]  # the table: touched rows only
            a[keys] = 0.9 * a[keys] + 0.1 * row_grad
            b[keys] = 0.999 * b[keys] + 0.001 * row_grad**2
            m.table[keys] -= rate * (a[keys] / c1) / (np.sqrt(b[keys] / c2) + 1e-8)
            for p_, g_, a, b in zip(params[1:], [*grads, g_pool.sum(axis=0), pooled.T @ g], first_m[1:], second_m[1:], strict=True):
                a[...] = 0.9 * a + 0.1 * g_
                b[...] = 0.999 * b + 0.001 * g_**2
                p_ -= rate * (a / c1) / (np.sqrt(b / c2) + 1e-8)
            gb = float(g.sum())
            bias_m, bias_v = 0.9 * bias_m + 0.1 * gb, 0.999 * bias_v + 0.001 * gb * gb
            m.out_bias -= rate * (bias_m / c1) / (np.sqrt(bias_v / c2) + 1e-8)
    return m


def threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float | None:
    """The logit of best F1, halfway between the logits it lies between; None without both labels."""
    if not (y == 1).any() or not (y == 0).any():
        return None
    order = np.argsort(-z)
    z, hit, miss = z[order], np.cumsum((y * weight)[order]), np.cumsum(((1 - y) * weight)[order])
    f1 = 2 * hit / (hit + miss + hit[-1])
    ends = np.append(z[:-1] != z[1:], True)
    i = int(np.argmax(np.where(ends, f1, -1)))
    return float((z[i] + z[i + 1]) / 2 if i + 1 < len(z) else z[i] - 1)


def fit(texts: list[bytes], y: np.ndarray, lang: list[str | None], weight: np.ndarray) -> Model:
    pieces = [features(*run) for run in runs_of(texts)]
    words, n = np.concatenate([w for w, _ in pieces]), np.concatenate([np.diff(f) for _, f in pieces])
    first = np.concatenate([[0], np.cumsum(n)])
    check = np.arange(len(y)) % 4 == 3  # the sample comes in order of a hash
    if not (y[~check] == 1).any() or not (y[~check] == 0).any():
        check[:] = False
    some = np.flatnonzero(~check)
    own = np.concatenate([[0], np.cumsum(n[some])])
    m = train(words[parts(first, some)], own, y[some])
    names = sorted({x for x in lang if x is not None}) or ["none"]
    number = np.array([names.index(x) if x is not None else -1 for x in lang])
    count = np.full((BUCKETS[0], len(names)), 0.05)
    of = np.repeat(number, n)
    for j in range(len(names)):
        count[:, j] += np.bincount(words[of == j, 0], minlength=BUCKETS[0])
    logp = np.log(count / count.sum(axis=0))
    m.language = (logp - logp.mean(axis=1, keepdims=True)).astype(np.float32)
    proj = m.projected()
    z = np.concatenate([m.logits(proj, w, f) for w, f in pieces])
    guess = np.concatenate([m.languages(w, f) for w, f in pieces])
    test = check if check.any() else np.ones(len(y), bool)
    whole = threshold(z[test], y[test], weight[test])
    whole = threshold(z, y, weight) if whole is None else whole
    m.shift = np.full(len(names), 0.0 if whole is None else whole)
    for j in range(len(names)):
        here = test & (guess == j)
        if y[here].sum() >= 8:
            m.shift[j] = threshold(z[here], y[here], weight[here]) if (y[here] == 0).any() else m.shift[j]
    return m


def marked(labels: DataFrame, learn: Column) -> DataFrame:
    """(doc_id, toxic) of all that may be learnt from."""
    return labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(learn)


def labelled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(toxic, lang, text, turn); ids: (doc_id, toxic), joined by broadcast if it is marked so."""
    ids = ids.select(F.col("doc_id").alias("d"), "toxic", F.xxhash64("doc_id").alias("turn"))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", lang.alias("lang"), "text")
    return texts.join(ids, F.col("doc_id") == F.col("d")).select("toxic", "lang", "text", "turn")


def sample(docs: DataFrame, labels: DataFrame, learn: Column, per_label: int) -> tuple[DataFrame, dict[int, int]]:
    """At most per_label labelled texts of each label (toxic, lang, text, turn), and how many there are in all."""
    every = marked(labels, learn)
    count = dict(every.where("toxic IN (0, 1)").groupBy("toxic").count().collect())
    ids = [every.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for t in (0, 1)]
    return labelled(docs, F.broadcast(ids[0].unionByName(ids[1]))), count


def build(table: pa.Table, count: dict[int, int], most: int) -> Model:
    """The model of a sample; count: labelled rows in all, by label."""
    rows = table.to_pydict()
    every, order, size = sorted(range(len(rows["turn"])), key=lambda i: (rows["turn"][i], rows["text"][i])), [], {}
    for i in every[:most]:
        label = rows["toxic"][i]
        if size.get(label, 0) < ROOM:
            order.append(i)
            size[label] = size.get(label, 0) + len(rows["text"][i])
    y = np.array([rows["toxic"][i] for i in order], np.float64)
    took = {t: max(1, int((y == t).sum())) for t in (0, 1)}
    weight = np.array([count.get(int(t), 1) / took[int(t)] for t in y])
    return fit([rows["text"][i].encode() + b" " for i in order], y, [rows["lang"][i] for i in order], weight)


def pieces(learner: int, at: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a matrix that a learner has something in, ascending, as pieces that summed() takes."""
    cut = np.searchsorted(at, np.arange(0, sum(BUCKETS) + PIECE, PIECE))
    for piece, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        if a < b:
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([learner], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (at[a:b].astype(np.int32) - np.int32(piece * PIECE), np.ascontiguousarray(values[a:b], np.float32)))], ["piece", "learner", "at", "values"])


PIECES = "piece int, learner long, at binary, values binary"


def summed(each: DataFrame, columns: int, mean: bool) -> tuple[np.ndarray, list[bytes]]:
    """A matrix by embeddings: sums over learners, or means over those that have a row; and what came as piece -1 whole."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for piece, _, at, values in zip(*batch.columns, strict=True):
                p = piece.as_py()
                if p < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([values.as_py()], pa.binary())], ["piece", "values"])
                    continue
                total, have = out.setdefault(p, (np.zeros((PIECE, columns)), np.zeros(PIECE)))
                i = np.frombuffer(at.as_buffer(), np.int32)
                total[i] += np.frombuffer(values.as_buffer(), np.float32).reshape(-1, columns)
                have[i] += 1
        for p, (total, have) in out.items():
            if mean:
                total /= np.maximum(have, 1)[:, None]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([total.astype(np.float32 if mean else np.float64).tobytes()], pa.binary())], ["piece", "values"])

    dealt = each.repartition(-(-sum(BUCKETS) // PIECE), "piece").sortWithinPartitions("piece", "learner")
    out, rest = np.zeros((sum(BUCKETS), columns), np.float32 if mean else np.float64), []
    for piece, values in zip(*dealt.mapInArrow(added, "piece int, values binary").toArrow().columns, strict=True):
        if (p := piece.as_py()) < 0:
            rest.append(values.as_py())
        else:
            out[p * PIECE : (p + 1) * PIECE] = np.frombuffer(values.as_buffer(), out.dtype).reshape(-1, columns)
    return out, rest


class Learners:
    """All labelled texts as rows of words' buckets, a row a learner."""

    def __init__(self, rows: DataFrame, chars: int, aside: bool, scratch: Scratch):
        """aside: whether a quarter of the texts stays out of training and finds the thresholds; without it all do both."""

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            size = 0

            def row() -> pa.RecordBatch:
                runs = [features(*run) for run in runs_of([t.encode() + b" " for _, _, t, _ in held])]
                words, n = np.concatenate([w for w, _ in runs]).astype(np.int32), np.concatenate([np.diff(f) for _, f in runs])
                turn = np.array([x[3] for x in held], np.int64)
                own = [words, n.astype(np.int64), np.array([x[0] for x in held], np.int8), ((turn >> 8) % 4 == 3) if aside else np.zeros(len(held), bool)]
                return pa.RecordBatch.from_arrays([pa.array([int(turn[0])], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in own), pa.array([[x[1] for x in held]], pa.list_(pa.string()))], ["learner", "words", "n", "y", "aside", "lang"])

            for batch in batches:
                for x in zip(*(batch.column(c).to_pylist() for c in ("toxic", "lang", "text", "turn")), strict=True):
                    held.append(x)
                    size += len(x[2])
                    if size >= 2 * LEARNER:  # a partition of much more than its share
                        yield row()
                        held, size = [], 0
            if held:
                yield row()
            held.clear()
            give_back()

        dealt = rows.repartition(max(2, -(-chars // LEARNER)), "turn").sortWithinPartitions("turn", "text")
        self.rows = scratch.save(dealt.mapInArrow(packed, "learner long, words binary, n binary, y binary, aside binary, lang array<string>"), "learners")
        scratch.settle()

    def each(self, work, state: object, schema: str) -> DataFrame:
        """work(learner, words, first, y, aside, lang, state) of each learner."""
        sent = self.rows.sparkSession.sparkContext.broadcast(state)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for learner, words, n, y, aside, lang in zip(*batch.columns, strict=True):
                    n, y, aside = np.frombuffer(n.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int8).astype(np.float64), np.frombuffer(aside.as_buffer(), bool)
                    words = np.frombuffer(words.as_buffer(), np.int32).reshape(-1, 3)
                    yield from work(learner.as_py(), words, np.concatenate([[0], np.cumsum(n)]), y, aside, lang.as_py(), sent.value)
                    del words, n, y, aside, lang
            give_back()

        return self.rows.mapInArrow(rows, schema)


def chosen(words: np.ndarray, first: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some texts alone: their words, and where each one's begin."""
    return words[parts(first, texts)], np.concatenate([[0], np.cumsum(np.diff(first)[texts])])


def counted(learner, words, first, y, aside, lang, names) -> Iterator[pa.RecordBatch]:
    """By bucket: trained texts of each label that hold it, and its words in each language."""
    some = np.flatnonzero(~aside)
    seen = seen_by_label(*chosen(words, first, some), y[some])
    number = {x: i for i, x in enumerate(names)}
    of = np.repeat(np.array([number.get(x, -1) for x in lang], np.int64), np.diff(first))
    by = [np.bincount(words[of == j, 0], minlength=sum(BUCKETS)) for j in range(len(names))]
    values = np.stack([*seen, *by], axis=1)
    at = np.flatnonzero(values.any(axis=1))
    yield from pieces(learner, at, values[at])


def trained(learner, words, first, y, aside, lang, state) -> Iterator[pa.RecordBatch]:
    """What a round changes in a learner's copy of the model."""
    start, epochs, total, seed = state
    some = np.flatnonzero(~aside)
    if not len(some):
        return
    m = train(*chosen(words, first, some), y[some], epochs, seed=seed, start=start, total=total)
    at = np.flatnonzero((m.table != start.table).any(axis=1))
    yield from pieces(learner, at, m.table[at] - start.table[at])
    rest = pickle.dumps((learner, len(some), [*m.filters, m.bias, m.out, np.array(m.out_bias)]))
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([learner], pa.int64()), pa.array([b""], pa.binary()), pa.array([rest], pa.binary())], ["piece", "learner", "at", "values"])


def judged(learner, words, first, y, aside, lang, m) -> Iterator[pa.RecordBatch]:
    """(guess, z, toxic) of the texts that find the thresholds, z in thousandths."""
    some = np.flatnonzero(aside) if m[1] else np.arange(len(y))
    w, f = chosen(words, first, some)
    z = np.rint(m[0].logits(m[0].projected(), w, f) * 1000).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(m[0].languages(w, f).astype(np.int32)), pa.array(z), pa.array(y[some].astype(np.int32))], ["guess", "z", "toxic"])


def fit_all(rows: DataFrame, every: list, scratch: Scratch) -> Model:
    """The model of all rows (toxic, lang, text, turn), by learners; every: how many and how long, by language, label and part."""
    have = lambda t, a: sum(r.n for r in every if r.toxic == t and r.aside == a)
    aside = all(have(t, a) for t in (0, 1) for a in (True, False))
    total = np.array([have(t, False) + (0 if aside else have(t, True)) for t in (0, 1)])
    sizes: dict[str, int] = {}
    for r in every:
        if r.lang is not None:
            sizes[r.lang] = sizes.get(r.lang, 0) + r.n
    names = sorted(sorted(sizes, key=lambda x: (-sizes[x], x))[:LANGUAGES])
    learners = Learners(rows, sum(r.chars for r in every), aside, scratch)
    counts, _ = summed(learners.each(counted, names, PIECES), 2 + len(names), mean=False)
    m = begun(counts[:, :2].T, total, np.random.default_rng(2))
    by = counts[: BUCKETS[0], 2:] + 0.05 if names else np.ones((BUCKETS[0], 1))
    logp = np.log(by / by.sum(axis=0))
    m.language = (logp - logp.mean(axis=1, keepdims=True)).astype(np.float32)
    m.shift = np.zeros(m.language.shape[1])
    for i, epochs in enumerate(ROUNDS):
        changes, rest = summed(learners.each(trained, (replace(m, language=m.language[:0]), epochs, total, 2 + i), PIECES), DIM, mean=True)
        m.table += changes
        own = sorted((pickle.loads(r) for r in rest), key=lambda r: r[0])
        size = np.array([r[1] for r in own], np.float64)
        *filters, bias, out, out_bias = (np.tensordot(size / size.sum(), np.stack(x).astype(np.float64), 1) for x in zip(*(r[2] for r in own), strict=True))
        m.filters, m.bias, m.out, m.out_bias = [f.astype(np.float32) for f in filters], bias.astype(np.float32), out.astype(np.float32), float(out_bias)
    got = learners.each(judged, (m, aside), "guess int, z int, toxic int").groupBy("guess", "z", "toxic").agg(F.count("*").alias("c")).toArrow()
    scratch.drop("learners")
    guess, z, y, c = (got[k].to_numpy().astype(np.float64) for k in ("guess", "z", "toxic", "c"))
    z /= 1000
    whole = threshold(z, y, c)
    m.shift[:] = 0.0 if whole is None else whole
    for j in range(len(m.shift)):
        here = guess == j
        if (c * y)[here].sum() >= 8 and (y[here] == 0).any():
            m.shift[j] = threshold(z[here], y[here], c[here])
    return m


def learned(docs: DataFrame, labels: DataFrame, learn: Column, per_label: int, at_once: int = 1 << 20) -> Model | None:
    """The model of all labelled texts; up to `at_once` labelled ids are joined by broadcast."""
    ids = marked(labels, learn).where("toxic IN (0, 1)")
    ids = F.broadcast(ids) if ids.count() <= at_once else ids
    rows = labelled(docs, ids)
    part = F.pmod(F.shiftright("turn", 8), F.lit(4)) == 3
    sizes = rows.groupBy("lang", "toxic", part.alias("aside")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    if all(sum(r.n for r in sizes if r.toxic == t) <= per_label and sum(r.chars for r in sizes if r.toxic == t) <= ROOM for t in (0, 1)):
        some, count = sample(docs, labels, learn, per_label)
        return fitted(some, lambda table: build(table, count, 2 * per_label))
    return fit_all(rows, sizes, Scratch(docs.sparkSession))


def scored(docs: DataFrame, labels: DataFrame, learn: Column, per_label: int = 3000) -> DataFrame:
    """docs with toxic_score (instead of a column of that name); learn: a condition on labels' doc_id. Up to per_label texts a
    label one task fits the model."""
    docs = docs.drop("toxic_score")
    sent = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, learn, per_label))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        proj = model.projected() if model else None
        for part, data, off in slices(batches):
            score = model.score(proj, data, off).astype(np.float64) if model else np.zeros(len(off) - 1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], [*part.schema.names, "toxic_score"])

    return docs.mapInArrow(rows, T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.DoubleType())]))


def clean(docs: DataFrame, labels: DataFrame, at: float = AT, **how) -> DataFrame:
    """docs without those whose score is `at` or more."""
    own = "__toxic_score" if "toxic_score" in docs.columns else None
    out = scored(docs.withColumnRenamed("toxic_score", own) if own else docs, labels, F.lit(True), **how).where(F.col("toxic_score") < at).drop("toxic_score")
    return out.withColumnRenamed(own, "toxic_score") if own else out


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    learn = ~held_out(F.col("doc_id"), 3, 1) & F.col("doc_id").isNotNull()
    out = scored(docs.select("doc_id", "lang", "text"), labels, learn)
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= AT).cast("int").alias("predicted"))
