"""Language identification by word-first backoff.

A word that the model knows scores its log frequency in each language. A word it has not seen falls back to character
n-grams, from NGRAMS[0] characters down to one: at each place the longest known n-gram that begins there counts. Words
are runs of ASCII letters and non-ASCII characters, with a space on either side for the n-grams.

The model is fitted on a bounded sample of whole texts of every language: those of least hash, at most `per_language` of each,
from SHARED languages on fewer, so that their number stays, but never below FEWEST; and of each language at most its
share of ROOM bytes and the text that passes it. Either bound is dealt out over BUCKETS buckets of hashes, so that a language with
many documents is many groups. It holds at most `words` words and `grams` n-grams, dealt out evenly by language, but LEAST of
each for a language if that is more. Scores are kept for the languages that have a word only. Prediction reads every text whole.

Edge cases: null texts and texts without a letter are `und` with score 0; if there is nothing to learn from, every text
is; ties go to the language that comes first by code point; repeated rows get equal results, and each counts while learning; very long
texts are read whole; an empty table gives an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from countloom.llm.common import fitted
from countloom.llm.words import U, Words, mix, runs_of, slices, table

NOT_LETTER = table([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
NGRAMS = (5, 4, 3, 2, 1)
SHARED, FEWEST, LEAST = 64, 50, 5000
ROOM, BUCKETS = 128 << 20, 32
SCORES = 8_000_000  # scores that are spread out at once
_M = np.random.default_rng(11).integers(1, 1 << 62, 8, dtype=np.int64).astype(U) * U(2) + U(1)


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves `rest`; rows without an id are held out of nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def grams_of(words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n of NGRAMS: hashes of the n-grams at all places of " word word ", and whether one fits there: it must
    not cross a space but may begin or end with one."""
    text = np.frombuffer((b" " + b" ".join(words) + b" ").decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(U)
    space = np.concatenate([[0], np.cumsum(text == 32)])
    out = []
    for n in NGRAMS:
        h, fits = np.zeros(len(text), U), np.zeros(len(text), bool)
        k = len(text) - n + 1
        if k > 0:
            h[:k] = mix(sum((text[i : i + k] * _M[i] for i in range(1, n)), text[:k] * _M[0]) + U(n))
            inner = space[n - 1 : n - 1 + k] - space[1 : 1 + k] if n > 1 else np.zeros(k, np.int64)
            fits[:k] = inner == 0
            if n == 1:
                fits[:k] = text != 32
        out.append((h, fits))
    return out


def places(words: list[bytes]) -> np.ndarray:
    """The word that each place of " word word " belongs to; a space belongs to the word behind it."""
    text = np.frombuffer((b" " + b" ".join(words) + b" ").decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return np.minimum(np.cumsum(text == 32) - 1, len(words) - 1)


@dataclass
class Scores:
    """Log frequencies by language of words or n-grams. A key has entries for the languages that it occurs in; in all
    others it scores `base`."""

    keys: np.ndarray  # sorted hashes
    first: np.ndarray
    of: np.ndarray
    gain: np.ndarray
    base: np.ndarray

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where hashes are, and whether they are there."""
        at = np.minimum(np.searchsorted(self.keys, h), max(len(self.keys) - 1, 0))
        return at, self.keys[at] == h if len(self.keys) else np.zeros(len(h), bool)

    def rows(self, at: np.ndarray) -> np.ndarray:
        """A row of scores by language for each place."""
        out = np.tile(self.base, (len(at), 1))
        size = self.first[at + 1] - self.first[at]
        entry = np.repeat(self.first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        out[np.repeat(np.arange(len(at)), size), self.of[entry]] += self.gain[entry]
        return out


@dataclass
class Model:
    languages: list[str]
    words: Scores
    grams: Scores

    def unseen(self, words: list[bytes]) -> np.ndarray:
        """Scores of words by backoff."""
        of = places(words)
        best = np.full((len(of), len(self.languages)), 0, np.float32)
        open_ = np.ones(len(of), bool)
        for h, fits in grams_of(words):
            at, there = self.grams.find(h)
            now = open_ & fits & there
            best[now] = self.grams.rows(at[now])
            open_ &= ~now
        out = np.zeros((len(words), len(self.languages)), np.float32)
        for j in range(out.shape[1]):
            out[:, j] = np.bincount(of, best[:, j], len(words))
        return out / 2  # n-grams overlap

    def sums(self, w: Words, begin: int, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Scores by language of texts of `n` words each, which are those of `w` from `begin` on and hash to `h`."""
        value = np.zeros((len(h), len(self.languages)), np.float32)
        at, known = self.words.find(h)
        value[known] = self.words.rows(at[known])
        new = np.flatnonzero(~known)
        if len(new):
            _, one, back = np.unique(h[new], return_index=True, return_inverse=True)
            one = new[one] + begin
            own = [bytes(w.data[a:b]) for a, b in zip(w.start[one].tolist(), w.end[one].tolist(), strict=True)]
            found, step = np.zeros((len(own), len(self.languages)), np.float32), max(SCORES // (16 * len(self.languages)), 1)
            for i in range(0, len(own), step):
                found[i : i + step] = self.unseen(own[i : i + step])
            value[new] = found[back]
        out, some = np.zeros((len(n), len(self.languages)), np.float64), n > 0
        if some.any():
            out[some] = np.add.reduceat(value, (np.cumsum(n) - n)[some], axis=0, dtype=np.float64)
        return out

    def score(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and share of belief of each text."""
        w = Words(data, off, NOT_LETTER, lower=True)
        h = w.hashes()
        n = np.diff(w.first)
        best, belief = np.zeros(len(n), np.int64), np.ones(len(n))
        turn = (w.first[:-1] + np.arange(len(n))) // max(SCORES // len(self.languages), 1)  # a group of texts at a time
        ends = np.append(np.flatnonzero(np.diff(turn)) + 1, len(n)).tolist() if len(n) else []
        a = 0
        for b in ends:
            i, j = int(w.first[a]), int(w.first[b])
            total = self.sums(w, i, h[i:j], n[a:b])
            best[a:b] = total.argmax(axis=1)
            total = (total - total.max(axis=1, keepdims=True)) / np.maximum(n[a:b] / 16, 1)[:, None]
            belief[a:b] = 1 / np.exp(total).sum(axis=1)
            a = b
        return best, belief


def scores(hashes: list[np.ndarray], weights: list[np.ndarray], most: int) -> Scores:
    """Hashes that occur twice or more, by language; if they are more than `most`, each language's most frequent ones."""
    every, n = np.concatenate(hashes), np.concatenate(weights).astype(np.float64)
    of = np.repeat(np.arange(len(hashes), dtype=np.int32), [len(x) for x in hashes])
    keys, back = np.unique(every, return_inverse=True)
    keep = np.bincount(back, n, len(keys)) >= 2
    if keep.sum() > most:
        chosen, share, end = np.zeros(len(keys), bool), max(most // len(hashes), LEAST), 0
        for own in hashes:
            begin, end = end, end + len(own)
            mine = np.flatnonzero(keep[back[begin:end]]) + begin
            chosen[back[mine[np.argsort(-n[mine], kind="stable")[:share]]]] = True
        keep = chosen
    entry = np.flatnonzero(keep[back])
    entry = entry[np.argsort(back[entry], kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(back[entry], minlength=len(keys))[keep])]).astype(np.int64)
    smooth = 0.1
    base = np.log(smooth / (np.bincount(of[entry], n[entry], len(hashes)) + smooth * (keep.sum() + 1)))
    return Scores(keys[keep], first, of[entry], np.log((n[entry] + smooth) / smooth).astype(np.float32), base.astype(np.float32))


def fit(texts: dict[str, list[bytes]], words: int, grams: int) -> Model:
    languages = sorted(texts, key=lambda x: x.encode())
    word_h, word_n, gram_h, gram_n = [], [], [], []
    for name in languages:
        own: dict[int, bytes] = {}
        found = [np.zeros(0, U)]
        for data, off in runs_of(texts[name]):
            w = Words(data, off, NOT_LETTER, lower=True)
            found.append(w.hashes())
            h, one = np.unique(found[-1], return_index=True)
            low = w.data.tobytes()
            own |= {k: low[a:b] for k, a, b in zip(h.tolist(), w.start[one].tolist(), w.end[one].tolist(), strict=True)}
        h, n = np.unique(np.concatenate(found), return_counts=True)
        word_h.append(h)
        word_n.append(n)
        own = list(own.values())
        found = [np.zeros(0, U)]
        for i in range(0, len(own), 50_000):  # each distinct word once: unseen words are rare ones
            found += [h_[fits] for h_, fits in grams_of(own[i : i + 50_000])]
        g, n = np.unique(np.concatenate(found), return_counts=True)
        gram_h.append(g)
        gram_n.append(n)
    return Model(languages, scores(word_h, word_n, words), scores(gram_h, gram_n, grams))


def sample(docs: DataFrame, learn: Column, per_language: int) -> DataFrame:
    """At most per_language texts of each language, fewer if there are many languages (lang, text)."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    names = rows.agg(F.count_distinct("lang").alias("names"))  # one row
    turn = F.xxhash64("doc_id")
    own = Window.partitionBy("lang", "bucket").orderBy("hash", "doc_id", "size")
    ids = rows.select("doc_id", "lang", F.octet_length("text").alias("size"), turn.alias("hash"), F.pmod(turn, F.lit(BUCKETS)).alias("bucket"))
    before = F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ids = ids.withColumn("turn", F.row_number().over(own)).withColumn("before", before).where(F.col("turn") <= -(-per_language // BUCKETS))
    most = F.least(F.lit(per_language), F.greatest(F.floor(F.lit(SHARED * per_language) / F.col("names")), F.lit(FEWEST)))
    ids = ids.crossJoin(F.broadcast(names)).where((F.col("turn") <= F.ceil(most / BUCKETS)) & (F.col("before") < F.lit(ROOM // BUCKETS) / F.col("names")))
    ids = ids.select(F.col("doc_id").alias("d"), F.col("lang").alias("l")).distinct()
    return rows.join(F.broadcast(ids), (F.col("doc_id") == F.col("d")) & (F.col("lang") == F.col("l")), "left_semi").select("lang", "text")


def build(table: pa.Table, words: int, grams: int) -> Model:
    out: dict[str, list[bytes]] = {}
    for name, text in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True):
        out.setdefault(name, []).append(text.encode() + b" ")
    return fit(out, words, grams)


def identify(docs: DataFrame, learn: Column, per_language: int = 2000, words: int = 200_000, grams: int = 300_000) -> DataFrame:
    """(doc_id, lang_pred, score) of each document; the model learns from the rows where `learn` holds."""
    model = fitted(sample(docs, learn, per_language), lambda table: build(table, words, grams))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for part, data, off in slices(batches):
            letters = part.column(2).to_numpy(zero_copy_only=False)
            if model is None:
                names, score = ["und"] * len(letters), np.zeros(len(letters))
            else:
                best, score = model.score(data, off)
                names = [model.languages[b] if has else "und" for b, has in zip(best.tolist(), letters.tolist(), strict=True)]
                score = np.where(letters, score, 0.0)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    letters = F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False)).alias("letters")
    return docs.select("doc_id", "text", letters).mapInArrow(rows, "doc_id long, lang_pred string, score double")


def op5_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = held_out(F.col("doc_id"), 4, 2)
    return identify(docs, ~held & F.col("doc_id").isNotNull()).select("doc_id", held.alias("held_out"), "lang_pred", "score")
