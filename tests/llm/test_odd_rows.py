"""Nulls in any column, repeated rows, long texts, empty tables and clashing names, for every operator; plain versions of what SQL
does not express."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from countloom.llm import debruijn, decontaminate, jpeg, langid, minhash, mixing, sharding, suffixes, toxicity, urls, words
from countloom.llm.common import Scratch, values

SCHEMA = "doc_id long, text string, lang string, source string, score string, hits int, bands int, copy int, t1 int"


def odd(spark, n=40):
    rng = random.Random(21)
    long = " ".join(f"w{rng.randrange(40_000)}" for _ in range(220_000))
    assert len(long) > words.SLICE
    rows = [(i, " ".join(f"v{rng.randrange(300)}" for _ in range(rng.randrange(1, 90))), rng.choice(["xa", "xb", None]), rng.choice(["a", "b", None])) for i in range(n)]
    rows += [(None, None, None, None), (None, "", "xa", "a"), (None, "some words without an id", None, "b"), (100, None, "xa", None), (101, long, "xb", "a"), (102, "\u2028 \u00a0", "xb", "b")]
    rows += rows[:3] + rows[-4:-3]
    return spark.createDataFrame([(*r, "clash", 1, 2, 3, 4) for r in rows], SCHEMA)


def benchmark(spark):
    return spark.createDataFrame([(1, "v1 v2"), (2, None), (None, "without an id"), (3, "v1 v2")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(30)] + [(None, 1, 1), (3, 0, None), (4, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "minhash": lambda s, d: minhash.near_duplicates(d, Scratch(s)),
    "toxicity": lambda s, d: toxicity.scored(d, labels(s), F.lit(True)),
    "media": lambda s, d: jpeg.media(d),
    "decontaminate": lambda s, d: decontaminate.report(d, benchmark(s)),
    "language": lambda s, d: langid.identify(d, F.lit(True)),
    "debruijn": lambda s, d: debruijn.removed(d, Scratch(s)),
    "mixing": lambda s, d: mixing.taken(d, Scratch(s)),
    "sharding": lambda s, d: sharding.place(d, Scratch(s)),
    "suffixes": lambda s, d: suffixes.removed(d, Scratch(s)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(spark, name):
    docs = odd(spark)
    want = collections.Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert collections.Counter(r.doc_id for r in OPERATORS[name](spark, docs).select("doc_id").collect()) == want
    assert OPERATORS[name](spark, docs.limit(0)).isEmpty()


STAGES = {
    "toxicity": lambda s, d: toxicity.clean(d, labels(s)),
    "near_dedup": lambda s, d: minhash.deduplicated(d, Scratch(s), percent=80),
    "decontamination": lambda s, d: decontaminate.cleaned(d, benchmark(s)),
    "mixing": lambda s, d: mixing.mixed(d, Scratch(s)),
    "sharding": lambda s, d: sharding.sharded(d, Scratch(s)),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(spark, name):
    docs = odd(spark)
    out = STAGES[name](spark, docs)
    assert out.columns == docs.columns + ["shard", "slot"] * (name == "sharding")
    rows = out.collect()
    assert {r.score for r in rows} == {"clash"} and {r.t1 for r in rows} == {4}
    if name == "sharding":
        assert len(rows) == docs.count()
    if name == "mixing":
        assert all(r.text for r in rows) and max(collections.Counter((r.doc_id, r.text) for r in rows).values()) <= 6
    assert STAGES[name](spark, docs.limit(0)).isEmpty()


def test_urls_with_nulls_and_long_ones(spark):
    rows = [(1, "http://a.net/" + "x" * 100_000, "c"), (None, "http://A.example.net/en/x", "c"), (2, None, "c"), (2, None, "c"), (3, "no scheme", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    rules = values(spark, urls.RULES, "rule_host string, rule_path string, rule_verdict string")
    got = sorted((r.page_id or 0, r.host, r.rule, r.verdict) for r in urls.judge(pages, rules).collect())
    assert got == sorted([(1, "a.net", "net/", "block"), (0, "a.example.net", "example.net/en/", "allow"), (2, "", None, "allow"), (2, "", None, "allow"), (3, "", None, "allow")], key=str) or set(got) == {(1, "a.net", "net/", "block"), (0, "a.example.net", "example.net/en/", "allow"), (2, "", None, "allow"), (3, "", None, "allow")}
    assert urls.judge(pages.limit(0), rules).isEmpty()


def test_mix_by_plain_counting(spark):
    """Words taken, counted slot by slot over the streams of words."""
    docs = odd(spark).where("doc_id <> 101 OR doc_id IS NULL")
    sized, sources, slots = mixing.plan(docs, Scratch(spark), block=16)
    stream = collections.defaultdict(dict)
    for r in sized.collect():
        for k in range(r.size):
            assert r.at + k not in stream[r.skey]
            stream[r.skey][r.at + k] = (r.doc_id, r.t)
    took = collections.Counter()
    filled = slots.collect()
    assert len({(r.out_shard, r.slot) for r in filled}) == len(filled)
    for r in filled:
        took.update(stream[r.skey][p] for p in range(r["index"] * 16, r["index"] * 16 + 16) if p in stream[r.skey])
    got = collections.Counter()
    for r in mixing.taken(docs, Scratch(spark), block=16).collect():
        got[r.doc_id, r.t] += r.taken
    assert +got == took
    by = {r.skey: r for r in sources.collect()}
    for key, r in by.items():
        assert r.source_size == len(stream[key]) and abs(sum(n for (d, t), n in took.items() if (d, t) in set(stream[key].values())) - r.target) <= max(32, 0.2 * r.target) + 16


def test_shards_by_plain_counting(spark):
    docs = odd(spark).unionByName(odd(spark).where("doc_id < 20"))
    rows = sharding.place(docs, Scratch(spark), shards=5).collect()
    text = collections.Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == text
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    pairs = collections.defaultdict(set)
    for r in rows:
        if r.doc_id is not None and r.doc_id < 20:
            pairs[r.doc_id].add(r.shard)
    assert sum(len(s) > 1 for s in pairs.values()) <= 4  # copies meet


def test_language_by_plain_backoff():
    """Word by word and place by place, without arrays."""
    rng = random.Random(5)
    tongues = {"a": ["ka", "to", "mi", "\u00f1u"], "b": ["sch", "ei", "\u00df", "ver"]}
    say = lambda t, n: " ".join("".join(rng.choice(tongues[t]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    model = langid.fit({t: [say(t, 60).encode() + b" " for _ in range(4)] for t in tongues}, 1000, 1000)

    def table(scores):
        return {int(k): scores.rows(np.array([i]))[0].astype(float) for i, k in enumerate(scores.keys)}

    known, grams = table(model.words), table(model.grams)

    def gram_hash(g):
        total = sum(ord(c) * int(langid._M[i]) for i, c in enumerate(g)) + len(g)
        return int(words.mix(np.array([total % 2**64], np.uint64))[0])

    def one(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        w = words.Words(raw, np.array([0, len(raw)]), langid.NOT_LETTER, lower=True)
        h = int(w.hashes()[0])
        if h in known:
            return known[h]
        padded, out = f" {word} ", np.zeros(2)
        for i in range(len(padded)):
            for n in langid.NGRAMS:
                g = padded[i : i + n]
                if len(g) == n and " " not in g[1:-1] and not (n == 1 and g == " ") and gram_hash(g) in grams:
                    out = out + grams[gram_hash(g)]
                    break
        return out / 2

    for t in list("abab"):
        text = say(t, 12) + " kaq verz"
        total = sum(one(w) for w in re.findall(r"\S+", text))
        raw = np.frombuffer(text.encode(), np.uint8)
        best, _ = model.score(raw, np.array([0, len(raw)]))
        w = words.Words(raw, np.array([0, len(raw)]), langid.NOT_LETTER, lower=True)
        assert np.allclose(model.sums(w, 0, w.hashes(), np.array([len(w.start)]))[0], total, atol=1e-2) and best[0] == int(np.argmax(total))


def test_toxicity_by_plain_convolution(spark):
    """Scores of whole documents by loops over words and filters."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["zap", "fine", "good", "tree", "Bad", "worse"]) for _ in range(rng.randint(1, 25))) for _ in range(60)] + [""]
    y = np.array([float("Bad" in t) for t in texts])
    model = toxicity.fit([t.encode() + b" " for t in texts], y, ["xa"] * len(texts), np.ones(len(y)))
    for text in texts[:8] + texts[-1:]:
        raw = np.frombuffer(text.encode(), np.uint8)
        rows, first = toxicity.features(raw, np.array([0, len(raw)]))
        e = [sum(model.table[i] for i in r) for r in rows]
        want = model.out_bias
        for i, (width, f) in enumerate(zip(toxicity.WIDTHS, model.filters, strict=True)):
            for k in range(toxicity.FILTERS):
                at = i * toxicity.FILTERS + k
                best = max((sum(e[t + j] @ f[j][:, k] for j in range(width) if t + j < len(e)) for t in range(len(e))), default=0.0)
                want += max(best + model.bias[at], 0) * model.out[at]
        assert model.logits(model.projected(), rows, first)[0] == pytest.approx(float(want), abs=1e-3)
