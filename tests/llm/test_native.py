"""URL filters, sharding and mixing against plain Python."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from countloom.llm import mixing, sharding, urls
from countloom.llm.common import Scratch, fitted, running, values

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", (sources or ["a"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)], DOCS)


def judged(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group().translate({c: c + 32 for c in range(65, 91)})
        path = re.match(r"[^/?#]*([^?#]*)", rest).group(1)
    fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)] if host else []
    best = max(fits, default=(0, None, default))
    return host, path, best[1], best[2]


URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "http://a.net/x", "http://planet/", "HTTP://A.EXAMPLE.NET/en/1?q#f", "http://example.net/en", "http://example.com/de/", "http://x.example.com/fr/",
    "http://x.org/fr/1", "http://org/fr/", "ftp://b.c.example.org/fr/?a", "x://example.com#/de/", "http://.net/", "http://a..net/", "http://é.net/", "http://example.net:80/", "http://a.b.c.d.e.f.example.net/en/x",
]


@pytest.mark.parametrize("sizes", [{}, {"prefix": 2, "per_salt": 1}, {"prefix": 30, "per_salt": 2}])
def test_urls(spark, sizes):
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(URLS)] + [(3, "http://a.net/x", None, None)] * 2, "page_id long, url string, host string, verdict string")
    more = [*urls.RULES, ("b.c.example.org", "/", "block"), ("c.example.org", "/fr/", "block"), ("example.net", "/", "allow")]
    for rules in (urls.RULES, more):
        table = spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")
        got = collections.Counter(map(tuple, urls.judge(pages, table, **sizes).collect()))
        want = collections.Counter((p.page_id, *judged(p.url, rules)) for p in pages.collect())
        assert got == want


def test_urls_of_an_empty_table_or_without_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    rules = spark.createDataFrame(urls.RULES, "rule_host string, rule_path string, rule_verdict string")
    assert urls.judge(pages.limit(0), rules).isEmpty()
    assert urls.judge(pages, rules.limit(0)).first().verdict == "allow"


def test_literal_tables(spark):
    rows = [("it's", 1), (None, 2), ("a\\b", 3), ("é", None)]
    out = values(spark, rows, "name string, n long")
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, rows)) and dict(out.dtypes) == {"name": "string", "n": "bigint"}


def test_models_are_made_in_one_task(spark):
    assert fitted(spark.range(1000).repartition(7), lambda t: sum(t.column(0).to_pylist())) == 499500
    assert fitted(spark.range(0), len) is None


def test_running_sums(spark):
    rows = spark.createDataFrame([("a" if i % 3 else "b", i, i % 5) for i in range(200)], "p string, i long, v long")
    out = running(rows, ["p"], ["i"], F.col("v"), "before", 700_000).collect()
    for p in "ab":
        own = sorted((r.before, r.v) for r in out if r.p == p)
        at = 0
        by_place = collections.defaultdict(list)
        for before, v in own:
            by_place[before].append(v)
        for before in sorted(by_place):
            assert before == at
            at += sum(by_place[before])


@pytest.mark.parametrize("texts", [[], ["x"], [None, "", None, ""], ["same"] * 100, ["a", "b"] * 60 + [f"t{i}" for i in range(31)], [f"t{i}" for i in range(48)]])
def test_shards(spark, texts):
    got = sharding.place(docs_of(spark, texts), Scratch(spark)).collect()
    sizes = collections.Counter(r.shard for r in got)
    counts = [sizes[s] for s in range(24)]
    assert len(got) == len(texts) and max(counts) - min(counts) <= 1
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 8 for r in got)


def test_groups_that_fit_stay_together(spark):
    texts = [f"group {i % 40}" for i in range(200)] + [f"single {i}" for i in range(400)]
    shard = {r.doc_id: r.shard for r in sharding.place(docs_of(spark, texts), Scratch(spark)).collect()}
    split = [g for g in range(40) if len({shard[i] for i in range(200) if i % 40 == g}) > 1]
    assert not split


def test_sharded_rows_are_the_documents(spark):
    docs = docs_of(spark, ["a", "a", None, "", "b"]).withColumn("shard", F.lit("old"))
    docs = docs.unionByName(docs.where("doc_id < 2"))
    out = sharding.sharded(docs, Scratch(spark))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    key = lambda rows: collections.Counter((r.doc_id, r.text) for r in rows)
    assert key(out.collect()) == key(docs.collect())


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5))).collect()]
        assert sorted(got) == list(range(n))


def targets_of(sizes):
    """By the rule's own words: fix what is above its cap, reshare, until none is."""
    total, weight = sum(sizes), [i % 3 + 1 for i in range(len(sizes))]
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while free:
        w = sum(weight[i] for i in free)
        over = [i for i in free if left * weight[i] / w > 3 * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weight[i] / w
            break
        for i in over:
            out[i] = 3.0 * sizes[i]
        left -= sum(out[i] for i in over)
        free -= set(over)
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 5, 1000], [0, 10, 10, 3000, 2], [7]])
def test_targets(spark, sizes):
    table = spark.createDataFrame([(f"s{i}", f"src{i}", n) for i, n in enumerate(sizes)], "skey string, source string, source_size long")
    got = {r.skey: r.target for r in mixing.targets(table).collect()}
    for i, t in enumerate(targets_of(sizes)):
        assert got[f"s{i}"] == pytest.approx(t)


def test_mix(spark):
    texts = [" ".join(["w"] * (i % 50)) for i in range(400)] + [None, "", "\x0bone\x0ctwo "]
    sources = ["big" if i % 2 else f"s{i % 5}" for i in range(402)] + [None]
    docs = docs_of(spark, texts, sources)
    got = mixing.taken(docs, Scratch(spark), block=8).collect()
    again = mixing.taken(docs, Scratch(spark), block=8).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == 403
    size = {r.doc_id: r["size"] for r in got}
    assert size[402] == 2 and size[400] == size[401] == 0
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[sources[r.doc_id]].append(r)
    assert sum(rows[0].target for rows in by.values()) == pytest.approx(sum(size.values()))
    for rows in by.values():
        assert sum(r.taken for r in rows) == pytest.approx(rows[0].target, abs=16)


def test_mix_of_nothing(spark):
    assert mixing.taken(docs_of(spark, []), Scratch(spark)).isEmpty()
    assert [r.taken for r in mixing.taken(docs_of(spark, [None, ""]), Scratch(spark)).collect()] == [0, 0]


def test_mixed_documents_are_whole(spark):
    docs = docs_of(spark, [f"text number {i} " * 20 for i in range(60)], [f"s{i % 3}" for i in range(60)]).withColumn("copies", F.lit("clash"))
    out = mixing.mixed(docs, Scratch(spark), block=8)
    assert out.columns == docs.columns
    times = collections.Counter(r.doc_id for r in out.collect())
    assert max(times.values()) <= 3 and 30 < sum(times.values()) < 100
