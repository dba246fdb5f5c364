"""The pipeline's stages on a small corpus, against what each must do."""

import collections
import random

from pyspark.sql import functions as F

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(f"w{rng.randrange(400)}" for _ in range(n))


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    item = prose(rng, 40)
    texts = [prose(rng, rng.randint(20, 90)) for _ in range(240)]
    for i in range(0, 240, 4):
        texts[i] = f"scum idiot {texts[i]} scum"
    texts += [texts[1]] * 6 + [texts[5] + " tail"] + [f"{texts[9]} {item} {texts[13]}", item, None, ""]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    sf = f"file://{tmp_path}"
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/out{i}")
        docs = spark.read.parquet(f"{sf}/out{i}")
        kept[name] = docs.collect()
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {k: {r.doc_id for r in v} for k, v in kept.items()}
    assert len([i for i in range(0, 240, 4) if i in ids["toxicity"]]) <= 2
    assert len([i for i in range(240) if i % 4 and i in ids["toxicity"]]) >= 176
    assert 1 in ids["near_dedup"] and not ids["near_dedup"] & set(range(240, 246))
    assert 248 not in ids["decontamination"] and all(item not in (r.text or "") for r in kept["decontamination"])
    assert max(collections.Counter(r.doc_id for r in kept["mixing"]).values()) <= 3
    sizes = collections.Counter(r.shard for r in kept["sharding"])
    assert sum(sizes.values()) == len(kept["mixing"]) and max(sizes.values()) - min(sizes.get(s, 0) for s in range(24)) <= 1
    assert not docs.where(F.col("slot").isNull()).count()


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 50 and out.columns[-2:] == ["shard", "slot"]
