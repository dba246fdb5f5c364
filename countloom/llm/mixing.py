"""Mixing sources to target weights by blocks. DataFrame functions only.

The words of a source, document after document, are packed into blocks of `block` words. A source's target is its share
by weight, at most `most` times its size, the excess being reshared by weight. Each target is so many draws of blocks.
The output's slots are filled by a pseudorandom permutation of all draws, so the counts by source of an output shard are
multinomial counts under the condition that the draws of the whole mix meet the targets exactly. The j-th draw of a
source takes block perm(j mod n) of its n blocks, with another permutation for each round of n draws: no block is taken
more than ceil(most) times. Slots and blocks then meet in a join on (source, block index).

The permutations are swap-or-not shuffles of [0, n): each round pairs x with (key - x) mod n and one hash bit of the
pair decides whether they swap. That is a bijection for any n, is made of built-in functions, and reruns agree.

Edge cases: null and empty texts have size 0 and are never taken; a null source is a source of its own, the last;
repeated rows, ties and rows without an id each have their own place in their source's stream; very long texts fill many
blocks; an empty table gives an empty one; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from countloom.llm.common import WORD, Scratch, row_hash, running

ROUNDS = 12


def permuted(x: Column, n: Column, seed: Column, rounds: int = ROUNDS) -> Column:
    """Where a pseudorandom permutation of [0, n) takes x."""
    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(seed, r), n) + n - x, n)
        bit = F.xxhash64(F.greatest(x, partner), seed, -1 - r).bitwiseAND(F.lit(1))
        return F.when(bit == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x.cast("long"), swap)


def targets(sources: DataFrame, most: float = 3.0) -> DataFrame:
    """sources (skey, source, source_size) with weight and target: min(most * size, level * weight), where the level
    makes the targets add up to all sizes. The sources that stop at their cap are those of least cap by weight."""
    every = Window.partitionBy(F.lit(0))
    s = sources.withColumn("weight", (F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("total", F.sum("source_size").over(every)).withColumn("all", F.sum("weight").over(every))
    by_cap = every.orderBy(F.col("cap") / F.col("weight"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0))) / (F.col("all") - F.coalesce(F.sum("weight").over(by_cap), F.lit(0)))
    s = s.withColumn("level", level).withColumn("free", F.col("cap") / F.col("weight") >= F.col("level"))
    s = s.withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("skey"), F.col("level").alias("l")))).over(every)["l"])
    return s.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))).drop("total", "all", "level", "free", "cap")


def plan(docs: DataFrame, scratch: Scratch, block: int = 128, most: float = 3.0, per_shard: int = 4096, seed: int = 9) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sized (doc_id, skey, size, at: where its words begin in its source's stream), sources (with target, blocks,
    draws), and slots (out_shard, slot, skey, index): which block fills each slot of the mix."""
    spark = docs.sparkSession
    skey = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("none"))
    sized = docs.select("doc_id", skey.alias("skey"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("t"))
    sized = scratch.save(sized, "sized")
    sources = sized.groupBy("skey").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    sources = targets(sources, most).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    draws = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") / F.col("source_size") * F.col("blocks")), F.col("blocks") * F.lit(int(most)))).otherwise(0)
    sources = sources.withColumn("draws", draws.cast("long"))
    sources = sources.withColumn("first", F.coalesce(F.sum("draws").over(Window.partitionBy(F.lit(0)).orderBy("skey").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sources = scratch.save(sources.coalesce(1), "sources")
    total = sources.agg(F.coalesce(F.sum("draws"), F.lit(0))).first()[0]
    sized = running(sized, ["skey"], ["doc_id", "t"], F.col("size"), "at", sized.count()).drop("source")
    # a source's draws are one interval of all draws; the intervals are cut at multiples of `piece` for an equi-join
    piece = 65536
    cut = sources.where("draws > 0").select("skey", "first", "draws", "blocks", F.explode(F.sequence(F.floor(F.col("first") / piece), F.floor((F.col("first") + F.col("draws") - 1) / piece))).alias("piece"))
    pos = spark.range(total).withColumnRenamed("id", "position")
    pos = pos.withColumn("draw", permuted(F.col("position"), F.lit(max(total, 1)).cast("long"), F.lit(seed))).withColumn("piece", F.floor(F.col("draw") / piece))
    own = F.col("draw") - F.col("first")
    slots = pos.join(cut, "piece").where((own >= 0) & (own < F.col("draws")))
    turn = F.xxhash64(F.lit(seed), "skey", F.floor(own / F.col("blocks")))
    index = permuted(F.pmod(own, F.col("blocks")), F.col("blocks"), F.col("turn"))
    slots = slots.withColumn("turn", turn).select(F.floor(F.col("position") / per_shard).alias("out_shard"), (F.col("position") % per_shard).cast("int").alias("slot"), "skey", index.alias("index"))
    return sized, sources, slots


def taken(docs: DataFrame, scratch: Scratch, block: int = 128, **how) -> DataFrame:
    """(doc_id, t, size, source_size, target, taken): how many of each document's words the mix takes, repeats counted;
    t: the text's hash."""
    sized, sources, slots = plan(docs, scratch, block, **how)
    uses = slots.groupBy("skey", "index").agg(F.count("*").alias("uses"))
    last = F.floor((F.col("at") + F.col("size") - 1) / block)
    parts = sized.where("size > 0").withColumn("index", F.explode(F.sequence(F.floor(F.col("at") / block), last)))
    length = F.least(F.col("at") + F.col("size"), (F.col("index") + 1) * block) - F.greatest(F.col("at"), F.col("index") * block)
    parts = parts.withColumn("length", length).join(uses, ["skey", "index"], "left")
    words = parts.groupBy("skey", "at", "doc_id", "t", "size").agg(F.coalesce(F.sum(F.col("uses") * F.col("length")), F.lit(0)).alias("taken")).select("skey", "doc_id", "t", "size", "taken")
    words = words.unionByName(sized.where("size = 0").select("skey", "doc_id", "t", "size", F.lit(0).cast("long").alias("taken")))
    return words.join(sources.select("skey", "source_size", "target"), "skey").select("doc_id", "t", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """The documents of the mix, whole: each row stands as often as the mix takes its words, a rest of less than one
    whole document being decided by a hash of the document, so that words still come near their targets. Equal rows
    share one number of copies for each."""
    share = taken(docs, scratch, **how)
    nth = F.row_number().over(Window.partitionBy("doc_id", "t").orderBy("taken"))
    u = F.pmod(F.xxhash64(F.lit("copies"), "doc_id", "t", "nth"), F.lit(1 << 30)) / float(1 << 30)
    share = share.where("size > 0").withColumn("nth", nth).select(F.col("doc_id").alias("d"), "t", "nth", F.floor(F.col("taken") / F.col("size") + u).cast("int").alias("copies")).where("copies > 0")
    rows = docs.select(F.struct(*docs.columns).alias("row"), row_hash(docs).alias("whole")).select("row", "whole", F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("own"))
    rows = rows.withColumn("own_nth", F.row_number().over(Window.partitionBy("id", "own").orderBy("whole")))
    met = rows.join(share, F.col("id").eqNullSafe(F.col("d")) & (F.col("own") == F.col("t")) & (F.col("own_nth") == F.col("nth")))
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)).drop("t")
