"""Balanced label propagation: linked documents move towards their neighbours' shards under quotas. DataFrame functions
only.

Documents of equal text are linked (null texts with nothing). The links are kept as document - group, never as pairs,
and the state as (group, shard, documents): a hot group is `shards` rows. In each round a group's documents want to
go to the shard that holds most of them. How many may go from shard a to shard b is found on the driver from the
shards x shards matrix of wishes: pairs of opposite wishes swap, and what room a shard has left under its quota is given
to the wishes that remain. Documents without links, and what exceeds a quota, fill the rest. Law `rows`: the quotas are
the row counts, at most one apart, and every shard ends at exactly its quota.

Edge cases: an empty table gives an empty one; repeated rows count one by one; a group larger than a quota is split over
several shards; null ids and very long texts take part like any other; ties go by a hash; other columns are not looked at, and
sharded() replaces columns named shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from countloom.llm.common import Scratch, row_hash, running, text_keys, values


def allowed(wishes: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many may go from a to b: opposite wishes swap, then room is given away, the largest wish first."""
    out = {(a, b): min(n, wishes.get((b, a), 0)) for (a, b), n in wishes.items()}
    room = list(room)
    for (a, b), n in sorted(wishes.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - out[a, b], max(0, room[b]))
        out[a, b] += more
        room[b] -= more
        room[a] += more
    return out


def propagate(linked: DataFrame, quotas: list[int], scratch: Scratch, rounds: int) -> DataFrame:
    """(g1, g2, shard, n) after label propagation; linked: g1, g2, shard, n to begin with."""
    shards, spark = len(quotas), linked.sparkSession
    state = scratch.save(linked, "state0")
    for i in range(rounds):
        g = Window.partitionBy("g1", "g2")
        best = state.withColumn("to", F.max(F.struct("n", F.xxhash64("g1", "shard"), F.col("shard").alias("s"))).over(g)["s"])
        moves = best.where("shard <> to")
        held = dict(state.groupBy("shard").agg(F.sum("n")).collect())  # at most `shards` rows
        wishes = {(a, b): n for a, b, n in moves.groupBy("shard", "to").agg(F.sum("n")).collect()}  # at most shards squared
        leave = allowed(wishes, [q - held.get(s, 0) for s, q in enumerate(quotas)])
        if not any(leave.values()):
            break
        limits = values(spark, [(a, b, n) for (a, b), n in leave.items()], "shard int, to int, most long")
        queue = running(moves, ["shard", "to"], ["g1", "g2"], F.col("n"), "before", sum(quotas)).join(F.broadcast(limits), ["shard", "to"])
        goes = F.least(F.col("n"), F.greatest(F.lit(0), F.col("most") - F.col("before")))
        queue = queue.withColumn("goes", goes).where("goes > 0").select("g1", "g2", "shard", "to", "goes")
        change = queue.select("g1", "g2", "shard", (-F.col("goes")).alias("n")).unionByName(queue.select("g1", "g2", F.col("to").alias("shard"), F.col("goes").alias("n")))
        state = scratch.save(state.unionByName(change).groupBy("g1", "g2", "shard").agg(F.sum("n").alias("n")).where("n > 0"), f"state{i + 1}")
        scratch.drop(f"state{i}")
    return state


def place(docs: DataFrame, scratch: Scratch, shards: int = 24, rounds: int = 4) -> DataFrame:
    """(doc_id, t1, t2, size, text_crc32, shard, slot) for each row of docs (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = scratch.save(docs.select("doc_id", *text_keys(F.col("text")), F.col("text").isNull().alias("none"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")), "base")
    total = base.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    groups = base.where("not none").groupBy(F.col("t1").alias("g1"), F.col("t2").alias("g2")).agg(F.count("*").alias("members")).where("members > 1")
    groups = scratch.save(groups, "groups")
    # each linked document begins in a shard of its own choice; equal choices of a group are one row
    rank = running(base.where("not none").join(groups, (F.col("t1") == F.col("g1")) & (F.col("t2") == F.col("g2"))), ["g1", "g2"], ["doc_id"], F.lit(1), "rank", total)
    linked = scratch.save(rank.select("doc_id", "t1", "t2", "size", "text_crc32", "rank"), "linked")
    start = linked.select(F.col("t1").alias("g1"), F.col("t2").alias("g2"), F.pmod(F.xxhash64("doc_id", "t1", "rank"), F.lit(shards)).cast("int").alias("shard"))
    state = propagate(start.groupBy("g1", "g2", "shard").agg(F.count("*").alias("n")), quotas, scratch, rounds)
    # a group's documents, by rank, go to its shards in turn
    upto = F.sum("n").over(Window.partitionBy("g1", "g2").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    where = state.withColumn("upto", upto).groupBy("g1", "g2").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("cuts"))  # at most `shards` entries
    sent = linked.join(where, (F.col("t1") == F.col("g1")) & (F.col("t2") == F.col("g2")))
    sent = sent.withColumn("shard", F.filter("cuts", lambda c: c["upto"] > F.col("rank"))[0]["shard"]).select("doc_id", "t1", "t2", "size", "text_crc32", "shard")
    sent = running(sent, ["shard"], ["t1", "t2", "doc_id"], F.lit(1), "slot", total)
    quota = F.array(*[F.lit(q) for q in quotas])
    sent = scratch.save(sent.withColumn("over", F.col("slot") >= F.element_at(quota, F.col("shard") + 1)), "sent")
    held = dict(sent.groupBy("shard").count().collect())
    held = [min(held.get(s, 0), q) for s, q in enumerate(quotas)]
    single = base.join(groups, (F.col("t1") == F.col("g1")) & (F.col("t2") == F.col("g2")) & ~F.col("none"), "left_anti").drop("none")
    rest = single.unionByName(sent.where("over").select(*single.columns))
    rest = running(rest, [], ["doc_id", "t1"], F.lit(1), "nth", total)
    ends, at = [], 0
    for s, q in enumerate(quotas):
        at += q - held[s]
        ends.append(at)
    shard = F.coalesce(*[F.when(F.col("nth") < e, F.lit(s)) for s, e in enumerate(ends)])
    begin = F.array(*[F.lit(held[s] - (ends[s - 1] if s else 0)).cast("long") for s in range(shards)])
    rest = rest.withColumn("shard", shard).withColumn("slot", F.col("nth") + F.element_at(begin, F.col("shard") + 1)).drop("nth")
    return sent.where("not over").drop("over").unionByName(rest)


def sharded(docs: DataFrame, scratch: Scratch, shards: int = 24, **how) -> DataFrame:
    """docs with their shard and slot. Rows that agree in id and text are told apart by their number only."""
    placed = place(docs, scratch, shards, **how)
    placed = placed.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "t1", "t2").orderBy("shard", "slot"))).select(F.col("doc_id").alias("__id"), F.col("t1").alias("__p1"), F.col("t2").alias("__p2"), "nth", "shard", "slot")
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in ("shard", "slot")]).alias("row"), row_hash(docs).alias("whole")).select("row", "whole", F.col("row.doc_id").alias("id"), *text_keys(F.col("row.text"), ("k1", "k2")))
    rows = rows.withColumn("own", F.row_number().over(Window.partitionBy("id", "k1", "k2").orderBy("whole")))
    met = rows.join(placed, F.col("id").eqNullSafe(F.col("__id")) & (F.col("k1") == F.col("__p1")) & (F.col("k2") == F.col("__p2")) & (F.col("own") == F.col("nth")))
    return met.select("row.*", "shard", "slot")


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    placed = place(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
