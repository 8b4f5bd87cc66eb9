"""Sharding by balanced label propagation, in DataFrame operations only.

Documents start in the shard of a hash. Linked ones move, round by round, towards the shard that most of their
neighbours are in: a join brings each document the votes of its groups, and quotas let only so many into a shard
that its linked documents stay within its capacity. Rounds go on until no document moves or the links between shards no
longer grow fewer. Documents without links then fill the shards up to
exactly equal numbers of rows, so that evenness costs no link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.shared import drop, keep, ranked, skew_join, told_apart, uniform

SHARDS = 8
PATIENCE = 2  # rounds without fewer cut links
BUCKET_ROWS = 256


def propagate(links: DataFrame, capacity: float, total: int, shards: int = SHARDS) -> tuple[DataFrame, float]:
    """uid and shard of the linked nodes, and the number of links that go between shards.

    links: uid, h, group, n, shard: the row is one of the n members of the group, which are neighbours; h tells nodes apart and
    shard is where they start. Each round, a node asks for the shard with most votes among its own and those with room (ties:
    by a hash of its group); of those that ask for a shard, the share that has room moves. In a shard without room a node
    stays if all its neighbours are there, or are too many for any shard; else they meet elsewhere. After the first round a
    part of the nodes rests, so that neighbours don't swap places for ever.
    """
    at = keep(links.select("uid", "h", "shard").distinct(), "sharding-round")
    best, least, stale, k = at, None, 0, 0
    while True:
        load = {r["shard"]: r["n"] for r in at.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each shard
        room = [capacity - load.get(s, 0) for s in range(shards)]
        votes = links.select("uid", "group", "n").join(at, "uid").groupBy("group", "n").agg(*(F.count_if(F.col("shard") == s).alias(f"v{s}") for s in range(shards)))
        votes = keep(votes, "sharding-votes")
        square = lambda c: F.col(c).cast("decimal(20,0)") * F.col(c)
        cut = float(votes.agg(F.sum(square("n") - sum((square(f"v{s}") for s in range(shards)), F.lit(0)))).first()[0] or 0) / 2
        if least is None or cut < least:
            best, least, stale = at, cut, 0
        else:
            stale += 1
        if not cut or stale >= PATIENCE:
            return best.select("uid", "shard"), least
        seen = skew_join(links.select("uid", "group"), votes, "group", "n", total)
        sums = seen.groupBy("uid").agg(F.min("group").alias("tie"), F.sum("n").alias("all"), *(F.sum(f"v{s}").alias(f"v{s}") for s in range(shards)))

        def chance(s: int) -> Column:
            score = F.struct(F.col(f"v{s}").alias("votes"), F.xxhash64("tie", F.lit(s)).alias("tie"), F.lit(s).alias("to"))
            stays = (F.col("shard") == s) & ((F.col(f"v{s}") == F.col("all")) | (F.col("all") > max(room)))
            return score if room[s] >= 1 else F.when(stays, score)

        asks = at.join(sums, "uid").select("uid", "h", "shard", F.coalesce(F.greatest(*map(chance, range(shards)))["to"], F.col("shard")).alias("to"))
        asks = keep(asks.withColumn("asks", (F.col("to") != F.col("shard")) & (uniform("h", seed=100 + k) < (0.7 if k else 1.0))), "sharding-asks")
        into = {r["to"]: r["n"] for r in asks.where("asks").groupBy("to").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not into:
            return best.select("uid", "shard"), least
        share = F.coalesce(*(F.when(F.col("to") == s, min(1.0, max(0.0, room[s] / n))) for s, n in into.items()), F.lit(0.0))
        goes = F.col("asks") & (uniform("h", seed=200 + k) < share)
        at = keep(asks.select("uid", "h", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard")), "sharding-round")
        drop(asks)
        drop(votes)
        k += 1


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is 'rows': the counts of the shards are at most one apart. Documents with equal texts are linked; a null
    text counts as empty, with size 1. Null and repeated ids are rows like others; rows alike in id and text may trade
    places, else the result is the same however docs is partitioned. With fewer rows than shards, some
    shards are empty. A group with more rows than a shard holds goes on in the next. Further columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = keep(rows.withColumn("uid", F.monotonically_increasing_id()), "sharding-rows")
    total = rows.count()
    rows = told_apart(rows, ["doc_id", "digest"], total)
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    start = F.pmod(F.xxhash64("h", F.lit(3)), F.lit(shards)).cast("int").alias("shard")
    links = skew_join(rows.select("uid", "h", "digest"), groups, "digest", "n", total).select("uid", "h", F.xxhash64("digest").alias("group"), "n", start)
    links = keep(links, "sharding-links")
    quota = [(s + 1) * total // shards - s * total // shards for s in range(shards)]
    moved, _ = propagate(links, total / shards, total, shards)

    # Large groups come first in a shard, so that what there is no room for has few links
    wide, mixed = F.lit(max(1, total // BUCKET_ROWS)), F.xxhash64("h", F.lit(7))
    place = F.when(F.col("n") > BUCKET_ROWS, F.pmod(mixed, wide)).otherwise(wide + F.pmod(F.xxhash64("group"), wide))
    held = links.drop("shard").join(moved, "uid").withColumn("place", place)
    held = keep(ranked(held.select("uid", "h", "group", "shard", "place"), ["shard"], "place", ["group", "h", "uid"]), "sharding-held")
    most = F.coalesce(*(F.when(F.col("shard") == s, q) for s, q in enumerate(quota)))
    held = held.where(F.col("rank") < most).select("uid", "shard", F.col("rank").alias("slot"))
    load = {r["shard"]: r["n"] for r in held.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    free = rows.select("uid", "h").join(held, "uid", "left_anti").withColumn("place", F.pmod(mixed, wide))
    free = ranked(free, [], "place", ["h", "uid"])
    shard, slot, start = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s, q in enumerate(quota):
        there = load.get(s, 0)
        here = (F.col("rank") >= start) & (F.col("rank") < start + q - there)
        shard, slot = F.when(here, s).otherwise(shard), F.when(here, F.col("rank") - start + there).otherwise(slot)
        start += q - there
    placed = held.unionByName(free.select("uid", shard.alias("shard"), slot.alias("slot")))
    out = rows.join(placed, "uid")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_shard(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
