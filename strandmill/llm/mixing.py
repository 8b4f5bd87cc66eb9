"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each source has a target number of words. A document of a source with target t and size s gets t / s copies:
the whole part at once, the rest as a probability. Pairs of documents transfer probability mass, weighted by
their sizes, until one of the two is integral; the other goes on. Blocks of documents fold to one residual,
blocks of residuals to one again, and so on up a tree, so that each source's words meet its target but
for a part of the last residual. That one is rounded. What this leaves owed, half of its size at most, smaller documents of
the whole source make up for: a share of them by a hash, and what then is left a pool of about POOL of them, the large
ones first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.shared import drop, keep, numbered, ranked, skew_join, told_apart, uniform

FAN_IN = 48
POOL = 256
WORD = r"[^\x20\x09-\x0D]+"
SEED = 17


def source_targets(sized: DataFrame, cap: float = 3.0) -> DataFrame:
    """source, rank, n, units, source_size, target of each source of sized (source, size), in the shared folder.

    n are all rows of a source and units those with words. Sources by code point, null last, weigh 1, 2, 3, 1, ...;
    targets are the level at which the weights share all words, where none is above cap times its source's size: sources
    that the level would fill up are taken out until none is left.
    """
    sources = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("size") > 0).alias("units"), F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    ranged = keep(sources.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "mixing-sources")
    weighed = keep(ranked(ranged, [], "_range", order).withColumn("weight", F.col("rank") % 3 + 1).drop("_range"), "mixing-sources")
    drop(ranged)
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1
    while True:
        full = F.col("source_size") * F.lit(cap) < F.lit(level) * F.col("weight")
        held, weights, k = weighed.agg(F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if k == before or not weights:
            break
        level, before = (total - cap * (held or 0)) / weights, k
    return weighed.withColumn("target", F.least(F.col("source_size") * F.lit(cap), F.lit(level) * F.col("weight"))).drop("weight")


def _fold(units: str) -> str:
    """SQL: folds an array of (uid, h, mass, size) to one residual and the copies of the others.

    Of residual a and unit b, mass moves to a with probability down / (up + down), else to b; up and down are
    the most that can move either way. Then one of the two is empty or full.
    """
    return f"""
    aggregate(slice({units}, 2, size({units})),
      named_struct('uid', {units}[0].uid, 'h', {units}[0].h, 'mass', {units}[0].mass, 'size', {units}[0].size,
                   'done', cast(array() as array<struct<h:bigint,size:double,uid:bigint,copy:int>>)),
      (a, b) -> transform(array(named_struct(
          'up', least(a.size - a.mass, b.mass), 'down', least(a.mass, b.size - b.mass),
          'r', shiftrightunsigned(xxhash64(a.h, b.h, a.size, b.size, {SEED}), 11) / 9007199254740992D)),
        m -> CASE
          WHEN m.r * (m.up + m.down) < m.down THEN
            IF(a.size - a.mass <= b.mass,
              named_struct('uid', b.uid, 'h', b.h, 'mass', b.mass - m.up, 'size', b.size, 'done', concat(a.done, array(named_struct('h', a.h, 'size', a.size, 'uid', a.uid, 'copy', 1)))),
              named_struct('uid', a.uid, 'h', a.h, 'mass', a.mass + m.up, 'size', a.size, 'done', concat(a.done, array(named_struct('h', b.h, 'size', b.size, 'uid', b.uid, 'copy', 0)))))
          ELSE
            IF(a.mass <= b.size - b.mass,
              named_struct('uid', b.uid, 'h', b.h, 'mass', b.mass + m.down, 'size', b.size, 'done', concat(a.done, array(named_struct('h', a.h, 'size', a.size, 'uid', a.uid, 'copy', 0)))),
              named_struct('uid', a.uid, 'h', a.h, 'mass', a.mass - m.down, 'size', a.size, 'done', concat(a.done, array(named_struct('h', b.h, 'size', b.size, 'uid', b.uid, 'copy', 1)))))
          END)[0])"""


def _settle() -> str:
    """SQL: the pool with some copies changed, large documents first, wherever that brings owed nearer to 0."""
    change = "IF(u.copy = 0, u.size, -u.size)"
    return f"""
    aggregate(reverse(array_sort(pool)),
      named_struct('owed', owed, 'out', cast(array() as array<struct<uid:bigint,copy:int>>)),
      (a, u) -> IF(abs(a.owed - {change}) < abs(a.owed),
        named_struct('owed', a.owed - {change}, 'out', concat(a.out, array(named_struct('uid', u.uid, 'copy', 1 - u.copy)))),
        named_struct('owed', a.owed, 'out', concat(a.out, array(named_struct('uid', u.uid, 'copy', u.copy)))))).out"""


def _owed(decided: DataFrame, goals: DataFrame) -> DataFrame:
    """goals (group, n, goal) with owed, the words by which what is decided falls short of the goal."""
    taken = decided.groupBy("group").agg(F.sum(F.col("copy") * F.col("size").cast("long")).alias("_taken"))
    return goals.join(taken, "group").select("group", "n", "goal", (F.col("goal") - F.col("_taken")).cast("double").alias("owed"))


def pivotal_copies(units: DataFrame, largest: int, total: int) -> DataFrame:
    """uid and copy (0 or 1) of units (group, n, uid, h, mass, size), where mass / size is the probability.

    n is the number of units of the group, largest the greatest n and total the sum of all; h is a number that tells units
    apart and doesn't depend on how they are partitioned, so equal input gives equal results. The sum of copy * size comes
    as near the sum of the masses as the sizes of the pool's documents allow.
    """
    goals = keep(units.groupBy("group").agg(F.first("n").alias("n"), F.sum(F.col("mass").cast("decimal(28,6)")).alias("goal")), "mixing-goals")
    blocks = -(-largest // FAN_IN)
    level = units.withColumn("block", F.pmod(F.xxhash64("h", F.lit(SEED)), F.ceil(F.col("n") / FAN_IN)))
    done = []
    while True:
        node = F.array_sort(F.collect_list(F.struct(F.xxhash64("h", F.lit(SEED + 1)).alias("o"), "h", "size", "mass", "uid")))
        folded = level.groupBy("group", "block").agg(node.alias("units")).select("group", "block", F.expr(_fold("units")).alias("r"))
        folded = keep(folded, "mixing-level")
        done.append(folded.select("group", F.explode("r.done").alias("d")).select("group", "d.uid", "d.h", "d.size", "d.copy"))
        level = folded.select("group", "block", "r.uid", "r.h", "r.mass", "r.size")
        if blocks <= 1:
            break
        blocks = -(-blocks // FAN_IN)
        level = level.withColumn("block", F.floor(F.col("block") / FAN_IN))
    decided = level.select("group", "uid", "h", "size", (F.col("mass") * 2 >= F.col("size")).cast("int").alias("copy"))
    for more in done:
        decided = decided.unionByName(more)

    # Words owed are spread over the documents that are no longer than that: each changes with the same probability
    owed = skew_join(decided, _owed(decided, goals).drop("goal"), "group", "n", total)
    may = (F.col("size") <= F.abs("owed")) & (F.col("copy") == (F.col("owed") < 0).cast("int"))
    share = owed.where(may).groupBy("group").agg((F.first(F.abs("owed")) / F.sum(F.col("size").cast("long"))).alias("share"))
    shares = keep(_owed(decided, goals).join(share, "group", "left"), "mixing-owed")
    flips = may & (uniform("h", seed=SEED + 2) < F.col("share"))
    spread = skew_join(decided, shares.drop("goal"), "group", "n", total)
    spread = keep(spread.select("group", "n", "uid", "h", "size", F.when(flips, 1 - F.col("copy")).otherwise(F.col("copy")).alias("copy")), "mixing-spread")

    in_pool = uniform("h", seed=SEED + 3) * F.col("n") < POOL
    pool = spread.where(in_pool).groupBy("group").agg(F.collect_list(F.struct("size", "h", "uid", "copy")).alias("pool"))
    settled = pool.join(_owed(spread, goals), "group").select(F.explode(F.expr(_settle())).alias("d")).select("d.uid", "d.copy")
    return spread.where(~in_pool).select("uid", "copy").unionByName(settled)


def mix_sized(sized: DataFrame, cap: float = 3.0) -> DataFrame:
    """uid, source_size, target and copies of each row of sized (uid, id, source, size), a table in the shared folder."""
    sources = keep(source_targets(sized, cap), "mixing-targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(0.0)
    key = {"_name": F.coalesce("source", F.lit("")), "_none": F.col("source").isNull()}
    total = sized.count()
    rows = skew_join(sized.withColumns(key), sources.withColumns(key).withColumn("rate", rate).drop("source"), ["_name", "_none"], "n", max(total, 1))
    rows = rows.withColumns({"whole": F.floor("rate").cast("int"), "part": F.col("rate") - F.floor("rate")})
    units = rows.where("size > 0 AND part > 0").select(F.col("rank").alias("group"), F.col("units").alias("n"), "uid", "source", "id", (F.col("part") * F.col("size")).alias("mass"), F.col("size").cast("double").alias("size"))
    largest = sources.agg(F.max("units")).first()[0] or 0
    copies = pivotal_copies(told_apart(units, ["source", "id", "size"], total), largest, max(total, 1))
    more = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("copy", F.lit(0))).otherwise(0)
    return rows.join(copies, "uid", "left").select("uid", "source_size", "target", more.alias("copies"), "id", "source", "size")


def _size():
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size")


def mix(docs: DataFrame, cap: float = 3.0) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, copies, taken.

    Null and empty texts have size 0 and take nothing. Null ids, repeated ids and ties are rows like others; rows alike in
    source, id and size may trade places. Null is a source of its own. An empty table gives no rows. Further columns are not
    read.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("id"), "source", _size())
    rows = mix_sized(keep(sized.withColumn("uid", F.monotonically_increasing_id()), "mixing-sized"), cap)
    return rows.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, cap: float = 3.0) -> DataFrame:
    """docs with each row as many times as the mix takes it, with its columns. What mix() says of odd rows holds here too."""
    rows, uid = numbered(docs)
    times = f"{uid}copies"
    while times.lower() in {c.lower() for c in rows.columns}:
        times += "_"
    sized = keep(rows.select(F.col(uid).alias("uid"), F.col("doc_id").cast("long").alias("id"), "source", _size()), "mixing-sized")
    copies = mix_sized(sized, cap).where("copies > 0").select(F.col("uid").alias(uid), F.array_repeat(F.lit(True), F.col("copies")).alias(times))
    return rows.join(copies, uid).withColumn(times, F.explode(times)).select(*docs.columns)


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
