"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.storage import delete, written


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """node and component (the least node that links lead to) of every node of links; null ends and links to itself don't count.

    Links are rewired to the least neighbour, in turns from above and from below, until nothing moves: some rounds more than the
    logarithm of the longest chain. Each round is a table in the shared folder, and only its count and a sum of hashes come to the driver.
    """
    pairs = links.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    edges = pairs.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct()
    table, path = written(edges, "components")
    seen = None
    while True:
        both = table.unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        after, place = written(moved, "components")
        delete(table.sparkSession, path)
        table, path = after, place
        now = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return table.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(table.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
