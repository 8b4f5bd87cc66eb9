"""Histograms, cumulative curves and their quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """keys, bin, n, density. Values out of range count neither; the last bin holds its right edge too."""
    width = (high - low) / bins
    inside = df.where(F.col(value).between(low, high))
    counts = inside.withColumn("bin", F.least(F.floor((F.col(value) - low) / F.lit(width)), F.lit(bins - 1))).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys)) if keys else F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("density", F.col("n") / (total * F.lit(width)))


def histogram_2d(df: DataFrame, x: str, y: str, width_x: float, width_y: float) -> DataFrame:
    return df.groupBy(F.floor(F.col(x) / width_x).alias("bin_x"), F.floor(F.col(y) / width_y).alias("bin_y")).agg(F.count(F.lit(1)).alias("n"))


def cumulative(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """keys, bin, edge (the bin's right one), cdf, for all bins; keys without a value in range have no rows."""
    width = (high - low) / bins
    counts = histogram(df, keys, value, low, high, bins)
    every = counts.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    filled = every.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy(*keys)
    running = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w)
    return filled.select(*keys, "bin", (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("edge"), running.alias("cdf"))


def mean_curve(curves: DataFrame, keys: list[str]) -> DataFrame:
    """The mean of the curves at each bin: keys, bin, edge, cdf."""
    return curves.groupBy(*keys, "bin", "edge").agg(F.avg("cdf").alias("cdf"))


def curve_quantile(curves: DataFrame, keys: list[str], q: float = 0.5) -> DataFrame:
    """keys, x where the curve, made monotone, first reaches q, linear between bins; its last x if it doesn't."""
    order = Window.partitionBy(*keys).orderBy("edge")
    mono = curves.withColumn("cdf", F.max("cdf").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    step = mono.withColumns({"cdf0": F.lag("cdf").over(order), "edge0": F.lag("edge").over(order)})
    x = F.when(F.col("cdf0").isNull() | (F.col("cdf") == F.col("cdf0")), F.col("edge")).otherwise(F.col("edge0") + (F.lit(q) - F.col("cdf0")) / (F.col("cdf") - F.col("cdf0")) * (F.col("edge") - F.col("edge0")))
    found = step.groupBy(*keys).agg(F.min_by(F.when(F.col("cdf") >= q, x), F.when(F.col("cdf") >= q, F.col("edge"))).alias("_at"), F.max("edge").alias("_last"))
    return found.select(*keys, F.coalesce("_at", "_last").alias("x"))


def mean_density(df: DataFrame, keys: list[str], sample: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """keys, bin, density: each sample's density histogram over the range, and the mean of these; a sample without a value in a bin has 0 there."""
    each = histogram(df.where(F.col(value).isNotNull()), [*keys, sample], value, low, high, bins)
    samples = each.select(*keys, sample).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sums = each.groupBy(*keys, "bin").agg(F.sum("density").alias("_d"))
    full = samples.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")))).join(sums, [*keys, "bin"], "left")
    return full.select(*keys, "bin", (F.coalesce("_d", F.lit(0.0)) / F.col("_n")).alias("density"))
