"""Joins and rewrites of half-open intervals (contig, start, stop). A contig is dealt into bins of some width, so that neither
a join nor a window has all of its rows in one task: intervals meet in the bins that they touch, and what a window
carries from bin to bin are a few rows for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 50_000
_BEFORE = (Window.unboundedPreceding, -1)


def bins_of(start: Column, stop: Column, width: int) -> Column:
    """The bins that an interval touches, one row for each; an empty interval touches that of its start."""
    return F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(stop - 1, start) / width)))


def merge_intervals(df: DataFrame, keys: list[str], start: str = "start", stop: str = "stop", width: int = WIDTH) -> DataFrame:
    """Overlapping or touching intervals of a key as one.

    Intervals are cut at the edges of bins and merged within each; then runs of merged pieces that touch at an edge are
    joined. A bin has two such pieces at most, so this second pass is as long as the key has bins, however many its intervals.
    """
    cut = df.select(*keys, F.col(start).alias("_s"), F.col(stop).alias("_e"), bins_of(F.col(start), F.col(stop), width).alias("_b"))
    cut = cut.withColumns({"_s": F.greatest("_s", F.col("_b") * width), "_e": F.least("_e", (F.col("_b") + 1) * width)})
    order = Window.partitionBy(*keys, "_b").orderBy("_s", "_e")
    reach = F.max("_e").over(order.rowsBetween(*_BEFORE))
    cut = cut.withColumn("_new", F.when(reach.isNull() | (F.col("_s") > reach), 1).otherwise(0))
    cut = cut.withColumn("_k", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = cut.groupBy(*keys, "_b", "_k").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
    pieces = pieces.withColumns({"_left": F.col("_s") == F.col("_b") * width, "_right": F.col("_e") == (F.col("_b") + 1) * width})
    along = Window.partitionBy(*keys, F.col("_left") | F.col("_right")).orderBy("_b", "_s")
    joins = F.col("_left") & F.lag("_right").over(along) & (F.lag("_b").over(along) == F.col("_b") - 1)
    edge = pieces.where("_left OR _right").withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    edge = edge.withColumn("_k", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edge.groupBy(*keys, "_k").agg(F.min("_s").alias(start), F.max("_e").alias(stop)).drop("_k")
    return pieces.where("NOT (_left OR _right)").select(*keys, F.col("_s").alias(start), F.col("_e").alias(stop)).unionByName(joined)


def overlap_join(left: DataFrame, right: DataFrame, key: str = "contig", width: int = WIDTH) -> DataFrame:
    """Pairs whose intervals overlap; the right's start and stop come as r_start and r_stop.

    Both sides go to every bin of width bases that they touch, and a pair counts in the bin where the later of its
    starts lies, so a contig with many intervals is spread over many tasks and no pair appears twice. Intervals
    are meant to be short against width; one that isn't only takes more bins.
    """
    def bins(df: DataFrame, start: str, stop: str) -> DataFrame:
        return df.withColumn("_bin", bins_of(F.col(start), F.col(stop), width))

    other = right.withColumnsRenamed({"start": "r_start", "stop": "r_stop"})
    met = bins(left, "start", "stop").join(bins(other, "r_start", "r_stop"), [key, "_bin"])
    met = met.where((F.col("start") < F.col("r_stop")) & (F.col("stop") > F.col("r_start")))
    return met.where(F.floor(F.greatest("start", "r_start") / width) == F.col("_bin")).drop("_bin")


def overlap_totals(left: DataFrame, right: DataFrame, key: str = "contig", width: int = WIDTH) -> DataFrame:
    """By key, the number of pairs that overlap_join gives, and the bases shared by them: key, pairs, shared. Keys without pairs are left out.

    Pairs aren't made. With each stop of right, the left intervals that began before it count; with each start, those that ended by then
    don't; between two places, depth times depth bases are shared. Sums run within bins, from what the bins before leave off.
    """
    names = ["_ls", "_le", "_rs", "_re", "_lo", "_ro"]  # starts and stops of left and right, and empty ones

    def places(df: DataFrame, side: int) -> DataFrame:
        own = df.where(F.col(key).isNotNull() & F.col("start").isNotNull() & F.col("stop").isNotNull())
        return own.select(key, F.stack(F.lit(2), "start", F.lit(side) + F.when(F.col("start") == F.col("stop"), 4).otherwise(0), "stop", F.lit(side + 1)).alias("at", "_kind"))

    kinds = {"_ls": (0, 4), "_le": (1,), "_rs": (2, 6), "_re": (3,), "_lo": (4,), "_ro": (6,)}
    steps = places(left, 0).unionByName(places(right, 2)).groupBy(key, "at").agg(*(F.count_if(F.col("_kind").isin(*kinds[n])).alias(n) for n in names))
    steps = steps.withColumn("_bin", F.floor(F.col("at") / width))
    along = Window.partitionBy(key).orderBy("_bin")
    carried = ["_ls", "_le", "_rs", "_re"]
    bins = steps.groupBy(key, "_bin").agg(*(F.sum(n).alias(n) for n in carried), F.min("at").alias("_first"))
    bins = bins.select(key, "_bin", *(F.coalesce(F.sum(n).over(along.rowsBetween(*_BEFORE)), F.lit(0)).alias(f"{n}0") for n in carried), F.lead("_first").over(along).alias("_next"))
    order = Window.partitionBy(key, "_bin").orderBy("at")
    until = {f"{n}1": F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0)) for n in carried}
    runs = steps.withColumns(until | {"_lead": F.lead("at").over(order)}).join(bins, [key, "_bin"])
    runs = runs.withColumns({f"{n}1": F.col(f"{n}0") + F.col(f"{n}1") for n in carried} | {"_lead": F.coalesce("_lead", "_next")})
    pairs = F.col("_re") * (F.col("_ls1") - F.col("_ls")) - F.col("_rs") * F.col("_le1") + F.col("_lo") * F.col("_ro")
    shared = (F.col("_ls1") - F.col("_le1")) * (F.col("_rs1") - F.col("_re1")) * (F.col("_lead") - F.col("at"))
    out = runs.groupBy(key).agg(F.sum(pairs).alias("pairs"), F.coalesce(F.sum(shared), F.lit(0)).cast("long").alias("shared"))
    return out.where("pairs > 0")


def flank(df: DataFrame, size: int) -> DataFrame:
    """Intervals grown by size on both sides, not below 0."""
    return df.withColumns({"start": F.greatest(F.col("start") - size, F.lit(0)), "stop": F.col("stop") + size})


def near(left: DataFrame, windows: DataFrame, size: int, key: str = "contig") -> DataFrame:
    """Distinct rows of left that overlap a window grown by size."""
    grown = flank(windows.select(key, "start", "stop"), size)
    return overlap_join(left, grown, key, max(size * 2, 50_000)).select(*left.columns).distinct()


def far(left: DataFrame, windows: DataFrame, size: int, key: str = "contig") -> DataFrame:
    """Distinct rows of left that overlap no window grown by size."""
    return left.distinct().join(near(left, windows, size, key), left.columns, "left_anti")


def boundary(direction: str = "direction", start: str = "start", stop: str = "stop") -> Column:
    """The inner end of a telomere: its stop on the minus side, else its start."""
    return F.when(F.col(direction) == "-", F.col(stop)).otherwise(F.col(start))


def centre(start: str = "start", stop: str = "stop") -> Column:
    return (F.col(start) + F.col(stop)) / 2


def within_reach(left: DataFrame, right: DataFrame, at: str, reach: int, key: str = "contig") -> DataFrame:
    """Pairs where an end of left's interval is at most reach from the position at of right.

    Both meet in bins; a pair for which both ends are near counts in the bin of its start.
    """
    width = max(2 * reach, WIDTH)
    ends = F.array_distinct(F.array(F.floor(F.col("start") / width), F.floor(F.col("stop") / width)))
    near = right.withColumn("_bin", bins_of(F.col(at) - reach, F.col(at) + reach + 1, width))
    met = left.withColumn("_bin", F.explode(ends)).join(near, [key, "_bin"])
    first, second = F.abs(F.col("start") - F.col(at)) <= reach, F.abs(F.col("stop") - F.col(at)) <= reach
    here = (first & (F.floor(F.col("start") / width) == F.col("_bin"))) | (~first & second)
    return met.where(here).drop("_bin")


def flag_within(left: DataFrame, position: str, right: DataFrame, at: str, reach: float, flag: str, key: str = "contig") -> DataFrame:
    """left with flag: whether some position at of right lies nearer than reach.

    Each bin of a key has the positions that lie in it or within reach of it as one array, so rows of left never multiply.
    """
    width = int(max(2 * reach, WIDTH))
    low, high = F.floor(F.col(at) - F.lit(reach)), F.floor(F.col(at) + F.lit(reach)) + 1
    held = right.withColumn("_bin", bins_of(low, high, width)).groupBy(key, "_bin").agg(F.collect_set(at).alias("_at"))
    found = F.exists("_at", lambda x: F.abs(F.col(position) - x) < reach)
    rows = left.withColumn("_bin", F.floor(F.col(position) / width)).join(held, [key, "_bin"], "left")
    return rows.withColumn(flag, F.coalesce(found, F.lit(False))).drop("_at", "_bin")


def nearest(left: DataFrame, right: DataFrame, at: str, key: str = "contig", width: int = WIDTH) -> DataFrame:
    """left with the position at of right that is nearest, the least of equally near ones, and distance.

    The distance is 0 if the position lies in the interval. Rows without one on their key have nulls. Only the last
    position before start and the first from there on can be nearest: they lie in the bin of start, or are the last and first of
    the next bins that have any.
    """
    bin_at = F.floor(F.col("start") / width)
    held = right.groupBy(key, F.floor(F.col(at) / width).alias("_bin")).agg(F.sort_array(F.collect_set(at)).alias("_at"))
    every = left.select(key, bin_at.alias("_bin")).distinct().join(held, [key, "_bin"], "full_outer")
    order = Window.partitionBy(key).orderBy("_bin")
    before = F.last(F.array_max("_at"), ignorenulls=True).over(order.rowsBetween(*_BEFORE))
    after = F.first(F.array_min("_at"), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    rows = left.withColumn("_bin", bin_at).join(every.withColumns({"_before": before, "_after": after}), [key, "_bin"], "left")
    last = F.coalesce(F.array_max(F.filter("_at", lambda x: x < F.col("start"))), F.col("_before"))
    first = F.coalesce(F.array_min(F.filter("_at", lambda x: x >= F.col("start"))), F.col("_after"))
    rows = rows.withColumns({"_last": last, "_first": first})
    up = F.greatest(F.col("_first") - F.col("stop"), F.lit(0))
    best = F.array_min(F.array_compact(F.array(*(F.when(x.isNotNull(), F.struct(d.alias("distance"), x.alias("at"))) for x, d in ((F.col("_last"), F.col("start") - F.col("_last")), (F.col("_first"), up))))))
    rows = rows.withColumn("_best", best).withColumns({f"nearest_{at}": F.col("_best.at"), "distance": F.col("_best.distance")})
    return rows.drop("_bin", "_at", "_before", "_after", "_last", "_first", "_best")


def arm_window(left: DataFrame, ends: DataFrame, width: int, key: str = "contig") -> DataFrame:
    """Rows of left by the arm of ends (contig, arm, boundary) next to which they lie: p from the boundary on, q up to it."""
    p = (F.col("arm") == "p") & (F.col("start") >= F.col("boundary")) & (F.col("start") < F.col("boundary") + width)
    q = (F.col("arm") == "q") & (F.col("stop") > F.col("boundary") - width) & (F.col("stop") <= F.col("boundary"))
    return left.join(ends, key).where(p | q)


def relative_to_arm(df: DataFrame, width: int) -> DataFrame:
    """Distance of both ends from the boundary, outwards, clipped to width; those that reach into the telomere go."""
    p = F.col("arm") == "p"
    begin = F.when(p, F.col("start") - F.col("boundary")).otherwise(F.col("boundary") - F.col("stop"))
    end = F.when(p, F.col("stop") - F.col("boundary")).otherwise(F.col("boundary") - F.col("start"))
    return df.withColumns({"rel_start": begin, "rel_stop": F.least(end, F.lit(width))}).where((F.col("rel_start") >= 0) & (F.col("rel_start") < width))


def coverage_runs(df: DataFrame, keys: list[str], start: str = "start", stop: str = "stop", width: int = WIDTH) -> DataFrame:
    """Runs of equal coverage: keys, start, stop, depth, from +1 and -1 at the ends of the intervals.

    Sums run within bins, from the depth at which the bins before leave off.
    """
    ends = df.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(stop).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(*keys, F.col("e.at").alias("start")).agg(F.sum("e.d").alias("d")).withColumn("_bin", F.floor(F.col("start") / width))
    along = Window.partitionBy(*keys).orderBy("_bin")
    bins = steps.groupBy(*keys, "_bin").agg(F.sum("d").alias("_d"), F.min("start").alias("_first"))
    bins = bins.select(*keys, "_bin", F.coalesce(F.sum("_d").over(along.rowsBetween(*_BEFORE)), F.lit(0)).alias("_base"), F.lead("_first").over(along).alias("_next"))
    order = Window.partitionBy(*keys, "_bin").orderBy("start")
    runs = steps.withColumns({"_sum": F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_lead": F.lead("start").over(order)}).join(bins, [*keys, "_bin"])
    runs = runs.withColumns({"depth": F.col("_base") + F.col("_sum"), "stop": F.coalesce("_lead", "_next")})
    return runs.where("stop IS NOT NULL").select(*keys, "start", "stop", "depth")


def end_windows(telomeres: DataFrame, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """Windows inwards of each telomere (contig, start, stop, direction) by name: contig, name, start, stop.

    ranges: name to the least and greatest distance from the boundary, as proximal (0, 10,000) and distal (10,000, 1,000,000).
    """
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(a).alias("low"), F.lit(b).alias("high")) for n, (a, b) in ranges.items()))).alias("w")
    minus = F.col("direction") == "-"
    begin = F.when(minus, F.col("stop") + F.col("w.low")).otherwise(F.col("start") - F.col("w.high"))
    end = F.when(minus, F.col("stop") + F.col("w.high")).otherwise(F.col("start") - F.col("w.low"))
    return telomeres.select("contig", "direction", "start", "stop", rows).select("contig", "direction", F.col("w.name").alias("name"), begin.alias("start"), end.alias("stop"))


def strictly_inside(sites: DataFrame, windows: DataFrame, key: str = "contig", width: int = WIDTH) -> DataFrame:
    """sites with the windows (key, name, direction, start, stop) that they lie in with both ends, which may not touch the window's."""
    met = overlap_join(sites, windows, key, width)
    return met.where((F.col("start") > F.col("r_start")) & (F.col("stop") < F.col("r_stop"))).drop("r_start", "r_stop")
