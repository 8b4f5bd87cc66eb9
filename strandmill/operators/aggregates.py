"""Aggregations over reads, molecules and similarities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.operators import positions, stats


def box_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n and the 10th, 25th, 50th, 75th and 90th percentile, linear between values; a group's values are ranked by ranges."""
    points = [0.1, 0.25, 0.5, 0.75, 0.9]
    out = stats.group_percentiles(df, keys, value, points)
    return out.select(*keys, "n", *(F.col(f"p{k}").alias(f"p{round(q * 100)}") for k, q in enumerate(points)))


def box_stats_of_counts(df: DataFrame, keys: list[str], value: str, count: str) -> DataFrame:
    """As box_stats, of different values with how often each occurs; meant for few different ones, as a group's are in one buffer."""
    points = [0.1, 0.25, 0.5, 0.75, 0.9]
    out = df.groupBy(*keys).agg(F.sum(count).alias("n"), F.percentile(value, points, F.col(count)).alias("_p"))
    return out.select(*keys, "n", *(F.col("_p")[k].alias(f"p{round(q * 100)}") for k, q in enumerate(points)))


def box_whiskers(df: DataFrame, keys: list[str], value: str, reach: float = 1.5) -> DataFrame:
    """keys, low and high: the least and greatest value within reach interquartile ranges of the box. Null keys are a group; groups
    without values have no row."""
    box = stats.group_percentiles(df, keys, value, [0.25, 0.75])
    counts = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    inside = null_safe_join(counts, box.select(*keys, "p0", "p1"), keys).where(F.col("_v").between(F.col("p0") - reach * (F.col("p1") - F.col("p0")), F.col("p1") + reach * (F.col("p1") - F.col("p0"))))
    return inside.groupBy(*keys).agg(F.min("_v").alias("low"), F.max("_v").alias("high"))


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each value of keys; tasks keep one row of each before anything is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"))
    return first.select(*keys, "_f.*").select(*df.columns)


def with_first(df: DataFrame, keys: list[str], order: list[Column], attributes: list[str]) -> DataFrame:
    """df with the attributes of the first row of its keys in place of its own."""
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*attributes), F.struct(*order)).alias("_f"))
    met = df.join(first, keys)
    return met.withColumns({a: F.col(f"_f.{a}") for a in attributes}).drop("_f")


def spans_up_to(df: DataFrame, keys: list[str], widths: list[int]) -> DataFrame:
    """keys, total and up_to_<width>: the bases of spans (start, stop), in all and before each width."""
    upto = lambda w: F.sum(F.greatest(F.lit(0), F.least(F.col("stop"), F.lit(w)) - F.col("start")))
    return df.groupBy(*keys).agg(F.sum(F.col("stop") - F.col("start")).alias("total"), *(upto(w).alias(f"up_to_{w}") for w in widths))


def median_ratio(df: DataFrame, key: str, own: Column, value: str) -> DataFrame:
    """key and ratio: the median of the rows for which own holds over that of the others; keys that lack either, or have 0 there, go."""
    sides = stats.group_percentiles(df.withColumn("_own", own), [key, "_own"], value, [0.5])
    h = sides.groupBy(key).agg(F.max(F.when(F.col("_own"), F.col("p0"))).alias("_a"), F.max(F.when(~F.col("_own"), F.col("p0"))).alias("_b"))
    return h.where("_a IS NOT NULL AND _b > 0").select(key, (F.col("_a") / F.col("_b")).alias("ratio"))


def site_list(df: DataFrame, names: str, codes: str, start: str = "start") -> DataFrame:
    """name, sites: each molecule's sites (start, bound), in the order of start, from sites whose names and footprint codes are
    comma-separated lists in parallel."""
    from strandmill.functions.sequence import bound_flags

    pairs = df.select(F.col(start).alias("start"), F.explode(F.arrays_zip(F.split(names, ",").alias("name"), bound_flags(codes).alias("bound"))).alias("m"))
    return pairs.groupBy(F.col("m.name").alias("name")).agg(F.array_sort(F.collect_list(F.struct("start", F.col("m.bound").alias("bound")))).alias("sites"))


def bound_gaps(sites: DataFrame) -> DataFrame:
    """name, gap: the distances between neighbouring bound sites of a site_list; molecules with fewer than two have none."""
    at = F.transform(F.filter("sites", lambda s: s["bound"]), lambda s: s["start"])
    rest = F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0)))
    gaps = F.zip_with(F.slice(at, 1, F.size(rest)), rest, lambda a, b: b - a)
    return sites.select("name", F.explode(gaps).alias("gap"))


def distinct_ratio(part: DataFrame, whole: DataFrame, key: str, name: str) -> DataFrame:
    """key, part_names, whole_names and ratio of the numbers of different names; 0 where a side has none, null where whole has."""
    count = lambda df, n: df.groupBy(key).agg(F.count_distinct(name).alias(n))
    both = outer_fill(count(whole, "whole_names"), count(part, "part_names"), [key])
    return both.withColumn("ratio", F.try_divide(F.col("part_names"), F.col("whole_names")))


def duplication_distances(df: DataFrame) -> DataFrame:
    """One row, in kb: means of the size of the first copy, of the distances from its end and its start to the second's start, of its start's and its
    midpoint's distance from the boundary, and of the midpoint between both copies. Rows with a missing place count where they can."""
    a, b, c = F.col("code_start_1"), F.col("code_end_1"), F.col("code_start_2")
    each = {"size": b - a, "end_to_start": c - b, "start_to_start": c - a, "start": a, "midpoint": (a + b) / 2, "between": (b + c) / 2}
    return df.agg(*((F.avg(F.nanvl(v, F.lit(None).cast("double"))) / 1000.0).alias(n) for n, v in each.items()))


def share_decrease(df: DataFrame, same: Column, value: str, cut: float) -> DataFrame:
    """One row: how many rows there are of which same holds and of which it doesn't, their percentages above cut, and by how many percent the
    second is lower."""
    own = lambda c: 100.0 * F.avg(F.when(c, (F.col(value) > cut).cast("int")))
    out = df.agg(F.count_if(same).alias("same"), F.count_if(~same).alias("other"), own(same).alias("same_pct"), own(~same).alias("other_pct"))
    return out.withColumn("decrease", 100.0 * (1 - F.try_divide(F.col("other_pct"), F.col("same_pct"))))


def ordered_names(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """name and place of the different names of df that order lists, by its order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(name)).cast("int")
    return df.select(name).distinct().withColumn("place", place).where("place > 0").orderBy("place")


def mean_sd(value: Column) -> list[Column]:
    """mean, null without values, and population sd, null unless there are two."""
    n = F.count(value)
    return [n.alias("n"), F.avg(value).alias("mean"), F.when(n > 1, F.stddev_pop(value)).alias("sd")]


def share_above(value: str, cut: float) -> Column:
    return F.avg((F.col(value) > cut).cast("int"))


def consensus(reads: DataFrame, keys: list[str], sequence: str, end: str, least: int = 5, most: int | None = None) -> DataFrame:
    """keys, n_reads, length_bp and consensus of the reads' tails, aligned at their first base.

    At each column the most frequent of A, C, G, T, in that order in ties, or - if there is none; as many columns as
    the median tail is long, rounded down, and most at most. Groups of under least reads are left out.
    """
    tails = reads.where(F.col(sequence).isNotNull() & (F.col(end) > 0) & (F.col(end) <= F.length(sequence)))
    tails = tails.select(*keys, F.right(F.col(sequence), F.col(end).cast("int")).alias("_tail"))
    lengths = tails.groupBy(*keys, F.length("_tail").alias("_length")).agg(F.count(F.lit(1)).alias("_n"))  # so the median takes each length once
    sizes = lengths.groupBy(*keys).agg(F.sum("_n").alias("n_reads"), F.floor(F.percentile("_length", 0.5, F.col("_n"))).cast("int").alias("_width")).where(F.col("n_reads") >= least)
    if most:
        sizes = sizes.withColumn("_width", F.least("_width", F.lit(most)))
    cut = tails.join(sizes, keys).select(*keys, F.substr("_tail", F.lit(1), F.col("_width")).alias("_tail"))
    base = np.frombuffer(b"ACGT-", np.uint8)

    def voted(first: int, counts: np.ndarray) -> list[pa.Array]:
        best = np.where(counts.any(axis=1), counts.argmax(axis=1), 4)  # the first of equal ones
        return [pa.array([first]), pa.array([base[best].tobytes().decode()])]

    texts = positions.folded(cut, keys, ["_tail"], positions.base_counts("_tail"), 4, voted, "_first bigint, _text string")
    joined = texts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_first", "_text"))), lambda x: x["_text"]), "").alias("_bases"))
    text = F.rpad(F.coalesce("_bases", F.lit("")), F.col("_width"), F.lit("-"))
    return sizes.join(joined, keys, "left").select(*keys, "n_reads", F.col("_width").alias("length_bp"), text.alias("consensus"))


def partner_curve(pairs: DataFrame, cuts: list[float], by: str = "assignment", sim: str = "sim", per: tuple[str, ...] = ()) -> DataFrame:
    """per, by, cutoff, n, pct: the share of labels (of by) whose best partner is at least as similar as the cut, for each value of
    by and for all ('ALL'), in each group of per (such as the length that was compared). pairs: per, by, label_i, label_j, sim;
    similarities and cuts are compared as floats."""
    ends = F.explode(F.array("label_i", "label_j")).alias("label")
    best = pairs.select(*per, by, ends, F.col(sim).cast("float").alias("sim")).groupBy(*per, by, "label").agg(F.max("sim").alias("best"))
    return best_partner_curve(best, cuts, by, per)


def best_partner_curve(best: DataFrame, cuts: list[float], by: str = "assignment", per: tuple[str, ...] = ()) -> DataFrame:
    """As partner_curve, of labels with their best similarity (per, by, label, best)."""
    passes = [F.count_if(F.col("best") >= F.lit(c).cast("float")).alias(f"c{k}") for k, c in enumerate(cuts)]
    sums = best.groupingSets([[*per, by], [*per]], *per, by).agg(F.grouping(by).alias("_all"), F.count(F.lit(1)).alias("n"), *passes)
    rows = F.explode(F.array(*(F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"c{k}").alias("hit")) for k, c in enumerate(cuts)))).alias("x")
    named = sums.where("n > 0").select(*per, F.when(F.col("_all") == 1, "ALL").otherwise(F.col(by)).alias(by), "n", rows)  # no pairs, no rows
    return named.select(*per, by, "x.cutoff", "n", (100.0 * F.col("x.hit") / F.col("n")).alias("pct"))


def bound_fraction(df: DataFrame, keys: list[str], names: str, codes: str) -> DataFrame:
    """keys, n_molecules, fraction of molecules bound at any site; names and codes are comma-separated lists in parallel."""
    from strandmill.functions.sequence import bound_flags

    pairs = df.select(*keys, F.explode(F.arrays_zip(F.split(names, ",").alias("name"), bound_flags(codes).alias("bound"))).alias("m"))
    each = pairs.groupBy(*keys, F.col("m.name").alias("name")).agg(F.bool_or("m.bound").alias("bound"))
    return each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_molecules"), F.avg(F.col("bound").cast("int")).alias("fraction"))


def paired_loads(left: DataFrame, right: DataFrame, keys: list[str], value: str, least_left: int, least_right: int) -> DataFrame:
    """Mean values of the groups with enough reads on both sides: keys, left_mean, right_mean."""
    def means(df: DataFrame, name: str, least: int) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias(name)).where(F.col("_n") >= least).drop("_n")

    return means(left, "left_mean", least_left).join(means(right, "right_mean", least_right), keys)


def dominant(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    """Rows whose category is the most frequent of their keys, the least of equally frequent ones."""
    counts = df.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.groupBy(*keys).agg(F.min_by(category, F.struct(-F.col("_n"), category)).alias(category))
    return df.join(top, [*keys, category], "left_semi")


def fill_bins(counts: DataFrame, key: str, bin_col: str, bins: int, value: str) -> DataFrame:
    """A row for every key and bin from 0 to bins - 1, absent ones with 0."""
    every = counts.select(key).distinct().withColumn(bin_col, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    return every.join(counts, [key, bin_col], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def outer_fill(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join where absent numbers are 0."""
    return left.join(right, keys, "full_outer").na.fill(0)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left and right joined on keys where null matches null, as pandas merges do; each key comes once, also of rows of right alone."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    met = left.join(named, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys], how)
    if how in ("left_semi", "left_anti"):
        return met
    return met.withColumns({k: F.coalesce(k, f"_right_{k}") for k in keys}).drop(*(f"_right_{k}" for k in keys))


def top_and_other(df: DataFrame, group: str, item: str, count: str, k: int, other: str = "OTHER", normalise: bool = False) -> DataFrame:
    """Counts of the k items with most in all, ties by name, and of the others together, in each group; normalised, as shares of the group.

    The table is counted once by group and item; what else is asked for comes from these counts.
    """
    counts = df.groupBy(item, group).agg(F.sum(count).alias(count))
    whole = counts.groupBy(item).agg(F.sum(count).alias("_n"), F.collect_list(F.struct(group, count)).alias("_groups"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(F.desc("_n"), item))
    part = whole.withColumn("_p", F.pmod(F.xxhash64(item), F.lit(64))).withColumn("_k", place)
    # k of each part are enough to find the k of all
    among = F.row_number().over(Window.partitionBy(F.col("_k") <= k, F.when(F.col("_k") <= k, F.lit(0)).otherwise(F.col("_p"))).orderBy(F.desc("_n"), item))
    named = part.withColumn(item, F.when((F.col("_k") <= k) & (among <= k), F.col(item)).otherwise(other))
    each = named.select(item, F.explode("_groups").alias("_g")).groupBy(F.col(f"_g.{group}").alias(group), item).agg(F.sum(f"_g.{count}").alias(count))
    return each.withColumn(count, F.col(count) / F.sum(count).over(Window.partitionBy(group))) if normalise else each


def composition_trace(spans: DataFrame, reads: DataFrame, keys: list[str], min_cov: int = 5, min_len: int = 1000) -> DataFrame:
    """pos, value: at each position, the share of reads that a span covers, averaged over keys.

    reads: keys, length; spans: keys, start, stop. Positions need more than min_cov reads, and keys more than min_len such
    positions.
    """
    own = [reads.select(*keys, F.lit("den").alias("_kind"), F.lit(0).cast("long").alias("start"), F.col("length").cast("long").alias("stop")), spans.select(*keys, F.lit("num").alias("_kind"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))]

    def shares(first: int, counts: np.ndarray) -> list[pa.Array]:
        at = np.flatnonzero(counts[:, 0] > min_cov)
        return [pa.array(first + at), pa.array(counts[at, 0]), pa.array(counts[at, 1])]

    steps = positions.coverage(keys, "start", "stop", "_kind", ["den", "num"])
    full = positions.folded(own[0].unionByName(own[1]).where("stop > start"), keys, ["_kind", "start", "stop"], steps, 2, shares, "pos bigint, den bigint, num bigint")
    full = full.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("_n") > min_len)
    return full.groupBy("pos").agg(F.avg(F.col("num") / F.col("den")).alias("value"), F.count(F.lit(1)).alias("n"))


def rolling_ratio(df: DataFrame, keys: list[str], pos: str, num: str, den: str, window: int) -> DataFrame:
    """Ratio of the sums of num and den over a centred window of positions; null where den sums to 0."""
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(-(window // 2), window - window // 2 - 1)
    return df.select(*keys, pos, F.try_divide(F.sum(num).over(w), F.sum(den).over(w)).alias("ratio"))


def best_kmer_coverage(spans: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """key, coverage: for each row the most that one k-mer's places cover of the text, in percent; 0 for texts under k letters.

    A text's k-mers are sorted and counted within its row, so no row is made for a k-mer.
    """
    from strandmill.functions import sequence

    places = F.sort_array(F.filter(F.transform(sequence.kmers(text, k), lambda w, i: F.struct(w.alias("kmer"), i.alias("at"))), lambda x: sequence.plain(x["kmer"])))
    none = F.struct(F.lit("").alias("kmer"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("own"), F.lit(0).cast("long").alias("most"))

    def add(a: Column, x: Column) -> Column:
        more = F.when(a["kmer"] == x["kmer"], a["own"] + F.least(F.lit(k), x["at"] - a["at"])).otherwise(k).cast("long")
        return F.struct(x["kmer"].alias("kmer"), x["at"].alias("at"), more.alias("own"), F.greatest(a["most"], more).alias("most"))

    best = F.aggregate(places, none, add, lambda a: a["most"])
    return spans.select(key, F.when(F.length(text) >= k, 100.0 * best / F.length(text)).otherwise(0.0).alias("coverage"))


def boxcar(df: DataFrame, keys: list[str], pos: str, value: str, width: int) -> DataFrame:
    """keys, pos, value: the moving average over width places, with zeros past the ends."""
    around = Window.partitionBy(*keys).orderBy(pos).rowsBetween(-(width // 2), (width - 1) // 2)
    return df.select(*keys, pos, (F.sum(value).over(around) / F.lit(float(width))).alias(value))
