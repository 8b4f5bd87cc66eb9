"""Rank tests and related statistics. Ranks and sums are made by Spark; only the sums go on to the p-value."""

from __future__ import annotations

import functools
import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


EXACT_U, EXACT_W = 8, 50
RANGES = 16  # squared, the ranges that a table's values are dealt into


def average_ranks(df: DataFrame, by: list[str], value: str, name: str = "rank") -> DataFrame:
    """df with the rank of value within by, the mean of their ranks for ties.

    Ranks come from the counts of distinct values, so rows aren't ordered and a repeated value is one row. Rows whose value or by is
    null go.
    """
    known = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, value]))
    counts = known.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = _below(counts, by, value, {"_lower": F.col("_n")})
    return known.join(ranked.select(*by, value, (F.col("_lower") + (F.col("_n") + 1) / 2.0).alias(name)), [*by, value])


#: Coefficients of the Chebyshev fit of the complementary error function; its relative error is under 1.2e-7 everywhere.
_ERFC = [0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223]


def normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution for z of at least 0, with a relative error under 1.2e-7 however far out."""
    x = z / math.sqrt(2)
    t = 1 / (1 + x / 2)
    poly = F.lit(_ERFC[0])
    for c in _ERFC[1:]:
        poly = poly * t + c
    return 0.5 * t * F.exp(poly - x * x)


@functools.cache
def _numerator(n: int) -> tuple[int, list[int]]:
    """period and c of 1 / ((1 - q) (1 - q) (1 - q^2) ... (1 - q^n)) = c(q) / (1 - q^period)^(n + 1), with whole numbers."""
    period, c = math.lcm(*range(1, n + 1)), [1]
    for k in (1, *range(1, n + 1)):  # times (1 - q^period) / (1 - q^k): sums along each residue class of k
        top = c + [0] * period
        for i, x in enumerate(c):
            top[period + i] -= x
        for i in range(k, len(top)):
            top[i] += top[i - k]
        c = top[: len(c) + period - k]
    return period, c


def _at_most(n: int, m: int) -> int:
    """How many partitions into at most n parts the numbers 0 to m have; exact, in as many steps as n for any m."""
    if m < 0:
        return 0
    period, c = _numerator(n)
    return sum(c[j] * math.comb((m - j) // period + n, n) for j in range(m % period, min(m, len(c) - 1) + 1, period))


def u_at_most(n1: int, n2: int, u: int) -> int:
    """In how many orders of n1 and n2 different values U is at most u; n1, the smaller number, is small, n2 may be any."""
    terms = {0: 1}  # (1 - q^(n2 + 1)) ... (1 - q^(n2 + n1))
    for k in range(1, n1 + 1):
        for shift, x in list(terms.items()):
            terms[shift + n2 + k] = terms.get(shift + n2 + k, 0) - x
    return sum(x * _at_most(n1, u - shift) for shift, x in terms.items())


@functools.lru_cache(maxsize=4096)
def w_counts(n: int) -> np.ndarray:
    """In how many of the 2 ** n choices of signs the ranks with a plus sum to 0, 1, ..., n (n + 1) / 2."""
    counts = np.ones(1)
    for k in range(1, n + 1):
        counts = np.concatenate((counts, np.zeros(k))) + np.concatenate((np.zeros(k), counts))
    return counts


@F.pandas_udf(T.DoubleType())
def exact_u(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
    """Two-sided p of U without ties: twice the share of orders in which it is at least the larger of U and n1 n2 - U."""
    def one(a: float, b: float, x: float) -> float:
        a, b = int(min(a, b)), int(max(a, b))
        u = int(round(min(x, a * b - x)))
        return float(min(1, Fraction(2 * u_at_most(a, b, u), math.comb(a + b, a))))

    return pd.Series([None if pd.isna(x) else one(a, b, x) for a, b, x in zip(n1, n2, u)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def exact_w(n: pd.Series, w: pd.Series) -> pd.Series:
    """Two-sided p of the smaller rank sum w of n different differences."""
    def one(k: int, x: float) -> float:
        counts = w_counts(k)
        return min(1.0, 2 * float(counts[: int(math.floor(x)) + 1].sum() / counts.sum()))

    return pd.Series([None if pd.isna(x) else one(int(k), x) for k, x in zip(n, w)], dtype="float64")


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 1000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d)
            c = 1 + step / c
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


@F.pandas_udf(T.DoubleType())
def correlation_p(n: pd.Series, r: pd.Series) -> pd.Series:
    """Two-sided p of a correlation of n pairs, by the t distribution with n - 2 degrees of freedom; null for under three pairs."""
    return pd.Series([None if k < 3 or pd.isna(x) else beta_share((k - 2) / 2, 0.5, max(0.0, 1 - x * x)) for k, x in zip(n, r)], dtype="float64")


def _below(counts: DataFrame, by: list[str], value: str, sums: dict[str, Column], then: tuple[str, ...] = ()) -> DataFrame:
    """counts (by, value, one row for each value) with the sums over the lesser values of by, and those over all of by as <name>_all.

    The values of the table are dealt into ranges at approximate percentiles, which only decide what goes to which task: whatever share of
    the table a group has, a task has one range of it at most. Sums run within a group's range, from those of its ranges before. value is
    a number or a time; equal values are ordered by then. Nulls in by are a group, a null value comes first.
    """
    steps, ahead = RANGES * RANGES, (Window.unboundedPreceding, -1)
    cuts = counts.agg(F.array_sort(F.percentile_approx(value, [k / steps for k in range(1, steps)])).alias("_cuts"))
    cuts = cuts.select("_cuts", F.filter("_cuts", lambda _, i: i % RANGES == RANGES - 1).alias("_coarse"))  # one row
    up_to = lambda some: F.size(F.filter(some, lambda c: c <= F.col(value)))
    place = up_to(F.col("_coarse")) * RANGES
    place = place + up_to(F.slice("_cuts", place + 1, RANGES - 1))
    # as a struct, a group without a key meets itself in the join
    cell = F.struct(*by, F.coalesce(place, F.lit(0)).alias("_range"))
    ranged = counts.join(F.broadcast(cuts)).withColumn("_cell", cell).drop("_cuts", "_coarse")
    group = [F.col("_cell")[c] for c in by] or [F.lit(0)]  # a row for each range, RANGES squared at most
    before, every = Window.partitionBy(*group).orderBy("_cell._range").rowsBetween(*ahead), Window.partitionBy(*group)
    whole = ranged.groupBy("_cell").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    carried = [x for n in sums for x in (F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}"), F.sum(f"_{n}").over(every).alias(f"{n}_all"))]
    order = Window.partitionBy("_cell").orderBy(value, *then).rowsBetween(*ahead)
    inside = ranged.withColumns({n: F.coalesce(F.sum(c).over(order), F.lit(0)) for n, c in sums.items()})
    return inside.join(whole.select("_cell", *carried), "_cell").withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_cell", *(f"_{n}" for n in sums))


def mann_whitney(df: DataFrame, by: list[str], group: str, value: str, first: str, second: str, count: str | None = None) -> DataFrame:
    """by, n1, n2, u1, z, p_value of value in the groups first and second: two-sided. The p-value is exact where a group has up to
    EXACT_U values and none is repeated, else by the normal approximation with ties and continuity corrected. With
    count, a row stands for so many."""
    number = F.col(count) if count else F.lit(1)
    rows = df.where(F.col(group).isin(first, second) & F.col(value).isNotNull())
    own = lambda g: F.sum(F.when(F.col(group) == g, number).otherwise(0))
    counts = rows.groupBy(*by, value).agg(own(first).cast("long").alias("a"), own(second).cast("long").alias("b"))
    t = F.col("a") + F.col("b")
    ranked = _below(counts, by, value, {"_lower": t}).withColumn("rank", F.col("_lower") + (t + 1) / 2.0)
    tt = t.cast("double")
    sums = ranked.groupBy(*by).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum(tt * tt * tt - tt).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    sums = sums.withColumn("u1", F.col("r1") - n1 * (n1 + 1) / 2)
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    sums = sums.withColumn("z", F.try_divide(F.greatest(F.col("u1"), n1 * n2 - F.col("u1")) - n1 * n2 / 2 - 0.5, sd))
    approximate = F.least(F.lit(1.0), 2 * F.when(F.col("z") >= 0, normal_tail(F.col("z"))).otherwise(1 - normal_tail(-F.col("z"))))
    small = (F.least("n1", "n2") <= EXACT_U) & (F.least("n1", "n2") > 0) & (F.col("ties") == 0)
    exact = exact_u(F.when(small, n1).otherwise(1.0), F.when(small, n2).otherwise(1.0), F.when(small, F.col("u1")))
    return sums.select(*by, "n1", "n2", "u1", "z", F.when(small, exact).otherwise(approximate).alias("p_value"))


def pairwise_tests(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mann-Whitney tests of all pairs of groups: group_1 < group_2 and the columns of mann_whitney. Each value meets the counts of
    the other groups at the same place in the order, not their rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    names = counts.select(group).distinct()
    pairs = names.select(F.col(group).alias("group_1")).join(names.select(F.col(group).alias("group_2")), F.col("group_1") < F.col("group_2"))
    first = pairs.withColumn(group, F.col("group_1")).join(counts, group).withColumn("side", F.lit("first"))
    second = pairs.withColumn(group, F.col("group_2")).join(counts, group).withColumn("side", F.lit("second"))
    both = first.unionByName(second)
    return mann_whitney(both, ["group_1", "group_2"], "side", value, "first", "second", "n")


def wilcoxon(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, n, w_plus, w_minus, w, p_value of paired differences; zero differences are left out, ties share their mean rank.

    The two-sided p-value is exact for up to EXACT_W differences of which none is repeated, else by the normal approximation with ties
    corrected.
    """
    d = df.withColumn("_d", F.col(x) - F.col(y)).where("_d <> 0").withColumn("_a", F.abs("_d"))
    counts = d.groupBy(*by, "_a").agg(F.count_if(F.col("_d") > 0).alias("up"), F.count_if(F.col("_d") < 0).alias("down"))
    t = F.col("up") + F.col("down")
    tt = t.cast("double")
    ranked = _below(counts, by, "_a", {"_lower": t}).withColumn("_r", F.col("_lower") + (t + 1) / 2.0)
    sums = ranked.groupBy(*by).agg(F.sum(t).alias("n"), F.sum(F.col("up") * F.col("_r")).alias("w_plus"), F.sum(F.col("down") * F.col("_r")).alias("w_minus"), F.sum(tt * tt * tt - tt).alias("_ties"))
    sums = sums.withColumn("w", F.least("w_plus", "w_minus"))
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    z = F.abs(F.try_divide(F.col("w") - n * (n + 1) / 4, sd))
    small = (F.col("n") <= EXACT_W) & (F.col("_ties") == 0)
    exact = exact_w(F.when(small, n).otherwise(1.0), F.when(small, F.col("w")))
    return sums.select(*by, "n", "w_plus", "w_minus", "w", F.when(small, exact).otherwise(F.least(F.lit(1.0), 2 * normal_tail(z))).alias("p_value"))


def pearson(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, n, r, p_value (two-sided) of the pairs of which neither is null; r and p are null where x or y has one value only."""
    sides = F.stddev_pop(x) * F.stddev_pop(y)  # F.corr fails where it is 0
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.covar_pop(x, y), sides)))
    found = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), r).alias("r"))
    return found.withColumn("p_value", correlation_p("n", "r"))


def mean_difference(df: DataFrame, group: str, value: str, first: str, second: str) -> DataFrame:
    """One row: first_mean, second_mean and difference, the first less the second."""
    own = lambda g: F.avg(F.when(F.col(group) == g, F.col(value)))
    return df.agg(own(first).alias("first_mean"), own(second).alias("second_mean"), (own(first) - own(second)).alias("difference"))


def group_percentiles(df: DataFrame, by: list[str], value: str, points: list[float]) -> DataFrame:
    """by, n, mean, p0, p1, ...: how many values each group has, their mean and their percentiles, linear between values.

    Different values are counted and ranked by ranges, and the two about each percentile are picked by their ranks: neither one task nor
    one buffer has all values of a group. Nulls don't count; a group of nulls alone has n of 0 and nulls.
    """
    counts = df.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(value).alias("_c"))
    ranked = _below(counts, by, "_v", {"_lower": F.col("_c")})
    picks = []
    for k, q in enumerate(points):
        place = (F.col("_lower_all") - 1) * F.lit(float(q))
        for name, rank in ((f"_low{k}", F.floor(place)), (f"_high{k}", F.ceil(place))):
            picks.append(F.max(F.when((F.col("_lower") <= rank) & (rank < F.col("_lower") + F.col("_c")), F.col("_v"))).alias(name))
    found = ranked.groupBy(*by).agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n"), F.sum(F.when(F.col("_c") > 0, F.col("_v") * F.col("_c"))).alias("_sum"), *picks)

    def between(k: int, q: float) -> Column:
        place, low, high = (F.col("n") - 1) * F.lit(float(q)), F.col(f"_low{k}"), F.col(f"_high{k}")
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return found.select(*by, "n", F.try_divide("_sum", "n").alias("mean"), *(between(k, q).alias(f"p{k}") for k, q in enumerate(points)))


def exact_percentiles(df: DataFrame, value: str, points: list[float]) -> DataFrame:
    """One row, p0, p1, ...: percentiles of a column, linear between values, without all values in one task."""
    return group_percentiles(df, [], value, points).select(*(f"p{k}" for k in range(len(points))))


def outer_means(df: DataFrame, gate: str, value: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Mean of value where gate is at most its low percentile, and where at least its high one; both ends count."""
    cuts = exact_percentiles(df, gate, [low, high]).select(F.col("p0").alias("_low"), F.col("p1").alias("_high"))
    both = df.join(F.broadcast(cuts))  # one row
    side = F.when(F.col(gate) <= F.col("_low"), "low").when(F.col(gate) >= F.col("_high"), "high")
    return both.withColumn("side", side).where("side IS NOT NULL").groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def sample_per_group(df: DataFrame, by: list[str], n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows of each group, all if there are fewer: those whose key has the least hash with the seed, so the same ones however the
    rows are partitioned. Tasks keep n rows of a group each before anything is shuffled."""
    least = df.withColumn("_r", F.struct(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(seed))).alias("h"), key))
    part = least.withColumn("_p", F.pmod(F.xxhash64(key), F.lit(64)))
    first = F.row_number().over(Window.partitionBy(*by, "_p").orderBy("_r"))
    few = part.withColumn("_k", first).where(F.col("_k") <= n)
    return few.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("_r"))).where(F.col("_k") <= n).drop("_r", "_k", "_p")


def sample_with_replacement(df: DataFrame, by: list[str], n: int, key: str, seed: int = 0) -> DataFrame:
    """n draws from each group, a row may come several times, with draw from 0 to n - 1. Drawn places depend on the seed alone, so
    the same rows come however they are partitioned; key orders the rows of a group, by its hash first unless it is a number or a time.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    draw = sizes.select(*by, "_n", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    digits = F.conv(F.substr(F.md5(F.concat_ws("-", *by, F.col("draw"), F.lit(seed))), F.lit(1), F.lit(8)), 16, 10).cast("long")
    places = draw.withColumn("_place", F.pmod(digits, F.col("_n")))
    ordered = isinstance(df.schema[key].dataType, (T.NumericType, T.DateType, T.TimestampType))
    rows = df.withColumn("_order", F.col(key) if ordered else F.xxhash64(key))
    ranked = _below(rows, by, "_order", {"_place": F.lit(1)}, (key,))
    return ranked.join(places.drop("_n"), [*by, "_place"]).drop("_place", "_place_all", "_order")
