"""URL filters by a temporal list join.

Dated entries of a blocklist, each adding or removing a host or domain, become intervals in which a pattern is
listed. A capture is looked up by its host and all its parent domains, and each list is evaluated as of the time at which
the capture was fetched. There is one row of intervals for each pattern, so the join brings no capture
more rows than its host has parents, however long a pattern's history or however many captures a host has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.shared import keep, skew_join

DAYS = 366


def intervals(entries: DataFrame) -> DataFrame:
    """pattern and its spans, an array of (category, begin, until), of entries (pattern, category, action, at).

    An 'add' lists the pattern from its time on, until the next entry of the same pattern and category; entries of the
    same time count in the order of their action, so a 'remove' wins. Patterns that differ in case, in a last dot or in brackets
    alone are one. Entries with a null field are not used, nor are empty patterns.
    """
    known = entries.dropna(subset=["pattern", "category", "action", "at"]).withColumn("pattern", plain_host(F.col("pattern"))).where("pattern <> ''")
    later = Window.partitionBy("pattern", "category").orderBy("at", "action")
    known = known.distinct().withColumn("until", F.lead("at").over(later)).where("action = 'add' AND (until IS NULL OR until > at)")
    return known.groupBy("pattern").agg(F.sort_array(F.collect_set(F.struct("category", F.col("at").alias("begin"), "until"))).alias("spans"))


def plain_host(host: Column) -> Column:
    """A host lower-cased, without the brackets of an IPv6 address and without a last dot."""
    return F.regexp_replace(F.lower(host), r"^\[|\]$|\.$", "")


def host_of(url: Column) -> Column:
    """The plain host of a URL, or null."""
    host = plain_host(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#\]]*\]|[^/?#:]+)", 1))
    return F.when(F.length(host) > 0, host)


def patterns_of(host: Column) -> Column:
    """The host and its parent domains down to two labels, an array; of an IP address only itself."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    return F.when(host.rlike(r"^[0-9]+(\.[0-9]+){3}$|:"), F.array(host)).otherwise(parents)


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row for each row of captures (page_id, url, fetched): page_id, url, host, fetched, blocked, pattern, category.

    pattern is the longest that is listed at the time of the fetch, category its first by name. A null or unreadable url,
    or a null time, is never blocked. Repeated captures are rows like others. An IP address has no parents.
    """
    rows = captures.select("page_id", "url", "fetched", host_of(F.col("url")).alias("host"))
    rows = keep(rows.withColumn("uid", F.monotonically_increasing_id()), "captures")
    asked = rows.where("host IS NOT NULL AND fetched IS NOT NULL").select("uid", "fetched", F.explode(patterns_of(F.col("host"))).alias("pattern"))
    sizes = keep(asked.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "url-patterns")
    listed = keep(intervals(entries).join(sizes, "pattern"), "url-lists")
    met = skew_join(asked, listed, "pattern", "n", max(sizes.agg(F.sum("n")).first()[0] or 0, 1))
    active = F.filter("spans", lambda s: (s["begin"] <= F.col("fetched")) & (s["until"].isNull() | (s["until"] > F.col("fetched"))))
    met = met.withColumn("active", active).where(F.size("active") > 0)
    best = met.groupBy("uid").agg(F.max(F.struct(F.length("pattern").alias("size"), "pattern", F.col("active")[0]["category"].alias("category"))).alias("m"))
    out = rows.join(best, "uid", "left")
    return out.select("page_id", "url", "host", "fetched", F.col("m").isNotNull().alias("blocked"), F.col("m.pattern").alias("pattern"), F.col("m.category").alias("category"))


def _digit(h: str, k: int) -> str:
    return f"(instr('0123456789abcdef', substr({h}, {k}, 1)) - 1)"


#: pages has neither a time of fetch nor a list: captures are dated by page_id, and the list is made of the hosts and
#: domains that occur, by the digits of their MD5: a quarter is listed, from a day in the first part of the year, taken off
#: after some weeks, and in half of these put on again.
_FETCHED = f"CAST(page_id % {DAYS} AS INT)"
_HASH = "md5(pattern)"
_FIRST = f"CAST(16 * {_digit(_HASH, 2)} + {_digit(_HASH, 3)} AS INT)"
_WEEKS = f"CAST(7 * (1 + {_digit(_HASH, 4)}) AS INT)"
_CATEGORY = f"CASE WHEN {_digit(_HASH, 5)} < 8 THEN 'ads' ELSE 'malware' END"


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captures = pages.select("page_id", "url", F.expr(_FETCHED).alias("fetched"))
    host = host_of(F.col("url"))
    patterns = pages.where(host.isNotNull()).select(F.explode(patterns_of(host)).alias("pattern")).distinct()
    listed = patterns.where(F.expr(f"{_digit(_HASH, 1)} < 4")).withColumns({"category": F.expr(_CATEGORY), "day": F.expr(_FIRST), "weeks": F.expr(_WEEKS), "again": F.expr(f"{_digit(_HASH, 6)} < 8")})
    adds = listed.select("pattern", "category", F.lit("add").alias("action"), F.col("day").alias("at"))
    off = listed.select("pattern", "category", F.lit("remove").alias("action"), (F.col("day") + F.col("weeks")).alias("at"))
    back = listed.where("again").select("pattern", "category", F.lit("add").alias("action"), (F.col("day") + 2 * F.col("weeks")).alias("at"))
    return filter_captures(captures, adds.unionByName(off).unionByName(back))


SQL = f"""
WITH c AS (SELECT page_id, url, {_FETCHED} AS fetched, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^/?#\\]]*\\]|[^/?#:]+)', 1), '^\\[|\\]$|\\.$', '', 'g'), '') AS host FROM pages),
l AS (SELECT *, CASE WHEN regexp_matches(host, '^[0-9]+(\\.[0-9]+){{3}}$|:') THEN [host] ELSE string_split(host, '.') END AS labels FROM c WHERE host IS NOT NULL),
a AS (SELECT page_id, fetched, array_to_string(labels[k:], '.') AS pattern
      FROM (SELECT *, unnest(range(1, greatest(len(labels) - 1, 1) + 1)) AS k FROM l)),
p AS (SELECT DISTINCT pattern FROM a),
d AS (SELECT pattern, {_CATEGORY} AS category, {_FIRST} AS day, {_WEEKS} AS weeks, {_digit(_HASH, 6)} < 8 AS again FROM p WHERE {_digit(_HASH, 1)} < 4),
s AS (SELECT pattern, category, day AS b, day + weeks AS u FROM d UNION ALL SELECT pattern, category, day + 2 * weeks, NULL FROM d WHERE again),
m AS (SELECT a.page_id, a.pattern, s.category, row_number() OVER (PARTITION BY a.page_id ORDER BY length(a.pattern) DESC, a.pattern DESC, s.category) AS r
      FROM a JOIN s ON a.pattern = s.pattern AND s.b <= a.fetched AND (s.u IS NULL OR s.u > a.fetched))
SELECT c.page_id, c.url, c.host, c.fetched, m.pattern IS NOT NULL AS blocked, m.pattern, m.category
FROM c LEFT JOIN m ON c.page_id = m.page_id AND m.r = 1
"""
