"""Queries over distributions: histograms, cumulative curves, tests, relational idioms."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions import identity
from strandmill.operators import aggregates, histograms, stats
from strandmill.plans.derived import ctes, relation, table
from strandmill.plans.register import registry
from strandmill.sources import readers

QUERIES, ORACLES, query = registry()
_BOX = ", ".join(f"round(quantile_cont({{v}}, {q}), 6) AS p{round(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9))


@query(f"""WITH {ctes('loads')}, b AS (SELECT tech, CAST(least(floor((load - 0) / 10000), 29) AS BIGINT) AS bin, count(*) AS n FROM loads WHERE load BETWEEN 0 AND 300000 GROUP BY 1, 2)
SELECT tech, bin, n, round(n / (sum(n) OVER (PARTITION BY tech) * 10000.0) * 1e6, 6) AS density FROM b""")
def load_histogram(spark, sf):
    out = histograms.histogram(relation(spark, sf, "loads"), ["tech"], "load", 0.0, 300_000.0, 30)
    return out.select("tech", "bin", "n", F.round(F.col("density") * 1e6, 6).alias("density"))


_CDF = """
b AS (SELECT sample, status, CAST(least(floor(load / 3000), 99) AS BIGINT) AS bin, count(*) AS n FROM loads WHERE load BETWEEN 0 AND 300000 GROUP BY 1, 2, 3),
e AS (SELECT sample, status, unnest(range(0, 100)) AS bin FROM (SELECT DISTINCT sample, status FROM b)),
f AS (SELECT e.sample, e.status, e.bin, (e.bin + 1) * 3000.0 AS edge, coalesce(n, 0) AS n FROM e LEFT JOIN b ON e.sample = b.sample AND e.status = b.status AND e.bin = b.bin),
c AS (SELECT *, sum(n) OVER (PARTITION BY sample, status ORDER BY bin) / sum(n) OVER (PARTITION BY sample, status) AS cdf FROM f),
m AS (SELECT status, bin, edge, avg(cdf) AS cdf FROM c GROUP BY 1, 2, 3)"""


@query(f"WITH {ctes('loads')}, {_CDF} SELECT status, CAST(bin AS BIGINT) AS bin, CAST(edge AS DOUBLE) AS edge, round(cdf, 6) AS cdf FROM m")
def cdf_by_group(spark, sf):
    curves = histograms.cumulative(relation(spark, sf, "loads"), ["sample", "status"], "load", 0.0, 300_000.0, 100)
    return histograms.mean_curve(curves, ["status"]).select("status", "bin", "edge", F.round("cdf", 6).alias("cdf"))


@query(f"""WITH {ctes('loads')}, {_CDF}, s AS (SELECT status, edge, cdf, lag(cdf) OVER w AS c0, lag(edge) OVER w AS e0 FROM m WINDOW w AS (PARTITION BY status ORDER BY edge))
SELECT status, round(CASE WHEN c0 IS NULL OR cdf = c0 THEN edge ELSE e0 + (0.5 - c0) / (cdf - c0) * (edge - e0) END, 4) AS x FROM s WHERE cdf >= 0.5 QUALIFY row_number() OVER (PARTITION BY status ORDER BY edge) = 1""")
def curve_n50(spark, sf):
    curves = histograms.cumulative(relation(spark, sf, "loads"), ["sample", "status"], "load", 0.0, 300_000.0, 100)
    return histograms.curve_quantile(histograms.mean_curve(curves, ["status"]), ["status"]).select("status", F.round("x", 4).alias("x"))


@query("SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS bin_x, CAST(floor(l_extendedprice / 10000) AS BIGINT) AS bin_y, count(*) AS n FROM lineitem GROUP BY 1, 2")
def histogram_2d(spark, sf):
    return histograms.histogram_2d(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 5, 10_000)


@query(f"WITH {ctes('loads')} SELECT assignment, count(load) AS n, {_BOX.format(v='load')} FROM loads GROUP BY 1")
def box_statistics(spark, sf):
    out = aggregates.box_stats(relation(spark, sf, "loads"), ["assignment"], "load")
    return out.select("assignment", "n", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


_WINS = """
x AS (SELECT assignment, load, tech FROM loads),
r AS (SELECT assignment, tech, load, rank() OVER (PARTITION BY assignment ORDER BY load) + (count(*) OVER (PARTITION BY assignment, load) - 1) / 2.0 AS r FROM x)"""


@query(f"""WITH {ctes('loads')}, {_WINS}
SELECT assignment, CAST(count_if(tech = 'ONT') AS BIGINT) AS n1, CAST(count_if(tech = 'PacBio') AS BIGINT) AS n2, round(sum(CASE WHEN tech = 'ONT' THEN r ELSE 0 END) - count_if(tech = 'ONT') * (count_if(tech = 'ONT') + 1) / 2.0, 4) AS u1 FROM r GROUP BY 1""")
def mann_whitney_u(spark, sf):
    out = stats.mann_whitney(relation(spark, sf, "loads"), ["assignment"], "tech", "load", "ONT", "PacBio")
    return out.select("assignment", "n1", "n2", F.round("u1", 4).alias("u1"))


def _tail(z: str) -> str:
    """SQL: the upper tail of the normal distribution."""
    t = f"(1 / (1 + {z} / sqrt(2) / 2))"
    poly = str(stats._ERFC[0])
    for c in stats._ERFC[1:]:
        poly = f"({poly} * {t} + {c})"
    return f"0.5 * {t} * exp({poly} - {z} * {z} / 2)"


@query(f"""WITH {ctes('loads')}, {_WINS}, g AS (SELECT assignment, CAST(count_if(tech = 'ONT') AS DOUBLE) AS n1, CAST(count_if(tech = 'PacBio') AS DOUBLE) AS n2, sum(CASE WHEN tech = 'ONT' THEN r ELSE 0 END) AS r1 FROM r GROUP BY 1),
t AS (SELECT assignment, sum(c * c * c - c) AS ties FROM (SELECT assignment, CAST(count(*) AS DOUBLE) AS c FROM loads GROUP BY assignment, load) GROUP BY 1),
u AS (SELECT g.*, ties, r1 - n1 * (n1 + 1) / 2 AS u1, n1 + n2 AS n FROM g JOIN t ON g.assignment = t.assignment WHERE least(n1, n2) > {stats.EXACT_U}),
z AS (SELECT assignment, (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / nullif(sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))), 0) AS z FROM u)
SELECT assignment, round(z, 6) AS z, round(least(1, 2 * CASE WHEN z >= 0 THEN {_tail('z')} ELSE 1 - {_tail('(-z)')} END), 6) AS p_value FROM z""")
def mann_whitney_p(spark, sf):
    out = stats.mann_whitney(relation(spark, sf, "loads"), ["assignment"], "tech", "load", "ONT", "PacBio")
    return out.where(F.least("n1", "n2") > stats.EXACT_U).select("assignment", F.round("z", 6).alias("z"), F.round("p_value", 6).alias("p_value"))


@query(f"""WITH {ctes('loads')}, s AS (SELECT status, load FROM loads), n AS (SELECT status, count(*) AS n FROM s GROUP BY 1),
r AS (SELECT a.status AS group_1, b.status AS group_2, s.status, load, rank() OVER (PARTITION BY a.status, b.status ORDER BY load) + (count(*) OVER (PARTITION BY a.status, b.status, load) - 1) / 2.0 AS r FROM n a JOIN n b ON a.status < b.status JOIN s ON s.status IN (a.status, b.status))
SELECT group_1, group_2, CAST(count_if(status = group_1) AS BIGINT) AS n1, CAST(count_if(status = group_2) AS BIGINT) AS n2, round(sum(CASE WHEN status = group_1 THEN r ELSE 0 END) - count_if(status = group_1) * (count_if(status = group_1) + 1) / 2.0, 2) AS u1 FROM r GROUP BY 1, 2""")
def pairwise_group_tests(spark, sf):
    out = stats.pairwise_tests(relation(spark, sf, "loads"), "status", "load")
    return out.select("group_1", "group_2", "n1", "n2", F.round("u1", 2).alias("u1"))


@query("""WITH d AS (SELECT l_returnflag, l_quantity - l_linenumber * 8 AS d FROM lineitem WHERE l_quantity <> l_linenumber * 8),
r AS (SELECT l_returnflag, d, rank() OVER (PARTITION BY l_returnflag ORDER BY abs(d)) + (count(*) OVER (PARTITION BY l_returnflag, abs(d)) - 1) / 2.0 AS r FROM d)
SELECT l_returnflag, count(*) AS n, CAST(sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS DOUBLE) AS w_plus, CAST(sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS DOUBLE) AS w_minus FROM r GROUP BY 1""")
def wilcoxon_w(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("other", F.col("l_linenumber") * 8)
    return stats.wilcoxon(rows, ["l_returnflag"], "l_quantity", "other").select("l_returnflag", "n", "w_plus", "w_minus")


@query(f"""WITH {ctes('loads')}, s AS (SELECT status, load FROM loads), n AS (SELECT status, count(*) AS n FROM s GROUP BY 1),
x AS (SELECT a.status AS group_1, b.status AS group_2, s.status, load FROM n a JOIN n b ON a.status < b.status JOIN s ON s.status IN (a.status, b.status)),
r AS (SELECT *, rank() OVER (PARTITION BY group_1, group_2 ORDER BY load) + (count(*) OVER (PARTITION BY group_1, group_2, load) - 1) / 2.0 AS r FROM x),
t AS (SELECT group_1, group_2, sum(c * c * c - c) AS ties FROM (SELECT group_1, group_2, CAST(count(*) AS DOUBLE) AS c FROM x GROUP BY group_1, group_2, load) GROUP BY 1, 2),
g AS (SELECT group_1, group_2, CAST(count_if(status = group_1) AS DOUBLE) AS n1, CAST(count_if(status = group_2) AS DOUBLE) AS n2, sum(CASE WHEN status = group_1 THEN r ELSE 0 END) AS r1 FROM r GROUP BY 1, 2),
u AS (SELECT group_1, group_2, n1, n2, n1 + n2 AS n, ties, r1 - n1 * (n1 + 1) / 2 AS u1 FROM g JOIN t USING (group_1, group_2) WHERE least(n1, n2) > {stats.EXACT_U}),
z AS (SELECT group_1, group_2, (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / nullif(sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))), 0) AS z FROM u)
SELECT group_1, group_2, round(least(1, 2 * CASE WHEN z >= 0 THEN {_tail('z')} ELSE 1 - {_tail('(-z)')} END), 6) AS p_value FROM z""")
def pairwise_group_p(spark, sf):
    out = stats.pairwise_tests(relation(spark, sf, "loads"), "status", "load")
    return out.where(F.least("n1", "n2") > stats.EXACT_U).select("group_1", "group_2", F.round("p_value", 6).alias("p_value"))


@query(f"""WITH d AS (SELECT l_returnflag, l_linestatus, l_quantity - 25.5 AS d FROM lineitem WHERE l_quantity <> 25.5),
c AS (SELECT l_returnflag, l_linestatus, abs(d) AS a, CAST(count(*) AS DOUBLE) AS c FROM d GROUP BY 1, 2, 3), t AS (SELECT l_returnflag, l_linestatus, sum(c * c * c - c) AS ties, sum(c) AS n FROM c GROUP BY 1, 2),
r AS (SELECT l_returnflag, l_linestatus, d, rank() OVER w + (count(*) OVER (PARTITION BY l_returnflag, l_linestatus, abs(d)) - 1) / 2.0 AS r FROM d WINDOW w AS (PARTITION BY l_returnflag, l_linestatus ORDER BY abs(d))),
s AS (SELECT l_returnflag, l_linestatus, CAST(least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS DOUBLE) AS w FROM r GROUP BY 1, 2),
z AS (SELECT l_returnflag, l_linestatus, w, CAST(n AS BIGINT) AS n, abs((w - n * (n + 1) / 4) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 0)) AS z FROM s JOIN t USING (l_returnflag, l_linestatus) WHERE n > {stats.EXACT_W})
SELECT l_returnflag, l_linestatus, n, w, round(least(1, 2 * {_tail('z')}), 6) AS p_value FROM z""")
def wilcoxon_p(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("middle", F.lit(25.5))
    out = stats.wilcoxon(rows, ["l_returnflag", "l_linestatus"], "l_quantity", "middle").where(F.col("n") > stats.EXACT_W)
    return out.select("l_returnflag", "l_linestatus", "n", "w", F.round("p_value", 6).alias("p_value"))


#: The t distribution with 1 to 5 degrees of freedom has closed forms in the correlation s and c = sqrt(1 - s * s).
@query("""WITH g AS (SELECT l_orderkey, count(*) AS n, least(1, abs(covar_pop(l_quantity, l_extendedprice) / nullif(stddev_pop(l_quantity) * stddev_pop(l_extendedprice), 0))) AS s FROM lineitem GROUP BY 1 HAVING count(*) BETWEEN 3 AND 7 AND min(l_quantity) < max(l_quantity) AND min(l_extendedprice) < max(l_extendedprice)),
h AS (SELECT *, sqrt(1 - s * s) AS c FROM g WHERE s IS NOT NULL)
SELECT l_orderkey, n, round(1 - CASE n WHEN 3 THEN asin(s) * 2 / pi() WHEN 4 THEN s WHEN 5 THEN (asin(s) + s * c) * 2 / pi() WHEN 6 THEN s * (1 + c * c / 2) ELSE (asin(s) + s * (c + c * c * c * 2 / 3)) * 2 / pi() END, 5) AS p_value FROM h""")
def pearson_p(spark, sf):
    out = stats.pearson(table(spark, sf, "lineitem"), ["l_orderkey"], "l_quantity", "l_extendedprice").where(F.col("n").between(3, 7) & F.col("r").isNotNull())
    return out.select("l_orderkey", "n", F.round("p_value", 5).alias("p_value"))


@query("SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def pearson(spark, sf):
    return stats.pearson(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").select("l_returnflag", "n", F.round("r", 6).alias("r"))


@query("""WITH c AS (SELECT quantile_cont(l_extendedprice, 0.1) AS lo, quantile_cont(l_extendedprice, 0.9) AS hi FROM lineitem)
SELECT CASE WHEN l_extendedprice <= lo THEN 'low' ELSE 'high' END AS side, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem, c WHERE l_extendedprice <= lo OR l_extendedprice >= hi GROUP BY 1""")
def outer_decile_means(spark, sf):
    return stats.outer_means(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity").select("side", "n", F.round("mean", 6).alias("mean"))


@query("""WITH a AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal > 5000 GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM a FULL OUTER JOIN b ON a.k = b.k""")
def full_outer_fill(spark, sf):
    a = table(spark, sf, "customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = table(spark, sf, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return aggregates.outer_fill(a, b, ["k"])


@query("""WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2), t AS (SELECT c_nationkey, c_mktsegment FROM n QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1)
SELECT c.c_nationkey, c.c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM customer c JOIN t ON c.c_nationkey = t.c_nationkey AND c.c_mktsegment = t.c_mktsegment GROUP BY 1, 2""")
def dominant_category(spark, sf):
    rows = aggregates.dominant(table(spark, sf, "customer"), ["c_nationkey"], "c_mktsegment")
    return rows.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean"))


@query("""WITH a AS (SELECT c_custkey % 500 AS id, max_by(c_mktsegment, c_custkey) AS chrom FROM customer GROUP BY 1)
SELECT coalesce(a.chrom, 'unmapped') AS chrom, count(*) AS n FROM orders o LEFT JOIN a ON o.o_custkey % 700 = a.id GROUP BY 1""")
def lookup_last_wins(spark, sf):
    lines = table(spark, sf, "customer").select((F.col("c_custkey") % 500).alias("id"), F.col("c_mktsegment").alias("chrom"), "c_custkey")
    alias = readers.last_alias(lines, F.col("c_custkey")).withColumnRenamed("alias_chrom", "chrom")
    o = table(spark, sf, "orders").withColumn("id", F.col("o_custkey") % 700)
    return o.join(alias, "id", "left").groupBy(F.coalesce("chrom", F.lit("unmapped")).alias("chrom")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, concat(CASE WHEN n_nationkey < 22 THEN concat('chr', n_nationkey + 1) ELSE 'scaffold' END, CASE WHEN n_regionkey % 2 = 0 THEN '_alt' ELSE '' END) AS raw,
CASE WHEN n_nationkey < 22 THEN concat('chr', n_nationkey + 1, CASE WHEN n_nationkey * 10000 > 100000 THEN 'q' ELSE 'p' END) END AS assignment FROM nation""")
def normalised_ends(spark, sf):
    rows = table(spark, sf, "nation").selectExpr("n_name", "n_nationkey * 10000 AS pos", "concat(CASE WHEN n_nationkey < 22 THEN concat('chr', n_nationkey + 1) ELSE 'scaffold' END, CASE WHEN n_regionkey % 2 = 0 THEN '_alt' ELSE '' END) AS raw")
    return rows.select("n_name", "raw", identity.normalised(F.col("raw"), F.col("pos")).alias("assignment"))


@query(f"""WITH {ctes('loads')}, d AS (SELECT sample, assignment, load FROM loads), h AS (SELECT sample, median(load) FILTER (WHERE assignment IN ('chr1p', 'chr2p', 'chr3p')) AS a, median(load) FILTER (WHERE assignment NOT IN ('chr1p', 'chr2p', 'chr3p')) AS b FROM d GROUP BY 1)
SELECT sample, round(a / b, 6) AS ratio FROM h WHERE a IS NOT NULL AND b > 0""")
def median_ratio(spark, sf):
    own = F.col("assignment").isin("chr1p", "chr2p", "chr3p")
    return aggregates.median_ratio(relation(spark, sf, "loads"), "sample", own, "load").select("sample", F.round("ratio", 6).alias("ratio"))


@query(f"""WITH {ctes('loads')} SELECT tech, round(avg(CASE WHEN load > 150000 THEN 1.0 ELSE 0.0 END), 6) AS share, count(DISTINCT assignment) AS ends, round(count(DISTINCT sample) / 40.0, 6) AS samples FROM loads GROUP BY 1""")
def share_above(spark, sf):
    out = relation(spark, sf, "loads").groupBy("tech").agg(aggregates.share_above("load", 150_000).alias("share"), F.count_distinct("assignment").alias("ends"), (F.count_distinct("sample") / 40.0).alias("samples"))
    return out.select("tech", F.round("share", 6).alias("share"), "ends", F.round("samples", 6).alias("samples"))


@query(f"""WITH {ctes('loads')}, p AS (SELECT assignment, avg(load) FILTER (WHERE tech = 'ONT') AS "ONT", avg(load) FILTER (WHERE tech = 'PacBio') AS "PacBio" FROM loads GROUP BY 1)
SELECT assignment, round("ONT", 4) AS "ONT", round("PacBio", 4) AS "PacBio" FROM p""")
def pivot_means(spark, sf):
    out = relation(spark, sf, "loads").groupBy("assignment").pivot("tech", ["ONT", "PacBio"]).agg(F.avg("load"))
    return out.select("assignment", F.round("ONT", 4).alias("ONT"), F.round("PacBio", 4).alias("PacBio"))


@query(f"""WITH {ctes('loads')} SELECT assignment, id, load FROM loads QUALIFY row_number() OVER (PARTITION BY assignment ORDER BY load DESC, id) = 1""")
def first_of_group(spark, sf):
    return aggregates.first_of(relation(spark, sf, "loads"), ["assignment"], [-F.col("load"), F.col("id")]).select("assignment", "id", "load")


@query(f"""WITH {ctes('loads')} SELECT count(*) AS n, CAST(count_if(NOT (starts_with(assignment, 'chr13') OR starts_with(assignment, 'chr14') OR starts_with(assignment, 'chr21'))) AS BIGINT) AS kept, CAST(count_if(isfinite(1.0 / nullif(id % 3, 0))) AS BIGINT) AS finite FROM loads""")
def prefix_and_finite_filters(spark, sf):
    rows = relation(spark, sf, "loads").withColumn("v", F.try_divide(F.lit(1.0), F.col("id") % 3))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~identity.any_prefix("assignment", ["chr13", "chr14", "chr21"])).alias("kept"), F.count_if(identity.finite("v")).alias("finite"))
