"""Queries over intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.operators import aggregates, alignments, intervals
from strandmill.plans.derived import ctes, relation
from strandmill.plans.register import registry

QUERIES, ORACLES, query = registry()


@query(f"""WITH {ctes('satellites')}, o AS (SELECT *, max(stop) OVER (PARTITION BY contig ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM satellites),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT contig, min(start) AS start, max(stop) AS stop FROM i GROUP BY contig, k""")
def interval_merge(spark, sf):
    return intervals.merge_intervals(relation(spark, sf, "satellites"), ["contig"]).select("contig", "start", "stop")


@query(f"""WITH {ctes('motifs', 'satellites')}
SELECT m.contig, count(*) AS pairs, CAST(sum(least(m.stop, s.stop) - greatest(m.start, s.start)) AS BIGINT) AS shared
FROM motifs m JOIN satellites s ON m.contig = s.contig AND m.start < s.stop AND m.stop > s.start GROUP BY 1""")
def interval_overlap(spark, sf):
    return intervals.overlap_totals(relation(spark, sf, "motifs"), relation(spark, sf, "satellites"))


_NEAR = "m.contig = t.contig AND m.start < t.stop + 10000 AND m.stop > greatest(t.start - 10000, 0)"


@query(f"WITH {ctes('motifs', 'telomeres')} SELECT DISTINCT m.* FROM motifs m JOIN telomeres t ON {_NEAR}")
def motifs_near_telomeres(spark, sf):
    return intervals.near(relation(spark, sf, "motifs"), relation(spark, sf, "telomeres"), 10_000)


@query(f"WITH {ctes('motifs', 'telomeres')} SELECT contig, count(*) AS n FROM (SELECT DISTINCT * FROM motifs m WHERE NOT EXISTS (SELECT 1 FROM telomeres t WHERE {_NEAR})) GROUP BY 1")
def motifs_far_from_telomeres(spark, sf):
    return intervals.far(relation(spark, sf, "motifs"), relation(spark, sf, "telomeres"), 10_000).groupBy("contig").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ctes('motifs', 'telomeres')}, f AS (SELECT unnest([10000, 100000, 500000, 1000000, 5000000, 10000000]) AS flank),
n AS (SELECT DISTINCT f.flank, m.* FROM f JOIN motifs m ON true JOIN telomeres t ON m.contig = t.contig AND m.start < t.stop + f.flank AND m.stop > greatest(t.start - f.flank, 0))
SELECT CAST(flank AS INT) AS flank, contig, count(*) AS n, round(avg(CASE WHEN direction = '+' THEN 1.0 ELSE 0.0 END), 6) AS skew FROM n GROUP BY 1, 2""")
def orientation_skew_by_flank(spark, sf):
    flanks = [10_000, 100_000, 500_000, 1_000_000, 5_000_000, 10_000_000]
    ends = relation(spark, sf, "telomeres").select("contig", "start", "stop", F.col("start").alias("t_start"), F.col("stop").alias("t_stop"))
    met = intervals.overlap_join(relation(spark, sf, "motifs"), intervals.flank(ends, max(flanks)), width=100_000)
    # one range join at the widest flank; what each narrower one keeps follows from how far its telomere is
    apart = F.greatest(F.col("start") - F.col("t_stop") + 1, F.col("t_start") - F.col("stop") + 1, F.lit(0))
    size = F.explode(F.filter(F.array(*map(F.lit, flanks)), lambda f: apart <= f)).alias("flank")
    rows = met.select(size, "contig", "start", "stop", "direction").distinct()
    return rows.groupBy("flank", "contig").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("direction") == "+", 1.0).otherwise(0.0)), 6).alias("skew"))


@query(f"""WITH {ctes('satellites', 'telomeres')}, b AS (SELECT contig, CASE WHEN direction = '-' THEN stop ELSE start END AS tel_end FROM telomeres)
SELECT s.contig, s.start, s.stop, b.tel_end FROM satellites s JOIN b ON s.contig = b.contig AND (abs(s.start - tel_end) <= 10000 OR abs(s.stop - tel_end) <= 10000)""")
def proximity_join(spark, sf):
    ends = relation(spark, sf, "telomeres").select("contig", intervals.boundary().alias("tel_end"))
    return intervals.within_reach(relation(spark, sf, "satellites"), ends, "tel_end", 10_000)


@query(f"""WITH {ctes('molecules', 'satellites')}, s AS (SELECT contig, (start + stop) / 2 AS mid FROM satellites)
SELECT m.id, EXISTS (SELECT 1 FROM s WHERE s.contig = m.contig AND abs(m.position - s.mid) < 500) AS has_satellite FROM molecules m""")
def proximity_exists(spark, sf):
    centres = relation(spark, sf, "satellites").select("contig", intervals.centre().alias("mid"))
    return intervals.flag_within(relation(spark, sf, "molecules"), "position", centres, "mid", 500, "has_satellite").select("id", "has_satellite")


@query(f"""WITH {ctes('satellites', 'telomeres')}, b AS (SELECT DISTINCT contig, CASE WHEN direction = '-' THEN stop ELSE start END AS tel_end FROM telomeres),
d AS (SELECT s.*, tel_end, greatest(s.start - tel_end, tel_end - s.stop, 0) AS distance FROM (SELECT DISTINCT * FROM satellites) s LEFT JOIN b ON s.contig = b.contig)
SELECT contig, start, stop, tel_end AS nearest_tel_end, CAST(distance AS BIGINT) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY contig, start, stop ORDER BY distance, tel_end) = 1""")
def nearest_boundary(spark, sf):
    ends = relation(spark, sf, "telomeres").select("contig", intervals.boundary().alias("tel_end"))
    return intervals.nearest(relation(spark, sf, "satellites").distinct(), ends, "tel_end")


_ARMS = "SELECT contig, CASE WHEN start = 0 THEN 'p' ELSE 'q' END AS arm, CASE WHEN start = 0 THEN stop ELSE start END AS boundary FROM telomeres"


@query(f"""WITH {ctes('satellites', 'telomeres')}, e AS ({_ARMS}),
w AS (SELECT DISTINCT e.contig, e.arm FROM e JOIN satellites s ON s.contig = e.contig AND (arm = 'p' AND s.start >= boundary AND s.start < boundary + 20000 OR arm = 'q' AND s.stop > boundary - 20000 AND s.stop <= boundary))
SELECT e.arm, count(*) AS ends, count(w.contig) AS with_satellite, round(count(w.contig) / count(*), 6) AS share FROM e LEFT JOIN w ON e.contig = w.contig AND e.arm = w.arm GROUP BY 1""")
def satellite_share_per_arm(spark, sf):
    ends = relation(spark, sf, "telomeres").select("contig", F.when(F.col("start") == 0, "p").otherwise("q").alias("arm"), F.when(F.col("start") == 0, F.col("stop")).otherwise(F.col("start")).alias("boundary"))
    found = intervals.arm_window(relation(spark, sf, "satellites"), ends, 20_000).select("contig", "arm").distinct().withColumn("hit", F.lit(1))
    joined = ends.join(found, ["contig", "arm"], "left")
    return joined.groupBy("arm").agg(F.count(F.lit(1)).alias("ends"), F.count("hit").alias("with_satellite"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("share"))


@query(f"""WITH {ctes('satellites', 'telomeres')}, e AS ({_ARMS}), r AS (SELECT s.contig, arm, CASE WHEN arm = 'p' THEN s.start - boundary ELSE boundary - s.stop END AS rel_start, CASE WHEN arm = 'p' THEN s.stop - boundary ELSE boundary - s.start END AS rel_stop FROM satellites s JOIN e ON s.contig = e.contig)
SELECT contig, arm, rel_start, least(rel_stop, 50000) AS rel_stop FROM r WHERE rel_start >= 0 AND rel_start < 50000""")
def relative_coordinates(spark, sf):
    ends = relation(spark, sf, "telomeres").select("contig", F.when(F.col("start") == 0, "p").otherwise("q").alias("arm"), F.when(F.col("start") == 0, F.col("stop")).otherwise(F.col("start")).alias("boundary"))
    return intervals.relative_to_arm(relation(spark, sf, "satellites").join(ends, "contig"), 50_000).select("contig", "arm", "rel_start", "rel_stop")


@query(f"""WITH {ctes('satellites')}, e AS (SELECT contig, start AS pt, 1 AS d FROM satellites UNION ALL SELECT contig, stop, -1 FROM satellites), s AS (SELECT contig, pt, sum(d) AS d FROM e GROUP BY 1, 2),
r AS (SELECT contig, pt AS start, lead(pt) OVER w AS stop, sum(d) OVER w AS depth FROM s WINDOW w AS (PARTITION BY contig ORDER BY pt))
SELECT contig, CAST(depth AS BIGINT) AS depth, CAST(sum(stop - start) AS BIGINT) AS bases FROM r WHERE stop IS NOT NULL GROUP BY 1, 2""")
def coverage_depth(spark, sf):
    runs = intervals.coverage_runs(relation(spark, sf, "satellites"), ["contig"])
    return runs.groupBy("contig", "depth").agg(F.sum(F.col("stop") - F.col("start")).alias("bases"))


@query(f"""WITH {ctes('motifs')}, c AS (SELECT contig, CAST(floor(start / 50000) AS BIGINT) AS bin, count(*) AS n FROM motifs WHERE start >= 0 AND start < 1000000 GROUP BY 1, 2),
e AS (SELECT contig, unnest(range(0, 20)) AS bin FROM (SELECT DISTINCT contig FROM c))
SELECT e.contig, CAST(e.bin AS BIGINT) AS bin, coalesce(c.n, 0) AS n FROM e LEFT JOIN c ON e.contig = c.contig AND e.bin = c.bin""")
def motif_bins_zero_filled(spark, sf):
    rows = relation(spark, sf, "motifs").where("start >= 0 AND start < 1000000")
    counts = rows.groupBy("contig", F.floor(F.col("start") / 50_000).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return aggregates.fill_bins(counts, "contig", "bin", 20, "n")


_PRIMARY = "(flag & 2308) = 0"


@query(f"""WITH {ctes('alignments')} SELECT rname, count(*) AS total, {', '.join(f'CAST(count_if(mapq >= {q}) AS BIGINT) AS mapq_{q}' for q in (20, 30, 40, 50, 60))} FROM alignments WHERE {_PRIMARY} GROUP BY 1""")
def mapq_threshold(spark, sf):
    return alignments.mapq_summary(relation(spark, sf, "alignments"), [20, 30, 40, 50, 60], ["rname"])


@query(f"""WITH {ctes('alignments', 'telomeres')}, i AS (SELECT DISTINCT qname FROM alignments a JOIN telomeres t ON a.rname = t.contig AND a.pos < t.stop AND a.stop > t.start WHERE (flag & 4) = 0),
g AS (SELECT CASE WHEN i.qname IS NOT NULL THEN 'inside' ELSE 'outside' END AS grp, nm, score FROM alignments a LEFT JOIN i ON a.qname = i.qname WHERE (flag & 4) = 0)
SELECT grp AS "group", count(nm) AS nm_n, round(avg(nm), 6) AS nm_mean, round(CASE WHEN count(nm) > 1 THEN stddev_pop(nm) END, 6) AS nm_sd,
count(score) AS as_n, round(avg(score), 6) AS as_mean, round(CASE WHEN count(score) > 1 THEN stddev_pop(score) END, 6) AS as_sd FROM g GROUP BY 1""")
def nm_as_summary(spark, sf):
    rows = relation(spark, sf, "alignments").withColumn("tags", F.array(F.lit("RG:Z:x"), F.concat(F.lit("NM:i:"), "nm"), F.concat(F.lit("AS:i:"), "score")))
    out = alignments.tag_summary(rows.drop("nm", "score"), relation(spark, sf, "telomeres"), {"nm": "NM:i:", "as": "AS:i:"})
    return out.select(*(F.round(c, 6).alias(c) if c.endswith(("mean", "sd")) else F.col(c) for c in out.columns))


@query(f"""WITH {ctes('alignments', 'telomeres')} SELECT qname FROM (SELECT DISTINCT qname FROM alignments WHERE (flag & 4) = 0)
EXCEPT SELECT qname FROM alignments a JOIN telomeres t ON a.rname = t.contig AND a.pos < t.stop AND a.stop > t.start WHERE (flag & 4) = 0""")
def reads_outside_telomeres(spark, sf):
    rows = relation(spark, sf, "alignments")
    names = rows.where(F.col("flag").bitwiseAND(4) == 0).select("qname").distinct()
    return names.join(alignments.touching_reads(rows, relation(spark, sf, "telomeres")), "qname", "left_anti")


@query()
def alignments_by_quality(spark, sf):
    rows = relation(spark, sf, "alignments").withColumn("size", (F.col("stop") - F.col("pos")).cast("int")).where("size > 0")
    cigar = F.concat(F.lit("5S"), F.col("size").cast("string"), F.lit("M3I2D"))
    rows = rows.withColumns({"cigar": cigar, "quality": F.transform(F.sequence(F.lit(1), F.col("size") + 8), lambda k: ((k * 7 + F.col("mapq")) % 41).cast("double"))})
    kept = alignments.filter_by_quality(rows, intervals.flank(relation(spark, sf, "telomeres"), 20_000), 19.0)
    return kept.select("qname", "rname", "pos", F.size("means").alias("regions"), F.round(F.array_max("means"), 6).alias("best"))
