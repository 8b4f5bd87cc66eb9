"""Queries over single molecules: methylation calls, footprints, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions import identity, sequence
from strandmill.operators import aggregates, kernels, methylation
from strandmill.plans.derived import READS, SPANS, reads, table, telomere_reads
from strandmill.plans.register import registry

QUERIES, ORACLES, query = registry()

_SITES = "concat('m', user_id % 60, ',m', event_id % 60) AS names, concat(CAST(floor(value) AS INT) % 4, ',', CAST(floor(value * 3) AS INT) % 4) AS codes"


def _called(spark, sf) -> DataFrame:
    """Telomere reads with calls at every fifth A of the telomere, by the read's id; at every fifth T for a quarter of the reads."""
    rows = telomere_reads(spark, sf)
    found = F.transform(F.split("telo", ""), lambda base, k: F.when((base == F.when(F.col("id") % 4 == 1, "T").otherwise("A")) & ((k + F.col("id")) % 5 == 0), k))
    return rows.withColumn("calls", F.array_compact(found))


_TARGET = "CASE WHEN id % 4 = 1 THEN 'T' ELSE 'A' END"
_CALLED = f"""{READS}, t AS (SELECT id, sample, assignment, tech, right(seq, CAST(least(qend, length(seq)) AS INT)) AS head FROM reads WHERE qend >= 100),
p AS (SELECT id, sample, assignment, tech, k, substr(head, CAST(k + 1 AS INT), 1) AS base FROM (SELECT *, unnest(range(0, length(head))) AS k FROM t)),
o AS (SELECT *, (k + id) % 5 = 0 AS called FROM p WHERE base = {_TARGET}), a AS (SELECT * FROM o WHERE id IN (SELECT id FROM o WHERE called))"""


@query(f"""WITH e AS (SELECT event_type, {_SITES} FROM events),
m AS (SELECT event_type, unnest(string_split(names, ',')) AS name, unnest(string_split(codes, ',')) AS code FROM e),
b AS (SELECT event_type, name, bool_or((CAST(code AS INT) & 3) = 3) AS bound FROM m GROUP BY 1, 2)
SELECT event_type, count(*) AS n_molecules, round(avg(CASE WHEN bound THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM b GROUP BY 1""")
def bound_fraction(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_type", _SITES.split(" AS names, ")[0] + " AS names", _SITES.split(" AS names, ")[1])
    return aggregates.bound_fraction(rows, ["event_type"], "names", "codes").select("event_type", "n_molecules", F.round("fraction", 6).alias("fraction"))


@query(f"""WITH e AS (SELECT {_SITES} FROM events), f AS (SELECT (CAST(string_split(codes, ',')[1] AS INT) & 3) = 3 AS a, (CAST(string_split(codes, ',')[2] AS INT) & 3) = 3 AS b FROM e)
SELECT a, b, count(*) AS n FROM f GROUP BY 1, 2""")
def footprint_decode(spark, sf):
    codes = table(spark, sf, "events").selectExpr(_SITES.split(" AS names, ")[1])
    flags = codes.select(sequence.bound_flags("codes").alias("f"))
    return flags.groupBy(F.col("f")[0].alias("a"), F.col("f")[1].alias("b")).agg(F.count(F.lit(1)).alias("n"))


_PLACE = "CAST((event_id * 6151 + user_id * 97) % 1000000 AS BIGINT) AS start"
_SITE_LIST = f"""e AS (SELECT {_PLACE}, {_SITES} FROM events), m AS (SELECT start, unnest(string_split(names, ',')) AS name, unnest(string_split(codes, ',')) AS code FROM e),
s AS (SELECT name, start, (CAST(code AS INT) & 3) = 3 AS bound FROM m)"""


def _sites(spark, sf) -> DataFrame:
    rows = table(spark, sf, "events").selectExpr(_PLACE, _SITES.split(" AS names, ")[0] + " AS names", _SITES.split(" AS names, ")[1])
    return aggregates.site_list(rows, "names", "codes")


@query(f"WITH {_SITE_LIST} SELECT name, count(*) AS sites, CAST(count_if(bound) AS BIGINT) AS bound, min(start) AS first FROM s GROUP BY 1")
def molecule_sites(spark, sf):
    size = F.size("sites").cast("long")
    return _sites(spark, sf).select("name", size.alias("sites"), F.size(F.filter("sites", lambda s: s["bound"])).cast("long").alias("bound"), F.col("sites")[0]["start"].alias("first"))


@query(f"""WITH {_SITE_LIST}, g AS (SELECT name, start - lag(start) OVER (PARTITION BY name ORDER BY start) AS gap FROM s WHERE bound)
SELECT name, count(*) AS gaps, round(avg(gap), 6) AS mean_gap FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def bound_site_gaps(spark, sf):
    return aggregates.bound_gaps(_sites(spark, sf)).groupBy("name").agg(F.count(F.lit(1)).alias("gaps"), F.round(F.avg("gap"), 6).alias("mean_gap"))


@query(f"""WITH e AS (SELECT event_type, event_id % 4000 AS length, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 1 + CAST(floor(value) AS BIGINT) END AS calls FROM events)
SELECT event_type, count(*) AS n, CAST(count_if(calls >= greatest(1, ceil(length * 0.001))) AS BIGINT) AS kept FROM e GROUP BY 1""")
def adaptive_call_gate(spark, sf):
    calls = "CASE WHEN event_id % 5 = 0 THEN '' ELSE array_join(transform(sequence(0L, CAST(floor(value) AS BIGINT)), k -> CAST(k AS STRING)), ',') END AS m6a_qual"
    rows = table(spark, sf, "events").selectExpr("event_type", "event_id % 4000 AS length", calls)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(identity.enough_calls("m6a_qual", "length")).alias("kept"))


@query("""SELECT event_type, count(*) AS n, CAST(count_if(event_id % 40000 >= 15000 AND user_id >= 100 AND CAST(user_id AS DOUBLE) / (event_id % 40000) >= 0.005 AND value >= 10 AND event_id % 25000 BETWEEN 1500 AND 20000) AS BIGINT) AS kept FROM events GROUP BY 1""")
def molecule_gates(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_type", "event_id % 40000 AS q", "user_id AS m", "value AS nuc", "event_id % 25000 AS telo")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(identity.molecule_gates("q", "m", "nuc", "telo")).alias("kept"))


@query(f"WITH {_CALLED} SELECT assignment, CAST(k AS INT) AS pos, CAST(count_if(called) AS BIGINT) AS calls, count(*) AS targets FROM a GROUP BY 1, 2")
def positional_rate(spark, sf):
    return methylation.positional_rate(_called(spark, sf), ["assignment"], "telo", "calls")


@query(ORACLES["positional_rate"].replace("assignment, CAST", "sample, CAST"))
def positional_rate_whole(spark, sf):
    """By sample over all ends."""
    return methylation.positional_rate(_called(spark, sf), ["sample"], "telo", "calls")


@query(f"""WITH {_CALLED}, g AS (SELECT k, count_if(called) AS calls, count(*) AS targets FROM a GROUP BY 1)
SELECT CAST(k AS INT) AS pos, round(sum(calls) OVER w / nullif(sum(targets) OVER w, 0), 6) AS ratio FROM g WINDOW w AS (ORDER BY k ROWS BETWEEN 50 PRECEDING AND 49 FOLLOWING)""")
def rolling_ratio(spark, sf):
    rates = methylation.positional_rate(_called(spark, sf), [], "telo", "calls").withColumn("all", F.lit(0))
    return aggregates.rolling_ratio(rates, ["all"], "pos", "calls", "targets", 100).select("pos", F.round("ratio", 6).alias("ratio"))


@query(f"""WITH {_CALLED}, g AS (SELECT sample, k, count_if(called) AS calls, count(*) AS targets FROM a GROUP BY 1, 2)
SELECT sample, CAST(k AS INT) AS pos, round(sum(calls) OVER w / nullif(sum(targets) OVER w, 0), 6) AS ratio FROM g WINDOW w AS (PARTITION BY sample ORDER BY k ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)""")
def rolling_ratio_whole(spark, sf):
    """By sample, over ten positions."""
    rates = methylation.positional_rate(_called(spark, sf), ["sample"], "telo", "calls")
    return aggregates.rolling_ratio(rates, ["sample"], "pos", "calls", "targets", 10).select("sample", "pos", F.round("ratio", 6).alias("ratio"))


@query(f"""WITH {_CALLED}, m AS (SELECT assignment, sample, id, k // 50 AS bin, count_if(called) / count(*) AS r FROM a GROUP BY 1, 2, 3, 4),
s AS (SELECT assignment, sample, bin, avg(r) AS m FROM m GROUP BY 1, 2, 3)
SELECT assignment, CAST(bin AS BIGINT) AS bin, round(median(m), 6) AS rate FROM s GROUP BY 1, 2""")
def binned_rate(spark, sf):
    return methylation.binned_rate(_called(spark, sf), ["assignment"], "sample", "telo", "calls").select("assignment", "bin", F.round("rate", 6).alias("rate"))


@query(ORACLES["binned_rate"])
def binned_rate_whole(spark, sf):
    """By chromosome end in bins of 50 bases, over whole telomeres."""
    return methylation.binned_rate(_called(spark, sf), ["assignment"], "sample", "telo", "calls").select("assignment", "bin", F.round("rate", 6).alias("rate"))


@query()
def binned_variant_rates(spark, sf):
    out = methylation.binned_variant_rates(_called(spark, sf).where("length(telo) >= 1000"), ["assignment"], "sample", "telo", "calls", "spans")
    return out.select("assignment", "bin", F.round("inside_rate", 6).alias("inside"), F.round("outside_rate", 6).alias("outside"))


_MOTIFS = ["TTAGGG", "TGAGGG", "TTGGGG", "CCCTAA", "CCCTCA", "CCCCAA"]


def _motif_counts(by: str) -> str:
    return f"""WITH {_CALLED}, x AS (SELECT t.*, m.motif FROM t CROSS JOIN (SELECT unnest({_MOTIFS}) AS motif) m),
s AS (SELECT id, {by}, motif, unnest(string_split(head, motif)) AS piece, generate_subscripts(string_split(head, motif), 1) AS k, len(string_split(head, motif)) AS n FROM x),
h AS (SELECT id, {by}, motif, k, n, sum(length(piece) + 6) OVER (PARTITION BY id, motif ORDER BY k) - 6 AS at FROM s),
c AS (SELECT h.*, EXISTS (SELECT 1 FROM a WHERE a.id = h.id AND a.called AND a.k >= h.at AND a.k < h.at + 6) AS meth FROM h WHERE k < n),
b AS (SELECT DISTINCT {by}, motif FROM x)
SELECT b.{by}, b.motif, CAST(coalesce(count_if(c.meth), 0) AS BIGINT) AS meth, count(c.at) AS total FROM b LEFT JOIN c ON b.{by} = c.{by} AND b.motif = c.motif GROUP BY 1, 2"""


@query(_motif_counts("sample"))
def motif_call_counts(spark, sf):
    out = methylation.motif_counts(_called(spark, sf), "sample", "telo", "calls", _MOTIFS)
    return out.select("sample", "motif", F.col("meth").cast("long").alias("meth"), F.col("total").cast("long").alias("total"))


@query(_motif_counts("assignment"))
def motif_call_counts_whole(spark, sf):
    """By chromosome end."""
    out = methylation.motif_counts(_called(spark, sf), "assignment", "telo", "calls", _MOTIFS)
    return out.select("assignment", "motif", F.col("meth").cast("long").alias("meth"), F.col("total").cast("long").alias("total"))


@query(f"""WITH n AS ({ORACLES["motif_call_counts"]}), g AS (SELECT motif, sum(meth) / nullif(sum(total), 0) AS base FROM n GROUP BY 1),
r AS (SELECT sample, n.motif, (meth / nullif(total, 0)) / nullif(base, 0) AS ratio FROM n JOIN g ON n.motif = g.motif),
c AS (SELECT sample, ratio AS c FROM r WHERE motif = 'TTAGGG')
SELECT r.sample, motif, round(ratio, 6) AS ratio, round(ratio / nullif(c, 0), 6) AS normalised FROM r LEFT JOIN c ON r.sample = c.sample""")
def motif_ratios(spark, sf):
    counts = methylation.motif_counts(_called(spark, sf), "sample", "telo", "calls", _MOTIFS)
    genome = counts.groupBy("motif").agg(F.sum("meth").alias("meth_count"), F.sum("total").alias("total_count"))
    return methylation.motif_ratios(counts, genome, "sample").select("sample", "motif", F.round("ratio", 6).alias("ratio"), F.round("normalised", 6).alias("normalised"))


@query(f"""WITH {SPANS}, t AS (SELECT id, sample, telo, {_TARGET} AS own FROM telos WHERE length(telo) >= 1000),
k AS (SELECT id, p FROM (SELECT id, telo, own, unnest(range(1, length(telo))) AS p FROM t) WHERE substr(telo, CAST(p + 1 AS INT), 1) = own AND (p + id) % 5 = 0),
n AS (SELECT id, start, length, piece, row_number() OVER (PARTITION BY id ORDER BY start) AS rn, count(*) OVER (PARTITION BY id) AS c FROM spans),
u AS (SELECT *, {_TARGET} AS base FROM n WHERE rn > 1 AND rn < c AND contains(piece, {_TARGET})),
h AS (SELECT k.id, count(*) AS hit FROM k JOIN u ON k.id = u.id AND k.p >= u.start AND k.p < u.start + u.length GROUP BY 1),
o AS (SELECT id, sum(length - length(replace(piece, base, ''))) AS own FROM u GROUP BY 1), a AS (SELECT id, count(*) AS calls FROM k GROUP BY 1),
m AS (SELECT t.sample, a.calls, coalesce(hit, 0) AS hit, coalesce(o.own, 0) AS own, length(telo) - length(replace(telo, t.own, '')) AS total
      FROM t LEFT JOIN a ON t.id = a.id LEFT JOIN h ON t.id = h.id LEFT JOIN o ON t.id = o.id)
SELECT sample, count(*) AS n, round(avg(CASE WHEN calls > 0 AND own > 0 THEN hit / own END), 6) AS inside, round(avg(CASE WHEN calls > 0 AND total > own THEN (calls - hit) / (total - own) END), 6) AS outside FROM m GROUP BY 1""")
def variant_call_rates(spark, sf):
    rows = methylation.variant_rates(_called(spark, sf).where("length(telo) >= 1000"), "telo", "calls", "spans")
    return rows.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("inside_rate"), 6).alias("inside"), F.round(F.avg("outside_rate"), 6).alias("outside"))


@query()
def mean_autocorrelation(spark, sf):
    rows = _called(spark, sf).withColumn("size", F.length("telo"))
    return kernels.mean_autocorrelation(rows, ["tech"], "calls", "size", 5000, 2000).select("tech", "lag", F.round("value", 6).alias("value"))


@query(f"""WITH {SPANS}, l AS (SELECT t.id, t.sample, t.assignment, t.tech, coalesce(sum(s.length) FILTER (WHERE s.length >= 5), 0) AS load FROM telos t LEFT JOIN spans s ON s.id = t.id GROUP BY 1, 2, 3, 4),
o AS (SELECT assignment, avg(load) AS a FROM l WHERE tech = 'ONT' GROUP BY 1 HAVING count(*) >= 2), p AS (SELECT assignment, avg(load) AS b FROM l WHERE tech = 'PacBio' GROUP BY 1 HAVING count(*) >= 2)
SELECT o.assignment, round(a, 6) AS left_mean, round(b, 6) AS right_mean FROM o JOIN p ON o.assignment = p.assignment""")
def loads_by_technology(spark, sf):
    rows = telomere_reads(spark, sf).withColumn("load", sequence.span_load("spans", 5))
    out = aggregates.paired_loads(rows.where("tech = 'ONT'"), rows.where("tech = 'PacBio'"), ["assignment"], "load", 2, 2)
    return out.select("assignment", F.round("left_mean", 6).alias("left_mean"), F.round("right_mean", 6).alias("right_mean"))


@query(f"""WITH {READS} SELECT sample, coalesce(tech, 'ALL') AS tech, count(*) AS n, count(DISTINCT assignment) AS ends, count(DISTINCT chrom) AS contigs FROM reads GROUP BY ROLLUP (sample, tech) HAVING sample IS NOT NULL""")
def molecule_totals(spark, sf):
    rows = reads(spark, sf).rollup("sample", "tech").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("assignment").alias("ends"), F.count_distinct("chrom").alias("contigs"))
    return rows.where("sample IS NOT NULL").withColumn("tech", F.coalesce("tech", F.lit("ALL")))


@query(f"""WITH {READS}, h AS (SELECT assignment, string_split(chrom, '#')[1] AS individual, string_split(chrom, '#')[2] AS hap FROM reads),
i AS (SELECT assignment, individual, max(CAST(hap = '1' AS INT)) AS h1, max(CAST(hap = '2' AS INT)) AS h2 FROM h GROUP BY 1, 2)
SELECT assignment, CAST(sum(h1 + h2) AS BIGINT) AS haplotypes FROM i GROUP BY 1""")
def haplotypes_per_end(spark, sf):
    rows = reads(spark, sf).select("assignment", *identity.contig_parts("chrom"))
    each = rows.groupBy("assignment", "individual").agg(*(F.max((F.col("hap") == h).cast("int")).alias(f"h{h}") for h in ("1", "2")))
    return each.groupBy("assignment").agg(F.sum(F.col("h1") + F.col("h2")).alias("haplotypes"))


@query(f"""WITH {READS}, x AS (SELECT id, concat(string_split(chrom, '#')[1], '_', string_split(chrom, '#')[2]) AS label, chrom FROM reads)
SELECT label, count(*) AS n, count(DISTINCT chrom) AS contigs FROM x GROUP BY 1""")
def reads_per_label(spark, sf):
    rows = reads(spark, sf).select(identity.label("chrom").alias("label"), "chrom")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chrom").alias("contigs"))
