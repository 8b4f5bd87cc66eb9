"""Queries over sequences: variant repeats, k-mers, consensus."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions import identity, sequence
from strandmill.operators import aggregates, stats
from strandmill.plans.derived import READS, SPANS, reads, table, telomere_reads
from strandmill.plans.register import registry

QUERIES, ORACLES, query = registry()


def _r(c, n: int = 6):
    return F.round(c, n)


@query(f"""WITH {SPANS}, l AS (SELECT t.id, t.assignment, CAST(coalesce(sum(s.length), 0) AS BIGINT) AS load FROM telos t LEFT JOIN spans s ON t.id = s.id GROUP BY 1, 2)
SELECT assignment, count(*) AS n, round(avg(load), 6) AS mean_load, median(load) AS median_load FROM l GROUP BY 1""")
def tvr_load(spark, sf):
    rows = telomere_reads(spark, sf).withColumn("load", sequence.span_load("spans"))
    return stats.group_percentiles(rows, ["assignment"], "load", [0.5]).select("assignment", "n", _r("mean").alias("mean_load"), F.col("p0").alias("median_load"))


@query(f"WITH {SPANS} SELECT id, start, length FROM spans")
def tvr_spans(spark, sf):
    rows = telomere_reads(spark, sf).select("id", F.explode("spans").alias("s"))
    return rows.select("id", F.col("s.start").cast("long").alias("start"), F.col("s.length").cast("long").alias("length"))


@query(f"WITH {SPANS} SELECT id, motif, CAST(plus AS BIGINT) AS plus, CAST(minus AS BIGINT) AS minus FROM telos")
def strand_call(spark, sf):
    rows = telomere_reads(spark, sf)
    return rows.select("id", "motif", *(sequence.overlapping("telo", sequence.rotations(m)).cast("long").alias(n) for m, n in ((sequence.PLUS, "plus"), (sequence.MINUS, "minus"))))


@query(f"WITH {SPANS}, w AS (SELECT id, floor(length / 10) AS bin FROM spans) SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n FROM w GROUP BY 1")
def tvr_size_distribution(spark, sf):
    spans = telomere_reads(spark, sf).select(F.explode("spans").alias("s"))
    return spans.groupBy(F.floor(F.col("s.length") / 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SPANS}, k AS (SELECT substr(piece, CAST(i AS INT), 6) AS kmer FROM (SELECT piece, unnest(range(1, length - 4)) AS i FROM spans WHERE length > 6))
SELECT kmer, count(*) AS n FROM k WHERE regexp_full_match(kmer, '[ACGT]+') GROUP BY 1""")
def kmer_counts_inside(spark, sf):
    rows = telomere_reads(spark, sf).select("telo", F.explode("spans").alias("s")).where("s.length > 6")
    text = F.substr("telo", F.col("s.start") + 1, F.col("s.length"))
    k = rows.select(F.explode(sequence.kmers(text, 6)).alias("kmer")).where(sequence.plain("kmer"))
    return k.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SPANS}, k AS (SELECT substr(t.telo, CAST(s.start + i AS INT), 6) AS kmer FROM (SELECT id, start, length, unnest(range(1, length + 1)) AS i FROM spans WHERE length > 24) s JOIN telos t ON t.id = s.id)
SELECT kmer, count(*) AS n FROM k WHERE regexp_full_match(kmer, '[ACGT]{{6}}') GROUP BY 1""")
def kmer_counts_overlapping(spark, sf):
    rows = telomere_reads(spark, sf).select("telo", F.explode("spans").alias("s")).where("s.length > 24")
    starts = F.sequence(F.col("s.start") + 1, F.col("s.start") + F.col("s.length"))
    k = rows.select(F.explode(F.transform(starts, lambda i: F.substr(F.col("telo"), i, F.lit(6)))).alias("kmer"))
    return k.where(sequence.plain("kmer") & (F.length("kmer") == 6)).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SPANS}, k AS (SELECT t.assignment, substr(piece, CAST(i AS INT), 6) AS kmer FROM (SELECT id, piece, unnest(range(1, length - 4, 6)) AS i FROM spans WHERE length >= 6) s JOIN telos t ON t.id = s.id),
n AS (SELECT assignment, kmer, count(*) AS n FROM k GROUP BY 1, 2), top AS (SELECT kmer FROM n GROUP BY 1 ORDER BY sum(n) DESC, kmer LIMIT 5)
SELECT assignment, CASE WHEN kmer IN (SELECT kmer FROM top) THEN kmer ELSE 'OTHER' END AS kmer, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY 1, 2""")
def kmer_topk_other(spark, sf):
    rows = telomere_reads(spark, sf).select("assignment", "telo", F.explode("spans").alias("s"))
    text = F.substr("telo", F.col("s.start") + 1, F.col("s.length"))
    k = rows.select("assignment", F.explode(sequence.kmers(text, 6, 6)).alias("kmer")).groupBy("assignment", "kmer").agg(F.count(F.lit(1)).alias("n"))
    return aggregates.top_and_other(k, "assignment", "kmer", "n", 5)


@query(f"""WITH {SPANS}, k AS (SELECT id, start, length, i, substr(piece, CAST(i AS INT), 6) AS kmer FROM (SELECT id, start, length, piece, unnest(range(1, length - 4)) AS i FROM spans WHERE length >= 6)),
g AS (SELECT *, least(6, coalesce(lead(i) OVER (PARTITION BY id, start, kmer ORDER BY i) - i, 6)) AS c FROM k),
b AS (SELECT id, start, max(c) AS c FROM (SELECT id, start, kmer, 100.0 * sum(c) / any_value(length) AS c FROM g GROUP BY ALL) GROUP BY 1, 2)
SELECT s.id, s.start, round(coalesce(b.c, 0), 6) AS coverage FROM spans s LEFT JOIN b ON s.id = b.id AND s.start = b.start""")
def best_k_coverage(spark, sf):
    rows = telomere_reads(spark, sf).select("id", "telo", F.explode("spans").alias("s"))
    spans = rows.select(F.struct("id", F.col("s.start").cast("long").alias("start")).alias("key"), F.substr("telo", F.col("s.start") + 1, F.col("s.length")).alias("piece"))
    return aggregates.best_kmer_coverage(spans, "key", "piece", 6).select("key.id", "key.start", _r("coverage").alias("coverage"))


@query(f"""WITH {READS}, x AS (SELECT id, translate(reverse(seq), 'ACGTacgtnN', 'TGCAtgcaNn') AS rc, seq FROM reads)
SELECT id, md5(rc) AS rc_md5, CAST(length(seq) - length(replace(seq, 'G', '')) AS BIGINT) AS g FROM x""")
def reverse_complements(spark, sf):
    rows = reads(spark, sf)
    return rows.select("id", F.md5(sequence.reverse_complement("seq")).alias("rc_md5"), sequence.char_count("seq", "G").cast("long").alias("g"))


@query("""WITH w AS (SELECT DISTINCT substr(replace(p_type, ' ', ''), 1, 6) AS a, substr(replace(p_name, ' ', ''), 1, 6) AS b FROM part)
SELECT a, b, length(a) = length(b) AND contains(concat(a, a), b) AS rotated FROM (SELECT a, b FROM w UNION SELECT a, concat(substr(a, 3), substr(a, 1, 2)) FROM w)""")
def cyclic_match(spark, sf):
    w = table(spark, sf, "part").selectExpr("substr(replace(p_type, ' ', ''), 1, 6) AS a", "substr(replace(p_name, ' ', ''), 1, 6) AS b").distinct()
    both = w.unionByName(w.selectExpr("a", "concat(substr(a, 3), substr(a, 1, 2)) AS b")).distinct()
    return both.select("a", "b", sequence.is_rotation("a", "b").alias("rotated"))


@query()
def kmer_hash_scalars(spark, sf):
    rows = telomere_reads(spark, sf).select(F.explode(sequence.kmers("telo", 6, 6)).alias("kmer")).where(sequence.plain("kmer")).distinct()
    key = sequence.canonical_key("kmer")
    return rows.select("kmer", key.alias("key"), sequence.hash_scalar(key).alias("scalar"))


def _consensus(by: str) -> str:
    return f"""WITH {READS}, x AS (SELECT {by}, right(seq, CAST(qend AS INT)) AS tail FROM reads WHERE qend > 0 AND qend <= length(seq)),
g AS (SELECT {by}, count(*) AS n_reads, CAST(floor(median(length(tail))) AS INT) AS width FROM x GROUP BY 1 HAVING count(*) >= 3),
b AS (SELECT x.{by}, i, substr(tail, CAST(i AS INT), 1) AS base FROM (SELECT x.*, g.width, unnest(range(1, g.width + 1)) AS i FROM x JOIN g ON x.{by} = g.{by}) x),
v AS (SELECT {by}, i, base, count(*) AS n FROM b WHERE base IN ('A', 'C', 'G', 'T') GROUP BY 1, 2, 3),
w AS (SELECT {by}, i, base, row_number() OVER (PARTITION BY {by}, i ORDER BY n DESC, base) AS r FROM v)
SELECT g.{by}, g.n_reads, g.width AS length_bp, string_agg(w.base, '' ORDER BY w.i) AS consensus FROM g JOIN w ON g.{by} = w.{by} AND r = 1 GROUP BY 1, 2, 3"""


@query(_consensus("assignment"))
def telomere_consensus(spark, sf):
    return aggregates.consensus(reads(spark, sf), ["assignment"], "seq", "qend", least=3)


@query(_consensus("sample"))
def telomere_consensus_whole(spark, sf):
    """By sample, over all ends."""
    return aggregates.consensus(reads(spark, sf), ["sample"], "seq", "qend", least=3)


@query(f"""WITH {SPANS}, p AS (SELECT id, telo, motif, unnest(range(0, length(telo))) AS p FROM telos WHERE motif IS NOT NULL),
w AS (SELECT id, p, motif, substr(telo, CAST(p + 1 AS INT), 6) AS w FROM p),
f AS (SELECT id, p, CASE WHEN length(w) = 6 AND contains(concat(motif, motif), w) THEN 1 ELSE 0 END AS turn, CASE WHEN w = motif THEN 1 ELSE 0 END AS canon FROM w),
d AS (SELECT id, p, sum(turn) OVER b < 6 AND max(canon) OVER b = 0 AS bare FROM f WINDOW b AS (PARTITION BY id ORDER BY p ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
r AS (SELECT id, p, p - row_number() OVER (PARTITION BY id ORDER BY p) AS island FROM d WHERE bare)
SELECT id, min(p) AS start, count(*) AS length FROM r GROUP BY id, island""")
def phase_disruption_spans(spark, sf):
    rows = telomere_reads(spark, sf).select("id", F.explode(sequence.phase_disruption("telo")).alias("s"))
    return rows.select("id", F.col("s.start").cast("long").alias("start"), F.col("s.length").cast("long").alias("length"))


@query(f"""WITH {SPANS}, p AS (SELECT id, i, substr(telo, CAST(i + 1 AS INT), 6) AS f FROM (SELECT id, telo, unnest(range(0, length(telo), 6)) AS i FROM telos)),
n AS (SELECT *, CASE WHEN f = lag(f) OVER (PARTITION BY id ORDER BY i) THEN 0 ELSE 1 END AS new FROM p),
r AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY i) AS run FROM n), l AS (SELECT f, sum(length(f)) AS size FROM r GROUP BY id, run, f)
SELECT f AS fragment, count(*) AS runs, CAST(max(size) AS INT) AS longest FROM l GROUP BY 1""")
def merged_fragment_runs(spark, sf):
    rows = telomere_reads(spark, sf).select("id", F.explode(sequence.merged_fragments("telo")).alias("f"))
    return rows.groupBy("f.fragment").agg(F.count(F.lit(1)).alias("runs"), F.max("f.length").alias("longest"))


@query(f"""WITH {SPANS}, x AS (SELECT id, assignment, sample FROM telos),
n AS (SELECT assignment, count(*) AS n, count(DISTINCT sample) AS samples FROM x GROUP BY 1)
SELECT assignment, n, samples, CAST(regexp_extract(assignment, '^chr([0-9]+)', 1) AS INT) AS number FROM n""")
def molecules_per_end(spark, sf):
    rows = telomere_reads(spark, sf).groupBy("assignment").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sample").alias("samples"))
    return rows.select("*", identity.arm_number("assignment").alias("number")).orderBy(*identity.arm_key("assignment"))


@query(f"""WITH {SPANS}, d AS (SELECT assignment, p, count(*) AS den FROM (SELECT assignment, unnest(range(0, length(telo))) AS p FROM telos) GROUP BY 1, 2 HAVING count(*) > 3),
c AS (SELECT t.assignment, s.p, count(*) AS num FROM (SELECT id, unnest(range(start, start + length)) AS p FROM spans) s JOIN telos t ON t.id = s.id GROUP BY 1, 2),
f AS (SELECT d.assignment, d.p, coalesce(num, 0) / den AS v FROM d LEFT JOIN c ON d.assignment = c.assignment AND d.p = c.p),
k AS (SELECT assignment FROM f GROUP BY 1 HAVING count(*) > 1000)
SELECT CAST(p AS BIGINT) AS pos, round(avg(v), 6) AS value, count(*) AS n FROM f WHERE assignment IN (SELECT assignment FROM k) GROUP BY 1""")
def tvr_composition(spark, sf):
    rows = telomere_reads(spark, sf)
    spans = rows.select("assignment", F.explode("spans").alias("s")).select("assignment", F.col("s.start").alias("start"), (F.col("s.start") + F.col("s.length")).alias("stop"))
    trace = aggregates.composition_trace(spans, rows.select("assignment", F.length("telo").alias("length")), ["assignment"], 3, 1000)
    return trace.select("pos", _r("value").alias("value"), "n")


@query(f"""WITH {SPANS}, e AS (SELECT id, start, start + length AS stop FROM spans)
SELECT t.assignment, CAST(sum(stop - start) AS BIGINT) AS total, CAST(sum(greatest(0, least(stop, 1000) - start)) AS BIGINT) AS first_1kb,
CAST(sum(greatest(0, least(stop, 5000) - start)) AS BIGINT) AS first_5kb FROM e JOIN telos t ON t.id = e.id GROUP BY 1""")
def span_bases_by_distance(spark, sf):
    s = telomere_reads(spark, sf).select("assignment", F.explode("spans").alias("s")).select("assignment", F.col("s.start").alias("start"), (F.col("s.start") + F.col("s.length")).alias("stop"))
    return aggregates.spans_up_to(s, ["assignment"], [1000, 5000]).withColumnsRenamed({"up_to_1000": "first_1kb", "up_to_5000": "first_5kb"})


@query(f"""WITH {SPANS}, m AS (SELECT t.assignment, t.id, max(s.start) AS top FROM telos t LEFT JOIN spans s ON s.id = t.id AND s.start < 2000 AND s.length >= 5 GROUP BY 1, 2)
SELECT assignment, median(top) AS median_start FROM m GROUP BY 1""")
def ends_by_variant_start(spark, sf):
    near = F.filter("spans", lambda s: (s["start"] < 2000) & (s["length"] >= 5))
    rows = telomere_reads(spark, sf).withColumn("top", F.array_max(F.transform(near, lambda s: s["start"])))
    medians = stats.group_percentiles(rows, ["assignment"], "top", [0.5]).select("assignment", F.col("p0").alias("median_start"))
    return medians.orderBy(F.asc_nulls_last("median_start"), "assignment")
