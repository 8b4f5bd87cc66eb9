"""Queries through files: relations written in the formats of the sources and read back by their readers.

Files go to the folder that spark.checkpoint.dir names, which driver and executors share; in local mode, where it may be
unset, to a temporary one. They are deleted when the application ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strandmill.plans.derived import READS, ctes, reads, relation, table
from strandmill.plans.register import registry
from strandmill.sources import bam, readers, schemas, sinks
from strandmill.storage import scratch, written

QUERIES, ORACLES, query = registry()


def _lines(df: DataFrame, columns: list, path: str, head: str | None = None, gzip: bool = False) -> str:
    """Tab-separated lines of the columns as text files; each begins with the head line, if there is one."""
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")) for c in columns))
    if head is None:
        df.select(line.alias("value")).write.option("compression", "gzip" if gzip else "none").text(path)
    else:
        df.select(line.alias(head)).write.options(header=True, quote="", sep="\u0001", compression="gzip" if gzip else "none").csv(path)
    return path


_ALIAS = "SELECT DISTINCT concat('S', id % 7, '#', id % 2 + 1, '#ctg', id % 12) AS id, concat('chr', id % 12 + 1) AS chrom FROM (SELECT DISTINCT l_suppkey AS id FROM lineitem) WHERE id % 12 <> 5"


@query(f"""WITH {READS}, a AS ({_ALIAS}) SELECT a.chrom || CASE WHEN r.id % 3 = 0 THEN 'q' ELSE 'p' END AS chrom_assignment, concat_ws('_', string_split(r.chrom, '#')[1], string_split(r.chrom, '#')[2]) AS label,
count(*) AS n, CAST(sum(qend) AS BIGINT) AS ends, CAST(sum(length(seq)) AS BIGINT) AS bases FROM reads r LEFT JOIN a ON r.chrom = a.id GROUP BY 1, 2""")
def centered_read_files(spark, sf):
    rows = reads(spark, sf).withColumn("place", F.when(F.col("id") % 3 == 0, 200_000).otherwise(50_000))
    empty = F.lit("")
    columns = ["chrom", "place", F.lit("+"), empty, F.lit(0), F.lit(0), "id", empty, empty, F.lit(-5), "qend", F.length("seq"), empty, empty, empty, empty, empty, empty, empty, empty, empty, "seq"]
    path = _lines(rows, columns, scratch(spark, "centered"), "\t".join(f"h{k}" for k in range(22)), gzip=True)
    names = rows.where("id % 12 <> 5").select("chrom", F.concat(F.lit("chr"), F.col("id") % 12 + 1).alias("name")).distinct()
    alias = _lines(names, ["chrom", "name", F.lit("c")], scratch(spark, "alias"))
    found = readers.read_centered(spark, path, readers.read_alias(spark, alias))
    return found.groupBy("chrom_assignment", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("centered_query_end").alias("ends"), F.sum(F.length("query_sequence")).alias("bases"))


@query("SELECT concat(r, arm) AS chrom_assignment, count(*) AS n FROM (SELECT concat('chr', user_id % 22 + 1) AS r, CASE WHEN event_id % 2 = 0 THEN 'p' ELSE 'q' END AS arm FROM events) GROUP BY 1")
def pedigree_read_files(spark, sf):
    rows = table(spark, sf, "events").selectExpr("concat('chr', user_id % 22 + 1) AS chrom", "IF(event_id % 2 = 0, 10, 300000) AS place", "event_id")
    columns = ["chrom", "place", *(F.lit(str(k)) for k in range(19)), F.lit("ACGT")]
    path = _lines(rows, columns, scratch(spark, "pedigree"), "\t".join(f"h{k}" for k in range(22)))
    return readers.read_centered(spark, path).groupBy("chrom_assignment").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT event_type, event_id % 4000 AS len, event_id % 7 * 900 AS before, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 1 + CAST(floor(value) AS BIGINT) END AS calls, user_id FROM events),
k AS (SELECT *, calls >= greatest(1, ceil((len + before) * 0.001)) AS kept FROM e), n AS (SELECT count(*) AS reads, CAST(count_if(kept) AS BIGINT) AS kept FROM k)
SELECT concat('chr', user_id % 22 + 1, CASE WHEN user_id % 3 = 0 THEN 'q' ELSE 'p' END) AS chrom_assignment, count(*) AS n, CAST(sum(len) AS BIGINT) AS bases, n.reads AS all_reads, n.kept AS all_kept FROM k, n WHERE k.kept GROUP BY 1, 4, 5""")
def fiberseq_read_files(spark, sf):
    """The gate goes by the centred molecule's length, which is not the query's; what it keeps is counted in the same pass."""
    calls = "CASE WHEN event_id % 5 = 0 THEN '' ELSE array_join(transform(sequence(0L, CAST(floor(value) AS BIGINT)), k -> CAST(k AS STRING)), ',') END AS m6a_qual"
    rows = table(spark, sf, "events").selectExpr(
        "concat('S#1#c', user_id) AS chrom", "IF(user_id % 3 = 0, 200000, 1000) AS centering_position", "-(event_id % 7 * 900) AS centered_query_start", "event_id % 4000 AS centered_query_end", "99999 AS query_length", calls, "user_id")
    columns = ["chrom", "centering_position", "centered_query_start", "centered_query_end", "query_length", "m6a_qual"]
    path = _lines(rows, columns, scratch(spark, "fiberseq"), "\t".join(columns), gzip=True)
    names = rows.select("chrom", F.concat(F.lit("chr"), F.col("user_id") % 22 + 1, F.lit("_hap")).alias("name")).distinct()
    alias = _lines(names, ["chrom", "name", F.lit("c")], scratch(spark, "alias"))
    counts = Observation("fiberseq")
    kept, _ = written(readers.read_fiberseq(spark, path, columns, readers.read_alias(spark, alias), counts=counts), "kept")
    out = kept.groupBy("chrom_assignment").agg(F.count(F.lit(1)).alias("n"), F.sum("centered_query_end").alias("bases"))
    return out.withColumns({"all_reads": F.lit(counts.get["reads"]).cast("long"), "all_kept": F.lit(counts.get["kept"]).cast("long")})


@query(f"WITH {ctes('telomeres')} SELECT * FROM telomeres")
def bed_files(spark, sf):
    rows = relation(spark, sf, "telomeres")
    return readers.read_bed(spark, _lines(rows, ["contig", "start", "stop", "direction", F.lit("more")], scratch(spark, "bed")))


@query(f"WITH {ctes('satellites')} SELECT contig AS chrom, count(*) AS n, CAST(sum(stop - start) AS BIGINT) AS bases FROM satellites GROUP BY 1")
def bed_interval_files(spark, sf):
    rows = relation(spark, sf, "satellites")
    lines = rows.select(F.explode(F.array(F.concat_ws("\t", "contig", "start", "stop"), F.concat(F.lit("#"), F.col("contig")), F.concat_ws("\t", "contig", "start"))).alias("value"))
    path = scratch(spark, "bed3")
    lines.write.text(path)
    return readers.read_bed_intervals(spark, path).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"))


@query(f"WITH {ctes('motifs')} SELECT contig, direction, count(*) AS n, CAST(sum(\"stop\" - start) AS BIGINT) AS bases, round(avg(start % 7), 6) AS score FROM motifs GROUP BY 1, 2")
def motif_files(spark, sf):
    rows = relation(spark, sf, "motifs")
    path = _lines(rows, ["contig", "start", "stop", F.lit("x"), F.col("start") % 7, "direction", *map(F.lit, "abcd")], scratch(spark, "motifs"), gzip=True)
    found = readers.read_motifs(spark, path)
    return found.groupBy("contig", "direction").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"), F.round(F.avg("score"), 6).alias("score"))


@query("SELECT concat('chr', user_id % 22, '_', CASE WHEN event_id * 37 % 200000 < 100000 THEN 'p' ELSE 'q' END) AS chrom_end, count(DISTINCT event_id % 97) AS names FROM events GROUP BY 1")
def bed_name_files(spark, sf):
    rows = table(spark, sf, "events").selectExpr("concat('chr', user_id % 22) AS chrom", "event_id * 37 % 200000 AS start", "event_id % 97 AS name")
    path = _lines(rows, ["chrom", "start", F.col("start") + 10, F.concat(F.lit("r"), "name"), F.lit(0), F.lit("+")], scratch(spark, "bed6"))
    return readers.read_names(spark, path).groupBy("chrom_end").agg(F.count_distinct("name").alias("names"))


@query("""WITH e AS (SELECT CAST(count_if((CAST(floor(value) AS INT) & 3) = 3) AS BIGINT) AS bound, event_type FROM events GROUP BY event_type) SELECT event_type AS chrom, bound FROM e""")
def footprint_files(spark, sf):
    from strandmill.functions.sequence import bound_flags

    rows = table(spark, sf, "events").selectExpr("event_type", "CAST(floor(value) AS INT) AS code", "event_id")
    path = _lines(rows, ["event_type", "event_id", F.col("event_id") + 20, F.lit(1), "code", F.lit("m1")], scratch(spark, "footprints"), "#chrom\tstart\tend\tn_spanning_fibers\tfootprint_codes\tfiber_names", gzip=True)
    flags = readers.read_footprints(spark, path).select("chrom", F.explode(bound_flags("footprint_codes")).alias("b"))
    return flags.groupBy("chrom").agg(F.count_if("b").alias("bound"))


@query("SELECT concat('HG', user_id % 40) AS id, CAST(user_id % 2 + 1 AS VARCHAR) AS hap, count(*) AS n, round(avg(user_id / 8.0), 6) AS pc1, round(avg(event_id / -4.0), 6) AS pc2 FROM events GROUP BY 1, 2")
def ancestry_files(spark, sf):
    rows = table(spark, sf, "events")
    name = F.expr("concat('HG', user_id % 40, '/', user_id % 2 + 1, '/w_(', CAST(user_id / 8.0 AS DOUBLE), ',', CAST(event_id / -4.0 AS DOUBLE), ')')")
    path = _lines(rows, [F.lit("chr1"), "event_id", F.col("event_id") + 5, name, F.lit(0.5)], scratch(spark, "ancestry"))
    found = readers.read_ancestry(spark, path)
    return found.groupBy("id", "hap").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("pc1"), 6).alias("pc1"), F.round(F.avg("pc2"), 6).alias("pc2"))


@query("SELECT o_orderpriority AS label_i, count(*) AS n, round(avg(CAST(o_orderkey % 8 / 8.0 AS FLOAT)), 6) AS sim_t50, count(nullif(o_custkey % 3, 0)) AS sim_t100 FROM orders GROUP BY 1")
def similarity_files(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("label_i"), F.lit("x").alias("label_j"), (F.col("o_orderkey") % 8 / 8.0).alias("sim_t50"), F.nullif(F.col("o_custkey") % 3, F.lit(0)).alias("sim_t100"))
    path = scratch(spark, "similarity")
    sinks.write_csv(rows, path)
    found = readers.read_similarity(spark, path)
    return found.groupBy("label_i").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("sim_t50"), 6).alias("sim_t50"), F.count("sim_t100").alias("sim_t100"))


@query("SELECT concat('chr', l_linenumber, 'p') AS assignment, concat('S', l_suppkey % 5, '_1') AS label, count(*) AS n, count(nullif(l_linenumber, 7)) AS second, CAST(sum(l_partkey) AS DOUBLE) AS start FROM lineitem GROUP BY 1, 2")
def duplication_files(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.concat(F.lit("chr"), "l_linenumber", F.lit("p:S"), F.col("l_suppkey") % 5, F.lit("_1")).alias("chrom"), F.lit("a, b").alias("note"), F.col("l_partkey").alias("code_start_1"),
        F.col("l_orderkey").alias("code_end_1"), F.nullif(F.col("l_linenumber"), F.lit(7)).alias("code_start_2"), F.lit(1).alias("more"))
    path = scratch(spark, "duplications")
    sinks.write_csv(rows, path)
    found = readers.read_duplications(spark, path)
    return found.groupBy("assignment", "label").agg(F.count(F.lit(1)).alias("n"), F.count("code_start_2").alias("second"), F.sum("code_start_1").alias("start"))


@query("SELECT p_brand AS motif, count(*) AS meth_count, CAST(sum(p_size) AS BIGINT) AS total_count FROM part GROUP BY 1")
def motif_count_files(spark, sf):
    counts = table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("m"), F.sum("p_size").alias("t"))
    three = F.concat_ws("\t", "p_brand", "m", "t")
    path = scratch(spark, "motif-counts")
    counts.select(F.explode(F.array(F.lit("motif\tmeth\ttotal"), three, F.lit("short\t1"))).alias("value")).write.text(path)
    return readers.read_motif_counts(spark, path)


_SAM = "qname, flag, rname, pos, mapq, concat(stop - pos, 'M') AS cigar, nm, score"


@query(f"""WITH {ctes('alignments')} SELECT rname, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(mapq) AS BIGINT) AS mapq, CAST(sum(CASE WHEN stop > pos THEN stop - pos ELSE 0 END) AS BIGINT) AS bases, round(avg(nm), 6) AS nm, CAST(2 AS BIGINT) AS header FROM alignments GROUP BY 1""")
def sam_files(spark, sf):
    from strandmill.functions.sequence import tag_value
    from strandmill.operators.alignments import reference_length

    tags = F.array(F.lit("RG:Z:a"), F.concat(F.lit("NM:i:"), F.col("nm").cast("int")))
    rows = relation(spark, sf, "alignments").selectExpr("qname", "flag", "rname", "pos", "mapq", "concat(stop - pos, 'M') AS cigar", "nm").withColumn("tags", tags)
    absent = {n: F.lit(None).cast(schemas.ALIGNMENT[n].dataType) for n in schemas.ALIGNMENT.fieldNames() if n not in rows.columns}
    header = spark.createDataFrame([("@HD\tVN:1.6\tSO:coordinate",), ("@SQ\tSN:ctg0\tLN:1000000",)], "value string")
    path = scratch(spark, "sam")
    sinks.write_sam(rows.withColumns(absent), header, path)
    found = readers.read_sam(spark, path)
    kept = readers.read_sam_header(spark, path).agg(F.count(F.lit(1)).alias("header"))  # one row
    out = found.groupBy("rname").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos"), F.sum("mapq").alias("mapq"), F.sum(reference_length()).alias("bases"), F.round(F.avg(tag_value("tags", "NM:i:")), 6).alias("nm"))
    return out.join(F.broadcast(kept))


#: Alignments with bases and qualities where the mapping quality is low, as both BAM queries write them.
_BAM = f"""{ctes('alignments')}, b AS (SELECT *, CASE WHEN mapq < 20 AND stop > pos THEN stop - pos ELSE 0 END AS bases FROM alignments)"""


def _bam(spark, sf) -> str:
    """The path of a folder of BAM files of the alignments."""
    bases = "CASE WHEN mapq < 20 AND stop > pos THEN stop - pos ELSE 0 END"
    rows = relation(spark, sf, "alignments").selectExpr(
        "qname", "flag", "rname", "pos", "mapq", "concat(stop - pos, 'M') AS cigar", "'=' AS rnext", "pos + 1 AS pnext", "CAST(0 AS BIGINT) AS tlen",
        f"IF({bases} > 0, rpad('', CAST({bases} AS INT), 'ACGTN'), '*') AS seq", f"IF({bases} > 0, repeat(chr(33 + mapq), CAST({bases} AS INT)), '*') AS qual",
        "array(concat('NM:i:', CAST(nm AS INT)), 'RG:Z:a', concat('AS:i:', CAST(score AS INT))) AS tags",
    )
    header = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:ctg{k}\tLN:2000000\n" for k in range(25))
    path = scratch(spark, "bam")
    bam.write_bam(rows, header, path)
    return path


@query(f"""WITH {_BAM} SELECT rname, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(mapq) AS BIGINT) AS mapq, CAST(sum(CASE WHEN stop > pos THEN stop - pos ELSE 0 END) AS BIGINT) AS bases, round(avg(nm), 6) AS nm,
CAST(sum(bases) AS BIGINT) AS letters, CAST(sum(bases * mapq) AS BIGINT) AS quality, CAST(26 AS BIGINT) AS header FROM b GROUP BY 1""")
def bam_files(spark, sf):
    from strandmill.functions.sequence import tag_value
    from strandmill.operators.alignments import reference_length

    path = _bam(spark, sf)
    lines = len(bam.read_bam_header(path).splitlines())
    letters = F.when(F.col("seq") == "*", 0).otherwise(F.length("seq")).cast("long")
    out = bam.read_bam(spark, path).groupBy("rname").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos"), F.sum("mapq").alias("mapq"), F.sum(reference_length()).alias("bases"), F.round(F.avg(tag_value("tags", "NM:i:")), 6).alias("nm"),
        F.sum(letters).alias("letters"), F.sum(letters * F.when(F.col("qual") == "*", 0).otherwise(F.ascii("qual") - 33)).alias("quality"))
    return out.withColumn("header", F.lit(lines).cast("long"))


@query(f"""WITH {_BAM} SELECT rname, flag, count(*) AS n, min(pos) AS first, max(pos) AS last, CAST(sum(score) AS BIGINT) AS score FROM b
WHERE rname IN ('ctg3', 'ctg7') AND pos >= 200000 AND pos < 400000 AND (flag & 2308) = 0 GROUP BY 1, 2""")
def bam_regions(spark, sf):
    from strandmill.functions.sequence import tag_value

    rows = bam.read_bam(spark, _bam(spark, sf), exclude_flags=2308).where("rname IN ('ctg3', 'ctg7') AND pos >= 200000 AND pos < 400000")
    return rows.groupBy("rname", "flag").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.sum(tag_value("tags", "AS:i:").cast("long")).alias("score"))


@query("SELECT concat('q', l_suppkey % 50) AS q_name, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS starts, count(*) AS tags FROM lineitem GROUP BY 1")
def paf_files(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("q", F.concat(F.lit("q"), F.col("l_suppkey") % 50))
    n = F.lit(10)
    path = _lines(rows, ["q", F.lit(99), "l_partkey", F.col("l_partkey") + 5, F.lit("+"), F.lit("t"), n, n, n, n, n, F.lit(60), F.lit("tp:A:P"), F.lit("cg:Z:5M")], scratch(spark, "paf"))
    found = readers.read_paf(spark, path)
    return found.groupBy("q_name").agg(F.count(F.lit(1)).alias("n"), F.sum("q_start").alias("starts"), F.sum(F.size("tags")).alias("tags"))


@query(f"""WITH {ctes('alignments')}, q AS (SELECT unnest([20, 30, 40, 50, 60]) AS threshold), p AS (SELECT mapq FROM alignments WHERE (flag & 2308) = 0)
SELECT CAST(threshold AS BIGINT) AS threshold, CAST(count_if(mapq >= threshold) AS BIGINT) AS passing, count(*) AS total FROM q, p GROUP BY 1""")
def mapq_summary_files(spark, sf):
    from strandmill.operators.alignments import mapq_summary

    cuts = [20, 30, 40, 50, 60]
    one = mapq_summary(relation(spark, sf, "alignments"), cuts)
    lines = F.array(*(x for q in cuts for x in (F.concat(F.lit(f"MAPQ>={q}: "), f"mapq_{q}"), F.concat(F.lit("Total primary: "), "total"))))
    path = scratch(spark, "mapq")
    one.select(F.explode(lines).alias("value")).coalesce(1).write.text(path)
    return readers.read_mapq_summary(spark, path)


@query(f"WITH {ctes('alignments')} SELECT rname, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos FROM alignments WHERE mapq >= 30 GROUP BY 1")
def alignment_tables(spark, sf):
    path = scratch(spark, "alignments")
    sinks.write_alignments(relation(spark, sf, "alignments").where("mapq >= 30"), path)
    return spark.read.parquet(path).groupBy("rname").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos"))


@query("SELECT o_orderstatus AS status, count(*) AS n, count(*) - count(nullif(o_custkey % 4, 0)) AS missing FROM orders GROUP BY 1")
def tsv_files(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.nullif(F.col("o_custkey") % 4, F.lit(0)).alias("v"))
    path = scratch(spark, "tsv")
    sinks.write_tsv(rows, path)
    found = spark.read.options(sep="\t", header=True).csv(path)
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") == "NA").alias("missing"))
