"""Genomic inputs derived from the given tables, as the same relation for Spark and for SQL.

The tables hold no sequences, so reads are put together from line items, and intervals, alignments and calls take their
positions from keys. Every relation has a row or a group for the rows of its table, so it grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT = "CASE WHEN l_linenumber = 1 THEN 'TGAGGG' WHEN l_linenumber = 2 THEN 'TTGGGG' WHEN l_quantity < 5 THEN 'TTAGG' ELSE 'TTAGGG' END"
PLACE = "(l_partkey * 7919 + l_orderkey * 31 + l_linenumber * 101) % 1000000"

#: Relations in SQL that both engines read alike; {table} stands for a table.
RELATIONS = {
    "telomeres": """
        SELECT concat('ctg', n_nationkey) AS contig, CAST(0 AS BIGINT) AS start, CAST(2000 + 100 * n_regionkey AS BIGINT) AS stop, '-' AS direction FROM {nation}
        UNION ALL SELECT concat('ctg', n_nationkey), CAST(997000 - 50 * n_regionkey AS BIGINT), CAST(1000000 AS BIGINT), '+' FROM {nation}""",
    "motifs": f"""
        SELECT concat('ctg', l_suppkey % 25) AS contig, CAST({PLACE} AS BIGINT) AS start, CAST({PLACE} + 6 + l_linenumber AS BIGINT) AS stop,
               CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS direction FROM {{lineitem}}""",
    "satellites": """
        SELECT concat('ctg', o_custkey % 25) AS contig, CAST((o_orderkey * 7907 + o_custkey * 13) % 1000000 AS BIGINT) AS start,
               CAST((o_orderkey * 7907 + o_custkey * 13) % 1000000 + 300 + o_custkey % 500 AS BIGINT) AS stop FROM {orders}""",
    "molecules": """
        SELECT event_id AS id, concat('ctg', user_id % 25) AS contig, CAST((event_id * 6151 + user_id * 97) % 1000000 AS BIGINT) AS position,
               concat('m', event_id % 500) AS name, value, event_type FROM {events}""",
    "alignments": f"""
        SELECT concat('r', l_orderkey) AS qname, CASE l_linenumber WHEN 2 THEN 16 WHEN 3 THEN 256 WHEN 4 THEN 2048 WHEN 5 THEN 4 ELSE 0 END AS flag,
               concat('ctg', l_suppkey % 25) AS rname, CAST({PLACE} AS BIGINT) AS pos, CAST({PLACE} + 20 * l_quantity AS BIGINT) AS stop,
               CAST(l_quantity + 10 AS INT) AS mapq, CAST(l_discount * 100 AS DOUBLE) AS nm, CAST(l_quantity * 2 AS DOUBLE) AS score FROM {{lineitem}}""",
    "loads": """
        SELECT concat('S', o_custkey % 40) AS sample, concat('chr', o_orderkey % 22 + 1, CASE WHEN o_custkey % 2 = 0 THEN 'p' ELSE 'q' END) AS assignment,
               CASE WHEN o_orderkey % 3 = 0 THEN 'PacBio' ELSE 'ONT' END AS tech, o_orderstatus AS status, o_totalprice AS load, o_orderkey AS id FROM {orders}""",
}
_ROTATIONS = {m: "', '".join(m[k:] + m[:k] for k in range(6)) for m in ("CCCTAA", "TTAGGG")}

#: Common table expressions for SQL: reads, their telomeres with the strand's hexamer, and the variant spans.
READS = f"""
units AS (SELECT l_suppkey AS id, l_orderkey, l_linenumber, l_quantity, {UNIT} AS m FROM lineitem),
joined AS (SELECT id, string_agg(m, '' ORDER BY l_orderkey, l_linenumber, l_quantity, m) AS s FROM units GROUP BY id),
reads AS (SELECT id, concat('S', id % 7) AS sample, concat('chr', id % 12 + 1, CASE WHEN id % 3 = 0 THEN 'q' ELSE 'p' END) AS assignment,
          concat('S', id % 7, '#', id % 2 + 1, '#ctg', id % 12) AS chrom, CASE WHEN id % 5 < 3 THEN 'ONT' ELSE 'PacBio' END AS tech,
          CASE WHEN id % 2 = 0 THEN s ELSE translate(reverse(s), 'ACGT', 'TGCA') END AS seq, length(s) - 10 * (id % 50) AS qend FROM joined)"""
SPANS = f"""{READS},
tails AS (SELECT *, right(seq, CAST(least(qend, length(seq)) AS INT)) AS telo FROM reads WHERE qend >= 100),
turns AS (SELECT *, len(list_filter(range(1, length(telo) - 4), lambda i: substr(telo, i, 6) IN ('{_ROTATIONS['CCCTAA']}'))) AS plus,
             len(list_filter(range(1, length(telo) - 4), lambda i: substr(telo, i, 6) IN ('{_ROTATIONS['TTAGGG']}'))) AS minus FROM tails),
telos AS (SELECT *, CASE WHEN plus = 0 AND minus = 0 THEN NULL WHEN plus >= minus THEN 'CCCTAA' ELSE 'TTAGGG' END AS motif FROM turns),
pieces AS (SELECT id, unnest(string_split(telo, motif)) AS piece, generate_subscripts(string_split(telo, motif), 1) AS k FROM telos WHERE motif IS NOT NULL),
sp AS (SELECT id, piece, length(piece) AS length, sum(length(piece) + 6) OVER (PARTITION BY id ORDER BY k) - length(piece) - 6 AS start FROM pieces),
spans AS (SELECT id, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, piece FROM sp WHERE length > 0 AND length <= 300)"""


def ctes(*names: str) -> str:
    """Relations as common table expressions over the registered tables."""
    tables = dict.fromkeys(("nation", "lineitem", "orders", "events", "embeddings"))
    return ",\n".join(f"{n} AS ({RELATIONS[n].format(**{t: t for t in tables})})" for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = RELATIONS[name]
    used = {t: table(spark, sf_dir, t) for t in ("nation", "lineitem", "orders", "events", "embeddings") if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read for each supplier: the units of its line items in order, on alternating strands."""
    units = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("u"))
    unit = UNIT.replace("l_", "x.l_")  # made after the sort, since equal numbers have equal units
    s = units.groupBy("id").agg(F.sort_array(F.collect_list("u")).alias("u")).selectExpr("id", f"array_join(transform(u, x -> {unit}), '') AS s")
    return s.selectExpr(
        "id", "concat('S', id % 7) AS sample", "concat('chr', id % 12 + 1, CASE WHEN id % 3 = 0 THEN 'q' ELSE 'p' END) AS assignment",
        "concat('S', id % 7, '#', id % 2 + 1, '#ctg', id % 12) AS chrom", "CASE WHEN id % 5 < 3 THEN 'ONT' ELSE 'PacBio' END AS tech",
        "CASE WHEN id % 2 = 0 THEN s ELSE translate(reverse(s), 'ACGT', 'TGCA') END AS seq", "length(s) - 10 * (id % 50) AS qend",
    )


def telomere_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with telo, its strand's hexamer and its variant spans."""
    from strandmill.functions import sequence

    rows = reads(spark, sf_dir).where("qend >= 100").withColumn("telo", sequence.telomere("seq", "qend"))
    rows = rows.withColumn("motif", sequence.repeat_motif("telo"))
    return rows.withColumn("spans", sequence.variant_spans("telo", motif="motif"))
