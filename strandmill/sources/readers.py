"""Readers of the text formats. Each returns one DataFrame over all files of a path or glob, with a sample column where
files stand for samples; nothing is inferred and no file is opened by the driver."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.functions import identity
from strandmill.sources import schemas


def _table(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    return spark.read.schema(schema).options(**({"sep": "\t", "header": False, "mode": "PERMISSIVE"} | options)).csv(path)


def sample_name() -> Column:
    """The file's name up to its first dot."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)


def read_alias(spark: SparkSession, path: str) -> DataFrame:
    """id, chrom, contig, without a header."""
    return _table(spark, path, schemas.ALIAS)


def last_alias(alias: DataFrame, line: Column | None = None) -> DataFrame:
    """One chrom for each id: where an id repeats, that of its last line, by the file's order or by line."""
    order = alias.withColumn("_line", F.monotonically_increasing_id() if line is None else line)
    return order.groupBy("id").agg(F.max_by("chrom", "_line").alias("alias_chrom"))


def read_centered(spark: SparkSession, path: str, alias: DataFrame | None = None) -> DataFrame:
    """Centred reads by column position, the header row dropped, with sample, label and chrom_assignment.

    alias (id, chrom) names the chromosome of a contig; unknown contigs have no assignment. Without it (pedigree files)
    chrom is a chromosome name already.
    """
    wide = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(schemas.CENTERED_WIDTH)])
    raw = _table(spark, path, wide, header=True, enforceSchema=True)
    rows = raw.select(*(F.col(f"c{k}").cast(kind).alias(name) for k, (name, kind) in schemas.CENTERED_READS.items()), sample_name().alias("sample"))
    if alias is None:
        rows = rows.withColumn("alias_chrom", F.col("chrom"))
    else:
        rows = rows.join(last_alias(alias), rows["chrom"] == F.col("id"), "left").drop("id")
    return rows.withColumns({"chrom_assignment": identity.assignment("alias_chrom", "centering_position"), "label": identity.label("chrom")}).drop("alias_chrom")


def read_fiberseq(spark: SparkSession, path: str, columns: list[str], alias: DataFrame | None = None, share: float = 0.001, counts: Observation | None = None) -> DataFrame:
    """Reads from files with a header, by name, kept if they have enough m6A calls for their length.

    The length is that of the centred molecule, centered_query_end - centered_query_start; without these columns it is query_length.
    counts, an Observation, gets `reads` and `kept` of the same pass. Files that can't be read (cut-off or damaged gzip) are left out from the
    damage on; unreadable_files() names them.
    """
    raw = spark.read.options(sep="\t", header=True, ignoreCorruptFiles=True).csv(path).select(*columns, sample_name().alias("sample"))
    rows = raw.withColumns({c: F.col(c).cast("long") for c in ("centering_position", "centered_query_start", "centered_query_end", "query_length") if c in columns})
    if alias is not None:
        rows = rows.join(last_alias(alias), rows["chrom"] == F.col("id"), "left").drop("id")
        rows = rows.withColumn("chrom_assignment", identity.normalised(F.col("alias_chrom"), F.col("centering_position"))).drop("alias_chrom")
    centred = {"centered_query_start", "centered_query_end"} <= set(columns)
    length = F.col("centered_query_end") - F.col("centered_query_start") if centred else F.col("query_length")
    enough = identity.enough_calls("m6a_qual", length, share)
    if counts is not None:
        rows = rows.observe(counts, F.count(F.lit(1)).alias("reads"), F.count_if(enough).alias("kept"))
    return rows.where(enough)


def unreadable_files(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, reason of the gzip files that are damaged or cut off; each file is unpacked once by a task, in pieces.

    Other files are not looked at. A file is a row, so one has at most 2 GB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p.as_py(), len(c.as_buffer()), _damage(memoryview(c.as_buffer()))) for p, c in zip(batch.column("path"), batch.column("content"))]
            bad = [x for x in found if x[2]]
            if bad:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*bad), (pa.string(), pa.int64(), pa.string()))], names=["path", "bytes", "reason"])

    files = spark.read.format("binaryFile").load(path).where(F.col("path").endswith(".gz") & (F.col("length") > 0))
    return files.select("path", "content").mapInArrow(run, "path string, bytes long, reason string")


def _damage(data: memoryview, step: int = 1 << 20) -> str | None:
    """What is wrong with a gzip file; None if nothing is."""
    at = 0
    while at < len(data):
        member = zlib.decompressobj(31)
        try:
            while at < len(data) and not member.eof:
                piece = data[at : at + step]
                member.decompress(piece)
                at += len(piece) - len(member.unused_data)
        except zlib.error as e:
            return str(e)
        if not member.eof:
            return "the file ends before its data"
    return None


def read_bed(spark: SparkSession, path: str, schema: T.StructType = schemas.TELOMERES) -> DataFrame:
    """The first columns of a BED file by position; further ones are not read."""
    return _table(spark, path, schema)


def read_bed_intervals(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end of BED lines that aren't comments and have three fields."""
    parts = F.split("value", r"\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(parts) >= 3))
    return lines.select(parts[0].alias("chrom"), parts[1].cast("long").alias("start"), parts[2].cast("long").alias("end"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end and name of BED6 or BED12 lines, with arm and chrom_end ('chr1_p', by the start)."""
    rows = _table(spark, path, schemas.BED_NAMES)
    arm = F.when(F.col("start") < identity.ARM_POSITION, "p").otherwise("q")
    return rows.withColumns({"arm": arm, "chrom_end": F.concat_ws("_", "chrom", arm)})


def read_duplications(spark: SparkSession, path: str) -> DataFrame:
    """Duplicated variant repeats of a CSV file with a header, which may have more columns: chrom (arm:label), note and the places of both copies,
    with assignment and label from chrom."""
    rows = spark.read.options(header=True).csv(path)
    part = F.split("chrom", ":")
    places = [F.col(c).cast("double").alias(c) for c in ("code_start_1", "code_end_1", "code_start_2")]
    return rows.select("chrom", "note", *places, F.get(part, F.lit(0)).alias("assignment"), F.get(part, F.lit(1)).alias("label"))


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, schemas.MOTIFS)


def read_footprints(spark: SparkSession, path: str) -> DataFrame:
    """The header's first name begins with #, so # marks no comments here."""
    return _table(spark, path, schemas.FOOTPRINTS, header=True, enforceSchema=True)


def read_ancestry(spark: SparkSession, path: str) -> DataFrame:
    """Windows of local ancestry; the name holds id, haplotype and two components as ID/HAP/..._(PC1,PC2)."""
    rows = _table(spark, path, schemas.ANCESTRY)
    pattern = r"^([^/]+)/([^/]+)/.*_\(([^,]+),([^)]+)\)$"
    part = [F.nullif(F.regexp_extract("name", pattern, k), F.lit("")) for k in range(1, 5)]
    return rows.select("chrom", "start", "end", part[0].alias("id"), part[1].alias("hap"), part[2].cast("double").alias("pc1"), part[3].cast("double").alias("pc2"), "confidence")


def read_similarity(spark: SparkSession, path: str) -> DataFrame:
    """Pairwise similarities: names as strings, every sim_t column as float; which there are is read from the header."""
    rows = spark.read.options(header=True).csv(path)
    return rows.select(*(F.col(c).cast("float").alias(c) if c.startswith("sim_t") else F.col(c) for c in rows.columns))


def read_motif_counts(spark: SparkSession, path: str) -> DataFrame:
    """Motif, methylated and total counts of the lines of three fields, the header left out."""
    parts = F.split("value", r"\t")
    rows = spark.read.text(path).where(F.size(parts) == 3)
    rows = rows.select(parts[0].alias("motif"), parts[1].try_cast("long").alias("meth_count"), parts[2].try_cast("long").alias("total_count"))
    return rows.where(F.col("total_count").isNotNull())


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text, header lines left out; pos is 0-based, the fields from the twelfth on are tags."""
    f = F.split("value", r"\t")
    names = schemas.ALIGNMENT.fieldNames()
    rows = spark.read.text(path).where(~F.col("value").startswith("@"))
    kinds = [x.dataType for x in schemas.ALIGNMENT.fields]
    return rows.select(*((f[k] if n != "pos" else f[k].cast("long") - 1).cast(kinds[k]).alias(n) for k, n in enumerate(names[:-1])), F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))).alias("tags"))


def read_sam_header(spark: SparkSession, path: str) -> DataFrame:
    """value: the header lines of SAM text, in their order."""
    return spark.read.text(path).where(F.col("value").startswith("@"))


def read_paf(spark: SparkSession, path: str, keep_tags: str = "cg:") -> DataFrame:
    """Whole-genome alignments, with the tags that begin with keep_tags."""
    f = F.split("value", r"\t")
    names = schemas.PAF.fieldNames()
    kinds = [x.dataType for x in schemas.PAF.fields]
    tags = F.filter(F.slice(f, 13, F.greatest(F.size(f) - 12, F.lit(0))), lambda t: t.startswith(keep_tags))
    return spark.read.text(path).select(*(f[k].cast(kinds[k]).alias(n) for k, n in enumerate(names[:-1])), tags.alias("tags"))


def read_mapq_summary(spark: SparkSession, path: str) -> DataFrame:
    """threshold, passing, total of stored summaries: lines 'MAPQ>=Q: n', each followed by 'Total primary: N'."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"MAPQ>=?\d+: *\d+\s+Total primary: *\d+"), F.lit(0))).alias("v"))
    return lines.select(*(F.regexp_extract("v", r"MAPQ>=?(\d+): *(\d+)\s+Total primary: *(\d+)", k).cast("long").alias(n) for k, n in ((1, "threshold"), (2, "passing"), (3, "total"))))
