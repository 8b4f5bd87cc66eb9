"""Sinks. All write a folder of part files; a table without rows still writes its header or schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.sources.schemas import ALIGNMENT


ROWS = 200_000  # in a file of alignments


def in_ranges(df: DataFrame, by: list, partitions: int | None = None, rows: int | None = None) -> DataFrame:
    """df dealt out by ranges of by: to partitions, or to as many as give each about rows (ROWS) rows, so that a task's rows don't grow with the table."""
    return df.repartitionByRange(partitions or max(1, -(-df.count() // (rows or ROWS))), *by)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").options(header=True, sep=sep, emptyValue="", nullValue="NA" if sep == "\t" else "").csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """With a header; null is NA."""
    write_csv(df, path, "\t")


def write_sam(df: DataFrame, header: DataFrame, path: str, partitions: int | None = None) -> None:
    """Alignments as SAM text in coordinate order: the first file is the header's lines (value), the others hold ranges of (rname, pos).

    pos is 0-based in df and 1-based in the file. Without alignments there is the header alone. There is no BAM writer or reader here.
    """
    by = ("rname", "pos")
    ranged = in_ranges(df, by, partitions)
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("*")) if c != "pos" else (F.col("pos") + 1).cast("string") for c in ALIGNMENT.fieldNames()[:-1]]
    line = F.concat_ws("\t", *fields, F.col("tags"))
    header.select("value").coalesce(1).write.mode("overwrite").text(path)
    ranged.sortWithinPartitions(*by).select(line.alias("value")).write.mode("append").text(path)


def write_alignments(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Alignments as Parquet in coordinate order: files hold ranges of (rname, pos), sorted within."""
    by = ("rname", "pos")
    ranged = in_ranges(df, by, partitions)
    ranged.sortWithinPartitions(*by).write.mode("overwrite").parquet(path)
