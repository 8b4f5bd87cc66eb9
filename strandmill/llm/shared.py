"""Helpers that several of the training-data operators use."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A group that holds more than 1/HOT_SHARE of all rows is hot, so there are fewer than HOT_SHARE such groups.
HOT_SHARE = 512
REPEATS = 256  # rows in a bucket when those that are alike are numbered


@functools.cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_folder(spark.sparkContext.applicationId)
    return root


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def keep(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives a lost executor.

    The table is deleted by drop(), or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strandmill/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where, system = _path(spark, path)
    system.deleteOnExit(where)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def drop(kept: DataFrame) -> None:
    """Deletes a kept table that nothing reads any more."""
    where, system = _path(kept.sparkSession, kept.kept_at)
    system.delete(where, True)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, in the shared folder, and the new column's name, which docs has no column by.

    What is decided about a row is joined to it by this number: ids may be null or repeated.
    """
    name, taken = "_uid", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return keep(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def skew_join(rows: DataFrame, groups: DataFrame, on: str | list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to groups, of which there is one row for each value of on.

    count holds how many of the total rows a group has. Fewer than HOT_SHARE groups can hold more than
    total / HOT_SHARE rows, so these are broadcast; the others are shuffled, in pieces of bounded size.
    """
    on = [on] if isinstance(on, str) else on
    limit = max(total // HOT_SHARE, 1)
    hot, cold = groups.where(F.col(count) > limit), groups.where(F.col(count) <= limit)
    first = rows.join(F.broadcast(hot), on, "inner")
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how)
    return first.unionByName(rest)


def ranked(rows: DataFrame, by: list[str], bucket: str, order: list[str], wide: int = 4096) -> DataFrame:
    """rows with rank, from 0 within each value of by, in the order of bucket (a number from 0) and then order.

    Buckets are meant to be small, so no task gets all rows of a value. The first rank of each comes from sums over
    runs of wide buckets, and over these runs, so no task gets all buckets of a large table either.
    """
    sizes = rows.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("_n")).withColumn("_run", F.floor(F.col(bucket) / wide))
    ahead = Window.unboundedPreceding, -1
    runs = sizes.groupBy(*by, "_run").agg(F.sum("_n").alias("_m"))
    runs = runs.select(*by, "_run", F.coalesce(F.sum("_m").over(Window.partitionBy(*by).orderBy("_run").rowsBetween(*ahead)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy(*by, "_run").orderBy(bucket).rowsBetween(*ahead)), F.lit(0))
    first = sizes.withColumn("_inside", inside).join(runs, [*by, "_run"]).select(*by, bucket, (F.col("_before") + F.col("_inside")).alias("_first"))
    within = F.row_number().over(Window.partitionBy(*by, bucket).orderBy(*order)) - 1
    return rows.withColumn("_within", within).join(first, [*by, bucket]).withColumn("rank", F.col("_first") + F.col("_within")).drop("_within", "_first")


def told_apart(rows: DataFrame, columns: list[str], total: int) -> DataFrame:
    """rows (uid and others, total in number), in the shared folder, with h, a number that tells them apart.

    However rows are partitioned, h is the same set of numbers for the same values of columns. Rows that have all of these in
    common, such as those without an id, are numbered within buckets of some hundreds, so that none is too large for a task.
    """
    keyed = rows.withColumn("_k", F.xxhash64(*columns))
    again = keyed.groupBy("_k").agg(F.count(F.lit(1)).alias("_same")).where("_same > 1")
    met = skew_join(keyed, again, "_k", "_same", max(total, 1), "left")
    met = keep(met.withColumn("_place", F.pmod(F.xxhash64("uid"), F.ceil(F.col("_same") / REPEATS))), "apart")
    alike = ranked(met.where("_same IS NOT NULL"), ["_k"], "_place", ["uid"])
    one = met.where("_same IS NULL").withColumn("rank", F.lit(0).cast("long"))
    both = one.unionByName(alike.select(*one.columns)).withColumn("h", F.xxhash64("_k", "rank"))
    return keep(both.drop("_k", "_same", "_place", "rank"), "apart")


def uniform(*columns: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def batches(rows: Iterator[pa.RecordBatch], most_bytes: int = 48 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches, each of about most_bytes of text at most; one longer text is a slice of its own."""
    for batch in rows:
        if not batch.num_rows:
            continue
        _, offsets = string_buffers(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + most_bytes, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def in_docs(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over the consecutive runs that begin at first[:-1] and end at first[-1]."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]
