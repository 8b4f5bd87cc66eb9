"""The stateless operators on a stream of read files; an addition, as all else here is batch work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions import sequence


def stream_loads(reads: DataFrame, seq: str = "query_sequence", end: str = "centered_query_end", least: int = 100) -> DataFrame:
    """reads with telo, spans and load, row by row, so it runs on a streaming DataFrame as on a batch one."""
    rows = reads.withColumn("telo", sequence.telomere(seq, end, least))
    rows = rows.withColumn("spans", sequence.variant_spans("telo"))
    return rows.withColumn("load", sequence.span_load("spans"))


def append_loads(reads: DataFrame, path: str, checkpoint: str):
    """Appends the loads of new files to a Parquet table once; returns the query that has ended."""
    rows = stream_loads(reads).drop("spans")
    query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
