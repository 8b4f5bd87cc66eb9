"""Numbers by position as arrays that add up.

A task folds its rows into arrays by key and stretch of positions before anything is shuffled, so what is shuffled grows with keys
and stretches and not with bases. Arrays of a key are then summed in two levels, each in the order of keys, one array at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRETCH = 1024
HELD_BYTES = 64 << 20

Added = Iterator[tuple[int, int, np.ndarray]]  # a row of the batch with the key, the first position, positions x channels


def folded(rows: DataFrame, keys: list[str], columns: list[str], add: Callable[[pa.RecordBatch], Added], channels: int, finish: Callable[[int, np.ndarray], list], fields: str) -> DataFrame:
    """keys and fields: what finish(first position, positions x channels) makes of each stretch's sums, as columns of equal length.

    add gives the numbers (whole) of a batch with keys and columns. A key may be null. Sums are exact and don't depend on the partitioning.
    """
    kinds = dict(rows.dtypes)
    named = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    schema = f"{named}_stretch int, _data binary"

    def packed(held: dict, like: pa.Schema) -> pa.RecordBatch:
        names, stretches = [[k[i] for k, _ in held] for i in range(len(keys))], [s for _, s in held]
        arrays = [pa.array(n, like.field(k).type) for n, k in zip(names, keys)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(stretches, pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=[*keys, "_stretch", "_data"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * batch.num_rows
            for row, start, values in add(batch):
                done = 0
                while done < len(values):
                    stretch, at = divmod(start + done, STRETCH)
                    part = values[done : done + STRETCH - at]
                    into = held.get((names[row], stretch))
                    if into is None:
                        into = held[names[row], stretch] = np.zeros((STRETCH, channels), np.int64)
                    into[at : at + len(part)] += part
                    done += len(part)
                if len(held) * STRETCH * channels * 8 > HELD_BYTES:
                    yield packed(held, batch.schema)
                    held = {}
        if held:
            yield packed(held, batch.schema)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, np.ndarray, pa.Schema]]:
        now, total, like = None, None, None
        for batch in batches:
            like = batch.schema
            for row in zip(*(batch.column(c).to_pylist() for c in (*keys, "_stretch", "_data"))):
                values = np.frombuffer(row[-1], np.int64).reshape(STRETCH, channels)
                if row[:-1] == now:
                    total += values
                else:
                    if now is not None:
                        yield now[:-1], now[-1], total, like
                    now, total = row[:-1], values.copy()
        if now is not None:
            yield now[:-1], now[-1], total, like

    def middle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, stretch, total, like in sums(batches):
            yield packed({(key, stretch): total}, like)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, stretch, total, like in sums(batches):
            found = finish(stretch * STRETCH, total)
            many = len(found[0])
            if many:
                arrays = [pa.array([k] * many, like.field(n).type) for k, n in zip(key, keys)]
                yield pa.RecordBatch.from_arrays([*arrays, *found], names=[*keys, *names])

    names = [f.split()[0] for f in fields.split(", ")]
    parts = rows.select(*keys, *(c for c in columns if c not in keys)).mapInArrow(first, schema)
    level = math.isqrt(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if level > 8:  # else no key has enough parts to need it
        salt = F.pmod(F.spark_partition_id(), F.lit(level))
        parts = parts.withColumn("_salt", salt).repartition(*keys, "_stretch", "_salt").drop("_salt").sortWithinPartitions(*keys, "_stretch").mapInArrow(middle, schema)
    return parts.repartition(*keys, "_stretch").sortWithinPartitions(*keys, "_stretch").mapInArrow(last, f"{named}{fields}")


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of ASCII text, and where each row's begin and end; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), ends


def base_counts(text: str) -> Callable[[pa.RecordBatch], Added]:
    """Of a column of text: how often A, C, G and T stand at each place."""
    place = np.full(256, 4, np.int64)
    place[[ord(b) for b in "ACGT"]] = range(4)
    one = np.concatenate((np.eye(4, dtype=np.int64), np.zeros((1, 4), np.int64)))

    def add(batch: pa.RecordBatch) -> Added:
        data, ends = letters(batch.column(text))
        for k in range(batch.num_rows):
            yield k, 0, one[place[data[ends[k] : ends[k + 1]]]]

    return add


def call_counts(text: str, calls: str, target: str) -> Callable[[pa.RecordBatch], Added]:
    """Of molecules: at each place the calls on the target base, and the target bases."""

    def add(batch: pa.RecordBatch) -> Added:
        data, ends = letters(batch.column(text))
        bases = batch.column(target).to_pylist()
        lists = batch.column(calls).fill_null([])
        at = lists.offsets.to_numpy()
        found = lists.values.to_numpy(zero_copy_only=False)
        for k in range(batch.num_rows):
            own = data[ends[k] : ends[k + 1]] == ord(bases[k][0])
            mine = found[at[k] : at[k + 1]]
            mine = mine[(mine >= 0) & (mine < len(own))].astype(np.int64)  # a null call is NaN
            values = np.zeros((len(own), 2), np.int64)
            values[mine, 0] = 1
            values[:, 0] &= own
            values[:, 1] = own
            yield k, 0, values

    return add


def coverage(keys: list[str], start: str, stop: str, kind: str, kinds: list[str]) -> Callable[[pa.RecordBatch], Added]:
    """Of intervals: at each place, how many of each kind lie over it."""

    def add(batch: pa.RecordBatch) -> Added:
        begin, end = (batch.column(c).to_numpy() for c in (start, stop))
        channel = np.array([kinds.index(x) for x in batch.column(kind).to_pylist()], np.int64)
        names = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * batch.num_rows
        code: dict[tuple, int] = {}
        own = np.fromiter((code.setdefault(n, len(code)) for n in names), np.int64, len(names))
        order = np.argsort(own, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(own[order])) + 1) if len(order) else []:
            low = int(begin[rows].min())
            steps = np.zeros((int(end[rows].max()) - low + 1, len(kinds)), np.int64)
            np.add.at(steps, (begin[rows] - low, channel[rows]), 1)
            np.add.at(steps, (end[rows] - low, channel[rows]), -1)
            yield int(rows[0]), low, np.cumsum(steps, axis=0)[:-1]

    return add
