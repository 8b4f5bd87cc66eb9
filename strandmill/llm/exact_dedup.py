"""Exact deduplication with an extendible-hash index on shared files.

The leading bits of a text's SHA-256 are its key, and the directory's leading bits of a key name its bucket. The
directory begins with as many buckets as the table's bytes ask for; a bucket that turns out overfull splits by the next
bit of its keys, and where it is as deep as the directory, the directory doubles. Map tasks
fold equal texts of a batch into one entry, entries go to the task that owns their bucket's range of keys, and an owner
task streams its entries in key order, chains those with equal keys and tells them apart by their bytes. The chains
decide what is a copy of what: a document belongs to the one chain of its key, or, where a key has several, to that with
its bytes. The index is a Parquet table in the shared folder.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.shared import batches, drop, keep, numbered, skew_join

BITS = 63  # of a key
BUCKET_BYTES, PER_ROOT = 16 << 20, 13
ENTRIES = "slot int, key long, body binary, keep_id long, keep_uid long, copies long"
INDEX = "bucket long, key long, chain int, chains int, n_bytes long, body binary, keep_id long, keep_uid long, group_size long"


def bucket_size(total: int) -> int:
    """Bytes that a bucket may hold: the number of buckets and their size both grow with the square root of the table."""
    return max(BUCKET_BYTES, PER_ROOT * math.isqrt(total))


class Directory:
    """2**depth slots, by the leading bits of a key. A bucket whose local depth is under the directory's fills several
    neighbouring slots; so only the first slot of each is held, with the bucket's name: a 1 and then its leading bits."""

    def __init__(self, depth: int = 0):
        self.depth = depth
        self.first = np.arange(1 << depth, dtype=np.int64)
        self.names = self.first + (1 << depth)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place among the buckets, in key order, of each key."""
        return np.searchsorted(self.first, keys >> (BITS - self.depth), side="right") - 1

    def split(self, names: Iterable[int]) -> None:
        """Each of the named buckets becomes two, by its next bit; the directory doubles if one is as deep as itself."""
        names = np.array(sorted(names), np.int64)
        local = np.array([int(n).bit_length() - 1 for n in names], np.int64)
        if len(names) and local.max() >= self.depth:
            self.depth += 1
            self.first = self.first * 2
        stay = ~np.isin(self.names, names)
        halves = np.concatenate((2 * names, 2 * names + 1))
        deep = np.concatenate((local, local)) + 1
        begin = (halves - (np.int64(1) << deep)) << (self.depth - deep)
        first, names = np.concatenate((self.first[stay], begin)), np.concatenate((self.names[stay], halves))
        order = np.argsort(first)
        self.first, self.names = first[order], names[order]


def _key(digest: bytes, bits: int) -> int:
    """The first bits of a digest as a number of BITS bits; fewer bits serve to force collisions."""
    return int.from_bytes(digest[:8], "big") >> (64 - bits) << (BITS - bits)


def _normal(batch: pa.RecordBatch) -> list[bytes]:
    return pc.ascii_lower(batch.column("text").fill_null("")).cast(pa.binary()).to_pylist()


def _documents(bits: int, with_body: bool):
    """doc_id, key, digest and, if asked for, body of each row."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            texts = _normal(batch)
            digests = [hashlib.sha256(t).digest() for t in texts]
            columns = [batch.column("doc_id"), pa.array([_key(d, bits) for d in digests], pa.int64()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.binary())] * with_body, names=["doc_id", "key", "digest", "body"][: 3 + with_body])

    return run


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (doc_id, uid), the one with the larger id, null last, then with the smaller uid."""
    return max(a, b, key=lambda x: (x[0] is not None, x[0] or 0, -x[1]))


def _entries(directory: Directory, bits: int):
    def fold(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            found: dict[bytes, list] = {}
            for i, uid, text in zip(batch.column("doc_id").to_pylist(), batch.column("uid").to_pylist(), _normal(batch)):
                entry = found.get(text)
                if entry is None:
                    found[text] = [i, uid, 1]
                else:
                    entry[0], entry[1] = _better((entry[0], entry[1]), (i, uid))
                    entry[2] += 1
            keys = np.fromiter((_key(hashlib.sha256(t).digest(), bits) for t in found), np.int64, len(found))
            ids, uids, copies = zip(*found.values())
            columns = [pa.array(directory.find(keys).astype(np.int32)), pa.array(keys), pa.array(list(found), pa.binary()), pa.array(ids, pa.int64()), pa.array(uids, pa.int64()), pa.array(copies, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["slot", "key", "body", "keep_id", "keep_uid", "copies"])

    return fold


def _own(names: np.ndarray):
    """Entries in key order become chains; a chain holds the different texts of one key, told apart by their bytes."""
    kinds = {"bucket": pa.int64(), "key": pa.int64(), "chain": pa.int32(), "chains": pa.int32(), "n_bytes": pa.int64(), "body": pa.binary(), "keep_id": pa.int64(), "keep_uid": pa.int64(), "group_size": pa.int64()}

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chain, done, held = None, [], [], 0
        for batch in rows:
            for slot, k, body, top, uid, copies in zip(*(batch.column(c).to_pylist() for c in ("slot", "key", "body", "keep_id", "keep_uid", "copies"))):
                if key != (slot, k):
                    done += [(int(names[key[0]]), key[1], n, len(chain), len(x[0]), *x) for n, x in enumerate(chain)]
                    held += sum(len(x[0]) for x in chain)
                    key, chain = (slot, k), []
                    if held > 8 << 20:
                        yield out(done)
                        done, held = [], 0
                for entry in chain:
                    if entry[0] == body:
                        entry[1], entry[2] = _better((entry[1], entry[2]), (top, uid))
                        entry[3] += copies
                        break
                else:
                    chain.append([body, top, uid, copies])
        done += [(int(names[key[0]]), key[1], n, len(chain), len(x[0]), *x) for n, x in enumerate(chain)]
        if done:
            yield out(done)

    return run


def build_index(docs: DataFrame, bucket_bytes: int | None = None, bits: int = BITS) -> tuple[DataFrame, Directory]:
    """The index of docs (doc_id, text, uid), in the shared folder, and its directory.

    A row for each different text: bucket, key, its place in the key's chain, how many chains the key has, its bytes, the id
    and uid of the row that stays, and the number of its rows. A bucket is overfull if it holds more than bucket_bytes
    besides its longest text, and splits unless all its keys are one.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bucket_bytes = bucket_bytes or bucket_size(total)
    directory = Directory(max(0, math.ceil(math.log2(max(total, 1) / bucket_bytes))))
    slots = len(directory.names)
    entries = docs.mapInArrow(_entries(directory, bits), ENTRIES).repartitionById(slots, F.col("slot"))
    index = keep(entries.sortWithinPartitions("slot", "key").mapInArrow(_own(directory.names), INDEX), "dedup-index")
    parts = [index]
    while True:
        sizes = index.groupBy("bucket").agg(F.sum("n_bytes").alias("b"), F.max("n_bytes").alias("m"), F.min("key").alias("k0"), F.max("key").alias("k1"))
        over = sizes.where((F.col("b") - F.col("m") > bucket_bytes) & (F.col("k0") < F.col("k1"))).select("bucket")
        found = [r["bucket"] for r in over.collect()]  # buckets, whose number grows with the square root of the table
        if not found:
            index.parts = parts  # the tables that it is read from
            return index, directory
        directory.split(found)
        over = F.broadcast(index.sparkSession.createDataFrame([(b,) for b in found], "bucket long"))
        local = F.length(F.bin("bucket")) - 1
        bit = F.expr("shiftright(key, CAST(_next AS INT))").bitwiseAND(1)
        halves = index.join(over, "bucket", "left_semi").withColumn("_next", BITS - 1 - local).withColumn("bucket", F.col("bucket") * 2 + bit).drop("_next")
        parts.append(keep(halves, "dedup-split"))  # only what splits is written again
        index = index.join(over, "bucket", "left_anti").unionByName(parts[-1])


def exact_groups(docs: DataFrame, bucket_bytes: int | None = None, bits: int = BITS) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after lower-casing A-Z; null counts as empty. The largest doc_id of a
    group stays; where all ids of a group are null, null does. Rows that repeat the kept id with the same text are one
    document and are all marked kept. An empty table gives no rows. Further columns are not read.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("uid"))
    index, _ = build_index(slim, bucket_bytes, bits)
    keys = keep(slim.mapInArrow(_documents(bits, False), "doc_id long, key long, digest binary"), "dedup-keys")
    groups = index.select("key", "chains", "keep_id", "group_size")
    found = skew_join(keys, groups.where("chains = 1").drop("chains"), "key", "group_size", keys.count())
    if not index.where("chains > 1").isEmpty():  # keys that several texts share: their documents go by their bytes
        several = index.where("chains > 1").select("key", "body", "keep_id", "group_size")
        rows = slim.mapInArrow(_documents(bits, True), "doc_id long, key long, digest binary, body binary")
        found = found.unionByName(rows.join(several, ["key", "body"]).drop("body"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, bucket_bytes: int | None = None, bits: int = BITS) -> DataFrame:
    """Of docs, one row for each different text, with its columns: that with the largest doc_id, or any of those that have it.

    Null counts as the empty text. A text whose ids are all null keeps one row too. Other columns may have any names.
    """
    rows, uid = numbered(docs)
    slim = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(uid).alias("uid"))
    index, _ = build_index(slim, bucket_bytes, bits)
    kept = keep(index.select(F.col("keep_uid").alias(uid)), "dedup-kept")
    for part in index.parts:  # it holds the bytes of all texts, and all that is asked of it is written
        drop(part)
    return rows.join(kept, uid, "left_semi").select(*docs.columns)


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
