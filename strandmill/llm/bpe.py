"""BPE encoding and decoding through a table of distinct words.

Map tasks split blocks of texts into pre-tokens, replace each by its place in the block's own list of distinct
words, and send the words to the task that owns their hash. There each distinct word is encoded once, whichever
blocks it came from, and its ids go back to the places it had. Joined with the places that its texts are made of, a block
gives the ids of whole texts. Decoding joins ids with the pieces they stand for; that table has as many rows
as the vocabulary file has pieces, some 50,000, so each task holds it.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm import vocabulary
from strandmill.llm.pretokens import as_words, pretokens
from strandmill.llm.shared import batches, string_buffers

BLOCK_BYTES, LIST_BLOCK_BYTES = 24 << 20, 8 << 20  # smaller where ids themselves are returned
KNOWN_WORDS = 500_000
BLOCKS = "block long, part int, place int, doc_ids array<long>, firsts binary, lengths binary, data binary"  # place: in the row of texts, the number of words
CODEC = "zstd"


def pack(values: np.ndarray) -> bytes:
    """The values' own bytes, compressed, after their number of bytes."""
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, CODEC, asbytes=True) if raw else b"")


def unpack(packed: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    return np.frombuffer(pa.decompress(packed[8:], size, CODEC, asbytes=True) if size else b"", kind)


def _row(names: list[str], **columns) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "part": pa.int32(), "place": pa.int32(), "doc_ids": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds.get(n, pa.binary())) for n in names], names=names)


NAMES = ["block", "part", "place", "doc_ids", "firsts", "lengths", "data"]


def _blocks(path: str, parts: int, size: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        special = vocabulary.load(path).special
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches(rows, size):
            data, offsets = string_buffers(batch.column("text"))
            bounds, first = pretokens(data, offsets, special)
            coded = as_words(data, bounds).dictionary_encode()
            words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            part = np.fromiter((zlib.crc32(w) % parts for w in words), np.int32, len(words))
            order = np.argsort(part, kind="stable")  # words of a part get neighbouring places
            place = np.empty(len(words), np.int32)
            place[order] = np.arange(len(words), dtype=np.int32)
            # The name holds the contents too: should a task run again over rows in another order, its blocks have other names
            seen = hashlib.blake2b(repr((task, number, batch.column("doc_id").to_pylist())).encode(), digest_size=8)
            seen.update(offsets.tobytes())
            seen.update(np.ascontiguousarray(data))
            block = int.from_bytes(seen.digest(), "little", signed=True)
            out = [(block, -1, len(words), batch.column("doc_id").to_pylist(), pack(first.astype(np.int32)), b"", pack(place[codes] if len(codes) else codes))]
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                some = [words[k] for k in order[edges[p] : edges[p + 1]]]
                if some:
                    lengths = np.fromiter(map(len, some), np.int32, len(some))
                    out.append((block, p, int(edges[p]), None, b"", pack(lengths), pack(np.frombuffer(b"".join(some), np.uint8))))
            yield _row(NAMES, **dict(zip(NAMES, zip(*out))))
            number += 1

    return run


def _words_only(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        batch = batch.filter(pc.greater_equal(batch.column("part"), 0))
        if batch.num_rows:
            yield batch.select(["block", "part", "place", "lengths", "data"])


def _encode(path: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, known = vocabulary.load(path), {}
        for batch in rows:
            columns = (batch.column(c).to_pylist() for c in ("block", "place", "lengths", "data"))
            for block, place, lengths, data in zip(*columns):
                ends = np.cumsum(unpack(lengths, np.int32)).tolist()
                raw = unpack(data, np.uint8).tobytes()
                words = [raw[a:b] for a, b in zip([0, *ends], ends)]
                new = [w for w in words if w not in known]
                if len(known) + len(new) > KNOWN_WORDS:
                    known.clear()  # a part with more words than a task may hold encodes some again
                    new = words
                known |= zip(new, vocab.encode_words(new))
                found = [known[w] for w in words]
                sizes = np.fromiter(map(len, found), np.int32, len(found))
                ids = np.fromiter((i for f in found for i in f), np.int32, int(sizes.sum()))
                yield _row(["block", "place", "lengths", "data"], block=[block], place=[place], lengths=[pack(sizes)], data=[pack(ids)])

    return run


def _assemble(finish: Callable[[list, np.ndarray, np.ndarray], pa.RecordBatch], step: int = 1_000_000):
    """Ids of the texts of a block, for runs of about step words: finish(doc ids, ids, where each text's begin)."""

    def run(block: pa.Table, words: pa.Table) -> pa.Table:
        row = next((r for r in block.to_pylist() if r["part"] == -1), None)
        parts = sorted(zip(*(words.column(c).to_pylist() for c in ("place", "lengths", "data"))))
        sizes = np.concatenate([np.zeros(0, np.int32), *(unpack(p[1], np.int32) for p in parts)])
        ids = np.concatenate([np.zeros(0, np.int32), *(unpack(p[2], np.int32) for p in parts)])
        if row is None or len(sizes) != row["place"]:
            raise RuntimeError("a block and its words come from different runs of a task: write the documents to a table first")
        first, codes = unpack(row["firsts"], np.int32), unpack(row["data"], np.int32)
        begin = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        out, a = [], 0
        while a < len(first) - 1:
            b = min(max(int(np.searchsorted(first, first[a] + step, side="right")) - 1, a + 1), len(first) - 1)
            own = codes[first[a] : first[b]]
            lengths = sizes[own]
            ends = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
            at = np.repeat(begin[own] - ends[:-1], lengths) + np.arange(ends[-1])
            out.append(finish(row["doc_ids"][a:b], ids[at], ends[first[a : b + 1] - first[a]]))
            a = b
        return pa.Table.from_batches(out)

    return run


def encode_with(docs: DataFrame, finish: Callable, schema: str, path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Encodes docs (doc_id, text); finish makes rows of schema from runs of whole texts."""
    path = path or vocabulary.default_path()
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tasks = slim.rdd.getNumPartitions()
    parts = min(max(tasks, 16), max(2048, 8 * math.isqrt(tasks)))  # a block has a row for each, so they grow slower than blocks
    # one exchange serves both branches: each takes its own rows of it
    blocks = slim.mapInArrow(_blocks(path, parts, block_bytes), BLOCKS).repartition(F.col("block"))
    words = blocks.mapInArrow(_words_only, "block long, part int, place int, lengths binary, data binary").repartitionById(parts, F.col("part"))
    encoded = words.mapInArrow(_encode(path), "block long, place int, lengths binary, data binary")
    return blocks.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(_assemble(finish), schema)


def _lists(doc_ids: list, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of each row of docs, as the tokenizers library encodes the whole text.

    Null counts as empty and has no ids. Null and repeated doc_ids are rows like others; further columns are not read.
    Special strings in a text are special tokens, as is the library's default.
    """
    return encode_with(docs, _lists, "doc_id long, ids array<int>", path, LIST_BLOCK_BYTES)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids): the pieces of the ids, joined; bytes that are no UTF-8 become U+FFFD.

    Null ids give an empty text. Ids outside the vocabulary give nothing, as in the library.
    """
    path = path or vocabulary.default_path()

    def run(batch_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary.load(path).pieces
        for batch in batch_rows:
            lists = batch.column("ids").fill_null([])
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
            known = (ids >= 0) & (ids < len(pieces))
            ends = np.concatenate(([0], np.cumsum(known)))[ends]
            data, at = vocabulary.joined(ids[known].astype(np.int32), pieces)
            raw = data.tobytes()
            texts = [raw[at[a] : at[b]].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def _digests(path: str):
    def finish(doc_ids: list, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        pieces = vocabulary.load(path).pieces
        numbers = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids).cast(pa.string())), ",")
        data, at = vocabulary.joined(ids, pieces)
        raw = memoryview(np.ascontiguousarray(data))

        def decoded(a: int, b: int) -> str:
            text = bytes(raw[at[a] : at[b]]).decode("utf-8", "replace")
            return hashlib.sha256(text.encode()).hexdigest()

        shas = [hashlib.sha256(n.as_buffer()).hexdigest() for n in numbers]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, pa.int64()), pa.array(np.diff(ends)), pa.array(shas, pa.string()), pa.array([decoded(a, b) for a, b in zip(ends[:-1], ends[1:])], pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return finish


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs: its ids, and the text they decode to."""
    path = path or vocabulary.default_path()
    return encode_with(docs, _digests(path), DIGESTS, path)


def _checked(path: str):
    digests = _digests(path)

    def finish(doc_ids: list, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        found = digests(doc_ids, ids, ends)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
        return pa.RecordBatch.from_arrays([found.column("doc_id"), found.column("n_tokens"), lists, found.column("decoded_sha256")], names=["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return finish


def encode_checked(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, and the SHA-256 of the text that the ids decode to, of each row of docs."""
    path = path or vocabulary.default_path()
    return encode_with(docs, _checked(path), "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string", path, LIST_BLOCK_BYTES)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
