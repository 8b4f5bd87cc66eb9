"""Byte-level BPE by a file of ranks: the tokenizers library over the distinct words of Arrow batches.

Each byte of a text stands for one letter of the library's byte table, so a rank file becomes a vocabulary of letters and
offsets in letters are offsets in bytes. Ranks say which joined bytes are a token, not which pair made it: every pair of tokens
that joins to a third is a merge, by the rank of the third and then the longer first half. Where two different pairs that join to
the same token overlap, the left one goes first; the few strings in which this order gives another are merged by joined().
Decoding turns letters back into bytes. A token may end within a character: its offsets in characters take in the
whole character, and streamed decoding gives the character to the token that completes it.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm import vocabulary
from strandmill.llm.pretokens import as_words, pretokens
from strandmill.llm.shared import batches, string_buffers

SLICE, SPAN_SLICE = 16 << 20, 4 << 20
KNOWN_WORDS, KNOWN_BYTES = 400_000, 16 << 20  # of a task's finished words; beyond these some are encoded again


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Ranks:
    """Tokens by rank, and the library's model for their merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"{path} has no rank for the bytes {missing[:8]}")
        table = vocabulary.byte_letters()
        self._letters = {b: table[b] for b in range(256)}
        back = {letter: b for b, letter in enumerate(table)}
        merges, self.ties = self._merges()
        letters = {self.letters(token): rank for token, rank in self.ranks.items()}
        self.tokenizer = Tokenizer(models.BPE(vocab=letters, merges=[(self.letters(a), self.letters(b)) for a, b in merges], ignore_merges=True))
        pieces = [b""] * (max(letters.values()) + 1)
        for token, rank in letters.items():
            pieces[rank] = bytes(map(back.__getitem__, token))
        self.pieces = pa.array(pieces, pa.binary())

    def letters(self, data: bytes) -> str:
        """One letter for each byte."""
        return data.decode("latin-1").translate(self._letters)

    def _merges(self) -> tuple[list[tuple[bytes, bytes]], tuple[bytes, ...]]:
        """All pairs in the order in which they merge, and the strings in which pairs of the same token overlap in another order.

        Such a string counts only if its three parts can stand side by side once all lower ranks are joined. What stands around
        it doesn't matter: a token that crosses its ends would undo the parts.
        """
        pairs = defaultdict(list)
        for token in self.ranks:
            for i in range(len(token) - 1, 0, -1):
                if token[:i] in self.ranks and token[i:] in self.ranks:
                    pairs[token].append((token[:i], token[i:]))
        ties = set()
        for token, splits in pairs.items():
            for k, (a, b) in enumerate(splits):
                for first, second in splits[:k]:  # these go first, and may stand right of (a, b)
                    if first == b and self.joined(a + token, self.ranks[token]) == [self.ranks[x] for x in (a, b, second)]:
                        ties.add(a + token)
        return [pair for token in sorted(pairs, key=self.ranks.__getitem__) for pair in pairs[token]], tuple(sorted(ties))

    def joined(self, word: bytes, below: int | None = None) -> list[int]:
        """Ids of a word: of the neighbours that join to the lowest rank (less than below), the leftmost are joined first."""
        if below is None and word in self.ranks:
            return [self.ranks[word]]
        n = len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at i: its end, and where the part before begins
        alive, waiting = [True] * n, []

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n:
                rank = self.ranks.get(word[i : end[end[i]]])
                if rank is not None and (below is None or rank < below):
                    heapq.heappush(waiting, (rank, i, end[end[i]]))

        for i in range(n - 1):
            offer(i)
        while waiting:
            _, i, stop = heapq.heappop(waiting)
            if alive[i] and end[i] < n and end[end[i]] == stop:
                alive[end[i]] = False
                end[i] = stop
                if stop < n:
                    before[stop] = i
                offer(i)
                offer(before[i])
        return [self.ranks[word[i : end[i]]] for i in range(n) if alive[i]]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word (a match of the pattern)."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast([self.letters(w) for w in words], add_special_tokens=False)]
        for k, word in enumerate(words) if self.ties else ():
            if any(t in word for t in self.ties):
                found[k] = self.joined(word)
        return found


@functools.cache
def load(path: str) -> Ranks:
    return Ranks(path)


class _Encoder:
    """Ids of the texts of a batch; what a task has finished is kept for its next batches, up to a bound."""

    def __init__(self, path: str):
        self.model, self.known, self.held = load(path), {}, 0

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, and where each text's begin and end."""
        bounds, first = pretokens(data, offsets)
        coded = as_words(data, bounds).dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        new = [w for w in words if w not in self.known]
        self.held += sum(map(len, new))
        if len(self.known) + len(new) > KNOWN_WORDS or self.held > KNOWN_BYTES:
            self.known, new, self.held = {}, words, sum(map(len, words))
        self.known |= zip(new, self.model.encode_words(new))
        found = [self.known[w] for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for f in found for i in f), np.uint32, int(sizes.sum()))
        begin, lengths = np.concatenate(([0], np.cumsum(sizes)))[:-1], sizes[codes]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        at = np.repeat(begin[codes] - ends[:-1], lengths) + np.arange(ends[-1]) if len(codes) else np.zeros(0, np.int64)
        return ids[at], ends[first]


def _over_texts(docs: DataFrame, finish, schema: str, path: str, size: int) -> DataFrame:
    """finish(encoder, doc ids, bytes, offsets) for slices of docs (doc_id, text) as rows of schema."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(path)
        for batch in batches(rows, size):
            data, offsets = string_buffers(batch.column("text"))
            yield finish(encoder, batch.column("doc_id"), data, offsets)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _pieces_of(model: Ranks, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    data, at = vocabulary.joined(ids, model.pieces)
    return data.tobytes(), at


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array<long>) of each row of docs (doc_id, text), as the rank file's own library encodes the whole text.

    Null counts as empty and has no ids; strings of special tokens are text like other. Null and repeated doc_ids are rows like
    others, further columns are not read, an empty table gives none. A long text is a slice of its own.
    """

    def finish(encoder: _Encoder, doc_ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        ids, ends = encoder(data, offsets)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int64)))
        return pa.RecordBatch.from_arrays([doc_ids, lists], names=["doc_id", "ids"])

    return _over_texts(docs, finish, "doc_id long, ids array<long>", path or default_path(), SPAN_SLICE)


SPANS = "doc_id long, tokens array<struct<id:long,byte_start:long,byte_end:long,char_start:long,char_end:long>>"


def encode_spans(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and tokens of each row of docs: ids with their place in the text, in bytes of UTF-8 and in characters.

    Bytes: tokens cover the text without gaps. Characters: from the one that holds the token's first byte to the one that
    holds its last, so tokens that share a character overlap by it. Rows as in encode().
    """

    def finish(encoder: _Encoder, doc_ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        ids, ends = encoder(data, offsets)
        sizes = pc.binary_length(encoder.model.pieces).to_numpy()[ids]
        stop = np.cumsum(sizes)
        start = stop - sizes  # a text's tokens cover it, so these are also places in data
        base = np.repeat(offsets[:-1], np.diff(ends))
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # characters that begin before each byte
        from_char = chars[np.minimum(start + 1, len(data))] - 1 - chars[base]
        columns = (ids, start - base, stop - base, from_char, chars[stop] - chars[base])
        fields = ("id", "byte_start", "byte_end", "char_start", "char_end")
        tokens = pa.StructArray.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], names=fields)
        return pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), tokens)], names=["doc_id", "tokens"])

    return _over_texts(docs, finish, SPANS, path or default_path(), SPAN_SLICE)


def _over_ids(rows: DataFrame, finish, schema: str, path: str) -> DataFrame:
    def run(batch_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batch_rows:
            lists = batch.column("ids").fill_null([])
            ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
            known = (ids >= 0) & (ids < len(model.pieces))
            ends = np.concatenate(([0], np.cumsum(known)))[ends]
            data, at = _pieces_of(model, ids[known].astype(np.uint32))
            yield finish(batch.column("doc_id"), data, at, ends)

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<long>").alias("ids")).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, data (bytes) and text of rows (doc_id, ids): the ids' letters turned back to bytes.

    Bytes that are no UTF-8, such as a character of which an id is missing, are U+FFFD in text. Null lists give nothing,
    and null ids or those without a token stand for no bytes.
    """

    def finish(doc_ids: pa.Array, data: bytes, at: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        raw = [data[at[a] : at[b]] for a, b in zip(ends[:-1], ends[1:])]
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())], names=["doc_id", "data", "text"])

    return _over_ids(rows, finish, "doc_id long, data binary, text string", path or default_path())


def decode_streamed(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and parts of rows (doc_id, ids): the text that each id completes, then what is left at the end.

    A character split over several ids comes with the last of them; joined, the parts are decode()'s text. One part for each
    id that has a token, and one more.
    """

    def finish(doc_ids: pa.Array, data: bytes, at: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        parts = []
        for a, b in zip(ends[:-1], ends[1:]):
            take = codecs.getincrementaldecoder("utf-8")("replace").decode
            parts.append([take(data[at[k] : at[k + 1]]) for k in range(a, b)] + [take(b"", True)])
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(parts, pa.list_(pa.string()))], names=["doc_id", "parts"])

    return _over_ids(rows, finish, "doc_id long, parts array<string>", path or default_path())


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs: its ids, and the bytes they decode to. Rows as in encode()."""

    def finish(encoder: _Encoder, doc_ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        ids, ends = encoder(data, offsets)
        little = memoryview(ids.astype("<u4").tobytes())
        decoded, at = _pieces_of(encoder.model, ids)
        raw, spans = memoryview(decoded), list(zip(ends[:-1].tolist(), ends[1:].tolist()))
        of_ids = [hashlib.sha256(little[4 * a : 4 * b]).hexdigest() for a, b in spans]
        of_bytes = [hashlib.sha256(raw[at[a] : at[b]]).hexdigest() for a, b in spans]
        columns = [doc_ids, pa.array(np.diff(ends)), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _over_texts(docs, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", path or default_path(), SLICE)


def op11_byte_ranks(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
