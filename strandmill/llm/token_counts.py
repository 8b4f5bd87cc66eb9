"""Exact token counts of every prefix of a text, by dynamic programming over BPE tokens.

The last token of a prefix's encoding is the one token that ends there and may follow the last token of the
shorter prefix before it; two tokens may follow each other if the merges leave their joined bytes as these two. So
the count at a prefix is the count at the shorter one plus one, and nothing is encoded twice. Different
pre-tokens of a batch are taken in sorted order, and share the counts of the prefix that they have in common. A
text's counts are those of its pre-tokens, each added to the count where it starts; where a prefix ends in a run of spaces,
the run up to there is a pre-token of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm import vocabulary
from strandmill.llm.pretokens import SPACE, as_words, class_table, pretokens
from strandmill.llm.shared import batches, string_buffers

LIMIT = 512
SLICE, BATCH = 32 << 20, 4 << 20


class PrefixCounter:
    """Token counts at all byte prefixes of pre-tokens."""

    def __init__(self, vocab: vocabulary.Vocabulary):
        self.vocab, self.ids = vocab, vocab.ids
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone = {i: vocab.merge(piece) == [i] for piece, i in self.ids.items()}
        self.piece = {i: piece for piece, i in self.ids.items()}
        sizes: dict[bytes, set[int]] = {}  # of the tokens of three bytes and more, by their last three
        for piece in self.ids:
            if len(piece) > 2:
                sizes.setdefault(piece[-3:], set()).add(len(piece))
        self.sizes = {end: (*sorted(found, reverse=True), 2, 1) for end, found in sizes.items()}

    def follows(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self.vocab.merge(self.piece[a] + self.piece[b]) == [a, b]
        return known

    def extend(self, word: bytes, last: list[int], count: list[int]) -> None:
        """Appends to last and count, which hold the prefixes before, those of the rest of word."""
        ids, sizes, pairs, alone = self.ids.get, self.sizes.get, self.pairs.get, self.alone
        for j in range(len(last), len(word) + 1):
            for size in sizes(word[j - 3 : j], (2, 1)) if j > 2 else (2, 1):
                i = j - size
                if i < 0 or (t := ids(word[i:j])) is None:
                    continue
                if i:
                    fits = pairs((last[i], t))
                    if fits is None:
                        fits = self.follows(last[i], t)
                else:
                    fits = alone[t]
                if fits:
                    last.append(t)
                    count.append(count[i] + 1)
                    break
            else:
                raise ValueError(f"no token ends at byte {j} of {word!r}")

    def counts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts at the prefixes of 1, 2, ... characters of all words, and where each word's counts begin and end."""
        order = sorted(range(len(words)), key=words.__getitem__)
        found: list[list[int]] = [[]] * len(words)
        before, last, count = b"", [-1], [0]
        for k in order:
            word = words[k]
            if word[:1] == b"'" and word[1:2] in (b"r", b"v", b"l") or word.decode("utf-8", "replace") in self.vocab.specials:
                found[k] = self.by_text(word)
                continue
            same, most = 0, min(len(before), len(word))
            while same < most and before[same] == word[same]:
                same += 1
            del last[same + 1 :], count[same + 1 :]
            self.extend(word, last, count)
            found[k] = count[1:] if word.isascii() else [count[j] for j in range(1, len(word) + 1) if j == len(word) or word[j] & 0xC0 != 0x80]
            before = word
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((c for f in found for c in f), np.int32, int(lengths.sum()))
        return flat, np.concatenate(([0], np.cumsum(lengths)))

    def count(self, text: bytes) -> int:
        """Tokens of a short text."""
        bounds, _ = pretokens(np.frombuffer(text, np.uint8), np.array([0, len(text)]), self.vocab.special)
        total = 0
        for a, b in zip(bounds[:-1], bounds[1:]):
            if text[a:b].decode() in self.vocab.specials:
                total += 1
                continue
            last, count = [-1], [0]
            self.extend(text[a:b], last, count)
            total += count[-1]
        return total

    def by_text(self, word: bytes) -> list[int]:
        """For the few words whose prefixes split into other pre-tokens."""
        text = word.decode()
        return [self.count(text[:j].encode()) for j in range(1, len(text) + 1)]


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(vocabulary.load(path))
    return _counters[path]


def prefix_counts(data: np.ndarray, offsets: np.ndarray, counter: PrefixCounter) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: the first and last, the token count at every prefix of 1, 2, ... characters, and where each
    text's counts begin and end. Different pre-tokens are counted once for all runs."""
    bounds, first = pretokens(data, offsets, counter.vocab.special)
    coded = as_words(data, bounds).dictionary_encode()
    codes = coded.indices.to_numpy()
    flat, begin = counter.counts(coded.dictionary.to_pylist())
    a = 0
    while a < len(offsets) - 1:
        b = min(max(int(np.searchsorted(offsets, offsets[a] + BATCH, side="right")) - 1, a + 1), len(offsets) - 1)
        own = slice(first[a], first[b])
        some, at = data[offsets[a] : offsets[b]], bounds[first[a] : first[b] + 1] - offsets[a]
        yield a, b, *_run_counts(some, offsets[a : b + 1] - offsets[a], at, first[a : b + 1] - first[a], codes[own], flat, begin, counter)
        a = b


def _run_counts(data, offsets, bounds, first, codes, flat, begin, counter) -> tuple[np.ndarray, np.ndarray]:
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    lengths = np.diff(begin)[codes]
    totals = flat[begin[1:] - 1][codes]
    running = np.concatenate(([0], np.cumsum(totals)))
    before = running[:-1] - np.repeat(running[first[:-1]], np.diff(first))  # the count of the text where each word starts
    place = np.cumsum(lengths) - lengths
    at = np.repeat(begin[codes] - place, lengths) + np.arange(int(lengths.sum()))
    counts = flat[at] + np.repeat(before, lengths).astype(np.int32)

    space = class_table()[data[bounds[:-1]]] == SPACE  # wider spaces begin with a byte of 0x80 or more
    space |= data[bounds[:-1]] >= 0x80
    starts = np.zeros(len(codes) + 1, bool)
    starts[first] = True
    raw = data.tobytes()
    for k in np.flatnonzero(space[1:] & space[:-1] & ~starts[1:-1]) + 1:
        run = raw[bounds[k - 1] : bounds[k]].decode()
        head = raw[bounds[k] : bounds[k + 1]].decode()[0]
        if run.isspace() and head.isspace():
            counts[place[k]] = before[k - 1] + counter.count((run + head).encode())
    for mark in (t.encode() for t in counter.vocab.special):
        if mark not in raw:
            continue
        for k in np.flatnonzero(np.diff(bounds) == len(mark)):
            if raw[bounds[k] : bounds[k + 1]] == mark and not starts[k]:  # its first characters join what stands before
                b = k - 1
                while not starts[b] and raw[bounds[b] : bounds[b + 1]].decode().isspace():
                    b -= 1
                for j in range(1, len(mark)):
                    counts[place[k] + j - 1] = before[b] + counter.count(raw[bounds[b] : bounds[k] + j])
    return counts, lead[offsets]


def count_tokens(docs: DataFrame, limit: int = LIMIT, path: str | None = None, with_prefixes: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_tokens, over_limit, fits_chars and, if asked for, prefix_counts.

    fits_chars is the length in characters of the longest prefix of at most limit tokens; prefix_counts
    holds the token count at each prefix of 1, 2, ... characters. Null counts as empty: no bytes, no tokens. Null
    and repeated ids are rows like others. Further columns are not read.
    """
    path = path or vocabulary.default_path()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches(rows, SLICE):
            data, offsets = string_buffers(whole.column("text"))
            for a, b, counts, begin in prefix_counts(data, offsets, counter(path)):
                yield answer(whole.slice(a, b - a), offsets[a : b + 1], counts, begin)

    def answer(batch: pa.RecordBatch, offsets: np.ndarray, counts: np.ndarray, begin: np.ndarray) -> pa.RecordBatch:
        size = np.diff(begin)
        total = np.zeros(len(size), np.int64)
        total[size > 0] = counts[begin[1:][size > 0] - 1]
        fits = np.zeros(len(size), np.int64)
        if len(counts):
            within = np.where(counts <= limit, np.arange(1, len(counts) + 1), 0)
            some = size > 0
            fits[some] = np.maximum(np.maximum.reduceat(within, begin[:-1][some]) - begin[:-1][some], 0)
        columns = [batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(total), pa.array(total > limit), pa.array(fits)]
        names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars"]
        if with_prefixes:
            columns.append(pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(counts)))
            names.append("prefix_counts")
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits_chars long" + ", prefix_counts array<int>" * with_prefixes
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
