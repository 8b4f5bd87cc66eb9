"""Language identification with segmentation-marginalised unigrams.

The pieces are those of a public vocabulary. Each language has a probability for every piece; the probability of
a word is the sum over all ways to cut it into pieces, which the forward algorithm adds up from left to right. Piece
probabilities are learned by expectation and maximisation: backward sums tell how often each piece is expected
in the words of a language. A text's score is the posterior of its words.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm import words as W
from strandmill.llm.shared import batches, in_docs, string_buffers, uniform

SAMPLE_DOCS, SAMPLE_BYTES = 500, 1 << 20  # labelled documents of a language to learn from; none is longer than that
ROUNDS = 4
PRIOR = 0.01
BATCH = 16 << 20
FOREIGN = 1e-7  # the probability of a character that no piece covers
RESCALE = 8  # letters after which the sums are scaled, so that those of long words don't vanish


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary's pieces of letters, lower-cased; every letter is a piece too."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {model.id_to_piece(i).replace("▁", "").lower() for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_byte(i)}
        found |= {c for p in found for c in p}
        self.names = sorted(p for p in found if p.isalpha())
        self.longest = max(map(len, self.names))
        keys = self.keys([p for p in self.names])
        self.order = np.argsort(keys)
        self.sorted = keys[self.order]

    @staticmethod
    def keys(pieces: list[str]) -> np.ndarray:
        """A hash of each piece, as windows() makes it."""
        out = np.zeros(len(pieces), np.uint64)
        for k, p in enumerate(pieces):
            h = 0
            for c in p:
                h = (h * 0x100000001B3 + ord(c) + 1) % (1 << 64)
            out[k] = h
        return out

    def windows(self, points: np.ndarray) -> Iterator[list[np.ndarray]]:
        """For words of one length, rows of points, at each letter: the pieces that the letter, it and the next, ... are, or -1."""
        n = points.shape[1]
        for i in range(n):
            h, row = np.zeros(len(points), np.uint64), []
            for s in range(1, min(self.longest, n - i) + 1):
                h = h * np.uint64(0x100000001B3) + points[:, i + s - 1].astype(np.uint64) + np.uint64(1)
                at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
                row.append(np.where(self.sorted[at] == h, self.order[at], -1).astype(np.int32))
            yield row


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and code points of the words of each length."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(length):
        if n:
            at = np.flatnonzero(length == n)
            raw = "".join(words[k] for k in at).encode("utf-32-le")
            yield at, np.frombuffer(raw, np.uint32).reshape(len(at), n)


def _step(piece: np.ndarray, size: int, prob: np.ndarray) -> np.ndarray:
    """The probabilities of a piece of so many letters in each language. prob has a last row of zeros for -1."""
    return np.where((piece < 0)[:, None], FOREIGN, prob[piece]) if size == 1 else prob[piece]


def forward(points: np.ndarray, prob: np.ndarray, own: Pieces) -> np.ndarray:
    """Of words of one length: [word, language], the log of the summed probability of all cuts into pieces.

    Only the sums that pieces still reach are held, so a word may be of any length.
    """
    m, n = points.shape
    ring = np.zeros((own.longest + 1, m, prob.shape[1]))  # sums of the letters before i at i modulo its length
    ring[0], scale = 1, np.zeros((m, prob.shape[1]))
    for i, row in enumerate(own.windows(points)):
        here = ring[i % len(ring)].copy()
        ring[i % len(ring)] = 0
        for s, piece in enumerate(row, 1):
            ring[(i + s) % len(ring)] += here * _step(piece, s, prob)
        if i % RESCALE == RESCALE - 1:
            most = ring.max(axis=0)
            ring /= most
            scale += np.log(most)
    return np.log(ring[n % len(ring)]) + scale


def _sums(windows: list[list[np.ndarray]], prob: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward sums [position, word, language] of words of one length, and the logs of what each is scaled by."""
    n, m, k = len(windows), len(windows[0][0]), prob.shape[1]
    alpha, beta = np.zeros((n + 1, m, k)), np.zeros((n + 1, m, k))
    up, down = np.zeros((n + 1, m, k)), np.zeros((n + 1, m, k))
    alpha[0], beta[n] = 1, 1
    longest = max(map(len, windows))
    for i, row in enumerate(windows):
        for s, piece in enumerate(row, 1):
            alpha[i + s] += alpha[i] * _step(piece, s, prob)
        if i % RESCALE == RESCALE - 1 and i < n - 1:
            ahead = slice(i + 1, min(i + longest, n) + 1)
            most = alpha[ahead].max(axis=0)
            alpha[ahead] /= most
            up[i + 1 :] += np.log(most)
    for i in range(n - 1, -1, -1):
        for s, piece in enumerate(windows[i], 1):
            # sums from further on may have been scaled less than those here
            beta[i] += _step(piece, s, prob) * beta[i + s] * np.exp(down[i + s] - down[i])
        if (n - i) % RESCALE == 0 and i:
            most = beta[i].copy()
            beta[i] = 1
            down[: i + 1] += np.log(most)
    return alpha, up, beta, down


def learn(words: list[str], counts: np.ndarray, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities [piece + 1, language] from words and how often each language has them [word, language]."""
    own = pieces(path)
    groups = [(at[a : a + 5000], points[a : a + 5000]) for at, points in by_length(words) for a in range(0, len(at), 5000)]
    prob = np.full((len(own.names) + 1, counts.shape[1]), 1 / len(own.names))
    prob[-1] = 0
    for _ in range(rounds):
        expected = np.full_like(prob, PRIOR)
        for at, points in groups:
            windows = list(own.windows(points))
            alpha, up, beta, down = _sums(windows, prob)
            whole = np.log(alpha[-1]) + up[-1]
            for i, row in enumerate(windows):
                for s, piece in enumerate(row, 1):
                    known = piece >= 0
                    share = alpha[i] * prob[piece] * beta[i + s] * np.exp(up[i] + down[i + s] - whole) * counts[at]
                    if known.any():
                        np.add.at(expected, piece[known], share[known])
        expected[-1] = 0
        prob = expected / expected.sum(axis=0)
    return prob


def word_scores(words: list[str], prob: np.ndarray, path: str) -> np.ndarray:
    """Log probability of each word in each language, [word, language]; an empty word has 0."""
    own, out = pieces(path), np.zeros((len(words), prob.shape[1]))
    for at, points in by_length(words):
        for a in range(0, len(at), 20_000):
            out[at[a : a + 20_000]] = forward(points[a : a + 20_000], prob, own)
    return out


_LETTERS, _WORDS = regex.compile(r"\P{L}+"), regex.compile(r"\p{L}+")  # as in train()


def letters_of(word: str) -> str:
    return _LETTERS.sub("", word.lower())


def train(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities from about sample_docs documents of each language that have a text and aren't held out.

    The sample is by a hash of doc_id and text, among those of at most SAMPLE_BYTES; all its words are learned from.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & (F.octet_length("text") <= SAMPLE_BYTES))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((len(pieces(path).names) + 1, 0))
    share = F.element_at(F.create_map(*(F.lit(x) for pair in sizes.items() for x in (pair[0], sample_docs / pair[1]))), F.col("lang"))
    rows = known.where(uniform("doc_id", "text", seed=4) < share).select("lang", "text")
    each = rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).where("word <> ''")
    found = each.groupBy("word").agg(*(F.count_if(F.col("lang") == x).alias(f"n{k}") for k, x in enumerate(langs))).toArrow().sort_by("word")
    words = found.column("word").to_pylist()
    counts = np.stack([found.column(f"n{k}").to_numpy() for k in range(len(langs))], axis=1).astype(float).reshape(len(words), len(langs))
    return langs, learn(words, counts, path)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def score_texts(data: np.ndarray, offsets: np.ndarray, prob: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Summed log probabilities [text, language], and the letters of each text."""
    starts, _, first = W.words(data, offsets)
    if not len(starts):
        return np.zeros((len(offsets) - 1, prob.shape[1])), np.zeros(len(offsets) - 1, np.int64)
    codes, runs = W.coded(data, starts)
    found = [_WORDS.findall(r.lower()) for r in runs]  # a run between blanks may hold several words
    owner = np.repeat(np.arange(len(runs)), list(map(len, found)))
    coded = pa.array([w for f in found for w in f], pa.string()).dictionary_encode()
    words = coded.dictionary.to_pylist()
    places = coded.indices.to_numpy()
    score = word_scores(words, prob, path)[places]
    length = np.fromiter(map(len, words), np.int64, len(words))[places]
    sums = [np.bincount(owner, score[:, k], len(runs)) for k in range(score.shape[1])]
    total = np.stack([in_docs(x[codes], first) for x in sums], axis=1) if sums else np.zeros((len(first) - 1, 0))
    return total, in_docs(np.bincount(owner, length, len(runs)).astype(np.int64)[codes], first)


def identify(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score.

    score is the posterior of the language, with equal priors. A text that is null or has no letters is 'und' with
    score 0, as is every text if there is nothing to learn from. Ties go to the first language by code point. Null
    and repeated ids are rows like others. docs needs doc_id, text and lang.
    """
    path = path or default_path()
    langs, prob = train(docs, path)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, BATCH):
            total, letters = score_texts(*string_buffers(batch.column("text")), prob, path)
            if langs:
                best = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            else:
                best, share, letters = np.zeros(len(letters), int), np.zeros(len(letters)), letters * 0
            names = [langs[b] if n else "und" for b, n in zip(best, letters)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(np.where(letters > 0, share, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id").cast("long")).alias("held_out"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op4_language(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
