"""Byte-level BPE vocabulary files of the tokenizers library, loaded once in each Python worker."""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Pieces by id, ids by piece, and the library's own model for the merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        back = {letter: b for b, letter in enumerate(byte_letters())}
        self.specials = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.ids = {bytes(map(back.__getitem__, piece)): i for piece, i in file["model"]["vocab"].items()}
        pieces = {i: piece for piece, i in self.ids.items()} | {i: text.encode() for text, i in self.specials.items()}
        self.pieces = pa.array([pieces.get(i, b"") for i in range(max(pieces) + 1)], pa.binary())
        self.special = tuple(sorted(self.specials, key=lambda t: (-len(t), t)))  # of two that begin alike, the longer one counts

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens."""
        texts = [w.decode("utf-8") for w in words]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def letters(self, piece: bytes) -> str:
        table = byte_letters()
        return "".join(table[b] for b in piece)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of bytes by the merges alone."""
        return [t.id for t in self.tokenizer.model.tokenize(self.letters(piece))]


@functools.cache
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


def joined(ids: np.ndarray, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Joins ids to their pieces: the bytes of all, and where each begins and ends."""
    found = pieces.take(pa.array(ids))
    _, offsets, data = found.buffers()
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), np.frombuffer(offsets, np.int32)[: len(ids) + 1]
