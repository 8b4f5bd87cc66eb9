"""Pre-tokens of byte-level BPE vocabularies, found with array operations over a whole batch of texts.

The pattern is  's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ . Its tokens cover a
text without gaps, so they are known from the places where they start.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex

SPACE, LETTER, NUMBER, OTHER = range(4)


@functools.cache
def class_table() -> np.ndarray:
    """The class of each code point, as the tokenizers library has it.

    The library is asked about those that regex knows and Python's older tables don't.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    library, after = ByteLevel(add_prefix_space=False), {LETTER: "a", NUMBER: "1", OTHER: "!"}
    table = np.full(0x110000, OTHER, np.uint8)
    chars = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\x00" for c in range(0x110000))
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, chars):
            table[m.start() : m.end()] = kind
    for m in regex.finditer(r"\P{Cn}", chars):
        if unicodedata.category(m[0]) == "Cn":
            table[m.start()] = next((k for k, c in after.items() if len(library.pre_tokenize_str(c + m[0])) == 1), SPACE)
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte at which each begins."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.arange(len(data)) if len(points) == len(data) else np.flatnonzero((data & 0xC0) != 0x80)
    return points, at


def pretokens(data: np.ndarray, offsets: np.ndarray, special: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the pre-tokens (one more than there are), and the first pre-token of each text (one more).

    data, offsets: the bytes of all texts and where each begins and ends. Each occurrence of a string of special, the
    first of them that fits, is a token of its own, and the text before it ends there.
    """
    points, at = code_points(data)
    n = len(points)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, offsets)] = True
    first[n] = True
    inside = []
    if special:
        for m in re.finditer(b"|".join(re.escape(t.encode()) for t in special), data.tobytes()):
            i, j = np.searchsorted(at, [m.start(), m.end()])
            if not first[i + 1 : j].any():
                first[i] = first[j] = True
                inside.append((i, j))
    kind = class_table()[points]
    space = kind == SPACE
    start = first[:n].copy()
    start[1:] |= ~space[1:] & (kind[1:] != kind[:-1]) & (points[:-1] != 0x20)
    start[1:] |= space[1:] & ~space[:-1]
    start[:-1] |= space[:-1] & ~space[1:] & ~first[1:n]  # the last of several spaces stands alone or before a word
    follow = np.concatenate((points, np.zeros(3, np.uint32)))
    for i in np.flatnonzero((points == 0x27) & start):
        one = 0 if first[i + 1] else follow[i + 1]
        two = 0 if not one or first[i + 2] else follow[i + 2]
        size = 2 if one in (0x73, 0x74, 0x6D, 0x64) else 3 if (one, two) in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)) else 0
        if size:
            start[i + 1 : i + size] = False
            start[i + size : i + size + 1] = True
    for i, j in inside:
        start[i + 1 : j] = False
        start[i] = True
    bounds = np.concatenate((at[start], [len(data)]))
    return bounds, np.searchsorted(bounds, offsets)


def as_words(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The pre-tokens as an Arrow array over the same bytes."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
