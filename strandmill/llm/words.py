"""Lower-cased words of whole batches of texts, and their hashes, found with array operations."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
LONG = 64  # bytes


def mixed(h: np.ndarray) -> np.ndarray:
    """The hashes with all their bits stirred (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def lower(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte of the words [^\\x20\\x09-\\x0D]+, and the first word of each text (one more than texts)."""
    full = np.zeros(len(data) + 1, bool)
    full[:-1] = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = full.copy()
    start[1:] &= ~full[:-1] | edge[1:]
    end = np.zeros(len(data) + 1, bool)
    end[1:] = full[:-1] & (~full[1:] | edge[1:])
    starts = np.flatnonzero(start[:-1]) if len(data) else np.zeros(0, np.int64)
    return starts, np.flatnonzero(end), np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: bytes) -> np.ndarray:
    """A 64-bit hash of each of the runs of bytes, with a key of 16 bytes.

    Eight bytes at a time are mixed in, so whoever doesn't know the key can't write words that share a hash; long
    runs are hashed one by one.
    """
    size = ends - starts
    first, last = np.frombuffer(key, np.uint64, 2)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,))
    out = np.full(len(starts), first, np.uint64)
    short = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        left = size[short] - k
        short, left = short[left > 0], left[left > 0]
        if not len(short):
            break
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64))
        out[short] = mixed(out[short] ^ (eights[starts[short] + k] & mask))
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=key).digest(), "little")
    return mixed(out ^ (last + size.astype(np.uint64)))


def coded(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The place of each word among the different ones, and these."""
    edges = np.append(starts, len(data)).astype(np.int32)
    runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data.tobytes())])
    found = pc.ascii_rtrim(runs.cast(pa.string()), " \t\n\x0b\x0c\r").dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_pylist()
