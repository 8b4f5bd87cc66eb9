"""The BAM format: BGZF blocks, records to and from Arrow batches, and the index of 16-kilobase windows and bins."""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed values of the format.
BASES = "=ACMGRSVTWYHKDBN"
OPERATIONS = "MIDNSHP=X"
CONSUMES_REFERENCE = "MDN=X"
END_OF_FILE = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK_BYTES = 0xFF00
LINEAR, LARGEST_BIN = 14, 37449
_FIXED = np.dtype([
    ("ref", "<i4"), ("pos", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"), ("size", "<i4"), ("next_ref", "<i4"), ("next_pos", "<i4"), ("tlen", "<i4"),
])
_NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
_OP = re.compile(rb"(\d+)([MIDNSHP=X])")


def block(data: bytes) -> bytes:
    """One BGZF block."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def blocks(read, start: int, stop: int | None = None, step: int = 4 << 20) -> Iterator[tuple[int, bytes]]:
    """Where each block from start on begins, and what it holds; blocks that begin after stop aren't read. read(offset, size) gives bytes."""
    held, at = b"", start
    while stop is None or at <= stop:
        want = step if stop is None else min(step, max(stop - at, 0) + 0x10000 - len(held))
        more = read(at + len(held), max(want, 18)) if len(held) < 0x10000 else b""
        held += more
        if not held:
            return
        used = 0
        while len(held) - used >= 18 and (stop is None or at + used <= stop):
            if held[used : used + 4] != b"\x1f\x8b\x08\x04":
                raise ValueError(f"no BGZF block begins at byte {at + used}")
            (extra,) = struct.unpack_from("<H", held, used + 10)
            size, k = 0, used + 12
            while k + 4 <= used + 12 + extra:
                kind, length = held[k : k + 2], struct.unpack_from("<H", held, k + 2)[0]
                if kind == b"BC":
                    size = struct.unpack_from("<H", held, k + 4)[0] + 1
                k += 4 + length
            if not size:
                raise ValueError(f"the gzip member at byte {at + used} has no BGZF size")
            if len(held) - used < size:
                break
            data = zlib.decompress(held[used + 12 + extra : used + size - 8], -15)
            if (zlib.crc32(data), len(data)) != struct.unpack_from("<II", held, used + size - 8):
                raise ValueError(f"the BGZF block at byte {at + used} is damaged")
            yield at + used, data
            used += size
        if not used and not more:
            raise ValueError(f"the file ends within the BGZF block at byte {at}")
        held, at = held[used:], at + used


@dataclass
class Header:
    """Text, references (name, length) in their order, and where the records begin, as a virtual offset."""

    text: str
    references: list[tuple[str, int]]
    records: int = 0

    @staticmethod
    def of(text: str) -> Header:
        """A header from the lines of SAM text; the references are its @SQ lines."""
        text = text if text.endswith("\n") or not text else text + "\n"
        found = []
        for line in text.splitlines():
            if line.startswith("@SQ\t"):
                tags = dict(t.split(":", 1) for t in line.split("\t")[1:])
                found.append((tags["SN"], int(tags["LN"])))
        return Header(text, found)

    def packed(self) -> bytes:
        out = [b"BAM\1", struct.pack("<i", len(self.text.encode())), self.text.encode(), struct.pack("<i", len(self.references))]
        for name, length in self.references:
            out.append(struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length))
        return b"".join(out)


def read_header(read) -> Header:
    """The header of a BAM file."""
    data, begins, source = b"", [], blocks(read, 0)

    def need(n: int) -> None:
        nonlocal data
        while len(data) < n:
            at, more = next(source, (0, None))
            if more is None:
                raise ValueError("the file ends within its header")
            begins.append((len(data), at))
            data += more

    need(8)
    if data[:4] != b"BAM\1":
        raise ValueError("no BAM file")
    size = struct.unpack_from("<i", data, 4)[0]
    need(12 + size)
    text, k = data[8 : 8 + size].rstrip(b"\0").decode(), 12 + size
    references = []
    for _ in range(struct.unpack_from("<i", data, 8 + size)[0]):
        need(k + 4)
        n = struct.unpack_from("<i", data, k)[0]
        need(k + 8 + n)
        references.append((data[k + 4 : k + 3 + n].decode(), struct.unpack_from("<i", data, k + 4 + n)[0]))
        k += 8 + n
    try:
        need(k + 1)  # the record after it may begin in the next block
    except ValueError:
        pass
    first, at = begins[bisect_right(begins, (k, 1 << 62)) - 1]
    return Header(text, references, at << 16 | (k - first))


def whole(data: bytes) -> tuple[np.ndarray, int]:
    """Where each whole record of data begins, after its size, and where the first that isn't whole begins."""
    starts, at, n = [], 0, len(data)
    size = struct.Struct("<i").unpack_from
    while at + 4 <= n:
        end = at + 4 + size(data, at)[0]
        if end > n:
            break
        if end < at + 36:
            raise ValueError("a record is shorter than its fixed fields")
        starts.append(at + 4)
        at = end
    return np.array(starts, np.int64), at


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of bytes one after another, and where each begins and ends."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    return data[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])], ends


def _strings(data: np.ndarray, ends: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    out = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return (out if null is None else pc.if_else(pa.array(null), "*", out)).cast(pa.string())


def _cigars(words: np.ndarray, ends: np.ndarray) -> pa.Array:
    """CIGAR text from packed operations."""
    letters = pa.array(list(OPERATIONS)).take(pa.array(np.minimum(words & 15, 8)))
    each = pc.binary_join_element_wise(pa.array(words >> 4).cast(pa.string()), letters, "")
    return pc.if_else(pa.array(np.diff(ends) == 0), "*", pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), each), ""))


def _tags(data: bytes, at: int, end: int) -> tuple[list[str], np.ndarray | None]:
    """Optional fields as SAM text, and the operations of a CIGAR that is too long for the record's own field."""
    out, long = [], None
    while at + 3 <= end:
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            stop = data.index(b"\0", at)
            out.append(f"{name}:{kind}:{data[at:stop].decode()}")
            at = stop + 1
        elif kind == "A":
            out.append(f"{name}:A:{chr(data[at])}")
            at += 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            values = np.frombuffer(data, np.dtype("<" + _NUMBERS[sub]), n, at + 5)
            at += 5 + values.nbytes
            if name == "CG" and sub == "I":
                long = values
            else:
                out.append(f"{name}:B:{sub}" + "".join(f",{v:g}" if sub == "f" else f",{v}" for v in values.tolist()))
        else:
            (value,) = struct.unpack_from("<" + _NUMBERS[kind], data, at)
            out.append(f"{name}:f:{value:g}" if kind == "f" else f"{name}:i:{value}")
            at += struct.calcsize(_NUMBERS[kind])
    return out, long


def decoded(data: bytes, starts: np.ndarray, references: list[tuple[str, int]], keep=None) -> tuple[pa.RecordBatch, np.ndarray]:
    """The records that begin at starts as columns of SAM text, pos 0-based, and which of them keep(fixed fields) lets stay."""
    raw = np.frombuffer(data, np.uint8)
    fixed = raw[starts[:, None] + np.arange(32)].view(_FIXED).ravel()
    stays = np.ones(len(starts), bool) if keep is None else keep(fixed)
    starts, fixed = starts[stays], fixed[stays]
    sizes = np.array([struct.unpack_from("<i", data, s - 4)[0] for s in starts.tolist()], np.int64)
    name = starts + 32
    ops = name + fixed["name"]
    seq = ops + 4 * fixed["ops"].astype(np.int64)
    length = fixed["size"].astype(np.int64)
    qual = seq + (length + 1) // 2
    end = qual + length
    words, word_ends = _gathered(raw, ops, 4 * fixed["ops"].astype(np.int64))
    cigars = _cigars(words.view("<u4") if len(words) else np.zeros(0, np.uint32), word_ends // 4)
    tags, replaced = [], {}
    for k, (a, b) in enumerate(zip(end.tolist(), (starts + sizes).tolist())):
        found, long = _tags(data, a, b)
        tags.append(found)
        if long is not None:
            replaced[k] = _cigars(long, np.array([0, len(long)]))[0].as_py()
    if replaced:
        cigars = pa.array([replaced.get(k, c) for k, c in enumerate(cigars.to_pylist())], pa.string())
    nibbles, nibble_ends = _gathered(raw, seq, (length + 1) // 2)
    letters = np.frombuffer(BASES.encode(), np.uint8)
    both = np.stack((letters[nibbles >> 4], letters[nibbles & 15]), axis=1).ravel()
    bases, base_ends = _gathered(both, 2 * nibble_ends[:-1], length)
    quality, quality_ends = _gathered(raw, qual, length)
    absent = length == 0
    first = np.where(absent, 255, quality[np.minimum(quality_ends[:-1], max(len(quality) - 1, 0))] if len(quality) else 255)
    names = pa.array([n for n, _ in references] + ["*"], pa.string())
    ref, mate = (np.where(fixed[c] < 0, len(references), fixed[c]) for c in ("ref", "next_ref"))
    next_name = pc.if_else(pa.array((fixed["next_ref"] >= 0) & (fixed["next_ref"] == fixed["ref"])), "=", names.take(pa.array(mate)))
    read_name, name_ends = _gathered(raw, name, fixed["name"].astype(np.int64) - 1)
    columns = {
        "qname": _strings(read_name, name_ends), "flag": pa.array(fixed["flag"].astype(np.int32)), "rname": names.take(pa.array(ref)), "pos": pa.array(fixed["pos"].astype(np.int64)),
        "mapq": pa.array(fixed["mapq"].astype(np.int32)), "cigar": cigars, "rnext": next_name, "pnext": pa.array(fixed["next_pos"].astype(np.int64) + 1), "tlen": pa.array(fixed["tlen"].astype(np.int64)),
        "seq": _strings(bases, base_ends, absent), "qual": _strings(np.where(quality == 255, 0, quality + 33).astype(np.uint8), quality_ends, first == 255), "tags": pa.array(tags, pa.list_(pa.string())),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)), stays


def bin_of(start: int, stop: int) -> int:
    """The smallest bin that holds [start, stop)."""
    stop -= 1
    for level, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> level == stop >> level:
            return first + (start >> level)
    return 0


def bins_over(start: int, stop: int) -> list[int]:
    """The bins that [start, stop) touches."""
    stop, found = min(stop, 1 << 29) - 1, [0]
    for level, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        found += range(first + (start >> level), first + (stop >> level) + 1)
    return found


_CODES = np.full(256, 15, np.uint8)
for _k, _base in enumerate(BASES):
    _CODES[ord(_base)] = _CODES[ord(_base.lower())] = _k


def _packed_tag(text: str) -> bytes:
    name, kind, value = text.split(":", 2)
    if kind == "i":
        number = int(value)
        body = struct.pack("<ci" if number < 1 << 31 else "<cI", b"i" if number < 1 << 31 else b"I", number)
    elif kind == "f":
        body = struct.pack("<cf", b"f", float(value))
    elif kind == "A":
        body = b"A" + value.encode()[:1]
    elif kind == "B":
        sub, *numbers = value.split(",")
        body = b"B" + sub.encode() + struct.pack("<i", len(numbers)) + np.array([float(x) if sub == "f" else int(x) for x in numbers]).astype("<" + _NUMBERS[sub]).tobytes()
    elif kind in "ZH":
        body = kind.encode() + value.encode() + b"\0"
    else:
        raise ValueError(f"no such type of a tag: {text}")
    return name.encode() + body


def encoded(row: dict, places: dict[str, int]) -> tuple[bytes, int, int, int]:
    """A row of SAM text as a record, with its reference (-1: none), start and end on it. Null fields count as absent."""
    name = (row["qname"] or "*").encode()
    rname, rnext = row["rname"] or "*", row["rnext"] or "*"
    if rname != "*" and rname not in places:
        raise ValueError(f"the header has no reference {rname}")
    ref = -1 if rname == "*" else places[rname]
    mate = ref if rnext == "=" else -1 if rnext == "*" else places[rnext]
    found = _OP.findall((row["cigar"] or "*").encode())
    words = [int(n) << 4 | OPERATIONS.index(op.decode()) for n, op in found]
    spanned = sum(w >> 4 for w in words if OPERATIONS[w & 15] in CONSUMES_REFERENCE)
    seq = "" if row["seq"] in (None, "*") else row["seq"]
    codes = _CODES[np.frombuffer((seq + "=" * (len(seq) % 2)).encode("ascii"), np.uint8)]
    qual = b"\xff" * len(seq) if row["qual"] in (None, "*") else (np.frombuffer(row["qual"].encode("ascii"), np.uint8) - 33).tobytes()
    if len(qual) != len(seq):
        raise ValueError(f"{row['qname']}: {len(seq)} bases with {len(qual)} qualities")
    if len(name) > 254:
        raise ValueError(f"{row['qname']}: a read's name has at most 254 letters")
    tags = b"".join(map(_packed_tag, row["tags"] or []))
    if len(words) > 0xFFFF:
        tags += b"CGBI" + struct.pack("<i", len(words)) + np.array(words, "<u4").tobytes()
        words = [len(seq) << 4 | 4, spanned << 4 | 3]
    pos = -1 if row["pos"] is None else row["pos"]
    stop = pos + max(spanned, 1)
    number = [row[c] or 0 for c in ("mapq", "flag", "pnext", "tlen")]
    fixed = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, number[0], bin_of(pos, stop) if pos >= 0 else 4680, len(words), number[1], len(seq), mate, number[2] - 1, number[3])
    body = b"".join((fixed, name, b"\0", np.array(words, "<u4").tobytes(), (codes[::2] << 4 | codes[1::2]).tobytes(), qual, tags))
    return struct.pack("<i", len(body)) + body, ref, pos, stop


@dataclass
class Index:
    """Of each reference, the chunks (virtual offsets) of its bins, and the first record that touches each window of 16 kilobases."""

    bins: list[dict[int, list[list[int]]]]
    windows: list[list[int]]
    unplaced: int = 0

    @staticmethod
    def empty(references: int) -> Index:
        return Index([{} for _ in range(references)], [[] for _ in range(references)])

    def add(self, ref: int, start: int, stop: int, begin: int, end: int) -> None:
        """A record in the order of places."""
        if ref < 0 or start < 0:
            self.unplaced += 1
            return
        chunks = self.bins[ref].setdefault(bin_of(start, stop), [])
        if chunks and chunks[-1][1] == begin:
            chunks[-1][1] = end
        else:
            chunks.append([begin, end])
        windows, last = self.windows[ref], stop - 1 >> LINEAR
        windows += [0] * (last + 1 - len(windows))
        for k in range(start >> LINEAR, last + 1):
            windows[k] = windows[k] or begin

    def packed(self) -> bytes:
        out = [b"BAI\1", struct.pack("<i", len(self.bins))]
        for bins, windows in zip(self.bins, self.windows):
            out.append(struct.pack("<i", len(bins)))
            for number, chunks in sorted(bins.items()):
                out.append(struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
            filled = []
            for w in windows:
                filled.append(w or (filled[-1] if filled else 0))
            out.append(struct.pack("<i", len(filled)) + struct.pack(f"<{len(filled)}Q", *filled))
        return b"".join(out) + struct.pack("<Q", self.unplaced)

    @staticmethod
    def parsed(data: bytes) -> Index:
        if data[:4] != b"BAI\1":
            raise ValueError("no BAI index")
        n, at = struct.unpack_from("<i", data, 4)[0], 8
        out = Index.empty(n)
        for ref in range(n):
            many = struct.unpack_from("<i", data, at)[0]
            at += 4
            for _ in range(many):
                number, chunks = struct.unpack_from("<Ii", data, at)
                at += 8
                if number <= LARGEST_BIN:
                    out.bins[ref][number] = [list(struct.unpack_from("<QQ", data, at + 16 * k)) for k in range(chunks)]
                at += 16 * chunks
            size = struct.unpack_from("<i", data, at)[0]
            out.windows[ref] = list(struct.unpack_from(f"<{size}Q", data, at + 4))
            at += 4 + 8 * size
        if at + 8 <= len(data):
            out.unplaced = struct.unpack_from("<Q", data, at)[0]
        return out

    def chunks(self, ref: int, start: int = 0, stop: int = 1 << 29) -> list[tuple[int, int]]:
        """The stretches of the file that may hold records of a reference that touch [start, stop), in order."""
        if ref >= len(self.bins) or start >= stop:
            return []
        windows = self.windows[ref]
        least = windows[min(start >> LINEAR, len(windows) - 1)] if windows else 0
        own = self.bins[ref]
        wanted = set(bins_over(start, stop)) & set(own) if stop - start < 1 << 26 else [b for b in own if _touches(b, start, stop)]
        found: list[list[int]] = []
        for a, b in sorted((max(a, least), b) for k in wanted for a, b in own[k] if b > least):
            if found and a >> 16 <= found[-1][1] >> 16:
                found[-1][1] = max(found[-1][1], b)
            else:
                found.append([a, b])
        return [(a, b) for a, b in found]

    def starts(self) -> list[int]:
        """Offsets at which a record begins."""
        return sorted({c[0] for bins in self.bins for chunks in bins.values() for c in chunks} | {w for windows in self.windows for w in windows if w})


def _touches(number: int, start: int, stop: int) -> bool:
    for level, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1), (29, 0)):
        if number >= first:
            return (number - first) << level < stop and (number - first + 1) << level > start
    return False


@dataclass
class Writer:
    """Records in order to a file-like object as BGZF blocks, with their index."""

    out: object
    header: Header
    index: Index = field(init=False)
    written: int = 0
    records: int = 0

    def __post_init__(self):
        self.index, self.held = Index.empty(len(self.header.references)), bytearray()
        self.places = {name: k for k, (name, _) in enumerate(self.header.references)}
        for begin in range(0, len(packed := self.header.packed()), BLOCK_BYTES):
            self._put(packed[begin : begin + BLOCK_BYTES])

    def _put(self, data: bytes) -> None:
        made = block(data)
        self.out.write(made)
        self.written += len(made)

    def _offset(self) -> int:
        return self.written << 16 | len(self.held)

    def add(self, row: dict) -> tuple[int, int]:
        """Writes a row; gives its reference and place."""
        data, ref, start, stop = encoded(row, self.places)
        if len(self.held) + len(data) > BLOCK_BYTES and self.held:
            self._flush()
        begin = self._offset()
        self.held += data
        while len(self.held) > BLOCK_BYTES:
            self._put(bytes(self.held[:BLOCK_BYTES]))
            del self.held[:BLOCK_BYTES]
        self.index.add(ref, start, stop, begin, self._offset())
        self.records += 1
        return ref, start

    def _flush(self) -> None:
        self._put(bytes(self.held))
        self.held.clear()

    def close(self) -> None:
        if self.held:
            self._flush()
        self.out.write(END_OF_FILE)
