"""Media columns: ISO base media files (MP4 and its kin) in a binary column.

A file is a tree of boxes. The sample tables of each track say how long a sample lasts (stts), how large it is
(stsz, stz2), which chunk it is in (stsc), where the chunks begin (stco, co64) and which samples are keyframes (stss). From
these come codec, duration and the byte ranges of the keyframes, without decoding a payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.shared import batches

SAMPLE = 64
CHUNK_SAMPLES = 32
KEY_EVERY = 16
TIMESCALE = 8000
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf"}
_KEY = pa.struct([("sample", pa.int64()), ("offset", pa.int64()), ("size", pa.int64())])
_TRACK = [("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.float64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(_KEY))]
TRACK = "struct<handler:string,codec:string,timescale:long,duration:double,n_samples:long,keyframes:array<struct<sample:long,offset:long,size:long>>>"
#: The unity matrix of mvhd and tkhd.
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *body: bytes) -> bytes:
    """A box; one of 4 GiB and more has its size after its name."""
    inner = b"".join(body)
    if len(inner) + 8 < 1 << 32:
        return struct.pack(">I4s", len(inner) + 8, kind) + inner
    return struct.pack(">I4sQ", 1, kind, len(inner) + 16) + inner


def full(kind: bytes, *body: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *body)


def walk(data: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Path, first and last byte of the body of every box, in order, those within boxes too, however deep."""
    todo: list[tuple[int, int, tuple[bytes, ...]]] = [(0, len(data), ())]
    while todo:
        begin, end, path = todo.pop()
        if begin + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, begin)
        head = 8
        if size == 1 and begin + 16 <= end:
            (size,), head = struct.unpack_from(">Q", data, begin + 8), 16
        elif size == 0:
            size = end - begin
        if size < head or begin + size > end:
            raise ValueError(f"box {kind!r} at byte {begin} has size {size}")
        yield (*path[-4:], kind), begin + head, begin + size
        todo.append((begin + size, end, path))
        if kind in CONTAINERS:
            todo.append((begin + head, begin + size, (*path[-4:], kind)))


def store(payload: bytes, codec: bytes = b"raw ") -> bytes:
    """A file with one track of 8-bit samples in groups of SAMPLE bytes; nothing in it depends on time or place."""
    n = len(payload) // SAMPLE
    chunks = -(-n // CHUNK_SAMPLES)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    data_head = 8 if len(payload) + 8 < 1 << 32 else 16
    first = len(ftyp) + data_head
    entry = box(codec, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    per_chunk = [(1, CHUNK_SAMPLES)] if chunks == 1 or n % CHUNK_SAMPLES == 0 else [(1, CHUNK_SAMPLES), (chunks, n % CHUNK_SAMPLES)]
    per_chunk = [(1, n)] if chunks == 1 else per_chunk
    wide = first + len(payload) >= 1 << 32
    offsets = first + np.arange(chunks, dtype=np.int64) * CHUNK_SAMPLES * SAMPLE
    keys = np.arange(1, n + 1, KEY_EVERY)
    table = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
        full(b"stsc", struct.pack(">I", len(per_chunk)), *(struct.pack(">III", a, b, 1) for a, b in per_chunk)),
        full(b"stsz", struct.pack(">II", SAMPLE, n)),
        full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
    )
    lasts = n * SAMPLE
    version, form = (1, ">QQIQ") if lasts >= 1 << 32 else (0, ">IIII")
    mdhd = full(b"mdhd", struct.pack(form, 0, 0, TIMESCALE, lasts), struct.pack(">HH", 0x55C4, 0), version=version)
    hdlr = full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0")
    here = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
    media = box(b"mdia", mdhd, hdlr, box(b"minf", full(b"smhd", bytes(4)), here, table))
    mvhd = full(b"mvhd", struct.pack(form, 0, 0, TIMESCALE, lasts), struct.pack(">IH10x", 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2), version=version)
    times = struct.pack(">QQIIQ" if version else ">IIIII", 0, 0, 1, 0, lasts)
    tkhd = full(b"tkhd", times, bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), version=version, flags=7)
    return ftyp + box(b"mdat", payload) + box(b"moov", mvhd, box(b"trak", tkhd, media))


def _entries(data: bytes, at: tuple[int, int], width: int, form: str = ">u4", head: int = 4) -> np.ndarray:
    """The entries of a table of a box, whose number stands before them; they must lie within the box."""
    begin, end = at
    n = struct.unpack_from(">I", data, begin + head)[0]
    kind = np.dtype(form)
    if begin + head + 4 + n * width * kind.itemsize > end:
        raise ValueError("a table is longer than its box")
    return np.frombuffer(data, kind, n * width, begin + head + 4).astype(np.int64).reshape(n, width)


class Track:
    """The tables of one track. Sizes that all samples share are not expanded."""

    def __init__(self, data: bytes, found: dict[bytes, tuple[int, int]]):
        at = found[b"hdlr"][0] if b"hdlr" in found else None
        self.handler = data[at + 8 : at + 12].decode("latin-1") if at else ""
        at = found[b"stsd"][0]
        if at + 16 > found[b"stsd"][1]:
            raise ValueError("a track has no sample entry")
        self.codec = data[at + 12 : at + 16].decode("latin-1")
        at = found[b"mdhd"][0]
        self.timescale = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
        self.runs = _entries(data, found[b"stts"], 2)
        self.one, self.sizes = 0, None
        if b"stsz" in found:
            at = found[b"stsz"][0]
            self.one, self.n = struct.unpack_from(">II", data, at + 4)
            if not self.one:
                self.sizes = _entries(data, found[b"stsz"], 1, head=8)[:, 0]
            elif self.n * self.one > len(data):
                raise ValueError("the samples are longer than the file")
        else:
            at, end = found[b"stz2"]
            bits, self.n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
            if bits == 4:
                if at + 12 + (self.n + 1) // 2 > end:
                    raise ValueError("a table is longer than its box")
                pairs = np.frombuffer(data, np.uint8, (self.n + 1) // 2, at + 12)
                self.sizes = np.stack([pairs >> 4, pairs & 15], axis=1).reshape(-1)[: self.n].astype(np.int64)
            else:
                self.sizes = _entries(data, found[b"stz2"], 1, {8: ">u1", 16: ">u2"}[bits], 8)[:, 0]
        if self.runs[:, 0].sum() != self.n:
            raise ValueError("there are times for another number of samples")
        self.before = None if self.sizes is None else np.concatenate(([0], np.cumsum(self.sizes)))
        self.chunks = (_entries(data, found[b"stco"], 1) if b"stco" in found else _entries(data, found[b"co64"], 1, ">u8"))[:, 0]
        spans = _entries(data, found[b"stsc"], 3)
        self.last = np.cumsum(np.repeat(spans[:, 1], np.diff(np.append(spans[:, 0], len(self.chunks) + 1))))  # samples up to each chunk's end
        self.sync = _entries(data, found[b"stss"], 1)[:, 0] if b"stss" in found else np.arange(1, self.n + 1)  # without the box, every sample is one
        if len(self.sync) and not 1 <= self.sync.min() <= self.sync.max() <= self.n:
            raise ValueError("a keyframe is no sample")

    @property
    def duration(self) -> float:
        """In seconds."""
        return float((self.runs[:, 0].astype(float) * self.runs[:, 1]).sum() / max(self.timescale, 1))

    def ranges(self, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets and sizes of samples, counted from 0."""
        chunk = np.searchsorted(self.last, samples, side="right")
        first = np.concatenate(([0], self.last))[chunk]
        if self.sizes is None:
            return self.chunks[chunk] + (samples - first) * self.one, np.full(len(samples), self.one, np.int64)
        return self.chunks[chunk] + self.before[samples] - self.before[first], self.sizes[samples]


def read_tracks(data: bytes) -> list[Track]:
    """The tracks of a file, in order. A file with fragments (moof) has tables elsewhere and is not read: ValueError."""
    tracks: list[dict[bytes, tuple[int, int]]] = []
    for path, begin, end in walk(data):
        if path[-1] == b"moof":
            raise ValueError("the file has fragments")
        if path[-1] == b"trak":
            tracks.append({})
        elif tracks and b"trak" in path:
            tracks[-1].setdefault(path[-1], (begin, end))
    return [Track(data, found) for found in tracks]


def media_columns(rows: DataFrame, column: str = "media") -> DataFrame:
    """rows with handler, codec, timescale, duration, n_samples and keyframes (sample, offset, size) of the files in a binary
    column, those of the main track, and tracks with those of each.

    Null, empty and broken files give nulls, as do files without tracks and those with fragments, whatever is in them. Columns of
    rows by these names are replaced.
    """

    def one(data: bytes | None) -> list[dict] | None:
        try:
            out = []
            for t in read_tracks(data):
                offsets, sizes = t.ranges(t.sync - 1)
                keys = [{"sample": s, "offset": o, "size": z} for s, o, z in zip(t.sync.tolist(), offsets.tolist(), sizes.tolist())]
                out.append({"handler": t.handler, "codec": t.codec, "timescale": t.timescale, "duration": t.duration, "n_samples": t.n, "keyframes": keys})
            return out or None
        except (KeyError, ValueError, IndexError, TypeError, OverflowError, struct.error):
            return None

    @F.arrow_udf(f"array<{TRACK}>")
    def read(data: pa.Array) -> pa.Array:
        return pa.array(map(one, data.to_pylist()), pa.list_(pa.struct(_TRACK)))

    names = [n for n, _ in _TRACK]
    kept = rows.drop(*(n for n in [*names, "tracks"] if n.lower() != column.lower())).withColumn("tracks", read(F.col(column)))
    handlers = F.transform("tracks", lambda t: t["handler"])
    place = F.coalesce(*(F.nullif(F.array_position(handlers, h), F.lit(0)) for h in ("vide", "soun")), F.lit(1)).cast("int")
    main = F.try_element_at("tracks", place)
    return kept.select(*(c for c in kept.columns if c != "tracks"), *(main[n].alias(n) for n in names), "tracks")


def payload_of(text: str | None) -> tuple[bytes, int]:
    """A text's bytes, with zeros up to a positive multiple of SAMPLE, and how many there were."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % SAMPLE if raw else SAMPLE), len(raw)


def store_texts(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """One row for each row of docs: its text stored as a media file, and what is read back from that.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and, if asked for,
    media. Null counts as empty. Equal texts give equal files and features; null and repeated ids are rows like
    others; further columns are not read. A file is held whole in a task, as is its text.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 16 << 20):
            out = []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                payload, n = payload_of(text)
                media = store(payload)
                t = read_tracks(media)[0]
                back = b"".join(media[o : o + s] for o, s in _runs(*t.ranges(np.arange(t.n))))
                ranges = zlib.crc32(np.stack(t.ranges(t.sync - 1)).astype(">i8").tobytes())
                levels = np.frombuffer(back, np.uint8)
                feature = f"{t.codec.strip()};{t.duration:.3f}s;{t.n} samples;{len(t.sync)} keyframes;ranges {ranges:08x};mean {levels.mean():.4f};peak {levels.max()}"
                out.append((i, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-SAMPLE:]), len(media), hashlib.sha256(media).hexdigest(), feature, media)[: 8 + with_media])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"][: 8 + with_media]
    kinds = dict(zip(names, ["long", "long", "long", "string", "long", "long", "string", "string", "binary"]))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds.items()))


def _runs(offsets: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbouring samples as one range."""
    new = np.flatnonzero(np.append(True, offsets[1:] != offsets[:-1] + sizes[:-1]))
    ends = np.append(new[1:], len(offsets)) - 1
    yield from zip(offsets[new].tolist(), (offsets[ends] + sizes[ends] - offsets[new]).tolist())


def op2_media(spark, sf_dir: str) -> DataFrame:
    return store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
