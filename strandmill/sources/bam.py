"""BAM as a Spark data source: partitions from the index, contigs and places pushed down, and a sink that commits.

Files are opened through pyarrow's file systems, so a path may be local or of any store that these know (s3, gs, hdfs with its client).
A folder written by the sink has a manifest that lists its parts in coordinate order; each part is a BAM file with an index of
its own. A reader takes what the manifest lists, so parts of a job that failed are never seen.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from strandmill.sources import bam_format as fmt
from strandmill.sources.schemas import ALIGNMENT
from strandmill.sources.sinks import in_ranges

MANIFEST = "_manifest.json"
SPLIT_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
ROWS = 75_000  # in a file that is written
END = 1 << 63  # after any record


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), posixpath.normpath(path)


def _exists(system: fs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type != fs.FileType.NotFound


def files(path: str) -> list[str]:
    """The BAM files of a path: a file, a glob of one folder's names, a folder of BAM files, or one with a manifest."""
    system, where = store(path)
    folder, name = posixpath.split(where)
    if any(c in name for c in "*?["):
        return sorted(x.path for x in system.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatch(x.base_name, name) and x.is_file)
    if system.get_file_info(where).type == fs.FileType.Directory:
        if _exists(system, f"{where}/{MANIFEST}"):
            with system.open_input_stream(f"{where}/{MANIFEST}") as f:
                return [f"{where}/{part['name']}" for part in json.loads(f.read())["parts"]]
        return sorted(x.path for x in system.get_file_info(fs.FileSelector(where)) if x.is_file and x.base_name.endswith(".bam") and x.base_name[0] not in "._")
    return [where]


def _reading(system: fs.FileSystem, path: str):
    """read(offset, size) of a file."""
    f = system.open_input_file(path)

    def read(offset: int, size: int) -> bytes:
        f.seek(offset)
        return f.read(size)

    return read


def _index(system: fs.FileSystem, path: str) -> fmt.Index | None:
    for name in (f"{path}.bai", path.removesuffix(".bam") + ".bai"):
        if _exists(system, name):
            with system.open_input_stream(name) as f:
                return fmt.Index.parsed(f.read())
    return None


@dataclass
class Stretch(InputPartition):
    """Records of a file that begin at or after start and before stop (virtual offsets)."""

    path: str
    start: int
    stop: int

    def __post_init__(self):
        super().__init__((self.path, self.start, self.stop))


class BamReader(DataSourceReader):
    """Filters on rname and pos choose stretches by the index; Spark applies all filters again."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.contigs: set[str] | None = set(options["contigs"].split(",")) if "contigs" in options else None
        self.low, self.high = int(options.get("from", 0)), int(options.get("until", 1 << 29))  # of pos
        self.without = int(options.get("exclude_flags", 0))
        self.split = int(options.get("split_bytes", SPLIT_BYTES))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            match f:
                case EqualTo(("rname",), value) if value is not None:
                    self._only({value})
                case In(("rname",), values):
                    self._only({v for v in values if v is not None})
                case EqualTo(("pos",), value) if value is not None:
                    self.low, self.high = max(self.low, value), min(self.high, value + 1)
                case GreaterThan(("pos",), value):
                    self.low = max(self.low, value + 1)
                case GreaterThanOrEqual(("pos",), value):
                    self.low = max(self.low, value)
                case LessThan(("pos",), value):
                    self.high = min(self.high, value)
                case LessThanOrEqual(("pos",), value):
                    self.high = min(self.high, value + 1)
            yield f

    def _only(self, names: set[str]) -> None:
        self.contigs = names if self.contigs is None else self.contigs & names

    def partitions(self) -> list[InputPartition]:
        system, _ = store(self.path)
        return [s for path in files(self.path) for s in self._stretches(system, path)] or [Stretch("", 0, 0)]

    def _stretches(self, system: fs.FileSystem, path: str) -> list[Stretch]:
        header, index = fmt.read_header(_reading(system, path)), _index(system, path)
        if index is None:
            return [Stretch(path, header.records, END)]
        if self.contigs is None:
            chunks = [(header.records, END)]
        else:
            places = {name: k for k, (name, _) in enumerate(header.references)}
            low = max(self.low, 0)
            chunks = sorted(c for name in self.contigs if name in places for c in index.chunks(places[name], low, max(self.high, low)))
            if "*" in self.contigs:  # reads without a place come last
                chunks.append((max((c[1] for bins in index.bins for own in bins.values() for c in own), default=header.records), END))
        starts, out = np.array(index.starts(), np.uint64), []
        for begin, end in chunks:
            inner = starts[(starts > begin) & (starts < end)].tolist()
            for at in inner:
                if (at >> 16) - (begin >> 16) >= self.split:
                    out.append(Stretch(path, begin, at))
                    begin = at
            out.append(Stretch(path, begin, end))
        return out

    def _keep(self, references: list[tuple[str, int]]):
        wanted = None if self.contigs is None else {k for k, (name, _) in enumerate(references) if name in self.contigs} | ({-1} if "*" in self.contigs else set())

        def keep(fixed: np.ndarray) -> np.ndarray:
            stays = (fixed["flag"] & self.without) == 0
            if wanted is not None:
                stays &= np.isin(fixed["ref"], list(wanted))
            if self.low > 0:
                stays &= fixed["pos"] >= self.low
            if self.high < 1 << 29:
                stays &= fixed["pos"] < self.high
            return stays

        return keep

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = store(self.path)
        read = _reading(system, partition.path)
        references = fmt.read_header(read).references
        keep, held = self._keep(references), bytearray()
        first, last = partition.start >> 16, partition.stop >> 16
        for at, data in fmt.blocks(read, first, None if partition.stop == END else last):
            if at == last:
                data = data[: partition.stop & 0xFFFF]
            held += data[partition.start & 0xFFFF :] if at == first else data
            if len(held) > BATCH_BYTES:
                yield from self._batches(held, references, keep)
        yield from self._batches(held, references, keep)
        if held:
            raise ValueError(f"{partition.path} ends within a record")

    def _batches(self, held: bytearray, references: list, keep) -> Iterator[pa.RecordBatch]:
        data = bytes(held)
        starts, end = fmt.whole(data)
        del held[:end]
        if len(starts):
            batch, _ = fmt.decoded(data, starts, references, keep)
            if batch.num_rows:
                yield batch


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: its place among the parts, the file's name, and the records' number, first and last place."""

    number: int
    name: str
    records: int
    first: tuple[int, int] | None
    last: tuple[int, int] | None


class BamWriter(DataSourceArrowWriter):
    """Tasks write parts under a name of the job's own; only commit moves them to their place and publishes the manifest."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.header, self.overwrite = options["path"], fmt.Header.of(options.get("header", "")), overwrite
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        number, name = context.partitionId(), f"part-{context.partitionId():05}-{uuid.uuid4().hex[:12]}.bam"
        batch = next((b for b in iterator if b.num_rows), None)
        if batch is None:
            return Part(number, "", 0, None, None)
        first = last = None
        system, folder = self._folder()
        with system.open_output_stream(f"{folder}/{name}") as out:
            writer = fmt.Writer(out, self.header)
            while batch is not None:
                for row in batch.to_pylist():
                    ref, pos = writer.add(row)
                    place = (ref if ref >= 0 else 1 << 31, pos)
                    if last is not None and place < last:
                        raise ValueError(f"{row['qname']} comes after a later place: sort the rows by reference and pos")
                    first, last = first or place, place
                batch = next((b for b in iterator if b.num_rows), None)
            writer.close()
        with system.open_output_stream(f"{folder}/{name}.bai") as out:
            out.write(writer.index.packed())
        return Part(number, name, writer.records, first, last)

    def _folder(self) -> tuple[fs.FileSystem, str]:
        system, where = store(self.path)
        folder = f"{where}/{self.job}"
        system.create_dir(folder, recursive=True)
        return system, folder

    def commit(self, messages: list[Part | None]) -> None:
        system, folder = self._folder()
        where = posixpath.dirname(folder)
        before = files(self.path) if _exists(system, f"{where}/{MANIFEST}") else []
        parts = sorted((m for m in messages if m is not None and m.records), key=lambda m: m.number)
        for a, b in zip(parts, parts[1:]):
            if b.first < a.last:
                raise ValueError(f"{b.name} begins before {a.name} ends: deal the rows out by ranges of reference and pos")
        if before and not self.overwrite:
            raise ValueError(f"{self.path} holds alignments already, and more can't be put in order behind them: overwrite it")
        if not parts:  # the header alone
            parts = [Part(0, f"part-00000-{uuid.uuid4().hex[:12]}.bam", 0, None, None)]
            with system.open_output_stream(f"{folder}/{parts[0].name}") as out:
                writer = fmt.Writer(out, self.header)
                writer.close()
            with system.open_output_stream(f"{folder}/{parts[0].name}.bai") as out:
                out.write(writer.index.packed())
        for part in parts:
            for name in (part.name, f"{part.name}.bai"):
                system.move(f"{folder}/{name}", f"{where}/{name}")
        listed = {"header": self.header.text, "records": sum(p.records for p in parts), "parts": [{"name": p.name, "records": p.records, "first": p.first, "last": p.last} for p in parts]}
        with system.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps(listed).encode())
        if _exists(system, f"{where}/{MANIFEST}"):
            system.delete_file(f"{where}/{MANIFEST}")
        system.move(f"{folder}/{MANIFEST}", f"{where}/{MANIFEST}")
        system.delete_dir(folder)
        for old in before:
            for name in (old, f"{old}.bai"):
                if _exists(system, name):
                    system.delete_file(name)

    def abort(self, messages: list[Part | None]) -> None:
        system, folder = self._folder()
        system.delete_dir(folder)


class BamSource(DataSource):
    """Format `bam`: rows of ALIGNMENT. Options to read: path, contigs (names, joined by commas), from and until (of pos), exclude_flags,
    split_bytes; to write: path, header."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self):
        return ALIGNMENT

    def reader(self, schema) -> BamReader:
        return BamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter(dict(self.options), overwrite)


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(BamSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read_bam(spark: SparkSession, path: str, contigs: list[str] | None = None, exclude_flags: int = 0, **options) -> DataFrame:
    """Alignments of BAM files as read_sam gives them: pos 0-based, tags as SAM text.

    With an index (.bai) a file is cut at records that the index names, and contigs, or filters on rname and pos, read only the
    blocks that may hold them; without one a file is a task. Reads with a flag of exclude_flags are not decoded.
    """
    more = {"exclude_flags": exclude_flags} | ({} if contigs is None else {"contigs": ",".join(contigs)}) | options
    return _registered(spark).read.format("bam").options(path=path, **{k: str(v) for k, v in more.items()}).load()


def read_bam_header(path: str) -> str:
    """The header lines of the first BAM file of a path."""
    system, _ = store(path)
    return fmt.read_header(_reading(system, files(path)[0])).text


def write_bam(df: DataFrame, header: str, path: str, partitions: int | None = None) -> None:
    """Alignments as BAM in coordinate order (references in the header's order, reads without one last), in place of what path holds.

    A task writes a range as a BAM file with its index; the manifest, published last, lists them in order. Without rows there
    is one file of the header alone. A reference that the header lacks, or another name in a pair's rnext, fails the job, and what was there stays.
    """
    references = fmt.Header.of(header).references
    spark = _registered(df.sparkSession)
    order = spark.createDataFrame([(name, k) for k, (name, _) in enumerate(references)], "rname string, _ref long")
    by = (F.coalesce("_ref", F.lit(1 << 31)), F.col("pos"))
    placed = df.select(*ALIGNMENT.fieldNames()).join(F.broadcast(order), "rname", "left")  # a row for each contig of the header
    ranged = in_ranges(placed, by, partitions, ROWS)
    ordered = ranged.sortWithinPartitions(*by, "qname", "flag").select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in ALIGNMENT.fields))
    ordered.write.format("bam").options(path=path, header=header).mode("overwrite").save()
