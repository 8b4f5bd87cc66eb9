import gzip
import json
import os
import random
import struct

import numpy as np
import pytest

from strandmill.sources import bam
from strandmill.sources import bam_format as fmt
from strandmill.sources.schemas import ALIGNMENT

HEADER = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:c2\tLN:500000000\n@SQ\tSN:c1\tLN:900000\n@CO\tnaïve\n"
FIELDS = ALIGNMENT.fieldNames()


def rows(n, seed=1):
    rng, out = random.Random(seed), []
    for k in range(n):
        size = rng.randint(1, 60)
        seq = "".join(rng.choice("ACGTNR") for _ in range(size + 5))
        tags = [f"NM:i:{rng.choice([0, -3, 200, 70000, -40000, 3000000000])}", "RG:Z:a b", "XA:A:c", "XF:f:0.5", "XB:B:s,1,-2", "XI:B:I", "ML:B:C,0,255", "XH:H:1AE3"][: rng.randint(0, 8)]
        place = rng.choice(["c1", "c2"])
        out.append((f"r{k % 97}", rng.choice([0, 16, 256, 4]), place, rng.randint(0, 880_000) if place == "c1" else rng.randint(0, 499_000_000), rng.randint(0, 60), f"2S{size}M1I4D2M3H", rng.choice(["=", "*", "c1"]), rng.randint(0, 99), rng.randint(-9, 9), seq, "".join(chr(33 + rng.randint(0, 60)) for _ in seq), tags))
    out += [("u", 4, "*", -1, 0, "*", "*", 0, 0, "ACG", "*", []), ("u2", 77, "*", -1, 0, "*", "*", 0, 0, "*", "*", ["AS:i:1"])]
    return out


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bam") / "out")
    given = rows(3000)
    bam.write_bam(spark.createDataFrame(given, ALIGNMENT).repartition(7), HEADER, path, 5)
    return path, given


def text(found):
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in (r[c] for c in FIELDS)) for r in found)


def expected(given):
    """A mate on the same reference reads '='."""
    return sorted((*r[:6], "=" if r[6] == r[2] != "*" else r[6], *r[7:11], tuple(r[11])) for r in given)


def test_round_trip_and_order(spark, made):
    path, given = made
    assert text(bam.read_bam(spark, path).collect()) == expected(given)
    with open(f"{path}/{bam.MANIFEST}") as f:
        listed = json.load(f)
    assert listed["records"] == len(given) and len(listed["parts"]) == 5 and bam.read_bam_header(path) == HEADER
    order = [(r.rname, r.pos) for name in bam.files(path) for r in bam.read_bam(spark, name).collect()]
    place = {"c2": 0, "c1": 1, "*": 2}
    assert order == sorted(order, key=lambda x: (place[x[0]], x[1])) and len(order) == len(given)
    assert not [x for x in os.listdir(path) if x.startswith("_temporary")]


def test_parts_are_plain_bam_files(made):
    """A gzip reader and a byte-by-byte reading of the fixed fields agree with the source."""
    path, given = made
    names = set()
    for part in bam.files(path):
        with gzip.open(part) as f:
            data = f.read()
        assert data[:4] == b"BAM\1"
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        many = struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(many):
            at += 8 + struct.unpack_from("<i", data, at)[0]
        while at < len(data):
            size, ref, pos, l_name = struct.unpack_from("<iiiB", data, at)
            names.add((data[at + 36 : at + 35 + l_name].decode(), ["c2", "c1", "*"][ref], pos))
            at += 4 + size
        with open(part, "rb") as f:
            assert f.read().endswith(fmt.END_OF_FILE)
    assert names == {(r[0], r[2], r[3]) for r in given}


def test_a_region_reads_only_its_blocks(spark, tmp_path, monkeypatch):
    given = sorted(rows(4000, 2)[:-2], key=lambda r: (r[2] != "c2", r[3]))
    monkeypatch.setattr(fmt, "BLOCK_BYTES", 4096)  # many blocks in a small file
    with open(tmp_path / "a.bam", "wb") as f:
        writer = fmt.Writer(f, fmt.Header.of(HEADER))
        for r in given:
            writer.add(dict(zip(FIELDS, r)))
        writer.close()
    (tmp_path / "a.bam.bai").write_bytes(writer.index.packed())
    reader = bam.BamReader({"path": str(tmp_path / "a.bam")})
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    low, high = 100_000_000, 130_000_000
    filters = [EqualTo(("rname",), "c2"), GreaterThanOrEqual(("pos",), low), LessThan(("pos",), high)]
    assert list(reader.pushFilters(filters)) == filters
    read, plain = [], fmt.blocks

    def counted(*args):
        for at, data in plain(*args):
            read.append(at)
            yield at, data

    monkeypatch.setattr(fmt, "blocks", counted)
    stretches = reader.partitions()
    read.clear()
    found = [r for s in stretches for b in reader.read(s) for r in b.to_pylist()]
    assert text(found) == expected([r for r in given if r[2] == "c2" and low <= r[3] < high])
    every = sum(1 for _ in plain(bam._reading(*bam.store(str(tmp_path / "a.bam"))), 0))
    header = len(stretches)  # read again for each stretch
    assert every > 60 and len(read) - header < every // 5


def test_stretches_cover_a_file_once(spark, made):
    path, given = made
    df = bam.read_bam(spark, path, split_bytes=1)
    assert df.rdd.getNumPartitions() > len(bam.files(path))
    assert text(df.collect()) == expected(given)
    some = df.where("rname = 'c1' AND pos > 400000")
    assert some.rdd.getNumPartitions() < df.rdd.getNumPartitions()  # by the filters that were pushed
    assert text(some.collect()) == expected([r for r in given if r[2] == "c1" and r[3] > 400_000])
    assert text(bam.read_bam(spark, path, contigs=["*"]).collect()) == expected(given[-2:])
    assert bam.read_bam(spark, path, contigs=["none"]).collect() == []
    assert text(bam.read_bam(spark, path, exclude_flags=4 + 256).collect()) == expected([r for r in given if not r[1] & 260])


def test_files_without_an_index_globs_and_header_only(spark, tmp_path):
    with open(tmp_path / "x1.bam", "wb") as f:
        writer = fmt.Writer(f, fmt.Header.of(HEADER))
        for r in rows(50)[:-2]:
            writer.add(dict(zip(FIELDS, r)))
        writer.close()
    with open(tmp_path / "x2.bam", "wb") as f:
        fmt.Writer(f, fmt.Header.of("")).close()
    assert bam.read_bam(spark, str(tmp_path / "x*.bam")).count() == 50
    assert bam.read_bam(spark, str(tmp_path)).count() == 50
    assert bam.read_bam(spark, str(tmp_path / "x2.bam")).collect() == []
    none = spark.createDataFrame([], ALIGNMENT)
    bam.write_bam(none, HEADER, str(tmp_path / "none"))
    assert bam.read_bam(spark, str(tmp_path / "none")).collect() == [] and bam.read_bam_header(str(tmp_path / "none")) == HEADER


def test_an_aborted_job_leaves_what_was_there(spark, made, tmp_path):
    path = str(tmp_path / "out")
    good, given = spark.createDataFrame(rows(100), ALIGNMENT), rows(100)
    bam.write_bam(good, HEADER, path, 3)
    before = sorted(os.listdir(path))
    bad = spark.createDataFrame(rows(300, 5) + [("x", 0, "unknown", 5, 0, "1M", "*", 0, 0, "A", "I", [])], ALIGNMENT)
    with pytest.raises(Exception, match="no reference unknown"):
        bam.write_bam(bad, HEADER, path, 3)
    assert sorted(os.listdir(path)) == before and text(bam.read_bam(spark, path).collect()) == expected(given)
    bam.write_bam(good.limit(5), HEADER, path, 1)
    assert bam.read_bam(spark, path).count() == 5 and len(os.listdir(path)) == 3


def test_long_cigars_and_records_over_many_blocks(tmp_path, spark):
    cigar = "1M1I" * 40_000
    row = dict(zip(FIELDS, ("long", 0, "c1", 7, 1, cigar, "*", 0, 0, "AC" * 40_000, "I" * 80_000, ["NM:i:1"])))
    with open(tmp_path / "l.bam", "wb") as f:
        writer = fmt.Writer(f, fmt.Header.of(HEADER))
        for _ in range(3):
            writer.add(row)
        writer.close()
    found = bam.read_bam(spark, str(tmp_path / "l.bam")).collect()
    assert len(found) == 3 and all(r.cigar == cigar and r.seq == row["seq"] and r.tags == ["NM:i:1"] for r in found)


def test_damaged_files_are_refused(tmp_path):
    (tmp_path / "a.bam").write_bytes(b"\x1f\x8b\x08\x04" + bytes(40))
    with pytest.raises(ValueError):
        bam.BamReader({"path": str(tmp_path / "a.bam")}).partitions()
    good = fmt.block(b"hello")
    (tmp_path / "b.bam").write_bytes(good[:-9] + bytes([good[-9] ^ 1]) + good[-8:])
    with pytest.raises(Exception):
        list(fmt.blocks(bam._reading(*bam.store(str(tmp_path / "b.bam"))), 0))


def test_index_equals_a_search_of_all_records():
    rng, index, placed = random.Random(3), fmt.Index.empty(1), []
    at = 100
    for start in sorted(rng.randint(0, 1 << 22) for _ in range(800)):
        stop, end = start + rng.choice([1, 90, 30_000, 400_000]), at + rng.randint(1, 1 << 18)
        index.add(0, start, stop, at, end)
        placed.append((start, stop, at))
        at = end
    index = fmt.Index.parsed(index.packed())
    for _ in range(200):
        a = rng.randint(0, 1 << 22)
        b = a + rng.choice([1, 5000, 1 << 20])
        chunks = index.chunks(0, a, b)
        assert all(any(x <= offset < y for x, y in chunks) for s, e, offset in placed if s < b and e > a)
    assert np.all(np.diff(index.starts()) > 0)


def test_queries_equal_sql(spark, sf_dir, same):
    from strandmill.plans import catalog

    for name in ("bam_files", "bam_regions"):
        same(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLES[name])
