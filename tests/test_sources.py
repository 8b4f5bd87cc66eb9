import gzip

from strandmill.sources import readers, schemas, sinks


def test_centered_reads(spark, tmp_path):
    row = ["S#1#c1", "250000", "+", "x", "1", "2", "r1", "rg", "hp", "-5", "12", "30", "", "", "1,2", "3,4", "", "", "", "", "", "ACGT"]
    with gzip.open(tmp_path / "S1.x.tsv.gz", "wt") as f:
        f.write("\t".join(f"h{k}" for k in range(22)) + "\n" + "\t".join(row) + "\n" + "\t".join(["U#1#c9", *row[1:]]) + "\n")
    (tmp_path / "alias.txt").write_text("S#1#c1\tchr2\tc1\nS#1#c1\tchr1\tc1\n")
    alias = readers.read_alias(spark, str(tmp_path / "alias.txt"))
    rows = {r.chrom: r for r in readers.read_centered(spark, str(tmp_path / "S1*.gz"), alias).collect()}
    assert rows["S#1#c1"].chrom_assignment == "chr1q" and rows["S#1#c1"].sample == "S1" and rows["S#1#c1"].label == "S_1"
    assert rows["U#1#c9"].chrom_assignment is None and rows["S#1#c1"].query_sequence == "ACGT" and rows["S#1#c1"].centered_query_end == 12


def test_small_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    bed = readers.read_bed_intervals(spark, put("a.bed", "#c\nchr1\t1\t5\nchr1\t2\n"))
    assert [tuple(r) for r in bed.collect()] == [("chr1", 1, 5)]
    anc = readers.read_ancestry(spark, put("b.bed", "chr1\t0\t10\tHG/1/x_(0.5,-2)\t0.9\n")).first()
    assert (anc.id, anc.hap, anc.pc1, anc.pc2) == ("HG", "1", 0.5, -2.0)
    assert [r.motif for r in readers.read_motif_counts(spark, put("c.tsv", "motif\tm\tt\nTTAGGG\t1\t2\nbad\t1\n")).collect()] == ["TTAGGG"]
    fp = readers.read_footprints(spark, put("d.tsv", "#chrom\tstart\tend\tn\tcodes\tnames\nchr1\t1\t2\t2\t3,1\ta,b\n")).first()
    assert fp.chrom == "chr1" and fp.footprint_codes == "3,1"
    sam = readers.read_sam(spark, put("e.sam", "@HD\tx\nr\t16\tchr1\t11\t60\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:1\tAS:i:4\n")).first()
    assert (sam.pos, sam.flag, sam.tags) == (10, 16, ["NM:i:1", "AS:i:4"])
    paf = readers.read_paf(spark, put("f.paf", "q\t9\t0\t5\t+\tt\t99\t1\t6\t5\t5\t60\ttp:A:P\tcg:Z:5M\n")).first()
    assert paf.tags == ["cg:Z:5M"] and paf.t_end == 6
    mq = readers.read_mapq_summary(spark, put("g.txt", "MAPQ>=20: 4\nTotal primary: 9\nMAPQ>=30: 3\nTotal primary: 9\n")).orderBy("threshold")
    assert [tuple(r) for r in mq.collect()] == [(20, 4, 9), (30, 3, 9)]
    sim = readers.read_similarity(spark, put("h.csv", "label_i,label_j,sim_t50\na,b,0.1\n"))
    assert dict(sim.dtypes)["sim_t50"] == "float" and sim.first().label_j == "b"
    assert readers.read_bed(spark, put("i.bed", "c\t1\t2\t+\textra\n"), schemas.TELOMERES).first().direction == "+"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("chr2", 5, None), ("chr1", 9, 1.0)], "rname string, pos long, v double")
    sinks.write_tsv(rows, str(tmp_path / "t"))
    assert spark.read.options(header=True, sep="\t").csv(str(tmp_path / "t")).where("v = 'NA'").count() == 1
    sinks.write_alignments(rows, str(tmp_path / "a"), 2)
    assert [r.pos for r in spark.read.parquet(str(tmp_path / "a")).orderBy("rname").collect()] == [9, 5]
    sinks.write_alignments(rows.limit(0), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).columns == ["rname", "pos", "v"]


def test_the_call_gate_goes_by_the_centred_molecule(spark, tmp_path):
    from pyspark.sql import Observation

    head = "chrom\tcentering_position\tcentered_query_start\tcentered_query_end\tquery_length\tm6a_qual\n"
    rows = ["a\t5\t-500\t1500\t99000\t1,2", "b\t5\t-1500\t1500\t100\t1,2", "c\t5\t-1\t0\t9\t"]
    with gzip.open(tmp_path / "S1.tsv.gz", "wt") as f:
        f.write(head + "\n".join(rows) + "\n")
    columns = head.split()
    counts = Observation("gate")
    found = readers.read_fiberseq(spark, str(tmp_path / "*.gz"), columns, counts=counts)
    assert sorted(r.chrom for r in found.collect()) == ["a", "c"]  # 2 calls for 2,000 bases; 2 for 3,000 are too few
    assert counts.get == {"reads": 3, "kept": 2}
    plain = readers.read_fiberseq(spark, str(tmp_path / "*.gz"), ["chrom", "query_length", "m6a_qual"])
    assert sorted(r.chrom for r in plain.collect()) == ["b", "c"]


def test_unreadable_files_are_named(spark, tmp_path):
    whole = gzip.compress(b"a\tb\n" * 5000)
    noise = bytearray(gzip.compress(bytes(range(256)) * 400))
    noise[len(noise) // 2] ^= 255
    for name, data in {"good.tsv.gz": whole, "two.tsv.gz": whole + whole, "cut.tsv.gz": whole[: len(whole) // 2], "bad.tsv.gz": bytes(noise), "no.tsv.gz": b"plain text", "other.tsv": b"x", "empty.tsv.gz": b""}.items():
        (tmp_path / name).write_bytes(data)
    found = {r.path.rsplit("/", 1)[1]: (r.bytes, r.reason) for r in readers.unreadable_files(spark, str(tmp_path)).collect()}
    assert found.keys() == {"cut.tsv.gz", "bad.tsv.gz", "no.tsv.gz"} and found["cut.tsv.gz"][1] == "the file ends before its data"
