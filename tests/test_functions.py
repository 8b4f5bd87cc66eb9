import random

from pyspark.sql import functions as F

from strandmill.functions import identity, sequence
from strandmill.operators import aggregates, alignments, histograms, intervals, methylation, pairwise, stats


def one(spark, expr, **columns):
    return spark.createDataFrame([tuple(columns.values())] or [(0,)], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in columns.items())).select(expr.alias("x")).first()["x"]


def spans(spark, text, longest=300):
    return [[s["start"], s["length"]] for s in one(spark, sequence.variant_spans("t", longest), t=text)]


def test_variant_spans(spark):
    assert spans(spark, "TTAGGGTGAGGGTTAGGG") == [[6, 6]]
    assert spans(spark, "TAGGGTA") == [[0, 7]]
    assert spans(spark, "ACACACAC") == []
    assert spans(spark, "ttagggTTAGGG") == []
    assert spans(spark, "CCCTAA" + "A" * 20 + "CCCTAAGG", 10) == [[32, 2]]


def test_variant_spans_equal_a_mask(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(["TTAGGG", "CCCTAA", "T", "G", "TAGGG", "A"]) for _ in range(rnd.randint(0, 20))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sequence.variant_spans("t", None).alias("s"), sequence.repeat_motif("t").alias("m")).collect()
    for r in rows:
        covered = set()
        for i in range(len(r.t)):
            if r.m and r.t[i : i + 6] == r.m:
                covered |= set(range(i, i + 6))
        free = {p for s in r.s for p in range(s["start"], s["start"] + s["length"])}
        assert free == (set(range(len(r.t))) - covered if r.m else set())


def test_sequence_functions(spark):
    assert one(spark, sequence.reverse_complement("t"), t="ACGTNan") == "NtnACGT"
    assert one(spark, sequence.overlapping("t", sequence.rotations("TTAGGG")), t="TTAGGGTTAGGG") == 7
    assert one(spark, sequence.telomere("t", F.lit(100), 1), t="ACGT") == "ACGT"
    assert one(spark, sequence.telomere("t", F.lit(99)), t="ACGT") == ""
    assert one(spark, sequence.kmers("t", 3), t="ACGTN") == ["ACG", "CGT", "GTN"] and one(spark, sequence.kmers("t", 3), t="AC") == []
    assert one(spark, sequence.int_list("t"), t="[1, 2,nan,,3]") == [1, 2, 3] and one(spark, sequence.int_list("t", 1), t="1,2,3") == [2]
    assert one(spark, sequence.bound_flags("t"), t="3,1,7") == [True, False, True]
    assert one(spark, sequence.motif_hits("t", "AAA"), t="AAAAAA") == [0, 3] and one(spark, sequence.motif_hits("t", "AAA"), t="CC") == []
    assert one(spark, sequence.masked_text("t", sequence.variant_spans("t")), t="TTAGGGTGTTAGGG") == "TTAGGG**TG**TTAGGG"
    assert one(spark, sequence.is_rotation(F.col("t"), F.lit("AGGGTT")), t="TTAGGG")


def test_identity(spark):
    assert one(spark, identity.label("t"), t="HG01#2#ctg") == "HG01_2" and one(spark, identity.label("t"), t=None) == "unknown"
    assert one(spark, identity.assignment("t", F.lit(100_001)), t="chr1") == "chr1q" and one(spark, identity.assignment("t", F.lit(5)), t=None) is None
    for raw, want in (("chr19_x", "chr19p"), ("chr23", "chr2p"), ("chrXq", "chrXq"), ("scaffold", None)):
        assert one(spark, identity.normalised(F.col("t"), F.lit(5)), t=raw) == want
    assert one(spark, identity.enough_calls("t", F.lit(900)), t="") and not one(spark, identity.enough_calls("t", F.lit(1100)), t="")
    assert not one(spark, identity.finite(F.lit(float("nan")))) and one(spark, identity.finite(F.lit(1.0)))


def test_intervals(spark):
    rows = spark.createDataFrame([("c", 0, 5), ("c", 5, 9), ("c", 12, 13)], "contig string, start long, stop long")
    merged = intervals.merge_intervals(rows, ["contig"])
    assert sorted((r.start, r.stop) for r in merged.collect()) == [(0, 9), (12, 13)]
    assert intervals.merge_intervals(merged, ["contig"]).count() == 2
    rnd = random.Random(6)
    a = [(f"c{rnd.randint(0, 2)}", s := rnd.randint(0, 200), s + rnd.randint(1, 60)) for _ in range(60)]
    b = [(f"c{rnd.randint(0, 2)}", s := rnd.randint(0, 200), s + rnd.randint(1, 60)) for _ in range(60)]
    left, right = (spark.createDataFrame(x, rows.schema) for x in (a, b))
    met = sorted((r.contig, r.start, r.stop, r.r_start, r.r_stop) for r in intervals.overlap_join(left, right, width=25).collect())
    assert met == sorted((x[0], x[1], x[2], y[1], y[2]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and x[2] > y[1])
    near, far = intervals.near(left, right, 3), intervals.far(left, right, 3)
    assert near.count() + far.count() == len(set(a)) and near.intersect(far).count() == 0
    at = spark.createDataFrame([("c", 3), ("c", 100)], "contig string, at long")
    assert [(r.nearest_at, r.distance) for r in intervals.nearest(rows.where("start = 0"), at, "at").collect()] == [(3, 0)]


def test_consensus(spark):
    rows = spark.createDataFrame([("g", "A", 1), ("g", "C", 1), ("h", "ACGT", 4), ("h", "ACGTAA", 6), ("h", "NNGTAACCC", 9)], "k string, s string, q long")
    got = {r.k: (r.consensus, r.length_bp) for r in aggregates.consensus(rows, ["k"], "s", "q", least=1).collect()}
    assert got["g"] == ("A", 1) and got["h"] == ("ACGTAA", 6)
    assert aggregates.consensus(rows, ["k"], "s", "q", least=3).count() == 1
    assert aggregates.consensus(rows.where("k = 'none'"), ["k"], "s", "q").count() == 0


def test_histogram_edges(spark):
    rows = spark.createDataFrame([(float(v),) for v in (0, 5, 10, 10, 11)], "v double")
    assert {r.bin: r.n for r in histograms.histogram(rows, [], "v", 0.0, 10.0, 2).collect()} == {0: 1, 1: 3}
    curve = [r.cdf for r in histograms.cumulative(rows.withColumn("k", F.lit(1)), ["k"], "v", 0.0, 10.0, 2).orderBy("bin").collect()]
    assert curve == [0.25, 1.0]


def test_mann_whitney_equals_pairs(spark):
    rnd = random.Random(7)
    data = [("g", rnd.choice("ab"), float(rnd.randint(0, 9))) for _ in range(80)]
    got = stats.mann_whitney(spark.createDataFrame(data, "k string, g string, v double"), ["k"], "g", "v", "a", "b").first()
    a, b = ([v for _, g, v in data if g == x] for x in "ab")
    assert got.u1 == sum((x > y) + (x == y) / 2 for x in a for y in b) and 0 < got.p_value <= 1


def test_paf_and_tags(spark):
    rows = spark.createDataFrame([("a", 100, 10, 20, "+", "b", 200, 50, 90)], "q_name string, q_len long, q_start long, q_end long, strand string, t_name string, t_len long, t_start long, t_end long")
    r = alignments.flip_strand(rows, "b").first()
    assert (r.t_start, r.t_end, r.strand, r.q_start) == (110, 150, "-", 10)
    assert alignments.flip_strand(rows, "z").first() == rows.first() and alignments.long_alignments(rows, 30).count() == 1
    tags = spark.createDataFrame([(["NM:i:3", "AS:i:7"],), ([],)], "tags array<string>")
    assert [r.x for r in tags.select(sequence.tag_value("tags", "NM:i:").alias("x")).collect()] == [3.0, None]
    assert one(spark, alignments.reference_length("t"), t="3S4M2I5M1D2M") == 12


def test_matrix_and_methylation(spark):
    pairs = spark.createDataFrame([("e", "a", "b", 0.5), ("e", "b", "c", 0.25)], "k string, label_i string, label_j string, sim double")
    cells = {(r.row, r.col): r.sim for r in pairwise.symmetric_matrix(pairs, ["k"]).collect()}
    assert cells[("a", "b")] == cells[("b", "a")] == 0.5 and cells[("a", "c")] == 0 and cells[("c", "c")] == 1 and len(cells) == 9
    rows = spark.createDataFrame([("s", "TTAGGGTTAGGG", [2]), ("s", "CC", [])], "s string, seq string, calls array<int>")
    assert [tuple(r) for r in methylation.motif_counts(rows, "s", "seq", "calls", ["TTAGGG", "AAA"]).orderBy("motif").collect()] == [("s", "AAA", 0, 0), ("s", "TTAGGG", 1, 2)]


def test_null_keys_match(spark):
    from strandmill.operators import aggregates

    left = spark.createDataFrame([(1, "a", 10), (None, "a", 20), (None, None, 30), (4, "d", 40)], "k int, s string, x int")
    right = spark.createDataFrame([(1, "a", 1), (None, "a", 2), (None, None, 3), (5, None, 5)], "k int, s string, y int")
    rows = lambda how: sorted(map(tuple, aggregates.null_safe_join(left, right, ["k", "s"], how).collect()), key=str)
    both = [(1, "a", 10, 1), (None, "a", 20, 2), (None, None, 30, 3)]
    assert rows("inner") == sorted(both, key=str)
    assert rows("left") == sorted([*both, (4, "d", 40, None)], key=str)
    assert rows("full_outer") == sorted([*both, (4, "d", 40, None), (5, None, None, 5)], key=str)
    assert rows("left_anti") == [(4, "d", 40)]
