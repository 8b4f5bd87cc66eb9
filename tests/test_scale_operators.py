"""Operators that deal a contig, a group or a table over many tasks, against plain versions on random input."""

import inspect
import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.functions import sequence
from strandmill.operators import aggregates, intervals, kernels, methylation, pairwise, stats
from strandmill.plans import catalog, group_queries
from tests import plain


def random_intervals(seed, n, most=400, reach=60):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        start = rnd.randrange(most)
        out.append((rnd.choice("ab"), start, start + rnd.choice([0, 1, 3, 10, reach])))
    return out


@pytest.mark.parametrize("seed,width", [(1, 10), (2, 7), (3, 1000)])
def test_merging_in_bins(spark, seed, width):
    rows = random_intervals(seed, 60) + [("c", 0, 10), ("c", 10, 20), ("c", 20, 20), ("c", 30, 40), ("d", 5, 500)]
    want = []
    for c in "abcd":
        merged = []
        for _, s, e in sorted(r for r in rows if r[0] == c):
            if merged and s <= merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], e)
            else:
                merged.append([c, s, e])
        want += merged
    df = spark.createDataFrame(rows, "contig string, start long, stop long")
    assert sorted(map(list, intervals.merge_intervals(df, ["contig"], width=width).collect())) == sorted(want)


@pytest.mark.parametrize("width", [9, 1000])
def test_coverage_in_bins(spark, width):
    rows = [r for r in random_intervals(4, 80) if r[2] > r[1]]
    depth = {}
    for c, s, e in rows:
        for p in range(s, e):
            depth[c, p] = depth.get((c, p), 0) + 1
    got = {}
    for r in intervals.coverage_runs(spark.createDataFrame(rows, "contig string, start long, stop long"), ["contig"], width=width).collect():
        for p in range(r.start, r.stop):
            assert (r.contig, p) not in got
            got[r.contig, p] = r.depth
    assert {k: v for k, v in got.items() if v} == depth


@pytest.mark.parametrize("width", [8, 50, 5000])
def test_nearest_in_bins(spark, width):
    left, rnd = random_intervals(5, 80) + [("z", 1, 2)], random.Random(6)
    right = [(rnd.choice("ab"), rnd.randrange(-50, 600)) for _ in range(25)]
    got = intervals.nearest(spark.createDataFrame(left, "contig string, start long, stop long"), spark.createDataFrame(right, "contig string, at long"), "at", width=width)
    want = []
    for c, s, e in left:
        best = min(((max(s - x, x - e, 0), x) for k, x in right if k == c), default=(None, None))
        want.append((c, s, e, best[1], best[0]))
    assert sorted(map(str, map(tuple, got.select("contig", "start", "stop", "nearest_at", "distance").collect()))) == sorted(map(str, want))


def test_flags_and_reach_in_bins(spark, monkeypatch):
    monkeypatch.setattr(intervals, "WIDTH", 20)
    left, rnd = random_intervals(7, 80), random.Random(8)
    right = [(rnd.choice("ab"), rnd.randrange(-30, 500) / 2) for _ in range(30)]
    a, b = spark.createDataFrame(left, "contig string, start long, stop long"), spark.createDataFrame(right, "contig string, at double")
    for reach in (3, 12.5):
        got = intervals.flag_within(a, "start", b, "at", reach, "near")
        assert sorted(map(tuple, got.select("contig", "start", "stop", "near").collect())) == sorted((c, s, e, any(k == c and abs(s - x) < reach for k, x in right)) for c, s, e in left)
    met = intervals.within_reach(a, b, "at", 9).select("contig", "start", "stop", "at").collect()
    assert sorted(map(tuple, met)) == sorted((c, s, e, x) for c, s, e in left for k, x in right if k == c and (abs(s - x) <= 9 or abs(e - x) <= 9))


@pytest.mark.parametrize("by,block", [(["g"], 1000), (["g"], 3), ([], 4)])
def test_pairs_in_blocks(spark, by, block):
    rows = [(k % 3, k, f"v{k * 7 % 11}") for k in range(23)]
    got = pairwise.unordered_pairs(spark.createDataFrame(rows, "g int, k int, v string"), by, ["k"], ["k", "v"], block=block)
    want = [(a[1], b[1], a[2], b[2]) for a, b in itertools.combinations(rows, 2) if not by or a[0] == b[0]]
    assert sorted(map(tuple, got.select("k_i", "k_j", "v_i", "v_j").collect())) == sorted(want)


def test_call_vector(spark):
    rows = spark.createDataFrame([([3, 0, 3, 9, -1], 6), ([], 3), ([5], 6), ([0, 1, 2], 3)], "calls array<int>, n int")
    got = [r[0] for r in rows.select(methylation.call_vector("calls", F.col("n"))).collect()]
    assert got == [[1, 0, 0, 1, 0, 0], [0, 0, 0], [0, 0, 0, 0, 0, 1], [1, 1, 1]]


def test_disruption_and_fragments_as_expressions(spark):
    rnd = random.Random(11)
    texts = ["", "TTAGGG", "TTAGGGTTAGGGTTAGGG", "CCCTAACCCTAA", "AAAA", "TTAGG", "ttagggttaggg"]
    texts += ["".join(rnd.choice(["TTAGGG", "TTAGGG", "TGAGGG", "A", "CCCTAA", "GGG"]) for _ in range(rnd.randint(1, 30))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sequence.phase_disruption("t").alias("d"), sequence.merged_fragments("t").alias("f"))
    for r in df.collect():
        assert [(x.start, x.length) for x in r.d] == plain.disrupted_spans(r.t), r.t
        assert [tuple(x) for x in r.f] == plain.fragments(r.t), r.t


def test_fragments_of_a_long_text_take_one_pass(spark):
    texts = ["".join(random.Random(4).choice("ACGT") for _ in range(240_000)) + "AC", "é\nßxyzé\nßxyzab", "\U0001f600bcdefg", "A" * 13]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sequence.merged_fragments("t").alias("f"))
    began = time.time()
    for r in df.collect():
        assert [tuple(x) for x in r.f] == plain.fragments(r.t)
    assert time.time() - began < 8  # the text was joined again for each run


def test_best_kmer_coverage_makes_no_row_for_a_kmer(spark):
    rnd = random.Random(9)
    texts = [None, "", "ACGTA", "ACGTAC", "AAAAAAAAA", "ACNNGTACGT", "\U0001f600ACGTACGTACGTAC"] + ["".join(rnd.choice("AACN") for _ in range(rnd.randint(6, 60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    out = aggregates.best_kmer_coverage(df, "id", "t", 6)
    assert not any(x in out._jdf.queryExecution().executedPlan().toString() for x in ("Exchange", "Window", "Generate"))
    for r in out.collect():
        t, most = texts[r.id] or "", 0
        for w in {t[i : i + 6] for i in range(len(t) - 5)}:
            if set(w) <= set("ACGT"):
                most = max(most, len({i + k for i in range(len(t) - 5) if t[i : i + 6] == w for k in range(6)}))
        assert r.coverage == (100.0 * most / len(t) if t else 0.0), t


def test_linkage_equals_the_search_of_the_whole_matrix():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 24):
        d = rng.random((n, n))
        d = (d + d.T) / 2
        np.fill_diagonal(d, 0)
        clusters = {k: [k] for k in range(n)}
        want = []
        while len(clusters) > 1:
            dist, i, j = min((float(np.mean([d[a, b] for a in x for b in y])), i, j) for (i, x), (j, y) in itertools.combinations(clusters.items(), 2))
            want.append((i, j, dist, len(clusters[i]) + len(clusters[j])))
            clusters[n + len(want) - 1] = clusters.pop(i) + clusters.pop(j)
        got = kernels.average_linkage(d)
        assert [(a, b, s) for a, b, _, s in got] == [(*sorted((a, b)), s) for a, b, _, s in want]
        assert [m[2] for m in got] == pytest.approx([m[2] for m in want])


def test_rank_tests_of_small_samples_are_exact(spark):
    rnd = random.Random(12)
    a, b = [rnd.random() for _ in range(5)], [rnd.random() + 0.3 for _ in range(6)]
    u = sum(x > y for x in a for y in b)
    every = []
    for some in itertools.combinations(range(11), 5):
        every.append(sum(x > y for x in some for y in range(11) if y not in some))
    p = min(1, 2 * sum(x >= max(u, 30 - u) for x in every) / len(every))
    rows = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "g string, v double")
    r = stats.mann_whitney(rows, [], "g", "v", "a", "b").first()
    assert (r.n1, r.n2, r.u1) == (5, 6, u) and r.p_value == pytest.approx(p)
    d = [rnd.random() - 0.3 for _ in range(9)]
    ranks = {x: k + 1 for k, x in enumerate(sorted(map(abs, d)))}
    w = min(sum(ranks[abs(x)] for x in d if x > 0), sum(ranks[abs(x)] for x in d if x < 0))
    sums = [sum(k + 1 for k in range(9) if signs >> k & 1) for signs in range(512)]
    r = stats.wilcoxon(spark.createDataFrame([(x, 0.0) for x in d], "x double, y double"), [], "x", "y").first()
    assert r.w == w and r.p_value == pytest.approx(min(1, 2 * sum(s <= w for s in sums) / 512))


def test_p_values_far_out(spark):
    for z in (0.0, 0.5, 3.0, 12.0, 30.0):
        got = spark.range(1).select(stats.normal_tail(F.lit(z))).first()[0]
        assert got == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, rel=2e-7)
    # the t distribution with 1 and 2 degrees of freedom has closed forms
    for r in (0.1, 0.6, 0.99):
        t1, t2 = r / math.sqrt(1 - r * r), r * math.sqrt(2 / (1 - r * r))
        assert stats.beta_share(0.5, 0.5, 1 - r * r) == pytest.approx(1 - 2 / math.pi * math.atan(t1))
        assert stats.beta_share(1.0, 0.5, 1 - r * r) == pytest.approx(1 - t2 / math.sqrt(2 + t2 * t2))


def test_percentiles_and_ranks_over_ranges(spark):
    rnd = random.Random(13)
    values = [rnd.choice([1.0, 2.0, 2.5, 7.0]) if rnd.random() < 0.3 else rnd.random() * 10 for _ in range(500)]
    df = spark.createDataFrame([(v, "a" if k % 3 else "b") for k, v in enumerate(values)], "v double, g string").repartition(7)
    row = stats.exact_percentiles(df, "v", [0.0, 0.1, 0.5, 0.937, 1.0]).first()
    assert list(row) == pytest.approx(np.percentile(values, [0, 10, 50, 93.7, 100]).tolist())
    r = stats.mann_whitney(df, [], "g", "v", "a", "b").first()
    a, b = values[1::3] + values[2::3], values[::3]
    assert r.u1 == pytest.approx(sum((x > y) + (x == y) / 2 for x in a for y in b))


def test_percentiles_of_groups_over_ranges(spark, monkeypatch):
    rnd = random.Random(15)
    groups = {"hot": [rnd.gauss(0, 5) for _ in range(2000)], "same": [3.0] * 40, "one": [7.5], None: [1.0, 2.0, 4.0], "none": [None, None], "mixed": [None, 1.0, 1.0, float("inf")]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for ranges in (2, 16):
        monkeypatch.setattr(stats, "RANGES", ranges)
        got = {r.g: r for r in stats.group_percentiles(df, ["g"], "v", [0.0, 0.3, 0.5, 1.0]).collect()}
        assert got.keys() == groups.keys()
        for g, vs in groups.items():
            known = [v for v in vs if v is not None]
            assert got[g].n == len(known)
            if not known:
                assert list(got[g])[2:] == [None] * 5
                continue
            assert got[g].mean == pytest.approx(sum(known) / len(known))
            want = [1.0, 1.0, 1.0, math.inf] if g == "mixed" else np.percentile(known, [0, 30, 50, 100]).tolist()  # numpy has nan beside inf
            assert list(got[g])[3:] == pytest.approx(want), g
    assert stats.group_percentiles(df.limit(0), ["g"], "v", [0.5]).count() == 0
    assert tuple(stats.group_percentiles(df.limit(0), [], "v", [0.5]).first()) == (0, None, None)


def test_ranks_within_a_hot_group(spark):
    rnd = random.Random(16)
    rows = [("hot" if k % 10 else f"g{k % 7}", rnd.choice([rnd.randrange(30), rnd.random() * 30])) for k in range(1500)]
    rows = [(g, float(v)) for g, v in rows]
    df = spark.createDataFrame([*rows, ("hot", None), (None, 1.0)], "g string, v double").repartition(6)
    want = sorted((g, v, sum(h == g and w < v for h, w in rows) + (sum(h == g and w == v for h, w in rows) + 1) / 2) for g, v in rows)
    assert sorted(map(tuple, stats.average_ranks(df, ["g"], "v").select("g", "v", "rank").collect())) == want


def test_a_hot_group_is_ranked_in_many_tasks(spark):
    counts = spark.range(0, 20_000, 1, 8).selectExpr("'hot' AS g", "id * 7919 % 20011 AS v", "1L AS c")
    ranked = stats._below(counts, ["g"], "v", {"below": F.col("c")}).withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = ranked.groupBy("task").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) == 8 and max(r["count"] for r in tasks) < 20_000 / 3


def test_correlation_of_constants(spark):
    df = spark.createDataFrame([("c", 1.0, 2.0), ("c", 1.0, 3.0), ("c", 1.0, 5.0), ("one", 1.0, 1.0), ("line", 1.0, 2.0), ("line", 2.0, 4.0), ("line", 3.0, 6.0), ("n", None, 1.0)], "g string, x double, y double")
    got = {r.g: (r.n, r.r) for r in stats.pearson(df, ["g"], "x", "y").collect()}
    assert got["c"] == (3, None) and got["one"] == (1, None) and "n" not in got
    assert got["line"] == (3, pytest.approx(1.0))


def test_draws_by_names(spark):
    df = spark.range(200).selectExpr("concat('k', id) AS k", "id % 2 AS g")
    one, two = (sorted(map(tuple, stats.sample_with_replacement(df.repartition(n), ["g"], 100, "k", 3).collect())) for n in (1, 5))
    assert one == two and len(one) == 200 and all(int(k[1:]) % 2 == g for g, k, _ in (tuple(r) for r in stats.sample_with_replacement(df, ["g"], 100, "k", 3).select("g", "k", "draw").collect()))


def test_samples_dont_depend_on_partitions(spark):
    df = spark.range(500).selectExpr("id", "id % 3 AS g")
    one, two = (sorted(map(tuple, stats.sample_per_group(df.repartition(k), ["g"], 7, "id", 5).collect())) for k in (1, 6))
    assert one == two and len(one) == 21
    three, four = (sorted(map(tuple, stats.sample_with_replacement(df.repartition(k), ["g"], 300, "id", 5).select("g", "draw", "id").collect())) for k in (1, 6))
    assert three == four and len(three) == 900 and len({x[2] for x in three}) < 470 and all(i % 3 == g for g, _, i in three)


def test_top_items_of_many(spark):
    rnd = random.Random(14)
    rows = [(rnd.choice("xyz"), f"i{int(rnd.random() ** 3 * 300)}", rnd.randint(1, 4)) for _ in range(3000)]
    whole = {}
    for g, i, n in rows:
        whole[i] = whole.get(i, 0) + n
    top = sorted(whole, key=lambda i: (-whole[i], i))[:6]
    want = {}
    for g, i, n in rows:
        key = (g, i if i in top else "OTHER")
        want[key] = want.get(key, 0) + n
    df = spark.createDataFrame(rows, "g string, i string, n int")
    assert {(r.g, r.i): r.n for r in aggregates.top_and_other(df, "g", "i", "n", 6).collect()} == want


def test_missing_values_in_duplications(spark):
    rows = spark.createDataFrame([(1000.0, 3000.0, 8000.0), (2000.0, 2500.0, float("nan")), (0.0, None, 500.0)], "code_start_1 double, code_end_1 double, code_start_2 double")
    r = aggregates.duplication_distances(rows).first()
    assert (r.size, r.end_to_start, r.start_to_start, r.start, r.midpoint, r.between) == (1.25, 5.0, 3.75, 1.0, 2.125, 5.5)


def test_motif_places_with_a_call(spark):
    rnd = random.Random(17)
    rows = [("s", "".join(rnd.choice("TAG") for _ in range(120)), sorted(rnd.sample(range(130), rnd.randrange(12)))) for _ in range(40)]
    rows += [("s", "TTTT", [0, 0, None]), ("s", "", [1]), ("s", "TTTT", None)]
    want = {}
    for m in ("TA", "TAG"):
        places = [(at, calls or []) for _, t, calls in rows for at in range(len(t)) if t.startswith(m, at)]
        want[m] = (sum(any(p is not None and at <= p < at + len(m) for p in calls) for at, calls in places), len(places))
    hits = spark.createDataFrame(rows, "s string, t string, calls array<int>")
    assert {r.motif: (r.meth, r.total) for r in methylation.motif_counts(hits, "s", "t", "calls", ["TA", "TAG"]).collect()} == want


def test_gated_vectors(spark):
    """Bytes of 0 and 1; calls outside, repeated or null don't matter, null calls give null vectors."""
    rows = spark.createDataFrame([(1, [0, 0, 4, 5, -1, -3, -4, None], 5, 3), (2, [], 2, 0), (3, None, 2, 2)], "k int, calls array<int>, t int, s int")
    out = methylation.gated_vectors(rows.withColumn("spans", F.array().cast("array<struct<start:int,length:int>>")), "calls", "t", "s", "spans")
    got = {r.k: (r.telomere_calls, r.subtelomere_calls) for r in out.collect()}
    assert {k: tuple(None if v is None else list(v) for v in x) for k, x in got.items()} == {1: ([1, 0, 0, 0, 1], [1, 0, 1]), 2: ([0, 0], []), 3: (None, None)}
    sums = {r.k: tuple(r.x) for r in out.select("k", kernels.called_places("telomere_calls").alias("x")).collect() if r.x}
    assert sums[1] == (2, 4) and sums[2] == (0, None)


def test_rows_of_a_table_have_few_copies(spark, tmp_path):
    """pairs_across_table deals 3,000 suppliers into 3 blocks, not into 75, so joins take 6,000 copies of each side at most."""
    spark.range(3000).selectExpr("id AS s_suppkey", "CAST(id % 977 AS DOUBLE) AS s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    out = catalog.QUERIES["pairs_across_table"](spark, str(tmp_path))
    assert out.count() == 3000 * 2999 // 2 and out.where("i >= j").count() == 0
    blocks = pairwise.unordered_pairs(spark.range(64).selectExpr("id AS k"), [], ["k"], ["k"], block=4)
    assert sorted((r.k_i, r.k_j) for r in blocks.collect()) == list(itertools.combinations(range(64), 2))
    assert "block=" not in inspect.getsource(group_queries.pairs_across_table)


def test_overlap_totals_equal_the_pairs_of_the_join(spark):
    """On keys with many pairs at few places, empty intervals at the same places, and nulls."""
    left = spark.range(400).selectExpr("IF(id % 50 = 0, NULL, concat('c', id % 3)) AS contig", "id * 37 % 90 * 1000 AS start", "id * 37 % 90 * 1000 + id % 5 * 700 AS stop")
    right = spark.range(300).selectExpr("concat('c', id % 4) AS contig", "id * 41 % 90 * 1000 AS start", "IF(id % 60 = 7, NULL, id * 41 % 90 * 1000 + id % 4 * 900) AS stop")
    met = left.alias("l").join(right.select("contig", F.col("start").alias("s"), F.col("stop").alias("e")), "contig").where("start < e AND stop > s")
    wanted = met.groupBy("contig").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.least("stop", "e") - F.greatest("start", "s")).alias("shared")).collect()
    found = intervals.overlap_totals(left, right, width=5_000)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted)) and len(wanted) == 3
    assert intervals.overlap_totals(left.limit(0), right).count() == 0


def test_overlap_totals_of_a_square_of_pairs(spark):
    """10^12 pairs of one place are counted, not made."""
    rows = spark.range(1_000_000).selectExpr("'c' AS contig", "5L AS start", "9L AS stop")
    assert [tuple(r) for r in intervals.overlap_totals(rows, rows).collect()] == [("c", 10**12, 4 * 10**12)]


def test_files_of_alignments_grow_in_number(spark, tmp_path, monkeypatch):
    from strandmill.sources import sinks

    monkeypatch.setattr(sinks, "ROWS", 100)
    rows = spark.range(1000).selectExpr("'c' AS rname", "id AS pos")
    sinks.write_alignments(rows, str(tmp_path / "a"))
    assert len(list((tmp_path / "a").glob("*.parquet"))) == 10 and spark.read.parquet(str(tmp_path / "a")).count() == 1000


def test_qualities_of_alignments_that_meet_broadcast_regions(spark, monkeypatch):
    """The same rows as by hashes, for alignments shorter and longer than a bin, at its edges and on contigs without regions."""
    from strandmill.operators import alignments

    rows = [(f"q{k}", f"c{k % 3}", at, 0, 60, f"{n}M", [float((i + k) % 41) for i in range(min(n, 2000))]) for k, (at, n) in enumerate(itertools.product((0, 100, 49_990, 50_000, 99_995, 149_000, 151_000), (1, 11, 900, 50_000, 50_001, 120_000)))]
    df = spark.createDataFrame(rows + rows[:5], "qname string, rname string, pos long, flag int, mapq int, cigar string, quality array<double>")
    regions = spark.createDataFrame([(f"c{k}", a, b) for k in (0, 1) for a, b in ((5, 9), (50_000, 50_001), (99_990, 100_000), (120_000, 180_000), (49_995, 49_999))], "contig string, start long, stop long")

    def found():
        return sorted(map(str, alignments.filter_by_quality(df, regions, 15.0).collect()))

    near = found()
    monkeypatch.setattr(alignments, "FEW", 0)
    assert near == found() and len(near) > 10
