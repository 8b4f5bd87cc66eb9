"""Shares of signs by blocks, against pairs one by one."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.operators import aggregates, kernels, sign_pairs
from strandmill.plans import catalog

random.seed(5)
VECTORS = {k: (random.choice("ab"), [random.choice([-1.0, 0.0, 1.0, 2.0, None]) for _ in range(random.choice([5, 8]))]) for k in range(40)}


def brute(width=None):
    out = {}
    for i, (g, x) in VECTORS.items():
        for j, (h, y) in VECTORS.items():
            if i < j and g == h:
                size = width or len(x)
                bits = [[v is not None and v > 0 for v in w] for w in (x[:size], y[:size])]
                out[g, f"v{i}", f"v{j}"] = sum(p == q for p, q in zip(*bits)) / size
    return out


@pytest.fixture(scope="module")
def blocks(spark):
    rows = [(k, f"v{k}", g, x) for k, (g, x) in VECTORS.items()] + [(99, "v99", "c", [1.0])]
    df = spark.createDataFrame(rows, "id long, label string, g string, v array<float>").withColumn("bits", sign_pairs.signs("v"))
    return sign_pairs.blocks(df, "g", "id", "label", "bits", block=4)


def test_all_pairs_once(blocks):
    got = sign_pairs.similarities(blocks, "g").collect()
    assert len(got) == len(brute()) and {(r.g, r.label_i, r.label_j): r.sim for r in got} == pytest.approx(brute())


def test_counts(blocks):
    got = {(r.g, round(r.sim, 9)): r.n for r in sign_pairs.similarity_counts(blocks, "g").collect()}
    assert got == Counter((g, round(s, 9)) for (g, _, _), s in brute().items())


@pytest.mark.parametrize("width", [None, 3, 7])
def test_best_partners(blocks, width):
    want = defaultdict(float)
    for (g, i, j), s in brute(width).items():
        want[g, i], want[g, j] = max(want[g, i], s), max(want[g, j], s)
    got = {(r.g, r.label): r.best for r in sign_pairs.best_partners(blocks, "g", [width] if width else None).collect()}
    assert got == pytest.approx(dict(want), abs=1e-6)


def test_box_of_counts(spark):
    rows = [(k % 3, float(k % 7)) for k in range(50)]
    df = spark.createDataFrame(rows, "k int, v double")
    counts = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(aggregates.box_stats_of_counts(counts, ["k"], "v", "n").collect()) == sorted(aggregates.box_stats(df, ["k"], "v").collect())


def test_pairs_that_are_only_counted_have_no_rows(spark, sf_dir):
    """Bands, percentiles and partner curves are made where blocks meet, without a row for each pair."""
    for name in ("banded_similarity", "similarity_by_cap", "partner_curve", "partner_curve_by_length"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "label_j" not in plan


@pytest.mark.parametrize("lengths", [[6], [5, 8]])
def test_vectors_cluster_as_their_pairs(spark, lengths):
    """cluster_vectors holds no matrix, and each of its clusters and cuts is one of average linkage on all pairs; mean_sim is that of the inner pairs."""
    rng = random.Random(3)
    rows = [(k, f"v{k}", rng.choice("ab"), [rng.choice([-1.0, 1.0]) for _ in range(rng.choice(lengths))]) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, label string, g string, v array<float>").withColumn("bits", sign_pairs.signs("v"))
    sim = {frozenset((r.label_i, r.label_j)): r.sim for r in sign_pairs.similarities(sign_pairs.blocks(df, "g", "id", "label", "bits", 7), "g").collect()}
    clusters, alike = defaultdict(list), {}
    for r in kernels.cluster_vectors(df, "g", 0.6).collect():
        clusters[r.g, r.cluster].append(r.label)
        alike[r.g, r.cluster] = r.mean_sim
    assert sorted(x for c in clusters.values() for x in c) == sorted(r[1] for r in rows)
    for (g, k), c in clusters.items():
        inner = [sim[frozenset(p)] for p in itertools.combinations(c, 2)]
        assert alike[g, k] == (pytest.approx(sum(inner) / len(inner)) if inner else None)
        for (h, m), o in clusters.items():
            if g == h and k < m:
                assert sum(sim[frozenset((a, b))] for a in c for b in o) / len(c) / len(o) < 0.6


def test_mean_linkage_has_the_distances_of_the_matrix():
    for n in (1, 2, 60):
        x = 2.0 * np.random.default_rng(n).integers(0, 2, (n, 1001)) - 1
        got = kernels.mean_linkage(x)
        want = kernels.average_linkage(0.5 - x @ x.T / 2002)
        assert [m[:2] + m[3:] for m in got] == [m[:2] + m[3:] for m in want]
        assert [m[2] for m in got] == pytest.approx([m[2] for m in want])
