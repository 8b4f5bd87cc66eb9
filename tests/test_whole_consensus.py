"""Consensus sequences and their similarities beyond the first letters, where arms that begin alike differ."""

import random
from collections import defaultdict
from statistics import median

import numpy as np
import pytest

from strandmill.operators import kernels
from strandmill.plans import catalog
from strandmill.plans.derived import reads


def voted(tails):
    return "".join(min("ACGT", key=lambda x: (-sum(t[k : k + 1] == x for t in tails), x)) for k in range(int(median(map(len, tails)))))


def test_consensus_has_every_column(spark):
    """On more reads than the smallest tables have of an arm."""
    sf = "/root/testdata/sf0.01"
    tails = defaultdict(list)
    for r in reads(spark, sf).collect():
        if 0 < r.qend <= len(r.seq):
            tails[r.assignment].append(r.seq[-r.qend :])
    want = {k: (len(v), int(median(map(len, v))), voted(v)) for k, v in tails.items() if len(v) >= 3}
    got = {r.assignment: (r.n_reads, r.length_bp, r.consensus) for r in catalog.QUERIES["telomere_consensus"](spark, sf).collect()}
    assert got == want and min(len(x[2]) for x in got.values()) > 2000


def test_similarity_has_the_references_caps(spark):
    sf = "/root/testdata/sf0.01"
    caps = range(50, 4050, 50)
    made = defaultdict(list)
    for r in reads(spark, sf).collect():
        if 0 < r.qend <= len(r.seq):
            made[r.assignment, r.sample].append(r.seq[-r.qend :])
    rows = catalog.QUERIES["kmer_sw_similarity"](spark, sf).collect()
    assert rows[0].asDict().keys() == {"assignment", "label_i", "label_j"} | {f"sim_t{c}" for c in caps}
    assert any(r.sim_t4000 != r.sim_t300 for r in rows)
    for r in random.Random(3).sample(rows, 2):
        a, b = (kernels.kmer_codes(voted(made[r.assignment, x])) for x in (r.label_i, r.label_j))
        for cap, best in slow_scores(a, b, [50, 300, 2000, 4000]).items():
            assert r[f"sim_t{cap}"] == pytest.approx(best, abs=2e-6)


def slow_scores(a, b, caps):
    """By anti-diagonals, a pass for each cap."""
    quiet = [int(kernels.kmer_codes(c)[0]) for c in kernels.CANONICAL]
    out = {}
    for cap in caps:
        x, y = a[: max(cap - 5, 0)], b[: max(cap - 5, 0)]
        score = np.where(np.isin(x, quiet)[:, None] | np.isin(y, quiet)[None, :], 0, np.where(x[:, None] == y[None, :], 2, -1))
        h = np.zeros((len(x) + 1, len(y) + 1), int)
        for d in range(2, len(x) + len(y) + 1):
            i = np.arange(max(1, d - len(y)), min(len(x), d - 1) + 1)
            j = d - i
            h[i, j] = np.maximum.reduce([h[i - 1, j - 1] + score[i - 1, j - 1], h[i - 1, j] - 2, h[i, j - 1] - 2, np.zeros(len(i), int)])
        out[cap] = min(1.0, h.max() / (2 * min(len(x), len(y))))
    return out
