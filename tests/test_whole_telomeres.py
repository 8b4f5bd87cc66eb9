"""The queries over whole telomeres against brute force on the smallest tables, whose telomeres have about 3,500 letters."""

from collections import defaultdict
from statistics import mean, median

import numpy as np
import pytest

from strandmill.plans import catalog, molecule_queries
from strandmill.plans.derived import telomere_reads


@pytest.fixture(scope="module")
def molecules(spark, sf_dir):
    rows = telomere_reads(spark, sf_dir).select("id", "sample", "assignment", "tech", "telo", "spans").collect()
    assert rows and min(len(r.telo) for r in rows) > 2000
    return [(r, [k for k, x in enumerate(r.telo) if x == own(r) and (k + r.id) % 5 == 0]) for r in rows]


def own(r):
    """The base that is called in a molecule."""
    return "T" if r.id % 4 == 1 else "A"


def result(spark, sf_dir, name):
    return {tuple(r)[:-2]: tuple(r)[-2:] for r in catalog.QUERIES[name](spark, sf_dir).collect()}


def test_positions_and_motifs(spark, sf_dir, molecules):
    places, motifs = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for r, calls in molecules:
        for k, x in enumerate(r.telo):
            if x == own(r):
                places[r.assignment, k][0] += k in calls
                places[r.assignment, k][1] += 1
        for m in molecule_queries._MOTIFS:
            at = r.telo.find(m)
            while at >= 0:
                motifs[r.sample, m][0] += any(at <= p < at + 6 for p in calls)
                motifs[r.sample, m][1] += 1
                at = r.telo.find(m, at + 6)
    assert result(spark, sf_dir, "positional_rate") == {k: tuple(v) for k, v in places.items()}
    counted = result(spark, sf_dir, "motif_call_counts")
    assert {k: v for k, v in counted.items() if v[1]} == {k: tuple(v) for k, v in motifs.items()}

    genome = {m: [sum(v[i] for k, v in motifs.items() if k[1] == m) for i in (0, 1)] for m in molecule_queries._MOTIFS}
    got = {(r.sample, r.motif): r.ratio for r in catalog.QUERIES["motif_ratios"](spark, sf_dir).collect()}
    for (s, m), (meth, total) in motifs.items():
        want = meth / total / (genome[m][0] / genome[m][1]) if genome[m][0] else None
        assert got[s, m] == (None if want is None else pytest.approx(want, abs=1e-6))


def test_bins_and_rolling(spark, sf_dir, molecules):
    each, at = defaultdict(lambda: defaultdict(list)), defaultdict(lambda: [0, 0])
    for r, calls in molecules:
        bins = defaultdict(list)
        for k, x in enumerate(r.telo):
            if x == own(r):
                bins[k // 50].append(k in calls)
                at[k][0] += k in calls
                at[k][1] += 1
        for b, v in bins.items():
            each[r.assignment, b][r.sample].append(mean(map(int, v)))
    got = {(r.assignment, r.bin): r.rate for r in catalog.QUERIES["binned_rate"](spark, sf_dir).collect()}
    assert got == pytest.approx({k: median(mean(x) for x in v.values()) for k, v in each.items()}, abs=1e-6)
    order = sorted(at)
    rolled = {order[i]: sum(at[k][0] for k in order[max(0, i - 50) : i + 50]) / sum(at[k][1] for k in order[max(0, i - 50) : i + 50]) for i in range(len(order))}
    assert {r.pos: r.ratio for r in catalog.QUERIES["rolling_ratio"](spark, sf_dir).collect()} == pytest.approx(rolled, abs=1e-6)


def test_variant_rates(spark, sf_dir, molecules):
    rates = defaultdict(lambda: ([], []))
    for r, calls in molecules:
        size = len(r.telo)
        called = np.zeros(size, bool)
        called[[p for p in calls if 0 < p]] = True
        target = np.array(list(r.telo)) == r.telo[int(np.flatnonzero(called)[0])]
        inside = np.zeros(size, bool)
        for s in r.spans[1:-1]:
            if target[s.start : s.start + s.length].any():
                inside[s.start : s.start + s.length] = True
        for mask, out in zip((inside, ~inside), rates[r.sample]):
            if (target & mask).any():
                out.append((called & mask).sum() / (target & mask).sum())
    got = {r.sample: (r.inside, r.outside) for r in catalog.QUERIES["variant_call_rates"](spark, sf_dir).collect()}
    assert set(got) == set(rates)
    for s, sides in rates.items():
        assert got[s] == pytest.approx(tuple(map(mean, sides)), abs=1e-6)


def test_autocorrelation(spark, sf_dir, molecules):
    traces = defaultdict(list)
    for r, calls in molecules:
        if len(r.telo) > 2000:
            x = np.zeros(len(r.telo))
            x[calls] = 1
            x = x[:5000] - x[:5000].mean()
            full = np.correlate(x, x, mode="full")
            traces[r.tech].append(full[len(x) - 1 - 2000 : len(x) + 2000] / full[len(x) - 1])
    want = {(t, k - 2000): v for t, x in traces.items() for k, v in enumerate(np.mean(x, axis=0))}
    got = {(r.tech, r.lag): r.value for r in catalog.QUERIES["mean_autocorrelation"](spark, sf_dir).collect()}
    assert got == pytest.approx(want, abs=2e-6)


def test_binned_rate_whole_keeps_its_bins(spark, sf_dir):
    """By end in bins of 50 bases, not of 250 by technology."""
    got = {(r.assignment, r.bin): r.rate for r in catalog.QUERIES["binned_rate_whole"](spark, sf_dir).collect()}
    assert got == {(r.assignment, r.bin): r.rate for r in catalog.QUERIES["binned_rate"](spark, sf_dir).collect()} and len(got) > 31
    assert "k // 50 " in molecule_queries.ORACLES["binned_rate_whole"]
