"""The rows of queries without SQL, against plain versions over the same tables."""

import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest

from strandmill.operators import kernels
from strandmill.plans import catalog
from strandmill.plans.derived import reads, relation, telomere_reads
from strandmill.plans.pair_queries import _pairs


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_kmer_hash_scalars(spark, sf_dir):
    want = set()
    for r in telomere_reads(spark, sf_dir).select("telo").collect():
        for k in range(0, len(r.telo) - 5, 6):
            kmer = r.telo[k : k + 6]
            if set(kmer) <= set("ACGT"):
                key = min(kmer, turned(kmer))
                want.add((kmer, key, round(zlib.crc32(key.encode()) / 4294967295, 12)))
    assert {(r.kmer, r.key, round(r.scalar, 12)) for r in catalog.QUERIES["kmer_hash_scalars"](spark, sf_dir).collect()} == want


def merged(rows):
    out = defaultdict(list)
    for contig, start, stop in sorted(rows):
        if out[contig] and start <= out[contig][-1][1]:
            out[contig][-1][1] = max(stop, out[contig][-1][1])
        else:
            out[contig].append([start, stop])
    return out


def test_alignments_by_quality(spark, sf_dir):
    """Bases are laid on the reference one by one: five clipped ones at the start, the matched, three inserted where the walk stands."""
    regions = merged((r.contig, max(r.start - 20_000, 0), r.stop + 20_000) for r in relation(spark, sf_dir, "telomeres").collect())
    want = []
    for a in relation(spark, sf_dir, "alignments").collect():
        size = a.stop - a.pos
        if size <= 0 or a.flag & 2308:
            continue
        q = [(k * 7 + a.mapq) % 41 for k in range(1, size + 9)]
        place = [a.pos] * 5 + [a.pos + k for k in range(size)] + [a.pos + size] * 3
        means = []
        for start, stop in regions[a.rname]:
            if start < a.pos + size + 2 and stop > a.pos:
                some = [x for x, p in zip(q, place) if start <= p < stop]
                means += [sum(some) / len(some)] if some else []
        if means and max(means) >= 19:
            want.append((a.qname, a.rname, a.pos, len(means), round(max(means), 6)))
    got = catalog.QUERIES["alignments_by_quality"](spark, sf_dir).collect()
    assert sorted((r.qname, r.rname, r.pos, r.regions, round(r.best, 6)) for r in got) == sorted(want)


def test_alignments_by_every_quality(spark, sf_dir):
    regions = merged((r.contig, r.start, r.stop) for r in relation(spark, sf_dir, "satellites").collect())
    want = []
    for a in relation(spark, sf_dir, "alignments").collect():
        size = a.stop - a.pos
        if size <= 0 or a.flag & 2308:
            continue
        q = [(k * 7 + a.mapq) % 41 for k in range(1, size + 1)]
        means = []
        for start, stop in regions[a.rname]:
            some = q[max(start - a.pos, 0) : max(stop - a.pos, 0)]
            means += [sum(some) / len(some)] if some else []
        if means and min(means) >= 20:
            want.append((a.qname, a.flag, a.rname, a.pos, len(means), round(min(means), 6)))
    got = catalog.QUERIES["alignments_by_every_quality"](spark, sf_dir).collect()
    assert sorted((r.qname, r.flag, r.rname, r.pos, r.regions, round(r.least, 6)) for r in got) == sorted(want) and want


def plain_clusters(labels, sim, cut):
    clusters = [[x] for x in sorted(labels)]
    while len(clusters) > 1:
        best, i, j = min((np.mean([1 - sim.get(frozenset((a, b)), 0) for a in x for b in y]), i, j) for (i, x), (j, y) in itertools.combinations(enumerate(clusters), 2))
        if best > cut:
            break
        clusters[i] += clusters.pop(j)
    return {frozenset(c) for c in clusters}


def test_clusters(spark, sf_dir):
    pairs = defaultdict(dict)
    for r in _pairs(spark, sf_dir).collect():
        pairs[r.assignment][frozenset((r.label_i, r.label_j))] = r.sim
    got = defaultdict(lambda: defaultdict(set))
    for r in catalog.QUERIES["upgma_clusters"](spark, sf_dir).collect():
        got[r.assignment][r.cluster].add(r.label)
    mean = lambda sim, x, y: float(np.mean([1 - sim.get(frozenset((a, b)), 0) for a in x for b in y]))
    for arm, sim in pairs.items():
        clusters = list(got[arm].values())
        assert sorted(x for c in clusters for x in c) == sorted({x for p in sim for x in p})
        # Equal similarities leave the order of merges open; whatever it was, nothing is left to merge and each cluster holds by itself
        assert all(mean(sim, x, y) > 0.4 for x, y in itertools.combinations(clusters, 2))
        assert all(len(plain_clusters(c, sim, 0.4 + 1e-9)) == 1 for c in clusters)
    for name, arms in (("significant_clusters", None), ("significant_clusters_by_arm", (2, 12))):
        clusters = defaultdict(list)
        for r in kernels.cluster_groups(_pairs(spark, sf_dir), "assignment", 0.55).collect():
            clusters[r.assignment, r.cluster].append(r.label)
        want = []
        for (arm, k), c in clusters.items():
            inner = [round(pairs[arm][frozenset(p)], 6) for p in itertools.combinations(c, 2)]
            ids = [int(x[1:]) for x in c]
            contigs = len({i % 7 for i in ids}) if arms else len(c)
            if len(c) >= 3 and np.mean(inner) >= 0.5 and (not arms or contigs >= 2 and arms[0] <= len({i % 5 for i in ids}) <= arms[1]):
                want.append((arm, k, len(c), round(float(np.mean(inner)), 4)))
        assert sorted((r.assignment, r.cluster, r.members, round(r.mean_sim, 4)) for r in catalog.QUERIES[name](spark, sf_dir).collect()) == sorted(want)


def test_mean_autocorrelation_and_rises(spark, sf_dir):
    traces = defaultdict(list)
    for r in telomere_reads(spark, sf_dir).collect():
        x = np.array([float(b == ("T" if r.id % 4 == 1 else "A") and (k + r.id) % 5 == 0) for k, b in enumerate(r.telo)])
        if len(x) <= 2000 or not x.any():
            continue
        x = x[:5000] - x[:5000].mean()
        full = np.correlate(x, x, "full")
        middle = len(x) - 1
        traces[r.tech].append(full[middle - 2000 : middle + 2001] / full[middle])
    got = defaultdict(dict)
    for r in catalog.QUERIES["mean_autocorrelation"](spark, sf_dir).collect():
        got[r.tech][r.lag] = r.value
    for tech, some in traces.items():
        assert [got[tech][k] for k in range(-2000, 2001)] == pytest.approx(np.mean(some, axis=0).tolist(), abs=2e-6)
    rises = defaultdict(dict)
    for r in catalog.QUERIES["trough_peak_rises"](spark, sf_dir).collect():
        rises[r.tech][r.step] = r.rise
    for tech in traces:
        want = kernels.trough_peak_steps(np.array([got[tech][k] for k in range(1, 2001)]))
        assert [rises[tech][k] for k in range(len(want))] == pytest.approx(want, abs=1e-8)


def test_kmer_sw_similarity(spark):
    """Three pairs at the caps to 400, by a table of all cells."""
    sf_dir = "/root/testdata/sf0.01"
    tails = defaultdict(list)
    for r in reads(spark, sf_dir).collect():
        if 0 < r.qend <= len(r.seq):
            tails[r.assignment, r.sample].append(r.seq[-r.qend :])
    canon = {"TTAGGG", "CCCTAA"}

    def consensus(group):
        width = int(np.median([len(t) for t in group]))
        return "".join(max("ACGT", key=lambda b: (sum(t[k : k + 1] == b for t in group), -ord(b))) for k in range(min(width, 400)))

    for r in catalog.QUERIES["kmer_sw_similarity"](spark, sf_dir).limit(3).collect():
        a, b = (consensus(tails[r.assignment, x]) for x in (r.label_i, r.label_j))
        ka, kb = ([s[k : k + 6] for k in range(len(s) - 5)] for s in (a, b))
        table, top = np.zeros((len(ka) + 1, len(kb) + 1)), np.zeros((len(ka) + 1, len(kb) + 1))
        for i in range(1, len(ka) + 1):
            for j in range(1, len(kb) + 1):
                score = 0 if ka[i - 1] in canon or kb[j - 1] in canon else 2 if ka[i - 1] == kb[j - 1] else -1
                table[i, j] = max(0, table[i - 1, j - 1] + score, table[i - 1, j] - 2, table[i, j - 1] - 2)
                top[i, j] = max(table[i, j], top[i - 1, j], top[i, j - 1])
        for cap in range(50, 401, 50):
            i, j = min(len(ka), cap - 5), min(len(kb), cap - 5)
            assert r[f"sim_t{cap}"] == pytest.approx(min(1, top[i, j] / (2 * min(i, j))), abs=1e-5)
