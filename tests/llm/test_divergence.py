import re
from collections import Counter

import pytest

from strandmill.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, counts string, p long"


def plain(rows, least=10, top=10):
    docs = [((r[1] or ""), r[2] or "", r[3] or "") for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for lang in {d[1] for d in docs}:
        own = [(s, Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)))) for t, x, s in docs if x == lang]
        in_docs = Counter(t for _, c in own for t in c)
        kept = [t for t, n in in_docs.items() if n >= least]
        counts = {s: Counter() for s, _ in own}
        for s, c in own:
            counts[s].update({t: c[t] for t in kept if t in c})
        v, every = len(kept), sum(counts.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v)
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: {t: share(c, t) for t in kept} for s, c in counts.items()}
        q = {t: share(every, t) for t in kept}
        for s in counts:
            parts = {"pair": [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s], "term": [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, n, k + 1) for k, (i, n) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def rows_of(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def odd():
    """Nulls, empty texts, repeated rows, ties, sources without terms, a language without kept terms and one of a single source."""
    words = "alpha Beta GAMMA délta ÉTÉ 日本 x_y don't a1b".split()
    rows = [(k, " ".join(words[: 1 + k % len(words)]) + "." * (k % 4), "en", f"s{k % 5}") for k in range(60)]
    rows += [(k, "one two", "en" if k % 2 else None, "s1" if k % 3 else None) for k in range(60)]
    rows += [(None, None, "en", "quiet"), (7, "", "en", "empty"), (8, "12 34 \x00", "en", "digits"), (9, "rare", "xx", "a"), (9, "rare", "xx", "b"), (9, None, "yy", "only")]
    rows += [(5, "same words here", "en", "s0")] * 12 + [(6, "zeta " * 500 + "eta", "en", "tail")] * 10
    return [(*r, "t", "c", 1) for r in rows]


def test_equals_a_plain_version_on_odd_rows(spark, odd):
    df = spark.createDataFrame(odd, SCHEMA)
    expected = plain(odd)
    assert rows_of(divergence.audit(df.repartition(5))) == expected
    assert rows_of(divergence.audit(df.coalesce(1))) == expected
    assert {r[3] for r in expected if r[2] == "term"} >= {"ÉtÉ", "日本", "zeta"} and ("xx", "a", "pair", "b", 0, 1) in expected


def test_many_runs_windows_and_a_join_without_broadcast(spark, odd, monkeypatch):
    df = spark.createDataFrame(odd, SCHEMA)
    expected = plain(odd)
    assert rows_of(divergence.audit(df.repartition(3), memory=1)) == expected  # each slice of texts is a run
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    assert rows_of(divergence.audit(df.repartition(3))) == expected


def test_blocks_spill_and_merge_by_heap():
    import numpy as np

    texts = [(f"w{'abcdefgh'[k % 8]} common " * (1 + k % 3), "en", f"s{k % 4}") for k in range(200)]
    whole = Counter()
    runs = []
    for begin in range(0, 200, 23):
        block = divergence._Block()
        some = texts[begin : begin + 23]
        data = "".join(t for t, _, _ in some).encode()
        block.add([x[1] for x in some], [x[2] for x in some], np.frombuffer(data, np.uint8), np.cumsum([0, *(len(t) for t, _, _ in some)]))
        runs += list(block.runs(3))
        for t, _, s in some:
            whole.update((w, s) for w in t.split())
    for run in (r for batch in runs for r in batch.to_pylist()):
        keys = [k[:2] for k in divergence._Run(run).keys(0)]
        assert keys == sorted(keys)
    found = Counter()
    for shard in range(3):
        mine = [b.filter([x == shard for x in b.column("shard").to_pylist()]) for b in runs]
        for batch in divergence._frequencies(10)(iter(mine)):
            for r in batch.to_pylist():
                found.update({(r["term"], s): c for s, c in zip(r["sources"], r["counts"]) if r["term"]})
    assert found == whole


def test_pairs_of_many_sources_in_slices(spark, monkeypatch):
    rows = [(k, f"common w{chr(97 + k % 26)} w{chr(97 + k % 7)}", "en", f"s{k % 40}") for k in range(400)]
    rows = [(*r, "t", "c", 1) for r in rows]
    monkeypatch.setattr(divergence, "PAIRS", 50)
    code = divergence._both
    import pyarrow as pa

    terms = [("en", f"t{t}", f"s{s:02}", 1000 + 7 * t * s % 91, 10 + s) for t in range(9) for s in range(2 + t * 4)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*terms)], names=["lang", "term", "source", "p", "p0"])
    found = Counter()
    for out in code(batch.slice(k, 13) for k in range(0, len(terms), 13)):
        for r in out.to_pylist():
            found[r["a"], r["b"]] += r["value"]
    f = lambda p, q: (p - q) ** 2 // (p + q)
    expected = Counter()
    for x in terms:
        for y in terms:
            if x[1] == y[1] and x[2] < y[2]:
                expected[x[2], y[2]] += f(x[3], y[3]) - f(x[3], y[4]) - f(x[4], y[3]) + f(x[4], y[4])
    assert {k: v for k, v in found.items() if v} == {k: v for k, v in expected.items() if v}
    monkeypatch.undo()
    assert rows_of(divergence.audit(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_shares_are_exact_for_large_counts(spark):
    from pyspark.sql import functions as F

    pairs = [(2, 3), (1, 9 * 10**15), (9 * 10**15 - 1, 9 * 10**15), (5, 5), (123456789012345, 777777777777777)]
    df = spark.createDataFrame(pairs, "c long, n long").select("c", "n", divergence.share(F.col("c"), F.col("n")).alias("p"))
    assert all(r.p == 1 + 10**9 * r.c // r.n for r in df.collect())


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sql_gives_the_same_rows(spark, sf_dir, same):
    same(divergence.op12_divergence(spark, sf_dir), divergence.SQL)
