import random
from collections import defaultdict
from statistics import mean, median

import pytest
from pyspark.sql import functions as F

from strandmill.operators import methylation


def test_positional_rate_on_each_molecules_base(spark):
    rows = spark.createDataFrame([("TTAT", [0, 3]), ("AATA", [0, 1]), ("AAAA", [])], "seq string, calls array<int>")
    got = {r.pos: (r.calls, r.targets) for r in methylation.positional_rate(rows, [], "seq", "calls", None).collect()}
    assert got == {0: (2, 2), 1: (1, 2), 3: (1, 2)}
    bins = methylation.binned_rate(rows.selectExpr("*", "'s' AS s"), [], "s", "seq", "calls", 2, None).collect()
    assert {r.bin: r.rate for r in bins} == pytest.approx({0: 0.75, 1: 0.5})


def test_binned_variant_rates_equal_masks(spark):
    rnd = random.Random(9)
    data = []
    for _ in range(30):
        seq = "".join(rnd.choice("ACGT") for _ in range(rnd.randint(20, 60)))
        base = rnd.choice("AT")
        calls = [k for k, x in enumerate(seq) if x == base and rnd.random() < 0.5]
        spans = [(k, rnd.randint(1, 5)) for k in range(0, len(seq) - 6, 7)]
        data.append((rnd.choice("xy"), rnd.choice("st"), seq, calls, spans))
    rows = spark.createDataFrame(data, "k string, s string, seq string, calls array<int>, spans array<struct<start: int, length: int>>")
    each = defaultdict(lambda: defaultdict(list))
    for k, s, seq, calls, spans in data:
        calls = [p for p in calls if p > 0]
        if not calls:
            continue
        base = seq[calls[0]]
        inside = {p for a, n in spans[1:-1] if base in seq[a : a + n] for p in range(a, a + n)}
        for b in range(0, len(seq), 10):
            for side in (True, False):
                at = [p for p in range(b, min(b + 10, len(seq))) if (p in inside) == side]
                if den := sum(seq[p] == base for p in at):
                    each[k, b // 10, side][s].append(sum(p in calls for p in at) / den)
    want = {key: median(map(mean, v.values())) for key, v in each.items()}
    got = methylation.binned_variant_rates(rows, ["k"], "s", "seq", "calls", "spans", 10).collect()
    assert {(r.k, r.bin, side): v for r in got for side, v in ((True, r.inside_rate), (False, r.outside_rate)) if v is not None} == pytest.approx(want)


def test_subtelomere_calls(spark):
    rows = spark.createDataFrame([([-10, -1, 0, 4], 15, 5)], "calls array<int>, query int, telo int")
    assert rows.select(methylation.subtelomere_calls("calls", "query", "telo").alias("x")).first().x == [0, 9]


def test_bins_of_long_molecules(spark):
    """A hundred molecules of 100,000 bases, all with calls and spans: letters are looked at once, not from the start for each position."""
    import time

    text = "TTAGGG" * 8000 + "TTAGGGA" * 7428
    rows = spark.range(100).select(F.lit(text).alias("seq"), F.expr("transform(sequence(0, 19998), k -> k * 5)").alias("calls"))
    rows = rows.withColumn("spans", F.expr("transform(sequence(0, 4999), k -> struct(k * 20 AS start, 9 AS length))")).selectExpr("*", "'s' AS s")
    began = time.time()
    got = {r.bin: (r.inside_rate, r.outside_rate) for r in methylation.binned_variant_rates(rows, [], "s", "seq", "calls", "spans", 1000).collect()}
    assert time.time() - began < 60
    called = {k * 5 for k in range(1, 19999)}
    inside = {p for k in range(1, 4999) for p in range(k * 20, k * 20 + 9) if text[k * 20 : k * 20 + 9].count(text[5])}
    for b in (0, 50, 99):
        own = {p for p in range(b * 1000, min(b * 1000 + 1000, len(text))) if text[p] == text[5]}
        here = {p for p in called if p // 1000 == b and p < len(text)}
        assert got[b] == pytest.approx((len(here & inside) / len(own & inside), len(here - inside) / len(own - inside)))
