"""Exact p-values of the rank-sum test."""

import math
import time
from itertools import combinations

import pytest

from strandmill.operators import stats


@pytest.mark.parametrize("n1, n2", [(1, 1), (1, 7), (2, 5), (3, 6), (4, 4), (5, 6)])
def test_counts_equal_all_orders(n1, n2):
    u = [sum(sum(1 for y in range(n1 + n2) if y not in some and y < x) for x in some) for some in combinations(range(n1 + n2), n1)]
    assert [stats.u_at_most(n1, n2, k) for k in range(-1, n1 * n2 + 2)] == [sum(x <= k for x in u) for k in range(-1, n1 * n2 + 2)]


def test_a_small_group_against_ten_million():
    began = time.time()
    n2 = 10_000_000
    total = math.comb(n2 + 8, 8)
    assert stats.u_at_most(8, n2, 8 * n2) == total and stats.u_at_most(8, n2, 4 * n2 - 1) == total - stats.u_at_most(8, n2, 4 * n2)  # symmetric
    assert time.time() - began < 1


def test_p_values_in_a_table(spark):
    rows = [("g", "a" if k in (0, 2, 3) else "b", float(k)) for k in range(9)] + [("h", "a", 1.0), ("h", "b", 2.0)]
    found = {r.k: r for r in stats.mann_whitney(spark.createDataFrame(rows, "k string, s string, v double"), ["k"], "s", "v", "a", "b").collect()}
    assert found["g"].p_value == pytest.approx(2 * stats.u_at_most(3, 6, 2) / math.comb(9, 3)) and found["h"].p_value == 1.0
