"""Rounds of components: as many rows as fit a task go without broadcasts, and either way finds the same."""

import pytest

from strandmill.llm import jaccard

CHAIN = [(k, k + 1) for k in range(10, 50)]
STAR = [(-7, k) for k in range(100, 140)]
LINKS = [*CHAIN, *STAR, (60, 60), (71, 70), (70, 71), (80, 81), (82, 81), (82, 83)]
ROOTS = {k: 10 for k in range(10, 51)} | {k: -7 for k in (-7, *range(100, 140))} | {70: 70, 71: 70} | {k: 80 for k in range(80, 84)}


@pytest.mark.parametrize("few", [jaccard.FEW, 0])
def test_components_of_few_and_of_many_links(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    found = jaccard.components(spark.createDataFrame(LINKS, "a long, b long")).collect()
    assert len(found) == len(ROOTS) and {r.node: r.root for r in found} == ROOTS


def test_few_links_need_no_broadcasts(spark, monkeypatch):
    def broadcasts(*_):
        raise AssertionError("each round of these adds broadcasts to the driver")

    monkeypatch.setattr(jaccard, "skew_join", broadcasts)
    found = jaccard.components(spark.createDataFrame(LINKS, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == ROOTS


def test_no_links(spark):
    assert jaccard.components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []
