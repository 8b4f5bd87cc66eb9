import pytest

from strandmill.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, same, name):
    same(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLES[name])


#: What SQL doesn't say; tests/test_query_rows.py and tests/test_target_base.py and tests/test_everywhere.py hold their rows against plain versions.
WITHOUT_SQL = {
    "kmer_hash_scalars", "alignments_by_quality", "alignments_by_every_quality", "binned_variant_rates", "mean_autocorrelation", "trough_peak_rises",
    "kmer_sw_similarity", "global_similarity", "global_clusters", "vector_clusters", "significant_global_clusters", "upgma_clusters", "significant_clusters", "significant_clusters_by_arm",
}


def test_queries_without_sql_are_few():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
