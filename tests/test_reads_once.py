"""Reads are put together once for the consensus of each end, and in the order of their units."""

from strandmill.plans import pair_queries
from strandmill.plans.derived import reads


def test_ends_put_reads_together_once(spark, sf_dir):
    ends = pair_queries._ends(spark, sf_dir)
    assert not [f for f in ends.inputFiles() if "lineitem" in f]  # what consensus looks at twice is a table of reads
    assert ends.count() == reads(spark, sf_dir).where("qend > 0").select("assignment", "chrom", "tech").distinct().count()


def test_units_of_a_read_come_in_order(spark, tmp_path):
    rows = [(9, 2, 3, 4.0), (9, 2, 1, 50.0), (9, 1, 3, 9.0), (9, 1, 3, 1.0), (9, 1, 3, 1.0), (9, 1, 3, None), (9, 1, None, 7.0), (8, 5, 2, 1.0)]
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r.id: r.seq for r in reads(spark, str(tmp_path)).select("id", "seq").collect()}
    turned = "".join(("TTAGGG", "TTAGGG", "TTAGG", "TTAGG", "TTAGGG", "TGAGGG", "TTAGG"))[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert found == {9: turned, 8: "TTGGGG"}
