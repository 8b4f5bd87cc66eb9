"""Lists and matrices of all pairs: compiled, dealt once, in runs, and as SQL has them on odd rows."""

import itertools
import random

import duckdb
import pytest

from strandmill.operators import pairwise, sign_pairs
from strandmill.plans import catalog
from tests.conftest import comparable

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n, lengths, twice=()):
    rng = random.Random(n)
    rows = [(k, [rng.choice([-1.0, 0.0, 2.0, None, float("nan")]) for _ in range(rng.choice(lengths))], rng.choice([0, 1, None])) for k in range(n)]
    rows += [(n, None, 0), (n + 1, None, None), (n + 2, [], 1), (None, [1.0], 0), (n + 3, [1.0], 7)]
    return rows + [(rows[k][0], rows[k - 1][1], rows[k][2]) for k in twice]


def like_sql(spark, path, name, table, df):
    df.write.parquet(f"{path}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    out, result = catalog.QUERIES[name](spark, str(path)), con.execute(catalog.ORACLES[name])
    assert out.columns == [d[0] for d in result.description]
    want = sorted(str(comparable(list(r))) for r in result.fetchall())
    assert sorted(str(comparable(list(r))) for r in out.collect()) == want and want
    return out


def compiled(df):
    plan = df._jdf.queryExecution().toString()
    return not any(x in plan for x in ("MapInArrow", "ArrowEvalPython", "round("))


def runs(df, path, column):
    """Rows for each change of a column in the files."""
    df.write.parquet(str(path))
    changes = rows = 0
    for file in path.glob("*.parquet"):
        values = duckdb.execute(f"SELECT {column} FROM '{file}'").fetchall()
        rows, changes = rows + len(values), changes + sum(a != b for a, b in itertools.pairwise(values)) + 1
    return rows / changes


@pytest.mark.parametrize("lengths", [[64], [3, 64, 65, 130], [2100, 5]])
@pytest.mark.parametrize("twice", [(), (3, 4)])
def test_matrix(spark, tmp_path, lengths, twice):
    assert compiled(like_sql(spark, tmp_path, "pair_similarity_matrix", "embeddings", spark.createDataFrame(vectors(30, lengths, twice), SCHEMA)))


def test_matrix_in_runs(spark, tmp_path):
    """Rows of a name stand together, so files need few bytes for it."""
    spark.range(400).selectExpr("id AS vec_id", "transform(sequence(1, 64), i -> float(hash(id, i))) AS embedding", "0 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert runs(catalog.QUERIES["pair_similarity_matrix"](spark, str(tmp_path)), tmp_path / "out", "row") > 50


@pytest.mark.parametrize("both", [False, True])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_each_pair_once(spark, monkeypatch, by, both):
    monkeypatch.setattr(pairwise, "ORDERED_BLOCK", 7)
    monkeypatch.setattr(pairwise, "SMALL_BLOCK", 5)
    monkeypatch.setattr(pairwise, "CHUNK", 3)
    rows = [(k % 4 or None, k % 45, k) for k in range(60)] + [(1, None, 60)]
    found = pairwise.ordered_pairs(spark.createDataFrame(rows, "g int, k int, v int").select(*by, "k", "v"), by, "k", both)
    got = sorted((r._l.v, r._r.v) for r in found.collect())
    keep = [r for r in rows if r[1] is not None and (r[0] is not None or not by)]
    assert got == sorted((a[2], b[2]) for a in keep for b in keep if (a[1] != b[1] if both else a[1] < b[1]) and (not by or a[0] == b[0]))


def test_share_rounds_as_round(spark):
    """Halves go up, as in round(); a share of nothing is null."""
    df = spark.range(1, 700).selectExpr("id AS n", "explode(sequence(0L, id)) AS k")
    assert df.where(f"{sign_pairs.share('k', 'n')} != round(CAST(k AS DOUBLE) / n, 6)").count() == 0
    assert spark.sql(f"SELECT {sign_pairs.share('0', '0')} AS a, {sign_pairs.share('0', 'CAST(NULL AS INT)')} AS b").first() == (None, None)


@pytest.mark.parametrize("lengths", [[64], [3, 64, 65, 130], [2100, 5]])
@pytest.mark.parametrize("twice", [(), (3, 4)])
def test_list(spark, tmp_path, lengths, twice):
    assert compiled(like_sql(spark, tmp_path, "pairs_within_group", "embeddings", spark.createDataFrame(vectors(30, lengths, twice), SCHEMA)))


@pytest.mark.parametrize("lengths", [[64], [3, 64, 65, 130]])
@pytest.mark.parametrize("twice", [(), (3, 4)])
def test_means(spark, tmp_path, lengths, twice):
    out = like_sql(spark, tmp_path, "unordered_pair_means", "embeddings", spark.createDataFrame(vectors(30, lengths, twice), SCHEMA))
    assert twice or compiled(out)


def test_rows_are_dealt_once(spark, tmp_path):
    """Equal or missing keys are no pair; a key that is the same everywhere made the join deal both sides again, into few tasks."""
    rows = [(k // 2 if k % 9 else None, float(k * 37 % 500) if k % 7 else None) for k in range(80)]
    out = like_sql(spark, tmp_path, "pairs_across_table", "supplier", spark.createDataFrame(rows, "s_suppkey long, s_acctbal double"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    above = [a for a, b in itertools.pairwise(plan.splitlines()) if "REPARTITION_BY_NUM" in b]
    assert len(above) >= 2 and not any("Exchange" in a for a in above)
