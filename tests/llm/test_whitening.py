import numpy as np
import pytest

from strandmill.llm import whitening


def scaled(vectors):
    return np.floor(64 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000


def check(rows, ids, vectors, components=32, tolerance=1e-8):
    """Rows of the query against numpy's own eigenvectors."""
    x = scaled(vectors)
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    k = int((values > 1e-12 * values[0]).sum())
    assert len(rows) == n * k
    table = {(r.vec_id, r.component): r for r in rows}
    got = np.array([[table[i, c + 1].whitened for c in range(k)] for i in ids])
    expected = centred @ (axes[:, :k] / np.sqrt(values[:k]))
    signs = np.sign((got * expected).sum(axis=0))
    assert np.abs(got * signs - expected).max() < tolerance
    for j, i in enumerate(ids):
        r = table[i, 1]
        assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[j], sums))
    total = np.trace(centred.T @ centred / n)
    assert np.allclose([table[ids[0], c + 1].explained for c in range(k)], values[:k] / total, rtol=1e-9)
    errors = {r.identity_error for r in rows}
    assert len(errors) == 1 and max(errors) < 1e-9
    assert np.abs(got.T @ got / n - np.eye(k)).max() < 1e-9


def frame(spark, rows):
    rows = [(i, v and [None if c is None else float(c) for c in v]) for i, v in rows]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, component int, whitened string")


def run(df, components=32):
    return whitening.whiten(df, whitening.fit(df, components=components)).collect()


def test_equals_numpy_on_the_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    found = whitening.op13_whitening(spark, sf_dir)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(found.collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_rows_that_drop_out_and_odd_ids(spark):
    rng = np.random.default_rng(1)
    good = rng.normal(size=(60, 5)).astype(np.float32).tolist()
    rows = list(enumerate(good)) + [(100, None), (101, [1.0, None, 0, 0, 0]), (102, [1.0, float("nan"), 0, 0, 0]), (103, [float("inf"), 0, 0, 0, 0]), (104, [float("-inf")] * 5)]
    rows += [(105, []), (106, [1.0]), (107, [1e30, 0, 0, 0, 0])]
    found = run(frame(spark, rows).repartition(7))
    check(found, list(range(60)), good)
    twice = frame(spark, [(None, v) for v in good] + [(3, v) for v in good])
    assert len(run(twice)) == 2 * 60 * 5 and {r.n for r in run(twice)} == {120}


def test_directions_without_variance_have_no_component(spark):
    rng = np.random.default_rng(2)
    some = rng.normal(size=(40, 3)).astype(np.float32)
    rows = [(k, [*map(float, v), 0.5, 0.5, float(v[0])]) for k, v in enumerate(some)]
    found = run(frame(spark, rows))
    assert max(r.component for r in found) <= 4
    check(found, list(range(40)), [r[1] for r in rows])
    assert run(frame(spark, [(k, [0.25, 0.5]) for k in range(5)])) == []
    assert run(frame(spark, [(1, [0.25, 0.5])])) == []


def test_no_vectors(spark, tmp_path):
    assert whitening.fit(frame(spark, [])) is None
    assert whitening.fit(frame(spark, [(1, None), (2, [])])) is None
    frame(spark, [(1, None)]).select("vec_id", "embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert whitening.op13_whitening(spark, str(tmp_path)).collect() == []


def test_any_partitioning_and_one_very_common_vector(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(80, 12)).astype(np.float32).tolist()
    vectors = vectors + [vectors[0]] * 300
    df = frame(spark, list(enumerate(vectors)))
    for parts in (1, 40):
        check(run(df.repartition(parts), 8), list(range(len(vectors))), vectors, 8)


SPECTRA = {
    "spread": np.geomspace(1e4, 1e-3, 40),
    "even": np.linspace(1, 2, 50),
    "repeated": np.repeat([9.0, 4.0, 4.0 - 1e-7, 1.0], 12),
    "all equal": np.ones(45),
    "pairs": np.sort(np.concatenate([np.arange(1, 25), np.arange(1, 25) + 1e-10]))[::-1],
    "one large": np.concatenate(([1e6], np.linspace(1, 1.5, 39))),
    "one": np.array([3.0]),
    "zeros": np.concatenate((np.arange(1.0, 10), np.zeros(30))),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_slices_and_contours_miss_no_eigenvalue(name):
    values = np.sort(SPECTRA[name])[::-1]
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    matrix = (q * values) @ q.T
    matrix = (matrix + matrix.T) / 2
    wanted = min(32, len(values))
    parts = whitening.slices(matrix, wanted)
    assert sum(p.count for p in parts) >= wanted
    assert all(a.low == b.high for a, b in zip(parts, parts[1:]))
    found = [whitening.solved(matrix, p) for p in parts if p.count]
    got = np.concatenate([v for v, _ in found])
    assert np.abs(got[:wanted] - values[:wanted]).max() < 1e-12 * values[0]
    axes = np.concatenate([v for _, v in found], axis=1)
    assert np.abs(matrix @ axes - axes * got).max() < 1e-11 * values[0]


def test_inertia_counts():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    values = np.linalg.eigvalsh(a)
    shifts = np.concatenate((values[:-1] + np.diff(values) / 2, [values[0] - 1, values[-1] + 1, 0]))
    assert whitening.counts_above(*whitening.tridiagonal(a), shifts).tolist() == [(values > s).sum() for s in shifts]
    assert whitening.counts_above(*whitening.tridiagonal(np.diag([3.0, 1.0, 2.0])), np.array([1.5, 3.5, 0.0])).tolist() == [2, 0, 3]


def test_a_slice_that_lies_about_its_count_is_refused():
    with pytest.raises(RuntimeError, match="inertia counts"):
        whitening.solved(np.diag([1.0, 2.0, 9.0]), whitening.Slice(0.5, 2.5, 3))


def test_deviations_beyond_a_long_are_refused(spark):
    from pyspark.errors import PythonException

    rows = [(k, [float(k % 2) * 2e8, float(k)]) for k in range(9)]
    with pytest.raises(PythonException, match="more than a long holds"):
        run(frame(spark, rows))
