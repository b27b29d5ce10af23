import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm import queries, whitening

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


@pytest.fixture()
def vectors(spark):
    return lambda rows, parts=3: spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in rows], VECTORS).repartition(parts)


def whole(v):
    return [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]


def against_brute(rows, out):
    """Rows of (id, vector), all usable: every column against numpy on whole rows."""
    x = np.array([whole(v) for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(0)
    away = x * n - sums
    deviation = sorted((away**2).sum(1).tolist())
    centred = away.astype(float) / n
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    values, vectors_ = s**2 / n, vt.T
    k = max(r.component for r in out)
    assert sorted({r.component for r in out}) == list(range(1, k + 1)) and len(out) == k * n
    assert sorted(int(r.deviation) for r in out if r.component == 1) == deviation
    for c in range(1, k + 1):
        own = [r for r in out if r.component == c]
        assert {r.n for r in own} == {n} and max(r.identity_error for r in own) <= 1e-6
        assert all(abs(r.explained / (values[c - 1] / values.sum()) - 1) < 1e-6 for r in own)
        expected = dict(zip([i for i, _ in rows], centred @ vectors_[:, c - 1] / math.sqrt(values[c - 1]), strict=True))
        got = np.array([[expected[r.vec_id], r.whitened] for r in own])
        sign = np.sign((got[:, 0] * got[:, 1]).sum())
        assert np.abs(got[:, 0] - sign * got[:, 1]).max() < 1e-6
    return k


def test_equals_numpy_on_all_rows(vectors):
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(150, 12)) * 2.0 ** -np.arange(12))]
    assert against_brute(rows, whitening.whiten(vectors(rows)).collect()) == 8


def test_ill_conditioned_rows(vectors):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(200, 1))
    rows = [(i, v) for i, v in enumerate(np.hstack([base * 5000, base * 5000 + rng.normal(size=(200, 1)) * 0.01, rng.normal(size=(200, 2))]))]
    assert against_brute(rows, whitening.whiten(vectors(rows)).collect()) == 4


def test_unusable_rows_go_and_repeats_stay(vectors):
    rng = np.random.default_rng(5)
    good = [(i, v) for i, v in enumerate(rng.normal(size=(40, 5)))]
    good += [good[0], good[0]]
    bad = [(100, None), (101, [1, None, 1, 1, 1]), (102, [1, float("nan"), 1, 1, 1]), (103, [float("-inf")] * 5)]
    out = whitening.whiten(vectors(good + bad).withColumn("x", F.lit(1)).withColumn("n", F.lit("n"))).collect()
    assert against_brute(good, out) == 5
    assert sum(r.vec_id == 0 for r in out) == 15


def test_null_ids_stay(vectors):
    rng = np.random.default_rng(6)
    out = whitening.whiten(vectors([(None if i < 3 else i, v) for i, v in enumerate(rng.normal(size=(30, 3)))])).collect()
    assert sum(r.vec_id is None for r in out) == 9


def test_directions_without_rows_are_no_components(vectors):
    rng = np.random.default_rng(7)
    a = rng.integers(-9, 9, size=(60, 2))
    rows = [(i, [p, q, p, 7, p + q]) for i, (p, q) in enumerate(a.tolist())]
    assert against_brute(rows, whitening.whiten(vectors(rows)).collect()) == 2


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 2])], [(1, [3, 3]), (2, [3, 3])], [(1, []), (2, [])]])
def test_nothing_varies(vectors, rows):
    assert whitening.whiten(vectors(rows)).collect() == []


def test_one_dimension(vectors):
    assert against_brute([(i, [i * i]) for i in range(9)], whitening.whiten(vectors([(i, [i * i]) for i in range(9)])).collect()) == 1


def test_sums_beyond_64_bits_stay_exact(vectors):
    rows = [(i, [(-1) ** i * 2e8 + i, i]) for i in range(50)]
    x = [whole(v) for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    expected = {i: sum((50 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for (i, _), v in zip(rows, x, strict=True)}
    assert max(expected.values()) > 2**63
    assert {r.vec_id: int(r.deviation) for r in whitening.whiten(vectors(rows)).collect()} == expected


def test_lengths_must_agree(vectors):
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(vectors([(1, [1, 2]), (2, [1, 2, 3])], 1)).collect()
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(vectors([(1, [1, 2]), (2, [1, 2, 3])], 2)).collect()


def test_triangular_solve():
    rng = np.random.default_rng(8)
    r, rows = np.triu(rng.normal(size=(6, 6))) + 3 * np.eye(6), rng.normal(size=(20, 6))
    assert np.allclose(whitening._solved(rows, r) @ r, rows)


def test_query(spark):
    out = queries.op11_whitening(spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes) | {"vec_id": "bigint"} == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert against_brute(rows, out.collect()) == 8
