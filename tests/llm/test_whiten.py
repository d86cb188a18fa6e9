"""Whitening against plain integer sums and numpy."""

import math

import numpy as np
import pytest

from annolink.llm import whiten
from annolink.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows):
    """x by row, n, sums, eigenvalues, eigenvectors, trace; from a plain covariance of the distinct vectors."""
    x = [(k, [math.floor(256 * c) for c in v]) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(v) for _, v in x}), dtype=np.float64)
    n, s = len(fit), [int(v) for v in fit.sum(axis=0)]
    centred = fit - fit.mean(axis=0)
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    return x, n, s, e[::-1], u[:, ::-1], np.trace(cov)


def compare(rows, got):
    x, n, s, e, u, trace = brute(rows)
    centre = [(k, [n * a - b for a, b in zip(v, s)]) for k, v in x]
    want = sorted(((k is None, k or 0, c, sum(v * v for v in centred)), centred) for k, centred in centre for c in range(1, 5))
    place = lambda r: (r.vec_id is None, r.vec_id or 0, r.component, r.deviation)
    got = sorted(got, key=place)
    assert [place(r) for r in got] == [k for k, _ in want]
    sign = {}
    for r, ((_, _, c, _), centred) in zip(got, want):
        assert r.n == n
        w = (np.array(centred) / n) @ u[:, c - 1] / math.sqrt(e[c - 1])
        sign.setdefault(c, 1 if abs(r.whitened - w) <= abs(r.whitened + w) else -1) if abs(w) > 1e-3 else None
        assert abs(r.whitened - sign.get(c, 1) * w) < 1e-6
        assert abs(r.explained - e[c - 1] / trace) <= 1e-9 and 0 <= r.identity_error < 1e-9


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    got = QUERIES["op13_whitening"](spark, d)
    assert dict(got.dtypes) | {"component": "int", "deviation": "bigint", "n": "bigint"} == dict(got.dtypes)
    compare([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()], got.collect())


def test_edge_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(np.float32(v)) for v in rng.normal(size=6) * [9, 5, 3, 2, 1, 0]]) for k in range(200)]
    # copies, repeated and null ids, equal after rounding, and rows that go
    rows += [(1000 + k, rows[7][1]) for k in range(300)] + [(3, rows[8][1]), (3, rows[9][1]), (None, rows[4][1]), (None, rows[5][1]), (2**53 + 1, rows[5][1])]
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (2003, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(k, v, None) for k, v in rows], SCHEMA).repartition(7)
    compare(rows, whiten.whiten(df.withColumnRenamed("label", "x")).collect())


def test_few_vectors(spark):
    def out(vectors):
        return whiten.whiten(spark.createDataFrame([(k, v, 0) for k, v in enumerate(vectors)], SCHEMA)).collect()

    assert out([]) == [] and out([None]) == [] and out([[1.0, 2.0]] * 5) == [] and out([[]]) == []
    # two distinct vectors have one component; the shorter one counts as (1, 0)
    got = out([[1.0, 2.0], [1.0], [1.0, 2.0]])
    assert [(r.vec_id, r.component, r.n) for r in sorted(got, key=lambda r: r.vec_id)] == [(0, 1, 2), (1, 1, 2), (2, 1, 2)]
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and r.explained == 1 and r.deviation == 512**2 for r in got)


@pytest.mark.parametrize("bits", [1, 8, 20, 40, 62])
def test_exact_products(bits):
    x = np.random.default_rng(bits).integers(-(1 << bits), 1 << bits, (777, 5))
    g, s = whiten.block_moments(x)
    o = x.astype(object)
    assert (g == o.T @ o).all() and (s == o.sum(axis=0)).all()
