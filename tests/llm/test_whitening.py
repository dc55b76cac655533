import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import whitening
from tessera.llm.queries import op13_whitening

from .conftest import SF01


def integers(rows, scale=256):
    good = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    return [(i, tuple(math.floor(scale * x) for x in v) + (0,) * (width - len(v))) for i, v in good]


def compare(found, rows, k=4):
    """Against a plain covariance of the distinct vectors."""
    own = integers(rows)
    fit = sorted({x for _, x in own})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    X = np.array(fit, float)
    V = (X - X.mean(axis=0)).T @ (X - X.mean(axis=0)) / n
    e, q = np.linalg.eigh(V)
    e, q = e[::-1], q[:, ::-1]
    k = min(k, int((e > len(e) * 2.3e-16 * e[0]).sum()))
    got = {}
    for r in found:
        got.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    want = {}
    for i, x in own:
        want.setdefault((i, sum((n * c - s) ** 2 for c, s in zip(x, sums))), []).append(x)
    assert got.keys() == want.keys()
    signs = {}
    for key, xs in want.items():
        assert sorted(got[key]) == list(range(1, k + 1))
        for c in range(k):
            rs = got[key][c + 1]
            assert len(rs) == len(xs) and {r.n for r in rs} == {n}
            assert all(abs(r.explained / (e[c] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-9 for r in rs)
            w = sorted(float((np.array(x, float) - X.mean(axis=0)) @ q[:, c] / math.sqrt(e[c])) for x in xs)
            g = sorted(r.whitened for r in rs)
            if c not in signs and max(map(abs, w)) > 0.3:
                signs[c] = 1 if np.allclose(g, w, atol=1e-7) else -1
            if c in signs:
                assert np.allclose(g, w if signs[c] > 0 else [-x for x in reversed(w)], atol=1e-7)


def test_query_equals_plain_covariance(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    compare(op13_whitening(spark, SF01).collect(), rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(0)
    rows = [(i, list(map(float, v))) for i, v in enumerate(rng.normal(size=(40, 3)))]
    rows += [(100, None), (101, [None, 1.0]), (102, [nan, 1.0]), (103, [inf]), (104, []), (105, [1.5]), (106, [1.5, 0.0, 0.0]), (0, rows[0][1]), (0, rows[0][1]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("x", F.lit("clash")).withColumn("component", F.lit("clash"))
    compare(whitening.whiten(df, whitening.fit(df)).collect(), rows)
    for few in (df.limit(0), df.where("vec_id = 5"), df.where("vec_id in (100, 104)")):
        assert whitening.whiten(few, whitening.fit(few)).collect() == []
    two = df.where("vec_id in (5, 6)")
    assert [r.component for r in whitening.whiten(two, whitening.fit(two)).collect()] == [1, 1]


def test_copies_ties_and_partitions(spark):
    """A vector with most of the rows, equal eigenvalues, and many spectra."""
    rows = [(i, [4.0 if j == i % 6 else 0.0 for j in range(6)]) for i in range(6)]
    rows += [(100 + i, [float(i % 2)] * 6) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(9)
    model = whitening.fit(df)
    assert model.n == 8 and np.allclose(model.components.T @ model.components, np.eye(4), atol=1e-12)
    found = whitening.whiten(df, model).toPandas()
    assert (found.identity_error < 1e-9).all() and len(found) == 4 * len(rows)


def test_deviations_are_exact():
    model = whitening.Whitening(10**6, np.array([3 * 10**12, -5], object), 1.0, np.ones(1), np.ones((2, 1)))
    for x, y in ((7, 9), (10**9, 0), (10**14, 1)):
        want = (10**6 * x - 3 * 10**12) ** 2 + (10**6 * y + 5) ** 2
        assert model.deviations(np.array([[x, y]])) == [want if want < 1 << 63 else None]


@pytest.mark.parametrize("n,d,rank", [(1, 4, 4), (5, 8, 8), (400, 12, 12), (400, 12, 5), (9000, 6, 6)])
def test_updates_equal_one_decomposition(n, d, rank):
    rng = np.random.default_rng(n + d)
    rows = rng.integers(-500, 500, size=(n, d))
    rows[:, rank:] = rows[:, : d - rank]
    parts = []
    for some in np.array_split(rows, 3):
        own = whitening.Spectrum.empty(d)
        own.add_rows(some)
        parts.append(own)
    total = whitening.Spectrum.empty(d)
    for p in parts:
        total.add(p)
    centred = rows - rows.mean(axis=0)
    scatter = centred.T @ centred
    size = max(1.0, np.abs(scatter).max())
    assert total.n == n and [int(s) for s in total.sums] == rows.sum(axis=0).tolist()
    assert np.abs((total.vectors * total.values) @ total.vectors.T - scatter).max() < 1e-11 * size
    assert np.abs(total.vectors.T @ total.vectors - np.eye(d)).max() < 1e-11


def test_secular_roots():
    """Against exact sign changes, with poles close together and tiny weights."""
    poles = np.array([0.0, 1e-9, 1.0, 1.0 + 1e-10, 5.0])
    weights = np.array([1e-14, 0.3, 1e-6, 0.2, 1e-3])
    near, x = whitening.secular_roots(poles, weights)
    for i, (at, step) in enumerate(zip(near, x)):
        def f(d):
            return 1 + sum(Fraction(w) / (Fraction(p) - Fraction(poles[at]) - d) for p, w in zip(poles.tolist(), weights.tolist()))

        d = Fraction(float(step))
        assert f(d * (1 - Fraction(1, 10**10)) if step > 0 else d * (1 + Fraction(1, 10**10))) < 0
        assert f(d * (1 + Fraction(1, 10**10)) if step > 0 else d * (1 - Fraction(1, 10**10))) > 0
