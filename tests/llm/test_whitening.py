"""Whitening against sums in plain Python integers."""

import math

import numpy as np
import pytest

from listwright.llm import whitening
from listwright.llm.queries import op11_whitening

SCHEMA = "vec_id long, embedding array<double>, label int, x string, component int"


def rows_of(spark, vectors, ids=None, schema=SCHEMA):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, 0, "own", 9) for i, v in zip(ids, vectors, strict=True)], schema)


def brute(vectors, most=4):
    """Rows by id as the query should give them, up to the sign of a component."""
    whole = {
        i: tuple(math.floor(256 * c) for c in v) for i, v in enumerate(vectors)
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    }
    fit = sorted(set(whole.values()))
    n, dim = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(dim)]
    cov = np.array([[sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit) / n**3 for j in range(dim)] for i in range(dim)])
    value, vector = np.linalg.eigh(cov)
    out = {}
    for i, x in whole.items():
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        centred = np.array([(n * c - s) / n for c, s in zip(x, sums, strict=True)])
        for k in range(min(most, dim)):
            e = value[-1 - k]
            if e > 1e-9:
                out[i, k + 1] = (n, deviation, centred @ vector[:, -1 - k] / math.sqrt(e), e / value.sum())
    return out


def compare(got, want):
    assert {(r.vec_id, r.component) for r in got} == set(want)
    signs = {}
    for r in got:
        n, deviation, white, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error <= 1e-9
        if abs(white) > 1e-6:
            sign = signs.setdefault(r.component, math.copysign(1, white * r.whitened))
            assert r.whitened == pytest.approx(sign * white, rel=1e-6, abs=1e-9)


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    plain = (rng.standard_normal((150, 6)) @ rng.standard_normal((6, 6)) * 0.2).tolist()
    odd = [None, [0.0] * 5 + [None], [0.0] * 5 + [math.nan], [math.inf] + [0.0] * 5, [0.0] * 6, [-0.0] * 6]
    vectors = plain + plain[:40] + [plain[0]] * 60 + odd
    found = whitening.whitened(rows_of(spark, vectors).repartition(5))
    compare(found.collect(), brute(vectors))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.standard_normal((70, 3)) * np.array([3.0, 3e4, 2e3])).tolist()
    compare(whitening.whitened(rows_of(spark, vectors)).collect(), brute(vectors))
    huge = whitening.whitened(rows_of(spark, [[1e300, 0.0], [-1e300, 1.0], [0.0, 2.0]])).collect()
    assert sorted({r.deviation or 0 for r in huge}) == [0, 589825] and all(math.isfinite(r.whitened) for r in huge)


def test_edges(spark):
    # Nothing, one distinct vector, no direction but one, two lengths, repeated and missing ids, an empty vector.
    assert whitening.whitened(rows_of(spark, [])).count() == 0
    assert whitening.whitened(rows_of(spark, [None, []])).count() == 0
    assert whitening.whitened(rows_of(spark, [[1.0, 2.0]] * 3)).count() == 0
    line = whitening.whitened(rows_of(spark, [[1.0, 2.0], [2.0, 2.0], [4.0, 2.0]])).collect()
    assert [r.component for r in line] == [1, 1, 1] and {r.explained for r in line} == {1.0}
    two = whitening.whitened(rows_of(spark, [[1.0], [3.0], [0.0, 1.0], [1.0, 0.5], [3.0, 3.0]], [1, 1, None, 7, 7])).collect()
    assert sorted((r.vec_id or -1, r.component, r.n) for r in two) == [(-1, 1, 3), (-1, 2, 3), (1, 1, 2), (1, 1, 2), (7, 1, 3), (7, 1, 3), (7, 2, 3), (7, 2, 3)]
    named = rows_of(spark, [[1.0], [3.0]], ["a", "b"], SCHEMA.replace("vec_id long", "vec_id string"))
    assert {r.vec_id for r in whitening.whitened(named).collect()} == {"a", "b"}


@pytest.mark.parametrize("rows", [1, 63, 64, 65, 200])
def test_planes_hold_the_numbers(rows):
    rng = np.random.default_rng(rows)
    x = rng.integers(-5, 900, (rows, 4))
    x[:, 2] = 7
    scatter = whitening.Scatter(x.min(axis=0), x.max(axis=0))
    scatter.add(x)
    shifted = x - x.min(axis=0)
    power = np.array([1 << (whitening.SPAN * p) for p in range(len(scatter.sums))])
    assert (power @ scatter.sums == shifted.sum(axis=0)).all()
    assert (np.triu(np.tensordot(power, scatter.products, 1)) == np.triu(shifted.T @ shifted)).all()


def test_the_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    given = [r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()]
    ids = [r.vec_id for r in spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()]
    want = {(ids[i], k): v for (i, k), v in brute(given).items()}
    compare(op11_whitening(spark, folder).collect(), want)
