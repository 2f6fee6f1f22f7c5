from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import whitening
from tidemark.llm.queries import op12_whitening

SCHEMA = "vec_id long, embedding array<float>, n int, x string, component string"


def slow(rows, components=4):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} of rows (id, vector), with fractions."""
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    whole = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in usable]
    fit = sorted({x for _, x in whole})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    centred = [[Fraction(x[j]) - Fraction(sums[j], n) for j in range(d)] for x in fit]
    v = [[sum(c[i] * c[j] for c in centred) / n for j in range(d)] for i in range(d)]
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in row] for row in v]))
    trace = float(sum(v[i][i] for i in range(d)))
    out = {}
    for i, x in whole:
        deviation = sum((n * x[j] - sums[j]) ** 2 for j in range(d))
        for c in range(min(components, d)):
            e, u = values[-1 - c], vectors[:, -1 - c]
            z = sum(float(Fraction(x[j]) - Fraction(sums[j], n)) * u[j] for j in range(d)) / math.sqrt(e) if e > 1e-9 * trace else None
            out.setdefault((i, c + 1), []).append((n, deviation, z, e / trace if trace else None))
    return out


def check(table, rows):
    got, want = {}, slow(rows)
    for r in whitening.whiten(table).collect():
        got.setdefault((r.vec_id, r.component), []).append(r)
    assert got.keys() == want.keys()
    signs = {}
    for at, expected in want.items():
        assert len(got[at]) == len(expected)
        for r, (n, deviation, z, explained) in zip(got[at], expected):
            assert (r.n, r.deviation) == (n, deviation if deviation < 1 << 63 else None)
            assert r.explained is None if explained is None else math.isclose(r.explained, explained, rel_tol=1e-6, abs_tol=1e-12)
            if z is None:
                assert r.whitened is None
            elif abs(z) > 1e-6:
                signs.setdefault(at[1], set()).add(round(r.whitened / z, 6))
            assert r.identity_error is None or r.identity_error < 1e-9
    assert all(s in ({1.0}, {-1.0}) for s in signs.values())


def vectors(n, d, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) * np.geomspace(1, 0.05, d)).astype(np.float32)


def test_odd_rows_are_left_out_and_equal_vectors_count_once(spark):
    v = vectors(60, 6).tolist()
    rows = [(i, x, 1, "a", "b") for i, x in enumerate(v)]
    rows += [(5, v[5], 1, "a", "b"), (100, v[7], 1, "a", "b"), (None, v[8], None, None, None), (101, [-0.0] * 6, 1, "", "")]
    odd = [(200, None, 1, "a", "b"), (201, [], 1, "a", "b"), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, "a", "b")]
    odd += [(203, [float("nan")] + [0.0] * 5, 1, "a", "b"), (204, [float("inf")] * 6, 1, "a", "b"), (205, [1.0, 2.0], 1, "a", "b")]
    table = spark.createDataFrame([*rows, *odd], SCHEMA).repartition(5)
    check(table, [(r[0], r[1]) for r in rows])


def test_large_entries_take_more_primes_and_stay_exact(spark):
    v = (vectors(40, 5, 3).astype(np.float64) * 3e6).astype(np.float32).tolist()
    check(spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, embedding array<float>"), list(enumerate(v)))


def test_residues_give_back_what_a_double_cannot_hold():
    moduli = whitening.primes(1 << 140)
    for x in (0, -1, (1 << 139) - 7, -(1 << 138) + 3):
        assert whitening.from_residues([x % p for p in moduli], moduli) == x
    assert all(p < whitening.LIMIT for p in moduli) and len(set(moduli)) == len(moduli)


def test_scatter_is_exact(spark):
    x = np.random.default_rng(5).integers(-(1 << 40), 1 << 40, (3000, 3))
    table = spark.createDataFrame([(r,) for r in x.tolist()], "x array<long>").repartition(4)
    model = whitening.fit(table, 3)
    y = x.astype(object)
    assert model.sums == y.sum(axis=0).tolist() and model.n == 3000
    v = np.array([[float(Fraction(int(3000 * (y[:, i] * y[:, j]).sum() - y[:, i].sum() * y[:, j].sum()), 3000**2)) for j in range(3)] for i in range(3)])
    assert np.allclose(np.sort(model.values), np.linalg.eigvalsh(v), rtol=1e-12)


def test_few_rows(spark):
    """One vector, vectors on a line, huge entries, an empty table."""
    one = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<float>")
    rows = whitening.whiten(one).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows} == {(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)}
    line = [(i, [float(i), 2.0 * i, -float(i)]) for i in range(9)]
    check(spark.createDataFrame(line, "vec_id long, embedding array<float>"), line)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")).collect()
    assert len(huge) == 6 and {r.deviation for r in huge if r.vec_id in (1, 2)} == {None}
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    check(table, [(r.vec_id, r.embedding) for r in table.collect()])
    assert op12_whitening(spark, sf).filter(F.col("identity_error") > 1e-9).count() == 0
