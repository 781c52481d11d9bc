"""Nearest neighbours and whitening against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardlens.llm import cross_polytope, queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, id string, hi int, component int, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2, 3) for i, v in rows], SCHEMA)


def vectors(rng, count, width=12):
    return rng.standard_normal((count, width)).astype(np.float32)


@pytest.fixture(scope="module")
def odd():
    """Copies, near copies, scaled copies, repeated rows and everything that takes no part."""
    rng = np.random.default_rng(3)
    x = vectors(rng, 160)
    x[60:100] = x[7]
    x[100:130] = x[9] + rng.standard_normal((30, 12)).astype(np.float32) * 0.01
    x[130:140] = x[10] * 2
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(5, [float(c) for c in x[5]])]
    return rows + [(200, None), (250, []), (300, [0.0] * 12), (350, [float("nan")] * 12), (400, [None] + [1.0] * 11),
                   (450, [float("inf")] + [1.0] * 11), (500, [1.0, 2.0]), (None, [1.0] * 12)]


def usable(rows):
    kept = {}
    for i, v in rows:
        if v and len(v) == 12 and all(c is not None and np.isfinite(c) for c in v):
            kept[i, tuple(v)] = None
    return [(i, np.array(v)) for i, v in kept]


def brute(rows, modulus, k=5):
    rows = [(i, v) for i, v in rows if i is not None and v.any()]
    out = {}
    for i, v in rows:
        if i % modulus == 0:
            scored = sorted((-round(float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), 12), j) for j, w in rows if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def listed(result):
    out = {}
    for r in sorted(result.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_nearest_with_all_cells_is_exact(spark, odd, monkeypatch):
    monkeypatch.setattr(cross_polytope, "PART_ROWS", 16)
    monkeypatch.setattr(cross_polytope, "WORK_VALUES", 12 * 50)
    got = listed(cross_polytope.nearest(frame(spark, odd), F.col("vec_id") % 10 == 0,
                                        hashing=cross_polytope.Hashing(12, 1, 32)))
    want = brute(usable(odd), 10)
    assert {q: [j for j, _ in found] for q, found in got.items()} == {q: [j for j, _ in found] for q, found in want.items()}
    for q, found in got.items():
        assert np.allclose([s for _, s in found], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_nearest_with_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]
    got = listed(cross_polytope.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0))
    assert [j for j, _ in got[0]] == [2, 1] and list(got) == [0]
    assert cross_polytope.nearest(frame(spark, []), F.col("vec_id") % 50 == 0).collect() == []
    assert cross_polytope.nearest(frame(spark, rows[:1]), F.col("vec_id") % 50 == 0).collect() == []


def test_two_hashes_find_what_they_probe(spark):
    rng = np.random.default_rng(1)
    x = vectors(rng, 300, 8)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    shape = cross_polytope.Hashing(8, 2, 90)
    got = listed(cross_polytope.nearest(frame(spark, rows), F.col("vec_id") % 5 == 0, hashing=shape))
    units = cross_polytope.unit_rows(x.astype(float))
    home, probed = shape.home(units), shape.probed(units)
    near = units @ units.T
    for q in range(0, 300, 5):
        met = [j for j in range(300) if j != q and set(home[j]) & set(probed[q])]
        assert [j for j, _ in got[q]] == sorted(met, key=lambda j: -near[q, j])[:5]


def test_hash_is_the_nearest_signed_axis():
    shape = cross_polytope.Hashing(50)
    units = cross_polytope.unit_rows(np.random.default_rng(0).standard_normal((50, 50)))
    axes = shape.axes(units, 0)
    assert np.allclose((axes[:, :64] ** 2).sum(axis=1), 1)  # a rotation
    best = np.abs(axes[:, :64]).argmax(axis=1)
    negative = axes[np.arange(50), best] < 0
    assert (shape.home(units)[:, 0] == best + 64 * negative).all()


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.1"])
def test_recall_on_given_table(spark, scale):
    folder = f"/root/testdata/{scale}"
    got = listed(queries.op11_cross_polytope(spark, folder))
    table = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    want = brute([(r["vec_id"], np.array(r["embedding"], float)) for r in table], 50)
    assert set(got) == set(want) and all(len(got[q]) == 5 for q in want)
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def eigen(x):
    centred = x - x.mean(axis=0)
    values, parts = np.linalg.eigh(centred.T @ centred / len(x))
    return values[::-1], parts[:, ::-1]


def check_whitening(rows, result, components=16):
    used = usable(rows) if rows and isinstance(rows[0][1], list) else rows
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in used])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, parts = eigen(fit.astype(float))
    keep = [k for k in range(min(components, x.shape[1])) if values[k] > 1e-9 * values.sum()]
    got = {}
    for r in result.collect():
        got.setdefault(r["component"], {})[r["vec_id"]] = r
    assert sorted(got) == [k + 1 for k in keep]
    for k in keep:
        want = (x - sums / n) @ parts[:, k] / np.sqrt(values[k])
        found = np.array([got[k + 1][i]["whitened"] for i, _ in used])
        sign = np.sign(found @ want)
        assert np.allclose(found, sign * want, atol=1e-6)
        for (i, _), xi in zip(used, x.tolist(), strict=True):
            r = got[k + 1][i]
            assert r["n"] == n and r["identity_error"] < 1e-9
            assert r["deviation"] == sum((n * a - int(s)) ** 2 for a, s in zip(xi, sums, strict=True))
            assert abs(r["explained"] / (values[k] / values.sum()) - 1) < 1e-9


def test_whitening_of_odd_rows(spark, odd):
    rows = [r for r in odd if r[0] is not None]
    check_whitening(rows, whitening.whitened(frame(spark, rows)))
    with_null = whitening.whitened(frame(spark, odd)).where("vec_id is null")
    assert with_null.count() == 12


def test_whitening_without_spread(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whitened(frame(spark, rows)).collect() == []
    rows = [(1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 6.0]), (3, [4.0, 8.0, 12.0])]  # rank one
    assert {r["component"] for r in whitening.whitened(frame(spark, rows)).collect()} == {1}


def test_large_entries_stay_exact(spark):
    rows = [(1, [2.0 ** 40, 1.0]), (2, [-(2.0 ** 40), 3.0]), (3, [0.0, 2.0 ** 39])]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitened(frame(spark, rows)).collect()}
    assert got == {1: None, 2: None, 3: None}  # beyond a long
    with pytest.raises(Exception, match="too large|overflow"):
        whitening.whitened(frame(spark, [(1, [2.0 ** 60]), (2, [0.0])])).collect()


def test_whitening_of_given_table(spark, small):
    table = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    check_whitening([(i, np.array(v)) for i, v in table], queries.op13_whitening(spark, small))


def test_inertia_counts_and_solves():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 9))
        m = rng.integers(-3, 4, (n, n))
        m = m + m.T + 0.1 * np.eye(n)
        factors = whitening.factorized(m)
        assert factors.positive == (np.linalg.eigvalsh(m) > 0).sum()
        b = rng.standard_normal(n)
        assert np.allclose(m @ factors.solve(b), b)


@pytest.mark.parametrize("spectrum", [[5, 3, 1], [2, 2, 2, 1], [1, 1 - 1e-13, 0.5, 0, 0], [1] * 20, [4, 1e-6, 1e-12]])
def test_leading_eigenpairs(spectrum):
    turn, _ = np.linalg.qr(np.random.default_rng(2).standard_normal((len(spectrum),) * 2))
    m = turn @ np.diag(np.array(spectrum, float)) @ turn.T
    values, parts = whitening.leading_eigenpairs((m + m.T) / 2, 16)
    want = [v for v in sorted(spectrum, reverse=True) if v > 1e-10 * sum(spectrum)][:16]
    assert np.allclose(values, want, rtol=1e-8, atol=1e-13)
    assert np.allclose(m @ parts, parts * values, atol=1e-13 * max(spectrum))
    assert np.allclose(parts.T @ parts, np.eye(len(want)), atol=1e-12)
