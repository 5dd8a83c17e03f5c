"""Whitening against numpy's symmetric eigensolver and exact integers."""

from fractions import Fraction

import numpy as np
import pytest

from cvebeacon.llm.whitening import Whitening, largest_components, polar, whiten

SCHEMA = "vec_id long, embedding array<double>, label int, n int, w string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", "y") for i, v in rows], SCHEMA)


def spectra():
    draw = np.random.default_rng(3)
    cases = {
        "spread": np.geomspace(1, 1e-9, 24),
        "ties": np.array([5.0] * 6 + [2.0] * 6 + [1.0] * 4),
        "near": np.concatenate([1 + np.arange(8) * 1e-9, [0.5] * 8]),
        "low rank": np.array([4.0, 3.0, 2.0] + [0.0] * 9),
        "two": np.array([2.0, 1.0]),
    }
    for name, values in cases.items():
        q = np.linalg.qr(draw.normal(size=(len(values), len(values))))[0]
        yield name, (q * values) @ q.T
    yield "diagonal", np.diag([3.0, 1.0, 2.0])
    yield "one", np.array([[7.0]])
    yield "shift on an eigenvalue", np.array([[1.0, 0, 0], [0, 1, 1], [0, 1, 1]])


@pytest.mark.parametrize("name,a", list(spectra()), ids=lambda x: x if isinstance(x, str) else "")
def test_components(name, a):
    e, v = largest_components(a, 8)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:8]
    top = np.abs(want).max()
    assert len(e) == min(8, len(a))
    assert np.abs(e - want).max() < 1e-13 * len(a) * top
    assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-13 * len(a)
    assert np.abs(a @ v - v * e).max() < 1e-13 * len(a) * top


def test_polar_factor():
    draw = np.random.default_rng(5)
    q = np.linalg.qr(draw.normal(size=(9, 9)))[0]
    signs = np.array([1, 1, 1, -1, -1, 1, -1, -1, 1.0])
    a = (q * (signs * np.geomspace(1, 1e-7, 9))) @ q.T
    assert np.abs(polar(a) - (q * signs) @ q.T).max() < 1e-8


def test_against_brute_force(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(900, 12)) * np.linspace(0.5, 0.02, 12)
    x[:, 3] = x[:, 0] * 0.5 + x[:, 3] * 0.1
    got = whiten(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]).repartition(5)).toPandas()
    assert len(got) == 900 * 8
    ints = np.floor(x * 1024).astype(int) + 100_000
    n, sums = len(x), ints.sum(axis=0)
    y = ints - np.array([float(Fraction(int(s), n)) for s in sums])
    cov = y.T @ y / n
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    deviation = ((n * ints - sums) ** 2).sum(axis=1)
    assert got.groupby("vec_id").deviation.first().tolist() == deviation.tolist()
    assert (got.n == n).all() and (got.deviation_exact.astype(float) == got.deviation).all()
    assert got.identity_error.max() < 1e-10 and got.identity_error.nunique() == 1
    u, v = np.linalg.eigh(cov)
    for c in range(1, 9):
        part = got[got.component == c].sort_values("vec_id")
        assert abs(part.explained.iloc[0] / (values[c - 1] / np.trace(cov)) - 1) < 1e-10
        want = y @ v[:, -c] / np.sqrt(u[-c])
        sign = np.sign(want @ part.whitened.to_numpy())
        assert np.abs(sign * want - part.whitened).max() < 1e-9


def test_odd_vectors(spark):
    """Null, empty, unequal lengths, null and non-finite entries, huge entries, repeats, ties."""
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0]), (2, [0.0, -1.0]), (3, None), (4, []),
            (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1e30, 0.0]),
            (9, [1.0, 2.0, 3.0]), (10, [0.0, 0.0])]
    got = whiten(frame(spark, rows)).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == sorted(
        (i, c) for i in (1, 1, 0, 2, 10) for c in (1, 2)
    )
    assert {r["n"] for r in got} == {5}
    x = np.array([[1024, 0], [1024, 0], [0, 1024], [0, -1024], [0, 0]]) + 100_000
    dev = ((5 * x - x.sum(axis=0)) ** 2).sum(axis=1)
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(dev.tolist())
    assert abs(sum(r["explained"] for r in got if r["vec_id"] == 10) - 1) < 1e-12


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_nothing_to_whiten(spark, rows):
    got = whiten(frame(spark, rows))
    assert got.collect() == [] and "identity_error" in got.columns


def test_long_overflow(spark):
    """Deviations beyond a long are kept as decimals."""
    rows = [(i, [1e10 * (i % 3), float(i)]) for i in range(60)]
    got = whiten(frame(spark, rows), Whitening(components=1)).collect()
    x = [[int(1024 * v[0]) + 100_000, int(1024 * v[1]) + 100_000] for _, v in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    for r in got:
        want = sum((60 * a - b) ** 2 for a, b in zip(x[r["vec_id"]], s, strict=True))
        assert int(r["deviation_exact"]) == want
        assert r["deviation"] == (want if want < 2**63 else None)
