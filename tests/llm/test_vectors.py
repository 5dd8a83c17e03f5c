"""Vector operators against brute force."""

import numpy as np
import pytest

from cvebeacon.llm import learned_search, neardup_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node long, v string, n_links int"


def frame(spark, x, labels):
    return spark.createDataFrame(
        [(i, [float(c) for c in v], int(k), 1, "x", 2) for i, (v, k) in enumerate(zip(x, labels, strict=True))],
        SCHEMA,
    )


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(700, 24)).astype(np.float32)
    for i in range(300, 600):
        x[i] = x[i % 40] + draw.normal(size=24) * 0.09
    x[600:] = x[5]
    return x, np.where(np.arange(700) < 600, np.arange(700) % 2, 1)


def test_links_against_brute_force(spark, vectors):
    x, labels = vectors
    rows = neardup_vectors.near_vectors(frame(spark, x, labels)).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = (u @ u.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(link, False)
    low = np.arange(len(x))
    while True:
        after = np.minimum(low, np.where(link, low[None, :], len(x)).min(axis=1))
        if (after == low).all():
            break
        low = after
    assert link.sum() > 5000
    for r in rows:
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"], r["kept"]) == (link[i].sum(), low[i], low[i] == i)


def exact_links(x, labels):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = (u @ u.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(link, False)
    low, before = np.arange(len(x)), None
    while before is None or (low != before).any():
        before = low
        low = np.minimum(low, np.where(link, low[None, :], len(x)).min(axis=1))
    return link.sum(axis=1), low


def test_rim_of_a_dense_group(spark):
    """Vectors that only a few of a dense group link to."""
    draw = np.random.default_rng(7)
    centre = draw.normal(size=32)
    centre /= np.linalg.norm(centre)
    x = centre + draw.normal(size=(2600, 32)) * 0.012
    x /= np.linalg.norm(x, axis=1)[:, None]
    rim = []
    for i in range(160):
        out = x[i] - (x[i] @ centre) * centre
        rim.append(x[i] + out / np.linalg.norm(out) * 0.2)
    x = np.vstack([x, rim]).astype(np.float32)
    labels = np.ones(len(x), int)
    links, low = exact_links(x, labels)
    assert (links[2600:] > 0).sum() > 100 and np.median(links[2600:]) < 100
    for r in neardup_vectors.near_vectors(frame(spark, x, labels)).collect():
        assert (r["n_links"], r["component_id"]) == (links[r["vec_id"]], low[r["vec_id"]])


def test_links_without_descent(spark, vectors):
    """The finish alone finds all components, over many cells and blocks."""
    x, labels = vectors
    links, low = exact_links(x, labels)
    how = neardup_vectors.NearVectors(beside=0, descents=0, block=40)
    for r in neardup_vectors.near_vectors(frame(spark, x, labels), how).collect():
        assert (r["n_links"], r["component_id"]) == (links[r["vec_id"]], low[r["vec_id"]])


def test_search_recall(spark, vectors):
    x, labels = vectors
    draw = np.random.default_rng(4)
    x = np.vstack([x, draw.normal(size=(3300, 24)).astype(np.float32)])
    labels = np.zeros(len(x))
    rows = learned_search.search(frame(spark, x, labels)).collect()
    exact = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(exact, -np.inf)
    hits = 0
    for r in rows:
        assert r["score"] == pytest.approx(exact[r["query_id"], r["vec_id"]], abs=1e-9)
        hits += r["score"] >= np.sort(exact[r["query_id"]])[-20] - 1e-9
    asked = {r["query_id"] for r in rows}
    assert asked == set(range(0, len(x), 20)) and hits >= 0.9 * 20 * len(asked)
    for q in list(asked)[:20]:
        own = sorted((r["rank"], -r["score"], r["vec_id"]) for r in rows if r["query_id"] == q)
        assert [o[0] for o in own] == list(range(1, 21)) and own == sorted(own, key=lambda o: o[1:])


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (2, None, 1), (3, [], 1), (4, [0.0, 0.0], 1),
        (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [1.0, None], 1), (8, [1.0, 0.0], None), (None, [1.0, 0.0], 1),
        (9, [2.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.0], 2),
    ]
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    found = neardup_vectors.near_vectors(table).collect()
    assert len(found) == len(rows)
    by_id = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found}
    assert by_id[0] == by_id[20] == by_id[9] == (2, 0)
    assert all(by_id[i] == (0, i) for i in (2, 3, 4, 5, 6, 7, 8, 10, 11)) and by_id[None] == (0, None)
    near = learned_search.search(table).collect()
    best = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in near]
    assert sorted(best) == [
        (0, 1, 9, 2.0), (0, 2, 8, 1.0), (0, 3, 11, 1.0), (0, 4, 20, 1.0),
        (20, 1, 9, 2.0), (20, 2, 0, 1.0), (20, 3, 8, 1.0), (20, 4, 11, 1.0),
    ]
    none = table.limit(0)
    assert neardup_vectors.near_vectors(none).count() == 0 and learned_search.search(none).count() == 0
