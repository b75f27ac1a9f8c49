import math
import random

import numpy as np
import pytest

from stranda.llm import knn as K

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string"


def brute(rows, every, k):
    """From the contract, with exact integers."""
    table = []
    for i, e in rows:
        if i is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        table.append((i, [math.floor(256 * float(np.float32(x))) for x in e]))
    out = {}
    for i, q in table:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in table if j != i and len(x) == len(q))[:k]
            out[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return {i: v for i, v in out.items() if v}


def result(spark, rows, k=5):
    df = spark.createDataFrame([(i, e, 1, "clash") for i, e in rows], SCHEMA)
    v = K.vectors(df)
    got = {}
    for r in K.top_k(v, v.filter(f"vec_id % {K.EVERY} = 0"), k).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {i: sorted(x) for i, x in got.items()}


def test_clusters_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(K, "PER_PIVOT", 40)
    monkeypatch.setattr(K, "CELL", 60)
    rng = random.Random(13)
    centers = [[rng.uniform(-2, 2) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in centers[i % 5]]) for i in range(500)]
    rows += [(1000 + i, [1.0] * 6) for i in range(300)]  # one very common vector
    rows += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 6), (2150, [float("inf")] * 6), (None, [1.0] * 6), (2200, [1.0, 2.0]), (2250, []), (2251, [3.0, 4.0]), (-50, [0.5] * 6)]
    assert result(spark, rows) == brute(rows, 50, 5)


def test_large_components_stay_exact():
    x = np.array([[2**40, -3], [7, 2**41]], dtype=np.int64)
    q = np.array([[2**20 + 1, 5]], dtype=np.int64)
    assert K.scores(x, q)[:, 0].tolist() == [2**40 * (2**20 + 1) - 15, 7 * (2**20 + 1) + 5 * 2**41]


def test_bounds_never_exclude_a_neighbour():
    rng = np.random.default_rng(3)
    middle = rng.integers(-3000, 3000, (10, 5))
    x, q = (middle[rng.integers(0, 10, n)] + rng.integers(-40, 40, (n, 5)) for n in (400, 60))
    cells = K.Cells.of(middle)
    at, of = (K.distances(v, middle).argmin(axis=1) for v in (x, q))
    scores = q @ x.T
    third = np.sort(scores, axis=1)[:, -3].astype(float)
    for c in range(10):
        cells.sizes[c], cells.radius[c] = (at == c).sum(), K.distances(x[at == c], middle[[c]]).max(initial=0)
        cells.asked[c], cells.reach[c] = (of == c).sum(), K.distances(q[of == c], middle[[c]]).max(initial=0)
        cells.floor[c] = third[of == c].min(initial=np.inf) - 500
    pairs = cells.needed_groups()
    rows = cells.needed_rows(x, np.arange(10))
    assert pairs.mean() < 0.7 and rows.mean() < 0.7
    for i in range(len(q)):
        for j in np.argsort(-scores[i])[:3]:
            assert pairs[of[i], at[j]] and rows[j, of[i]]
    cells.gather(15)
    assert sorted(c for g in cells.groups for c in g) == np.flatnonzero(cells.asked).tolist()
    assert all(cells.asked[g].sum() <= 15 * s for g, s in zip(cells.groups, cells.splits, strict=True))


def test_clustered_data_is_not_compared_in_full(spark, monkeypatch):
    for name, value in (("PER_PIVOT", 50), ("CELL", 70)):
        monkeypatch.setattr(K, name, value)
    rng = np.random.default_rng(4)
    middle = rng.normal(0, 1, (12, 8))
    middle *= 20 / np.linalg.norm(middle, axis=1)[:, None]
    data = middle[rng.integers(0, 12, 900)] + rng.normal(0, 0.05, (900, 8))
    rows = [(i, e.tolist()) for i, e in enumerate(data)]
    v = K.vectors(spark.createDataFrame([(i, e, 1, "") for i, e in rows], SCHEMA))
    join = K.Join(v, v.filter(f"vec_id % {K.EVERY} = 0"), 5, block=4)
    got = {}
    for r in join.best().collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {i: sorted(x) for i, x in got.items()} == brute(rows, 50, 5)
    assert join.visited() < 0.6


def test_few_and_no_rows(spark):
    assert result(spark, [(0, [1.0]), (1, [2.0]), (50, [3.0])]) == brute([(0, [1.0]), (1, [2.0]), (50, [3.0])], 50, 5)
    assert result(spark, []) == {}
    assert result(spark, [(0, [1.0])]) == {}


def test_repeated_query_rows_are_one_query(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.5, 0.0])]
    assert result(spark, rows, k=2) == {0: [(1, 1, 65536), (2, 1, 65536)]}


@pytest.mark.parametrize("k", [1, 7])
def test_other_k(spark, k):
    rng = random.Random(k)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(120)]
    assert result(spark, rows, k) == brute(rows, 50, k)
