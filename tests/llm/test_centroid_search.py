import hashlib
import math
import random

import numpy as np
import pytest

from thriftline.llm import centroid_search as cs

SCHEMA = "vec_id long, embedding array<double>, cluster string, inertia int, `a.b` string"


def made_rows():
    rng = random.Random(3)
    heads = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(heads)]) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.25, -0.5, 0.0]) for i in range(150)]  # one place, very many times
    rows += [(7, [0.1, 0.2, 0.3, 0.4]), (7, [0.1, 0.2, 0.3, 0.4]), (8, [9.0, 9.0, 9.0, 9.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    out = [(2000, None), (2001, []), (2002, [1.0, 2.0, 3.0]), (2003, [1.0, None, 2.0, 3.0]), (2004, [math.nan, 0.0, 0.0, 0.0]),
           (2005, [math.inf, 0.0, 0.0, 0.0]), (2006, [1e300, 0.0, 0.0, 0.0]), (2007, [-float(1 << 19), 0.0, 0.0, 0.0])]
    return rows, out


def brute(rows, k, rounds, seed=2, scale=256):
    ints = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in ints if i is not None)
    centroids = [v for _, v in order[:k]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        held = {}
        for _, v in ints:
            held.setdefault(nearest(v), []).append(v)
        for c, own in held.items():
            centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    last = [(i, nearest(v), v) for i, v in ints]
    inertia = {}
    for _, c, v in last:
        inertia[c] = inertia.get(c, 0) + far(v, centroids[c])
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return sorted(((i, c, far(v, centroids[c]), inertia[c], sum(inertia.values()), digest(c)) for i, c, v in last), key=repr)


@pytest.mark.parametrize("k,rounds", [(12, 5), (1, 2), (700, 1)])
def test_equals_brute_force(spark, k, rounds):
    rows, out = made_rows()
    vectors = spark.createDataFrame([(*r, "own", 1, "x") for r in rows + out], SCHEMA).repartition(3)
    found = cs.cluster(vectors, k=k, rounds=rounds, dims=4)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, k, rounds)


def test_no_vectors(spark):
    assert cs.cluster(spark.createDataFrame([], SCHEMA)).collect() == []
    found = cs.cluster(spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>"))
    assert found.collect() == [] and len(found.columns) == 6


@pytest.mark.parametrize("size", [100, 100_000_000])
def test_search_equals_all_distances(size):
    """Near and large values, ties of distance and of sums, against a table of all distances."""
    rng = np.random.default_rng(1)
    points = rng.integers(-size, size, (60, 8))
    points[30:40] = points[20:30]
    points[40] = np.roll(points[41], 3)
    vectors = np.concatenate([rng.integers(-size, size, (500, 8)), points, (points[:20] + points[20:40]) // 2])
    table = ((vectors[:, None].astype(object) - points[None].astype(object)) ** 2).sum(2)
    label, best = cs.Centroids(points).nearest(vectors)
    assert best.tolist() == table.min(1).tolist()
    assert label.tolist() == [row.tolist().index(min(row)) for row in table]


def test_search_passes_over_most_centroids(monkeypatch):
    """With means that differ, few exact distances are computed."""
    rng = np.random.default_rng(2)
    points = rng.integers(-20, 20, (50, 16)) + np.arange(50)[:, None] * 40
    vectors = rng.integers(-20, 20, (1000, 16)) + rng.integers(0, 50, 1000)[:, None] * 40
    measured = []
    count = np.einsum
    monkeypatch.setattr(np, "einsum", lambda spec, a, b: measured.append(len(a)) or count(spec, a, b))
    cs.Centroids(points).nearest(vectors)
    assert sum(measured) < 3 * len(vectors)


def test_huge_inertia_is_null(spark):
    far = float((1 << 19) - 1)
    rows = [(i, [far if i % 2 else -far] * 64) for i in range(12)]
    found = cs.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=1, rounds=1).collect()
    assert {r["distance"] for r in found} == {64 * (256 * ((1 << 19) - 1)) ** 2} and {r["inertia"] for r in found} == {None}
