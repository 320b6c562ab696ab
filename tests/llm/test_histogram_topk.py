import math

import numpy as np
import pytest

from thriftline.llm import histogram_topk as ht

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k, scale=1024):
    ok = [(i, [math.floor(scale * x) for x in np.float32(v).astype(float)]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    asked = {}
    for i, v in rows:
        if i is not None and i % 100 == 0 and v is not None and all(x is not None and math.isfinite(x) for x in v):
            asked.setdefault(i, []).append(v)
    for q, own in asked.items():
        first = [math.floor(scale * x) for x in np.float32(min(own)).astype(float)]
        scores = sorted(((-sum(a * b for a, b in zip(first, v)), i) for i, v in ok if i != q))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def run(spark, rows, **options):
    vectors = spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA).repartition(5)
    found = ht.histogram_topk(vectors, vectors.filter("vec_id % 100 = 0"), **options)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, found.collect()))


def random_rows(n=600, hot=150, d=5):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=d).round(2).tolist()) for i in range(n)]
    for i in range(50, 50 + hot):  # a third of all rows are equal
        rows[i] = (i, [0.5] * d)
    return rows


def test_equals_brute_force(spark):
    rows = random_rows()
    rows += [(1000, [1.0, float("nan"), 0.0]), (1001, [float("inf")] * 5), (1002, None), (1003, [1.0, None, 2.0]), (None, [9.0] * 5),
             (1100, []), (1004, [3.0] * 8), (1200, [1.0, -1.0]), (7, [0.1] * 5), (100, [5.0] * 5), (-300, [0.25] * 5)]
    for k, block in ((10, 2048), (1, 3), (200, 2)):
        assert run(spark, rows, k=k, query_block=block) == brute(rows, k)


def test_few_candidates_ties_and_none(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0]), (2, [2.0])]) == [(0, 1, 1, 2048 * 1024), (0, 2, 2, 2048 * 1024)]
    assert run(spark, [(0, [1.0])]) == [] and run(spark, [(1, [1.0])]) == [] and run(spark, []) == []
    assert run(spark, [(i, [0.0, 0.0]) for i in range(30)], k=3) == [(0, 1, 1, 0), (0, 2, 2, 0), (0, 3, 3, 0)]


def test_short_and_long_queries_in_one_block(spark):
    """A query of small components is settled in fewer rounds than its neighbour and stays so."""
    rng = np.random.default_rng(1)
    rows = [(0, [0.001] * 4), (100, [900.0] * 4), *[(i, (rng.integers(-6, 6, 4) / 1024).tolist()) for i in range(1, 90)]]
    for k in (1, 3, 10):
        assert run(spark, rows, k=k) == brute(rows, k)


def test_large_numbers_stay_exact(spark):
    rows = [(0, [1e6, 1.0]), (1, [1e6, 1.0]), (2, [1e6, 1.0 + 2 ** -10]), (3, [-1e6, 1.0])]
    assert run(spark, rows, k=2) == brute(rows, 2)
    with pytest.raises(ValueError):
        run(spark, [(0, [1e15]), (1, [1e15])])
