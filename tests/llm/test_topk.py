from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import topk as kx


def brute(rows, k=10):
    whole = [(i, kx.whole_numbers(v, 1024.0)) for i, v in rows]
    whole = [(i, v) for i, v in whole if v is not None]
    out, seen = [], set()
    for i, q in whole:
        if i is None or i % 100 or (i, tuple(q)) in seen:
            continue
        seen.add((i, tuple(q)))
        scores = []
        for j, v in whole:
            if j != i:
                s = sum(a * b for a, b in zip(q, v))
                scores.append((-max(-(2**63), min(2**63 - 1, s)), j is None, j or 0, j))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def got(spark, rows, how=kx.TopK()):
    df = spark.createDataFrame([(i, v, 1.0, "x") for i, v in rows], "vec_id long, embedding array<float>, norm double, id string")
    out = kx.top_products(df, F.col("id") % 100 == 0, how).collect()
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("how", [kx.TopK(), kx.TopK(unit_rows=40, buckets=5, block_queries=2, coordinate_from=0.05, coordinates=6)])
def test_equals_brute_force(spark, how):
    draw = np.random.default_rng(2)
    centres = draw.normal(0, 1, (6, 12))
    lengths = np.exp(draw.normal(0, 1, 400))
    vectors = (centres[draw.integers(0, 6, 400)] + draw.normal(0, 0.3, (400, 12))) * lengths[:, None]
    vectors[50:60] = vectors[7]  # ties
    rows = [(int(i), v.astype("f4").tolist()) for i, v in enumerate(vectors)]
    rows += [(100, None), (200, [1.0, None]), (300, [float("nan")]), (301, [float("inf")]), (5000, [0.0] * 12), (None, [1.0] * 12), (7, rows[7][1]), (100, rows[100][1])]
    assert got(spark, rows, how) == brute(rows)


def test_odd_vectors(spark):
    rows = [(0, []), (1, [1.0]), (2, [1.0, -2.0, 3.0]), (100, [2.0, 2.0]), (3, [1e30, -1e30]), (4, [3e8]), (200, [1e20, 1.0])]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == [] and got(spark, [(0, [1.0])]) == []


def test_pruning_never_loses_a_result():
    draw = np.random.default_rng(4)
    for trial in range(20):
        n, d = 200, int(draw.integers(2, 20))
        vectors = draw.integers(-300, 300, (n, d)) * draw.integers(1, 5, (n, 1))
        unit = kx.Unit(list(range(n)), [v.tolist() for v in vectors], d)
        query = draw.integers(-300, 300, d)
        scores = vectors @ query
        bound = float(np.sort(scores)[-int(draw.integers(1, 30))])
        rows = unit.candidates(query.astype(float), math.sqrt(float(query @ query)), bound, kx.TopK(coordinate_from=0.0, coordinates=d))
        kept = {unit.ids[i] for i in rows}
        assert {i for i in range(n) if scores[i] >= bound} <= kept
    assert len(rows) < n
