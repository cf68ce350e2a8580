"""Merged heavy hitters within their bounds, and robust vectors across tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.operators import mesh, sketches


@pytest.mark.parametrize(("parts", "capacity"), [(1, 8), (7, 8), (16, 40)])
def test_every_heavy_key_is_found_within_bounds(spark, parts, capacity):
    draw = random.Random(parts)
    keys = [1] * 2000 + [2] * 900 + [3] * 700 + [draw.randrange(10, 3000) for _ in range(5000)] + [None] * 50
    draw.shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(parts)
    true = {}
    for k in keys:
        true[k] = true.get(k, 0) + 1
    total = len(keys) - 50
    out = sketches.heavy_hitters(sketches.sketched(df, F.col("k"), F.col("k"), capacity), 100).collect()
    assert {str(k) for k, n in true.items() if k is not None and n * (capacity + 1) > total} <= {r.key for r in out} and len(out) <= capacity
    for r in out:
        n = true[int(r.key)]
        assert r.least <= n <= r.most <= r.estimate and (n - r.least) * (capacity + 1) <= total == r.total


def test_no_rows(spark):
    assert sketches.heavy_hitters(sketches.sketched(spark.range(0), F.col("id"), F.col("id"))).count() == 0


@pytest.mark.parametrize("block", [3, 512])
def test_krum_equals_a_plain_search(spark, block):
    draw = np.random.default_rng(block)
    rows = [(g, 100 * g + i, draw.normal(0, 1 + (i == 0) * 9, 3).tolist()) for g, n in enumerate([1, 2, 3, 4, 9, 30]) for i in range(n)]
    df = spark.createDataFrame([*rows, (5, 999, None), (5, None, [0.0] * 3)], "g int, i long, v array<double>").repartition(3)
    out = {r.g: (r.id, r.score) for r in mesh.krum(df, "g", "i", "v", block=block).collect()}
    for g in range(6):
        own = [(i, np.array(v)) for a, i, v in rows if a == g]
        m = len(own) - 3
        if m <= 0:
            assert g not in out
            continue
        scores = [(sum(sorted(((x - y) ** 2).sum() for j, y in own if j != i)[:m]), i) for i, x in own]
        assert out[g][0] == min(scores)[1] and out[g][1] == pytest.approx(min(scores)[0])


def test_small_groups_fall_back_to_the_trimmed_mean(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 2.0]), (1, 2, [3.0, 6.0]), (2, 3, [5.0, 5.0]), (3, 4, [0.0, 0.0]), (3, 5, [0.0, 1.0]), (3, 6, [1.0, 0.0]), (3, 7, [90.0, 90.0])], "g int, i long, v array<double>")
    out = {r.g: (r.id, r.vector) for r in mesh.robust(df, "g", "i", "v").collect()}
    assert out[1] == (None, [2.0, 4.0]) and out[2] == (None, [5.0, 5.0]) and out[3] == (4, [0.0, 0.0])
    assert mesh.federated(df, "g", "i", "v").count() == 3
