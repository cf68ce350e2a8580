"""Exact neighbours against a plain search, how much is skipped, and the cleaning of classes."""

import numpy as np
import pytest

from rivulet.operators import neighbours, tables


def plain(rows, k):
    out = set()
    for i, v in rows:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in rows if j != i)[:k]
        out |= {(i, n, j) for n, (_, j) in enumerate(near, 1)}
    return out


def clustered(n, width=4, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 20, (12, width))
    return [(i, np.round(centres[i % 12] + draw.normal(0, 1, width), 3).tolist()) for i in range(n)]


@pytest.mark.parametrize(("block", "k"), [(16, 3), (60, 5), (4096, 1)])
def test_equal_to_a_plain_search(spark, block, k):
    rows = clustered(400) + [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(90)] + [(2000, [500.0] * 4)]
    odd = [(3000, None), (3001, [1.0, None, 1.0, 1.0]), (3002, [float("nan")] * 4), (None, [0.0] * 4)]
    df = spark.createDataFrame(rows + odd, "k long, v array<double>").repartition(3)
    out = neighbours.nearest_rows(df, "k", "v", k, block).collect()
    assert {(r.id, r["rank"], r.neighbour) for r in out} == plain(rows, k) and len(out) == k * len(rows)


def test_blocks_are_skipped(spark):
    search = neighbours.Search(spark.createDataFrame(clustered(3000), "k long, v array<double>"), "k", "v", 5, 50)
    assert search.found().count() == 15_000
    assert search.compared() < 0.35


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e25])
def test_rows_without_structure_are_sent_to_few_groups(spark, offset):
    draw = np.random.default_rng(3)
    rows = [(i, (np.round(draw.normal(0, 1, 8), 2) * max(1.0, offset / 1e9) + offset).tolist()) for i in range(900)]
    search = neighbours.Search(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v", 3, 4)
    got = {(r.id, r["rank"], r.neighbour) for r in search.found().collect()}
    x = np.array([v for _, v in rows])
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    assert got == {(i, n, int(j)) for i in range(900) for n, j in enumerate(np.lexsort((np.arange(900), d[i]))[:3], 1)}
    assert len(search.names) > 100  # each row asked most of them by itself
    assert search.asked.selectExpr("sum(length(qids) / 8) as n").first().n <= neighbours.GROUPS * 900


def test_few_and_no_rows(spark):
    assert neighbours.nearest_rows(spark.createDataFrame([], "k long, v array<double>"), "k", "v", 3).count() == 0
    one = spark.createDataFrame([(1, [1.0])], "k long, v array<double>")
    assert neighbours.nearest_rows(one, "k", "v", 3).count() == 0
    two = spark.createDataFrame([(1, [1.0]), (2, [3.0])], "k long, v array<double>")
    assert sorted((r.id, r.neighbour, r.distance) for r in neighbours.nearest_rows(two, "k", "v", 3).collect()) == [(1, 2, 4.0), (2, 1, 4.0)]


def test_only_rows_of_the_larger_class_go(spark):
    # 1 (larger class) and 4 (smaller) are each other's nearest
    rows = [(1, [0.0, 0.0], 0), (2, [10.0, 0.0], 0), (3, [10.0, 1.0], 0), (4, [0.1, 0.0], 1), (5, [-5.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "k long, v array<double>, y int")
    assert sorted(r.k for r in tables.smote_tomek(df, "k", "v", "y", 0).collect()) == [2, 3, 4, 5]
