"""Calibrated p-values of several scores at once, and boxes of points by ranks."""

import numpy as np
from pyspark.sql import functions as F

from rivulet.operators import detectors, windows


def test_p_values_of_several_scores(spark):
    draw = np.random.default_rng(3)
    rows = [(i, None if i % 7 == 0 else int(draw.integers(2)), float(draw.choice([0.0, 0.5, 1.0, draw.random()])), None if i % 5 == 0 else float(np.round(draw.random(), 2))) for i in range(400)]
    rows += [(400 + i, None, 1.0, 1.0) for i in range(3)]  # highest, and not labelled
    df = spark.createDataFrame(rows, "seq long, label int, a double, b double").repartition(3)
    out = {r.seq: r for r in windows.conformal_each(df, F.col("label") == 0, ["a", "b"], buckets=10).collect()}
    assert len(out) == len(rows)
    for at, name in ((2, "p_a"), (3, "p_b")):
        benign = [r[at] for r in rows if r[1] == 0 and r[at] is not None]
        for r in rows:
            expected = None if r[at] is None else (1 + sum(v >= r[at] for v in benign)) / (len(benign) + 1)
            assert out[r[0]][name] == expected


def test_rows_are_joined_once_whatever_the_number_of_scores(spark):
    df = spark.range(50).select("id", (F.col("id") % 2).alias("label"), *((F.col("id") / 50).alias(f"s{i}") for i in range(5)))
    joins = [windows.conformal_each(df, F.col("label") == 0, [f"s{i}" for i in range(n)])._jdf.queryExecution().optimizedPlan().toString().count("Join ") for n in (2, 5)]
    assert joins[0] == joins[1]


def test_boxes_of_cases_of_all_sizes():
    draw = np.random.default_rng(4)
    x = draw.integers(0, 9, (300, 3)) / 7.0
    values, first, ranks = detectors.ranked(x)
    held = draw.integers(1, 57, 200)
    begin = np.cumsum(held) - held
    points = draw.integers(0, len(x), held.sum())
    low, high = detectors.boxes(ranks, points, begin, held)
    assert ranks.dtype == np.int16
    for i, (a, n) in enumerate(zip(begin, held, strict=True)):
        own = x[points[a : a + n]]
        assert (values[low[i, :3] + first] == own.min(0)).all() and (values[high[i, :3] + first] == own.max(0)).all()


def test_costly_stages_are_not_coalesced(spark):
    df = spark.range(40).select(F.col("id").alias("seq"), F.col("id").alias("us"), (F.col("id") % 9).cast("string").alias("src"), F.rand(1).alias("a"))
    assert detectors.random_cuts(df, "src", ["a"]).rdd.getNumPartitions() == 4
