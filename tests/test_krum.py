"""The group's nearest vector without all pairs."""

import numpy as np
from pyspark.sql import functions as F

from rivulet.operators import mesh


def test_few_rows_can_be_the_nearest(spark):
    draw = np.random.default_rng(2)
    vectors = [(int(i % 3), i, draw.normal(i % 3, 1, 6).tolist()) for i in range(1500)]
    df = spark.createDataFrame(vectors, "g long, id long, v array<double>")
    rows = df.select(F.col("g").alias("key"), "id", "v")
    sizes = rows.groupBy(F.col("key").alias("__group")).agg(F.count("*").alias("n"))
    assert mesh.possible(rows, sizes, 2).count() < 300
    out = {r.g: (r.id, r.score) for r in mesh.krum(df, "g", "id", "v", block=64).collect()}
    for g in range(3):
        own = [(i, np.array(v)) for k, i, v in vectors if k == g]
        x = np.array([v for _, v in own])
        d = np.sort(((x[:, None] - x[None]) ** 2).sum(-1), axis=1)[:, :-2].sum(1)
        assert out[g][0] == own[int(d.argmin())][0] and abs(out[g][1] - d.min()) < 1e-6


def test_copies_are_no_further_candidates(spark):
    draw = np.random.default_rng(5)
    vectors = draw.normal(0, 1, (40, 6)).tolist()
    df = spark.createDataFrame([(1, 1000 - i, vectors[i % 40]) for i in range(800)], "key long, id long, v array<double>").repartition(5)
    sizes = df.groupBy(F.col("key").alias("__group")).agg(F.count("*").alias("n"))
    found = mesh.candidates(df, sizes, 2).collect()
    assert len(found) == len({tuple(r.v) for r in found}) == mesh.possible(df, sizes, 2).select("v").distinct().count() <= 40
    x = np.array([vectors[i % 40] for i in range(800)])
    d = np.sort(((x[:, None] - x[None]) ** 2).sum(-1), axis=1)[:, :-2].sum(1)
    out = mesh.krum(df, "key", "id", "v", block=64).first()
    assert out.id == min(1000 - i for i in range(800) if abs(d[i] - d.min()) < 1e-9) and abs(out.score - d.min()) < 1e-6
