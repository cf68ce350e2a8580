"""Rates among the last rows, over stretches."""

from pyspark.sql import functions as F

from rivulet.operators import windows


def test_recent_rate_over_stretches(spark):
    hits = [None if i % 11 == 0 else bool(i * 7 % 5 < 2) for i in range(700)]
    rows = [(i * 3, "a" if i % 4 else None, hits[i]) for i in range(700)]
    df = spark.createDataFrame(rows, "seq long, k string, hit boolean").repartition(3)
    out = {r.seq: r.rate for r in windows.recent_rate(df, "k", "seq", F.col("hit"), 37, stretch=16).collect()}
    assert len(out) == 700
    past: dict = {}
    for seq, k, hit in rows:
        own = past.setdefault(k, [])
        own.append(hit)
        known = [h for h in own[-37:] if h is not None]
        assert out[seq] == (sum(known) / len(known) if known else None)
