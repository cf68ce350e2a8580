"""Streams in event time: features equal the batch's, silent keys expire, silent members are found."""

import random

import pytest
from pyspark.sql import functions as F

from rivulet.operators import mesh, windows
from rivulet.streaming import timed
from tests.test_sliding import SCHEMA, flows


def streamed(spark, parts, folder, schema, make):
    """What make(stream) appends if each of parts is a micro-batch."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in" / f"part={i:03d}"))
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(folder / "in"))
    name = f"out_{folder.name}".replace("-", "_")
    query = make(files).writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / "check")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.table(name)


@pytest.mark.parametrize("cuts", [1, 5])
def test_features_equal_the_batch_however_it_is_cut(spark, tmp_path, cuts):
    draw = random.Random(cuts)
    rows = [(r[0], r[1] + 1_000_000_000, *r[2:]) for r in flows(250, spread=20_000_000) if r[5] is None or r[5] == r[5]]  # Spark's first watermark is the epoch
    moved = sorted(rows, key=lambda r: r[1] + draw.randrange(3_000_000))  # up to 3 s out of order
    size = -(-len(moved) // cuts)
    parts = [moved[a : a + size] for a in range(0, len(moved), size)] + [[(9999, 10**12, "end", "d", 1, 1.0, 2)], [(9998, 10**12 + 1, "end", "d", 1, 1.0, 2)]]
    live = streamed(spark, parts, tmp_path, SCHEMA, lambda s: timed.features(s, late="4 seconds", idle_us=10**13))
    names = [c for c in live.columns if c.startswith("f_")]
    plain = lambda df: {r.seq: tuple(None if r[c] is None else round(r[c], 12) for c in names) for r in df.collect()}
    assert plain(live.filter("src IS NULL OR src <> 'end'")) == plain(windows.features(spark.createDataFrame(rows, SCHEMA)))
    assert live.filter("expired").count() == 0


@pytest.mark.parametrize("whole", [False, True])
def test_silent_keys_expire(spark, tmp_path, whole):
    row = lambda seq, us, src: (seq, us, src, "d", 1, 100.0, 2)
    parts = [[row(1, 1_000_000, "a"), row(2, 1_500_000, "b")], [row(3, 9_000_000, "b")], [row(4, 30_000_000, "b")], [row(5, 31_000_000, "a"), row(6, 90_000_000, "b")], [row(7, 91_000_000, "b")]]
    parts = [sum(parts[:4], []), parts[4]] if whole else parts
    live = streamed(spark, parts, tmp_path, SCHEMA, lambda s: timed.features(s, late="1 second", idle_us=10_000_000)).collect()
    gone = sorted((r.src, r.us) for r in live if r.expired)
    assert gone == [("a", 11_000_000), ("a", 41_000_000), ("b", 19_000_000), ("b", 40_000_000)]
    assert {r.seq: r.f_iat for r in live if not r.expired}[5] == 0.0  # it starts anew
    assert all(r.f_len is None for r in live if r.expired)


def test_a_silent_member_is_suspected_then_dead(spark, tmp_path):
    beat = lambda t: t * 1_000_000
    steady = [(n, beat(n), "steady") for n in range(60)]
    silent = [(100 + n, beat(n), "silent") for n in range(20)]
    slow = [(200 + n, beat(t), "slow") for n, t in enumerate([*range(20), *range(22, 60)])]
    rows = sorted(steady + silent + slow, key=lambda r: r[1])
    parts = [rows[a : a + 40] for a in range(0, len(rows), 40)]
    live = streamed(spark, parts, tmp_path, "seq long, us long, node string", lambda s: timed.watched(s, suspect=8.0, dead=9.5)).collect()
    of = lambda node: [r.state for r in sorted((r for r in live if r.node == node), key=lambda r: r.us)]
    assert of("steady") == ["ALIVE"] and of("silent") == ["ALIVE", "SUSPECT", "DEAD"] and of("slow") == ["ALIVE", "SUSPECT", "DEAD"]
    suspected = next(r.us for r in live if r.node == "silent" and r.state == "SUSPECT")
    assert beat(19) + 1_000_000 < suspected < beat(21)


def test_overdue_is_where_phi_reaches_the_level(spark):
    from rivulet.functions import flow as fx

    for gaps in ([], [1000.0, 1010.0, 990.0], [500.0, 2000.0]):
        at = mesh.overdue_at(8.0, gaps)
        assert mesh.phi_of(at, gaps) >= 8.0 > mesh.phi_of(at - 0.1, gaps)
    assert mesh.overdue_at(12.0, []) is None
    row = spark.range(1).select(fx.phi(F.lit(1300.0), F.lit(1000.0), F.lit(50.0)).alias("p")).first()
    assert row.p == pytest.approx(mesh.phi_of(1300.0, [950.0, 1050.0]))
