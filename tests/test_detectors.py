"""Detectors against plain versions, row by row, and the process that runs them together."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rivulet.operators import alerts, detectors, engine, folds
from rivulet.plans.catalogue import QUERIES
from rivulet.plans.models import _points
from rivulet.plans.tables import DAY, flows

TABLES = "/root/testdata/sf0.001"
COLUMNS = ["score", "b", "c"]


@pytest.fixture(scope="module")
def points(spark):
    return _points(spark, TABLES).cache()


@pytest.fixture(scope="module")
def rows(points):
    return sorted(points.collect(), key=lambda r: (r.us, r.seq))


def test_hyperdimensional_by_single_bits(spark, points, rows):
    x = np.array([[r[c] for c in COLUMNS] for r in rows])
    y = np.array([r.label for r in rows])
    codes = detectors.standardised(points, COLUMNS, detectors.Codes(3, 128))
    assert np.allclose(codes.mean, x.mean(0)) and np.allclose(codes.scale, np.sqrt(x.var(0) + 1e-6))
    made = detectors.bundled(points, COLUMNS, "label", codes)
    signs = np.where(codes.bits(x), 1, -1)
    plain = {c: signs[y == c].sum(0) >= 0 for c in (0, 1)}
    assert all((made[c] == plain[c]).all() for c in (0, 1))
    out = {r.seq: r.hdc for r in detectors.hyperdimensional(points, COLUMNS, made, codes).collect()}
    for r, s in list(zip(rows, signs, strict=True))[::40]:
        near = [(s * np.where(plain[c], 1, -1)).mean() for c in (0, 1)]
        assert abs(out[r.seq] - 1 / (1 + np.exp(-4 * (near[1] - near[0])))) < 1e-9
    assert detectors.bundled(points.limit(0), COLUMNS, "label", codes) == {}


def test_saliency_of_lists():
    flat = np.sin(np.arange(32))
    spike = flat.copy()
    spike[-1] += 8
    lists = pa.array([flat.tolist(), spike.tolist(), flat[:7].tolist(), [], spike[12:].tolist()], pa.list_(pa.float64()))
    one = detectors.saliencies(lists)
    assert one[1] > one[0] and one[2] == one[3] == 0
    for k, s in ((0, flat), (1, spike), (4, spike[12:])):
        f = np.fft.fft(s)
        level = np.log(np.abs(f) + 1e-9)
        mean = np.array([sum(level[j] for j in (i - 1, i, i + 1) if 0 <= j < len(s)) / 3 for i in range(len(s))])
        back = np.abs(np.fft.ifft(np.exp(level - mean + 1j * np.angle(f))))
        assert abs(one[k] - min(1, max(0, (back[-1] - back.mean()) / (3 * back.mean())))) < 1e-6


def test_saliency_of_history(spark, points, rows):
    out = {r.seq: r.sr for r in detectors.spectral_residual(points, "src", F.col("score")).collect()}
    past: dict[str, list] = {}
    for r in rows:
        past.setdefault(r.src, []).append(r.score)
        assert abs(out[r.seq] - detectors.saliencies(pa.array([past[r.src][-32:]]))[0]) < 1e-9


def test_cuts_row_by_row(spark, points, rows):
    out = {r.seq: r.rrcf for r in detectors.random_cuts(points, "src", COLUMNS, trees=2, size=8).collect()}
    past: dict[str, list] = {}
    for r in rows:
        x, before = np.array([r[c] for c in COLUMNS]), past.setdefault(r.src, [])
        total = 0.0
        for tree in range(2):
            left, depth = np.array(before[-8:]).reshape(-1, 3), 0
            if len(left) < 4:
                depth, mass = 1, 1
            else:
                for level in range(24):
                    span = np.ptp(left, axis=0)
                    if span.sum() <= 1e-9:
                        break
                    u, v = (float(detectors.uniform(5, np.array([r.seq]), tree, 2 * level + k)[0]) for k in (0, 1))
                    axis = min(int((np.cumsum(span) < u * np.cumsum(span)[-1]).sum()), 2)
                    cut = left[:, axis].min() + v * span[axis]
                    left = left[(left[:, axis] <= cut) == (x[axis] <= cut)]
                    depth += 1
                    if len(left) <= 1:
                        break
                mass = len(left)
            total += 1 / ((1 + depth) * (1 + np.log(mass + 1)))
        assert abs(out[r.seq] - min(1, 2.2 * total / 2)) < 1e-9
        before.append(x)


def test_cuts_take_no_lists_along_and_do_not_depend_on_batches(spark, points):
    whole = detectors.random_cuts(points, "src", COLUMNS)
    assert "collect_list" not in whole._jdf.queryExecution().toString()
    expected = {r.seq: r.rrcf for r in whole.collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {r.seq: r.rrcf for r in detectors.random_cuts(points, "src", COLUMNS, block=3).collect()} == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_far_points_are_cut_off_sooner(spark):
    draw = np.random.default_rng(1)
    made = [(i, i, "a", float(v), float(w)) for i, (v, w) in enumerate(draw.normal(0, 0.1, (200, 2)))] + [(200, 200, "a", 9.0, 9.0)]
    out = {r.seq: r.rrcf for r in detectors.random_cuts(spark.createDataFrame(made, "seq long, us long, src string, x double, y double"), "src", ["x", "y"]).collect()}
    assert out[200] > np.quantile([v for k, v in out.items() if 60 <= k < 200], 0.95)


def test_head_learns_from_blocks():
    draw = np.random.default_rng(0)
    x = draw.random((1000, 3))
    y = (x[:, 0] + 0.2 * x[:, 1] > 0.6).astype(float)
    head = detectors.Head(3)
    assert (head.scores(x[:2]) == 0.5).all()
    head.learn(x[:5], np.full(5, np.nan))
    assert head.seen == 0
    for a in range(0, 600, 16):
        head.learn(x[a : a + 16], y[a : a + 16])
    assert np.mean((head.scores(x[600:]) > 0.5) == y[600:]) > 0.9


def test_fitted_head_learns_from_all_rows(spark):
    """Label 1 only where the numbers hash highest: a head of the lowest 20,000 would see none."""
    w = Window.orderBy(F.xxhash64("seq"))
    df = spark.range(24_000).withColumnRenamed("id", "seq").withColumn("a", F.rand(3)).withColumn("y", (F.row_number().over(w) > 20_000).cast("int"))
    head = detectors.fitted_head(df, ["a"], "y")
    assert head.seen == 24_000
    assert head.scores(np.linspace(0, 1, 50)[:, None]).mean() > 0.1


@pytest.mark.parametrize("name", ["engine_alerts", "engine_process"])
def test_queries_learn_from_all_labels(spark, name, monkeypatch):
    """sf0.1 has 100,000 labels. The query ends once its head is there."""
    heads = []

    def scored(df, columns, head):
        heads.append(head.seen)
        raise StopIteration

    monkeypatch.setattr(detectors, "scored_by_head", scored)
    with pytest.raises(StopIteration):
        QUERIES[name](spark, "/root/testdata/sf0.1")
    assert heads == [100_000]


@pytest.mark.parametrize("size", [1 << 17, 300])
def test_fitted_head_is_the_mean_of_its_shards(spark, points, size):
    df = points.select("seq", *COLUMNS, F.when(F.col("seq") % 7 == 0, F.lit(float("nan"))).when(F.col("seq") % 5 > 0, F.col("label")).alias("y"))
    rows = df.filter("y is not null").select("*", F.xxhash64("seq").alias("h"), F.xxhash64("seq", detectors.vector(COLUMNS), F.col("y").cast("double")).alias("s")).collect()
    shards = -(-len(rows) // size)
    total, seen = 0.0, 0
    for k in range(shards):
        own = sorted((r for r in rows if r.s % shards == k), key=lambda r: r.h)
        one = detectors.Head(3)
        for a in range(0, len(own), 32):
            one.learn(np.array([[r[c] for c in COLUMNS] for r in own[a : a + 32]]), np.array([float(r.y) for r in own[a : a + 32]]))
        total, seen = total + one.weights * one.seen, seen + one.seen
    heads = [detectors.fitted_head(df.repartition(parts), COLUMNS, "y", size) for parts in (1, 5)]
    assert [h.seen for h in heads] == [seen, seen] and seen < len(rows)
    assert np.allclose(heads[0].weights, total / seen, atol=1e-9) and (heads[0].weights == heads[1].weights).all()
    assert detectors.fitted_head(df.limit(0), COLUMNS, "y").seen == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_prequential_by_blocks(spark, points, rows, parts):
    out = {r.seq: r.sup for r in detectors.prequential(points.repartition(parts), ["proto"], ["us", "seq"], COLUMNS, "label").collect()}
    for proto in {r.proto for r in rows}:
        own = [r for r in rows if r.proto == proto]
        head = detectors.Head(3)
        for a in range(0, len(own), 32):
            x, y = np.array([[r[c] for c in COLUMNS] for r in own[a : a + 32]]), np.array([float(r.label) for r in own[a : a + 32]])
            assert np.allclose([out[r.seq] for r in own[a : a + 32]], head.scores(x), atol=1e-9)
            head.learn(x, y)
    assert len(out) == len(rows)


def test_missing_values_count_as_zero(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, float("nan"), 3.0)], "seq long, a double, b double")
    assert [r.v for r in df.orderBy("seq").select(detectors.vector(["a", "b"]).alias("v")).collect()] == [[0.0, 2.0], [0.0, 3.0]]


def test_bank_and_process(spark):
    f = flows(spark, TABLES)
    n = f.count()
    out = engine.processed(f, DAY, 1 / 86400, 0.001, watts=F.col("len"), watt_budget=120.0).cache()
    assert out.count() == n == out.select("seq").distinct().count()
    assert {r.action for r in out.select("action").distinct().collect()} <= {"PASS", "MIRROR", "RATE_LIMIT", "DROP", "QUARANTINE", "REDIRECT"}
    assert out.filter("score < 0 or score > 1 or score is null").count() == 0
    shown = alerts.process(out.filter("action <> 'PASS'"), DAY)
    assert shown.count() <= out.filter("action <> 'PASS'").count()
    again = shown.groupBy("src").agg(F.max("campaign_count").alias("m"), F.count("*").alias("n")).filter("m <> n")
    assert again.count() == 0
    bank = detectors.bank(_points(spark, TABLES), COLUMNS, "label")
    assert bank.columns[-5:] == detectors.BANK and bank.filter(" or ".join(f"{d} is null" for d in detectors.BANK)).count() == 0


def test_skipped_detectors_leave_the_fusion(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}", i % 2, i / 40, None if i % 4 == 0 else i / 40) for i in range(40)], "seq long, src string, label int, one double, two double")
    trust = spark.createDataFrame([("s0", 0.5)], "src string, suspicion double")
    out = {r.seq: r.raw for r in engine.epoch(df, ["one", "two"], [0.5, 0.5], 0.6, 0.5, trust).collect()}
    assert set(out) == set(range(40))
    benign = [i / 40 for i in range(40) if i % 2 == 0]
    alone = lambda i: 1 - (1 + sum(b >= i / 40 for b in benign)) / (len(benign) + 1)
    assert all(abs(out[i] - alone(i)) < 1e-9 for i in range(0, 40, 4))


def test_recent_windows_forget():
    r = folds.Recent(3)
    for v in (5.0, 1.0, 3.0, 2.0):
        r.add(v)
    assert (len(r), r.at_least(3.0), r.at_most(2.0)) == (3, 1, 2)


def test_sink_settings():
    assert alerts.sink_settings({}) == alerts.SINKS
    some = alerts.sink_settings({"RIVULET_SINK_SLACK": "HIGH", "RIVULET_SINK_MAIL": "off"})
    assert some["slack"] == "high" and "mail" not in some
    with pytest.raises(ValueError):
        alerts.sink_settings({"RIVULET_SINK_SLACK": "loud"})


def test_simulated_stream_equals_batch(spark, tmp_path):
    from rivulet.sources.sinks import make_source

    batch = make_source(spark, "sim", rows=3000, batch_rows=1000)
    assert batch.select("dst_ip").distinct().count() > 400
    query = spark.readStream.format("rivulet_sim").option("rows", 3000).option("batch_rows", 1000).load().writeStream.format("memory").queryName("sim_rows").option("checkpointLocation", str(tmp_path)).start()
    try:
        query.processAllAvailable()
        got = spark.table("sim_rows")
        assert got.select("seq").distinct().count() == got.count() == 3000
    finally:
        query.stop()


def test_bank_cuts_rows_once(spark, points):
    plan = detectors.bank(points, COLUMNS, "label")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rrcf#") and plan.count("MapInArrow") == 4  # saliency, cuts, prototypes and head
