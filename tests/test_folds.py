"""Steps and closed forms against hand-checked values and plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.functions import flow as fx
from rivulet.operators import alerts, detectors, engine, folds, mesh, metrics, rules, tables, windows


def test_trust_and_suspicion():
    s = folds.trust_start()
    for m in (1, 1, 0):
        s = folds.trust_step(s, m)
    assert (round(s["a"], 6), round(s["b"], 9)) == (1.941192, 2.970099875)
    n = s["a"] + s["b"]
    assert round(s["a"] / n, 6) == 0.395251
    assert round(min(1, s["b"] / n + 0.4 * math.sqrt(math.log(s["seen"] + 2) / n)), 6) == 0.833730


def test_threshold():
    s, out = folds.threshold_start(), []
    for x in (0.9, 0.1, 0.7):
        s = folds.threshold_step(s, x)
        out.append(round(s["tau"], 6))
    assert out == [0.659756, 0.658566, 0.715542]
    for x in np.random.default_rng(1).random(3000):
        s = folds.threshold_step(s, float(x), 9.0)
        assert 0.05 <= s["tau"] <= 0.999


def test_hedge():
    s = folds.hedge_step(folds.hedge_start(3)(), [0.9, 0.5, 0.1], 1)
    assert [round(w, 6) for w in s["w"]] == [0.343959, 0.336454, 0.319587]
    assert abs(sum(s["w"]) - 1) < 1e-12


def test_drift_resets_after_its_alarm():
    s, levels, alarms = folds.drift_start(), [], []
    for _ in range(6):
        s, level, alarm = folds.drift_step(s, 1e-6)
        levels.append(round(level, 6))
        alarms.append(alarm)
    assert levels == [1.021859, 2.043718, 3.065578, 4.087437, 5.109296, 1.021859]
    assert alarms == [False] * 4 + [True, False]


def test_dedup_is_greedy():
    s, out = folds.dedup_start(), []
    for t in (0, 2, 2.9, 3, 5, 6.1):
        s, shown = folds.dedup_step(s, t, 3.0, False)
        out.append(int(shown))
    assert out == [1, 0, 0, 1, 0, 1]


def test_budget_and_bucket():
    s, taught = folds.budget_start(), 0
    for _ in range(40):
        s, ok = folds.budget_step(s)
        taught += ok
    assert taught == 20 and s["b"] < 1.05
    s = folds.bucket_start(2.0)()
    out = []
    for t in (0, 0, 0, 1, 0.5, 1):
        s, ok = folds.bucket_step(s, t, 1.0, 2.0)
        out.append(ok)
    assert out == [True, True, False, True, False, False]


def test_canary_is_promoted_and_rolled_back():
    s = folds.canary_start()
    for k in range(400):
        s = folds.canary_step(s, k in (0, 200), k % 2 == 0, k < 200)
    assert (s["promoted"], s["rolled_back"], s["version"]) == (1, 1, 2)


def test_calibration():
    c = engine.Calibration()
    assert round(c.p(0.8), 6) == 0.289050
    for k in range(100):
        c.add(0.9 if k < 3 else 0.1)
    assert round(c.p(0.5), 6) == 0.039604
    c = engine.Calibration(window=3, warm=0)
    for v in (1, 2, 3, 4):
        c.add(v)
    assert c.recent.sorted == [2, 3, 4]


@pytest.mark.parametrize(("score", "suspicion", "unknown", "action"), [(0.55, 0, True, "REDIRECT"), (0.80, 0.9, False, "QUARANTINE"), (0.80, 0.7, False, "DROP"), (0.65, 0.9, False, "RATE_LIMIT"), (0.80, 0.5, False, "RATE_LIMIT"), (0.55, 0.5, False, "MIRROR"), (0.40, 0.5, False, "PASS"), (0.40, 0.5, True, "PASS")])
def test_action_table(spark, score, suspicion, unknown, action):
    assert engine.action_of(score, 0.6, 0.52, suspicion, unknown) == action
    row = spark.range(1).select(fx.choose_action(F.lit(score), F.lit(0.6), F.lit(0.52), F.lit(suspicion), F.lit(unknown)).alias("d")).first()
    assert row.d.action == action


def test_scalars(spark):
    row = spark.createDataFrame([(r,) for r in (0.5, 1.0, 9.0, 10.0, 1000.0, 1e6)], "rate double").select(fx.rate_band(F.col("rate")).alias("b")).collect()
    assert [r.b for r in row] == [0, 0, 1, 2, 6, 9]
    names = ["BENIGN", "BenignTraffic", " normal ", "0", "None", "DDoS", None, ""]
    got = spark.createDataFrame([(n,) for n in names], "x string").select(fx.is_benign(F.col("x")).alias("b")).collect()
    assert [r.b for r in got] == [True, True, True, True, True, False, False, False]
    lengths = ["12.9", "0", "x", "99999", "-4", "nan", "inf", None]
    got = spark.createDataFrame([(n,) for n in lengths], "x string").select(fx.packet_length(F.col("x")).alias("b")).collect()
    assert [r.b for r in got] == [12, 64, 64, 65535, 1, 64, 64, 64]
    assert spark.range(1).select(fx.ipv4_number(F.lit("10.0.0.7")).alias("n")).first().n == 167772167
    gaps = spark.createDataFrame([(float(d),) for d in (500, 900, 1000, 1100, 1200)], "d double")
    literal = [round(r.p, 2) for r in gaps.select(fx.phi(F.col("d"), F.lit(1000.0), F.lit(50.0), corrected=False).alias("p")).collect()]
    assert literal == [10, 0.03, 0, 1.63, 4.74]
    rising = [r.p for r in gaps.select(fx.phi(F.col("d"), F.lit(1000.0), F.lit(50.0)).alias("p")).collect()]
    assert rising == sorted(rising)


def test_mix_and_zeros(spark):
    def mixed(x, seed):
        x = (x ^ seed) * 0x9E3779B1 & 0xFFFFFFFF
        x ^= x >> 15
        x = x * 0x85EBCA77 & 0xFFFFFFFF
        return x ^ x >> 13

    values = [0, 1, 77, 2**31, 2**32 - 1, 123456789]
    out = spark.createDataFrame([(v,) for v in values], "x long").select(fx.mix32(F.col("x"), 0x5BD1E995).alias("h"), fx.leading_zeros32(F.col("x")).alias("z")).collect()
    assert [r.h for r in out] == [mixed(v, 0x5BD1E995) for v in values]
    assert [r.z for r in out] == [32 - v.bit_length() for v in values]


def test_ranking_metrics(spark):
    df = spark.createDataFrame([(0.9, 1, 1), (0.8, 0, 2), (0.8, 1, 3), (0.3, 0, 4)], "score double, label int, seq long")
    assert metrics.roc_auc(df).first().roc_auc == 0.875
    assert metrics.average_precision(df).first().pr_auc == 1.0
    assert metrics.roc_auc(df.filter("label = 1")).first().roc_auc is None
    flipped = df.withColumn("score", 1 - F.col("score"))
    assert metrics.roc_auc(flipped).first().roc_auc == 0.125
    c = spark.createDataFrame([(8, 2, 85, 5)], "tp long, fp long, tn long, fn long")
    r = metrics.rates(c, 4).first()
    assert (r.precision, r.recall, r.f1, r.mcc) == (0.8, 0.6154, 0.6957, 0.6641)
    zero = metrics.rates(spark.createDataFrame([(0, 0, 0, 0)], "tp long, fp long, tn long, fn long")).first()
    assert (zero.precision, zero.mcc, zero.fpr) == (0, 0, 0)


def test_discovery_cutoff(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216] * 2
    df = spark.createDataFrame([(v,) for v in p], "p double")
    assert alerts.discovery_cutoff(df).first().cutoff == 0.06
    assert alerts.discovery_cutoff(df.limit(5)).first().cutoff == 1.0


def test_entropy(spark):
    df = spark.createDataFrame([([1, 1, 2, 3],), ([5, 5],)], "p array<int>")
    assert [round(r.e, 6) for r in df.select(windows.entropy(F.col("p")).alias("e")).collect()] == [0.946395, 0.0]


def test_peers(spark):
    v = [[0.2, 0.8], [0.25, 0.75], [0.22, 0.78], [0.9, 0.1], [0.24, 0.76]]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "k int, i long, v array<double>")
    assert [round(x, 6) for x in mesh.trimmed_mean(df, "k", "v").first().vector] == [0.236667, 0.763333]
    best = mesh.krum(df, "k", "i", "v").first()
    assert best.id == 4 and round(best.score, 6) == 0.001
    assert abs(sum(mesh.federated(df, "k", "i", "v").first().weights) - 1) < 1e-12


def test_merges_do_not_depend_on_order(spark):
    rows = [("a", 5, 1, "x"), ("a", 7, 2, "y"), ("a", 7, 3, "z"), ("b", 1, 4, "w")]
    for order in (rows, rows[::-1], rows + rows):
        df = spark.createDataFrame(order, "ip string, us long, seq long, v string")
        assert {(r.ip, r.v) for r in mesh.merged_intel(df, "ip").collect()} == {("a", "y"), ("b", "w")}
    m = spark.createDataFrame([("n", 1, "DEAD", 9), ("n", 2, "ALIVE", 3), ("n", 2, "SUSPECT", 5)], "node string, incarnation long, state string, heartbeat long")
    assert tuple(mesh.merged_members(m).first()) == ("n", 2, "SUSPECT", 5)


def test_cardinality(spark):
    df = spark.range(3000).select(F.col("id").alias("s"))
    regs = tables.registers(df, F.col("s"), F.lit(0))
    assert abs(tables.cardinality(regs).first().estimate - 3000) < 300
    assert tables.cardinality(regs, correct=False).first().estimate > 10000


def test_sketch_never_underestimates(spark):
    df = spark.range(5000).select((F.col("id") % 1700).alias("k"))
    assert tables.count_min_estimates(df, "k").filter("estimate < n").count() == 0


def test_no_rules_without_enough_rows(spark):
    df = spark.createDataFrame([(0.1, 0.2, 1)], "a double, b double, y int")
    assert rules.distilled(df, ["a", "b"], "y").count() == 0


def test_fold_streams_one_state_a_key(spark):
    rows = [(k % 7, n, float(n)) for n in range(4000) for k in (n,)]
    df = spark.createDataFrame(rows, "k long, n long, v double")

    def step(s, row):
        s = {"t": s["t"] + row["v"]}
        return s, {"k": row["k"], "n": row["n"], "t": s["t"]}

    out = folds.fold(df, ["k"], ["n"], lambda: {"t": 0.0}, step, "k long, n long, t double").collect()
    assert len(out) == 4000
    assert {r.k: r.t for r in out if r.n >= 3993} == {k: float(sum(n for n in range(4000) if n % 7 == k)) for k in range(7)}
