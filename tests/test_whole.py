"""Queries that take the whole table, against plain Python over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.operators import detectors, mesh, ordered
from rivulet.plans.catalogue import QUERIES
from rivulet.plans.tables import flows, table

TABLES = "/root/testdata/sf0.001"
STATES = {0: "SUSPECT", 1: "DEAD", 2: "LEFT"}
RANK = {"SUSPECT": 1, "LEFT": 2, "DEAD": 3, "ALIVE": 0}


@pytest.fixture(scope="module")
def events(spark):
    return flows(spark, TABLES).select("seq", "uid", "port", "proto", "len", "label", "score").collect()


def test_median_has_all_events(spark, events):
    groups = {}
    for r in events:
        groups.setdefault(r.proto, []).append(r.len)
    out = {r.proto: r.threshold for r in QUERIES["upper_median"](spark, TABLES).collect()}
    assert out == {k: sorted(v)[len(v) // 2] for k, v in groups.items()}


def test_medians_of_few_and_equal_values(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 1.0), ("b", 5.0), ("b", 5.0), ("b", 7.0), ("c", None)], "k string, v double")
    assert {r.k: r.median for r in mesh.upper_medians(df, "k", "v").collect()} == {"a": 2.0, "b": 5.0}
    assert mesh.upper_medians(df.limit(0), "k", "v").count() == 0


def test_members_have_all_events(spark, events):
    best, bad = {}, {}
    for r in events:
        inc, state = r.port // 25, STATES.get(r.port % 8, "ALIVE")
        old = best.get(r.uid)
        if old is None or inc > old[0]:
            best[r.uid] = (inc, state, r.seq)
        elif inc == old[0]:
            best[r.uid] = (inc, max(old[1], state, key=RANK.get), max(old[2], r.seq))
        if state in ("SUSPECT", "DEAD"):
            bad[r.uid] = max(bad.get(r.uid, -1), inc)
    out = {r.node: (r.incarnation, r.state, r.heartbeat) for r in QUERIES["member_merge"](spark, TABLES).collect()}
    assert out == best
    health = QUERIES["cluster_health"](spark, TABLES).first()
    count = lambda s: sum(v[1] == s for v in best.values())
    assert (health.alive, health.suspect, health.dead, health.quorum) == (count("ALIVE"), count("SUSPECT"), count("DEAD"), count("ALIVE") > len(best) / 2)
    own = {r.node: r.incarnation for r in QUERIES["refutation"](spark, TABLES).collect()}
    assert own == {n: bad[n] + 1 if bad.get(n, -1) >= v[0] else v[0] for n, v in best.items()}


def test_calibration_has_all_benign_events(spark, events):
    benign = np.sort([r.score for r in events if r.label == 0])
    out = {r.seq: r.p for r in QUERIES["conformal_p"](spark, TABLES).collect()}
    for r in events:
        above = len(benign) - np.searchsorted(benign, r.score)
        assert abs(out[r.seq] - (1 + above) / (len(benign) + 1)) < 1e-6


def test_neighbours_of_both_classes_and_needed_points(spark):
    rows = table(spark, TABLES, "embeddings").select("vec_id", "label", "embedding").collect()
    x, y = {r.vec_id: np.array(r.embedding, float) for r in rows}, {r.vec_id: r.label < 5 for r in rows}
    out = {}
    for r in sorted(QUERIES["nearest_neighbours"](spark, TABLES).collect(), key=lambda r: r.rank):
        out.setdefault(r.id, []).append(r.neighbour)
    assert set(out) == set(x)
    for i in list(x)[::25]:
        same = sorted((j for j in x if j != i and y[j] == y[i]), key=lambda j: (((x[i] - x[j]) ** 2).sum(), j))
        assert out[i] == same[:5]
    few = sum(r.label < 3 for r in rows)
    made = QUERIES["smote_knn"](spark, TABLES).collect()
    assert len(made) == abs(len(rows) - 2 * few) and len({r.number for r in made}) == len(made)
    assert all((next(r.label for r in rows if r.vec_id == m.id) < 3) == (2 * few < len(rows)) for m in made[::20])


def test_detectors_have_their_full_size(spark, monkeypatch):
    seen = {}
    cuts, begin = detectors.random_cuts, detectors.Codes.__init__
    monkeypatch.setattr(detectors, "random_cuts", lambda *a, trees=6, **k: seen.update(trees=trees) or cuts(*a, trees=trees, **k))
    monkeypatch.setattr(detectors.Codes, "__init__", lambda self, n, dim=1024, seed=23: seen.update(n=n, dim=dim) or begin(self, n, dim, seed))
    QUERIES["random_cuts"](spark, TABLES)
    QUERIES["hdc_bundle"](spark, TABLES)
    assert seen == {"trees": 6, "n": 64, "dim": 1024}
    hst = QUERIES["hst_mass"](spark, TABLES)
    events = flows(spark, TABLES)
    assert hst.count() == events.count()
    assert hst.join(events.filter("seq < 250"), "seq").filter(F.col("hst") != 1).count() == 0


def test_percentiles_by_ranges(spark):
    draw = np.random.default_rng(8)
    rows = [(k, float(v)) for k in "ab" for v in np.round(draw.normal(0, 1e3, 400), 1)] + [("c", 7.0), ("c", 7.0), ("a", None), ("a", float("nan")), ("d", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    out = {r.k: r.percentiles for r in ordered.percentiles(df, ["k"], "v", [0.0, 0.1, 0.5, 0.99, 1.0]).collect()}
    assert set(out) == {"a", "b", "c"}
    for k, got in out.items():
        own = [v for n, v in rows if n == k and v is not None and v == v]
        assert np.allclose(got, np.percentile(own, [0, 10, 50, 99, 100]))


def test_running_totals_of_skewed_values(spark):
    draw = np.random.default_rng(9)
    values = np.concatenate([draw.random(500) * 1e-6 + 5, [-3.0, 1e9, 5.0, 5.0]])
    df = spark.createDataFrame([(i, float(v), 1) for i, v in enumerate(values)], "seq long, v double, n long")
    for down in (False, True):
        out = ordered.running_totals(df, "v", ["n"], descending=down, tie=[F.col("seq")]).collect()
        got = [r.seq for r in sorted(out, key=lambda r: r.run_n)]
        assert got == sorted(range(len(values)), key=lambda i: ((-values[i] if down else values[i]), i))
    assert ordered.running_totals(df.limit(0), "v", ["n"]).count() == 0
