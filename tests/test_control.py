"""Settings as of a row's time, the queue of rules, and enforcement from the next batch."""

import random

from rivulet.operators import folds
from rivulet.streaming import control
from tests.test_timed import streamed

DAY = control.DAY_US


def test_values_hold_from_their_time(spark):
    draw = random.Random(4)
    changes = [(draw.randrange(40 * DAY), i, draw.choice(["budget", "mirror", "other"]), round(draw.random(), 3)) for i in range(60)]
    changes += [(5 * DAY, 100, "budget", 0.5), (5 * DAY, 101, "budget", 0.25), (None, 102, "budget", 9.0), (7, 103, "mirror", None)]
    rows = [(i, draw.randrange(40 * DAY)) for i in range(300)] + [(1000, 5 * DAY), (1001, None)]
    out = control.settings_at(spark.createDataFrame(rows, "seq long, us long"), spark.createDataFrame(changes, control.CHANGES), {"budget": 0.02, "mirror": 0.05}).collect()
    assert len(out) == len(rows)

    def want(us, name, default):
        past = sorted((c[0], c[1], c[3]) for c in changes if c[2] == name and c[0] is not None and c[3] is not None and us is not None and c[0] <= us)
        return past[-1][2] if past else default

    for r in out:
        assert (r.budget, r.mirror) == (want(r.us, "budget", 0.02), want(r.us, "mirror", 0.05))
    nothing = control.settings_at(spark.createDataFrame(rows[:0], "seq long, us long"), spark.createDataFrame(changes, control.CHANGES), {"budget": 0.02})
    assert nothing.count() == 0 and nothing.columns == ["seq", "us", "budget"]


def test_a_budget_changed_in_mid_stream_changes_later_rows_only(spark, tmp_path):
    draw = random.Random(1)
    rows = [(i, i * 1_000_000, "TCP", draw.random()) for i in range(400)]
    schema = "seq long, us long, proto string, score double"

    def step(s, row):
        s = folds.threshold_step(s, row["score"], budget=row["budget"])
        return s, {"seq": row["seq"], "tau": s["tau"]}

    def taus(changes):
        held = control.settings_at(spark.createDataFrame(rows, schema), spark.createDataFrame(changes, control.CHANGES), {"budget": 0.02})
        return {r.seq: r.tau for r in folds.fold(held, ["proto"], ["us", "seq"], folds.threshold_start, step, "seq long, tau double").collect()}

    before, after = taus([]), taus([(200_000_000, 1, "budget", 0.3)])
    assert all(before[i] == after[i] for i in range(200)) and all(before[i] != after[i] for i in range(200, 400))


def test_queue(spark, tmp_path):
    event = lambda us, kind, rule, body="{}", queue="q": (queue, us * 1_000_000, us, kind, rule, body)
    rows = [event(10 + i, "proposed", f"r{i}") for i in range(5)] + [event(16, "proposed", "r4"), event(20, "approved", "r4"), event(21, "approved", "r0"), event(22, "rejected", "r3"), event(23, "approved", "r3"), event(24, "proposed", "r9", None), event(25, "proposed", "r1", "{}", None)]
    parts = [rows[:4], rows[4:8], rows[8:], [event(1000, "none", "x")], [event(1001, "none", "x")]]
    out = streamed(spark, parts, tmp_path, "queue string, us long, seq long, kind string, rule string, body string", lambda s: control.rule_queue(s, most=3)).collect()
    said = sorted((r.us // 1_000_000, r.rule, r.status) for r in out)
    assert said == sorted([(10, "r0", "pending"), (11, "r1", "pending"), (12, "r2", "pending"), (13, "r3", "pending"), (13, "r0", "dropped"), (14, "r4", "pending"), (14, "r1", "dropped"), (20, "r4", "approved"), (21, "r0", "unknown"), (22, "r3", "rejected"), (23, "r3", "unknown"), (24, "r9", "pending"), (25, "r1", "pending")])


def test_approved_rules_hold_from_the_next_batch(spark, tmp_path):
    enforcer = control.Enforcer(spark, str(tmp_path / "e"), {"budget": 0.02})
    schema = "seq long, us long, src string, proto string, action string"
    batch = lambda k: spark.createDataFrame([(10 * k, 100 * k, "a", "TCP", "PASS"), (10 * k + 1, 100 * k + 50, "a", "UDP", "PASS"), (10 * k + 2, 100 * k + 60, "b", "TCP", "PASS")], schema)
    rules = lambda *r: spark.createDataFrame([("q", 1, *x) for x in r], "queue string, us long, rule string, body string, status string").write.mode("append").parquet(str(tmp_path / "e" / "rules"))
    enforcer.process(batch(0), 0)
    enforcer.change(150, 1, "budget", 0.1)
    rules(("r1", '{"src":"a","proto":"TCP","action":"DROP"}', "approved"), ("r2", '{"src":"b","action":"MIRROR"}', "pending"), ("r3", "broken", "approved"))
    enforcer.process(batch(1), 1)
    rules(("r2", '{"src":"b","action":"MIRROR"}', "approved"))
    enforcer.process(batch(1), 1)  # again: the rules that it had seen at first
    enforcer.process(batch(2), 2)
    out = {r.seq: (r.action, r.rule, r.budget) for r in enforcer.table().collect()}
    assert out == {
        0: ("PASS", None, 0.02), 1: ("PASS", None, 0.02), 2: ("PASS", None, 0.02),
        10: ("DROP", "r1", 0.02), 11: ("PASS", None, 0.1), 12: ("PASS", None, 0.1),
        20: ("DROP", "r1", 0.1), 21: ("PASS", None, 0.1), 22: ("MIRROR", "r2", 0.1),
    }
