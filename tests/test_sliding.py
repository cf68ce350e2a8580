"""Sliding statistics against a plain recount, and on streams cut anywhere."""

import math
import random
import time
from collections import Counter

import pyarrow as pa
import pytest

from rivulet.operators import sliding

SPAN = 2_000_000
SCHEMA = "seq long, us long, src string, dst string, port int, len double, flags int"


def flows(n, keys=4, seed=3, spread=60_000_000):
    draw = random.Random(seed)
    rows = [(i, draw.randrange(spread) // 1000 * 1000, draw.choice(["hot"] * 3 + [f"k{j}" for j in range(keys)]), f"d{draw.randrange(6)}", draw.randrange(5), float(draw.randrange(60, 1500)), draw.choice([2, 16, 18])) for i in range(n)]
    return rows + [(n, 0, None, "d", 1, 5.0, 2), (n + 1, 5, None, None, None, None, 2), (n + 2, 5, "hot", None, None, float("nan"), 2), (n + 3, 59_000_000, "late only", "d", 1, 1.0, 2)]


def plain(rows, span=SPAN):
    out = {}
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    for own in by.values():
        own.sort(key=lambda r: (r[1], r[0]))
        for i, r in enumerate(own):
            seen = [x for x in own if r[1] - span <= x[1] <= r[1]]
            ports = Counter(x[4] for x in seen if x[4] is not None)
            n = sum(ports.values())
            entropy = -sum(c / n * math.log(c / n) for c in ports.values()) / math.log(len(ports)) if len(ports) > 1 else 0.0
            out[r[0]] = (len(seen), len({x[3] for x in seen if x[3] is not None}), entropy, sum(x[5] for x in seen if x[5] is not None and x[5] == x[5]), None if i == 0 else r[1] - own[i - 1][1])
    return out


def test_equal_to_a_recount(spark):
    rows = flows(900)
    frame = spark.createDataFrame([(*r, "clash") for r in rows] + [(5000, None, "hot", "d", 1, 1.0, 2, "clash")], SCHEMA + ", other string").repartition(3)
    out = {r.seq: r for r in sliding.statistics(frame, SPAN, reach_us=3_000_000).collect()}
    assert out.pop(5000)[-5:] == (None,) * 5
    want = plain(rows)
    assert out.keys() == want.keys()
    for seq, (n, fanout, entropy, size, gap) in want.items():
        r = out[seq]
        assert (r.n, r.fanout) == (n, fanout) and r.entropy == pytest.approx(entropy, abs=1e-9) and r.bytes == pytest.approx(size)
        assert r.gap_us == gap if gap is None or gap <= 3_000_000 else r.gap_us > 3_000_000


def test_batches_may_cut_equal_times():
    rows = [("a", 0, us, 1, port, "d", 1.0) for us, port in [(1, 1), (2, 2), (2, 3), (2, 3), (2, 4), (9, 5)]]
    names = ["__key", "__stretch", "__us", "__kind", "__port", "__target", "__size"]
    whole = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])
    results = [pa.Table.from_batches(list(sliding.slid(iter([whole.slice(a, size) for a in range(0, 6, size)]), 3, ["__us"]))).to_pylist() for size in (1, 2, 4, 6)]
    assert all(r == results[0] for r in results) and [r["n"] for r in results[0]] == [1, 5, 5, 5, 5, 1]


def test_time_of_a_row_does_not_grow_with_the_window():
    def seconds(span, n=60_000):
        window, begin = sliding.Sliding(span), time.process_time()
        for i in range(n):
            window.forget(i)
            window.add(i, i * 7 % 50, i % 9, 100.0)
            window.values()
        return time.process_time() - begin

    seconds(10, 1000)
    assert seconds(30_000) < 3 * seconds(1_000)


def test_nothing_drifts():
    window = sliding.Sliding(5)
    for i in range(20_000):
        window.forget(i)
        window.add(i, i * 31 % 7, i % 3, 0.1 * (i % 11))
    window.forget(10**9)
    assert (window.spread, window.size, window.with_port, window.ports, window.targets) == (0, 0, 0, {}, {})
