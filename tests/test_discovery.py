"""The rolling cutoff against sorting each window."""

import random

import numpy as np
import pytest

from rivulet.operators import discovery


def plain(ps, window, q, least):
    out = []
    for i in range(len(ps)):
        own = np.sort(ps[max(0, i + 1 - window) : i + 1])
        n = len(own)
        level = q * (np.arange(1, n + 1) / n)
        below = np.flatnonzero(own <= level)
        out.append(1.0 if n < least else float(own[below[-1]]) if len(below) else float(level[0]))
    return out


@pytest.mark.parametrize("window", [1, 2, 20, 37, 500])
def test_each_step_equals_sorting(window):
    draw = random.Random(window)
    ps = [draw.choice([0.0, 0.1 / window, 0.05, 0.1, draw.random() ** 3, 1.0]) for _ in range(1500)]
    state, got = discovery.Cutoff(window, 0.1, 5), []
    for p in ps:
        state.add(p)
        got.append(state.value())
    assert got == plain(ps, window, 0.1, 5)


@pytest.mark.parametrize(("stretch", "window"), [(64, 50), (16, 50), (8192, 500)])
def test_stretches_don_t_show(spark, monkeypatch, stretch, window):
    monkeypatch.setattr(discovery, "STRETCH", stretch)
    draw = random.Random(1)
    rows = [(i, i // 7, draw.choice([None, 0.001, draw.random()]), "x") for i in range(600)]
    out = discovery.rolling_cutoffs(spark.createDataFrame(rows, "seq long, us long, p double, cut string").repartition(3), "p", window).collect()
    want = plain([1.0 if r[2] is None else r[2] for r in rows], window, 0.1, 20)
    assert {r.seq: r.cutoff for r in out} == dict(enumerate(want)) and len(out) == len(rows)
