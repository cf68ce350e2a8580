"""Hard negatives against a plain search."""

import math

import numpy as np
import pytest

from rivulet.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector string"


def plain(rows, positives=5, negs=5, every=10):
    own = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own.setdefault(i, []).append((label, tuple(float(np.float32(x)) for x in v)))
    own = {i: min(r) for i, r in own.items()}
    sizes = [len(v) for _, v in own.values()]
    width = min(set(sizes), key=lambda n: (-sizes.count(n), n)) if sizes else 0
    own = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in own.items() if len(v) == width}
    dot = lambda a, b: sum(x * y for x, y in zip(own[a][1], own[b][1], strict=True))
    out = []
    for a in own:
        if a % every:
            continue
        scored = sorted((-dot(a, i), i) for i in own if i != a)
        for s, p in [x for x in scored if own[x[1]][0] == own[a][0]][:positives]:
            fit = [(t, n) for t, n in scored if own[n][0] != own[a][0] and 80 * -s <= 100 * -t <= 100 * -s][:negs]
            out += [(a, p, k, n, -s, -t) for k, (t, n) in enumerate(fit, 1)]
    return sorted(out)


def found(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    whole = negatives.whole_components(frame, "vec_id", "embedding", frame.label)
    return sorted(tuple(r) for r in negatives.mined(whole, lambda d: d.filter("id % 10 = 0"), **options).collect())


@pytest.mark.parametrize("pass_bytes", [1500, 1 << 24])
def test_equal_to_a_plain_search(spark, pass_bytes):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(0.3, 0.3, 6).tolist(), int(draw.integers(0, 3))) for i in range(150)]
    rows += [(200 + i, [0.5] * 6, i % 3) for i in range(80)]  # ties: copies of one vector, over a third of all rows
    rows += [(500, None, 1), (501, [0.1] * 6, None), (502, [0.1, None, 0.1, 0.1, 0.1, 0.1], 1), (510, [float("nan")] * 6, 1), (520, [float("inf")] * 6, 1), (None, [0.1] * 6, 1), (530, [], 1), (540, [0.1, 0.2], 2)]
    rows += [(0, rows[0][1], rows[0][2])] * 2 + [(10, [0.9] * 6, 2)] + [(-10, [0.4] * 6, 1), (550, [0.0] * 6, 0)]
    want = plain(rows)
    assert found(spark, rows, pass_bytes=pass_bytes) == want and len(want) > 100


def test_products_beyond_doubles(spark):
    rows = [(i, [2.0**22 + i % 7, 2.0**21 - i % 3, float(i)], i % 2) for i in range(40)]
    assert found(spark, rows) == plain(rows) != []


def test_empty_and_unusable_tables(spark):
    assert found(spark, []) == [] == found(spark, [(0, None, 1), (10, [float("nan")], 1)]) == found(spark, [(0, [1.0], 1)])


def test_lists_keep_the_best_with_ties_to_smaller_ids():
    best = negatives.Best(2, 3)
    for block in ([(0, 5, 9), (0, 5, 8), (1, 1, 1)], [(0, 5, 7), (0, 4, 1), (0, 5, 1)], [(0, 6, 99)]):
        best.add(*(np.array(c) for c in zip(*block, strict=True)))
    assert list(zip(best.score[0].tolist(), best.id[0].tolist(), strict=True)) == [(6, 99), (5, 1), (5, 7)] and best.full[1].tolist() == [True, False, False]
    assert best.may_enter(np.array([[5], [5]]), np.array([3, 8]), slice(0, 1)).ravel().tolist() == [True, False]
