import random

import numpy as np
import pytest

from rivulet.llm import jaccard
from rivulet.llm.components import components

WHITE = "\t\n\x0b\x0c\r "


def brute(rows, width, percent):
    def shingles(text):
        words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).translate({ord(c): " " for c in WHITE}).split(" ")
        words = [w for w in words if w]
        if not words:
            return set()
        return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}

    sets = [shingles(t) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(rows[i][0]), root(rows[j][0])))
                parent[b] = a
    return {(d, len(s), root(d)) for (d, _), s in zip(rows, sets, strict=True)}


def corpus(seed, n):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "ALSO", "x y"]
    common = " ".join(draw.choice(vocabulary) for _ in range(12))
    rows = []
    for d in range(n):
        kind = draw.random()
        if rows and kind < 0.6:
            words = (draw.choice(rows)[1] or "a").split(" ")
            for _ in range(draw.choice([0, 1, 1, 2, 3, 8])):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            text = draw.choice([" ", "\n"]).join(words)
        else:
            text = " ".join(draw.choice(vocabulary) for _ in range(draw.choice([1, 2, 3, 5, 9, 30, 80, 200])))
            if draw.random() < 0.4:
                text = common + " " + text
        rows.append((d, text.upper() if draw.random() < 0.1 else text))
    return rows + [(n, ""), (n + 1, None), (n + 2, " \n")]


@pytest.mark.parametrize(("width", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (2, 60, 3)])
def test_against_all_pairs(spark, width, percent, seed):
    rows = corpus(seed, 260)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = jaccard.jaccard_components(df, "doc_id", "text", width, percent).collect()
    assert {tuple(r) for r in out} == brute(rows, width, percent)
    assert len(out) == len(rows)


def test_groups_of_copies_at_the_threshold(spark):
    draw = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for d in range(150):
        words = list(base)
        for _ in range(draw.choice([1, 2, 3, 3, 4, 5])):
            words[draw.randrange(120)] = f"r{draw.random()}"
        rows.append((d, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in jaccard.jaccard_components(df, "doc_id", "text", 5, 80).collect()} == brute(rows, 5, 80)


def test_a_group_of_copies_gives_a_forest_not_all_pairs(spark):
    sketch = bytes(jaccard.FILTER_BITS // 8)
    rows = [(key, i, i, True, 0, 0, 50, 50, sketch, b"") for key in range(3) for i in range(key, 60)]
    df = spark.createDataFrame(rows, "key long, id long, part long, lone boolean, far long, far_wide long, low long, high long, sketch binary, wide binary")
    pairs = [(r.a, r.b) for r in jaccard.compared_in_blocks(df, 80).collect()]
    assert len(pairs) <= len(rows)  # 1,770 pairs in the first key alone
    assert {r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()} == {0}


def test_repeated_and_null_ids_and_empty_table(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(1, a, 9), (2, a, 9), (2, b, 9), (3, b, 9), (4, None, 9), (None, a, 9), (5, a, 9), (5, a, 9)], "doc_id long, text string, node long")
    out = sorted((r.id or -1, r.component_id or -1) for r in jaccard.jaccard_components(df, "doc_id", "text").collect())
    assert out == [(-1, -1), (1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (5, 1), (5, 1)]
    assert jaccard.jaccard_components(df.limit(0), "doc_id", "text").count() == 0


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 3)]
    out = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert out == {i: 100 for i in range(100, 161)} | {7: 3, 3: 3}


def test_sketch_distance_never_exceeds_the_difference():
    draw = np.random.default_rng(3)
    for _ in range(50):
        x, y = (draw.integers(0, 2**63, 40, dtype=np.uint64) for _ in range(2))
        y[:30] = x[:30]
        s = [jaccard.parity((v % np.uint64(8)).astype(int), v, 8) for v in (x, y)]
        assert np.bitwise_count(s[0] ^ s[1]).sum() <= 20


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_pairs_at_the_threshold_share_a_key_and_others_do_not(percent):
    draw = np.random.default_rng(percent)
    new = lambda n: draw.integers(0, 2**63, n, dtype=np.uint64)
    sets, pairs = [], 0
    for size in [2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 60, 61, 120, 300, 1000, 3000]:
        for _ in range(25):
            for smaller in (percent * size // 100, size, (size + percent * size // 100) // 2):
                both = -(-percent * (size + smaller) // (100 + percent))  # the least intersection that links them
                if 0 < both <= min(size, smaller) and 100 * both >= percent * (size + smaller - both):
                    shared = new(both)
                    sets += [np.append(shared, new(size - both)), np.append(shared, new(smaller - both))]
                    pairs += 1
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    sizes = np.array([len(x) for x in sets])
    of, key = jaccard.segment_keys(row, np.concatenate(sets), sizes, percent)
    own = [set() for _ in sets]
    for r, k in zip(of.tolist(), key.tolist(), strict=True):
        own[r].add(k)
    equal = [set(sets[2 * k].tolist()) == set(sets[2 * k + 1].tolist()) for k in range(pairs)]
    assert all(e or own[2 * k] & own[2 * k + 1] for k, e in enumerate(equal))
    assert len(key) < sizes.sum()
    groups: dict[int, set[int]] = {}
    for r, k in zip(of.tolist(), key.tolist(), strict=True):
        groups.setdefault(k, set()).add(r // 2)
    assert sum(len(g) > 1 for g in groups.values()) <= 0.002 * len(groups)  # unrelated sets meet in zero segments of very small sets only


def test_percent_below_its_range(spark):
    with pytest.raises(ValueError):
        jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", 5, 50)
