import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from rivulet.llm import suffix


def brute(rows, length):
    """rows: (id, text) with different ids."""
    seen, out = set(), []
    for doc, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        edges = int(((gone.astype(int)[1:] - gone.astype(int)[:-1]) == 1).sum() + (gone[0] if len(gone) else 0))
        out.append((doc, len(data), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n):
    draw = random.Random(seed)
    words = ["alpha", "béta", "c", "delta,", "e\n", "日本", "zz"] + ["".join(draw.choice("abcdef") for _ in range(5)) for _ in range(300)]
    shared = [" ".join(draw.choice(words) for _ in range(draw.randint(10, 40))) for _ in range(6)]
    rows = []
    for d in range(n):
        parts = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 30)))]
        for _ in range(draw.choice([0, 0, 1, 2, 3])):
            s = draw.choice(shared)
            parts.append(s[draw.randint(0, 9) :] if draw.random() < 0.5 else s)
            parts.append(draw.choice(words))
        rows.append((d, "".join(parts)))
        if draw.random() < 0.15:
            rows[-1] = (d, draw.choice(rows)[1])
    return rows + [(n, None), (n + 1, ""), (n + 2, "a" * 350), (n + 3, "ab" * 90 + "a" * 120), (-5, "x" * 99), (n + 4, "x" * 99)]


@pytest.mark.parametrize(("length", "seed", "pieces"), [(100, 1, 1 << 11), (40, 2, 3)])
def test_against_a_plain_scan(spark, length, seed, pieces, monkeypatch):
    monkeypatch.setattr(suffix, "ANCHOR_PIECES", pieces)
    rows = corpus(seed, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = suffix.without_repeats(df, "doc_id", "text", length).drop("text", "kept").collect()
    assert sorted(map(tuple, out)) == brute(rows, length)


def test_a_text_longer_than_a_slice(spark):
    draw = random.Random(4)
    line = "".join(draw.choice("abcdefgh ") for _ in range(150))
    body = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range((1 << 20) + 5000))
    rows = [(1, body[:3000] + line + body[3000:] + line), (2, body[(1 << 20) - 400 : (1 << 20) + 900]), (3, line)]
    out = suffix.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").drop("text", "kept").collect()
    assert sorted(map(tuple, out)) == brute(rows, 100)


def test_null_and_repeated_ids_empty_table_and_characters(spark):
    text = "é" * 60
    rows = [(7, text, 1), (None, text, 2), (7, text, 3), (8, "a" + text, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes long")
    out = {(r.doc_id, r.kept) for r in suffix.without_repeats(df, "doc_id", "text", whole_characters=True).collect()}
    assert out == {(None, "é"), (7, ""), (8, "a")}
    assert suffix.without_repeats(df.limit(0), "doc_id", "text").count() == 0


def test_suffix_array_and_common_prefixes():
    draw = random.Random(9)
    for text in ["", "a", "banana", "a" * 200, "abc" * 50, "".join(draw.choice("ab") for _ in range(400)), "\0\0a\0\0", "".join(draw.choice("ab\0") for _ in range(60))]:
        data = np.frombuffer(text.encode(), np.uint8)
        order = suffix.suffix_array(data)
        b = text.encode()
        assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        shared = [0] * len(b)
        for k in range(1, len(b)):
            x, y = b[order[k - 1] :], b[order[k] :]
            while shared[k] < min(len(x), len(y)) and x[shared[k]] == y[shared[k]]:
                shared[k] += 1
        assert suffix.common_prefixes(data, order).tolist() == shared


def test_merging_many_shards_moves_a_row_few_times(monkeypatch):
    draw = np.random.default_rng(6)
    n, shards = 6000, 600
    frame = pd.DataFrame({"shard": draw.integers(0, shards, n), "anchor": 5, "key": draw.integers(0, 900, n), "doc": draw.integers(0, 40, n), "at": draw.integers(0, 9, n)})
    frame = frame.drop_duplicates(["shard", "key"], ignore_index=True)
    moved, plain = [], suffix.merged
    monkeypatch.setattr(suffix, "merged", lambda a, b: moved.append(len(a[0]) + len(b[0])) or plain(a, b))
    out = suffix.merge_runs(frame)
    assert sum(moved) <= len(frame) * 10  # 600 runs: ten rounds
    late = [(d, a) for _, g in frame.groupby("key") for d, a in {*zip(g["doc"], g["at"], strict=True)} - {min(zip(g["doc"], g["at"], strict=True))}]
    assert {*zip(out["doc"], out["at"], strict=True)} == {*late}
    assert not len(suffix.merge_runs(frame[frame["shard"] == 3]))
