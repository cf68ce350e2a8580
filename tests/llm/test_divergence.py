"""Divergence of sources against a plain count."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from rivulet.llm import divergence


def plain(rows, least=30, top=50):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in seen.items() if n >= least}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        q = share(Counter(t for d in own for t in d[2]))
        count = {s: Counter(t for d in own if d[1] == s for t in d[2]) for s in {d[1] for d in own}}
        p = {s: share(c) for s, c in count.items()}
        for s in p:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in p if o != s)
            term = sorted((q[t] - p[s][t], t.encode()) for t in kept if count[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -v, k) for part, found in (("pair", pair), ("term", term)) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def rows_of(n, seed=5):
    draw = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "ÉTÉ", "été", "日本", "x", "don't", "a1b", "Z_z", "naïve", *(f"w{chr(97 + k)}" for k in range(20)), "l" * 40, "l" * 39 + "m", "é" * 20]
    out = [(" ".join(draw.choices(words, k=draw.randrange(25))) + draw.choice(["", ".", "\u0000", "!"]), draw.choice(["en", "de", None, "xx"]), draw.choice([None, "", "s1", "s2", "ß", "Z", "hot", "hot", "hot"])) for _ in range(n)]
    return out + [(None, "en", "only null"), ("", "lonely", "one"), ("word", "lonely", "two"), (None, None, None)] + [out[0]] * 4 + [("beta " * 5000, "en", "s1")]


@pytest.mark.parametrize("options", [{}, {"term_block": 3, "source_block": 2}, {"term_block": 1, "source_block": 1, "top": 3}])
def test_equal_to_a_plain_count(spark, options):
    rows = rows_of(400)
    frame = spark.createDataFrame([(*r, "clash", 7) for r in rows], "text string, lang string, source string, term string, n long").repartition(5)
    out = sorted(tuple(r) for r in divergence.audited(frame, least_docs=12, **options).collect())
    assert out == plain(rows, 12, options.get("top", 50)) and {r[2] for r in out} == {"pair", "term"}


def test_nothing_kept_and_no_rows(spark):
    rows = rows_of(20)
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence.audited(frame, least_docs=10**6).collect()) == plain(rows, 10**6)
    assert divergence.audited(frame.limit(0)).count() == 0


def test_hash_equals_the_librarys():
    draw = np.random.default_rng(2)
    data = np.append(draw.integers(0, 256, 5000).astype(np.uint8), np.zeros(16, np.uint8))
    lengths = draw.integers(1, 60, 400)
    starts = draw.integers(0, 4900, 400)
    assert divergence.hashed(data, starts, lengths).tolist() == [xxhash.xxh64_intdigest(data[s : s + n].tobytes()) for s, n in zip(starts, lengths, strict=True)]


def test_equal_hashes_of_different_bytes_are_told_apart():
    body = b"abcabcabdlonglonglongwordlonglonglongworx"
    data = np.append(np.frombuffer(body, np.uint8), np.zeros(16, np.uint8))
    starts, lengths = np.array([0, 3, 6, 9, 25, 0]), np.array([3, 3, 3, 16, 16, 2])
    group, first = divergence.grouped(data, starts, lengths, np.array([7, 7, 7, 8, 8, 7], np.uint64))
    words = [body[s : s + n] for s, n in zip(starts, lengths, strict=True)]
    assert [words[first[g]] for g in group] == words and len(first) == len(set(words))


def test_shares_are_exact(spark):
    from pyspark.sql import functions as F

    cases = [(0, 7), (1, 7), (10**12 + 3, 10**13 + 1), (2, 7), (9 * 10**14, 9 * 10**15), (995, 1000)]
    out = spark.createDataFrame(cases, "n long, lower long").select(divergence.share(F.col("n"), F.col("lower")).alias("p")).collect()
    want = [1 + 10**9 * (n + 5) // d for n, d in cases]
    assert [r.p for r in out] == want == divergence.shares(*(np.array(c, np.int64) for c in zip(*cases, strict=True))).tolist()
