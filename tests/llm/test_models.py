"""Learned operators: accuracy on rows kept out, and defined results for odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import langid, lm, quality, toxicity
from rivulet.llm.common import fit_logistic, is_held_out, labelled, summed, vector_parts
from rivulet.llm.text import Words, distinct_pairs, shingles, utf8, words

BAD = ["vilex", "grumt", "snarb"]
ODD = [(9001, None), (9002, ""), (9003, " \n"), (9004, "12 34 !!"), (None, "vilex grumt vilex")]


def prose(draw, n, syllables):
    return " ".join("".join(draw.choice(syllables) for _ in range(draw.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    draw, rows, labels = random.Random(3), [], []
    tongues = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ein", "ung", "er"], "cc": ["é", "ois", "eau", "qu"]}
    for d in range(500):
        lang = draw.choice(list(tongues))
        text = prose(draw, draw.randint(20, 120), tongues[lang])
        toxic, bad = draw.random() < 0.2, draw.random() < 0.2
        if bad:
            text = " ".join(f"{w}!!" for w in text.upper().split()) if draw.random() < 0.5 else " | ".join(text.split())
        if toxic:
            parts = text.split(" ")
            for _ in range(3):
                parts.insert(draw.randrange(len(parts)), draw.choice(BAD) + draw.choice(["", "ka", "to"]))
            text = " ".join(parts)
        rows.append((d, text, lang))
        labels.append((d, int(not bad), int(toxic)))
    docs = spark.createDataFrame(rows + [(d, t, None) for d, t in ODD], "doc_id long, text string, lang string").repartition(3).persist()
    return docs, spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").persist()


def accuracy(out, labels, name, level):
    rows = out.filter(is_held_out(F.col("doc_id"))).join(labels.filter(f"{name} is not null"), "doc_id").select((F.col("s") >= level).cast("int").alias("p"), name).collect()
    return np.mean([r.p == r[name] for r in rows])


def test_toxicity(corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels)
    out = toxicity.scored(docs, "text", model)
    assert accuracy(out.withColumnRenamed("toxicity", "s"), labels, "toxic", 0.3) > 0.95
    odd = {r.doc_id: r for r in out.filter("doc_id > 9000 or doc_id is null").collect()}
    assert odd[None].toxicity > 0.3 and odd[9001].toxicity == odd[9002].toxicity < 0.3
    span = odd[None].toxic_spans[0]
    assert "vilex grumt vilex"[span["first"] : span["end"]] == "vilex grumt vilex"
    assert toxicity.scored(docs.limit(0), "text", model).count() == 0
    none = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert toxicity.scored(docs, "text", none).filter("toxicity > 0.3").count() == 0


def brute_segments(scores):
    """Maximal segments by definition (Ruzzo and Tompa): largest-sum segment, then the same on both sides."""
    def best(low, high):
        options = [(sum(scores[i:j]), -(j - i), -i, i, j) for i in range(low, high) for j in range(i + 1, high + 1)]
        top = max(options, default=None)
        if top is None or top[0] <= 0:
            return []
        return best(low, top[3]) + [(top[3], top[4] - 1)] + best(top[4], high)

    return best(0, len(scores))


def test_segments_against_the_definition():
    draw = np.random.default_rng(2)
    for _ in range(60):
        at = np.flatnonzero(draw.random(14) < 0.4)
        score = draw.integers(1, 9, len(at)) + draw.random(len(at)) / 7
        every = np.full(14, -1.3)
        every[at] = score
        got = [(a, b) for a, b, _ in toxicity.maximal_segments(at, score, 1.3)]
        assert got == brute_segments(every.tolist())


def test_rate_of_chance_sums():
    draw = np.random.default_rng(8)
    scored = np.zeros(toxicity.STEPS)
    scored[100], scored[200] = 30, 10  # scores of about 2 and 4
    rate = toxicity.chance_rate(scored, 4000, 0.05)
    values = np.array([100.5 * toxicity.STEP, 200.5 * toxicity.STEP, -0.05])
    share = np.array([30, 10, 4000]) / 4040
    assert abs(share @ np.exp(rate * values) - 1) < 1e-6 and rate > 1e-3
    steps = draw.choice(values, (4000, 400), p=share)
    top = np.maximum(0, np.cumsum(steps, axis=1)).max(1)  # the chance of reaching S falls as exp(-rate S)
    high = [(top >= s).mean() for s in (8, 16)]
    assert high[1] <= high[0] * np.exp(-rate * 8) * 1.6 + 0.01
    assert toxicity.chance_rate(np.zeros(toxicity.STEPS), 100, 0.05) == 1.0


def test_quality(corpus):
    docs, labels = corpus
    model = quality.fit(docs, labels)
    out = quality.scored(docs, "text", model)
    assert accuracy(out.withColumnRenamed("quality", "s"), labels, "quality", 0.7) > 0.9
    assert all(0 <= r.quality <= 1 for r in out.collect())
    assert quality.scored(docs.limit(0), "text", model).count() == 0


def test_prior_estimate():
    draw = np.random.default_rng(5)
    p = draw.normal(2, 1, 40000)
    u = np.where(draw.random(40000) < 0.7, draw.normal(2, 1, 40000), draw.normal(-3, 1, 40000))
    counts = [np.bincount(quality.binned(v, -6, 6), minlength=quality.BINS) for v in (p, u)]
    assert abs(quality.estimated_prior(*counts) - 0.7) < 0.05


@pytest.mark.parametrize("prior", [0.3, 0.7, 0.99])
def test_least_risk_against_descent(prior):
    draw = np.random.default_rng(6)
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (draw.normal(1, 1, (300, 3)), np.concatenate([draw.normal(1, 1, (420, 3)), draw.normal(-1, 1, (180, 3))])))
    moment = lambda x: (x.T @ x / len(x), x.mean(0))
    w = quality.least_risk(moment(p), moment(u), prior)

    def risk(w):
        a, b, c = ((1 - p @ w) ** 2).mean(), ((1 + u @ w) ** 2).mean(), ((1 + p @ w) ** 2).mean()
        return prior * a + max(0.0, b - prior * c) + 1e-2 * (w[:-1] @ w[:-1])

    assert all(risk(w) <= risk(w + draw.normal(0, s, 4)) + 1e-7 for s in (0.3, 0.03, 0.003) for _ in range(300))


def test_quality_moments_of_all_documents(spark, corpus):
    docs, _ = corpus
    model = quality.Quality(np.zeros(quality.STYLE), np.ones(quality.STYLE), np.ones(quality.WIDTH))
    data, offsets = utf8(__import__("pyarrow").array([r.text for r in docs.select("text").collect()]))
    x = model.rows(data, offsets)
    second, first, n = quality.moments(docs.select("text"), model)
    assert n == len(x) and np.allclose(second, x.T @ x / n) and np.allclose(first, x.mean(0))
    assert (quality.histogram(docs.select("text"), model, -50, 50) == np.bincount(quality.binned(x.sum(1), -50, 50), minlength=quality.BINS)).all()


def test_languages(corpus):
    docs, _ = corpus
    model = langid.fit(docs)
    rows = langid.identified(docs, "text", model).collect()
    known = [r for r in rows if r.lang is not None]
    assert np.mean([r.lang == r.lang_pred for r in known]) > 0.97
    odd = {r.doc_id: r for r in rows if r.lang is None}
    assert all(odd[k].lang_pred == "und" and odd[k].score == 0 for k in (9001, 9002, 9003, 9004))
    assert set(model.languages) == {"aa", "bb", "cc"}
    none = langid.fit(docs.filter("lang is null"))
    assert {r.lang_pred for r in langid.identified(docs, "text", none).collect()} == {"und"}


def test_lm_learns_and_sums(corpus):
    docs, _ = corpus
    model = lm.fit(docs, every=1)
    flat = lm.WindowModel(model.vocabulary, lm.start(np.ones(lm.IDS)))
    rows = {r.doc_id: r for r in lm.scored(docs, "text", model).collect()}
    before = {r.doc_id: r for r in lm.scored(docs, "text", flat).collect()}
    assert sum(r.pseudo_log_likelihood for r in rows.values()) > sum(r.pseudo_log_likelihood for r in before.values())
    assert rows[9001].n_words == 0 and rows[9001].pseudo_log_likelihood == 0 and rows[9001].mean_log_probability is None
    w = lm.unpacked(model.flat)
    data, offsets = utf8(__import__("pyarrow").array(["ka to mi ru kato"]))
    ids = model.vocabulary.ids(words(data, offsets).hash)
    context = lm.contexts(ids, np.zeros(5, int), np.arange(5))
    every = np.stack([lm.log_probabilities(w, context, np.full(5, k)) for k in range(0, lm.IDS)])
    assert np.allclose(np.exp(every.astype(float)).sum(0), 1, atol=1e-3)


def test_lm_trains_on_every_word(spark):
    import pyarrow as pa

    def turns(text):
        data, offsets = utf8(pa.array([text]))
        h = words(data, offsets).hash
        return lm.mix(h + np.arange(len(h), dtype=lm.U64) * lm.MULTIPLIERS[26]) % lm.U64(8)

    text = next(t for t in (f"left{k} right{k} up{k}" for k in range(100)) if (turns(t) != 0).all())
    docs = spark.createDataFrame([(k, text) for k in range(40)], "doc_id long, text string").coalesce(1)
    before, after = (lm.scored(docs, "text", lm.fit(docs, rounds=r)).first().pseudo_log_likelihood for r in (0, 1))
    assert after > before + 0.1
    assert np.array_equal(np.sort(lm.dealt(np.arange(1000, dtype=lm.U64), 8)), np.arange(1000))


def test_lm_words_with_a_shared_id_differ(spark):
    import pyarrow as pa

    common = [f"common{k} " * 3 for k in range(lm.IDS - lm.SHARED)]
    data, offsets = utf8(pa.array([" ".join(f"rare{k}" for k in range(4000))]))
    h = words(data, offsets).hash
    slot = lm.mix(h * lm.MULTIPLIERS[25]) % lm.U64(lm.SHARED)
    one, two, three = (f"rare{k}" for k in np.flatnonzero(slot == slot[0])[:3])  # none of them is common
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*common, f"{one} {one}", two, one[:0], None, two])], "doc_id long, text string").repartition(3)
    model = lm.fit(docs, rounds=0)
    plain = lm.WindowModel(lm.Vocabulary(model.vocabulary.lookup.known), model.flat)
    asked = spark.createDataFrame([(1, one), (2, two), (3, two), (4, three), (5, f"{one} {two} {one}"), (6, ""), (None, None), (7, common[0])], "doc_id long, text string")
    rows = {r.doc_id: r for r in lm.scored(asked, "text", model).collect()}
    before = {r.doc_id: r for r in lm.scored(asked, "text", plain).collect()}
    added = {k: rows[k].pseudo_log_likelihood - before[k].pseudo_log_likelihood for k in before}
    expected = {1: np.log(0.5), 2: np.log(0.5), 3: np.log(0.5), 4: -np.log(5), 5: 3 * np.log(0.5), 6: 0, None: 0, 7: 0}
    assert len(rows) == 8 and all(abs(added[k] - v) < 1e-6 for k, v in expected.items())
    assert rows[6].mean_log_probability is None and abs(rows[5].mean_log_probability * 3 - rows[5].pseudo_log_likelihood) < 1e-9


def test_lm_beats_word_shares_on_held_out_rows_at_any_number_of_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    learned, rest = docs.filter(~is_held_out(F.col("doc_id"))), docs.filter(is_held_out(F.col("doc_id")))
    counted = lm.word_counts(learned, "text").toPandas()
    known, total, kinds = dict(zip(counted.word, counted.n, strict=True)), counted.n.sum(), len(counted)
    found = np.concatenate([words(*utf8(__import__("pyarrow").array([r.text or ""]))).hash for r in rest.collect()]).view(np.int64)
    shares = np.mean([np.log((known.get(h, 0) + 0.5) / (total + 0.5 * (kinds + 1))) for h in found.tolist()])
    means = []
    for parts in (1, 8, 32):
        out = lm.scored(rest, "text", lm.fit(learned.repartition(parts)), keep_text=False)
        assert out.columns == ["doc_id", "n_words", "pseudo_log_likelihood", "mean_log_probability"]
        row = out.agg(F.sum("pseudo_log_likelihood").alias("s"), F.sum("n_words").alias("n")).first()
        assert row.n == len(found)
        means.append(row.s / row.n)
    assert min(means) > shares + 0.5
    assert max(means) - min(means) < 0.01 * abs(shares)


def test_lm_leaves_other_columns_alone(spark):
    rows = [(1, "one two two", "own", 5), (1, "one two two", "other", 6), (None, None, None, 7), (2, "", "x", None), (3, "rare " * 70_000, "long", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash string, Text_Share int")
    model = lm.fit(docs)
    common = lm.Vocabulary(model.vocabulary.lookup.known[:1])  # all but one word share ids
    common.counts, common.totals = model.vocabulary.counts, lm.shared_totals(model.vocabulary.counts, lm.Vocabulary(model.vocabulary.lookup.known[:1]))
    out = lm.scored(docs, "text", lm.WindowModel(common, model.flat))
    assert out.columns == [*docs.columns, "n_words", "pseudo_log_likelihood", "mean_log_probability"]
    got = sorted((tuple(r)[:4] for r in out.collect()), key=str)
    assert got == sorted(rows, key=str)
    by = {r.text_hash: r for r in out.collect()}
    assert by["own"].pseudo_log_likelihood == by["other"].pseudo_log_likelihood < 0 and by["long"].n_words == 70_000
    assert by[None].n_words == by["x"].n_words == 0 and by["x"].pseudo_log_likelihood == 0 and by["x"].mean_log_probability is None
    none = docs.limit(0)
    assert lm.scored(none, "text", lm.fit(none)).count() == 0


def test_lm_gradient():
    draw = np.random.default_rng(1)
    flat = lm.start(np.ones(lm.IDS)).astype(np.float32)
    context, target = draw.integers(0, lm.IDS, (64, 4)), draw.integers(0, 50, 64)
    before = lm.log_probabilities(lm.unpacked(flat), context, target).sum()
    for _ in range(20):
        lm.train_step(lm.unpacked(flat), context, target, 0.5)
    assert lm.log_probabilities(lm.unpacked(flat), context, target).sum() > before


def test_lm_frequent_words_need_no_join(spark):
    docs = spark.createDataFrame([(k, f"one two rare{k} Two") for k in range(50)] + [(None, None), (51, ""), (52, "never")], "doc_id long, text string").repartition(3)
    model = lm.fit(docs, rounds=0)
    few = lm.Vocabulary(model.vocabulary.lookup.known[:1])  # all but one word share ids
    few.totals, few.counts = lm.shared_totals(model.vocabulary.counts, few), model.vocabulary.counts
    asked = docs.union(spark.createDataFrame([(60, "unknown one")], docs.schema))
    by_join = {r.doc_id: r for r in lm.scored(asked, "text", lm.WindowModel(few, model.flat)).collect()}
    assert lm.share_sums(asked, "text", few).count() == 52  # a row for each text with words
    few.remember(model.vocabulary.frequent.known, model.vocabulary.frequent_counts)
    assert len(few.frequent.known) == 53 and few.frequent_counts.sum() == 201
    assert lm.share_sums(asked, "text", few).count() == 1
    rows = {r.doc_id: r for r in lm.scored(asked, "text", lm.WindowModel(few, model.flat)).collect()}
    assert len(rows) == 54 and all(abs(rows[k].pseudo_log_likelihood - r.pseudo_log_likelihood) < 1e-4 and rows[k].n_words == r.n_words for k, r in by_join.items())


def test_lm_step_is_the_plain_gradient():
    draw = np.random.default_rng(3)
    flat = lm.start(draw.integers(0, 9, lm.IDS).astype(float))
    flat += draw.normal(0, 0.2, lm.SIZE).astype(np.float32)
    for n, scale in ((1, 1), (200, 1), (130, 60)):  # less than a block, whole blocks and a rest, and scores that need a shift
        w = lm.unpacked((flat * scale).astype(np.float32))
        context, target = draw.integers(0, lm.IDS + 1, (n, 4)), draw.integers(0, lm.IDS, n)
        v = {k: x.astype(float) for k, x in w.items()}
        group, member = np.divmod(target, lm.MEMBERS)
        x = v["embedding"][context].reshape(n, -1)
        hidden = np.tanh(x @ v["inner"] + v["inner_bias"])
        logs = []
        gradient = {k: np.zeros_like(u) for k, u in v.items()}
        back = np.zeros_like(hidden)
        for z, at, name, bias in ((hidden @ v["classes"] + v["class_bias"], group, "classes", "class_bias"), (np.einsum("nh,nhm->nm", hidden, v["members"][group]) + v["member_bias"][group], member, "members", "member_bias")):
            z -= z.max(1, keepdims=True)
            logs.append(z[np.arange(n), at] - np.log(np.exp(z).sum(1)))
            d = np.exp(z) / np.exp(z).sum(1, keepdims=True)
            d[np.arange(n), at] -= 1
            if name == "classes":
                gradient[name], gradient[bias] = hidden.T @ d, d.sum(0)
                back += d @ v[name].T
            else:
                np.add.at(gradient[name], group, hidden[:, :, None] * d[:, None, :])
                np.add.at(gradient[bias], group, d)
                back += np.einsum("nm,nhm->nh", d, v[name][group])
        assert np.allclose(lm.log_probabilities(w, context, target), sum(logs), atol=1e-3 * scale)
        back *= 1 - hidden**2
        gradient["inner"], gradient["inner_bias"] = x.T @ back, back.sum(0)
        np.add.at(gradient["embedding"], context, (back @ v["inner"].T).reshape(n, 4, -1))
        squares = lm.unpacked(lm.first_squares())
        lm.train_step(w, context, target, 0.5, squares)
        if scale == 1:
            for k, g in gradient.items():
                assert np.allclose(squares[k], 1 + g * g, rtol=1e-3, atol=1e-4) and np.allclose(w[k], v[k] - 0.5 * g / np.sqrt(1 + g * g), atol=1e-4), k


def test_labelled_rows_are_bounded_and_not_held_out(corpus):
    docs, labels = corpus
    rows, totals = labelled(docs, labels, "toxic", per_class=10)
    assert rows.groupBy("label").count().filter("count > 10").count() == 0
    assert totals[0] + totals[1] == labels.filter(~is_held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).count()


def test_helpers(spark):
    def two(batches):
        for _ in batches:
            yield vector_parts(np.arange(100.0))

    assert np.allclose(summed(spark.range(4).repartition(2).mapInArrow(two, "part long, body binary"), 100), np.arange(100.0) * 2)
    x = np.random.default_rng(0).normal(size=(500, 1))
    w = fit_logistic(x, (x[:, 0] > 0.3).astype(float), np.ones(500))
    assert w[0] > 0 and abs(-w[1] / w[0] - 0.3) < 0.1


def test_word_kernel():
    import pyarrow as pa

    texts = ["Ähre ähre x", None, "", "a—b «c»", "one\ttwo"]
    data, offsets = utf8(pa.array(texts))
    found = words(data, offsets, prefixes=(2,))
    assert np.diff(found.bounds(5)).tolist() == [3, 0, 0, 3, 2]
    assert found.hash[0] == found.hash[1] and found.prefix[0][0] != found.hash[0]
    assert [texts[r].encode()[s : s + n].decode() for r, s, n in zip(found.row, found.start, found.length, strict=True)][:3] == ["Ähre", "ähre", "x"]
    assert isinstance(found, Words)
    row, h = distinct_pairs(*shingles(found, 2))
    assert np.bincount(row, minlength=5).tolist() == [2, 0, 0, 2, 1] and len(h) == 5
    long = "word " * 400_000
    data, offsets = utf8(pa.array([long]))
    assert len(words(data, offsets).hash) == 400_000
