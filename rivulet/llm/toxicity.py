"""Toxic passages by maximum-scoring segments.

Terms are words and their prefixes of 4 and 5 characters, in lower case. A
term's score is its log-odds in toxic against clean training texts under an
informative Dirichlet prior (in proportion to its share of all); only terms
whose log-odds are many standard deviations above zero count, and every other
word lowers the sum a little. A linear scan (Ruzzo and Tompa) finds all maximal
segments of a text. A segment's expected number by chance follows the
extreme-value law of such sums, K n exp(-lambda S): lambda is the positive root of
E[exp(lambda score)] = 1 over the scores of all words of clean training texts (Karlin and
Altschul), K comes from the segments found in these texts. The
evidence of a text's significant segments is calibrated to a probability.

Null and empty texts have no segment; their score is that of a text without any.
A score depends on the text only, which is read whole, so repeated rows have
equal scores. Columns named toxicity and toxic_spans are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, fit_logistic, labelled, small_batches, summed, vector_parts
from .text import MULTIPLIERS, U64, Lookup, Words, mix, row_groups, utf8, words

PREFIXES = (4, 5)
#: Ranges of word scores that are counted, from 0 up in steps.
STEP, STEPS = 0.02, 2000


def terms(found: Words) -> list[np.ndarray]:
    """Hashes of each word's terms: the word and its prefixes."""
    return [found.hash, *(mix(h ^ MULTIPLIERS[16 + k]) for k, h in enumerate(found.prefix))]


def maximal_segments(at: np.ndarray, score: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of words that score -drift but at the places at, where they score more. Linear in len(at)."""
    out: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    total, last = 0.0, -1
    for i, s in zip(at.tolist(), score.tolist(), strict=True):
        total -= drift * (i - last - 1)
        last = i
        first, low = i, total
        total += s
        high = total
        while True:
            k = len(out) - 1
            while k >= 0 and out[k][2] >= low:
                k -= 1
            if k < 0 or out[k][3] >= high:
                out.append((first, i, low, high))
                break
            first, low = out[k][0], out[k][2]
            del out[k:]
    return [(a, b, high - low) for a, b, low, high in out]


class Toxicity:
    """Term scores and calibration; a few thousand terms, so it can be broadcast."""

    def __init__(self, hashes: np.ndarray, scores: np.ndarray, drift: float):
        order = np.argsort(hashes)
        self.lookup, self.scores, self.drift = Lookup(hashes[order]), scores[order], drift
        self.rate, self.scale, self.logistic = 1.0, 1.0, np.array([1.0, -3.0])

    def word_scores(self, found: Words) -> np.ndarray:
        """Each word's score; 0 for those that lower the sum."""
        best = np.zeros(len(found.hash))
        for h in terms(found):
            slot = self.lookup.find(h)
            hit = slot >= 0
            best[hit] = np.maximum(best[hit], self.scores[slot[hit]])
        return best

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[list[tuple[int, int, float]]], np.ndarray, Words]:
        """Maximal segments in words of each text, the texts' numbers of words, and the words."""
        found = words(data, offsets, prefixes=PREFIXES)
        best = self.word_scores(found)
        bounds = found.bounds(len(offsets) - 1)
        at = np.flatnonzero(best > 0)
        out: list[list] = [[] for _ in range(len(offsets) - 1)]
        cuts = np.searchsorted(at, bounds)
        for row in np.flatnonzero(np.diff(cuts)):
            own = at[cuts[row] : cuts[row + 1]]
            out[row] = maximal_segments(own - bounds[row], best[own], self.drift)
        return out, np.diff(bounds), found

    def evidence(self, segments: list, n: int) -> float:
        """Minus the log of the expected number by chance, summed over significant segments."""
        return sum(max(0.0, self.rate * s - np.log(self.scale * max(n, 1))) for _, _, s in segments)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        z = self.logistic[0] * np.minimum(evidence, 100) / 10 + self.logistic[1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def chance_rate(scored: np.ndarray, others: float, drift: float) -> float:
    """The positive root of E[exp(rate * score)] = 1, where scored[k] words score about (k + 1/2) * STEP and others -drift."""
    at = np.flatnonzero(scored)
    value, share = np.append((at + 0.5) * STEP, -drift), np.append(scored[at], others) / (scored.sum() + others)
    if not len(at) or share @ value >= 0:  # no word scores, or sums don't fall by chance
        return 1.0 if not len(at) else 1e-6
    low, high = 1e-6, 50.0
    for _ in range(100):
        rate = (low + high) / 2
        low, high = (rate, high) if share @ np.exp(np.minimum(rate * value, 600)) < 1 else (low, rate)
    return low


def term_counts(texts: DataFrame) -> DataFrame:
    """(term, toxic, clean): numbers of texts that hold each term, for texts (text, label)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            label = batch.column(1).to_numpy()
            for low, high in row_groups(offsets):
                found = words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], prefixes=PREFIXES)
                h, row = np.concatenate(terms(found)), np.tile(found.row, 1 + len(PREFIXES))
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                h, y = h[new], label[low + row[new]]
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
                toxic, count = (np.add.reduceat(v, first) if len(h) else np.empty(0, np.int64) for v in (y.astype(np.int64), np.ones(len(h), np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(toxic), pa.array(count - toxic)], names=["term", "toxic", "clean"])

    return texts.mapInArrow(work, "term long, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", id_column: str = "doc_id", prior: float = 0.01, deviations: float = 3.5, most_terms: int = 20_000, drift: float = 0.05, per_class: int = 10_000) -> Toxicity:
    """Learns from at most per_class labelled rows of each class (see labelled). most_terms bounds the model, the most significant terms stay. Without both classes in the labels, nothing is toxic."""
    small_batches(docs.sparkSession)
    texts, totals = labelled(docs, labels, label, id_column, text, per_class)
    rows = {r.label: r["count"] for r in texts.groupBy("label").count().collect()}
    if not rows.get(0) or not rows.get(1):
        return Toxicity(np.empty(0, U64), np.empty(0), drift)
    n1, n0 = float(rows[1]), float(rows[0])
    y1, y0 = F.col("toxic"), F.col("clean")
    alpha = prior * (y1 + y0)
    a1, a0 = alpha * (n1 / (n1 + n0)), alpha * (n0 / (n1 + n0))
    odds = F.log((y1 + a1) / (n1 * (1 + prior) - y1 - a1 + 1)) - F.log((y0 + a0) / (n0 * (1 + prior) - y0 - a0 + 1))
    z = odds / F.sqrt(1 / (y1 + a1) + 1 / (y0 + a0))
    chosen = term_counts(texts).filter("toxic >= 3").select("term", odds.alias("odds"), z.alias("z")).filter(f"z > {deviations} and odds > 1").orderBy(F.desc("z"), "term").limit(most_terms).collect()
    model = Toxicity(np.array([r.term for r in chosen], np.int64).view(U64), np.array([r.odds for r in chosen]), drift)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STEPS + 2)  # words by score, words without one, segments
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for low, high in row_groups(offsets):
                segments, n, found = model.segments(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                best = model.word_scores(found)
                total[:STEPS] += np.bincount(np.minimum(best[best > 0] / STEP, STEPS - 1).astype(np.int64), minlength=STEPS)
                total[STEPS:] += [(best == 0).sum(), sum(map(len, segments))]
        yield vector_parts(total)

    total = summed(texts.filter("label = 0").select("text").mapInArrow(counted, "part long, body binary"), STEPS + 2)
    model.rate = chance_rate(total[:STEPS], total[STEPS] + 1, drift)
    floor = float(model.scores.min()) if len(chosen) else 1.0
    model.scale = (total[-1] + 0.5) / ((total[:-1].sum() + 1) * np.exp(-model.rate * floor))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for low, high in row_groups(offsets):
                segments, n, _ = model.segments(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                yield pa.RecordBatch.from_arrays([batch.column(1)[low:high], pa.array([float(model.evidence(own, k)) for own, k in zip(segments, n.tolist(), strict=True)], pa.float64())], names=["label", "evidence"])

    seen = texts.select("text", F.col("label").cast("long")).mapInArrow(measured, "label long, evidence double").collect()  # two numbers for each of at most 2 * per_class rows
    x = np.array([min(r.evidence, 100) / 10 for r in seen])
    y = np.array([float(r.label) for r in seen])
    weight = np.where(y == 1, totals[1] / n1, totals[0] / n0)
    model.logistic = fit_logistic(x[:, None], y, weight, 1e-4)
    return model


def scored(df: DataFrame, text: str, model: Toxicity) -> DataFrame:
    """df with toxicity (0 to 1) and toxic_spans: significant segments as byte ranges, each with its sum and its expected number by chance. Narrow."""
    small_batches(df.sparkSession)
    made = {"toxicity": "double", "toxic_spans": "array<struct<first: long, end: long, score: double, expected: double>>"}
    df = df.drop(*made)
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            evidence, spans = [], []
            for low, high in row_groups(offsets):
                segments, counts, found = own.segments(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                bounds = found.bounds(high - low)
                for row, (part, n) in enumerate(zip(segments, counts.tolist(), strict=True)):
                    evidence.append(own.evidence(part, n))
                    spans.append([])
                    for a, b, s in part:
                        expected = own.scale * n * np.exp(-own.rate * s)
                        if expected < 1:
                            end = bounds[row] + b
                            spans[-1].append({"first": int(found.start[bounds[row] + a]), "end": int(found.start[end] + found.length[end]), "score": s, "expected": float(expected)})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.probability(np.array(evidence, float))), pa.array(spans, kind)], names=[*batch.schema.names, *made])

    return df.mapInArrow(work, extended(df, made))
