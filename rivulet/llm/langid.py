"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are the runs of 3 and 4 bytes of a text in lower case in which every
run of other bytes than letters is one space, so they also mark where words
begin and end. Embeddings and softmax are trained by stochastic gradient
descent in numpy; for scoring, their product gives each subword one number a
language, and a text's logits are the means over all its subwords. A
temperature, fitted on rows kept out of training, calibrates the probability;
below the level that all but a given share of these rows reach, the operator
rejects. A text that is null or has no letter is ``und`` with score 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, is_held_out, small_batches
from .text import NON_WORD, U64, cuts, lowered, row_groups, separators, utf8

BUCKETS, WIDTH = 1 << 16, 16
NOT_LETTER = NON_WORD.copy()
NOT_LETTER[ord("0") : ord("9") + 1] = True
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every subword of the texts."""
    n, rows = len(data), len(offsets) - 1
    low = lowered(data, True)
    gap = separators(data, NOT_LETTER)
    low[gap] = 0x20
    keep = np.ones(n, bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    starts = offsets[:-1][np.diff(offsets) > 0]
    keep[starts] = ~gap[starts]
    row = np.repeat(np.arange(rows), np.diff(offsets))[keep]
    size = np.bincount(row, minlength=rows)
    out = np.full(len(row) + 2 * rows + 8, 0x20, np.uint8)  # a space before and after each text
    out[np.arange(len(row)) + 2 * row + 1] = low[keep]
    owner = np.repeat(np.arange(rows), size + 2)
    four = np.ndarray(len(owner), "<u4", out, strides=(1,)).astype(U64)
    found = []
    for k in (3, 4):
        inside = np.flatnonzero(owner[: len(owner) - k + 1] == owner[k - 1 :]) if len(owner) >= k else np.empty(0, np.int64)
        code = four[inside] & U64((1 << 8 * k) - 1)
        h = (code + U64(k << 40)) * U64(0x9E3779B97F4A7C15)
        found.append((owner[inside], (h >> U64(48)).astype(np.int64)))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) in slices; a long text comes in several."""
    for low, high in row_groups(offsets):
        piece, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        if high > low + 1:
            yield low, piece, at
        else:
            for a, b in cuts(piece, NOT_LETTER):
                yield low, piece[a:b], np.array([0, b - a])


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(ASCII_LETTER[data]))
    out = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


class LanguageModel:
    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, reject: float = 0.0):
        self.languages, self.table, self.bias, self.temperature, self.reject = languages, table, bias, temperature, reject

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        total, count = np.zeros((rows, len(self.languages))), np.zeros(rows)
        for first, piece, at in slices(data, offsets):
            row, bucket = subwords(piece, at)
            part = np.bincount(row, minlength=len(at) - 1)
            count[first : first + len(at) - 1] += part
            for k in range(len(self.languages)):
                total[first : first + len(at) - 1, k] += np.bincount(row, self.table[bucket, k], len(at) - 1)
        return softmax((total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(lists: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, languages: list[str], epochs: int = 6, rate: float = 0.5, seed: int = 7, tolerated: float = 0.01) -> LanguageModel:
    """lists: for each text, its different subword buckets, with counts."""
    draw = np.random.default_rng(seed)
    embedding = draw.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    shares = [(c / c.sum()).astype(np.float32) for c in counts]
    order = draw.permutation(len(lists))
    kept, order = order[: len(order) // 10], order[len(order) // 10 :]
    steps, done = max(1, epochs * -(-len(order) // 32)), 0
    for _ in range(epochs):
        draw.shuffle(order)
        for begin in range(0, len(order), 32):
            rows = order[begin : begin + 32]
            chosen, weight = [], []
            for i in rows:
                if draw.random() < 0.5:
                    chosen.append(lists[i])
                    weight.append(shares[i])
                else:  # as a short text of these subwords
                    n = int(draw.integers(8, 65))
                    at = np.searchsorted(np.cumsum(shares[i]), draw.random(n) * 0.999999)
                    chosen.append(lists[i][np.minimum(at, len(lists[i]) - 1)])
                    weight.append(np.full(n, 1 / n, np.float32))
            size = np.array([len(c) for c in chosen])
            flat, owner, weight = np.concatenate(chosen), np.repeat(np.arange(len(rows)), size), np.concatenate(weight)
            hidden = np.add.reduceat(embedding[flat] * weight[:, None], np.cumsum(size) - size)
            p = softmax(hidden @ out + bias)
            p[np.arange(len(rows)), labels[rows]] -= 1
            step = rate * (1 - done / steps) + 0.01
            back = p @ out.T
            out -= step * (hidden.T @ p) / len(rows) * 4
            bias -= step * p.mean(0)
            np.add.at(embedding, flat, (-step * 4 * weight[:, None] * back[owner]).astype(np.float32))
            done += 1
    table = embedding @ out
    model = LanguageModel(languages, table.astype(np.float64), bias.astype(np.float64))
    if len(kept):
        z = np.array([shares[i] @ table[lists[i]] for i in kept]) + bias
        own = labels[kept]
        loss = [(-np.log(softmax(z / t)[np.arange(len(own)), own] + 1e-12).mean(), t) for t in np.geomspace(0.05, 5, 40)]
        model.temperature = float(min(loss)[1])
        right = softmax(z / model.temperature)
        right = right.max(1)[right.argmax(1) == own]
        model.reject = float(np.quantile(right, tolerated)) if len(right) else 0.0
    return model


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id", per_language: int = 1500) -> LanguageModel:
    """Learns from about per_language rows of each language that aren't held out, chosen by a hash of the id; of each, every subword of the whole text."""
    small_batches(docs.sparkSession)
    known = docs.filter(F.col(lang).isNotNull() & F.col(id_column).isNotNull() & ~is_held_out(F.col(id_column)))
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    share: Column = F.lit(0.0)
    for name in languages:
        share = F.when(F.col(lang) == name, min(1.0, per_language / counts[name])).otherwise(share)
    chosen = known.filter(F.pmod(F.xxhash64(id_column), F.lit(1_000_003)) < share * 1_000_003)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            parts: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            for first, piece, at in slices(data, offsets):
                row, bucket = subwords(piece, at)
                order = np.argsort(row, kind="stable")
                bounds = np.searchsorted(row[order], np.arange(len(at)))
                for k in range(len(at) - 1):
                    parts[first + k].append(bucket[order[bounds[k] : bounds[k + 1]]].astype(np.uint16))
            found = [np.unique(np.concatenate([np.empty(0, np.uint16), *own]), return_counts=True) for own in parts]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([f[k].astype(t).tobytes() for f in found], pa.binary()) for k, t in enumerate((np.uint16, np.uint32)))], names=["lang", "subwords", "counts"])

    rows = chosen.select(F.coalesce(text, F.lit("")).alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(work, "lang string, subwords binary, counts binary").collect()
    rows = sorted((r.lang, bytes(r.subwords), bytes(r.counts)) for r in rows if len(r.subwords))
    index = {name: k for k, name in enumerate(languages)}
    return train([np.frombuffer(b, np.uint16) for _, b, _ in rows], [np.frombuffer(c, np.uint32) for _, _, c in rows], np.array([index[name] for name, _, _ in rows], np.int64), languages)


def identified(df: DataFrame, text: str, model: LanguageModel) -> DataFrame:
    """df with lang_pred, score (probability of that language) and rejected (too low to trust). Narrow."""
    small_batches(df.sparkSession)
    made = {"lang_pred": "string", "score": "double", "rejected": "boolean"}
    df = df.drop(*made)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            letters = has_letter(data, offsets)
            if own.languages:
                p = own.probabilities(data, offsets)
                best, score = p.argmax(1), np.where(letters, p.max(1), 0.0)
                name = [own.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
            else:
                name, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name), pa.array(score), pa.array((score < own.reject) | ~letters)], names=[*batch.schema.names, *made])

    return df.mapInArrow(work, extended(df, made))
