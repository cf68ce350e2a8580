"""Quality classifier by positive-unlabelled learning.

Trusted positives are training rows of quality 1; unlabelled is every document
that isn't held out, whatever its label. The risk is the non-negative unbiased
one: prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]), with a linear g
and the squared loss. It then depends on the unlabelled texts only by the first
and second moments of their features, which one pass sums over all documents, and
its minimum is found exactly: while the second part isn't negative, by one
linear system; else its weight is lowered until it is zero. The class prior is estimated:
the least ratio of unlabelled to positive texts above any level of a g fitted to half of
the positives, with levels and shares from the other half and a histogram of g
over all unlabelled documents. Two numbers, slope and place of a logistic curve, are set
on the labelled training rows, so that scores are probabilities; a negative has no
other part.

Features are shares and shapes of a text (capitals, digits, kinds of signs,
repeated words, word lengths, line lengths) and hashed words. Null and empty
texts have all features zero but the size. A row's score depends on its text
only, so repeated rows have equal scores; a text is read whole. A column named
quality is replaced, other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, fit_logistic, is_held_out, labelled, small_batches, summed, vector_parts
from .text import SPACES, U64, row_groups, utf8, words

HASHED = 1 << 8
BINS = 4096
#: Sets of bytes whose share of a text is a feature.
SIGNS = [b"!", b"?", b"#", b"$%&", b"*", b"|", b"<>{}[]", b"@", b".", b",;:", b"'\"", b"()", b"-_+=/\\~^`", b"\n", b" \t"]


def _tables() -> np.ndarray:
    out = np.zeros((len(SIGNS) + 4, 256))
    for k, s in enumerate(SIGNS):
        out[k, list(s)] = 1
    out[-4, 65:91] = out[-3, 97:123] = out[-2, 48:58] = out[-1, 128:] = 1
    return out


TABLES = _tables()
STYLE = 2 * len(TABLES) + 8


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Style features (rows x STYLE), and hashed words as (row, bucket, weight), the weights of a text with a norm of 1."""
    rows, size = len(offsets) - 1, np.diff(offsets)
    style = np.zeros((rows, STYLE))
    kinds = np.zeros((rows, 256))
    for k in range(rows):
        kinds[k] = np.bincount(data[offsets[k] : offsets[k + 1]], minlength=256)
    share = kinds @ TABLES.T / np.maximum(size, 1)[:, None]
    style[:, : len(TABLES)] = share
    style[:, len(TABLES) : 2 * len(TABLES)] = np.log(share + 1e-3) * (size > 0)[:, None]
    found = words(data, offsets, SPACES, latin=False)
    n = np.bincount(found.row, minlength=rows)
    per = np.maximum(n, 1)
    again = np.zeros(len(found.row))
    if len(again) > 1:
        again[1:] = (found.row[1:] == found.row[:-1]) & (found.hash[1:] == found.hash[:-1])
    repeated = np.bincount(found.row, again, rows) / per
    mean = np.bincount(found.row, found.length, rows) / per
    spread = np.sqrt(np.maximum(0, np.bincount(found.row, found.length.astype(float) ** 2, rows) / per - mean**2))
    order = np.lexsort((found.hash, found.row))
    row, h = found.row[order], found.hash[order]
    new = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])) if len(row) else np.empty(0, bool)
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(row)))
    row, h = row[first], h[first]
    kinds_of_words = np.bincount(row, minlength=rows) / per
    most = np.zeros(rows)
    np.maximum.at(most, row, counts)
    style[:, 2 * len(TABLES) :] = np.column_stack([np.log1p(size), repeated, np.log(repeated + 1e-2) * (n > 0), mean, spread, kinds_of_words, most / per, np.log1p(n)])
    weight = np.log1p(counts)
    norm = np.sqrt(np.bincount(row, weight**2, rows))
    weight = np.where(h >> U64(63), weight, -weight)  # words that share a bucket don't add up
    return style, row, (h & U64(HASHED - 1)).astype(np.int64), weight / norm[row] if len(row) else weight


class Quality:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights
        self.prior, self.logistic = 0.5, np.array([0.0, 0.0])

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Standardised style features (at most 8 from the mean), hashed words, and a constant."""
        style, row, bucket, weight = features(data, offsets)
        words_of = np.bincount(row * HASHED + bucket, weight, len(style) * HASHED).reshape(len(style), HASHED)
        return np.hstack([np.clip((style - self.mean) / self.scale, -8, 8), words_of, np.ones((len(style), 1))])

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logistic[0] * raw + self.logistic[1], -30, 30)))


WIDTH = STYLE + HASHED + 1


def over_slices(texts: DataFrame, each, end) -> DataFrame:
    """(part, body) for common.summed: end(state) of each partition, where each(state, data, offsets) has seen its texts in slices."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for low, high in row_groups(offsets):
                each(state, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        if state:
            yield vector_parts(end(state))

    return texts.mapInArrow(work, "part long, body binary")


def moments(texts: DataFrame, model: Quality) -> tuple[np.ndarray, np.ndarray, float]:
    """Means of x x' and of x, and the number of texts."""

    def add(state: dict, data: np.ndarray, offsets: np.ndarray) -> None:
        x = model.rows(data, offsets)
        state["m"] = state.get("m", 0) + x.T @ x

    total = summed(over_slices(texts, add, lambda s: s["m"]), WIDTH * WIDTH).reshape(WIDTH, WIDTH)
    n = total[-1, -1]
    return total / max(n, 1), total[-1] / max(n, 1), n


def histogram(texts: DataFrame, model: Quality, low: float, high: float) -> np.ndarray:
    """How many texts have g in each of BINS equal ranges; the outer two take what lies beyond."""

    def add(state: dict, data: np.ndarray, offsets: np.ndarray) -> None:
        state["n"] = state.get("n", 0) + np.bincount(binned(model.rows(data, offsets) @ model.weights, low, high), minlength=BINS).astype(float)

    return summed(over_slices(texts, add, lambda s: s["n"]), BINS)


def binned(g: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.clip((g - low) / (high - low) * BINS, 0, BINS - 1).astype(np.int64)


def least_risk(p: tuple, u: tuple, prior: float, penalty: float = 1e-2) -> np.ndarray:
    """The weights of least non-negative risk. p, u: moments (means of x x' and of x) of positives and unlabelled. The loss is (1 - y g)**2."""
    ridge = penalty * np.eye(len(p[1]))
    ridge[-1, -1] = 1e-9
    negative = lambda w: w @ u[0] @ w + 2 * u[1] @ w + 1 - prior * (w @ p[0] @ w + 2 * p[1] @ w + 1)
    at = lambda t: np.linalg.solve((1 - t) * prior * p[0] + t * u[0] + ridge, prior * p[1] - t * (u[1] - prior * p[1]))
    w = at(1.0)
    if negative(w) >= 0:
        return w
    low, high = 0.0, 1.0  # the negative part's weight, at which it is just zero
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if negative(at(middle)) >= 0 else (low, middle)
    return at(low)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled: above no level can the unlabelled have less than the prior times the positives' share there. Numbers of texts in ranges of a score, of rows that it wasn't fitted to."""
    above = [np.cumsum(h[::-1])[::-1] / max(1, h.sum()) for h in (positive, unlabelled)]
    use = (above[0] > 0.1) & (above[0] < 0.8)
    return float(np.clip((above[1][use] / above[0][use]).min() if use.any() else 0.5, 0.02, 0.98))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id_column: str = "doc_id", per_class: int = 4000) -> Quality:
    """Learns from at most per_class labelled rows of each class (see labelled) and all documents that aren't held out. Without positives, every score is 0.5."""
    small_batches(docs.sparkSession)
    texts, totals = labelled(docs, labels, label, id_column, text, per_class)
    known = sorted(texts.filter("text is not null").collect(), key=lambda r: (r.label, r.text))  # at most 2 * per_class rows
    model = Quality(np.zeros(STYLE), np.ones(STYLE), np.zeros(WIDTH))
    raw = utf8(pa.array([r.text for r in known], pa.large_string()))
    y = np.array([r.label for r in known], np.int64)
    if not (y == 1).any():
        return model
    cut = lambda a, b: (raw[0][raw[1][a] : raw[1][b]], raw[1][a : b + 1] - raw[1][a])
    style = np.concatenate([features(*cut(a, b))[0] for a, b in row_groups(raw[1])])[y == 1]
    model.mean, model.scale = style.mean(0), np.where(style.std(0) < 1e-6, 1, style.std(0))
    x = np.concatenate([model.rows(*cut(a, b)) for a, b in row_groups(raw[1])])
    good = x[y == 1]
    moment = lambda rows: (rows.T @ rows / len(rows), rows.mean(0))

    free = docs.filter(~is_held_out(F.col(id_column))).select(F.col(text).alias("text"))
    second, first, n = moments(free, model)
    if not n:
        return model
    half = np.random.default_rng(1).random(len(good)) < 0.5
    if half.any() and not half.all():
        model.weights = least_risk(moment(good[half]), (second, first), 0.5)
        g = good[~half] @ model.weights
        low, high = float(g.min()) - 1e-6, float(g.max()) + 1e-6
        model.prior = estimated_prior(np.bincount(binned(g, low, high), minlength=BINS), histogram(free, model, low, high))
    model.weights = least_risk(moment(good), (second, first), model.prior)
    seen = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    g = x @ model.weights
    model.logistic = fit_logistic(g[:, None], y.astype(float), np.where(y == 1, totals[1] / seen[1], totals[0] / seen[0])) if (y == 0).any() else np.array([2.0, 0.0])
    return model


def scored(df: DataFrame, text: str, model: Quality) -> DataFrame:
    """df with quality (0 to 1). Narrow."""
    small_batches(df.sparkSession)
    df = df.drop("quality")
    sent = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            own = sent.value
            out = [own.probability(own.rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) @ own.weights) for a, b in row_groups(offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.empty(0), *out]))], names=[*batch.schema.names, "quality"])

    return df.mapInArrow(work, extended(df, {"quality": "double"}))
