"""Masked pseudo-likelihood of documents under a bidirectional window network.

Each word is predicted from the two words before and the two after it (a
padding id beyond the ends of its text): their embeddings go through a tanh
layer to a softmax in two steps, class of word and word in its class. The
commonest words of the corpus have ids of their own, others share ids by hash;
to these the log of the word's share of all words with its id is added, from
the counts of all words: of words that make a FREQUENT-th of all or more (so at
most FREQUENT different ones) from a table that tasks hold, of others by a join.
A word that no document had counts as one.
Word counts come from all documents. Training masks each word of every document
once a round, in ``every`` turns by residues of position and hash: each task
trains its copy of the network in numpy, by steps that shrink with the sum of
squared gradients of a weight, and copies are averaged by their numbers of words,
for a given number of rounds. A copy that sees few words learns little, so a table
of fewer than SHARD_WORDS words a partition is trained in fewer tasks. A document's
score is the sum of the log-probabilities of all its words, each masked in turn.

Null and empty texts have no word, a sum of 0 and a null mean. Equal texts have
equal scores, whatever their ids; ids aren't read, so null and repeated ones are
rows like others. A very long text is scored in slices of words. No documents
give a model of even shares. Columns named like the results are replaced, all
others stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, free_name, small_batches, stored, summed, vector_parts
from .text import MULTIPLIERS, U64, Lookup, mix, row_groups, utf8, words

CLASSES, MEMBERS, SHARED = 64, 64, 1024
IDS = CLASSES * MEMBERS
PAD = IDS
WINDOW, WIDTH, HIDDEN = 2, 16, 32
SHARD_WORDS = 2_000_000
FREQUENT = 1 << 20
BLOCK = 64
SHAPES = {"embedding": (IDS + 1, WIDTH), "inner": (2 * WINDOW * WIDTH, HIDDEN), "inner_bias": (HIDDEN,), "classes": (HIDDEN, CLASSES), "class_bias": (CLASSES,), "members": (CLASSES, HIDDEN, MEMBERS), "member_bias": (CLASSES, MEMBERS)}
PAIRS = np.arange((IDS + 1) * WIDTH // 2).reshape(IDS + 1, -1)  # places of an embedding's pairs of numbers
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def start(counts: np.ndarray, seed: int = 13) -> np.ndarray:
    """First weights: small random numbers, and biases that give each id its share of the corpus."""
    draw = np.random.default_rng(seed)
    flat = (draw.normal(0, 0.1, SIZE)).astype(np.float32)
    w = unpacked(flat)
    share = (counts + 0.5).reshape(CLASSES, MEMBERS)
    w["inner_bias"][:] = 0
    w["class_bias"][:] = np.log(share.sum(1) / share.sum())
    w["member_bias"][:] = np.log(share / share.sum(1, keepdims=True))
    w["members"] *= 0.3
    return flat


class Vocabulary:
    def __init__(self, hashes: np.ndarray):
        """hashes: of the commonest words, at most IDS - SHARED. Ids are dealt over classes by a hash."""
        self.lookup = Lookup(hashes[: IDS - SHARED])
        self.totals = np.zeros(SHARED)  # words with each shared id
        self.counts: DataFrame | None = None  # (word, n) of all words; without it no shares are added
        self.remember(np.empty(0, U64), np.empty(0))

    def remember(self, hashes: np.ndarray, n: np.ndarray) -> None:
        """Words whose shares need no join, and their counts."""
        self.frequent = Lookup(hashes)
        self.frequent_counts = n[np.argsort(hashes)]

    def __getstate__(self):
        return self.__dict__ | {"counts": None}

    def ids(self, h: np.ndarray) -> np.ndarray:
        slot = self.lookup.find(h)
        return np.where(slot >= 0, slot, IDS - SHARED + (mix(h * MULTIPLIERS[25]) % U64(SHARED)).astype(np.int64))


def padded(ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids with WINDOW padding ids around each row's, and their places there."""
    row_number = np.cumsum(np.append(0, row[1:] != row[:-1]))[: len(ids)]
    place = np.arange(len(ids)) + WINDOW * (row_number + 1)
    out = np.full(place[-1] + WINDOW + 1 if len(ids) else 0, PAD, np.int64)
    out[place] = ids
    return out, place


def around(spaced: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The ids around places of padded ids: len(place) x 2 WINDOW."""
    out = np.empty((len(place), 2 * WINDOW), np.int64)
    for k, shift in enumerate([s for s in range(-WINDOW, WINDOW + 1) if s]):
        out[:, k] = spaced.take(place + shift)
    return out


def contexts(ids: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ids around the words at: len(at) x 2 WINDOW."""
    spaced, place = padded(ids, row)
    return around(spaced, place[at])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b for a long and narrow a, by blocks of rows: BLAS multiplies small matrices in place and copies larger ones first."""
    out = np.empty((len(a), b.shape[1]), a.dtype)
    whole = len(a) - len(a) % BLOCK
    np.matmul(a[:whole].reshape(-1, BLOCK, a.shape[1]), b, out=out[:whole].reshape(-1, BLOCK, b.shape[1]))
    np.matmul(a[whole:], b, out=out[whole:])
    return out


def cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b, by blocks of rows."""
    whole = len(a) - len(a) % BLOCK
    parts = np.matmul(a[:whole].reshape(-1, BLOCK, a.shape[1]).transpose(0, 2, 1), b[:whole].reshape(-1, BLOCK, b.shape[1]))
    return parts.sum(0) + a[whole:].T @ b[whole:]


def shifted(z: np.ndarray) -> np.ndarray:
    """z so that its exponentials neither overflow nor vanish: less each row's largest, where any number is large."""
    if z.size and (z.min() < -80 or z.max() > 80):
        z -= z.max(1, keepdims=True)
    return z


def chosen_logs(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each row's log-softmax the number at; z is overwritten."""
    shifted(z)
    out = z.ravel().take(np.arange(0, z.size, z.shape[1]) + at)
    np.exp(z, out=z)
    return out - np.log(z @ np.ones(z.shape[1], z.dtype))


def softmax(z: np.ndarray) -> np.ndarray:
    np.exp(shifted(z), out=z)
    z *= (1 / (z @ np.ones(z.shape[1], z.dtype)))[:, None]
    return z


def by_class(context: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Order of the words by class; in it their contexts, classes and members, and (class, first, end) of each class."""
    group, member = np.divmod(target, MEMBERS)
    group = group.astype(np.uint8)  # small numbers are sorted by their digits
    order = np.argsort(group, kind="stable")
    group = group.take(order)
    bounds = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
    spans = [(c, a, b) for c, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]
    return order, context.take(order, axis=0), group, member.take(order), spans


def layers(w: dict[str, np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings of the contexts, and the hidden layer."""
    x = w["embedding"].take(context.ravel(), axis=0).reshape(len(context), -1)
    hidden = product(x, w["inner"])
    hidden += w["inner_bias"]
    return x, np.tanh(hidden, out=hidden)


def class_scores(w: dict[str, np.ndarray], hidden: np.ndarray) -> np.ndarray:
    z = product(hidden, w["classes"])
    z += w["class_bias"]
    return z


def member_scores(w: dict[str, np.ndarray], hidden: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    z = np.empty((len(hidden), MEMBERS), np.float32)
    for c, a, b in spans:
        np.dot(hidden[a:b], w["members"][c], out=z[a:b])
        z[a:b] += w["member_bias"][c]
    return z


def log_probabilities(w: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray) -> np.ndarray:
    order, context, group, member, spans = by_class(context, target)
    _, hidden = layers(w, context)
    out = np.empty(len(target), np.float32)
    out[order] = chosen_logs(class_scores(w, hidden), group) + chosen_logs(member_scores(w, hidden, spans), member)
    return out


def first_squares() -> np.ndarray:
    return np.ones(SIZE, np.float32)


def train_step(w: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray, rate: float, squares: dict[str, np.ndarray] | None = None) -> None:
    """One step on a batch, down its summed gradient; a weight's step is divided by the root of its squared gradients so far (squares, which grow)."""
    squares = unpacked(first_squares()) if squares is None else squares

    def move(name: str, gradient: np.ndarray) -> None:
        total = squares[name]
        total += gradient * gradient
        gradient *= rate
        gradient /= np.sqrt(total)
        w[name] -= gradient

    n = len(target)
    one = np.ones(n, np.float32)
    first = np.arange(n)
    _, context, group, member, spans = by_class(context, target)
    x, hidden = layers(w, context)
    d = softmax(class_scores(w, hidden))
    d.ravel()[first * CLASSES + group] -= 1
    e = softmax(member_scores(w, hidden, spans))
    e.ravel()[first * MEMBERS + member] -= 1
    back = np.empty_like(hidden)
    members, member_bias = np.zeros_like(w["members"]), np.zeros_like(w["member_bias"])
    turned = np.ascontiguousarray(w["members"].transpose(0, 2, 1))
    for c, a, b in spans:
        np.dot(e[a:b], turned[c], out=back[a:b])
        np.dot(hidden[a:b].T, e[a:b], out=members[c])
        np.dot(one[a:b], e[a:b], out=member_bias[c])
    back += product(d, np.ascontiguousarray(w["classes"].T))
    move("members", members)
    move("member_bias", member_bias)
    move("classes", cross(hidden, d))
    move("class_bias", one @ d)
    hidden *= hidden
    back *= np.subtract(1, hidden, out=hidden)
    into = product(back, np.ascontiguousarray(w["inner"].T))
    move("inner", cross(x, back))
    move("inner_bias", one @ back)
    # two numbers are added at once, as one complex number
    pairs = np.zeros((IDS + 1) * WIDTH // 2, np.complex64)
    np.add.at(pairs, PAIRS.take(context.ravel(), axis=0).ravel(), into.ravel().view(np.complex64))
    move("embedding", pairs.view(np.float32).reshape(IDS + 1, WIDTH))


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) of all documents, words as hashes; counted in each batch before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            parts = [np.empty(0, U64), *(words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).hash for a, b in row_groups(offsets))]
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def shared_totals(counted: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """The number of words with each shared id."""
    sent = counted.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SHARED)
        for batch in batches:
            ids = sent.value.ids(batch.column(0).to_numpy().view(U64)) - (IDS - SHARED)
            total += np.bincount(ids[ids >= 0], batch.column(1).to_numpy()[ids >= 0], SHARED)
        yield vector_parts(total)

    return summed(counted.select("word", "n").mapInArrow(work, "part long, body binary"), SHARED)


def share_sums(df: DataFrame, text: str, vocabulary: Vocabulary) -> DataFrame:
    """(key, share): for each text's hash, the sum of the logs of its words' shares of their ids, frequent words left out."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            key = batch.column(1).to_numpy()
            for a, b in row_groups(offsets):
                found = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                at = np.flatnonzero(sent.value.ids(found.hash) >= IDS - SHARED)
                at = at[sent.value.frequent.find(found.hash[at]) < 0]
                order = at[np.lexsort((found.hash[at], found.row[at]))]
                row, h = found.row[order], found.hash[order]
                first = np.append(True, row[1:] != row[:-1])[: len(row)]
                new = np.flatnonzero(first | np.append(True, h[1:] != h[:-1])[: len(row)])
                n = np.diff(np.append(new, len(row)))
                # equal texts give equal rows: the number of their first words tells how many there are
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(key[a:b][row[new]]), pa.array(n * 2 + first[new])], names=["word", "key", "n2"])

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            n2 = batch.column(3).to_numpy()
            total = sent.value.totals[sent.value.ids(word.view(U64)) - (IDS - SHARED)]
            log = np.where(n > 0, np.log(np.maximum(n, 1) / np.maximum(total, 1)), -np.log(total + 1))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array((n2 >> 1) * log), pa.array(n2 & 1)], names=["key", "share", "texts"])

    used = df.select(F.col(text).alias("text"), F.xxhash64(text).alias("key")).mapInArrow(rest, "word long, key long, n2 long")
    joined = used.join(vocabulary.counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"), "key", "n2")
    return joined.mapInArrow(shares, "key long, share double, texts long").groupBy("key").agg((F.sum("share") / F.sum("texts")).alias("share"))


def dealt(h: np.ndarray, every: int) -> np.ndarray:
    """The places of all words, in order of their turns: one of every residues of position and hash."""
    turn = mix(h + np.arange(len(h), dtype=U64) * MULTIPLIERS[26]) % U64(every)
    return np.argsort(turn.astype(np.uint8) if every <= 256 else turn, kind="stable")


class WindowModel:
    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray):
        self.vocabulary, self.flat = vocabulary, flat.astype(np.float32)


def fit(docs: DataFrame, text: str = "text", rounds: int = 2, every: int = 8, rate: float = 0.2, batch: int = 4096) -> WindowModel:
    """Fits on all documents; nothing gathered on the driver depends on their number. Word counts stay in the shared folder, for scoring."""
    small_batches(docs.sparkSession)
    counted = stored(word_counts(docs, text), "word-counts")  # used by the ids, their totals and the shares
    n_words = counted.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, n_words // SHARD_WORDS)
    top = counted.orderBy(F.desc("n"), "word").limit(IDS - SHARED).collect()
    vocabulary = Vocabulary(np.array([r.word for r in top], np.int64).view(U64))
    counts = np.zeros(IDS)
    counts[vocabulary.ids(np.array([r.word for r in top], np.int64).view(U64))] = [r.n for r in top]
    vocabulary.totals = shared_totals(counted, vocabulary)
    vocabulary.counts = counted
    frequent = counted.filter(F.col("n") * FREQUENT >= n_words).collect()
    vocabulary.remember(np.array([r.word for r in frequent], np.int64).view(U64), np.array([r.n for r in frequent], np.float64))
    counts[IDS - SHARED :] = max(1.0, vocabulary.totals.sum() / SHARED)
    model = WindowModel(vocabulary, start(counts))
    for turn in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def work(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            flat = sent.value.flat.copy()
            w, n = unpacked(flat), 0
            squares = unpacked(first_squares())
            for part in batches:
                data, offsets = utf8(part.column(0))
                for a, b in row_groups(offsets):
                    found = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    ids = sent.value.vocabulary.ids(found.hash)
                    at = dealt(found.hash, every)
                    spaced, place = padded(ids, found.row)
                    for k in range(0, len(at), batch):
                        train_step(w, around(spaced, place[at[k : k + batch]]), ids[at[k : k + batch]], rate / (1 + turn), squares)
                    n += len(at)
            if n:
                yield vector_parts(np.append(flat.astype(np.float64), 1.0) * n)

        total = summed(docs.select(F.col(text).alias("text")).coalesce(tasks).mapInArrow(work, "part long, body binary"), SIZE + 1)
        if total[-1]:
            model = WindowModel(vocabulary, total[:-1] / total[-1])
    return model


def scored(df: DataFrame, text: str, model: WindowModel, keep_text: bool = True) -> DataFrame:
    """df with n_words, pseudo_log_likelihood (the sum) and mean_log_probability.

    Shuffles the words that share ids and aren't frequent, and each row to meet its text's shares: without keep_text the result has no
    text, and none is shuffled.
    """
    small_batches(df.sparkSession)
    made = {"n_words": "long", "pseudo_log_likelihood": "double", "mean_log_probability": "double"}
    df = df.drop(*made)
    sent = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if keep_text or c != text]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, vocabulary = unpacked(sent.value.flat), sent.value.vocabulary
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            count, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for a, b in row_groups(offsets):
                found = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids = vocabulary.ids(found.hash)
                spaced, place = padded(ids, found.row)
                for k in range(0, len(ids), 1 << 13):
                    at = slice(k, k + (1 << 13))
                    total[a:b] += np.bincount(found.row[at], log_probabilities(w, around(spaced, place[at]), ids[at]), b - a)
                rare = np.flatnonzero(ids >= IDS - SHARED)
                slot = vocabulary.frequent.find(found.hash[rare])
                rare, n = rare[slot >= 0], vocabulary.frequent_counts[slot[slot >= 0]]
                total[a:b] += np.bincount(found.row[rare], np.log(n / vocabulary.totals[ids[rare] - (IDS - SHARED)]), b - a)
                count[a:b] = np.bincount(found.row, minlength=b - a)
            mean = pa.array(total / np.maximum(count, 1), mask=count == 0)
            names = [c for c in batch.schema.names if keep_text or c != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(count), pa.array(total), mean], names=[*names, *made])

    if model.vocabulary.counts is None or not model.vocabulary.totals.any():
        return df.mapInArrow(work, extended(df.select(kept), made))
    key, share = free_name(df, "text_hash"), free_name(df, "text_share")
    shares = share_sums(df, text, model.vocabulary).toDF(key, share)
    # rows without text have no share to meet: any key does, but not one for all
    keyed = df.withColumn(key, F.when(F.length(text) > 0, F.xxhash64(text)).otherwise(F.monotonically_increasing_id()))
    out = keyed.mapInArrow(work, extended(keyed.select(*kept, key), made)).join(shares, key, "left")
    total = F.col("pseudo_log_likelihood") + F.when(F.col("n_words") > 0, F.coalesce(share, F.lit(0.0))).otherwise(F.lit(0.0))
    mean = F.when(F.col("n_words") > 0, total / F.col("n_words"))
    return out.select(*kept, "n_words", total.alias("pseudo_log_likelihood"), mean.alias("mean_log_probability"))
