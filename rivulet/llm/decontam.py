"""Benchmark decontamination by latent semantic retrieval.

Terms are the words of the benchmark that aren't common in the corpus, weighted
by inverse frequency over all documents. Texts are cut into passages of two
blocks of ``BLOCK`` words, each overlapping the next by one block. The matrix
A of their TF-IDF rows (the benchmark's own rows weigh more) is never stored:
the range of A'A is found by a randomised pass (Y = A'(A G), summed over all
partitions, then orthogonalised), which gives the latent basis. A passage
whose latent vector has a cosine of ``cosine`` or more with a benchmark
passage's, and a share ``contained`` of that one's length, is a candidate. So is
a stretch with as many of an item's word pairs as are left when words are
replaced up to the allowed share: this doesn't depend on weights, so copies of
an item that make its terms common don't hide it. Candidates are checked by the
longest common subsequence of the item's words and those around them, and by
the answer: the item's rarest terms, of which a share has to be there.

Only the benchmark, in blocks of ``block_items``, and matrices of fixed width
are broadcast; texts are not shuffled. Null and empty texts are clean; null and
empty items match nothing; items of fewer than ``min_words`` words are found
where all their words follow each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, summed, vector_parts
from .text import MULTIPLIERS, U64, Lookup, mix, row_groups, utf8, words

BLOCK = 24


def common_subsequence(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence of two sequences of hashes, by bit-parallel rows."""
    places: dict[int, int] = {}
    for i, v in enumerate(x.tolist()):
        places[v] = places.get(v, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for v in y.tolist():
        m = places.get(v, 0)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(x) - row.bit_count()


def blocks(row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block of each word, row of each block, number of words of each row); blocks are BLOCK words of one row."""
    n = np.bincount(row, minlength=rows)
    per = -(-n // BLOCK)
    first = np.cumsum(per) - per
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return first[row] + place // BLOCK, np.repeat(np.arange(rows), per), n


def add_rows(total: np.ndarray, to: np.ndarray, of: np.ndarray, rows: np.ndarray) -> None:
    """total[to] += rows[of], where to repeats too, in order: first places first, then second ones, each in one go."""
    if not len(to):
        return
    order = np.argsort(to, kind="stable")
    to, of = to[order], of[order]
    first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    n = np.diff(np.append(first, len(to)))
    by_size = np.argsort(-n, kind="stable")
    first, n = first[by_size], n[by_size]
    for k, left in enumerate(np.searchsorted(-n, -np.arange(n[0]), "left")):
        at = first[:left] + k
        total[to[at]] += rows[of[at]]


def passages(block_rows: np.ndarray) -> np.ndarray:
    """Which blocks have another of their row after them."""
    return np.append(block_rows[1:] == block_rows[:-1], False) if len(block_rows) else np.empty(0, bool)


class Space:
    """Terms, their weights, and the latent basis (each row times its term's weight)."""

    def __init__(self, hashes: np.ndarray):
        self.lookup = Lookup(np.unique(hashes))
        self.weight = np.ones(len(self.lookup.known), np.float32)
        self.basis = np.zeros((len(self.lookup.known), 1), np.float32)

    def rows(self, found) -> tuple[np.ndarray, np.ndarray]:
        """(word number, term) of the words that are terms."""
        slot = self.lookup.find(found.hash)
        at = np.flatnonzero(slot >= 0)
        return at, slot[at]

    def weighted(self, onto: np.ndarray) -> np.ndarray:
        return onto * self.weight[:, None]

    def project(self, found, rows: int, onto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
        """Vectors and squared norms of all passages, the rows of their first blocks, and (block, term) of the words; onto: weighted()."""
        block, owner, _ = blocks(found.row, rows)
        at, term = self.rows(found)
        useful = self.weight[term] > 0
        at, term = at[useful], term[useful]
        own = block[at]
        vector, norm = np.zeros((len(owner), onto.shape[1]), np.float32), np.zeros(len(owner), np.float32)
        if len(own):
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            w = self.weight[term]
            add_rows(vector, own, term, onto)
            norm[own[first]] = np.add.reduceat(w * w, first)
        joined = passages(owner)
        follow = np.flatnonzero(joined)
        vector[follow] += vector[follow + 1]
        norm[follow] += norm[follow + 1]
        # (vector[k + 1] was read before it changed: numpy adds from a copy)
        return vector, norm, owner, (own, term)


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words that follow each other."""
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * MULTIPLIERS[27] + h[k : len(h) - n + 1 + k])
    return out


class Items:
    """Benchmark items of one block, as word hashes."""

    def __init__(self, ids: list, texts: list, min_words: int):
        data, offsets = utf8(pa.array(texts, pa.string()))
        found = words(data, offsets)
        bounds = found.bounds(len(ids))
        keep = [k for k in range(len(ids)) if bounds[k + 1] - bounds[k] >= min_words]
        self.ids = [ids[k] for k in keep]
        self.words = [found.hash[bounds[k] : bounds[k + 1]] for k in keep]
        self.short: dict[int, dict[int, list]] = {}  # number of words -> hash of all -> ids
        for k in range(len(ids)):
            n = int(bounds[k + 1] - bounds[k])
            if 0 < n < min_words:
                self.short.setdefault(n, {}).setdefault(int(runs(found.hash[bounds[k] : bounds[k + 1]], n)[0]), []).append(ids[k])
        pairs = [np.unique(runs(w, 2)) if len(w) > 1 else np.empty(0, U64) for w in self.words]
        self.n_pairs = np.array([len(x) for x in pairs], np.int64)
        flat = np.concatenate([np.empty(0, U64), *pairs])
        self.pairs = Lookup(np.unique(flat))
        slot, item = self.pairs.find(flat), np.repeat(np.arange(len(pairs)), self.n_pairs)
        order = np.argsort(slot, kind="stable")
        self.pair_items = item[order]
        self.pair_bounds = np.searchsorted(slot[order], np.arange(len(self.pairs.known) + 1))
        self.sizes = np.array([len(w) for w in self.words], np.int64)

    def exact(self, found) -> list[tuple[int, int]]:
        """(row, id) of short items whose words follow each other."""
        out: set[tuple[int, int]] = set()
        for n, known in self.short.items():
            if len(found.hash) >= n:
                h = runs(found.hash, n)
                at = np.flatnonzero(np.isin(h, np.array(list(known), U64)) & (found.row[: len(h)] == found.row[n - 1 :]))
                out |= {(int(found.row[k]), i) for k in at for i in known[int(h[k])]}
        return sorted(out)

    def stretches(self, found, overlap: float) -> list[tuple[int, int, int]]:
        """(row, item, first word) of stretches of twice an item's words that have the pairs left when a share 1 - overlap of its words are replaced."""
        if len(found.hash) < 2 or not len(self.pair_items):
            return []
        slot = self.pairs.find(runs(found.hash, 2))
        at = np.flatnonzero((slot >= 0) & (found.row[:-1] == found.row[1:]))
        slot = slot[at]
        many = np.diff(self.pair_bounds)[slot]
        step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        item = self.pair_items[np.repeat(self.pair_bounds[slot], many) + step]
        at, slot = np.repeat(at, many), np.repeat(slot, many)
        window = at // self.sizes[item] + 1
        count, wide, known = len(self.words), len(found.hash) + 2, len(self.pairs.known)
        place = (found.row[at] * count + item) * wide + window
        stretch = np.unique(np.concatenate([place * known + slot, (place - 1) * known + slot])) // known
        stretch, n = np.unique(stretch, return_counts=True)
        item = stretch // wide % count
        lost = self.sizes - np.ceil(overlap * self.sizes - 1e-9).astype(np.int64)
        ok = n >= np.maximum(1, self.n_pairs - 2 * lost)[item]
        row, item, window = stretch[ok] // (wide * count), item[ok], stretch[ok] % wide - 1
        return list(zip(row.tolist(), item.tolist(), (window * self.sizes[item]).tolist(), strict=True))

    def found(self):
        from .text import Words

        row = np.repeat(np.arange(len(self.words)), [len(w) for w in self.words])
        flat = np.concatenate([np.empty(0, U64), *self.words])
        return Words(row, flat, np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64), [])


def mapped(docs: DataFrame, text: str, each, schema: str, end=None, before: tuple[str, ...] = ()) -> DataFrame:
    """each(first columns, found words, rows) for slices of docs, and end() once a partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            data, offsets = utf8(batch.column(len(before)))
            for a, b in row_groups(offsets):
                out = each(state, [batch.column(k)[a:b] for k in range(len(before))], words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), b - a)
                if out is not None:
                    yield out
        if end is not None and state:
            yield end(state)

    return docs.select(*before, F.col(text).alias("text")).mapInArrow(work, schema)


def fitted(docs: DataFrame, text: str, items: Items, rank: int, common: float) -> Space:
    """The space of these items: term weights from all documents, and the basis from a randomised pass over all passages."""
    own = items.found()
    space = Space(own.hash)
    size = len(space.weight)

    def count(state, _, found, rows):
        at, term = space.rows(found)
        block, owner, _ = blocks(found.row, rows)
        pair = np.sort(block[at] * size + term)
        pair = pair[np.append(True, pair[1:] != pair[:-1])[: len(pair)]]
        state["n"] = state.get("n", 0) + np.append(np.bincount(pair % size, minlength=size), len(owner)).astype(float)

    total = summed(mapped(docs, text, count, "part long, body binary", lambda s: vector_parts(s["n"])), size + 1)
    share = total[:-1] / max(total[-1], 1)
    weight = np.log(1 / np.maximum(share, 1 / (total[-1] + 2)))
    # terms in many blocks say nothing, but each item keeps its rarest three
    chosen = share <= common
    term = space.lookup.find(own.hash)
    for k in range(len(items.words)):
        mine = np.unique(term[own.row == k])
        chosen[mine[np.argsort(share[mine], kind="stable")[:3]]] = True
    space.weight = np.where(chosen, np.maximum(weight, 0.1), 0).astype(np.float32)

    rank = min(rank, size)
    gaussian = space.weighted(np.random.default_rng(17).normal(size=(size, rank)).astype(np.float32))

    def add(total: np.ndarray, found, rows: int, scale: float) -> None:
        vector, norm, owner, (block, term) = space.project(found, rows, gaussian)
        if len(term):
            unit = vector * (scale / np.maximum(norm, 1e-6))[:, None]
            before = np.zeros_like(unit)  # a word is in the passage of its block and in that of the block before
            before[1:] = unit[:-1] * (owner[1:] == owner[:-1])[:, None]
            add_rows(total, term, block, unit + before)

    def sketch(state, _, found, rows):
        if "y" not in state:
            state["y"] = np.zeros((size, rank), np.float32)
        add(state["y"], found, rows, 1.0)

    # the weight of a term is a factor of its whole row, so it comes last
    y = summed(mapped(docs, text, sketch, "part long, body binary", lambda s: vector_parts(s["y"])), size * rank).reshape(size, rank)
    bench = np.zeros((size, rank), np.float32)
    add(bench, own, len(items.words), 1.0)
    y, bench = y * space.weight[:, None], bench * space.weight[:, None]
    y += bench * (100 * max(1.0, np.linalg.norm(y)) / max(np.linalg.norm(bench), 1e-9))
    space.basis = space.weighted(np.linalg.qr(y)[0].astype(np.float32))
    return space


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", cosine: float = 0.35, overlap: float = 0.7, answer: float = 0.5, min_words: int = 8, rank: int = 160, common: float = 0.005, contained: float = 0.35, block_items: int = 256) -> DataFrame:
    """(id, item_id, overlap, answer): the items that each document holds. Clean documents have no row; rows with a null id are searched too."""
    small_batches(docs.sparkSession)
    schema = "id long, item_id long, overlap double, answer double"
    out = docs.sparkSession.createDataFrame([], schema)
    numbered = benchmark.filter(F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text")).distinct()
    count = numbered.count()
    groups = max(1, -(-count // block_items))
    for g in range(groups):  # the benchmark is a query set, searched in blocks of bounded size
        part = numbered.filter(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == g).orderBy("item", "text").collect()
        items = Items([r.item for r in part], [r.text for r in part], min_words)
        if not items.words and items.short:
            out = out.union(searched_exactly(docs, id_column, text, items, schema))
        if items.words:
            out = out.union(searched(docs, id_column, text, items, fitted(docs, text, items, rank, common), cosine, contained, overlap, answer, schema))
    return out.groupBy("id", "item_id").agg(F.max("overlap").alias("overlap"), F.max("answer").alias("answer"))


def searched_exactly(docs: DataFrame, id_column: str, text: str, items: Items, schema: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def search(_, columns, found, rows):
        return hits(columns, [(r, i, 1.0, 1.0) for r, i in sent.value.exact(found)])

    return mapped(docs.withColumn("__id", F.col(id_column).cast("long")), text, search, schema, before=("__id",))


def hits(columns: list, rows: list[tuple]) -> pa.RecordBatch | None:
    """A batch of (row, item id, overlap, answer)."""
    if not rows:
        return None
    row, item, share, there = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([columns[0].take(pa.array(row)), pa.array(item, pa.int64()), pa.array(share, pa.float64()), pa.array(there, pa.float64())], names=["id", "item_id", "overlap", "answer"])


def searched(docs: DataFrame, id_column: str, text: str, items: Items, space: Space, cosine: float, contained: float, overlap: float, answer: float, schema: str) -> DataFrame:
    own = items.found()
    query, _, item_of, _ = space.project(own, len(items.words), space.basis)
    length = np.linalg.norm(query, axis=1)
    some = length > 1e-6
    query, item_of, length = query[some] / length[some][:, None], item_of[some], length[some].astype(np.float32)
    term = space.lookup.find(own.hash)
    rare = []
    for k in range(len(items.words)):
        mine = np.unique(term[own.row == k])
        mine = mine[np.argsort(-space.weight[mine], kind="stable")]
        rare.append(space.lookup.known[mine[: max(3, len(mine) // 2)]])
    slots = [space.lookup.find(r) for r in rare]
    sent = docs.sparkSession.sparkContext.broadcast((space, query.astype(np.float32), length, item_of, items, rare, slots))

    def search(_, columns, found, rows):
        space, query, length, item_of, items, rare, slots = sent.value
        vector, norm, owner, _ = space.project(found, rows, space.basis)
        word, known = space.rows(found)
        holds = np.zeros((rows, len(space.weight)), bool)  # which terms a row has anywhere
        holds[found.row[word], known] = True
        size = np.linalg.norm(vector, axis=1)
        at = np.flatnonzero(size > contained * length.min(initial=np.inf))
        out: dict[tuple[int, int], tuple[float, float]] = {}
        bounds = found.bounds(rows)
        first_block = np.searchsorted(owner, np.arange(rows))

        def verify(row: int, item: int, begin: int, end: int) -> None:
            goal = items.words[item]
            if out.get((row, item), (0, 0))[0] == 1:
                return
            window = found.hash[max(bounds[row], begin - len(goal)) : min(bounds[row + 1], end + len(goal))]
            there = float(np.isin(rare[item], window).mean())
            if there < answer:
                return
            share = common_subsequence(goal, window) / len(goal)
            if share >= overlap and (share, there) > out.get((row, item), (0, 0)):
                out[row, item] = (share, there)

        for k in range(0, len(at), 4096):
            some = at[k : k + 4096]
            product = vector[some] @ query.T
            near = (product >= cosine * size[some][:, None]) & (product >= contained * length)
            p, q = np.nonzero(near)
            # a row without the answer anywhere has it in no window
            pair, place = np.unique(owner[some[p]] * len(slots) + item_of[q], return_inverse=True)
            able = np.fromiter((holds[x // len(slots), slots[x % len(slots)]].mean() >= answer for x in pair.tolist()), bool, len(pair))[place]
            for block, item in zip(some[p[able]].tolist(), item_of[q[able]].tolist(), strict=True):
                row = int(owner[block])
                begin = bounds[row] + (block - first_block[row]) * BLOCK
                verify(row, item, begin, begin + 2 * BLOCK)
        for row, item, begin in items.stretches(found, overlap):
            verify(row, item, begin, begin + 2 * len(items.words[item]))
        return hits(columns, [(r, items.ids[i], share, there) for (r, i), (share, there) in out.items()] + [(r, i, 1.0, 1.0) for r, i in items.exact(found)])

    return mapped(docs.withColumn("__id", F.col(id_column).cast("long")), text, search, schema, before=("__id",))
