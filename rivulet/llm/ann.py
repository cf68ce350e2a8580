"""Approximate nearest neighbours by learned partitions.

On a bounded sample: its neighbour graph is built by blocked brute force and
cut into balanced parts (parts grown from seeds, then moved by label
propagation under a size limit). A softmax classifier learns each vector's
part. It then places every vector of the table in its most probable part, and
routes each query to its most probable parts, as many as hold a given share of
probability, and as many more as it takes to find k rows. In a part, distances
are exact, in double precision.

Parts are salted, so that a part with very many vectors (copies of one, say) is
several groups; each group returns at most k rows a query, merged afterwards.
Vectors that are null, zero, of another length, or hold a null or non-finite
component take no part. A null id neither. Rows with one id are compared like
others; a row is never compared with its own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored


def usable(vector: Column) -> Column:
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row, by blocks."""
    out = np.empty((len(x), k), np.int64)
    norm = (x**2).sum(1)
    for a in range(0, len(x), 512):
        d = norm[None] - 2 * x[a : a + 512] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + len(d)] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 5, rounds: int = 12) -> np.ndarray:
    """A part for each node: parts of nearly equal size with few edges between them."""
    n, draw = len(graph), np.random.default_rng(seed)
    limit = int(np.ceil(n / parts * 1.05))
    part, size = np.full(n, -1), np.zeros(parts, np.int64)
    queue = [[int(s)] for s in draw.choice(n, parts, replace=False)]
    left = list(draw.permutation(n))
    while left:  # grow all parts in turn along edges; where none is left, from a free node
        for p in range(parts):
            while queue[p] and part[queue[p][0]] >= 0:
                queue[p].pop(0)
            if not queue[p]:
                while left and part[left[-1]] >= 0:
                    left.pop()
                if not left:
                    break
                queue[p].append(left[-1])
            if size[p] < limit:
                node = queue[p].pop(0)
                part[node], size[p] = p, size[p] + 1
                queue[p].extend(graph[node].tolist())
        while left and part[left[-1]] >= 0:
            left.pop()
    source, target = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (source, part[target]), 1)
        np.add.at(votes, (target, part[source]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        for node in np.argsort(-gain, kind="stable"):
            if gain[node] <= 0:
                break
            if size[best[node]] < limit:
                size[part[node]] -= 1
                size[best[node]] += 1
                part[node] = best[node]
    return part


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Router:
    """A network of one hidden layer that gives probabilities of parts."""

    def __init__(self, mean: np.ndarray, scale: float, layers: list[np.ndarray]):
        self.mean, self.scale, self.layers = mean, scale, layers

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return softmax(np.tanh((x - self.mean) / self.scale @ a + b) @ c + d)


def train_router(x: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, hidden: int = 64, epochs: int = 30, seed: int = 9) -> Router:
    """Learns, for each row, the parts of itself and its neighbours."""
    draw = np.random.default_rng(seed)
    mean = x.mean(0)
    scale = float((x - mean).std()) or 1.0
    z = (x - mean) / scale
    goal = np.zeros((len(x), parts))
    for column in np.column_stack([np.arange(len(x)), graph]).T:
        goal[np.arange(len(x)), part[column]] += 1
    goal /= goal.sum(1, keepdims=True)
    layers = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), draw.normal(0, 1 / np.sqrt(hidden), (hidden, parts)), np.zeros(parts)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in layers]
    turn = 0
    for _ in range(epochs):
        order = draw.permutation(len(x))
        for k in range(0, len(x), 128):
            rows = order[k : k + 128]
            h = np.tanh(z[rows] @ layers[0] + layers[1])
            d = (softmax(h @ layers[2] + layers[3]) - goal[rows]) / len(rows)
            back = d @ layers[2].T * (1 - h**2)
            turn += 1
            for w, g, (m, v) in zip(layers, [z[rows].T @ back, back.sum(0), h.T @ d, d.sum(0)], moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g**2 - v)
                w -= 0.003 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-9)
    return Router(mean, scale, layers)


def nearest(queries: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, distance) of each query's k nearest rows, ties to smaller ids, by blocks."""
    out: list[tuple] = []
    ids, x = rows
    for q, v in zip(*queries, strict=True):
        d = np.concatenate([np.empty(0), *(np.sqrt(((x[a : a + 4096] - v) ** 2).sum(1)) for a in range(0, len(x), 4096))])
        d = np.where(ids == q, np.inf, d)
        if len(d) > k:
            level = np.partition(d, k - 1)[k - 1]
            chosen = np.flatnonzero(d <= level)
        else:
            chosen = np.arange(len(d))
        chosen = chosen[d[chosen] < np.inf]
        chosen = chosen[np.lexsort((ids[chosen], d[chosen]))][:k]
        out.append((np.full(len(chosen), q), ids[chosen], d[chosen]))
    return tuple(np.concatenate([np.empty(0, t), *(o[j] for o in out)]) for j, t in enumerate((np.int64, np.int64, float)))


class Index:
    """Learns parts on about sample vectors, chosen by a hash of the id; search() places every vector.

    parts: by default the square root of the number of vectors, from 16 to as
    many as the sample has groups of 32.
    """

    def __init__(self, rows: DataFrame, id_column: str, vector: str, parts: int | None = None, sample: int = 4096, degree: int = 10, share: float = 0.97, group: int = 4096):
        spark = rows.sparkSession
        small_batches(spark, 4096)
        self.share, self.group = share, group
        clean = rows.filter(usable(F.col(vector)) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
        length = clean.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
        self.rows = clean.filter(F.size("vector") == (length.n if length else 0))
        self.count = length["count"] if length else 0
        parts = self.parts = parts or int(min(max(16, self.count**0.5 / 2), sample // 32))
        keep = min(1.0, sample / max(1, self.count))
        drawn = self.rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < keep * 1_000_003).orderBy("id").limit(sample * 2).collect()
        x = np.array([r.vector for r in drawn])
        if len(x) < 4 * parts:
            self.parts, self.router = 1, None
        else:
            graph = neighbour_graph(x, min(degree, len(x) - 1))
            self.router = train_router(x, graph, balanced_parts(graph, parts), parts)

    def placed(self, df: DataFrame, sizes: np.ndarray | None = None, k: int = 0) -> DataFrame:
        """(id, vector, part): the most probable part; with the parts' sizes, as many as hold the share of probability, and k rows besides the query's own."""
        sent = df.sparkSession.sparkContext.broadcast((self.router, self.share))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            router, share = sent.value
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                if router is None:
                    at, part = np.arange(n), np.zeros(n, np.int64)
                else:
                    p = router.probabilities(matrix(batch.column(1)))
                    if sizes is not None:
                        order = np.argsort(-p, axis=1, kind="stable")
                        before = np.cumsum(np.take_along_axis(p, order, 1), 1) - np.take_along_axis(p, order, 1)
                        rows = np.cumsum(sizes[order], 1) - sizes[order]
                        at, column = np.nonzero((before < share) | (rows < k + 1))
                        part = order[at, column]
                    else:
                        at, part = np.arange(n), p.argmax(1)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(part)], names=["id", "vector", "part"])

        return df.mapInArrow(work, "id long, vector array<double>, part long")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, id, score) for queries (id, vector), nearest first."""
        rows = stored(self.placed(self.rows), "index")
        counted = np.zeros(self.parts, np.int64)
        for r in rows.groupBy("part").agg(F.count_distinct("id").alias("n")).collect():  # a row a part
            counted[r.part] = r.n
        asked = self.placed(queries, counted, k)
        # salts that a part really has: one for each group's worth of vectors
        sizes = rows.groupBy("part").agg(F.ceil(F.count("*") / self.group).cast("long").alias("groups"))
        rows = rows.join(sizes, "part").withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), "groups")).drop("groups")
        asked = asked.join(sizes, "part").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")

        def work(left: pa.Table, right: pa.Table) -> pa.Table:
            q = (left.column("id").to_numpy(), matrix(left.column("vector").combine_chunks()))
            r = (right.column("id").to_numpy(), matrix(right.column("vector").combine_chunks()))
            a, b, c = nearest(q, r, k) if len(q[0]) and len(r[0]) else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            return pa.table({"query_id": a, "id": b, "score": c})

        columns = ["part", "salt", "id", "vector"]
        found = asked.select(*columns).groupBy("part", "salt").cogroup(rows.select(*columns).groupBy("part", "salt")).applyInArrow(work, "query_id long, id long, score double").distinct()
        place = Window.partitionBy("query_id").orderBy("score", "id")
        return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def scanned(index: Index, queries: DataFrame, k: int) -> float:
    """The share of all rows that a query is compared with, on average."""
    sizes = index.placed(index.rows).groupBy("part").agg(F.count("*").alias("n"))
    counted = np.zeros(index.parts, np.int64)
    for r in sizes.collect():
        counted[r.part] = r.n
    total = index.placed(queries, counted, k).join(sizes, "part").agg(F.sum("n")).first()[0] or 0
    return total / max(1, queries.count()) / max(1, index.count)


def recall(index: Index, queries: DataFrame, k: int) -> float:
    """The share of the true k nearest that search finds; queries are compared with all rows, by blocks."""
    found = {(r.query_id, r.id) for r in index.search(queries, k).collect()}
    asked = queries.collect()
    q = (np.array([r.id for r in asked]), np.array([r.vector for r in asked], float))
    sent = queries.sparkSession.sparkContext.broadcast(q)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, c = nearest(sent.value, (batch.column(0).to_numpy(), matrix(batch.column(1))), k)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], names=["query_id", "id", "score"])

    place = Window.partitionBy("query_id").orderBy("score", "id")
    exact = index.rows.mapInArrow(work, "query_id long, id long, score double").withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    true = {(r.query_id, r.id) for r in exact.collect()}
    return len(found & true) / max(1, len(true))
