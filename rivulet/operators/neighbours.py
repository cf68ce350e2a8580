"""Exact nearest rows without comparing all pairs.

Rows are put into blocks by their nearest pivot and their distance from it. A block
keeps the least and largest distance of its rows from every pivot. By the triangle
inequality, a row is no nearer to a block's rows than the largest of the gaps
between its own distance from a pivot and the block's range there; where that is
more than its k-th distance so far, the block is skipped.

Three rounds make the k-th distance small before the costly part: a row's own block,
the few blocks that most rows of its block find nearest, then all that are left and
can't be skipped. Pivots and blocks are few by construction (64, and about 5,000), so
what is broadcast has a fixed size; a block grows with the table instead, as a matrix
that is one value of one row. A block's copies are split by a salt.

In the last round blocks are dealt over 16 groups, and a task has what one group asks
of another. So a row is sent at most 16 times each way, however many blocks it asks:
what is shuffled grows with the table. Over 64 MB a group (2 million rows of 64
values) there are more groups, as a task holds two.

Squared distances are differences summed, so results don't depend on blocks. The last
round takes products in single precision first, and only pairs that could be near
enough by a bound on their rounding are measured. Rows without a key, or whose vector is null or holds a null or NaN, take no
part. A row is no neighbour of its own key; ties go to smaller keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

PIVOTS, BLOCKS, GRID, NEXT = 64, 4096, 1024, 3
GROUPS, HELD = 16, 1 << 26
FOUND = "id long, neighbour long, distance double"


def squared(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Squared distances of each of x from all rows, in slices of bounded size."""
    out = np.empty((len(x), len(rows)))
    step = max(1, (1 << 21) // max(1, rows.size))
    for a in range(0, len(x), step):
        out[a : a + step] = ((x[a : a + step, None] - rows[None]) ** 2).sum(-1)
    return out


def best(ids: np.ndarray, d: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, columns of its k nearest) for each row of distances."""
    d[own[:, None] == ids[None]] = np.inf
    for i, row in enumerate(d):
        near = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1]) if len(row) > k else np.arange(len(row))
        near = near[row[near] < np.inf]
        yield i, near[np.lexsort((ids[near], row[near]))][:k]


class Blocks:
    """What every task knows: pivots, where cells are cut, salts, and ranges of blocks."""

    def __init__(self, pivots: np.ndarray, edges: list[np.ndarray], salts: np.ndarray):
        self.pivots, self.edges, self.salts = pivots, edges, salts

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, ring, distances from the pivots) of rows."""
        d = np.sqrt(squared(x, self.pivots))
        cell = d.argmin(1)
        own = d[np.arange(len(x)), cell]
        return cell, np.array([np.searchsorted(self.edges[c], v, "right") if self.edges else 0 for c, v in zip(cell, own, strict=True)], np.int64), d


def lower_bounds(d: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How near rows with distances d from the pivots can be to blocks, at least."""
    out = np.zeros((len(d), len(low)))
    for p in range(d.shape[1]):
        np.maximum(out, d[:, p, None] - high[None, :, p], out=out)
        np.maximum(out, low[None, :, p] - d[:, p, None], out=out)
    return out


def reached(d: np.ndarray, far: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which blocks (columns) could have a row within far (squared) of rows with distances d from the pivots."""
    return lower_bounds(d, low, high) <= (np.sqrt(far) * (1 + 1e-9) + 1e-12)[:, None]


class Near:
    """The k nearest rows so far of some queries, each within its own limit."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, far: np.ndarray, k: int):
        self.x, self.ids, self.limit, self.k = x, ids, far.copy(), k
        self.d, self.near = np.full((len(x), k), np.inf), np.full((len(x), k), -1, np.int64)

    def take(self, query: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        """Measures pairs of a query (its number) and a row, and keeps the nearest."""
        for a in range(0, len(query), 1 << 15):
            q, i = query[a : a + (1 << 15)], ids[a : a + (1 << 15)]
            d = ((self.x[q] - x[a : a + (1 << 15)]) ** 2).sum(-1)
            keep = (d <= self.limit[q]) & (self.ids[q] != i)
            if not keep.any():
                continue
            rows = np.unique(q[keep])
            old = self.d[rows] < np.inf
            q = np.concatenate([q[keep], np.repeat(rows, old.sum(1))])
            d, i = np.concatenate([d[keep], self.d[rows][old]]), np.concatenate([i[keep], self.near[rows][old]])
            order = np.lexsort((i, d, q))
            q, d, i = q[order], d[order], i[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            first = place < self.k
            self.d[q[first], place[first]], self.near[q[first], place[first]] = d[first], i[first]
            self.limit[rows] = np.minimum(self.limit[rows], self.d[rows, -1])


def least_products(x: np.ndarray, limit: np.ndarray, largest: float, offset: float) -> np.ndarray:
    """What x . y - |y|^2 / 2 in single precision comes to, at least, for rows y within limit (squared) of x; both less a centre, |y| at most largest, offset the size of what was taken off."""
    n = x.shape[1] + 8
    own = (x**2).sum(1)
    size = np.sqrt(own)
    least = (own - limit) / 2
    scale = size * largest + largest**2 / 2 + np.abs(least)
    with np.errstate(invalid="ignore"):
        out = least - n * 2.0**-23 * scale - 1e-14 * offset * (size + largest) - 1e-30
    return np.where(scale < 1e37, out, -np.inf).astype(np.float32)


def _matrix(value: bytes, width: int) -> np.ndarray:
    return np.frombuffer(value, np.float64).reshape(-1, width)


def _batches(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


class Search:
    """The k nearest others of every row of a table. compared is the number of distances that found() computes."""

    def __init__(self, df: DataFrame, key: str, vector: str, k: int, block: int = 256):
        value = F.col(vector).cast("array<double>")
        whole = F.coalesce(F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False))
        self.rows = df.filter(F.col(key).isNotNull() & whole).select(F.col(key).cast("long").alias("id"), value.alias("v"))
        self.k, self.spark = k, df.sparkSession
        self.count = self.rows.count()
        self.block = max(block, -(-self.count // BLOCKS))
        self.width = len(self.rows.first().v) if self.count else 0
        if self.count:
            self._build()

    def _build(self) -> None:
        spark, width = self.spark, self.width
        wanted = int(min(PIVOTS, max(1, self.count // self.block)))
        drawn = self.rows.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
        layout = Blocks(np.unique(np.array([r.v for r in drawn], float).reshape(-1, width), axis=0), [], np.ones(0))
        cells = self._placed(layout)
        shares = [i / GRID for i in range(1, GRID)]
        edges = [np.empty(0)] * len(layout.pivots)
        for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("own", shares, 10_000).alias("q")).collect():  # a row a pivot
            parts = min(GRID, -(-r.n // self.block))
            edges[r.cell] = np.unique([r.q[round(i * GRID / parts) - 1] for i in range(1, parts)])
        layout = Blocks(layout.pivots, edges, np.ones(0))
        placed = self._placed(layout)
        sizes = placed.groupBy("cell", "ring").agg(F.ceil(F.count("*") / (2 * self.block)).cast("long").alias("salts"))
        salted = placed.join(F.broadcast(sizes), ["cell", "ring"]).withColumn("salt", F.pmod(F.xxhash64("id", F.lit(2)), "salts"))

        def pack(part: pa.Table) -> pa.Table:
            x = np.array(part.column("v").to_pylist(), float).reshape(-1, width)
            _, _, d = layout.place(x)
            row = [part.column(c)[0].as_py() for c in ("cell", "ring", "salt")]
            blobs = [part.column("id").to_numpy().tobytes(), x.tobytes(), d.min(0).tobytes(), d.max(0).tobytes()]
            return pa.table([[v] for v in row + blobs], names=["cell", "ring", "salt", "ids", "x", "low", "high"])

        packed = salted.select("cell", "ring", "salt", "id", "v").groupBy("cell", "ring", "salt").applyInArrow(pack, "cell long, ring long, salt long, ids binary, x binary, low binary, high binary")
        self.packed = cut(packed.withColumn("block", F.concat_ws("-", "cell", "ring", "salt")).select("block", "ids", "x", "low", "high"))
        stats = self.packed.select("block", "low", "high").orderBy("block").collect()  # a row a block: some thousands
        self.names = [r.block for r in stats]
        low, high = (np.array([np.frombuffer(r[c]) for r in stats]) for c in ("low", "high"))
        parts = max(min(GROUPS, -(-len(self.names) // 8)), -(-self.count * width * 8 // HELD))
        self.groups = np.arange(len(self.names)) * min(parts, len(self.names)) // len(self.names)
        self.sent = spark.sparkContext.broadcast((layout, self.names, {b: i for i, b in enumerate(self.names)}, low, high))

    def _placed(self, layout: Blocks) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = np.array(batch.column("v").to_pylist(), float)
                    cell, ring, d = layout.place(x)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(ring), pa.array(d[np.arange(len(x)), cell])], names=["id", "v", "cell", "ring", "own"])

        return self.rows.mapInArrow(work, "id long, v array<double>, cell long, ring long, own double")

    def _asked(self, state: DataFrame) -> DataFrame:
        """(asks, of, qids, qx, far): rows of each block, which ask the few blocks that most of them find nearest. far: their k-th squared distance so far."""
        width, sent = self.width, self.sent

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            layout, names, at, low, high = sent.value
            for batch in batches:
                for r in batch.to_pylist():
                    x = _matrix(r["x"], width)
                    d = np.sqrt(squared(x, layout.pivots))
                    wish = np.zeros(len(names), np.int64)
                    for a in range(0, len(x) if len(names) > 1 else 0, 128):
                        bound = lower_bounds(d[a : a + 128], low, high)
                        bound[:, at[r["block"]]] = np.inf
                        np.add.at(wish, np.argpartition(bound, min(NEXT, len(names) - 1) - 1, axis=1)[:, :NEXT], 1)
                    wish[at[r["block"]]] = 0
                    out = [(names[b], r["block"], r["ids"], r["x"], r["far"]) for b in np.argsort(-wish, kind="stable")[:NEXT] if wish[b]]
                    for one in out:
                        yield _batches([one], ["asks", "of", "qids", "qx", "far"], [pa.string(), pa.string(), *[pa.binary()] * 3])

        return state.mapInArrow(work, "asks string, of string, qids binary, qx binary, far binary")

    def _rest(self, state: DataFrame) -> DataFrame:
        """(id, neighbour, distance): the nearest in blocks that a row's block hasn't asked yet and that can't be skipped."""
        width, k, sent, groups = self.width, self.k, self.sent, self.groups
        parts = int(groups[-1]) + 1
        starts = np.searchsorted(groups, np.arange(parts))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            layout, _, at, low, high = sent.value
            for batch in batches:
                for r in batch.to_pylist():
                    ids, x, far = np.frombuffer(r["ids"], np.int64), _matrix(r["x"], width), np.frombuffer(r["far"])
                    done = [at[r["block"]], *(at[b] for b in r["seen"])]
                    for a in range(0, len(x), 128):
                        part = slice(a, a + 128)
                        need = reached(np.sqrt(squared(x[part], layout.pivots)), far[part], low, high)
                        need[:, done] = False
                        wanted = np.logical_or.reduceat(need, starts, axis=1)
                        out = [(int(g), int(groups[done[0]]), done, *(v[part][wanted[:, g]].tobytes() for v in (ids, x, far))) for g in np.flatnonzero(wanted.any(0))]
                        if out:
                            yield _batches(out, ["asks", "of", "done", "qids", "qx", "far"], [pa.int32(), pa.int32(), pa.list_(pa.int32()), *[pa.binary()] * 3])

        def answer(left: pa.Table, right: pa.Table) -> pa.Table:
            layout, _, at, low, high = sent.value
            found: list[tuple] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
            blocks = sorted(right.to_pylist(), key=lambda r: at[r["block"]]) if left.num_rows else []
            if blocks:
                number = np.array([at[r["block"]] for r in blocks])
                x, ids = np.concatenate([_matrix(r["x"], width) for r in blocks]), np.concatenate([np.frombuffer(r["ids"], np.int64) for r in blocks])
                ends = np.cumsum([len(r["ids"]) // 8 for r in blocks])
                begins = np.append(0, ends[:-1])
                centre = layout.pivots.mean(0)
                offset = np.sqrt(width) * (np.abs(x).max() + np.abs(layout.pivots).max())
                near = x - centre
                sizes = (near**2).sum(1)
                with np.errstate(over="ignore"):
                    products = np.hstack([near, -sizes[:, None] / 2]).astype(np.float32)
                largest = float(np.sqrt(sizes.max()))
            for r in left.to_pylist() if blocks else []:
                own = Near(_matrix(r["qx"], width), np.frombuffer(r["qids"], np.int64), np.frombuffer(r["far"]), k)
                need = reached(np.sqrt(squared(own.x, layout.pivots)), own.limit, low[number], high[number])
                need[:, np.isin(number, r["done"])] = False
                less = own.x - centre
                reach = offset + np.sqrt(width) * np.abs(own.x).max()
                with np.errstate(over="ignore"):
                    asking = np.hstack([less, np.ones((len(less), 1))]).astype(np.float32)
                open_blocks = np.flatnonzero(need.any(0))
                at_once = max(1, 2048 * len(blocks) // len(x))
                for a in range(0, len(open_blocks), at_once):
                    some = open_blocks[a : a + at_once]
                    rows = np.concatenate([np.arange(begins[b], ends[b]) for b in some])
                    block = np.repeat(some, ends[some] - begins[some])
                    for c in range(0, len(rows), 8192):
                        piece = rows[c : c + 8192]
                        with np.errstate(over="ignore", invalid="ignore"):
                            hits = ~(asking @ products[piece].T < least_products(less, own.limit, largest, reach)[:, None])
                        query, column = np.divmod(np.flatnonzero(hits), len(piece))
                        asked = need[query, block[c : c + 8192][column]]
                        query, row = query[asked], piece[column[asked]]
                        for e in range(0, len(query), 1 << 15):
                            own.take(query[e : e + (1 << 15)], x[row[e : e + (1 << 15)]], ids[row[e : e + (1 << 15)]])
                there = own.d < np.inf
                found.append((np.repeat(own.ids, there.sum(1)), own.near[there], own.d[there]))
            return pa.table([np.concatenate(c) for c in zip(*found, strict=True)], names=["id", "neighbour", "distance"])

        self.asked = state.mapInArrow(ask, "asks int, of int, done array<int>, qids binary, qx binary, far binary")
        given = self.packed.join(F.broadcast(self.spark.createDataFrame([(b, int(g)) for b, g in zip(self.names, groups, strict=True)], "block string, asks int")), "block")
        given = given.select("asks", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("of"), "block", "ids", "x")
        return self.asked.groupBy("asks", "of").cogroup(given.groupBy("asks", "of")).applyInArrow(answer, FOUND)

    def _answers(self, asked: DataFrame) -> DataFrame:
        """(of, asks, ids, neighbours, distances) as arrays: what is as near as the k-th so far."""
        width, k = self.width, self.k
        met = asked.join(self.packed.select(F.col("block").alias("asks"), "ids", "x"), "asks")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    ids, x, own, far = np.frombuffer(r["ids"], np.int64), _matrix(r["x"], width), np.frombuffer(r["qids"], np.int64), np.frombuffer(r["far"])
                    rows = []
                    queries = _matrix(r["qx"], width)
                    for a in range(0, len(own), 256):
                        d = squared(queries[a : a + 256], x)
                        for i, near in best(ids, d, own[a : a + 256], k):
                            near = near[d[i, near] <= far[a + i]]
                            rows += [(r["of"], r["asks"], int(own[a + i]), int(ids[j]), float(d[i, j])) for j in near]
                    yield _batches(rows, ["of", "asks", "id", "neighbour", "distance"], [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64()])

        return met.mapInArrow(work, "of string, asks string, " + FOUND)

    def found(self) -> DataFrame:
        """(id, neighbour, distance, rank)."""
        if not self.count:
            return self.spark.createDataFrame([], FOUND + ", rank int")
        width, k = self.width, self.k

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    ids, x = np.frombuffer(r["ids"], np.int64), _matrix(r["x"], width)
                    rows, far = [], np.full(len(ids), np.inf)
                    for a in range(0, len(ids), 256):
                        d = squared(x[a : a + 256], x)
                        for i, near in best(ids, d, ids[a : a + 256], k):
                            rows += [(int(ids[j]), float(d[i, j])) for j in near] + [(-1, np.inf)] * (k - len(near))
                            if len(near) == k:
                                far[a + i] = d[i, near[-1]]
                    near, distance = (np.array(c) for c in zip(*rows, strict=True))
                    yield _batches([(r["block"], r["ids"], r["x"], far.tobytes(), near.astype(np.int64).tobytes(), distance.astype(float).tobytes(), [])], ["block", "ids", "x", "far", "near", "distance", "seen"], [pa.string(), *[pa.binary()] * 5, pa.list_(pa.string())])

        kind = "block string, ids binary, x binary, far binary, near binary, distance binary, seen array<string>"
        state = cut(self.packed.select("block", "ids", "x").mapInArrow(own, kind))
        near = self._answers(self._asked(state))

        def merge(left: pa.Table, right: pa.Table) -> pa.Table:
            r = left.to_pylist()[0]
            ids = np.frombuffer(r["ids"], np.int64)
            at = {v: i for i, v in enumerate(ids.tolist())}
            held = [[(d, n) for d, n in zip(a, b, strict=True) if d < np.inf] for a, b in zip(np.frombuffer(r["distance"]).reshape(-1, k).tolist(), np.frombuffer(r["near"], np.int64).reshape(-1, k).tolist(), strict=True)]
            for i, n, d in zip(*(right.column(c).to_pylist() for c in ("id", "neighbour", "distance")), strict=True):
                held[at[i]].append((d, n))
            held = [sorted(h)[:k] for h in held]
            far = np.array([h[-1][0] if len(h) == k else np.inf for h in held])
            full = [h + [(np.inf, -1)] * (k - len(h)) for h in held]
            near, distance = np.array([[n for _, n in h] for h in full], np.int64), np.array([[d for d, _ in h] for h in full], float)
            seen = sorted(set(right.column("asks").to_pylist()))
            columns = [[r["block"]], [r["ids"]], [r["x"]], [far.tobytes()], [near.tobytes()], [distance.tobytes()], pa.array([seen], pa.list_(pa.string()))]
            return pa.table(columns, names=["block", "ids", "x", "far", "near", "distance", "seen"])

        merged = cut(state.groupBy("block").cogroup(near.withColumnRenamed("of", "block").groupBy("block")).applyInArrow(merge, kind))
        self.state = merged

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    distance = np.frombuffer(r["distance"])
                    keep = distance < np.inf
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.frombuffer(r["ids"], np.int64), k)[keep]), pa.array(np.frombuffer(r["near"], np.int64)[keep]), pa.array(distance[keep])], names=["id", "neighbour", "distance"])

        place = Window.partitionBy("id").orderBy("distance", "neighbour")
        every = merged.mapInArrow(unpack, FOUND).union(self._rest(merged))
        return cut(every.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k))

    def compared(self) -> float:
        """The share of all pairs that can't be skipped; after found()."""
        width, sent = self.width, self.sent
        n = {r.block: r.n for r in self.packed.select("block", (F.length("ids") / 8).alias("n")).collect()}
        sizes = np.array([n[b] for b in self.names])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            layout, _, at, low, high = sent.value
            for batch in batches:
                for r in batch.to_pylist():
                    x = _matrix(r["x"], width)
                    need = reached(np.sqrt(squared(x, layout.pivots)), np.frombuffer(r["far"]), low, high)
                    need[:, at[r["block"]]] = True
                    yield pa.RecordBatch.from_arrays([pa.array([float((need @ sizes).sum())])], names=["c"])

        return self.state.mapInArrow(work, "c double").agg(F.sum("c").alias("c")).first().c / self.count**2


def nearest_rows(df: DataFrame, key: str, vector: str, k: int, block: int = 256) -> DataFrame:
    """(id, neighbour, distance, rank): each row's k nearest others by squared distance, ties to smaller keys."""
    return Search(df, key, vector, k, block).found().select("id", "neighbour", "distance", "rank")
