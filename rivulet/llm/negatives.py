"""Hard negatives for anchors, by dense products of blocks.

Vectors become integers, floor(256 x) for each component. Anchors are taken in
passes of bounded size; a pass broadcasts its anchors, and every task multiplies
them with its candidates in double precision, block by block. That is exact as
long as the sums stay below 2**53; blocks whose sizes allow more are multiplied
in integers of any length (scores beyond 64 bits stop at the largest).

A pass has two steps. The first keeps, for each anchor, the best rows of the same
label: lists of fixed length that merge. The second keeps, for each anchor and
positive, the best rows of another label in the positive's window. Neither depends
on how rows are dealt, as ties go to the smaller id.

Rows take part if id and label are not null and the vector holds no null or
non-finite component; vectors of another length than the commonest (the shorter at
a tie) take none. Rows with one id count once, as the smallest by label and vector
(so repeated rows change nothing), and are no partners of themselves. Empty tables
give no rows. Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

EXACT = 2.0**53
TILE = 512
LEAST = np.iinfo(np.int64).min


def whole_components(df: DataFrame, id_column: str, vector: str, label: Column) -> DataFrame:
    """(id, label, vector): rows that take part, one an id, components as whole numbers."""
    value = F.col(vector).cast("array<double>")
    finite = F.forall(value, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    ready = df.select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), value.alias("vector"), finite.alias("ok"))
    ready = ready.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce("ok", F.lit(False)))
    # floor of a double as a double: floor() itself gives a long, which large components don't fit in
    down = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(F.when(F.abs(x) < 2.0**52, x).otherwise(0.0)).cast("double")).otherwise(x)
    one = ready.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.label", F.transform("r.vector", lambda x: down(x * 256)).alias("vector"))
    length = one.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return one.filter(F.size("vector") == (length.n if length else 0))


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products of all rows and anchors, exact, as 64-bit integers."""
    if not rows.size or not anchors.size:
        return np.zeros((len(rows), len(anchors)), np.int64)
    if np.abs(rows).max() * np.abs(anchors).max() * rows.shape[1] < EXACT:
        return (rows @ anchors.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x], object)
    limit = np.iinfo(np.int64)
    return np.clip(whole(rows) @ whole(anchors).T, limit.min, limit.max).astype(np.int64)


class Best:
    """The best k (score, id) of each of n lists: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), LEAST)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.full = np.zeros((n, k), bool)

    def may_enter(self, scores: np.ndarray, ids: np.ndarray, lists: slice) -> np.ndarray:
        """Which of scores (row, list) would be among the best of their list as it is."""
        last, place, full = self.score[lists, -1], self.id[lists, -1], self.full[lists, -1]
        return ~full[None] | (scores > last[None]) | ((scores == last[None]) & (ids[:, None] < place[None]))

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Adds entries to the lists at."""
        if not len(at):
            return
        held_at, held = np.nonzero(self.full[np.unique(at)])
        touched = np.unique(at)
        at = np.concatenate([at, touched[held_at]])
        scores = np.concatenate([scores, self.score[touched[held_at], held]])
        ids = np.concatenate([ids, self.id[touched[held_at], held]])
        order = np.lexsort((ids, -(scores.astype(np.float64)), at)) if np.abs(scores).max(initial=0) < EXACT else np.array(sorted(range(len(at)), key=lambda i: (at[i], -int(scores[i]), ids[i])))
        at, scores, ids = at[order], scores[order], ids[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        keep = rank < self.k
        at, scores, ids, rank = at[keep], scores[keep], ids[keep], rank[keep]
        self.full[touched] = False
        self.score[at, rank], self.id[at, rank], self.full[at, rank] = scores, ids, True


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, matrix) in blocks of bounded size."""
    for batch in batches:
        if batch.num_rows:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            x = flat.reshape(batch.num_rows, width)
            for a in range(0, len(ids), 2048):
                yield ids[a : a + 2048], labels[a : a + 2048], x[a : a + 2048]


def mined(rows: DataFrame, chosen: Callable[[DataFrame], DataFrame], positives: int = 5, negatives: int = 5, low: tuple[int, int] = (4, 5), pass_bytes: int = 16 << 20) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    rows: (id, label, vector) of whole_components; chosen picks the anchors among
    them. A negative's score is at most the positive's and at least the
    share low of it. pass_bytes bounds what a pass broadcasts.
    """
    spark = rows.sparkSession
    small_batches(spark, 4096)
    rows = stored(rows, "candidates")
    anchors = stored(chosen(rows), "anchors")
    first = anchors.first()
    if first is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = len(first.vector)
    limit = max(1, pass_bytes // (8 * max(1, width) + 32 * positives))
    passes = -(-anchors.count() // limit)
    while True:  # anchors of a pass, by a hash of their ids: none may have more than the limit
        place = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(passes))
        if anchors.groupBy(place.alias("p")).count().agg(F.max("count")).first()[0] <= limit:
            break
        passes += passes // 4 + 1
    out = [stored(_pass(rows, anchors.filter(place == p), width, positives, negatives, low), "negatives") for p in range(passes)]
    return out[0] if len(out) == 1 else spark.read.schema(out[0].schema).parquet(*(d._stored_at for d in out))


def _pass(rows: DataFrame, anchors: DataFrame, width: int, positives: int, negatives: int, low: tuple[int, int]) -> DataFrame:
    spark = rows.sparkSession
    held = anchors.orderBy("id").collect()  # a pass's worth: at most pass_bytes
    ids, labels = np.array([r.id for r in held], np.int64), np.array([r.label for r in held], np.int64)
    x = np.array([r.vector for r in held], float).reshape(len(held), width)
    sent = spark.sparkContext.broadcast((ids, labels, x))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kinds, a = sent.value
        best = Best(len(own), positives)
        for at, label, block in blocks(batches, width):
            for t in range(0, len(own), TILE):
                lists = slice(t, t + TILE)
                score = products(block, a[lists])
                fit = (label[:, None] == kinds[None, lists]) & (at[:, None] != own[None, lists])
                row, column = np.nonzero(fit & best.may_enter(score, at, lists))
                best.add(column + t, score[row, column], at[row])
        row, place = np.nonzero(best.full)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(best.score[row, place]), pa.array(best.id[row, place])], names=["anchor", "score", "id"])

    found = _merged(rows.mapInArrow(nearest, "anchor long, score long, id long"), ["anchor"], positives).collect()  # positives rows an anchor of this pass
    pairs = sorted((r.anchor, r.rank, r.score, r.id) for r in found)
    of, value, partner = (np.array([p[k] for p in pairs], np.int64) for k in (0, 2, 3))
    floor_of = np.array([-((-low[0] * int(v)) // low[1]) for v in value], np.int64)  # the least whole number in the window
    sent_pairs = spark.sparkContext.broadcast((of, value, floor_of))

    def window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kinds, a = sent.value
        of, top, bottom = sent_pairs.value
        best = Best(len(of), negatives)
        for at, label, block in blocks(batches, width):
            for t in range(0, len(of), TILE):
                lists = slice(t, t + TILE)
                used, inverse = np.unique(of[lists], return_inverse=True)  # an anchor's positives stand together: one product for all
                score = products(block, a[used])[:, inverse]
                fit = (label[:, None] != kinds[of[lists]][None]) & (score <= top[None, lists]) & (score >= bottom[None, lists])
                row, column = np.nonzero(fit & best.may_enter(score, at, lists))
                best.add(column + t, score[row, column], at[row])
        row, place = np.nonzero(best.full)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(best.score[row, place]), pa.array(best.id[row, place])], names=["pair", "score", "id"])

    final = _merged(rows.mapInArrow(window, "pair long, score long, id long"), ["pair"], negatives)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, top, _ = sent_pairs.value
        for batch in batches:
            p = batch.column("pair").to_numpy()
            columns = [pa.array(sent.value[0][of[p]]), pa.array(partner[p]), batch.column("rank"), batch.column("id"), pa.array(top[p]), batch.column("score")]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return final.mapInArrow(named, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def _merged(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best k of each key's lists, one of at most k rows from each task."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
