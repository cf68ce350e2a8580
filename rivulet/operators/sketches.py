"""Heavy hitters by a sketch that merges: counters, and a bounded list of candidates.

Each partition keeps counters with fixed hashes and at most ``capacity`` keys with
counts. When there are more keys, the largest count that doesn't fit is taken off
all, and what is left of no count goes; what was taken off adds up to the error. Two
sketches merge by adding and taking off in the same way, so partitions meet in a
tree, and no exact count of any key is ever formed. Of N rows, every key with more
than N / (capacity + 1) is a candidate in the end, however rows were dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import flow as fx
from .tables import SKETCH_SEEDS, SKETCH_WIDTH

SCHEMA = "counters binary, keys array<string>, buckets array<array<int>>, counts array<long>, taken long, total long"
FAN = (64, 8, 1)


class HeavyHitters:
    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counters = np.zeros((len(SKETCH_SEEDS), SKETCH_WIDTH), np.int64)
        self.held: dict[str, int] = {}
        self.places: dict[str, list[int]] = {}
        self.taken = self.total = 0

    def add(self, keys: list[str], places: list[list[int]], counts: list[int]) -> None:
        """Rows with keys, and where they are counted."""
        at = np.array(places, np.int64).reshape(-1, len(SKETCH_SEEDS))
        for row in range(len(SKETCH_SEEDS)):
            np.add.at(self.counters[row], at[:, row], counts)
        self._hold(zip(keys, places, counts, strict=True))
        self.total += int(sum(counts))

    def merge(self, counters: np.ndarray, keys: list[str], places: list[list[int]], counts: list[int], taken: int, total: int) -> None:
        self.counters += counters
        self.taken += taken
        self.total += total
        self._hold(zip(keys, places, counts, strict=True))

    def _hold(self, entries) -> None:
        for key, place, n in entries:
            self.held[key] = self.held.get(key, 0) + n
            self.places[key] = place
        if len(self.held) > self.capacity:
            off = sorted(self.held.values(), reverse=True)[self.capacity]
            self.held = {k: n - off for k, n in self.held.items() if n > off}
            self.places = {k: self.places[k] for k in self.held}
            self.taken += off

    def row(self) -> pa.RecordBatch:
        keys = list(self.held)
        columns = [pa.array([self.counters.tobytes()], pa.binary()), pa.array([keys], pa.list_(pa.string())), pa.array([[self.places[k] for k in keys]], pa.list_(pa.list_(pa.int32()))), pa.array([[self.held[k] for k in keys]], pa.list_(pa.int64())), pa.array([self.taken]), pa.array([self.total])]
        return pa.RecordBatch.from_arrays(columns, names=["counters", "keys", "buckets", "counts", "taken", "total"])


def sketched(df: DataFrame, key: Column, number: Column, capacity: int = 256) -> DataFrame:
    """One row: the merged sketch of all rows. key: what is reported, number: its integer that is hashed. Null keys are left out."""
    buckets = F.array(*(fx.mix32(number, seed).bitwiseAND(SKETCH_WIDTH - 1).cast("int") for seed in SKETCH_SEEDS))
    rows = df.select(key.cast("string").alias("key"), buckets.alias("at")).filter(F.col("key").isNotNull())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = HeavyHitters(capacity)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = table.column("key").combine_chunks().dictionary_encode()
            index = keys.indices.to_numpy()
            first, counts = np.unique(index, return_index=True)[1], np.bincount(index, minlength=len(keys.dictionary))
            if len(first):
                sketch.add(keys.dictionary.to_pylist(), batch.column("at").take(pa.array(first)).to_pylist(), counts.tolist())
        yield sketch.row()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = HeavyHitters(capacity)
        for batch in batches:
            for r in batch.to_pylist():
                sketch.merge(np.frombuffer(r["counters"], np.int64).reshape(sketch.counters.shape), r["keys"], r["buckets"], r["counts"], r["taken"], r["total"])
        yield sketch.row()

    out = rows.mapInArrow(build, SCHEMA)
    for parts in FAN:  # a tree: each level merges what fewer tasks hold
        out = out.repartition(parts).mapInArrow(meet, SCHEMA)
    return out


def heavy_hitters(sketch: DataFrame, top: int = 20) -> DataFrame:
    """(key, least, estimate, most, total): candidates by their estimate, largest first, ties by key; a key's true count lies between least and most, and estimate is that of the counters alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                counters = np.frombuffer(r["counters"], np.int64).reshape(len(SKETCH_SEEDS), SKETCH_WIDTH)
                at = np.array(r["buckets"], np.int64).reshape(-1, len(SKETCH_SEEDS))
                estimate = counters[np.arange(len(SKETCH_SEEDS))[None], at].min(1) if len(at) else np.empty(0, np.int64)
                least = np.array(r["counts"], np.int64)
                columns = [pa.array(r["keys"], pa.string()), pa.array(least), pa.array(estimate), pa.array(np.minimum(estimate, least + r["taken"])), pa.array(np.full(len(least), r["total"]))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "least", "estimate", "most", "total"])

    return sketch.mapInArrow(work, "key string, least long, estimate long, most long, total long").orderBy(F.desc("estimate"), "key").limit(top)
