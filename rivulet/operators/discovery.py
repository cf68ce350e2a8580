"""The false-discovery cutoff over the last records, for each record.

A tree over ranks holds, for each rank i, how many of the last p-values are small
enough for it (at most q i / n). Its nodes keep sums and largest prefix sums, so the
largest rank that enough p-values reach is found by one descent, and a p-value that
comes or goes changes one path. The order of records is cut into stretches with the
window before each as context, so no task holds more than a stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import Recent
from .lineage import spread
from .ordered import running_totals

STRETCH = 8192
NEVER = -(1 << 40)


class Cutoff:
    """The Benjamini-Hochberg cutoff of the last `window` p-values; 1 until there are `least`."""

    def __init__(self, window: int = 500, q: float = 0.1, least: int = 20):
        self.window, self.q, self.least = window, q, least
        self.recent = Recent(window)
        self.levels = q * (np.arange(1, window + 1) / window)
        self.size = 1 << max(1, (window - 1).bit_length())
        self.total = [0] * (2 * self.size)
        self.best = [NEVER] * (2 * self.size)
        self.full = False

    def _set(self, rank: int, change: int) -> None:
        node = self.size + rank
        self.total[node] += change
        self.best[node] = self.total[node]
        node >>= 1
        while node:
            a, b = 2 * node, 2 * node + 1
            self.total[node] = self.total[a] + self.total[b]
            self.best[node] = max(self.best[a], self.total[a] + self.best[b])
            node >>= 1

    def _place(self, p: float, change: int) -> None:
        rank = int(np.searchsorted(self.levels, p))
        if rank < self.window:
            self._set(rank, change)

    def add(self, p: float) -> None:
        if len(self.recent) == self.window:
            self._place(self.recent.queue[0], -1)
        self.recent.add(p)
        if self.full:
            self._place(p, 1)
        elif len(self.recent) == self.window:
            self.full = True
            for rank in range(self.window):
                self._set(rank, -1)
            for v in self.recent.queue:
                self._place(v, 1)

    def rank(self) -> int:
        """The largest rank from 1 whose level as many p-values reach; 0 if none."""
        n = len(self.recent)
        if not self.full:
            reached = np.flatnonzero(np.array(self.recent.sorted) <= self.q * (np.arange(1, n + 1) / n))
            return int(reached[-1]) + 1 if len(reached) else 0
        node, before = 1, 0
        if self.best[1] < 0:
            return 0
        while node < self.size:
            if before + self.total[2 * node] + self.best[2 * node + 1] >= 0:
                before, node = before + self.total[2 * node], 2 * node + 1
            else:
                node = 2 * node
        return node - self.size + 1

    def value(self) -> float:
        n = len(self.recent)
        if n < self.least:
            return 1.0
        i = self.rank()
        return self.recent.sorted[i - 1] if i else float(self.q * (1 / n))


def rolling_cutoffs(df: DataFrame, p: str = "p", window: int = 500, q: float = 0.1, least: int = 20) -> DataFrame:
    """df (us, seq, p, ...) with cutoff: that of the last `window` records by (us, seq), this one included. A null p counts as 1."""
    one = running_totals(df.withColumn("__one", F.lit(1).cast("long")), "us", ["__one"], tie=[F.col("seq")])
    number = F.col("run___one") - 1
    own, place = F.floor(number / STRETCH).cast("long"), F.pmod(number, F.lit(STRETCH))
    once = F.array(F.struct(own.alias("s"), F.lit(True).alias("own")))
    reach = -(-window // STRETCH)  # stretches whose context a record is
    later = [F.struct((own + k).alias("s"), F.lit(False).alias("own")) for k in range(1, reach + 1)]
    twice = F.concat(once, F.array(*later))
    placed = one.withColumns({"__at": number, "__p": F.coalesce(F.nanvl(F.col(p).cast("double"), F.lit(1.0)), F.lit(1.0))}).withColumn("__s", F.explode(F.when(place >= STRETCH * reach - (window - 1), twice).otherwise(once) if reach == 1 else twice))
    dealt = placed.select(*df.columns, "__at", "__p", F.col("__s.s").alias("__stretch"), F.col("__s.own").alias("__own"))
    dealt = spread(dealt, "__stretch").sortWithinPartitions("__stretch", "__at")
    schema = T.StructType([*df.schema.fields, T.StructField("cutoff", T.DoubleType())])
    names = df.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, group = None, None
        for batch in batches:
            values = np.zeros(batch.num_rows)
            for i, (stretch, v, mine) in enumerate(zip(batch.column("__stretch").to_pylist(), batch.column("__p").to_pylist(), batch.column("__own").to_pylist(), strict=True)):
                if stretch != group:
                    state, group = Cutoff(window, q, least), stretch
                state.add(v)
                if mine:
                    values[i] = state.value()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(values)], names=[*names, "cutoff"]).filter(batch.column("__own"))

    return dealt.mapInArrow(work, schema)
