"""Statistics of a key's last span of time, by a window that adds and takes back.

A range frame in SQL recomputes its aggregate for every row, so a row costs as much
as its window holds. Here a row is added once and taken back once: counts of ports
and destinations change by one, and the entropy follows from a running sum. Sums
are kept as whole numbers, so they don't depend on the order of changes and never
drift: a batch and a stream give the same bits.

A key's time is cut into stretches of several spans. A stretch is a group of its
own, with the rows of one span before it as context; so a key that holds a third of
all rows is many tasks' work. What a task holds is one window.

Rows with equal times see each other. Null ports and destinations count as records
without a port or destination, a null length as 0; rows without a time have null
statistics, rows with a null key form one key.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import spread

FIXED = 1 << 44
FAR = (1 << 63) - 1
STRETCH = 8
STATISTICS = {"n": T.LongType(), "fanout": T.LongType(), "entropy": T.DoubleType(), "bytes": T.DoubleType(), "gap_us": T.LongType()}
MARKER, CONTEXT, OWN = -1, 0, 1

_terms: list[int] = [0, 0]


def weighted(count: int) -> int:
    """count * log(count) as a whole number of 2**-44."""
    while len(_terms) <= count and len(_terms) < 1 << 16:
        k = len(_terms)
        _terms.append(round(k * math.log(k) * FIXED))
    return _terms[count] if count < len(_terms) else round(count * math.log(count) * FIXED)


class Sliding:
    """The records of the last span."""

    def __init__(self, span_us: int):
        self.span, self.rows, self.ports, self.targets = span_us, deque(), {}, {}
        self.spread = self.size = self.with_port = 0

    def add(self, us: int, port, target, size) -> None:
        whole = 0 if size is None or size != size else round(size * FIXED)
        self.rows.append((us, port, target, whole))
        self.size += whole
        if port is not None:
            c = self.ports.get(port, 0)
            self.ports[port] = c + 1
            self.spread += weighted(c + 1) - weighted(c)
            self.with_port += 1
        if target is not None:
            self.targets[target] = self.targets.get(target, 0) + 1

    def forget(self, now: int) -> None:
        """Takes back what is older than a span."""
        rows, first = self.rows, now - self.span
        while rows and rows[0][0] < first:
            _, port, target, whole = rows.popleft()
            self.size -= whole
            if port is not None:
                c = self.ports[port]
                self.spread += weighted(c - 1) - weighted(c)
                self.with_port -= 1
                if c == 1:
                    del self.ports[port]
                else:
                    self.ports[port] = c - 1
            if target is not None:
                c = self.targets[target]
                if c == 1:
                    del self.targets[target]
                else:
                    self.targets[target] = c - 1

    def values(self) -> tuple[int, int, float, float]:
        """(records, destinations, entropy of ports over the log of their number, bytes)."""
        kinds, n = len(self.ports), self.with_port
        entropy = (math.log(n) - self.spread / FIXED / n) / math.log(kinds) if kinds > 1 else 0.0
        return len(self.rows), len(self.targets), entropy, self.size / FIXED


class _Held:
    """A batch and its rows' statistics, as far as they are known."""

    def __init__(self, batch: pa.RecordBatch):
        n = batch.num_rows
        self.batch, self.open = batch, 0
        # plain lists: rows are set one at a time
        self.values = {"n": [0] * n, "fanout": [0] * n, "entropy": [0.0] * n, "bytes": [0.0] * n, "gap_us": [-1] * n}

    def finished(self, names: list[str]) -> pa.RecordBatch:
        keep = self.batch.column("__kind").to_numpy() == OWN
        known = self.batch.column("__us").is_valid().to_numpy(zero_copy_only=False)
        mask = ~known
        values = {k: np.array(v, np.float64 if k in ("entropy", "bytes") else np.int64) for k, v in self.values.items()}
        added = [pa.array(v, mask=mask | (v < 0) if k == "gap_us" else mask) for k, v in values.items()]
        out = pa.RecordBatch.from_arrays([*(self.batch.column(c) for c in names), *added], names=[*names, *STATISTICS])
        return out.filter(pa.array(keep))


def slid(batches: Iterator[pa.RecordBatch], span_us: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Sorted batches with their statistics. gap_us is null for a key's first record, and at most the largest long if the last one is out of sight."""
    queue: deque[_Held] = deque()
    window, group, now, last, earlier = Sliding(span_us), None, None, None, False
    ranges: list[tuple[_Held, int, int]] = []  # records of the present time: their values are due when it has passed

    def close() -> None:
        values = window.values()
        for held, a, b in ranges:
            for name, v in zip(("n", "fanout", "entropy", "bytes"), values, strict=True):
                own = held.values[name]
                if b == a + 1:
                    own[a] = v
                else:
                    own[a:b] = [v] * (b - a)
            held.open -= 1
        ranges.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        held = _Held(batch)
        queue.append(held)
        columns = [batch.column(c).to_pylist() for c in ("__key", "__stretch", "__us", "__kind", "__port", "__target", "__size")]
        for i, (key, stretch, us, kind, port, target, size) in enumerate(zip(*columns, strict=True)):
            if (key, stretch) != group:
                close()
                window, group, now, last, earlier = Sliding(span_us), (key, stretch), None, None, False
            if kind == MARKER:
                earlier = True
                continue
            if us is None:
                continue
            if us != now:
                close()
                now = us
                window.forget(us)
            window.add(us, port, target, size)
            held.values["gap_us"][i] = us - last if last is not None else FAR if earlier else -1
            last = us
            if ranges and ranges[-1][0] is held and ranges[-1][2] == i:
                ranges[-1] = (held, ranges[-1][1], i + 1)
            else:
                ranges.append((held, i, i + 1))
                held.open += 1
        while queue and not queue[0].open:
            yield queue.popleft().finished(names)
    close()
    while queue:
        yield queue.popleft().finished(names)


def statistics(df: DataFrame, span_us: int, reach_us: int = 0, key: str = "src", port: str = "port", target: str = "dst", size: str = "len") -> DataFrame:
    """df with n, fanout, entropy, bytes of the key's last span_us (this record included) and gap_us, the time since its last record.

    A gap is exact up to reach_us (or the span, if that is longer); a longer one
    is some number above it. Needs us and seq.
    """
    reach = max(span_us, reach_us)
    length = STRETCH * reach
    stretch = F.floor(F.col("us") / F.lit(length)).cast("long")
    helpers = {"__key": F.col(key), "__us": F.col("us"), "__seq": F.col("seq"), "__port": F.col(port), "__target": F.col(target), "__size": F.col(size).cast("double")}
    rows = df.select("*", *(c.alias(n) for n, c in helpers.items()), stretch.alias("__own"))
    place = F.pmod(F.col("us"), F.lit(length))
    # a row belongs to its stretch, and to the next one as context if that begins within reach
    once = F.array(F.struct(F.col("__own").alias("s"), F.lit(OWN).alias("k")))
    twice = F.concat(once, F.array(F.struct((F.col("__own") + 1).alias("s"), F.lit(CONTEXT).alias("k"))))
    placed = rows.withColumn("__p", F.explode(F.when(place >= length - reach, twice).otherwise(once)))
    placed = placed.withColumns({"__stretch": F.col("__p.s"), "__kind": F.col("__p.k")}).drop("__p", "__own")
    # stretches that aren't their key's first: a row each
    known = df.filter(F.col("us").isNotNull()).select(F.col(key).alias("__key"), stretch.alias("__stretch")).distinct()
    later = known.withColumn("__first", F.min("__stretch").over(Window.partitionBy("__key"))).filter(F.col("__stretch") > F.col("__first"))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in placed.schema if f.name not in ("__key", "__stretch", "__kind")]
    markers = later.select("__key", "__stretch", F.lit(MARKER).alias("__kind"), *nothing).select(*placed.columns)
    every = spread(placed.union(markers), "__key", "__stretch").sortWithinPartitions("__key", "__stretch", F.col("__kind") >= 0, "__us", "__seq")
    names = df.columns
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in STATISTICS.items())])
    return every.mapInArrow(lambda batches: slid(batches, span_us, names), schema)
