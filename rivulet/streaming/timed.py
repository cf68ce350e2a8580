"""Keyed state in event time: rows in order, timers, expiry.

A stream's rows come in any order within the allowed delay. ``InOrder`` keeps a
key's rows until the watermark has passed them, then hands them on by (us, seq). So
what comes out doesn't depend on how the input was cut into micro-batches. Timers
make things happen where no row comes: a key's state expires, a silent member is
suspected. State is lists, maps and values of Spark's state store, never one text.

Needs the RocksDB state store (``prepared`` sets it for the session's next queries).
Rows without a time are left out; rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import sliding, windows

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepared(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class InOrder(StatefulProcessor):
    """Subclasses get a key's rows in order of time (passed), and calls at the times that they ask for (wake, due)."""

    def __init__(self, row_schema: str):
        self.row_schema = row_schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.row_schema)
        self.armed = handle.getValueState("armed", "at long")
        self.start(handle)

    def start(self, handle: StatefulProcessorHandle) -> None: ...

    def passed(self, key: tuple, rows: list[Row]) -> list[Row]:
        """Rows that the watermark has passed, by (us, seq)."""
        raise NotImplementedError

    def wake(self) -> int | None:
        """When to call due(), in ms, if no row comes before."""
        return None

    def due(self, key: tuple, now_ms: int) -> list[Row]:
        return []

    def arm(self, at: int | None) -> None:
        held = self.armed.get()
        if held is not None and (at is None or held[0] != at):
            self.handle.deleteTimer(held[0])
            self.armed.clear()
        if at is not None and (held is None or held[0] != at):
            self.handle.registerTimer(at)
            self.armed.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(r[c] for c in self.columns()) for r in rows]
        if new:
            self.pending.appendList(new)
            first, held = min(r[0] for r in new) // 1000, self.armed.get()
            self.arm(first if held is None else min(first, held[0]))
        return iter([])

    def columns(self) -> list[str]:
        return [part.split()[0] for part in self.row_schema.split(",")]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        self.armed.clear()
        names = self.columns()
        rows = sorted((Row(**dict(zip(names, r, strict=True))) for r in self.pending.get()), key=lambda r: (r.us, r.seq))
        ready, rest = [r for r in rows if r.us <= now * 1000], [r for r in rows if r.us > now * 1000]
        out = self.passed(key, ready) if ready else []
        if ready:
            if rest:
                self.pending.put([tuple(r) for r in rest])
            else:
                self.pending.clear()
        out += self.due(key, now)
        # later than now: Spark drops the timer that fired, also one set anew for the same time
        wanted = [max(t, now + 1) for t in (rest[0].us // 1000 if rest else None, self.wake()) if t is not None]
        self.arm(min(wanted) if wanted else None)
        return iter(out)

    def close(self) -> None: ...


class Features(InOrder):
    """Sliding statistics of a key. State: the records of the last span by time, and the time of the last one."""

    def __init__(self, span_us: int, idle_us: int):
        super().__init__("us long, seq long, port int, dst string, len double, flags int")
        self.span, self.idle = span_us, idle_us

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getMapState("recent", "us long, seq long", "port int, dst string, len double")
        self.last = handle.getValueState("last", "us long")

    def passed(self, key: tuple, rows: list[Row]) -> list[Row]:
        window, held = sliding.Sliding(self.span), sorted((tuple(k), tuple(v)) for k, v in self.recent.iterator())
        for (us, _), (port, dst, size) in held:
            window.add(us, port, dst, size)
        last = self.last.get()
        last = None if last is None else last[0]
        out, at = [], 0
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end].us == rows[at].us:
                end += 1
            if last is not None and rows[at].us > last + self.idle:  # the watermark passed its end and this row together
                out.append(self.end(key, last))
                window, last = sliding.Sliding(self.span), None
            window.forget(rows[at].us)
            for r in rows[at:end]:
                window.add(r.us, r.port, r.dst, r.len)
            values = dict(zip(("n", "fanout", "entropy", "bytes"), window.values(), strict=True))
            for r in rows[at:end]:
                out.append(Row(src=told(key), us=r.us, seq=r.seq, len=r.len, flags=r.flags, **values, gap_us=None if last is None else r.us - last, expired=False))
                last = r.us
            at = end
        for k, _ in held:
            if k[0] < last - self.span:
                self.recent.removeKey(k)
        for r in rows:
            if r.us >= last - self.span:
                self.recent.updateValue((r.us, r.seq), (r.port, r.dst, r.len))
        self.last.update((last,))
        return out

    def wake(self) -> int | None:
        last = self.last.get()
        return None if last is None else (last[0] + self.idle) // 1000 + 1

    def due(self, key: tuple, now_ms: int) -> list[Row]:
        last = self.last.get()
        if last is None or (last[0] + self.idle) // 1000 >= now_ms:
            return []
        self.recent.clear()
        self.last.clear()
        return [self.end(key, last[0])]

    def end(self, key: tuple, last: int) -> Row:
        return Row(src=told(key), us=last + self.idle, seq=None, len=None, flags=None, n=0, fanout=0, entropy=0.0, bytes=0.0, gap_us=None, expired=True)


def timed(df: DataFrame, key: str, late: str, **columns: str) -> DataFrame:
    """(no_key, key, us, seq, columns, at) with a watermark on at. A key is a text and whether it is null, as the state store keeps no null keys."""
    named = [F.col(c).cast(kind).alias(c) for c, kind in columns.items()]
    rows = df.filter(F.col("us").isNotNull()).select(F.col(key).isNull().alias("no_key"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col("us").cast("long").alias("us"), F.col("seq").cast("long").alias("seq"), *named)
    return rows.withColumn("at", F.timestamp_micros("us")).withWatermark("at", late)


def told(key: tuple) -> str | None:
    """The key of timed()."""
    return None if key[0] else key[1]


def features(flows: DataFrame, span_us: int = 2_000_000, iat_scale: float = 50.0, full_rate: float = 300.0, late: str = "10 seconds", idle_us: int = 3_600_000_000) -> DataFrame:
    """(src, us, seq, the seven features, expired) of a stream of flows, the same as windows.features gives for a table.

    A key that is silent for idle_us is forgotten, which is a row with expired
    set and null features; if it comes back, it starts anew. idle_us has to be
    longer than the span.
    """
    if idle_us <= span_us:
        raise ValueError("a key can't expire within its window")
    prepared(flows.sparkSession)
    rows = timed(flows, "src", late, port="int", dst="string", len="double", flags="int")
    out = rows.groupBy("no_key", "key").transformWithState(Features(span_us, idle_us), "src string, us long, seq long, len double, flags int, n long, fanout long, entropy double, bytes double, gap_us long, expired boolean", "Append", "EventTime")
    made = windows.seven(F.col("flags"), F.col("len"), *(F.col(c) for c in sliding.STATISTICS), span_us, iat_scale, full_rate)
    keep = lambda c: F.when(~F.col("expired"), c)
    return out.select(F.col("src").cast(flows.schema["src"].dataType).alias("src"), "us", "seq", *(keep(c).alias(k) for k, c in made.items()), "expired")


class Watch(InOrder):
    """A member's state from its beats: alive, suspect when phi reaches one level, dead at another, without any row that says so."""

    def __init__(self, suspect: float, dead: float, window: int, floor: float, first: float):
        super().__init__("us long, seq long")
        self.levels, self.window, self.floor, self.first = {"SUSPECT": suspect, "DEAD": dead}, window, floor, first

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.gaps = handle.getListState("gaps", "ms double")
        self.state = handle.getValueState("state", "last long, state string")

    def crossing(self, last_us: int, gaps: list[float], name: str) -> int | None:
        """The time in us at which phi reaches a level if no beat comes; None if it never does."""
        from ..operators.mesh import overdue_at

        overdue = overdue_at(self.levels[name], gaps, self.floor, self.first)
        return None if overdue is None else last_us + int(overdue * 1000) + 1

    def until(self, key: tuple, now_us: int, last: int, state: str, gaps: list[float]) -> tuple[str, list[Row]]:
        """The state at now_us without a beat since last, and the changes on the way."""
        out = []
        for name in ("SUSPECT", "DEAD"):
            at = self.crossing(last, gaps, name)
            if at is not None and at <= now_us and (state == "ALIVE" or (state, name) == ("SUSPECT", "DEAD")):
                state = name
                out.append(Row(node=told(key), us=at, state=name))
        return state, out

    def passed(self, key: tuple, rows: list[Row]) -> list[Row]:
        held, gaps, out = self.state.get(), [g for (g,) in self.gaps.get()], []
        last, state = (held[0], held[1]) if held is not None else (None, None)
        for r in rows:
            if last is not None:
                state, changed = self.until(key, r.us, last, state, gaps)
                out += changed
                gaps = [*gaps, (r.us - last) / 1000][-self.window :]
            if state != "ALIVE" and state != "DEAD":  # suspects recover; the dead stay dead
                state = "ALIVE"
                out.append(Row(node=told(key), us=r.us, state=state))
            last = r.us
        self.gaps.put([(g,) for g in gaps]) if gaps else self.gaps.clear()
        self.state.update((last, state))
        return out

    def wake(self) -> int | None:
        held = self.state.get()
        if held is None or held[1] == "DEAD":
            return None
        gaps = [g for (g,) in self.gaps.get()]
        at = self.crossing(held[0], gaps, "SUSPECT" if held[1] == "ALIVE" else "DEAD")
        return None if at is None else at // 1000 + 1

    def due(self, key: tuple, now_ms: int) -> list[Row]:
        held = self.state.get()
        if held is None:
            return []
        state, out = self.until(key, now_ms * 1000, held[0], held[1], [g for (g,) in self.gaps.get()])
        if out:
            self.state.update((held[0], state))
        return out


def watched(beats: DataFrame, late: str = "5 seconds", suspect: float = 8.0, dead: float = 9.5, window: int = 200, floor: float = 50.0, first: float = 750.0) -> DataFrame:
    """(node, us, state): changes of state of the members behind a stream of beats (node, us, seq).

    A member that falls silent turns suspect, then dead, at the times at which
    phi reaches the levels: timers fire when the others' beats move the watermark
    past them. Phi ends at 10, so levels above it are never reached.
    """
    if not 0 < suspect <= dead:
        raise ValueError("a member is suspected before it is dead")
    prepared(beats.sparkSession)
    rows = timed(beats, "node", late)
    return rows.groupBy("no_key", "key").transformWithState(Watch(suspect, dead, window, floor, first), "node string, us long, state string", "Append", "EventTime")
