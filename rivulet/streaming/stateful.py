"""The folds of rivulet.operators.folds on streams, and event-time windows.

State lives in Spark's state store by key, so a stream's memory doesn't grow
with its length; keys that stay silent are dropped after a time-out. A batch's
rows of a key are sorted by time first: within a micro-batch order is exact,
across batches it is arrival order, as for any online system.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import Step


def stream_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], dict], step: Step, schema: str, idle_ms: int = 0) -> DataFrame:
    """fold() on a stream: the same start and step. The state is kept as JSON. idle_ms: forget a key that is silent so long (0: never)."""
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = json.loads(state.get[0]) if state.exists else start()
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = []
        for row in rows.to_dict("records"):
            s, made = step(s, row)
            if made is not None:
                out.append(made)
        state.update((json.dumps(s),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out)

    return df.groupBy(*keys).applyInPandasWithState(work, schema, "state string", "append", timeout)


def windowed_counts(df: DataFrame, at: str, key: str, span: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and bytes of each key in tumbling windows; rows later than the watermark are dropped. (An addition: nothing like it came before.)"""
    return df.withWatermark(at, late).groupBy(F.window(at, span), key).agg(F.count("*").alias("n"), F.sum("len").alias("bytes")).select(F.col("window.start").alias("start"), key, "n", "bytes")


def sessions(df: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each key: rows no further apart than the gap."""
    return df.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), key, "n")


def deduplicated(df: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def to_sinks(stream: DataFrame, writers: dict[str, Callable[[DataFrame], None]], checkpoint: str):
    """Routes each micro-batch of alerts to writers by sink; one that fails doesn't stop the others, and its batch is reported."""
    from ..operators.alerts import routed

    failed: list[tuple[int, str, str]] = []

    def each(batch: DataFrame, number: int) -> None:
        rows = routed(batch).persist()
        try:
            for name, write in writers.items():
                try:
                    write(rows.filter(F.col("sink") == name).drop("sink"))
                except Exception as e:
                    failed.append((number, name, str(e)))
        finally:
            rows.unpersist()

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return query, failed
