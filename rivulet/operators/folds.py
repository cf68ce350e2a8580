"""Order-dependent state machines, one state a key.

``fold`` runs a step function over each key's rows in order. Rows are dealt by
key, sorted in their partition by Spark (which spills) and streamed through
Python, so a task holds one state and one batch, never a group. The same step
functions run in rivulet.streaming. Where a fold has a closed form, the form is
given too, as an aggregate or a window.
"""

from __future__ import annotations

import bisect
import math
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Step = Callable[[dict, dict], tuple[dict, dict | None]]


def fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], dict], step: Step, schema: str) -> DataFrame:
    """step(state, row) gives the next state and an output row (or None). Rows with a null key form one key."""
    columns = df.columns
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), {}
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                key = tuple(None if pd.isna(row[k]) else row[k] for k in keys)
                if key != last:
                    last, state = key, start()
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
            if out:
                yield pd.DataFrame(out)

    return dealt.select(*columns).mapInPandas(work, schema)


# --- steps -----------------------------------------------------------------
def trust_start() -> dict:
    return {"a": 1.0, "b": 1.0, "seen": 0}


def trust_step(s: dict, malicious: float, weight: float = 1.0, forget_good: float = 0.98, forget_bad: float = 0.995, cap: float = 1.0) -> dict:
    """Reputation of an entity: good evidence is forgotten faster than bad."""
    inc = min(weight, cap)
    return {"a": s["a"] * forget_good + inc * (1 - malicious), "b": s["b"] * forget_bad + inc * malicious, "seen": s["seen"] + 1}


def threshold_start() -> dict:
    return {"tau": 0.6, "t": 0}


def threshold_step(s: dict, score: float, weight: float = 1.0, budget: float = 0.02, gain: float = 2.5, delay: float = 40.0, floor: float = 0.01) -> dict:
    """A quantile tracker that keeps the share of benign scores over it at the budget."""
    t = s["t"] + 1
    move = min(weight, 5.0) * max(gain / (t + delay), floor) * ((1.0 if score > s["tau"] else 0.0) - budget)
    return {"tau": min(0.999, max(0.05, s["tau"] + move)), "t": t}


def hedge_start(k: int) -> Callable[[], dict]:
    return lambda: {"w": [1.0 / k] * k}


def hedge_step(s: dict, signals: list[float], label: float, share: float = 0.02) -> dict:
    """Expert weights: exponential in the squared error, mixed with equal shares."""
    k = len(signals)
    rate = math.sqrt(8 * math.log(max(k, 2)) / 1000)
    w = [v * math.exp(-rate * (x - label) ** 2) for v, x in zip(s["w"], signals, strict=True)]
    total = sum(w)
    w = [(1 - share) * v / total + share / k for v in w]
    total = sum(w)
    return {"w": [v / total for v in w]}


def budget_start() -> dict:
    return {"b": 20.0}


def budget_step(s: dict, cap: float = 20.0, refill: float = 0.05) -> tuple[dict, bool]:
    """Bounded influence: may this entity's event teach?"""
    b = s["b"]
    return ({"b": b - 1.0}, True) if b >= 1 else ({"b": min(cap, b + refill)}, False)


def drift_start() -> dict:
    return {"m": 0.0}


def drift_step(s: dict, p: float, power: float = 0.92, alarm: float = 100.0) -> tuple[dict, float, bool]:
    """A power martingale of p-values: (state, level before any reset, alarm)."""
    p = min(max(p, 1e-6), 1.0)
    level = max(0.0, s["m"] + math.log(power) + (power - 1) * math.log(p))
    return ({"m": 0.0}, level, True) if level > math.log(alarm) else ({"m": level}, level, False)


def bucket_start(burst: float) -> Callable[[], dict]:
    return lambda: {"tokens": burst, "at": None}


def bucket_step(s: dict, now: float, rate: float, burst: float) -> tuple[dict, bool]:
    """A token bucket; a clock that goes back refills nothing."""
    since = 0.0 if s["at"] is None else max(0.0, now - s["at"])
    tokens = min(burst, s["tokens"] + since * rate)
    return ({"tokens": tokens - 1, "at": now}, True) if tokens >= 1 else ({"tokens": tokens, "at": now}, False)


def dedup_start() -> dict:
    return {"last": None}


def dedup_step(s: dict, now: float, window: float, exempt: bool) -> tuple[dict, bool]:
    """Whether an alert is shown: not within the window of the last one shown, unless exempt."""
    if s["last"] is not None and now - s["last"] < window and not exempt:
        return s, False
    return {"last": now}, True


def canary_start() -> dict:
    return {"active": [0, 0], "canary": None, "version": 1, "made": 1, "promoted": 0, "rolled_back": 0}


def canary_step(s: dict, drift: bool, active_right: bool, canary_right: bool, needed: int = 200, margin: float = 0.01) -> dict:
    """A model registry: drift starts a canary, which after enough rows is promoted if clearly better, else dropped."""
    s = dict(s, active=list(s["active"]), canary=None if s["canary"] is None else list(s["canary"]))
    if drift and s["canary"] is None:
        s["canary"] = [0, 0]
    s["active"] = [s["active"][0] + int(active_right), s["active"][1] + 1]
    if s["canary"] is not None:
        s["canary"] = [s["canary"][0] + int(canary_right), s["canary"][1] + 1]
        if s["canary"][1] >= needed:
            if s["canary"][0] / s["canary"][1] > s["active"][0] / s["active"][1] + margin:
                s |= {"active": s["canary"], "version": s["made"] + 1, "made": s["made"] + 1, "promoted": s["promoted"] + 1}
            else:
                s["rolled_back"] += 1
            s["canary"] = None
    return s


def gaussian_start(n: int) -> Callable[[], dict]:
    return lambda: {"mean": [0.0] * n, "var": [1.0] * n}


def gaussian_step(s: dict, x: list[float], decay: float = 0.001) -> tuple[dict, float]:
    """Distance from slowly moving means and variances."""
    d = math.sqrt(sum((v - m) ** 2 / (q + 1e-6) for v, m, q in zip(x, s["mean"], s["var"], strict=True)) / len(x))
    mean = [(1 - decay) * m + decay * v for v, m in zip(x, s["mean"], strict=True)]
    var = [(1 - decay) * q + decay * (v - m) ** 2 for v, m, q in zip(x, mean, s["var"], strict=True)]
    return {"mean": mean, "var": var}, 1 - math.exp(-0.9 * d)


# --- the last numbers of a key ---------------------------------------------
class Recent:
    """The last `window` numbers, kept sorted."""

    def __init__(self, window: int):
        self.window, self.queue, self.sorted = window, deque(), []

    def __len__(self) -> int:
        return len(self.sorted)

    def add(self, v: float) -> None:
        if len(self.queue) == self.window:
            del self.sorted[bisect.bisect_left(self.sorted, self.queue.popleft())]
        self.queue.append(v)
        bisect.insort(self.sorted, v)

    def at_least(self, v: float) -> int:
        return len(self.sorted) - bisect.bisect_left(self.sorted, v)

    def at_most(self, v: float) -> int:
        return bisect.bisect_right(self.sorted, v)


def recent_conformal(df: DataFrame, keys: list[str], score: str, benign: str, window: int = 2000, warm: int = 50) -> DataFrame:
    """(seq, p): each row against the last `window` benign scores of its key before it; a logistic of the score until there are `warm` of them. windows.conformal is the batch form over the whole sample."""

    def step(s: dict, row: dict) -> tuple[dict, dict]:
        n = len(s["recent"])
        p = 1 / (1 + math.exp(3 * (row[score] - 0.5))) if n < warm else (1 + s["recent"].at_least(row[score])) / (n + 1)
        if row[benign]:
            s["recent"].add(row[score])
        return s, {"seq": row["seq"], "p": p}

    return fold(df.select(*keys, "us", "seq", score, benign), keys, ["us", "seq"], lambda: {"recent": Recent(window)}, step, "seq long, p double")


def recent_ecod(df: DataFrame, keys: list[str], columns: list[str], window: int = 1000, least: int = 20) -> DataFrame:
    """(seq, ecod): surprise of each row under the distribution of its key's last `window` rows before it; none until there are `least`. windows.ecod is the batch form."""

    def surprise(recent: Recent, v: float) -> float:
        if len(recent) < least:
            return 0.0
        share = recent.at_most(v) / (len(recent) + 1)
        return -math.log(max(1 - share if share > 0.5 else share, 1e-9))

    def step(s: dict, row: dict) -> tuple[dict, dict]:
        total = sum(surprise(s[c], row[c]) for c in columns)
        for c in columns:
            s[c].add(row[c])
        return s, {"seq": row["seq"], "ecod": 1 - math.exp(-total / (2.5 * len(columns)))}

    return fold(df.select(*keys, "us", "seq", *columns), keys, ["us", "seq"], lambda: {c: Recent(window) for c in columns}, step, "seq long, ecod double")


def recent_open_set(df: DataFrame, keys: list[str], columns: list[str], window: int = 500, least: int = 30) -> DataFrame:
    """(seq, unknown, novelty): distance of each row from its key's last `window` rows before it, against the 97th percentile of their own. windows.open_set is the form by blocks."""

    def step(s: dict, row: dict) -> tuple[dict, dict]:
        x, past = np.array([row[c] for c in columns], float), s["past"]
        unknown, novelty = False, 0.0
        if len(past) >= least:
            seen = np.array(past)
            mean, spread = seen.mean(0), seen.std(0) + 1e-6
            far = lambda v: np.sqrt((((v - mean) / spread) ** 2).mean(-1))
            gate, own = float(np.percentile(far(seen), 97)), float(far(x))
            unknown, novelty = own > 1.15 * gate, min(1.0, max(0.0, own / (gate + 1e-6) - 1)) if own > gate else 0.0
        past.append(x)
        return s, {"seq": row["seq"], "unknown": bool(unknown), "novelty": novelty}

    return fold(df.select(*keys, "us", "seq", *columns), keys, ["us", "seq"], lambda: {"past": deque(maxlen=window)}, step, "seq long, unknown boolean, novelty double")


# --- closed forms ----------------------------------------------------------
def trust_final(df: DataFrame, key: str, malicious: Column, forget_good: float = 0.98, forget_bad: float = 0.995) -> DataFrame:
    """The last trust state of each key, as discounted sums: no order-dependent step is left."""
    w = Window.partitionBy(key)
    age = F.count("*").over(w) - F.row_number().over(w.orderBy("us", "seq"))
    aged = df.select(key, malicious.cast("double").alias("m"), age.alias("age"))
    out = aged.groupBy(key).agg(
        F.count("*").alias("seen"),
        (F.pow(F.lit(forget_good), F.count("*")) + F.sum(F.pow(F.lit(forget_good), F.col("age")) * (1 - F.col("m")))).alias("a"),
        (F.pow(F.lit(forget_bad), F.count("*")) + F.sum(F.pow(F.lit(forget_bad), F.col("age")) * F.col("m"))).alias("b"),
    )
    return out.withColumn("trust", F.col("a") / (F.col("a") + F.col("b")))


def drift_level(p: Column, key: str, power: float = 0.92) -> Column:
    """The martingale's level up to its first alarm: a sum less its running minimum (0 at most)."""
    w = Window.partitionBy(key).orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(math.log(power) + (power - 1) * F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-6)))).over(w)
