"""Decisions on a stream whose learning is carried from batch to batch.

Each micro-batch is scored with what the batches before it have taught: weights of
the signals, thresholds by context, the last benign scores of each signal, and the
trust of each source. Then the batch teaches the next version. Versions are tables
in a shared folder; a version counts once its last table is there, and batch n makes
version n + 1 of version n and nothing else. So a batch that is run again after a
failure, or after a restart, learns nothing twice and decides as before.

Trust is a table by source, updated by discounted sums (the closed form of the
step by step rule). The rest has a fixed size: weights, a threshold a context, and the
last ``window`` benign scores a signal, which tasks get as sorted arrays, so p-values
need no join. Within a batch weights and thresholds stay; a batch's losses and
exceedances move them once.

Rows without seq, us, src or a finite signal are rejected with a reason, and stored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import flow as fx
from ..operators import engine

FORGET_GOOD, FORGET_BAD = 0.98, 0.995


@dataclass
class Learned:
    """What a version holds besides trust."""

    weights: list[float]
    thresholds: dict[str, tuple[float, int]] = field(default_factory=dict)
    recent: dict[str, list[tuple[int, int, float]]] = field(default_factory=dict)  # (us, seq, score), oldest first


class Learner:
    def __init__(self, spark: SparkSession, folder: str, signals: list[str], budget: float = 0.02, window: int = 2000, warm: int = 50, context: str = "proto"):
        self.spark, self.folder, self.signals = spark, folder.rstrip("/"), signals
        self.budget, self.window, self.warm, self.context = budget, window, warm, context

    # --- versions ---------------------------------------------------------
    def path(self, version: int, name: str) -> str:
        return f"{self.folder}/state/version={version}/{name}"

    def complete(self, version: int) -> bool:
        """Version 0 is the empty one; another counts once its last table has been written."""
        done = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(version, "params") + "/_SUCCESS")
        return version == 0 or done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done)

    def load(self, version: int) -> tuple[Learned, DataFrame]:
        trust = "src string, a double, b double, seen long"
        k = len(self.signals)
        if version == 0:
            return Learned([1 / k] * k), self.spark.createDataFrame([], trust)
        row = self.spark.read.parquet(self.path(version, "params")).first()
        recent: dict[str, list[tuple[int, int, float]]] = {s: [] for s in self.signals}
        for r in self.spark.read.parquet(self.path(version, "recent")).collect():  # window rows a signal
            recent[r.signal].append((r.us, r.seq, r.score))
        return Learned(list(row.weights), {t.context: (t.tau, t.t) for t in row.thresholds}, {s: sorted(v) for s, v in recent.items()}), self.spark.read.schema(trust).parquet(self.path(version, "trust"))

    # --- one batch --------------------------------------------------------
    def judged(self, rows: DataFrame) -> DataFrame:
        """rows with reason: why a row can't be scored, null if it can."""
        reason = F.when(F.col("seq").isNull(), "no seq").when(F.col("us").isNull(), "no time").when(F.col("src").isNull(), "no source")
        for s in self.signals:
            v = F.col(s).cast("double")
            reason = reason.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), f"no {s}")
        return rows.withColumn("reason", reason)

    def p_values(self, rows: DataFrame, learned: Learned) -> DataFrame:
        """rows with p_<signal>: against the benign scores of the versions before, a logistic of the score until there are enough."""
        sent = self.spark.sparkContext.broadcast({s: np.sort([v for *_, v in learned.recent.get(s, [])]) for s in self.signals})
        names, signals, warm = rows.columns, self.signals, self.warm

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = []
                for s in signals:
                    x, held = batch.column(s).to_numpy(zero_copy_only=False).astype(float), sent.value[s]
                    n = len(held)
                    made.append(pa.array(1 / (1 + np.exp(3 * (x - 0.5))) if n < warm else (1 + n - np.searchsorted(held, x)) / (n + 1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, *(f"p_{s}" for s in signals)])

        return rows.mapInArrow(work, T.StructType([*rows.schema.fields, *(T.StructField(f"p_{s}", T.DoubleType()) for s in self.signals)]))

    def decide(self, rows: DataFrame, learned: Learned, trust: DataFrame) -> DataFrame:
        """rows with raw, suspicion, score, high, low, action and severity, by what was learned before."""
        out = self.p_values(rows, learned)
        raw = sum((w * (1 - F.col(f"p_{s}")) for w, s in zip(learned.weights, self.signals, strict=True)), F.lit(0.0))
        known = trust.select(F.col("src").alias("__src"), fx.suspicion(F.col("a"), F.col("b"), F.col("seen")).alias("suspicion"))
        at = F.lit(0.6)
        for context, (tau, _) in sorted(learned.thresholds.items()):
            at = F.when(F.col(self.context) == context, tau).otherwise(at)
        out = out.withColumn("raw", raw).join(known, F.col("src").cast("string") == F.col("__src"), "left").drop("__src").withColumn("suspicion", F.coalesce("suspicion", F.lit(0.5)))
        out = out.withColumns({"score": fx.trust_modulated(F.col("raw"), F.col("suspicion")), "high": at, "low": F.greatest(F.lit(0.05), at - 0.08)})
        d = fx.choose_action(F.col("score"), F.col("high"), F.col("low"), F.col("suspicion"), F.lit(False))
        return out.withColumn("d", d).select("*", "d.action", "d.severity").drop("d", *(f"p_{s}" for s in self.signals))

    def taught(self, decided: DataFrame, learned: Learned, trust: DataFrame) -> tuple[Learned, DataFrame]:
        """The next version: what labelled rows teach."""
        rows = decided.filter(F.col("label").isNotNull())
        p = self.p_values(rows, learned)
        label, benign = F.col("label").cast("double"), F.col("label") == 0
        losses = p.agg(*(F.coalesce(F.sum((1 - F.col(f"p_{s}") - label) ** 2), F.lit(0.0)).alias(s) for s in self.signals)).first()
        k = len(self.signals)
        rate, fixed = math.sqrt(8 * math.log(max(k, 2)) / 1000), 0.02
        logs = [math.log(w) - rate * losses[s] for w, s in zip(learned.weights, self.signals, strict=True)]
        grown = [math.exp(v - max(logs)) for v in logs]
        weights = [(1 - fixed) * g / sum(grown) + fixed / k for g in grown]

        thresholds = dict(learned.thresholds)
        over = rows.filter(benign).groupBy(F.coalesce(F.col(self.context).cast("string"), F.lit("")).alias("c")).agg(F.count("*").alias("n"), F.avg((F.col("raw") > F.col("high")).cast("double")).alias("share"))
        for r in over.collect():  # a row a context
            tau, t = thresholds.get(r.c, (0.6, 0))
            gain = min(1.0, sum(max(2.5 / (t + i + 40.0), 0.01) for i in range(1, min(r.n, 5000) + 1)))
            thresholds[r.c] = (min(0.999, max(0.05, tau + gain * (r.share - self.budget))), t + r.n)

        recent = {}
        for s in self.signals:
            last = rows.filter(benign).select("us", "seq", F.col(s).cast("double").alias("v")).orderBy(F.desc("us"), F.desc("seq")).limit(self.window).collect()
            recent[s] = sorted(learned.recent.get(s, []) + [(r.us, r.seq, r.v) for r in last])[-self.window :]
        return Learned(weights, thresholds, recent), self.trusted(rows, trust, label)

    def trusted(self, rows: DataFrame, trust: DataFrame, label: Column) -> DataFrame:
        """Trust after rows, in order: what was there fades by the number of rows, each row by those after it."""
        from pyspark.sql import Window

        w = Window.partitionBy("src")
        aged = rows.select(F.col("src").cast("string").alias("src"), label.alias("m"), (F.count("*").over(w) - F.row_number().over(w.orderBy("us", "seq"))).alias("age"))
        new = aged.groupBy("src").agg(F.count("*").alias("n"), F.sum(F.pow(F.lit(FORGET_GOOD), F.col("age")) * (1 - F.col("m"))).alias("good"), F.sum(F.pow(F.lit(FORGET_BAD), F.col("age")) * F.col("m")).alias("bad"))
        met = trust.join(new, "src", "full_outer")
        n, held = F.coalesce("n", F.lit(0)), lambda c: F.coalesce(c, F.lit(1.0))
        return met.select("src", (held("a") * F.pow(F.lit(FORGET_GOOD), n) + F.coalesce("good", F.lit(0.0))).alias("a"), (held("b") * F.pow(F.lit(FORGET_BAD), n) + F.coalesce("bad", F.lit(0.0))).alias("b"), (F.coalesce("seen", F.lit(0)) + n).cast("long").alias("seen"))

    def save(self, version: int, learned: Learned, trust: DataFrame) -> None:
        """params come last: with them the version is complete."""
        trust.write.mode("overwrite").parquet(self.path(version, "trust"))
        rows = [(s, us, seq, v) for s, held in learned.recent.items() for us, seq, v in held]
        self.spark.createDataFrame(rows, "signal string, us long, seq long, score double").coalesce(1).write.mode("overwrite").parquet(self.path(version, "recent"))
        params = [(learned.weights, [(c, tau, t) for c, (tau, t) in sorted(learned.thresholds.items())])]
        self.spark.createDataFrame(params, "weights array<double>, thresholds array<struct<context string, tau double, t long>>").coalesce(1).write.mode("overwrite").parquet(self.path(version, "params"))

    def process(self, batch: DataFrame, number: int) -> None:
        """Batch n by version n; for foreachBatch."""
        if self.complete(number + 1):
            return  # run again after its version had been made: decided and learned already
        if not self.complete(number):
            raise RuntimeError(f"version {number} is missing: the checkpoint and the state folder don't belong together")
        learned, trust = self.load(number)
        judged = engine.cut(self.judged(batch))
        judged.filter(F.col("reason").isNotNull()).write.mode("overwrite").parquet(f"{self.folder}/rejected/batch={number}")
        self.decide(judged.filter(F.col("reason").isNull()).drop("reason"), learned, trust).write.mode("overwrite").parquet(f"{self.folder}/decided/batch={number}")
        decided = self.spark.read.parquet(f"{self.folder}/decided/batch={number}")
        self.save(number + 1, *self.taught(decided, learned, trust))

    def start(self, stream: DataFrame, checkpoint: str, before: Callable[[DataFrame, int], None] | None = None):
        """The running query over what is there. before: called with each batch first (tests make it fail)."""

        def each(batch: DataFrame, number: int) -> None:
            if before is not None:
                before(batch, number)
            self.process(batch, number)

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def table(self, name: str) -> DataFrame:
        """decided or rejected, of all batches."""
        return self.spark.read.parquet(f"{self.folder}/{name}")


def replayed(flows: DataFrame, folder: str, signals: list[str], span_us: int, **options) -> DataFrame:
    """Decisions on a table in batches of time: each span is a batch, taught by those before it. Nothing is decided by what came later."""
    learner = Learner(flows.sparkSession, folder, signals, **options)
    number = F.floor(F.col("us") / span_us).cast("long")
    for n, r in enumerate(flows.filter(F.col("us").isNotNull()).select(number.alias("n")).distinct().orderBy("n").collect()):  # a row a span
        learner.process(flows.filter(number == r.n), n)
    return learner.table("decided")
