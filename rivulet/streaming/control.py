"""Settings and rules that change while a stream runs.

A change of a setting is a row (us, seq, name, value) and holds from its time until
the next one: a row is judged by what was set when it happened, however late it is
processed. Proposed rules wait in a queue of fixed length, kept as state by queue;
approving one is a row too. A batch enforces the rules that were approved before it
began, so a batch that runs again does the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from . import timed

DAY_US = 86_400_000_000
CHANGES = "us long, seq long, name string, value double"


def settings_at(rows: DataFrame, changes: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """rows (us, ...) with a column for each name of defaults: the value in force at the row's time.

    A value's time is cut into days, and rows meet it by name and day: an equal
    join, whatever the number of changes. Of changes at one time the one with the
    largest seq counts; changes without a time or value don't. Rows without a
    time have the defaults.
    """
    ends = rows.agg(F.min("us").alias("a"), F.max("us").alias("b")).first()
    out = rows.withColumn("__day", F.floor(F.col("us") / DAY_US).cast("long"))
    for name, default in defaults.items():
        own = changes.filter((F.col("name") == name) & F.col("us").isNotNull() & F.col("value").isNotNull())
        until = F.lead("us").over(Window.partitionBy("name").orderBy("us", "seq"))
        spans = own.select(F.col("us").alias("__from"), F.coalesce(until, F.lit(2**62)).alias("__until"), F.col("value").alias("__value")).filter("__from < __until")
        if ends.a is None:
            spans = spans.limit(0).withColumn("__on", F.lit(0).cast("long"))
        else:
            spans = spans.filter((F.col("__until") > ends.a) & (F.col("__from") <= ends.b))
            first, last = F.greatest(F.col("__from"), F.lit(ends.a)), F.least(F.col("__until") - 1, F.lit(ends.b))
            spans = spans.withColumn("__on", F.explode(F.sequence(F.floor(first / DAY_US).cast("long"), F.floor(last / DAY_US).cast("long"))))
        held = (F.col("__day") == F.col("__on")) & (F.col("us") >= F.col("__from")) & (F.col("us") < F.col("__until"))
        out = out.join(spans, held, "left").withColumn(name, F.coalesce("__value", F.lit(float(default)))).drop("__from", "__until", "__value", "__on")
    return out.drop("__day")


class Queue(timed.InOrder):
    """Proposed rules of a queue, oldest first. State: a list of (rule, body)."""

    def __init__(self, most: int):
        super().__init__("us long, seq long, kind string, rule string, body string")
        self.most = most

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "rule string, body string")

    def passed(self, key: tuple, rows: list[Row]) -> list[Row]:
        waiting = dict(tuple(r) for r in self.waiting.get())
        out = []
        say = lambda r, rule, body, status: out.append(Row(queue=timed.told(key), us=r.us, rule=rule, body=body, status=status))
        for r in rows:
            if r.kind == "proposed":
                if r.rule in waiting:
                    continue
                waiting[r.rule] = r.body
                say(r, r.rule, r.body, "pending")
                if len(waiting) > self.most:
                    oldest = next(iter(waiting))
                    say(r, oldest, waiting.pop(oldest), "dropped")
            elif r.kind in ("approved", "rejected"):
                say(r, r.rule, waiting[r.rule], r.kind) if r.rule in waiting else say(r, r.rule, None, "unknown")
                waiting.pop(r.rule, None)
        self.waiting.put(list(waiting.items())) if waiting else self.waiting.clear()
        return out


def rule_queue(events: DataFrame, late: str = "1 second", most: int = 50) -> DataFrame:
    """(queue, us, rule, body, status) of a stream of (queue, us, seq, kind: proposed, approved or rejected, rule, body).

    A rule is pending once; of more than `most` the oldest is dropped. Approving
    what isn't pending gives the status unknown, so nothing is enforced that was
    never proposed.
    """
    timed.prepared(events.sparkSession)
    rows = timed.timed(events, "queue", late, kind="string", rule="string", body="string")
    return rows.groupBy("no_key", "key").transformWithState(Queue(most), "queue string, us long, rule string, body string, status string", "Append", "EventTime")


RULE = "src string, proto string, action string"


class Enforcer:
    """Writes each batch of decisions with the settings of its rows' times and the rules approved before the batch.

    folder/changes: tables of CHANGES; folder/rules: what rule_queue says. Both
    may grow while the stream runs. folder/batches: the rules of each batch, as
    it first saw them; folder/enforced: the results.
    """

    def __init__(self, spark: SparkSession, folder: str, defaults: dict[str, float]):
        self.spark, self.folder, self.defaults = spark, folder.rstrip("/"), defaults

    def _there(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path) if self._there(path) else self.spark.createDataFrame([], schema)

    def change(self, us: int, seq: int, name: str, value: float) -> None:
        if name not in self.defaults:
            raise ValueError(f"no such setting: {name}")
        self.spark.createDataFrame([(us, seq, name, float(value))], CHANGES).coalesce(1).write.mode("append").parquet(f"{self.folder}/changes")

    def rules(self, number: int) -> DataFrame:
        """(rule, src, proto, action): approved when batch `number` first began; kept, so that it is the same if the batch runs again."""
        path = f"{self.folder}/batches/batch={number}"
        if not self._there(f"{path}/_SUCCESS"):
            said = self._read("rules", "queue string, us long, rule string, body string, status string").filter("status = 'approved'")
            parsed = said.select("rule", F.from_json("body", RULE).alias("r")).filter(F.col("r.action").isNotNull()).select("rule", "r.*")
            parsed.dropDuplicates(["rule"]).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(f"rule string, {RULE}").parquet(path)

    def process(self, batch: DataFrame, number: int) -> None:
        """rows (us, src, proto, action, ...) get their settings, and the action of a rule for their source (and protocol, if it names one); of several the smallest rule."""
        held = settings_at(batch, self._read("changes", CHANGES), self.defaults)
        rules = self.rules(number).select(F.col("rule"), F.col("src").alias("__src"), F.col("proto").alias("__proto"), F.col("action").alias("__action"))
        by_source = rules.groupBy("__src").agg(F.sort_array(F.collect_list(F.struct("rule", "__proto", "__action"))).alias("__rules"))  # as many as people approved for a source
        met = held.join(by_source, F.col("src") == F.col("__src"), "left")
        fit = F.filter("__rules", lambda r: r["__proto"].isNull() | (r["__proto"] == F.col("proto")))
        first = F.get(F.coalesce(fit, F.array().cast(T.ArrayType(by_source.schema["__rules"].dataType.elementType))), F.lit(0))
        out = met.withColumn("__r", first).withColumns({"rule": F.col("__r.rule"), "action": F.coalesce("__r.__action", "action")})
        out.drop("__src", "__rules", "__r").write.mode("overwrite").parquet(f"{self.folder}/enforced/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/enforced")
