"""Alerts: false-discovery control, campaigns, routing to sinks, stored events and audit records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flow as fx
from . import folds
from .discovery import rolling_cutoffs

#: Name and lowest severity that each sink takes. Fixed values.
SINKS = {"elastic": "low", "siem": "low", "slack": "medium", "rest": "high", "mail": "high", "pager": "critical"}


def discovery_cutoff(df: DataFrame, p: str = "p", q: float = 0.1, least: int = 20) -> DataFrame:
    """The Benjamini-Hochberg cutoff: the largest p that is at most its rank's share of q; q / n if none; 1 for few rows.

    Ties share their largest rank, so ranks come from counts by value, and only
    values that can qualify (p <= q) are ranked.
    """
    total = df.agg(F.count("*").alias("n"))
    groups = df.filter(F.col(p) <= q).groupBy(p).agg(F.count("*").alias("c"))
    buckets = groups.withColumn("b", F.least(F.lit(1023), F.floor(F.col(p) / q * 1024).cast("int")))
    offsets = buckets.groupBy("b").agg(F.sum("c").alias("t")).withColumn("before", F.coalesce(F.sum("t").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = buckets.join(F.broadcast(offsets), "b").withColumn("rank", F.col("before") + F.sum("c").over(Window.partitionBy("b").orderBy(p)))
    best = ranked.join(F.broadcast(total)).filter(F.col(p) <= q * F.col("rank") / F.col("n")).agg(F.max(p).alias("best"))
    return total.join(best).select(F.when(F.col("n") < least, 1.0).otherwise(F.coalesce("best", q / F.col("n"))).alias("cutoff"))


def campaigns(alerts: DataFrame, key: str = "src") -> DataFrame:
    """One row a source: alerts, first time, and the actions taken."""
    return alerts.groupBy(key).agg(F.count("*").alias("alerts"), F.min("us").alias("first"), F.array_join(F.array_sort(F.collect_set("action")), ",").alias("actions"))


def enriched(alerts: DataFrame, key: str = "src") -> DataFrame:
    """alerts with their number in the campaign, an id, a flow id and 1 - score."""
    w = Window.partitionBy(key).orderBy("us", "seq")
    out = alerts.withColumn("campaign_count", F.row_number().over(w))
    return out.withColumns({"alert_id": fx.alert_id(F.col("us") / 1e6, F.col("campaign_count")), "flow_id": fx.flow_id(F.col("src"), F.col("dst"), F.col("port")), "fdr_p": F.round(1 - F.col("score"), 4), "lifecycle": F.lit("new")})


def process(events: DataFrame, dedup_us: int = 3_000_000, q: float = 0.1, window: int = 500) -> DataFrame:
    """Alerts of events (seq, us, src, dst, port, action, score): repeats by source and action go (quarantines never), then advisory ones whose p = 1 - score is over the false-discovery cutoff of the last `window` events, repeats among them; what is left joins its source's campaign."""

    def step(s: dict, row: dict) -> tuple[dict, dict | None]:
        s, shown = folds.dedup_step(s, row["us"], dedup_us, row["action"] == "QUARANTINE")
        return s, {"seq": row["seq"]} if shown else None

    first = folds.fold(events.select("src", "action", "us", "seq"), ["src", "action"], ["us", "seq"], folds.dedup_start, step, "seq long")
    judged = rolling_cutoffs(events.withColumn("__small", 1 - F.col("score")), "__small", window, q)
    passed = judged.join(first, "seq", "left_semi").filter(F.col("action").isin(*fx.ENFORCING) | (F.col("__small") <= F.col("cutoff")))
    return enriched(passed.select(*events.columns))


def statistics(events: DataFrame, shown: DataFrame, q: float = 0.1, window: int = 500) -> DataFrame:
    """One row: alerts offered, suppressed, the false-discovery cutoff of the last `window` events, and campaigns."""
    total = events.agg(F.count("*").alias("alerts_total"))
    left = shown.agg(F.count("*").alias("__left"), F.count_distinct("src").alias("active_campaigns"))
    cutoff = discovery_cutoff(recent(events.select("us", "seq", (1 - F.col("score")).alias("p")), window), q=q).select(F.round("cutoff", 4).alias("bh_cutoff"))
    return total.join(left).join(cutoff).select("alerts_total", (F.col("alerts_total") - F.col("__left")).alias("alerts_suppressed"), "bh_cutoff", "active_campaigns")


def sink_settings(values: dict[str, str], prefix: str = "RIVULET_SINK_") -> dict[str, str]:
    """SINKS with the floors that settings name, such as RIVULET_SINK_SLACK=high; "off" takes a sink out. values may be os.environ."""
    floors = {k: values.get(prefix + k.upper(), v).lower() for k, v in SINKS.items()}
    unknown = [v for v in floors.values() if v != "off" and v not in fx.SEVERITY_RANK]
    if unknown:
        raise ValueError(f"no such severity: {unknown[0]}")
    return {k: v for k, v in floors.items() if v != "off"}


def routed(alerts: DataFrame, sinks: dict[str, str] | None = None) -> DataFrame:
    """alerts, once for each sink whose floor their severity reaches."""
    floors = F.array(*(F.struct(F.lit(k).alias("sink"), F.lit(fx.SEVERITY_RANK[v]).alias("floor")) for k, v in (sinks or SINKS).items()))
    each = alerts.withColumn("s", F.explode(floors))
    return each.filter((fx.severity_rank(F.col("severity")) >= F.col("s.floor")) & (F.col("severity") != "info")).withColumn("sink", F.col("s.sink")).drop("s")


def rate_limited(sent: DataFrame, per_minute: float = 120.0, burst: float = 30.0) -> DataFrame:
    """routed() alerts (sink, us, seq, ...) with passed: whether the sink's token bucket still has one for it. A state a sink, in order of time; nothing else waits for it."""

    def step(s: dict, row: dict) -> tuple[dict, dict]:
        s, ok = folds.bucket_step(s, row["us"] / 1e6, per_minute / 60, burst)
        return s, {"sink": row["sink"], "seq": row["seq"], "passed": ok}

    kind = sent.schema["seq"].dataType.simpleString()
    ok = folds.fold(sent.select("sink", "us", "seq"), ["sink"], ["us", "seq"], folds.bucket_start(burst), step, f"sink string, seq {kind}, passed boolean")
    return sent.join(ok, ["sink", "seq"])


def audit(df: DataFrame, kind: Column, *detail: str) -> DataFrame:
    """(us, kind, detail): records whose details are JSON with sorted keys."""
    return df.select("us", kind.alias("kind"), F.to_json(F.struct(*sorted(detail))).alias("detail"))


def recent(df: DataFrame, n: int = 200) -> DataFrame:
    """The last n rows by time: a top-k, never a full sort."""
    return df.orderBy(F.desc("us"), F.desc("seq")).limit(n)


def exposition(metrics: DataFrame) -> DataFrame:
    """(line) in the text format of metric scrapers, for (name, kind, help, labels map, value)."""
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    sample = F.concat(F.col("name"), F.when(F.size("labels") > 0, F.concat(F.lit("{"), labels, F.lit("}"))).otherwise(""), F.lit(" "), F.when(F.col("value") == F.floor("value"), F.floor("value").cast("string")).otherwise(F.col("value").cast("string")))
    first = F.row_number().over(Window.partitionBy("name").orderBy(labels)) == 1
    head = F.array(F.concat(F.lit("# HELP "), "name", F.lit(" "), "help"), F.concat(F.lit("# TYPE "), "name", F.lit(" "), "kind"))
    return metrics.withColumn("first", first).select("name", F.explode(F.when(F.col("first"), F.concat(head, F.array(sample))).otherwise(F.array(sample))).alias("line"))
