"""Writers: packet decisions as CSV, events and audit records as Parquet, evaluation tables, and a source by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import capture, labelled, ndjson


def decision_lines(df: DataFrame) -> DataFrame:
    """Decisions with fixed decimals, as text columns."""
    fixed = {"score": 6, "fdr_p": 5, "susp": 3}
    return df.select(*(F.format_string(f"%.{fixed[c]}f", F.col(c)).alias(c) if c in fixed else F.col(c) for c in df.columns))


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).csv(path)


def append_events(df: DataFrame, path: str) -> None:
    """Adds to an event or audit store, partitioned by day so that reads by time are pruned."""
    df.withColumn("day", F.floor(F.col("us") / 86_400_000_000).cast("long")).write.mode("append").partitionBy("day").parquet(path)


def evaluation(metrics: DataFrame) -> DataFrame:
    """One row of metrics as (metric, value) rows."""
    return metrics.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in metrics.columns))).alias("m")).select("m.*")


def make_source(spark: SparkSession, kind: str, **options) -> DataFrame:
    """Flow records of a source by its kind: sim, csv (or dataset), pcap, loader."""
    if kind == "sim":
        from .simulated import SimulatedFlows

        spark.dataSource.register(SimulatedFlows)
        return spark.read.format("rivulet_sim").options(**{k: str(v) for k, v in options.items()}).load()
    if kind in ("csv", "dataset"):
        return labelled.flow_records(labelled.raw(spark, options["path"]))
    if kind == "pcap":
        return capture.read(spark, options["path"])
    if kind in ("loader", "ebpf"):
        return ndjson.records(ndjson.parsed(spark.read.text(options["path"]), "flow"))
    raise ValueError(f"no source of kind {kind}")
