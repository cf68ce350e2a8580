"""Views of the driver's tables as flow records, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query by its name; sql gives the same rows from the same tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as flow records: one day stands for the sliding window, as users are active a few times a day."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("seq"),
        us.alias("us"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src"),
        F.col("user_id").alias("uid"),
        kind.alias("dst"),
        F.get_json_object("props", "$.k").cast("int").alias("port"),
        F.when(F.col("user_id") % 3 == 0, "TCP").when(F.col("user_id") % 3 == 1, "UDP").otherwise("ICMP").alias("proto"),
        F.col("value").alias("len"),
        F.when(kind == "signup", 2).when(kind == "click", 18).when(kind == "view", 16).when(kind == "error", 2).otherwise(24).alias("flags"),
        (kind == "error").cast("int").alias("label"),
        kind.alias("family"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("score"),
    )


#: The same view, for the SQL side.
FLOWS = """flows AS (
  SELECT event_id AS seq, epoch_us(ts) AS us, 'u' || user_id AS src, user_id AS uid, event_type AS dst,
    CAST(json_extract_string(props, '$.k') AS INT) AS port,
    CASE user_id % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' ELSE 'ICMP' END AS proto, value AS len,
    CASE event_type WHEN 'signup' THEN 2 WHEN 'click' THEN 18 WHEN 'view' THEN 16 WHEN 'error' THEN 2 ELSE 24 END AS flags,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, event_type AS family, least(value / 500, 1.0) AS score
  FROM events)"""
DAY = 86_400_000_000
