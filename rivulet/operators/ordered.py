"""Global orders without a single task: running totals and ranks by ranges of the ordering value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_bucket(value: Column, low: float | Column, high: float | Column, buckets: int) -> Column:
    span = F.when(F.lit(high) == F.lit(low), 1.0).otherwise(F.lit(high) - F.lit(low))
    return F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor((value - low) / span * buckets).cast("int")))


def in_ranges(df: DataFrame, value: str, buckets: int, bounds: tuple[float, float] | None) -> DataFrame:
    """df with __b, its value's range. Without bounds, ranges hold about equally many rows, by a sketch of the values (its size is fixed)."""
    if bounds is not None:
        return df.withColumn("__b", range_bucket(F.col(value), *bounds, buckets))
    inner = sorted(set(df.stat.approxQuantile(value, [k / buckets for k in range(1, buckets)], 0.5 / buckets)))
    splits = [float("-inf"), *([v for v in inner if abs(v) < float("inf")] or [0.0]), float("inf")]
    return Bucketizer(splits=splits, inputCol=value, outputCol="__b", handleInvalid="keep").transform(df)


def running_totals(df: DataFrame, value: str, weights: list[str], descending: bool = False, tie: list[Column] | None = None, buckets: int = 256, bounds: tuple[float, float] | None = None) -> DataFrame:
    """df with run_<weight>: totals of all rows up to each, in order of value (then tie).

    Rows are totalled by ranges of the value first; a window over these few
    totals gives each range its offset, and windows inside a range do the rest.
    No window has more rows than the fullest range.
    """
    order = [F.col(value).desc() if descending else F.col(value).asc(), *(tie or [])]
    placed = in_ranges(df, value, buckets, bounds)
    totals = placed.groupBy("__b").agg(*(F.sum(w).alias(f"__t_{w}") for w in weights))
    ranges = Window.orderBy(F.col("__b").desc() if descending else F.col("__b").asc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__b", *(F.coalesce(F.sum(f"__t_{w}").over(ranges), F.lit(0)).alias(f"__o_{w}") for w in weights))
    inside = Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(F.broadcast(offsets), "__b")  # at most `buckets` rows
    return joined.select(*df.columns, *((F.col(f"__o_{w}") + F.sum(w).over(inside)).alias(f"run_{w}") for w in weights))


def numbered(df: DataFrame, key: str, number: str, buckets: int = 256) -> DataFrame:
    """df with its rows' numbers from 0 in order of a numeric, unique key."""
    one = running_totals(df.withColumn("__one", F.lit(1).cast("long")), key, ["__one"], buckets=buckets)
    return one.withColumn(number, F.col("run___one") - 1).drop("__one", "run___one")


def values_at(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], buckets: int = 1024) -> DataFrame:
    """(keys, name, value): the values at ranks (from 0, functions of the number of values) of each key's numbers in ascending order.

    Equal values count as one row with a weight, and only the ranges that hold a
    rank are ordered, so no key is gathered. Nulls and NaN are left out, rows
    with a null key too.
    """
    marks = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__k"))
    ends = marks.groupBy(*keys).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.sum("__k").alias("__n"))
    placed = marks.join(ends.select(*keys, "__low", "__high"), keys).select(*keys, "__v", "__k", range_bucket(F.col("__v"), F.col("__low"), F.col("__high"), buckets).alias("__b"))
    reached = placed.groupBy(*keys, "__b").agg(F.sum("__k").alias("__t")).withColumn("__to", F.sum("__t").over(Window.partitionBy(*keys).orderBy("__b")))
    wanted = ends.select(*keys, F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank(F.col("__n")).cast("long").alias("rank")) for name, rank in ranks.items()))).alias("__w"))
    held = wanted.join(reached, keys).filter((F.col("__w.rank") < F.col("__to")) & (F.col("__w.rank") >= F.col("__to") - F.col("__t")))
    held = held.select(*keys, "__b", "__w.name", F.col("__w.rank").alias("__rank"), (F.col("__to") - F.col("__t")).alias("__before"))
    inside = Window.partitionBy(*keys, "__b").orderBy("__v")
    run = placed.join(held.select(*keys, "__b").distinct(), [*keys, "__b"], "left_semi").withColumn("__run", F.sum("__k").over(inside))
    return run.join(held, [*keys, "__b"]).filter(F.col("__before") + F.col("__run") > F.col("__rank")).groupBy(*keys, "name").agg(F.min("__v").alias("value"))


def percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, percentiles): of each key's numbers, interpolated between neighbours, in the order of shares."""
    at = lambda share, up: lambda n: (F.ceil if up else F.floor)(F.round((n - 1) * share, 9))
    ranks = {f"{i} {'high' if up else 'low'}": at(s, up) for i, s in enumerate(shares) for up in (False, True)}
    found = values_at(df, keys, value, ranks)
    n = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys).agg(F.count("*").alias("__n"))
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    wide = found.groupBy(*keys).agg(*(pick(name).alias(name) for name in ranks)).join(n, keys)
    part = lambda s: (F.col("__n") - 1) * s - F.floor(F.round((F.col("__n") - 1) * s, 9))
    return wide.select(*keys, F.array(*(F.col(f"{i} low") + (F.col(f"{i} high") - F.col(f"{i} low")) * part(s) for i, s in enumerate(shares))).alias("percentiles"))
