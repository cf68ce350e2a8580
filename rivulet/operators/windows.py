"""Sliding features of a flow's source, and batch detectors that are windows or joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import flow as fx
from . import sliding
from .lineage import stored
from .ordered import in_ranges, range_bucket, running_totals


def trailing(span_us: int, key: str = "src") -> object:
    """Records of the key in the last span, this one included. Records with equal times see each other."""
    return Window.partitionBy(key).orderBy("us").rangeBetween(-span_us, 0)


def inter_arrival(key: str = "src") -> Column:
    """Seconds since the key's last record, 0 for its first."""
    w = Window.partitionBy(key).orderBy("us", "seq")
    return F.coalesce((F.col("us") - F.lag("us").over(w)) / 1e6, F.lit(0.0))


def entropy(values: Column) -> Column:
    """Shannon entropy of a list over the log of its number of different values; 0 for one value."""
    kinds = F.array_sort(F.array_distinct(values))
    n = F.size(values)
    sizes = F.transform(kinds, lambda k: F.size(F.filter(values, lambda v: v == k)) / n)
    raw = F.aggregate(sizes, F.lit(0.0), lambda acc, p: acc - p * F.log(p))
    return F.when(F.size(kinds) > 1, raw / F.log(F.size(kinds).cast("double"))).otherwise(0.0)


def seven(flags: Column, size: Column, n: Column, fanout: Column, spread: Column, total: Column, gap_us: Column, span_us: int, iat_scale: float, full_rate: float) -> dict[str, Column]:
    """The seven features, each in 0 to 1, from a record and the statistics of its key's last span."""
    top = lambda c: F.least(F.lit(1.0), c)
    return {
        "f_len": size / 1500.0,
        "f_iat": top(F.coalesce(gap_us / 1e6, F.lit(0.0)) * iat_scale),
        "f_syn": fx.syn_only(flags).cast("double"),
        "f_fanout": top(fanout / 40.0),
        "f_entropy": top(spread),
        "f_bytes": top(total / (n * 1500.0 + 1e-6)),
        "f_pps": top(n / (span_us / 1e6) / full_rate),
    }


def features(flows: DataFrame, span_us: int = 2_000_000, iat_scale: float = 50.0, full_rate: float = 300.0) -> DataFrame:
    """flows with the seven features. One shuffle, by source and stretch of time; the time a row takes doesn't depend on the span."""
    seen = sliding.statistics(flows, span_us, reach_us=int(1e6 / iat_scale) + 1)
    made = seven(F.col("flags"), F.col("len"), *(F.col(c) for c in sliding.STATISTICS), span_us, iat_scale, full_rate)
    return seen.select(*flows.columns, *(c.alias(k) for k, c in made.items()))


def native_scaled(df: DataFrame, value: str, key: str, warm: int = 30) -> Column:
    """A running standard score of the signed logarithm, as a probability; 0.5 until warm."""
    x = fx.signed_log(F.col(value))
    w = Window.partitionBy(key).orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    spread = F.sqrt(F.greatest(F.var_pop(x).over(w), F.lit(1e-9)))
    return F.when(F.count("*").over(w) < warm, 0.5).otherwise(fx.sigmoid((x - F.avg(x).over(w)) / spread, 8.0))


def conformal(df: DataFrame, calibration: Column, score: str = "score") -> DataFrame:
    """df with p = (1 + calibration rows with this score or more) / (n + 1). A running total by score ranges, joined back by score."""
    marks = df.groupBy(score).agg(F.sum(calibration.cast("int")).cast("double").alias("cal"))
    run = running_totals(marks, score, ["cal"], descending=True).select(score, F.col("run_cal").alias("__above"))
    total = marks.agg(F.sum("cal").alias("__n"))
    return df.join(run, score).join(F.broadcast(total)).withColumn("p", (1 + F.col("__above")) / (F.col("__n") + 1)).drop("__above", "__n")


def conformal_each(df: DataFrame, calibration: Column, scores: list[str], buckets: int = 4096) -> DataFrame:
    """df with p_<score> for several scores in 0 to 1, as conformal gives each. A null score has a null p.

    Rows are kept (lineage.stored) with a number each. What is ordered, by ranges of value, is a
    number, a score and a flag for each score of a row; a row's values meet by its number,
    and only then the row, once whatever the number of scores. A range's lower end is a range
    of its own, and rows of a range with one value aren't ordered, so a million scores of 0 or 1 are many tasks' work.
    """
    rows = stored(df.withColumns({"__row": F.monotonically_increasing_id(), "__cal": F.coalesce(calibration.cast("int"), F.lit(0))}))
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("s")) for i, c in enumerate(scores)))
    each = rows.select("__row", "__cal", F.explode(cells).alias("x")).filter(F.col("x.s").isNotNull()).select("__row", "__cal", "x.i", "x.s")
    place = F.least(F.lit(buckets), F.greatest(F.lit(0), F.floor(F.col("s") * buckets)))
    placed = each.withColumn("b", F.when(F.col("s") < 0, -1).otherwise(2 * place + (F.col("s") * buckets > place).cast("int")))
    down = Window.partitionBy("i").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("i", "b").agg(F.sum("__cal").alias("t"), (F.min("s") == F.max("s")).alias("one"))
    ranges = ranges.select("i", "b", "t", "one", F.coalesce(F.sum("t").over(down), F.lit(0)).alias("before"), F.sum("t").over(Window.partitionBy("i")).alias("n"))
    # one number for score, range and part: sorts compare it first, and rarely need the score
    part = F.when(F.col("one"), 1 + F.pmod("__row", F.lit(1023))).otherwise(0)
    found = placed.join(F.broadcast(ranges), ["i", "b"]).withColumn("group", (F.col("i") * (2 * buckets + 3) + F.col("b") + 1) * 1024 + part)
    inside = F.sum("__cal").over(Window.partitionBy("group").orderBy(F.desc("s")))  # equal scores count together
    above = F.col("before") + F.when(F.col("one"), F.col("t")).otherwise(inside)
    p = found.select("__row", "i", ((1 + above) / (F.col("n") + 1)).alias("p"))
    wide = p.groupBy("__row").agg(*(F.max(F.when(F.col("i") == i, F.col("p"))).alias(f"p_{c}") for i, c in enumerate(scores)))
    return rows.join(wide, "__row", "left").drop("__row", "__cal")


def ecod(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with surprise_<column> = -log of the tail that the value is in, under the full sample's distribution, and ecod = the squashed sum. Values in 0 to 1."""
    n = df.agg(F.count("*").cast("double").alias("__n"))
    out = df.join(F.broadcast(n))
    for c in columns:
        run = running_totals(df.groupBy(c).agg(F.count("*").alias("k")), c, ["k"], bounds=(0.0, 1.0)).select(c, F.col("run_k").alias("__k"))
        share = F.col("__k") / (F.col("__n") + 1)
        out = out.join(run, c).withColumn(f"surprise_{c}", F.when(share > 0.5, -F.log(F.greatest(1 - share, F.lit(1e-9)))).otherwise(-F.log(F.greatest(share, F.lit(1e-9))))).drop("__k")
    total = sum((F.col(f"surprise_{c}") for c in columns), F.lit(0.0))
    return out.withColumn("ecod", 1 - F.exp(-total / (len(columns) * 2.5))).drop("__n")


def half_space_mass(df: DataFrame, columns: list[str], splits: list[list[int]], levels: list[list[float]], block: int = 250, stretch: int = 64) -> DataFrame:
    """df (with a dense seq) and hst: mean of 1 / (1 + mass of the leaf in the block of records before) over the trees.

    A group is a stretch of blocks and the block before it, so groups are of
    fixed size and each row is shuffled once; masses are counts of (block, leaf)
    in one array. A null or NaN isn't above any level.
    """
    size = block * stretch
    own = F.floor(F.col("seq") / size).cast("long")
    # a stretch's last block is context of the next stretch
    later = F.pmod(F.col("seq"), F.lit(size)) >= size - block
    places = F.when(later, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = df.withColumn("__stretch", F.explode(places))
    cuts, at = np.array(levels, float), np.array(splits, np.int64)
    leaves = 1 << at.shape[1]
    bits = 1 << np.arange(at.shape[1])
    names = df.columns

    def work(part: pa.Table) -> pa.Table:
        first = part.column("__stretch")[0].as_py() * stretch
        seq = part.column("seq").to_numpy()
        number = seq // block - first + 1  # 0 is the context
        x = np.column_stack([part.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns])
        total = np.zeros(len(seq))
        for s, t in zip(at, cuts, strict=True):
            leaf = ((x[:, s] > t) * bits).sum(1)
            mass = np.bincount((number + 1) * leaves + leaf, minlength=(stretch + 2) * leaves)
            total += 1 / (1 + mass[number * leaves + leaf])
        out = part.select(names).append_column("hst", pa.array(total / len(at)))
        return out.filter(pa.array(number > 0))

    schema = T.StructType([*df.schema.fields, T.StructField("hst", T.DoubleType())])
    return dealt.groupBy("__stretch").applyInArrow(work, schema)


def open_set(df: DataFrame, columns: list[str], block: int = 500) -> DataFrame:
    """df with unknown and novelty, against mean, spread and distances of the block of records before (unknown is false without one)."""
    number = F.floor(F.col("seq") / block)
    rows = df.withColumn("__b", number)
    stats = rows.groupBy("__b").agg(*(f(c).alias(f"__{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = lambda c: (F.col(c) - F.col(f"__m_{c}")) / (F.col(f"__s_{c}") + 1e-6)
    distance = F.sqrt(sum((z(c) * z(c) for c in columns), F.lit(0.0)) / len(columns))
    gate = rows.join(stats, "__b").groupBy("__b").agg(F.percentile(distance, 0.97).alias("__gate"))
    previous = stats.join(gate, "__b").withColumn("__b", F.col("__b") + 1)
    out = rows.join(previous, "__b", "left").withColumn("__d", distance)
    known = F.col("__gate").isNotNull()
    return out.select(*df.columns, F.coalesce(F.col("__d") > F.col("__gate") * 1.15, F.lit(False)).alias("unknown"), F.when(known & (F.col("__d") > F.col("__gate")), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__d") / (F.col("__gate") + 1e-6) - 1))).otherwise(0.0).alias("novelty"))


def recent_rate(df: DataFrame, key: str, order: str, hit: Column, rows: int, name: str = "rate", stretch: int = 65_536) -> DataFrame:
    """df with the share of hits (booleans; null ones don't count) among its key's last `rows` rows, this one included, in a numeric order.

    Rows are numbered by running counts of ranges of the order, then a stretch of a
    key's rows and the rows before it that its first ones look back to are a group:
    neither a key nor the whole is in one task, and a rate is a difference of counts.
    """
    placed = in_ranges(df.withColumns({"__v": F.col(order).cast("double"), "__hit": hit.cast("long")}), "__v", 256, None)
    before = Window.partitionBy("__key").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(F.col(key).alias("__key"), "__b").agg(F.count("*").alias("__c"))
    offsets = offsets.select("__key", F.col("__b").alias("__range"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__offset"))
    joined = placed.join(offsets, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__b") == F.col("__range")))
    numbered = joined.withColumn("__i", F.col("__offset") + F.row_number().over(Window.partitionBy(key, "__b").orderBy(order)) - 1)
    own = F.floor(F.col("__i") / stretch)
    last = F.floor((F.col("__i") + rows - 1) / stretch)
    dealt = numbered.withColumn("__own", own).withColumn("__stretch", F.explode(F.sequence(own, last)))
    w = Window.partitionBy(key, "__stretch").orderBy("__i")
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.withColumns({"__n": F.count("__hit").over(to_here), "__h": F.coalesce(F.sum("__hit").over(to_here), F.lit(0))})
    past = lambda c: F.col(c) - F.coalesce(F.lag(c, rows).over(w), F.lit(0))
    made = run.withColumns({"__m": past("__n"), "__g": past("__h")}).filter(F.col("__own") == F.col("__stretch"))
    return made.select(*df.columns, (F.col("__g") / F.nullif(F.col("__m"), F.lit(0).cast("long"))).alias(name))


def counter_delta(value: str, key: str, order: str = "us", wrap: float | None = None) -> Column:
    """Increase of a cumulative counter; where it falls, 0, or what a counter of range wrap would give."""
    w = Window.partitionBy(key).orderBy(order)
    d = F.col(value) - F.lag(value).over(w)
    d = F.coalesce(d, F.lit(0.0))
    return F.when(d >= 0, d).otherwise(d + wrap if wrap is not None else 0.0)
