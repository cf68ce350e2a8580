"""Distillation of decisions into short rules, with measured fidelity and coverage."""

from __future__ import annotations

from itertools import combinations
from operator import ge, gt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import flow as fx
from .ordered import percentiles

DECILES = [d / 10 for d in range(1, 10)]
PAIR_LEVELS = [0.1, 0.3, 0.5, 0.7, 0.9]
RULE = "feature string, op string, threshold double, feature2 string, op2 string, threshold2 double, at int"


def quantiles(df: DataFrame, features: list[str]) -> dict[str, list[float]]:
    """Exact deciles of each feature, all in one pass of ranks by ranges."""
    long = df.select(F.posexplode(F.array(*(F.col(c).cast("double") for c in features))).alias("i", "v"))
    found = {r.i: list(r.percentiles) for r in percentiles(long, ["i"], "v", DECILES).collect()}
    return {c: found.get(i, []) for i, c in enumerate(features)}


def candidates(levels: dict[str, list[float]]) -> list[tuple]:
    """All one- and two-feature rules, in the order that breaks ties."""
    out: list[tuple] = []
    for c, values in levels.items():
        out += [(c, ">", v, None, None, None) for v in values]
    for a, b in combinations(levels, 2):
        for qa in PAIR_LEVELS:
            for qb in PAIR_LEVELS:
                va, vb = (levels[c][DECILES.index(q)] for c, q in ((a, qa), (b, qb)))
                out += [(a, x, va, b, y, vb) for x in "><" for y in "><"]
    return [(*r, i) for i, r in enumerate(out)]


def evaluated(df: DataFrame, features: list[str], label: str, levels: dict[str, list[float]]) -> DataFrame:
    """All candidate rules with hits and right hits.

    Rows are first counted by their joint cell between the thresholds of all
    features (one pass, partial aggregates), then cells by each feature and each
    pair of features; rules meet these, not rows.
    """
    spark = df.sparkSession
    # a value's cell: how many thresholds it exceeds, and how many it reaches
    place = lambda c, op: sum((op(F.col(c), v).cast("int") for v in levels[c]), F.lit(0))
    cell = {c: F.struct(place(c, gt).alias("over"), place(c, ge).alias("reach")).alias(c) for c in features}
    joint = df.groupBy(*cell.values()).agg(F.count("*").alias("n"), F.sum(label).alias("hit"))
    none = F.struct(F.lit(0).alias("over"), F.lit(0).alias("reach"))
    one = [F.struct(F.lit(c).alias("f"), F.lit("").alias("g"), F.col(c).alias("x"), none.alias("y")) for c in features]
    two = [F.struct(F.lit(a).alias("f"), F.lit(b).alias("g"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in combinations(features, 2)]
    cells = joint.select(F.explode(F.array(*one, *two)).alias("c"), "n", "hit").groupBy("c").agg(F.sum("n").alias("n"), F.sum("hit").alias("right"))
    cells = cells.select("c.f", "c.g", "c.x", "c.y", "n", "right")
    rules = spark.createDataFrame([(*r[:6], r[6], r[0], r[3] or "", levels[r[0]].index(r[2]), levels[r[3]].index(r[5]) if r[3] else 0) for r in candidates(levels)], RULE + ", f string, g string, i int, j int")
    holds = lambda op, v, k: F.when(op == ">", v["over"] > k).otherwise(v["reach"] <= k)
    met = rules.join(cells, ["f", "g"]).filter(holds(F.col("op"), F.col("x"), F.col("i")) & (F.col("op2").isNull() | holds(F.col("op2"), F.col("y"), F.col("j"))))
    return met.groupBy("feature", "op", "threshold", "feature2", "op2", "threshold2", "at").agg(F.sum("n").alias("hits"), F.sum("right").alias("right"))


def distilled(df: DataFrame, features: list[str], label: str, fidelity: float = 0.95, coverage: float = 0.05, most: float = 0.9, rows: int = 20, top: int = 4, least_rows: int = 200) -> DataFrame:
    """The best rules by fidelity times coverage. None for fewer than least_rows rows or one class."""
    counts = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("y")).first()
    levels = quantiles(df, features)
    out = evaluated(df, features, label, levels) if counts.n else None
    n = float(counts.n or 1)
    if out is None or counts.n < least_rows or counts.y in (0, counts.n):
        empty = df.sparkSession.createDataFrame([], RULE)
        return empty.select("feature", "op", "threshold", "feature2", "op2", "threshold2", F.lit("").alias("rule"), F.lit(0.0).alias("fidelity"), F.lit(0.0).alias("coverage"))
    good = out.withColumn("fidelity", F.col("right") / F.col("hits")).withColumn("coverage", F.col("hits") / n)
    good = good.filter((F.col("coverage") >= coverage) & (F.col("coverage") <= most) & (F.col("hits") >= rows) & (F.col("fidelity") >= fidelity))
    good = good.withColumn("size", F.round(F.round("fidelity", 3) * F.round("coverage", 3), 9)).orderBy(F.desc("size"), "at").limit(top)
    text = fx.rule_predicate(F.col("feature"), F.col("op"), F.col("threshold"), F.col("feature2"), F.col("op2"), F.col("threshold2"))
    return good.select("feature", "op", F.round("threshold", 4).alias("threshold"), "feature2", "op2", F.round("threshold2", 4).alias("threshold2"), text.alias("rule"), F.round("fidelity", 3).alias("fidelity"), F.round("coverage", 3).alias("coverage"))
