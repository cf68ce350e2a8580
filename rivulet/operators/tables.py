"""Keyed look-ups, aggregates, profiles, resampling and sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flow as fx
from .lineage import cut
from .neighbours import nearest_rows
from .ordered import numbered

SKETCH_SEEDS = [0x00000001, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D]
SKETCH_WIDTH, REGISTERS, REGISTER_SEED = 1024, 1024, 0x5BD1E995


# --- look-ups --------------------------------------------------------------
def blocked(flows: DataFrame, blocklist: DataFrame, key: str, keep: bool = False) -> DataFrame:
    """Flows whose key is in the blocklist, or the others with keep. Spark broadcasts the list if it is small, else shuffles."""
    return flows.join(blocklist, key, "left_anti" if keep else "left_semi")


def with_verdicts(flows: DataFrame, verdicts: DataFrame, keys: list[str], now: str = "us") -> DataFrame:
    """flows with the action of a verdict (keys, action, expires) that hasn't expired; expires 0: never. Keys of verdicts are unique."""
    live = (F.col("expires") == 0) | (F.col(now) < F.col("expires"))
    return flows.join(verdicts, keys, "left").withColumn("verdict", F.when(live, F.col("action"))).drop("action", "expires")


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The row of each key that is first in order: a partial aggregate, so keys with many rows are reduced before the shuffle."""
    rest = [c for c in df.columns if c != key]
    names = [f"__o{i}" for i in range(len(order))]
    packed = df.select(key, F.struct(*(o.alias(n) for o, n in zip(order, names, strict=True)), *rest).alias("__row"))
    return packed.groupBy(key).agg(F.min("__row").alias("__row")).select(key, *(F.col("__row")[c].alias(c) for c in rest))


# --- aggregates ------------------------------------------------------------
def flow_stats(df: DataFrame, keys: list[str], length: str, at: str, flags: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("packets"), F.sum(length).alias("bytes"), F.min(at).alias("first"), F.max(at).alias("last"), F.bit_or(flags).alias("flags"))


def profile(df: DataFrame, columns: list[str], label: Column) -> DataFrame:
    """One row for each column: counts of missing, infinite and non-numeric cells, different values, and whether it is constant. One pass."""
    cells = df.select(F.posexplode(F.array(*(F.struct(F.lit(c).alias("column"), F.trim(F.col(c).cast("string")).alias("v")) for c in columns))).alias("i", "x"))
    kind = fx.cell_class(F.col("x.v"))
    out = cells.groupBy("i", F.col("x.column").alias("column")).agg(F.count_if(kind == "missing").alias("missing"), F.count_if(kind == "infinite").alias("infinite"), F.count_if(kind == "text").alias("non_numeric"), F.min("x.v").alias("low"), F.max("x.v").alias("high"))
    return out.select("column", "missing", "infinite", "non_numeric", F.coalesce(F.col("low") == F.col("high"), F.lit(False)).alias("constant"))


def duplicates(df: DataFrame) -> DataFrame:
    """Numbers of rows and of repeated rows: rows are grouped by content."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    return groups.agg(F.sum("__n").alias("rows"), F.sum(F.col("__n") - 1).alias("duplicates"))


def imbalance(df: DataFrame, label: Column) -> DataFrame:
    counts = df.agg(F.count_if(label == 0).alias("benign"), F.count_if(label == 1).alias("malicious"))
    high, low = F.greatest("benign", "malicious"), F.least("benign", "malicious")
    ratio = F.when(low > 0, high / F.nullif(low, F.lit(0).cast("long")))
    return counts.select("benign", "malicious", F.round(ratio, 6).alias("ratio"), fx.imbalance_level(ratio).alias("level"), fx.imbalance_warning(ratio).alias("warning"))


def dispersion(df: DataFrame, columns: list[str], top: int = 40, least: int = 50) -> DataFrame:
    """Columns by spread of the signed logarithm over one plus its mean's size, widest first; constant ones go. One pass, whole table."""
    cells = df.select(F.posexplode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").try_cast("double").alias("v")) for c in columns))).alias("i", "x"))
    v = fx.signed_log(F.col("x.v"))
    out = cells.filter(F.col("x.v").isNotNull() & ~F.isnan("x.v") & (F.abs("x.v") < float("inf"))).groupBy("i", F.col("x.column").alias("column")).agg(F.count("*").alias("n"), (F.var_pop(v) / (F.abs(F.avg(v)) + 1)).alias("spread"))
    return out.filter((F.col("n") >= least) & (F.col("spread") > 0)).orderBy(F.desc("spread"), F.desc("i")).limit(top).select("column", F.round("spread", 6).alias("spread"))


# --- sketches --------------------------------------------------------------
def count_min(df: DataFrame, key: Column) -> DataFrame:
    """(row, bucket, n): the counters of a count-min sketch with fixed hashes."""
    cells = F.array(*(F.struct(F.lit(d).alias("row"), fx.mix32(key, seed).bitwiseAND(SKETCH_WIDTH - 1).alias("bucket")) for d, seed in enumerate(SKETCH_SEEDS)))
    return df.select(F.explode(cells).alias("c")).groupBy("c.row", "c.bucket").agg(F.count("*").alias("n"))


def count_min_estimates(df: DataFrame, key: str) -> DataFrame:
    """(key, n, estimate): true counts and the sketch's, which are never smaller."""
    exact = df.groupBy(key).agg(F.count("*").alias("n"))
    place = [fx.mix32(F.col(key), seed).bitwiseAND(SKETCH_WIDTH - 1) + d * SKETCH_WIDTH for d, seed in enumerate(SKETCH_SEEDS)]
    counters = exact.select(F.explode(F.array(*place)).alias("at"), "n").groupBy("at").agg(F.sum("n").alias("m"))
    # the sketch is of fixed size: one row with all its counters, in place order
    empty = df.sparkSession.range(len(SKETCH_SEEDS) * SKETCH_WIDTH).select(F.col("id").alias("at"))
    whole = empty.join(counters, "at", "left").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("m", F.lit(0)).alias("m")))).alias("sketch"))
    asked = exact.join(F.broadcast(whole))
    return asked.select(key, "n", F.least(*(F.get(F.col("sketch"), p.cast("int"))["m"] for p in place)).alias("estimate"))


def registers(df: DataFrame, source: Column, port: Column) -> DataFrame:
    """(register, rho) of a cardinality sketch over (source, port); rho counts the ten bits that the index used up too."""
    h = fx.mix32(source.cast("long").bitwiseXOR(F.shiftleft(port.cast("long"), 16)), REGISTER_SEED)
    rank = fx.leading_zeros32(F.shiftrightunsigned(h, 10).bitwiseOR(1)) + 1
    return df.select(h.bitwiseAND(REGISTERS - 1).alias("register"), rank.alias("rho")).groupBy("register").agg(F.max("rho").alias("rho"))


def cardinality(regs: DataFrame, correct: bool = True) -> DataFrame:
    """The estimate; corrected for the ten bits that are always zero unless told otherwise."""
    m = float(REGISTERS)
    rho = F.col("rho") - (10 if correct else 0)
    total = F.sum(F.pow(F.lit(2.0), -rho)) + (m - F.count("*"))
    raw = 0.7213 / (1 + 1.079 / m) * m * m / total
    zeros = m - F.count("*")
    return regs.agg(F.when((raw <= 2.5 * m) & (zeros > 0), m * F.log(m / F.nullif(zeros, F.lit(0.0)))).otherwise(raw).alias("estimate"))


# --- resampling ------------------------------------------------------------
def hashed_order(key: Column, seed: int) -> Column:
    """A fixed pseudo-random order: a linear congruence of the key, so any engine gives the same."""
    return F.pmod(F.pmod(key.cast("long"), F.lit(2147483648)) * 1103515245 + seed * 12345 + 12345, F.lit(2147483648))


def undersampled(df: DataFrame, key: Column, label: Column, share: float, seed: int = 7) -> DataFrame:
    """All rows of class 1 and about a share of class 0."""
    return df.filter((label == 1) | (hashed_order(key, seed) < share * 2147483648))


def without_cross_class(df: DataFrame, signature: list[str], label: str) -> DataFrame:
    """df without rows of class 0 whose signature some row of class 1 has."""
    bad = df.filter(F.col(label) == 1).select(*signature).distinct().withColumn(label, F.lit(0))
    return df.join(bad, [*signature, label], "left_anti").select(*df.columns)


def rebalanced(df: DataFrame, key: str, signature: list[str], label: str, family: str, ratio: float = 1.5, most: int = 5, seed: int = 7) -> DataFrame:
    """df (with a unique key) and copy: clashing rows of class 0 gone, class 1 replicated (rarest families first, up to most times), class 0 trimmed to ratio times that.

    Ranks come from windows inside each family and each of many hash ranges;
    counts decide the rest, so no class is ordered in one task.
    """
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    if not sizes.get(0) or not sizes.get(1) or sizes[0] / sizes[1] < ratio:
        return df.withColumn("copy", F.lit(0))
    clean = without_cross_class(df, signature, label)
    kept = clean.filter(F.col(label) == 0)
    n0, n1 = kept.count(), sizes[1]
    target = max(n1, min(int(n0 / ratio), n1 * most))
    limit = int(target * ratio)
    # trim class 0 to the first `limit` in hash order: a threshold found from counts of ranges of the hash
    order = hashed_order(F.col(key), seed)
    ranged = kept.withColumn("__r", F.floor(order / (2147483648 / 4096)))
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("__r").agg(F.count("*").alias("__c")).withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    inside = Window.partitionBy("__r").orderBy(order, key)
    trimmed = ranged.join(F.broadcast(offsets), "__r").withColumn("__rank", F.col("__before") + F.row_number().over(inside)).filter(F.col("__rank") <= limit).select(*df.columns, F.lit(0).alias("copy"))
    # class 1: rank by (family size, family, key); row i gets another copy for each further round that reaches it
    minority = clean.filter(F.col(label) == 1)
    families = minority.groupBy(family).agg(F.count("*").alias("__c"))
    starts = families.withColumn("__before", F.coalesce(F.sum("__c").over(Window.orderBy("__c", family).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = minority.join(F.broadcast(starts), family).withColumn("__rank", F.col("__before") + F.row_number().over(Window.partitionBy(family).orderBy(key)) - 1)
    extra = target - n1
    more = F.lit(extra // n1) + F.when(F.col("__rank") < extra % n1, 1).otherwise(0)
    grown = ranked.withColumn("copy", F.explode(F.sequence(F.lit(0), more))).select(*df.columns, "copy")
    return trimmed.unionByName(grown)


def tomek_links(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, neighbour): rows that are each other's nearest, of different classes; each pair twice."""
    near = nearest_rows(df, key, vector, 1).select("id", "neighbour")
    mutual = near.join(near.select(F.col("neighbour").alias("id"), F.col("id").alias("neighbour")), ["id", "neighbour"])
    one, two = (df.select(F.col(key).alias(n), F.col(label).alias(f"label_{n}")) for n in ("id", "neighbour"))
    return mutual.join(one, "id").join(two, "neighbour").filter("label_id <> label_neighbour").select("id", "neighbour", "label_id")


def smote(df: DataFrame, key: str, vector: str, need: int, k: int = 5, seed: int = 7) -> DataFrame:
    """(key, n, vector): need synthetic points between rows and one of their k nearest, dealt over the rows in key order."""
    total = df.count()
    near = nearest_rows(df, key, vector, k)
    base = numbered(df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x")), "id", "at")
    copies = base.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(max(0, need - 1) // max(total, 1))))).withColumn("number", F.col("n") * total + F.col("at")).filter(F.col("number") < need)
    pick = hashed_order(F.col("number"), seed)
    chosen = copies.withColumn("rank", (pick % k + 1).cast("int")).withColumn("g", hashed_order(F.col("number"), seed + 1) / 2147483648.0)
    ends = df.select(F.col(key).alias("neighbour"), F.col(vector).cast("array<double>").alias("y"))
    joined = chosen.join(near.select("id", "rank", "neighbour"), ["id", "rank"]).join(ends, "neighbour")
    return joined.select("number", "id", "neighbour", F.zip_with("x", "y", lambda a, b: a + F.col("g") * (b - a)).alias("vector"))


def smote_tomek(df: DataFrame, key: str, vector: str, label: str, need: int, k: int = 5, seed: int = 7) -> DataFrame:
    """(key, vector, label, synthetic): the rows of two classes and need synthetic ones of the smaller, without rows of the larger class that are each other's nearest with one of the smaller. New keys follow the largest."""
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    small = min(sizes, key=lambda y: (sizes[y], str(y)))
    last = df.agg(F.max(key)).first()[0]
    own = df.select(key, F.col(vector).cast("array<double>").alias(vector), label, F.lit(False).alias("synthetic"))
    made = smote(df.filter(F.col(label) == small), key, vector, need, k, seed).select((F.col("number") + last + 1).alias(key), "vector", F.lit(small).alias(label), F.lit(True).alias("synthetic"))
    every = cut(own.union(made))
    links = tomek_links(every, key, vector, label).filter(F.col("label_id") != F.lit(small)).select(F.col("id").alias(key)).distinct()
    return every.join(links, key, "left_anti")


def balance_report(before: DataFrame, after: DataFrame, label: str, origin: str) -> DataFrame:
    """One row: sizes of both classes before and after, ratios, and rows removed and added. after.origin is 0 for rows that were there before."""
    sizes = lambda df, name: df.agg(F.count_if(F.col(label) == 0).alias(f"benign_{name}"), F.count_if(F.col(label) == 1).alias(f"malicious_{name}"))
    kept = after.agg(F.count_if((F.col(label) == 0) & (F.col(origin) == 0)).alias("__kept"), F.count_if(F.col(origin) > 0).alias("minority_added"))
    ratio = lambda name: F.round(F.col(f"benign_{name}") / F.greatest(F.lit(1).cast("long"), F.col(f"malicious_{name}")), 2).alias(f"ratio_{name}")
    row = sizes(before, "before").join(sizes(after, "after")).join(kept)
    return row.select("benign_before", "malicious_before", "benign_after", "malicious_after", ratio("before"), ratio("after"), (F.col("benign_before") - F.col("__kept")).alias("majority_removed"), "minority_added")


def class_costs(df: DataFrame, label: str) -> DataFrame:
    """df with cost: how much more a row of the smaller class counts, the ratio of class sizes; 1 for the larger one."""
    sizes = df.agg(F.count_if(F.col(label) == 0).alias("__n0"), F.count_if(F.col(label) == 1).alias("__n1"))
    ratio = F.when(F.col(label) == 1, F.col("__n0") / F.nullif(F.col("__n1"), F.lit(0).cast("long"))).otherwise(F.col("__n1") / F.nullif(F.col("__n0"), F.lit(0).cast("long")))
    return df.join(F.broadcast(sizes)).withColumn("cost", F.greatest(F.lit(1.0), F.coalesce(ratio, F.lit(1.0)))).drop("__n0", "__n1")


def shuffled(df: DataFrame, key: str, seed: int = 1337) -> DataFrame:
    """df in a fixed pseudo-random order: a distributed sort by the hash of the key, ties by the key."""
    return df.orderBy(hashed_order(F.col(key), seed), key)


def first_of_each(df: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The first rows of each key in order, with their ranks r. Spark keeps the top of each key before the shuffle."""
    return df.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("r") <= most)


def shed(df: DataFrame, span_us: int, most: int) -> DataFrame:
    """df with lost: rows that come when `most` have passed in their span of time. Spans are groups, so no order is global."""
    w = Window.partitionBy(F.floor(F.col("us") / span_us)).orderBy("us", "seq")
    return df.withColumn("lost", F.row_number().over(w) > most)
