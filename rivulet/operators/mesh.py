"""Merges of shared intelligence, members, clocks and models; energy accounting."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flow as fx
from .lineage import cut
from .ordered import numbered, values_at
from .tables import latest

# Energy of the network card, and grams of CO2 a kWh.
NIC_NJ_PER_BIT, NIC_IDLE_W, CARBON_G = 0.5, 0.8, 713.0


def merged_intel(events: DataFrame, key: str, arrival: str = "seq", at: str = "us") -> DataFrame:
    """Last writer wins by time; of equal times the first to arrive."""
    return latest(events, key, [-F.col(at), F.col(arrival)])


def live_intel(intel: DataFrame, now: Column, ttl_us: int, at: str = "us") -> DataFrame:
    return intel.filter(now - F.col(at) <= ttl_us)


def new_blocks(intel: DataFrame, seen: DataFrame, key: str, own: str, gate: float = 0.6) -> DataFrame:
    """Keys to block: confident drops from other nodes, not blocked before."""
    return intel.filter((F.col("confidence") >= gate) & F.col("action").isin(*fx.DROPPING) & (F.col("origin") != own)).select(key).distinct().join(seen, key, "left_anti")


def merged_members(rumours: DataFrame, node: str = "node") -> DataFrame:
    """Membership: the highest incarnation wins; inside it the worst state and the latest heartbeat. No order matters, so it is two aggregates."""
    rank = fx.case(F.col("state"), fx.MEMBER_RANK, F.lit(0))
    top = rumours.groupBy(node, "incarnation").agg(F.max(F.struct(rank.alias("rank"), F.col("state").alias("state"))).alias("worst"), F.max("heartbeat").alias("heartbeat"))
    return top.groupBy(node).agg(F.max(F.struct("incarnation", "worst", "heartbeat")).alias("m")).select(node, "m.incarnation", F.col("m.worst.state").alias("state"), "m.heartbeat")


def refuted(members: DataFrame, rumours: DataFrame, node: str = "node") -> DataFrame:
    """members with own incarnations raised above any rumour that calls the node suspect or dead at its incarnation or later."""
    bad = rumours.filter(F.col("state").isin("SUSPECT", "DEAD")).groupBy(node).agg(F.max("incarnation").alias("__bad"))
    own = F.when(F.col("__bad") >= F.col("incarnation"), F.col("__bad") + 1).otherwise(F.col("incarnation"))
    return members.join(bad, node, "left").withColumn("incarnation", own).drop("__bad")


def lamport(events: DataFrame, node: str, clock: str, order: list[str], first: int = 0) -> DataFrame:
    """events with the receiver's clock after each: max(own, incoming) + 1 in order. Closed form: the n-th is n + max(first, incoming_j - j + 1 for j up to n)."""
    w = Window.partitionBy(node).orderBy(*order)
    n = F.row_number().over(w)
    best = F.max(F.col(clock) - F.col("__n") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("__n", n).withColumn("own_clock", F.col("__n") + F.greatest(F.lit(first), best)).drop("__n")


def latest_telemetry(snapshots: DataFrame, node: str = "node", at: str = "us") -> DataFrame:
    """The last snapshot of each node."""
    return latest(snapshots, node, [-F.col(at), -F.col("seq")])


def intel_by_origin(intel: DataFrame, origin: str, last: int = 60) -> DataFrame:
    """Entries by origin among the most recent ones."""
    return intel.orderBy(F.desc("us"), F.desc("seq")).limit(last).groupBy(origin).agg(F.count("*").alias("n"))


def cpu_percent(samples: DataFrame, host: str, total: str, idle: str, order: str = "us") -> DataFrame:
    """samples with the busy share since the host's last sample, from cumulative counters; 0 where time stands still."""
    w = Window.partitionBy(host).orderBy(order)
    span, rest = F.col(total) - F.lag(total).over(w), F.col(idle) - F.lag(idle).over(w)
    return samples.withColumn("cpu_percent", F.when(span > 0, 100.0 * (span - rest) / F.nullif(span, F.lit(0))).otherwise(0.0))


def health(members: DataFrame) -> DataFrame:
    """Members by state, and whether more than half are alive."""
    c = lambda s: F.count_if(F.col("state") == s)
    return members.agg(c("ALIVE").alias("alive"), c("SUSPECT").alias("suspect"), c("DEAD").alias("dead"), F.coalesce(c("ALIVE") > F.count("*") / 2, F.lit(False)).alias("quorum"))


def clock_merge(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def clock_dominates(a: Column, b: Column) -> Column:
    """a is at least b everywhere, and more somewhere."""
    pairs = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.struct(F.coalesce(x, F.lit(0)).alias("x"), F.coalesce(y, F.lit(0)).alias("y"))))
    return F.forall(pairs, lambda p: p["x"] >= p["y"]) & F.exists(pairs, lambda p: p["x"] > p["y"])


def takes_policy(incoming: Column, own: Column, origin: Column, node: Column) -> Column:
    """A policy is taken if its clock dominates, or neither does and its origin comes first."""
    return clock_dominates(incoming, own) | (~clock_dominates(own, incoming) & (origin < node))


def trimmed_mean(vectors: DataFrame, key: str, vector: str, beta: float = 0.2) -> DataFrame:
    """(key, vector): coordinate-wise means without the share beta at each end."""
    each = vectors.select(key, F.posexplode(vector).alias("at", "v"))
    w = Window.partitionBy(key, "at")
    ranked = each.select(key, "at", "v", F.row_number().over(w.orderBy("v")).alias("r"), F.count("*").over(w).alias("n"))
    k = F.floor(F.col("n") * beta)
    means = ranked.filter((F.col("r") > k) & (F.col("r") <= F.col("n") - k) | (F.col("n") - 2 * k <= 0)).groupBy(key, "at").agg(F.avg("v").alias("v"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("vector"))


def possible(rows: DataFrame, sizes: DataFrame, drop: int) -> DataFrame:
    """Those of rows (key, id, v) whose sum of squared distances less the drop farthest may be the least of their group (sizes: __group, n); bounds that are no numbers keep all."""
    means = rows.select("key", F.posexplode("v").alias("at", "x")).groupBy("key", "at").agg(F.avg("x").alias("x"))
    means = means.groupBy(F.col("key").alias("__mean_of")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("__mean"))
    off = F.aggregate(F.zip_with("v", "__mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    far = rows.join(means, F.col("key").eqNullSafe(F.col("__mean_of"))).select("key", "id", "v", off.alias("__off"))
    spread = far.groupBy(F.col("key").alias("__k")).agg(F.sum("__off").alias("__sum"), F.max("__off").alias("__most"), F.min("__off").alias("__least"))
    spread = spread.join(sizes, F.col("__k").eqNullSafe(F.col("__group"))).select("__k", "__sum", "__most", "__least", "n")
    total = F.col("n") * F.col("__off") + F.col("__sum")
    low = total * (1 - 1e-9) - drop * (F.sqrt("__off") + F.sqrt("__most")) * (F.sqrt("__off") + F.sqrt("__most")) * (1 + 1e-9)
    best = (F.col("n") * F.col("__least") + F.col("__sum")) * (1 + 1e-9)
    return far.join(spread, F.col("key").eqNullSafe(F.col("__k"))).filter(low <= best).select("key", "id", "v")


def candidates(rows: DataFrame, sizes: DataFrame, drop: int) -> DataFrame:
    """possible(), of equal vectors the one with the smallest id: they have one score, so the others can't come first. Copies in a table don't make more candidates."""
    return possible(rows, sizes, drop).groupBy("key", "v").agg(F.min("id").alias("id")).select("key", "id", "v")


def krum(vectors: DataFrame, key: str, id_column: str, vector: str, faulty: int = 1, block: int = 512) -> DataFrame:
    """(key, id, score): of each group of peers, the vector nearest to its n - faulty - 2 nearest; ties to the smaller id. Groups too small for that have no row (see robust).

    A row's score is the sum of its distances less the farthest. The sum follows
    from the row's distance from the group's mean, and the farthest are no farther
    than that and the group's radius; so most rows can't be the nearest, and only the
    others are scored, exactly. Sums and farthest merge: rows are hashed into blocks,
    each pair of blocks gives each row a sum and its farthest few. No task holds a
    group. Where all rows are about equally far from the mean, all pairs are compared.
    """
    rows = vectors.filter(F.col(vector).isNotNull() & F.col(id_column).isNotNull()).select(F.col(key).alias("key"), F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("long")).filter((F.col("n") > 2) & (F.col("n") > faulty + 2)).withColumnRenamed("key", "__group")
    drop = faulty + 1
    chosen = cut(candidates(rows, sizes, drop))
    few = chosen.groupBy("key").agg(F.ceil(F.count("*") / block).cast("long").alias("askers")).withColumnRenamed("key", "__few")
    sizes = sizes.join(few, F.col("__group").eqNullSafe(F.col("__few"))).drop("__few")
    placed = lambda df: df.join(sizes, F.col("key").eqNullSafe(F.col("__group")))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    asked = placed(chosen).select("key", own("askers").alias("a"), each("blocks").alias("b"), "id", "v")
    given = placed(rows).select(F.col("key").alias("key"), each("askers").alias("a"), own("blocks").alias("b"), F.col("id").alias("id"), F.col("v").alias("v"))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, x, y = left.column("id"), *(np.array(t.column("v").to_pylist(), float) for t in (left, right))
        total, far = np.zeros(len(x)), []
        for a in range(0, len(x) if len(y) else 0, 64):
            d = ((x[a : a + 64, None] - y[None]) ** 2).sum(-1)
            total[a : a + 64] = d.sum(1)
            far += np.sort(d, axis=1)[:, -drop:].tolist()
        return pa.table([left.column("key"), ids, pa.array(total), pa.array(far or [[]] * len(x), pa.list_(pa.float64()))], names=["key", "id", "total", "far"])

    kind = rows.schema["key"].dataType.simpleString()
    met = asked.groupBy("key", "a", "b").cogroup(given.groupBy("key", "a", "b")).applyInArrow(work, f"key {kind}, id long, total double, far array<double>")
    merged = met.groupBy("key", "id").agg(F.sum("total").alias("total"), F.sort_array(F.flatten(F.collect_list("far")), asc=False).alias("far"))
    score = F.greatest(F.lit(0.0), F.col("total") - F.aggregate(F.slice("far", 1, drop), F.lit(0.0), lambda s, d: s + d))
    first = merged.select("key", "id", score.alias("score")).groupBy("key").agg(F.min(F.struct("score", "id")).alias("m"))
    return first.select(F.col("key").alias(key), "m.id", "m.score")


def robust(vectors: DataFrame, key: str, id_column: str, vector: str, faulty: int = 1) -> DataFrame:
    """(key, id, score, vector): what krum picks; for groups of at most faulty + 2 vectors, or of two, the trimmed mean, without id and score."""
    rows = vectors.filter(F.col(vector).isNotNull() & F.col(id_column).isNotNull())
    picked = krum(rows, key, id_column, vector, faulty)
    chosen = picked.join(rows.select(F.col(key).alias("__k"), F.col(id_column).alias("__i"), F.col(vector).cast("array<double>").alias("vector")), F.col(key).eqNullSafe(F.col("__k")) & (F.col("id") == F.col("__i"))).select(key, "id", "score", "vector")
    small = rows.groupBy(key).agg(F.count("*").alias("n")).filter((F.col("n") <= 2) | (F.col("n") <= faulty + 2)).select(F.col(key).alias("__k"))
    few = rows.join(small, F.col(key).eqNullSafe(F.col("__k")), "left_semi")
    means = trimmed_mean(few, key, vector).select(key, F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("score"), "vector")
    return chosen.unionByName(means)


def federated(vectors: DataFrame, key: str, id_column: str, vector: str) -> DataFrame:
    """(key, weights): trimmed mean of all vectors and the robust one once more, scaled to a sum of 1."""
    again = robust(vectors, key, id_column, vector).select(key, F.col("vector").alias(vector))
    own = vectors.select(key, F.col(vector).cast("array<double>").alias(vector))
    mean = trimmed_mean(own.unionByName(again), key, vector)
    total = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v)
    return mean.select(key, F.transform("vector", lambda v: v / F.when(total == 0, 1.0).otherwise(total)).alias("weights"))


def upper_median(value: str) -> Column:
    """The middle value, the upper one of an even number."""
    return F.element_at(F.array_sort(F.collect_list(value)), (F.floor(F.count(value) / 2) + 1).cast("int"))


def upper_medians(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median): the middle one of each key's numbers, the upper of an even number, without gathering them."""
    return values_at(df, [key], value, {"middle": lambda n: F.floor(n / 2)}).select(key, F.col("value").alias("median"))


def phi(beats: DataFrame, key: str, at_ms: str, window: int = 200, floor: float = 50.0, first: float = 750.0, tie: str | None = None) -> DataFrame:
    """beats with phi just before each: suspicion from the gaps of the beats before it. Beats of a key with equal times are in order of tie.

    Totals of gaps and their squares run once over the key; those of a window are
    differences of two.
    """
    w = Window.partitionBy(key).orderBy(at_ms, *([tie] if tie else []))
    gap = beats.withColumn("gap", F.col(at_ms) - F.lag(at_ms).over(w))
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    run = gap.withColumns({"__n": F.count("gap").over(to_here), "__s": F.coalesce(F.sum("gap").over(to_here), F.lit(0.0)), "__q": F.coalesce(F.sum(F.col("gap") * F.col("gap")).over(to_here), F.lit(0.0))})
    ago = lambda c, k: F.coalesce(F.lag(c, k).over(w), F.lit(0))
    past = run.select(*gap.columns, *((ago(c, 1) - ago(c, window + 1)).alias(c) for c in ("__n", "__s", "__q")))
    n = F.nullif(F.col("__n"), F.lit(0).cast("long"))
    mean = F.coalesce(F.col("__s") / n, F.lit(first))
    variance = F.greatest((F.col("__q") - F.col("__s") * F.col("__s") / n) / n, F.lit(0.0))
    spread = F.when(n.isNotNull(), F.greatest(F.sqrt(variance), F.lit(floor))).otherwise(first / 2)  # greatest() skips nulls
    return past.withColumn("phi", F.when(F.col("gap").isNull(), 0.0).otherwise(fx.phi(F.col("gap"), mean, spread))).drop("__n", "__s", "__q")


def phi_of(overdue_ms: float, gaps: list[float], floor: float = 50.0, first: float = 750.0) -> float:
    """phi() for one member: its last gaps, and how long its beat is overdue."""
    mean, spread = first, first / 2
    if gaps:
        mean = sum(gaps) / len(gaps)
        spread = max(math.sqrt(sum((g - mean) ** 2 for g in gaps) / len(gaps)), floor)
    y = max(-37.0, min(37.0, (overdue_ms - mean) / spread))
    tail = math.exp(-y * (1.5976 + 0.070566 * y * y))
    return -math.log10(min(1.0, max(1e-10, tail / (1 + tail))))


def overdue_at(level: float, gaps: list[float], floor: float = 50.0, first: float = 750.0) -> float | None:
    """How long a beat is overdue, in ms, when phi reaches a level (it only grows); None if it never does."""
    if level > 10:
        return None
    low, high = 0.0, 1.0
    while phi_of(high, gaps, floor, first) < level:
        low, high = high, high * 2
    while high - low > 0.01:
        middle = (low + high) / 2
        low, high = (low, middle) if phi_of(middle, gaps, floor, first) >= level else (middle, high)
    return high


def silent(beats: DataFrame, key: str, at_ms: str, now_ms: Column, window: int = 200, floor: float = 50.0, first: float = 750.0, suspect: float = 8.0, dead: float = 12.0) -> DataFrame:
    """(key, phi, state) of every member at now_ms, a literal: suspicion from how long its beat is overdue, given its last gaps. The stream's form, with timers, is streaming.timed.watched."""
    w = Window.partitionBy(key).orderBy(F.desc(at_ms))
    gap = F.col(at_ms) - F.lead(at_ms).over(w)
    last = beats.select(key, at_ms, gap.alias("__gap"), F.row_number().over(w).alias("__r")).filter(F.col("__r") <= window)
    seen = last.groupBy(key).agg(F.max(at_ms).alias("__last"), F.avg("__gap").alias("__mean"), F.stddev_pop("__gap").alias("__spread"))
    mean, spread = F.coalesce("__mean", F.lit(first)), F.when(F.col("__spread").isNotNull(), F.greatest(F.col("__spread"), F.lit(floor))).otherwise(first / 2)
    level = fx.phi(now_ms - F.col("__last"), mean, spread)
    return seen.select(key, level.alias("phi"), F.when(level >= dead, "DEAD").when(level >= suspect, "SUSPECT").otherwise("ALIVE").alias("state"))


def watched(members: DataFrame, levels: DataFrame, node: str = "node", suspect: float = 8.0, dead: float = 12.0) -> DataFrame:
    """members with the state that the last known phi (node, phi) calls for: suspects recover below `suspect`, the dead stay dead."""
    level, state = F.coalesce("phi", F.lit(0.0)), F.col("state")
    now = F.when(level >= dead, "DEAD").when((level >= suspect) & (state == "ALIVE"), "SUSPECT").when((level < suspect) & (state == "SUSPECT"), "ALIVE").otherwise(state)
    return members.join(levels.select(node, "phi"), node, "left").withColumn("state", now).drop("phi")


def local_intel(events: DataFrame, node: str, clock: int = 0, ttl: int = 900) -> DataFrame:
    """Records to share for a node's own enforced events: the clock counts on in order, confidence is the score, at most 1.

    A sender has few of them a flush, so one ordered pass over enforced events is enough.
    """
    own = numbered(events.filter(F.col("action").isin(*fx.ENFORCING)), "seq", "__i")
    return own.select("seq", "us", "src", "dst", "proto", "action", "severity", "score", F.least(F.col("score"), F.lit(1.0)).alias("confidence"), F.lit(node).alias("origin"), (F.col("__i") + clock + 1).alias("lamport"), F.lit(ttl).alias("ttl"))


def flushed(intel: DataFrame, members: DataFrame, node: str, batch: int = 64) -> DataFrame:
    """(peer, batch, records): how intel goes to each peer that isn't dead or gone, in batches of at most `batch` in clock order."""
    peers = members.filter((F.col("node") != node) & F.col("state").isin("ALIVE", "SUSPECT")).select(F.col("node").alias("peer"))
    sizes = intel.groupBy(F.floor((F.col("lamport") - 1) / batch).alias("batch")).agg(F.count("*").alias("records"))
    return sizes.join(peers).select("peer", "batch", "records")  # one row a message


def gossip_digest(members: DataFrame, intel: DataFrame, most_members: int = 24, newest: int = 40) -> tuple[DataFrame, DataFrame]:
    """What one exchange carries: members with the latest heartbeats and the newest records. Top-k, never a full sort."""
    return members.orderBy(F.desc("heartbeat"), "node").limit(most_members), intel.orderBy(F.desc("us"), F.desc("seq")).limit(newest)


def host_memory(samples: DataFrame) -> DataFrame:
    """samples (total, available, rss in bytes) with the share used and resident MiB."""
    used = F.when(F.col("total") > 0, F.round(100.0 * (F.col("total") - F.col("available")) / F.nullif(F.col("total"), F.lit(0).cast("long")), 1)).otherwise(0.0)
    return samples.withColumns({"mem_used_pct": used, "rss_mb": F.round(F.col("rss") / 1048576, 1)})


def packet_loss(counters: DataFrame, *keys: str) -> DataFrame:
    """(keys, seen, lost, loss_pct) of counters (seen, lost); 0 where nothing was seen."""
    seen, lost = F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("lost"), F.lit(0))
    return counters.groupBy(*keys).agg(seen.alias("seen"), lost.alias("lost"), F.when(seen > 0, F.round(100.0 * lost / F.nullif(seen, F.lit(0).cast("long")), 4)).otherwise(0.0).alias("loss_pct"))


def energy(samples: DataFrame, key: str) -> DataFrame:
    """Totals by key of samples (us, packets, attacks, bits, cpu_joules): cumulative counters become increases, which are summed."""
    w = Window.partitionBy(key).orderBy("us")
    up = lambda c: F.greatest(F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)), F.lit(0.0))
    seconds = F.coalesce((F.col("us") - F.lag("us").over(w)) / 1e6, F.lit(0.0))
    d = samples.select(key, *(up(c).alias(c) for c in ("packets", "attacks", "bits", "cpu_joules")), seconds.alias("seconds"))
    d = d.withColumn("nic_joules", F.col("bits") * NIC_NJ_PER_BIT / 1e9 + NIC_IDLE_W * F.col("seconds")).withColumn("watts", F.when(F.col("seconds") > 0, F.col("cpu_joules") / F.nullif(F.col("seconds"), F.lit(0.0))))
    joules = F.sum(F.col("cpu_joules") + F.col("nic_joules"))
    share = lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0.0))).otherwise(0.0)
    return d.groupBy(key).agg(
        joules.alias("joules"),
        share(joules * 1e6, F.sum("packets")).alias("uj_per_packet"),
        share(joules * 1e3, F.sum("attacks")).alias("mj_per_attack"),
        share(F.sum("bits"), joules).alias("bits_per_joule"),
        (joules / 3.6e6).alias("kwh"),
        (joules / 3.6e6 * CARBON_G).alias("co2_g"),
        F.max("watts").alias("peak_watts"),
        F.avg(F.when(F.col("attacks") > 0, F.col("watts"))).alias("attack_watts"),
        F.avg(F.when(F.col("attacks") == 0, F.col("watts"))).alias("idle_watts"),
    )


def energy_gate(watts: Column, suspicion: Column, budget: float) -> Column:
    """Whether costly detectors are skipped: over the budget, and the source isn't suspicious."""
    return (F.lit(budget) > 0) & (suspicion < 0.6) & (watts > budget)
