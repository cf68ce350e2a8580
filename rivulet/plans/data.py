"""Queries over look-ups, aggregates, profiles, sketches and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import flow as fx
from ..operators import sketches
from ..operators import tables as ops
from ..operators.ordered import numbered
from .projections import DECIDED, decided, mix32_sql
from .tables import DAY, FLOWS, SQL, flows, query, table

WITH = f"WITH {FLOWS}"


@query("SELECT l_suppkey, l_linestatus, count(*) AS packets, round(sum(l_quantity), 4) AS bytes, min(epoch_us(l_shipdate)) AS first, max(epoch_us(l_shipdate)) AS last, bit_or(l_linenumber) AS flags FROM lineitem GROUP BY 1, 2")
def flow_stats(spark, sf):
    t = table(spark, sf, "lineitem").withColumn("us", F.unix_micros(F.col("l_shipdate").cast("timestamp")))
    return ops.flow_stats(t, ["l_suppkey", "l_linestatus"], "l_quantity", "us", "l_linenumber").withColumn("bytes", F.round("bytes", 4))


@query(f"{DECIDED} SELECT count(*) AS packets, round(sum(len), 4) AS bytes, count(*) FILTER (action = 'DROP') AS dropped, count(*) FILTER (action = 'QUARANTINE') AS quarantined, count(*) FILTER (action <> 'PASS') AS alerts, round(100.0 * count(*) FILTER (port = 0) / count(*), 6) AS loss_percent FROM decided")
def metric_slots(spark, sf):
    act = F.col("action")
    return decided(spark, sf).agg(F.count("*").alias("packets"), F.round(F.sum("len"), 4).alias("bytes"), F.count_if(act == "DROP").alias("dropped"), F.count_if(act == "QUARANTINE").alias("quarantined"), F.count_if(act != "PASS").alias("alerts"), F.round(100.0 * F.count_if(F.col("port") == 0) / F.count("*"), 6).alias("loss_percent"))


_BLOCK = "(SELECT c_custkey AS uid FROM customer WHERE c_nationkey < 5)"


def _blocklist(spark, sf):
    return table(spark, sf, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("uid"))


@query(f"{WITH} SELECT seq FROM flows WHERE uid IN {_BLOCK}")
def blocklist_semi(spark, sf):
    return ops.blocked(flows(spark, sf), _blocklist(spark, sf), "uid").select("seq")


@query(f"{WITH} SELECT seq FROM flows WHERE uid NOT IN {_BLOCK}")
def blocklist_anti(spark, sf):
    return ops.blocked(flows(spark, sf), _blocklist(spark, sf), "uid", keep=True).select("seq")


@query(f"""{WITH}, v AS (SELECT uid, dst, CASE WHEN max(port) > 90 THEN 'DROP' ELSE 'RATE_LIMIT' END AS action, CASE WHEN uid % 2 = 0 THEN 0 ELSE min(us) + {5 * DAY} END AS expires FROM flows WHERE port > 80 GROUP BY uid, dst)
 SELECT f.seq, CASE WHEN v.expires = 0 OR f.us < v.expires THEN v.action END AS verdict FROM flows f LEFT JOIN v ON f.uid = v.uid AND f.dst = v.dst""")
def verdict_ttl(spark, sf):
    f = flows(spark, sf)
    v = f.filter("port > 80").groupBy("uid", "dst").agg(F.when(F.max("port") > 90, "DROP").otherwise("RATE_LIMIT").alias("action"), F.when(F.col("uid") % 2 == 0, 0).otherwise(F.min("us") + 5 * DAY).alias("expires"))
    return ops.with_verdicts(f, v, ["uid", "dst"]).select("seq", "verdict")


@query(f"{WITH} SELECT uid, count(*) AS n FROM flows GROUP BY uid QUALIFY row_number() OVER (ORDER BY n DESC, uid) <= 20")
def heavy_hitters(spark, sf):
    return flows(spark, sf).groupBy("uid").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "uid").limit(20)


_CMS = ", ".join(f"{{'d': {d}, 'b': {mix32_sql('uid', s)} & 1023}}" for d, s in enumerate(ops.SKETCH_SEEDS))


@query(f"""{WITH}, c AS (SELECT uid, unnest([{_CMS}]) AS x FROM flows), k AS (SELECT x.d AS d, x.b AS b, count(*) AS n FROM c GROUP BY 1, 2), e AS (SELECT uid, count(*) AS n FROM flows GROUP BY uid)
 SELECT e.uid, e.n, min(k.n) AS estimate FROM e JOIN (SELECT DISTINCT uid, x.d AS d, x.b AS b FROM c) q ON q.uid = e.uid JOIN k ON k.d = q.d AND k.b = q.b GROUP BY 1, 2""")
def cms_exact(spark, sf):
    return ops.count_min_estimates(flows(spark, sf), "uid")


@query(f"""{WITH}, c AS (SELECT uid, unnest([{_CMS}]) AS x FROM flows), k AS (SELECT x.d AS d, x.b AS b, count(*) AS n FROM c GROUP BY 1, 2), e AS (SELECT uid, count(*) AS n FROM flows GROUP BY uid)
 SELECT e.uid, e.n, min(k.n) AS estimate, true AS bounded FROM e JOIN (SELECT DISTINCT uid, x.d AS d, x.b AS b FROM c) q ON q.uid = e.uid JOIN k ON k.d = q.d AND k.b = q.b WHERE 1025 * e.n > (SELECT count(*) FROM flows) GROUP BY 1, 2""")
def heavy_sketch(spark, sf):
    """Keys that a sketch of 1,024 candidates is sure to find, with true counts beside the estimates."""
    x = flows(spark, sf)
    found = sketches.heavy_hitters(sketches.sketched(x, F.col("uid"), F.col("uid"), 1024), 1024)
    true = x.groupBy("uid").agg(F.count("*").alias("n"))
    bounded = (F.col("least") <= F.col("n")) & (F.col("n") <= F.col("most")) & ((F.col("n") - F.col("least")) * 1025 <= F.col("total"))
    return true.join(found.withColumn("uid", F.col("key").cast("long")), "uid").filter(F.col("n") * 1025 > F.col("total")).select(F.col("uid").cast(x.schema["uid"].dataType).alias("uid"), "n", "estimate", bounded.alias("bounded"))


_HLL = f"""h AS (SELECT {mix32_sql("xor(l_suppkey, l_partkey << 16) & 4294967295", ops.REGISTER_SEED)} AS h FROM lineitem), w AS (SELECT h & 1023 AS register, (h >> 10) | 1 AS w FROM h),
 r AS (SELECT register, max(33 - length(bin(w))) AS rho FROM w GROUP BY 1)"""


def _registers(spark, sf):
    pair = F.col("l_suppkey").bitwiseXOR(F.shiftleft(F.col("l_partkey"), 16)).bitwiseAND(4294967295)
    return ops.registers(table(spark, sf, "lineitem"), pair, F.lit(0))


@query(f"WITH {_HLL} SELECT register, rho FROM r")
def hll_registers(spark, sf):
    return _registers(spark, sf)


@query(f"""WITH {_HLL}, t AS (SELECT 1024 - count(*) AS zeros, sum(power(2.0, 10 - rho)) + 1024 - count(*) AS total FROM r), e AS (SELECT zeros, 0.7213 / (1 + 1.079 / 1024) * 1024 * 1024 / total AS raw FROM t)
 SELECT round(CASE WHEN raw <= 2560 AND zeros > 0 THEN 1024 * ln(1024.0 / zeros) ELSE raw END, 4) AS estimate FROM e""")
def hll_estimate(spark, sf):
    return ops.cardinality(_registers(spark, sf)).select(F.round("estimate", 4).alias("estimate"))


@query(f"{WITH} SELECT uid, count(DISTINCT port) AS fanout FROM flows GROUP BY uid")
def fanout_exact(spark, sf):
    return flows(spark, sf).groupBy("uid").agg(F.count_distinct("port").alias("fanout"))


@query()
def builtin_sketches(spark, sf):
    """Spark's own sketches: distinct pairs (estimate) and quantiles (approximate)."""
    return flows(spark, sf).groupBy("proto").agg(F.hll_sketch_estimate(F.hll_sketch_agg("port", 10)).alias("ports"), F.percentile_approx("len", 0.98, 1000).alias("p98"))


# --- profile ---------------------------------------------------------------
_TEXT = "CASE WHEN c_custkey % 11 = 0 THEN ' NaN' WHEN c_custkey % 13 = 0 THEN 'inf' WHEN c_custkey % 17 = 0 THEN '?' WHEN c_custkey % 19 = 0 THEN '' ELSE c_mktsegment END"


def _dirty(spark, sf):
    k = F.col("c_custkey")
    text = F.when(k % 11 == 0, " NaN").when(k % 13 == 0, "inf").when(k % 17 == 0, "?").when(k % 19 == 0, "").otherwise(F.col("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", text.alias("segment"), F.lit("7").alias("seven"), F.col("c_acctbal").cast("string").alias("balance"))


@query(f"SELECT c_custkey FROM customer WHERE NOT (lower(trim({_TEXT})) IN ('', 'nan', 'na', 'null', 'none', 'inf', '-inf', 'infinity'))")
def clean_filter(spark, sf):
    return _dirty(spark, sf).filter(~fx.is_dirty(F.col("segment"))).select("c_custkey")


@query(f"""WITH t AS (SELECT lower(trim({_TEXT})) AS v, trim({_TEXT}) AS w FROM customer)
 SELECT 'segment' AS "column", count(*) FILTER (v IN ('', 'nan', 'na', 'null', 'none', '?')) AS missing, count(*) FILTER (v IN ('inf', '-inf', 'infinity', '-infinity')) AS infinite,
  count(*) FILTER (v NOT IN ('', 'nan', 'na', 'null', 'none', '?', 'inf', '-inf', 'infinity', '-infinity')) AS non_numeric, min(w) = max(w) AS constant FROM t
 UNION ALL SELECT 'seven', 0, 0, 0, true UNION ALL SELECT 'balance', 0, 0, 0, false""")
def quality_profile(spark, sf):
    return ops.profile(_dirty(spark, sf), ["segment", "seven", "balance"], F.lit(0))


@query("SELECT 'seven' AS \"column\"")
def constant_cols(spark, sf):
    return ops.profile(_dirty(spark, sf), ["segment", "seven", "balance"], F.lit(0)).filter("constant").select("column")


@query(f"SELECT 'segment' AS \"column\", count(*) AS missing FROM customer WHERE lower(trim({_TEXT})) IN ('', 'nan', 'na', 'null', 'none', '?')")
def missing_topk(spark, sf):
    return ops.profile(_dirty(spark, sf), ["segment", "seven", "balance"], F.lit(0)).filter("missing > 0").orderBy(F.desc("missing"), "column").limit(3).select("column", "missing")


@query("SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean_size, count(DISTINCT source) AS sources FROM documents GROUP BY lang ORDER BY n DESC LIMIT 12")
def class_distribution(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_size"), F.count_distinct("source").alias("sources")).orderBy(F.desc("n")).limit(12)


@query("""WITH c AS (SELECT count(*) FILTER (toxic = 0) AS benign, count(*) FILTER (toxic = 1) AS malicious FROM labels), r AS (SELECT *, CASE WHEN least(benign, malicious) > 0 THEN greatest(benign, malicious)::DOUBLE / least(benign, malicious) END AS r FROM c)
 SELECT benign, malicious, round(r, 6) AS ratio, CASE WHEN r IS NULL THEN 'DEGENERATE' WHEN r < 1.5 THEN 'BALANCED' WHEN r < 4 THEN 'MILD' WHEN r < 10 THEN 'MODERATE' WHEN r < 100 THEN 'SEVERE' ELSE 'EXTREME' END AS level,
 CASE WHEN r IS NULL OR r >= 100 THEN 'SEVERE' WHEN r >= 10 THEN 'HIGH' WHEN r >= 3 THEN 'MODERATE' ELSE 'BALANCED' END AS warning FROM r""")
def imbalance(spark, sf):
    return ops.imbalance(table(spark, sf, "labels"), F.col("toxic"))


@query("SELECT count(*) AS rows, count(*) - count(DISTINCT text) AS duplicates FROM documents")
def dedup_exact(spark, sf):
    return ops.duplicates(table(spark, sf, "documents").select("text"))


@query("""WITH c AS (SELECT 'l_quantity' AS c, 0 AS i, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', 1, l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', 2, l_discount FROM lineitem UNION ALL SELECT 'l_tax', 3, l_tax FROM lineitem),
 s AS (SELECT c, i, var_pop(sign(v) * ln(1 + abs(v))) / (abs(avg(sign(v) * ln(1 + abs(v)))) + 1) AS spread FROM c GROUP BY c, i) SELECT c AS "column", round(spread, 6) AS spread FROM s WHERE spread > 0""")
def column_dispersion(spark, sf):
    return ops.dispersion(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


# --- resampling ------------------------------------------------------------
_HASH = "((seq * 1103515245 + 7 * 12345 + 12345) % 2147483648)"


@query(f"{WITH} SELECT seq FROM flows WHERE label = 1 OR {_HASH} < 0.5 * 2147483648")
def bal_undersample(spark, sf):
    return ops.undersampled(flows(spark, sf), F.col("seq"), F.col("label"), 0.5).select("seq")


@query(f"{WITH} SELECT seq FROM flows f WHERE label = 1 OR NOT EXISTS (SELECT 1 FROM flows m WHERE m.label = 1 AND m.port = f.port AND m.proto = f.proto AND m.flags = f.flags)")
def tomek_signature(spark, sf):
    return ops.without_cross_class(flows(spark, sf), ["port", "proto", "flags"], "label").select("seq")


@query(f"""{WITH}, x AS (SELECT seq, family, CASE WHEN uid % 17 = 0 THEN 1 ELSE 0 END AS y, port, uid FROM flows), m AS (SELECT DISTINCT port, uid % 40 AS u FROM x WHERE y = 1), b AS (SELECT * FROM x WHERE y = 0 AND NOT EXISTS (SELECT 1 FROM m WHERE m.port = x.port AND m.u = x.uid % 40)),
 n AS (SELECT (SELECT count(*) FROM b) AS n0, (SELECT count(*) FROM x WHERE y = 1) AS n1), t AS (SELECT n1, greatest(n1, least(CAST(floor(n0 / 1.5) AS BIGINT), n1 * 5)) AS target FROM n),
 k AS (SELECT seq, 0 AS copy FROM (SELECT seq, row_number() OVER (ORDER BY {_HASH}, seq) AS r FROM b), t WHERE r <= floor(target * 1.5)),
 f AS (SELECT family, count(*) AS c FROM x WHERE y = 1 GROUP BY 1), o AS (SELECT seq, row_number() OVER (ORDER BY f.c, x.family, seq) - 1 AS r FROM x JOIN f ON x.family = f.family WHERE y = 1),
 g AS (SELECT seq, unnest(range(0, CAST(1 + (target - n1) // n1 + CASE WHEN r < (target - n1) % n1 THEN 1 ELSE 0 END AS BIGINT))) AS copy FROM o, t) SELECT * FROM k UNION ALL SELECT * FROM g""")
def bal_replicate(spark, sf):
    x = flows(spark, sf).select("seq", "family", (F.col("uid") % 17 == 0).cast("int").alias("y"), "port", (F.col("uid") % 40).alias("u"))
    return ops.rebalanced(x, "seq", ["port", "u"], "y", "family").select("seq", "copy")


_BALANCED = SQL["bal_replicate"].split(" SELECT * FROM k UNION ALL")[0]


@query(f"""{_BALANCED}, o2 AS (SELECT * FROM k UNION ALL SELECT * FROM g), z AS (SELECT o2.copy, x.y FROM o2 JOIN x ON x.seq = o2.seq)
 SELECT (SELECT count(*) FROM x WHERE y = 0) AS benign_before, (SELECT count(*) FROM x WHERE y = 1) AS malicious_before, count(*) FILTER (y = 0) AS benign_after, count(*) FILTER (y = 1) AS malicious_after,
 round((SELECT count(*) FROM x WHERE y = 0) / greatest(1, (SELECT count(*) FROM x WHERE y = 1))::DOUBLE, 2) AS ratio_before, round(count(*) FILTER (y = 0) / greatest(1, count(*) FILTER (y = 1))::DOUBLE, 2) AS ratio_after,
 (SELECT count(*) FROM x WHERE y = 0) - count(*) FILTER (y = 0 AND copy = 0) AS majority_removed, count(*) FILTER (copy > 0) AS minority_added FROM z""")
def balance_report(spark, sf):
    x = flows(spark, sf).select("seq", "family", (F.col("uid") % 17 == 0).cast("int").alias("y"), "port", (F.col("uid") % 40).alias("u"))
    return ops.balance_report(x, ops.rebalanced(x, "seq", ["port", "u"], "y", "family"), "y", "copy")


@query(f"{WITH}, n AS (SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM flows) SELECT seq, round(CASE WHEN label = 1 THEN greatest(1, n0 / n1::DOUBLE) ELSE greatest(1, n1 / n0::DOUBLE) END, 6) AS cost FROM flows, n")
def class_costs(spark, sf):
    return ops.class_costs(flows(spark, sf), "label").select("seq", F.round("cost", 6).alias("cost"))


@query(f"{WITH} SELECT seq, row_number() OVER (ORDER BY (seq * 1103515245 + 1337 * 12345 + 12345) % 2147483648, seq) - 1 AS place FROM flows")
def seeded_shuffle(spark, sf):
    """Places in the seeded order; tables.shuffled sorts by it."""
    x = flows(spark, sf).select("seq", ops.hashed_order(F.col("seq"), 1337).alias("h"))
    return numbered(x, "h", "place").select("seq", "place")


@query("SELECT l_shipmode, l_orderkey, l_linenumber, r FROM (SELECT l_returnflag AS l_shipmode, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_suppkey, l_quantity) AS r FROM lineitem) WHERE r <= 50")
def limit_per_file(spark, sf):
    """At most 50 rows of each part of the input (return flags stand for files)."""
    x = table(spark, sf, "lineitem").withColumn("l_shipmode", F.col("l_returnflag"))
    return ops.first_of_each(x, "l_shipmode", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity"], 50).select("l_shipmode", "l_orderkey", "l_linenumber", "r")


@query(f"{WITH}, x AS (SELECT proto, us // 3600000000 AS span, row_number() OVER (PARTITION BY us // 3600000000 ORDER BY us, seq) AS r FROM flows) SELECT proto, count(*) AS seen, count(*) FILTER (r > 3) AS lost FROM x GROUP BY proto")
def load_shedding(spark, sf):
    """At most three records an hour pass; the others are counted as lost."""
    return ops.shed(flows(spark, sf), 3_600_000_000, 3).groupBy("proto").agg(F.count("*").alias("seen"), F.count_if("lost").alias("lost"))


@query(f"{WITH} SELECT proto, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets, round(avg(len), 6) AS mean_len FROM flows GROUP BY proto")
def protocol_mix(spark, sf):
    return flows(spark, sf).groupBy("proto").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"), F.round(F.avg("len"), 6).alias("mean_len"))


_VEC = "CAST(embedding AS DOUBLE[])"


@query(f"""WITH e AS (SELECT vec_id, {_VEC} AS v, coalesce(label < 5, false) AS y FROM embeddings),
 p AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id AND a.y = b.y),
 k AS (SELECT id, neighbour, d, row_number() OVER (PARTITION BY id ORDER BY d, neighbour) AS rank FROM p) SELECT id, rank, neighbour, round(d * d, 6) AS distance FROM k WHERE rank <= 5""")
def nearest_neighbours(spark, sf):
    """Neighbours of the same class, in both classes."""
    e = table(spark, sf, "embeddings")
    of = lambda rows: ops.nearest_rows(e.filter(rows), "vec_id", "embedding", 5)
    return of("label < 5").unionByName(of("label >= 5 OR label IS NULL")).select("id", "rank", "neighbour", F.round("distance", 6).alias("distance"))


@query(f"""WITH e AS (SELECT vec_id, {_VEC} AS v, label < 5 AS y FROM embeddings), p AS (SELECT a.vec_id AS id, arg_min(b.vec_id, list_distance(a.v, b.v)) AS nb FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY 1)
 SELECT p.id, p.nb AS neighbour FROM p JOIN p q ON q.id = p.nb AND q.nb = p.id JOIN e a ON a.vec_id = p.id JOIN e b ON b.vec_id = p.nb WHERE a.y <> b.y""")
def tomek_links(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("y", F.col("label") < 5)
    return ops.tomek_links(e, "vec_id", "embedding", "y").select("id", "neighbour")


_SMOTE = f"""s AS (SELECT count(*) FILTER (label < 3) AS n1, count(*) FILTER (NOT coalesce(label < 3, false)) AS n0 FROM embeddings),
 e AS (SELECT vec_id, {_VEC} AS v, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS total, abs(n0 - n1) AS need FROM embeddings, s WHERE coalesce(label < 3, false) = (n1 < n0)),
 p AS (SELECT a.vec_id AS id, b.vec_id AS nb, b.v AS y, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank FROM e a JOIN e b ON a.vec_id <> b.vec_id),
 c AS (SELECT vec_id, v, need, i + unnest(range(0, 1 + (need - 1) // total)) * total AS number FROM e), d AS (SELECT * FROM c WHERE number < need),
 g AS (SELECT d.number, d.vec_id AS id, p.nb AS neighbour, ((d.number * 1103515245 + 8 * 12345 + 12345) % 2147483648) / 2147483648.0 AS g, d.v, p.y
  FROM d JOIN p ON p.id = d.vec_id AND p.rank = ((d.number * 1103515245 + 7 * 12345 + 12345) % 2147483648) % 5 + 1)"""


def _small_class(spark, sf):
    """The smaller of two classes, and how many rows it lacks."""
    e = table(spark, sf, "embeddings").withColumn("y", F.coalesce(F.col("label") < 3, F.lit(False)))
    sizes = {r.y: r["count"] for r in e.groupBy("y").count().collect()}
    one, zero = sizes.get(True, 0), sizes.get(False, 0)
    return e, e.filter(F.col("y") == F.lit(one < zero)), abs(zero - one) if one and zero else 0


@query(f"WITH {_SMOTE} SELECT number, id, neighbour, round(v[1] + g * (y[1] - v[1]), 6) AS first, round(v[64] + g * (y[64] - v[64]), 6) AS last FROM g")
def smote_knn(spark, sf):
    """As many points as the smaller class lacks, at a target ratio of 1."""
    _, small, need = _small_class(spark, sf)
    out = ops.smote(small, "vec_id", "embedding", need)
    return out.select("number", "id", "neighbour", F.round(F.col("vector")[0], 6).alias("first"), F.round(F.col("vector")[63], 6).alias("last"))


@query(f"""WITH {_SMOTE}, m AS (SELECT (SELECT max(vec_id) FROM embeddings) AS m),
 u AS (SELECT vec_id, {_VEC} AS v, coalesce(label < 3, false) AS y FROM embeddings UNION ALL SELECT m + 1 + number, list_transform(range(1, 65), lambda i: g.v[i] + g.g * (g.y[i] - g.v[i])), (SELECT n1 < n0 FROM s) FROM g, m),
 r AS (SELECT a.vec_id AS a, b.vec_id AS b, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS k FROM u a JOIN u b ON a.vec_id <> b.vec_id),
 n AS (SELECT a, b FROM r WHERE k = 1), l AS (SELECT n.a FROM n JOIN n o ON n.b = o.a AND n.a = o.b JOIN u x ON x.vec_id = n.a JOIN u z ON z.vec_id = n.b WHERE x.y <> z.y AND x.y <> (SELECT n1 < n0 FROM s))
 SELECT vec_id, y, vec_id > (SELECT m FROM m) AS synthetic FROM u WHERE vec_id NOT IN (SELECT a FROM l)""")
def smote_tomek(spark, sf):
    """Rows after synthesis and the removal of linked rows of the larger class."""
    e, _, need = _small_class(spark, sf)
    out = ops.smote_tomek(e, "vec_id", "embedding", "y", need)
    return out.select("vec_id", "y", "synthetic")


@query("SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY customers DESC, n_name LIMIT 10")
def top_labels(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf, "customer").join(n, "c_nationkey").groupBy("n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance")).orderBy(F.desc("customers"), "n_name").limit(10)


@query(f"{WITH} SELECT seq, r FROM (SELECT seq, row_number() OVER (PARTITION BY src ORDER BY us, seq) AS r, count(*) OVER (PARTITION BY src) AS n FROM flows) WHERE r % greatest(1, n // 10) = 0 AND r // greatest(1, n // 10) <= 10")
def stride_sample(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("src")
    x = flows(spark, sf).select("seq", F.row_number().over(w.orderBy("us", "seq")).alias("r"), F.count("*").over(w).alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 10).cast("long"))
    return x.filter((F.col("r") % step == 0) & (F.floor(F.col("r") / step) <= 10)).select("seq", "r")


@query(f"{WITH} SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY src ORDER BY us DESC, seq DESC) AS r FROM flows) WHERE r <= 20")
def ring_buffer(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("src").orderBy(F.desc("us"), F.desc("seq"))
    return flows(spark, sf).select("seq", F.row_number().over(w).alias("r")).filter("r <= 20").select("seq")
