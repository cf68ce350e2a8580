"""Queries over single rows: normalisation, decisions, renderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import flow as fx
from .tables import FLOWS, flows, query, table

WITH = f"WITH {FLOWS}"


@query("""SELECT o_orderkey, replace(replace(lower(trim(o_orderpriority)), '_', ' '), '-', ' ') AS norm,
  CASE WHEN lower(o_orderpriority) LIKE '%not specified%' THEN 'Benign-Traffic' WHEN o_orderstatus = 'F' THEN ' NORMAL ' WHEN o_orderstatus = 'O' THEN 'DDoS' ELSE '0' END AS label,
  NOT (lower(o_orderpriority) NOT LIKE '%not specified%' AND o_orderstatus = 'O') AS benign FROM orders""")
def label_normalise(spark, sf):
    label = F.when(F.lower("o_orderpriority").contains("not specified"), "Benign-Traffic").when(F.col("o_orderstatus") == "F", " NORMAL ").when(F.col("o_orderstatus") == "O", "DDoS").otherwise("0")
    return table(spark, sf, "orders").select("o_orderkey", fx.normal_label(F.col("o_orderpriority")).alias("norm"), label.alias("label"), fx.is_benign(label).alias("benign"))


@query("""SELECT c_custkey, CASE c_nationkey WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' ELSE upper(c_mktsegment) END AS proto,
  CASE WHEN c_nationkey < 9 THEN 'TCP' WHEN c_nationkey < 17 THEN 'UDP' WHEN c_nationkey < 20 THEN 'ICMP' ELSE 'OTHER' END AS hot FROM customer""")
def proto_map(spark, sf):
    n = F.col("c_nationkey")
    code = F.when(n.isin(1, 6, 17), n.cast("string")).otherwise(F.lower("c_mktsegment"))
    one = lambda low, high: ((n >= low) & (n < high)).cast("double")
    return table(spark, sf, "customer").select("c_custkey", fx.protocol(code).alias("proto"), fx.protocol_of_flags(one(0, 9), one(9, 17), one(17, 20)).alias("hot"))


@query(f"""{WITH} SELECT seq, CASE WHEN len * 10 < 1 THEN 0 ELSE least(9, CAST(floor(2 * log10(greatest(len * 10, 1.0))) AS INT)) END AS band,
  '10.99.' || (CASE WHEN len * 10 < 1 THEN 0 ELSE least(9, CAST(floor(2 * log10(greatest(len * 10, 1.0))) AS INT)) END) || '.' ||
  ((8 * (port % 2) + 4 * (port % 3) + 2 * (port % 5) + port % 7) % 256) AS entity FROM flows""")
def surrogate_entity(spark, sf):
    port = F.col("port")
    return flows(spark, sf).select("seq", fx.rate_band(F.col("len") * 10).alias("band"), fx.surrogate_source(F.col("len") * 10, port % 2, port % 3, port % 5, port % 7).alias("entity"))


@query(f"{WITH} SELECT seq, CASE WHEN port % 4 = 1 THEN 443 WHEN port % 3 = 1 THEN 80 WHEN port % 5 = 1 THEN 53 ELSE 0 END AS dst_port FROM flows")
def default_port(spark, sf):
    on = lambda k: (F.col("port") % k == 1).cast("double")
    return flows(spark, sf).select("seq", fx.default_port(on(4), on(3), on(5)).alias("dst_port"))


@query(f"""{WITH} SELECT seq, (port % 2) + 2 * (port // 2 % 2) + 4 * (port // 4 % 2) + 8 * (port // 8 % 2) + 16 * (port // 16 % 2) AS bits,
  (flags & 2) <> 0 AND (flags & 16) = 0 AS syn_only FROM flows""")
def flag_bits(spark, sf):
    bit = lambda k: F.shiftright("port", k) % 2
    return flows(spark, sf).select("seq", fx.flag_bits(bit(0), bit(1), bit(2), bit(3), bit(4)).alias("bits"), fx.syn_only(F.col("flags")).alias("syn_only"))


@query("""SELECT event_id AS seq, greatest(1, least(65535, CASE WHEN event_type = 'error' THEN 64 WHEN CAST(trunc(value * 300) AS BIGINT) = 0 THEN 64 ELSE CAST(trunc(value * 300) AS BIGINT) END))::INT AS pkt_len FROM events""")
def len_clamp(spark, sf):
    text = F.when(F.col("event_type") == "error", "n/a").otherwise((F.col("value") * 300).cast("string"))
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), fx.packet_length(text).alias("pkt_len"))


@query("""SELECT c_custkey, round(sign(c_acctbal) * ln(1 + abs(c_acctbal)), 6) AS slog FROM customer""")
def slog(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.round(fx.signed_log(F.col("c_acctbal")), 6).alias("slog"))


@query("""SELECT c_custkey, round(1 / (1 + exp(-greatest(-8, least(8, c_acctbal / 500)))), 6) AS p8, round(1 / (1 + exp(-greatest(-30, least(30, c_acctbal / 100)))), 6) AS p30 FROM customer""")
def sigmoid(spark, sf):
    x = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", F.round(fx.sigmoid(x / 500, 8), 6).alias("p8"), F.round(fx.sigmoid(x / 100, 30), 6).alias("p30"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'benign' WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'attack' WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE 'F' END AS family FROM orders""")
def family_column(spark, sf):
    label = F.when(F.col("o_orderstatus") == "O", "0").when(F.col("o_orderstatus") == "P", "1").otherwise("F")
    category = F.when(F.col("o_orderkey") % 3 == 0, "-").otherwise(F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", fx.family(label, category).alias("family"))


DECIDED = f"""{WITH}, decided AS (SELECT *, (uid % 10) / 10.0 AS susp, CASE
  WHEN port % 10 = 0 AND score > 0.22 THEN 'REDIRECT' WHEN score > 0.3 AND (uid % 10) / 10.0 > 0.6 AND score - 0.3 > 0.12 AND (uid % 10) / 10.0 > 0.85 THEN 'QUARANTINE'
  WHEN score > 0.3 AND (uid % 10) / 10.0 > 0.6 AND score - 0.3 > 0.12 THEN 'DROP' WHEN score > 0.3 THEN 'RATE_LIMIT' WHEN score > 0.22 THEN 'MIRROR' ELSE 'PASS' END AS action,
  CASE WHEN port % 10 = 0 AND score > 0.22 THEN 'high' WHEN score > 0.3 AND (uid % 10) / 10.0 > 0.6 AND score - 0.3 > 0.12 AND (uid % 10) / 10.0 > 0.85 THEN 'critical'
  WHEN score > 0.3 AND (uid % 10) / 10.0 > 0.6 AND score - 0.3 > 0.12 THEN 'high' WHEN score > 0.3 THEN 'medium' WHEN score > 0.22 THEN 'low' ELSE 'info' END AS severity FROM flows)"""


def decided(spark, sf):
    """Flows with a decision: fixed thresholds 0.3 and 0.22, suspicion by source."""
    f = flows(spark, sf).withColumn("susp", (F.col("uid") % 10) / 10.0)
    d = fx.choose_action(F.col("score"), F.lit(0.3), F.lit(0.22), F.col("susp"), F.col("port") % 10 == 0)
    return f.withColumn("d", d).select("*", "d.action", "d.severity").drop("d")


@query(f"{DECIDED} SELECT seq, action, severity FROM decided")
def choose_action(spark, sf):
    return decided(spark, sf).select("seq", "action", "severity")


@query(f"""{DECIDED} SELECT action, count(*) AS n, round(avg(score), 6) AS mean_score,
  CASE action WHEN 'PASS' THEN 'none' WHEN 'LOG' THEN 'record only' WHEN 'MIRROR' THEN 'copy to observation port' WHEN 'RATE_LIMIT' THEN 'token bucket on the flow'
  WHEN 'REDIRECT' THEN 'route to decoy' WHEN 'DROP' THEN 'discard packets of the flow' ELSE 'isolate the source' END AS mitigation FROM decided GROUP BY action""")
def action_mix(spark, sf):
    return decided(spark, sf).groupBy("action").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score")).withColumn("mitigation", fx.mitigation(F.col("action")))


@query(f"""{DECIDED} SELECT seq, CASE severity WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 ELSE 0 END AS rank,
  action IN ('DROP','QUARANTINE','RATE_LIMIT','REDIRECT') AS flagged, action IN ('DROP','QUARANTINE') AS would_drop,
  CASE WHEN action IN ('DROP','QUARANTINE') THEN 20.0 ELSE 1.0 END AS ipw, CASE severity WHEN 'critical' THEN 'critical' WHEN 'info' THEN 'info' ELSE 'warning' END AS pager FROM decided""")
def sev_rank(spark, sf):
    d = decided(spark, sf)
    drop = F.col("action").isin(*fx.DROPPING)
    return d.select("seq", fx.severity_rank(F.col("severity")).alias("rank"), F.col("action").isin(*fx.ENFORCING).alias("flagged"), drop.alias("would_drop"), (1 / fx.propensity(drop)).alias("ipw"), fx.pager_severity(F.col("severity")).alias("pager"))


@query(f"{WITH} SELECT seq, score > 0.8 OR (flags = 2 AND len < 60) OR port / 100.0 > 0.7 AS verdict FROM flows")
def rule_baseline(spark, sf):
    return flows(spark, sf).select("seq", fx.static_verdict(F.col("score"), F.col("flags"), F.col("len"), F.col("port") / 100.0).alias("verdict"))


@query(f"{DECIDED} SELECT seq, round(greatest(0.0, least(1.0, score * (1 + 0.6 * (susp - 0.5)))), 6) AS agg FROM decided")
def trust_modulate(spark, sf):
    return decided(spark, sf).select("seq", F.round(fx.trust_modulated(F.col("score"), F.col("susp")), 6).alias("agg"))


@query(f"""{DECIDED} SELECT round(sum(CASE WHEN label = 0 AND action IN ('DROP','QUARANTINE','RATE_LIMIT','REDIRECT') THEN CASE WHEN action IN ('DROP','QUARANTINE') THEN 20.0 ELSE 1.0 END ELSE 0 END)
  / sum(CASE WHEN label = 0 THEN CASE WHEN action IN ('DROP','QUARANTINE') THEN 20.0 ELSE 1.0 END ELSE 0 END), 8) AS fpr FROM decided""")
def ipw_fpr(spark, sf):
    w = 1 / fx.propensity(F.col("action").isin(*fx.DROPPING))
    benign = F.col("label") == 0
    return decided(spark, sf).agg(F.round(F.sum(F.when(benign & F.col("action").isin(*fx.ENFORCING), w).otherwise(0)) / F.sum(F.when(benign, w).otherwise(0)), 8).alias("fpr"))


@query(f"{WITH} SELECT seq, round(1 / (1 + exp(-(2.6 * port / 100.0 + 2.2 * (CASE WHEN (flags & 2) <> 0 AND (flags & 16) = 0 THEN 1 ELSE 0 END) + 2.0 * score + 1.4 * (uid % 7) / 7.0 + 1.8 * (uid % 5) / 5.0 - 1.2))), 6) AS p FROM flows")
def linear_head(spark, sf):
    u = F.col("uid")
    return flows(spark, sf).select("seq", F.round(fx.linear_head({"dst_fanout": F.col("port") / 100.0, "syn_ratio": fx.syn_only(F.col("flags")).cast("int"), "pps": F.col("score"), "port_entropy": (u % 7) / 7.0, "byte_asymmetry": (u % 5) / 5.0}), 6).alias("p"))


@query(f"""{WITH}, c AS (SELECT seq, unnest([{{'f':'pkt_len','i':0,'v':0.4*(len/1500.0)}},{{'f':'dst_fanout','i':3,'v':2.6::DOUBLE*(port/100.0)}},{{'f':'port_entropy','i':4,'v':1.4::DOUBLE*((uid%7)/7.0)}},{{'f':'pps','i':6,'v':2.0*score}},{{'f':'iat','i':1,'v':-0.6::DOUBLE*((uid%3)/3.0)}},{{'f':'syn_ratio','i':2,'v':0.0}},{{'f':'byte_asymmetry','i':5,'v':0.0}}]) AS x FROM flows),
 r AS (SELECT seq, x.f AS f, row_number() OVER (PARTITION BY seq ORDER BY abs(x.v) DESC, x.i) AS k FROM c)
 SELECT seq, max(CASE k WHEN 1 THEN f END) AS first, max(CASE k WHEN 2 THEN f END) AS second, max(CASE k WHEN 3 THEN f END) AS third FROM r GROUP BY seq""")
def additive_attr(spark, sf):
    u, zero = F.col("uid"), F.lit(0.0)
    top = fx.top_contributions({"pkt_len": F.col("len") / 1500.0, "dst_fanout": F.col("port") / 100.0, "port_entropy": (u % 7) / 7.0, "pps": F.col("score"), "iat": (u % 3) / 3.0, "syn_ratio": zero, "byte_asymmetry": zero})
    return flows(spark, sf).withColumn("t", top).select("seq", F.col("t")[0]["feature"].alias("first"), F.col("t")[1]["feature"].alias("second"), F.col("t")[2]["feature"].alias("third"))


def mix32_sql(x: str, seed: int) -> str:
    """The hash of flow.mix32 as a SQL expression."""
    h = f"CAST((xor({x}, {seed}::BIGINT)::HUGEINT * 2654435761) % 4294967296 AS BIGINT)"
    h = f"CAST((xor({h}, {h} >> 15)::HUGEINT * 2246822519) % 4294967296 AS BIGINT)"
    return f"xor({h}, {h} >> 13)"


@query(f"""WITH f AS (SELECT c_custkey, {mix32_sql("c_custkey", 42)} AS h FROM customer)
 SELECT c_custkey, h AS mixed, CASE WHEN h = 0 THEN 32 ELSE 32 - length(bin(h)) END AS zeros FROM f""")
def mix_hash(spark, sf):
    h = fx.mix32(F.col("c_custkey"), 42)
    return table(spark, sf, "customer").select("c_custkey", h.alias("mixed"), fx.leading_zeros32(h).alias("zeros"))


@query("""SELECT s_suppkey, 10 * 16777216 + (s_nationkey % 256) * 65536 + (s_suppkey // 256 % 256) * 256 + s_suppkey % 256 AS number FROM supplier""")
def ipv4_numbers(spark, sf):
    address = F.format_string("10.%d.%d.%d", F.col("s_nationkey") % 256, (F.floor(F.col("s_suppkey") / 256) % 256).cast("long"), F.col("s_suppkey") % 256)
    return table(spark, sf, "supplier").select("s_suppkey", fx.ipv4_number(address).alias("number"))


LINE = "printf('%.4f', round(score, 4))"


@query(f"""{DECIDED} SELECT seq, '[ALERT] ' || upper(severity) || ' ' || action || ' src=' || src || ' dst=' || dst || ' score=' || {LINE} || ' reason=score over threshold' AS line FROM decided WHERE action <> 'PASS'""")
def alert_summary(spark, sf):
    d = decided(spark, sf).filter("action <> 'PASS'")
    return d.select("seq", fx.alert_summary(F.col("severity"), F.col("action"), F.col("src"), F.col("dst"), F.round("score", 4), F.lit("score over threshold")).alias("line"))


@query(f"""{DECIDED} SELECT seq, 'CEF:0|rivulet|flows|1.0|' || action || '|score over threshold|' || (CASE severity WHEN 'medium' THEN 6 WHEN 'high' THEN 8 WHEN 'critical' THEN 10 ELSE 3 END) || '|src=' || src || ' dst=' || dst || ' act=' || action || ' cs1Label=reason cs1=score over threshold cn1Label=aggregate cn1=' || {LINE} AS line FROM decided WHERE action <> 'PASS'""")
def cef_lines(spark, sf):
    d = decided(spark, sf).filter("action <> 'PASS'")
    return d.select("seq", fx.cef(F.col("severity"), F.col("action"), F.col("src"), F.col("dst"), F.round("score", 4), F.lit("score over threshold")).alias("line"))
