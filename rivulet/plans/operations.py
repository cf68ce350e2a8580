"""Queries over rules, alerts, merges and energy."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import alerts, engine, mesh, rules
from ..operators.discovery import rolling_cutoffs
from .projections import DECIDED, decided
from .states import alert_dedup, stepped  # noqa: F401  (its SQL is a part of others)
from .tables import DAY, FLOWS, SQL, flows, query, table

WITH = f"WITH {FLOWS}"
_X = "x AS (SELECT score AS a, port / 100.0 AS b, (uid % 97) / 97.0 AS c, CASE WHEN port > 85 AND seq % 50 <> 0 THEN 1 ELSE 0 END AS y FROM flows)"


def _windowed(spark, sf):
    f = flows(spark, sf)
    return f.select(F.col("score").alias("a"), (F.col("port") / 100.0).alias("b"), ((F.col("uid") % 97) / 97.0).alias("c"), ((F.col("port") > 85) & (F.col("seq") % 50 != 0)).cast("int").alias("y"))


_Q = ", ".join(f"quantile_cont({c}, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q{c}" for c in "abc")
_STUMPS = " UNION ALL ".join(f"SELECT '{c}' AS feature, '>' AS op, q{c}[k] AS threshold, NULL AS feature2, NULL AS op2, NULL::DOUBLE AS threshold2, {9 * i} + k AS k FROM q, range(1, 10) t(k)" for i, c in enumerate("abc"))
_PAIRS = " UNION ALL ".join(
    f"SELECT '{f}', CASE WHEN o < 2 THEN '>' ELSE '<' END, q{f}[i], '{g}', CASE WHEN o % 2 = 0 THEN '>' ELSE '<' END, q{g}[j], 28 + {n} * 100 + ((i - 1) // 2) * 20 + ((j - 1) // 2) * 4 + o FROM q, range(1, 10, 2) s(i), range(1, 10, 2) t(j), range(4) u(o)" for n, (f, g) in enumerate((("a", "b"), ("a", "c"), ("b", "c")))
)
_VALUE = lambda f: f"CASE r.{f} WHEN 'a' THEN a WHEN 'b' THEN b ELSE c END"
_HOLDS = f"(CASE r.op WHEN '>' THEN {_VALUE('feature')} > r.threshold ELSE {_VALUE('feature')} < r.threshold END) AND (r.feature2 IS NULL OR CASE r.op2 WHEN '>' THEN {_VALUE('feature2')} > r.threshold2 ELSE {_VALUE('feature2')} < r.threshold2 END)"


@query(f"""{WITH}, {_X}, q AS (SELECT {_Q} FROM x), r AS ({_STUMPS} UNION ALL {_PAIRS}), h AS (SELECT r.feature, r.op, r.threshold, r.feature2, r.op2, r.threshold2, r.k AS "at", count(*) AS hits, sum(y) AS rights FROM r JOIN x ON {_HOLDS} GROUP BY ALL),
 e AS (SELECT *, rights / hits::DOUBLE AS fidelity, hits / (SELECT count(*) FROM x)::DOUBLE AS coverage FROM h), k AS (SELECT * FROM e WHERE coverage BETWEEN 0.05 AND 0.9 AND hits >= 20 AND fidelity >= 0.95 ORDER BY round(round(fidelity, 3) * round(coverage, 3), 9) DESC, "at" LIMIT 4)
 SELECT feature, op, round(threshold, 4) AS threshold, feature2, op2, round(threshold2, 4) AS threshold2, round(fidelity, 3) AS fidelity, round(coverage, 3) AS coverage,
 feature || ' ' || op || ' ' || printf('%.3f', threshold) || coalesce(' AND ' || feature2 || ' ' || op2 || ' ' || printf('%.3f', threshold2), '') AS rule FROM k""")
def distill_rules(spark, sf):
    return rules.distilled(_windowed(spark, sf), ["a", "b", "c"], "y")


@query(f"{WITH}, {_X} SELECT count(*) FILTER (b > 0.8) AS hits, count(*) FILTER (b > 0.8 AND y = 1) AS rights, round(count(*) FILTER (b > 0.8) / count(*)::DOUBLE, 6) AS coverage FROM x")
def rule_apply(spark, sf):
    hit = F.col("b") > 0.8
    return _windowed(spark, sf).agg(F.count_if(hit).alias("hits"), F.count_if(hit & (F.col("y") == 1)).alias("rights"), F.round(F.count_if(hit) / F.count("*"), 6).alias("coverage"))


@query(f"""{WITH}, p AS (SELECT round(power((port + 1) / 101.0, 3), 6) AS p FROM flows), r AS (SELECT p, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS n FROM p)
 SELECT CASE WHEN max(n) < 20 THEN 1.0 ELSE coalesce(max(p) FILTER (p <= 0.1 * k / n), 0.1 / max(n)) END AS cutoff FROM r""")
def bh_cutoff(spark, sf):
    p = F.round(F.pow((F.col("port") + 1) / 101.0, F.lit(3)), 6)
    return alerts.discovery_cutoff(flows(spark, sf).select(p.alias("p")))


@query(f"{DECIDED} SELECT src, count(*) AS alerts, min(us) AS first, string_agg(DISTINCT action, ',' ORDER BY action) AS actions FROM decided WHERE action <> 'PASS' GROUP BY src")
def campaigns(spark, sf):
    return alerts.campaigns(decided(spark, sf).filter("action <> 'PASS'"))


@query(f"{DECIDED}, a AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY us, seq) AS k FROM decided WHERE action <> 'PASS') SELECT seq, k AS campaign_count, 'al-' || CAST(floor(us / 1e6 * 1000) AS BIGINT) % 10000000 || '-' || k AS alert_id, round(1 - score, 4) AS fdr_p FROM a")
def alert_enriched(spark, sf):
    return alerts.enriched(decided(spark, sf).filter("action <> 'PASS'")).select("seq", "campaign_count", "alert_id", "fdr_p")


@query(f"""{DECIDED}, s AS (SELECT unnest(['elastic','siem','slack','rest','mail','pager']) AS sink, unnest([0, 0, 1, 2, 2, 3]) AS low)
 SELECT sink, severity, count(*) AS n FROM decided, s WHERE severity <> 'info' AND (CASE severity WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 ELSE 0 END) >= low GROUP BY 1, 2""")
def sink_routing(spark, sf):
    return alerts.routed(decided(spark, sf)).groupBy("sink", "severity").agg(F.count("*").alias("n"))


_SINKS = """k AS (SELECT unnest(['elastic','siem','slack','rest','mail','pager']) AS sink, unnest([0, 0, 1, 2, 2, 3]) AS low),
 sent AS (SELECT decided.*, sink FROM decided, k WHERE severity <> 'info' AND (CASE severity WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 ELSE 0 END) >= low)"""
_LEFT = "least(30.0, {tokens} + greatest(0, r.us - coalesce({at}, r.us)) / 1e6 * (0.03 / 60))"


@query(stepped("sent", "sink", {"tokens": "30.0::DOUBLE", "at": "NULL::BIGINT"}, {"tokens": f"CASE WHEN {_LEFT} >= 1 THEN {_LEFT} - 1 ELSE {_LEFT} END", "at": "r.us", "passed": f"{_LEFT} >= 1"}, "sink, seq, passed", f"{DECIDED.replace('WITH flows', 'WITH RECURSIVE flows', 1)}, {_SINKS}"))
def sink_limits(spark, sf):
    """What each sink's bucket lets through, at 43 alerts a day."""
    return alerts.rate_limited(alerts.routed(decided(spark, sf)), 0.03, 30.0).select("sink", "seq", "passed")


@query(f"{DECIDED} SELECT seq, us, action, severity FROM decided ORDER BY us DESC, seq DESC LIMIT 200")
def recent_events(spark, sf):
    return alerts.recent(decided(spark, sf)).select("seq", "us", "action", "severity")


@query(f"""{DECIDED} SELECT us, 'ttl_expiry' AS kind, '{{"action":"' || action || '","src":"' || src || '"}}' AS detail FROM decided WHERE action = 'QUARANTINE'""")
def audit_json(spark, sf):
    return alerts.audit(decided(spark, sf).filter("action = 'QUARANTINE'"), F.lit("ttl_expiry"), "src", "action")


@query(f"""{DECIDED}, m AS (SELECT action, count(*) AS v, row_number() OVER (ORDER BY action) AS r FROM decided GROUP BY action), l AS (SELECT 'flows_total{{action="' || action || '"}} ' || CAST(v AS VARCHAR) AS line FROM m)
 SELECT 'flows_total' AS name, line FROM l UNION ALL SELECT 'flows_total', '# HELP flows_total Flows by action' UNION ALL SELECT 'flows_total', '# TYPE flows_total counter'""")
def prometheus_text(spark, sf):
    m = decided(spark, sf).groupBy("action").agg(F.count("*").cast("double").alias("value"))
    rows = m.select(F.lit("flows_total").alias("name"), F.lit("counter").alias("kind"), F.lit("Flows by action").alias("help"), F.create_map(F.lit("action"), "action").alias("labels"), "value")
    return alerts.exposition(rows)


def _rolling(table: str, q: float, p: str = "1 - score") -> str:
    """f: seq and the cutoff of the last 500 rows of a table by (us, seq)."""
    levels = f"list_filter(range(1, len(l) + 1), lambda i: l[i] <= {q} * (i / CAST(len(l) AS DOUBLE)))"
    return f"""w AS (SELECT seq, list_sort(list({p}) OVER (ORDER BY us, seq ROWS 499 PRECEDING)) AS l FROM {table}),
 f AS (SELECT seq, CASE WHEN len(l) < 20 THEN 1.0 WHEN len({levels}) > 0 THEN l[list_max({levels})] ELSE {q} / len(l) END AS cutoff FROM w)"""


_ALERTS = f"""{DECIDED}, d AS ({SQL["alert_dedup"]}), offered AS (SELECT * FROM decided WHERE action <> 'PASS'), {_rolling("offered", 0.5)},
 a AS (SELECT x.*, row_number() OVER (PARTITION BY src ORDER BY us, x.seq) AS campaign_count FROM decided x JOIN d ON d.seq = x.seq AND d.shown JOIN f ON f.seq = x.seq WHERE x.action IN ('DROP', 'QUARANTINE', 'RATE_LIMIT', 'REDIRECT') OR 1 - score <= cutoff)"""


@query(f"{WITH}, x AS (SELECT seq, us, round(power((port + 1) / 101.0, 3), 6) AS p FROM flows), {_rolling('x', 0.1, 'p')} SELECT seq, round(cutoff, 9) AS cutoff FROM f")
def rolling_cutoff(spark, sf):
    """False-discovery cutoff of the last 500 flows, for each flow."""
    x = flows(spark, sf).select("seq", "us", F.round(F.pow((F.col("port") + 1) / 101.0, 3), 6).alias("p"))
    return rolling_cutoffs(x).select("seq", F.round("cutoff", 9).alias("cutoff"))


def _offered(spark, sf):
    return decided(spark, sf).filter("action <> 'PASS'")


@query(f"{_ALERTS} SELECT seq, action, campaign_count, 'al-' || CAST(floor(us / 1e6 * 1000) AS BIGINT) % 10000000 || '-' || campaign_count AS alert_id, round(1 - score, 4) AS fdr_p FROM a")
def alert_process(spark, sf):
    """Repeats in a day, false discoveries, campaigns: one call."""
    out = alerts.process(_offered(spark, sf), DAY, 0.5)
    return out.select("seq", "action", "campaign_count", "alert_id", "fdr_p")


@query(f"{_ALERTS} SELECT (SELECT count(*) FROM decided WHERE action <> 'PASS') AS alerts_total, (SELECT count(*) FROM decided WHERE action <> 'PASS') - count(*) AS alerts_suppressed, (SELECT round(cutoff, 4) FROM f JOIN offered USING (seq) ORDER BY us DESC, seq DESC LIMIT 1) AS bh_cutoff, count(DISTINCT src) AS active_campaigns FROM a")
def alert_stats(spark, sf):
    offered = _offered(spark, sf)
    return alerts.statistics(offered, alerts.process(offered, DAY, 0.5), 0.5)


_ENFORCED = "action IN ('DROP', 'QUARANTINE', 'RATE_LIMIT', 'REDIRECT')"
_W = "CASE WHEN action IN ('DROP', 'QUARANTINE') THEN 20.0 ELSE 1.0 END"


@query(f"""{_ALERTS}, s AS (SELECT count(*) AS packets, count(*) FILTER (action IN ('DROP', 'QUARANTINE')) AS dropped, count(*) FILTER (action = 'QUARANTINE') AS quarantined, count(*) / ((max(us) - min(us)) / 1e6) AS pps, sum(len) * 8 / ((max(us) - min(us)) / 1e6) AS bps,
  coalesce(sum({_W}) FILTER (label = 0 AND {_ENFORCED}), 0) / sum({_W}) FILTER (label = 0) AS fpr, count(*) FILTER (port > 70) / count(*)::DOUBLE AS hit,
  count(*) FILTER ({_ENFORCED} AND label = 1) AS tp, count(*) FILTER ({_ENFORCED} AND label = 0) AS fp, count(*) FILTER (NOT {_ENFORCED} AND label = 0) AS tn, count(*) FILTER (NOT {_ENFORCED} AND label = 1) AS fn FROM decided)
 SELECT packets, dropped, quarantined, round(pps, 6) AS pps, round(bps, 6) AS bps, round(fpr, 6) AS realized_fpr, round(fpr / 0.02, 4) AS budget_ratio, round(hit, 6) AS rule_hit_ratio, tp, fp, tn, fn, round(fn::DOUBLE / (fn + tp), 6) AS fnr,
  (SELECT count(*) FROM a) AS alerts, (SELECT count(DISTINCT src) FROM a) AS active_campaigns FROM s""")
def engine_snapshot(spark, sf):
    d = decided(spark, sf)
    out = engine.snapshot(d, alerts.process(d.filter("action <> 'PASS'"), DAY, 0.5), F.col("port") > 70)
    rounded = [F.round(c, 6).alias(c) for c in ("pps", "bps", "realized_fpr", "rule_hit_ratio")]
    return out.select("packets", "dropped", "quarantined", *rounded, F.round("budget_ratio", 4).alias("budget_ratio"), "tp", "fp", "tn", "fn", "fnr", "alerts", "active_campaigns")


# --- merges ----------------------------------------------------------------
@query(f"{WITH} SELECT dst || port AS ip, seq, src AS origin FROM flows QUALIFY row_number() OVER (PARTITION BY dst || port ORDER BY us // {DAY} DESC, seq) = 1")
def lww_merge(spark, sf):
    e = flows(spark, sf).select(F.concat("dst", F.col("port").cast("string")).alias("ip"), F.floor(F.col("us") / DAY).alias("us"), "seq", F.col("src").alias("origin"))
    return mesh.merged_intel(e, "ip").select("ip", "seq", "origin")


@query(f"""{WITH}, i AS (SELECT dst || port AS ip, max(us) AS us FROM flows WHERE score < 0.02 GROUP BY 1), n AS (SELECT max(us) AS now FROM flows) SELECT ip FROM i, n WHERE now - us <= {3 * DAY}""")
def intel_ttl(spark, sf):
    f = flows(spark, sf)
    intel = f.filter("score < 0.02").groupBy(F.concat("dst", F.col("port").cast("string")).alias("ip")).agg(F.max("us").alias("us"))
    return mesh.live_intel(intel.join(F.broadcast(f.agg(F.max("us").alias("now")))), F.col("now"), 3 * DAY).select("ip")


@query(f"{DECIDED} SELECT DISTINCT src FROM decided WHERE action IN ('DROP', 'QUARANTINE') AND 0.5 + score >= 0.95 AND proto <> 'TCP' AND src NOT IN (SELECT src FROM decided WHERE port = 7)")
def mesh_blocks(spark, sf):
    d = decided(spark, sf)
    return mesh.new_blocks(d.select("src", "action", F.col("proto").alias("origin"), (0.5 + F.col("score")).alias("confidence")), d.filter("port = 7").select("src").distinct(), "src", "TCP", 0.95)


_STATE = "CASE port % 8 WHEN 0 THEN 'SUSPECT' WHEN 1 THEN 'DEAD' WHEN 2 THEN 'LEFT' ELSE 'ALIVE' END"
_MEMBERS = f"""m AS (SELECT uid AS node, port // 25 AS incarnation, {_STATE} AS state, seq AS heartbeat FROM flows), t AS (SELECT node, max(incarnation) AS incarnation FROM m GROUP BY node),
 g AS (SELECT m.node, m.incarnation, arg_max(state, CASE state WHEN 'SUSPECT' THEN 1 WHEN 'LEFT' THEN 2 WHEN 'DEAD' THEN 3 ELSE 0 END) AS state, max(heartbeat) AS heartbeat FROM m JOIN t ON m.node = t.node AND m.incarnation = t.incarnation GROUP BY 1, 2)"""


def _rumours(spark, sf):
    p = F.col("port") % 8
    state = F.when(p == 0, "SUSPECT").when(p == 1, "DEAD").when(p == 2, "LEFT").otherwise("ALIVE")
    return flows(spark, sf).select(F.col("uid").alias("node"), F.floor(F.col("port") / 25).alias("incarnation"), state.alias("state"), F.col("seq").alias("heartbeat"))


def _members(spark, sf):
    return mesh.merged_members(_rumours(spark, sf))


@query(f"{WITH}, {_MEMBERS} SELECT node, incarnation, state, heartbeat FROM g")
def member_merge(spark, sf):
    return _members(spark, sf)


@query(f"{WITH}, {_MEMBERS} SELECT count(*) FILTER (state = 'ALIVE') AS alive, count(*) FILTER (state = 'SUSPECT') AS suspect, count(*) FILTER (state = 'DEAD') AS dead, count(*) FILTER (state = 'ALIVE') > count(*) / 2.0 AS quorum FROM g")
def cluster_health(spark, sf):
    return mesh.health(_members(spark, sf))


@query(f"{WITH}, x AS (SELECT seq, uid, port * 3 AS e, row_number() OVER (PARTITION BY uid ORDER BY us, seq) AS n FROM flows) SELECT seq, n + greatest(0, max(e - n + 1) OVER (PARTITION BY uid ORDER BY n)) AS own_clock FROM x")
def lamport_clock(spark, sf):
    e = flows(spark, sf).select("seq", "us", "uid", (F.col("port") * 3).alias("e"))
    return mesh.lamport(e, "uid", "e", ["us", "seq"]).select("seq", "own_clock")


@query(f"""{WITH}, {_MEMBERS}, b AS (SELECT node, max(incarnation) AS bad FROM m WHERE state IN ('SUSPECT', 'DEAD') GROUP BY node) SELECT g.node, CASE WHEN bad >= g.incarnation THEN bad + 1 ELSE g.incarnation END AS incarnation FROM g LEFT JOIN b ON b.node = g.node""")
def refutation(spark, sf):
    return mesh.refuted(_members(spark, sf), _rumours(spark, sf).drop("heartbeat")).select("node", "incarnation")


@query(f"{WITH}, t AS (SELECT uid, len FROM flows QUALIFY row_number() OVER (PARTITION BY uid ORDER BY us DESC, seq DESC) = 1) SELECT count(*) AS nodes, round(sum(len), 4) AS total FROM t")
def telemetry_latest(spark, sf):
    t = flows(spark, sf).select(F.col("uid").alias("node"), "us", "seq", "len")
    return mesh.latest_telemetry(t).agg(F.count("*").alias("nodes"), F.round(F.sum("len"), 4).alias("total"))


@query(f"{WITH} SELECT proto, count(*) AS n FROM (SELECT proto FROM flows ORDER BY us DESC, seq DESC LIMIT 60) GROUP BY proto")
def intel_by_origin(spark, sf):
    return mesh.intel_by_origin(flows(spark, sf), "proto")


@query(f"{WITH}, c AS (SELECT seq, uid, us, sum(port + 1) OVER (PARTITION BY uid ORDER BY us) AS t, sum((port + 1) // 3) OVER (PARTITION BY uid ORDER BY us) AS i FROM flows), d AS (SELECT seq, t - lag(t) OVER w AS dt, i - lag(i) OVER w AS di FROM c WINDOW w AS (PARTITION BY uid ORDER BY us)) SELECT seq, round(CASE WHEN dt > 0 THEN 100.0 * (dt - di) / dt ELSE 0 END, 6) AS cpu FROM d")
def host_cpu(spark, sf):
    w = Window.partitionBy("uid").orderBy("us")
    s = flows(spark, sf).select("seq", "uid", "us", F.sum(F.col("port") + 1).over(w).alias("t"), F.sum(F.floor((F.col("port") + 1) / 3)).over(w).alias("i"))
    return mesh.cpu_percent(s, "uid", "t", "i").select("seq", F.round("cpu_percent", 6).alias("cpu"))


@query("""WITH c AS (SELECT n_nationkey AS k, n_nationkey % 3 AS x, n_nationkey % 4 AS y, n_nationkey % 5 AS z FROM nation)
 SELECT a.k AS a, b.k AS b, (a.x >= b.x AND a.y >= b.y AND a.z >= b.z) AND (a.x > b.x OR a.y > b.y OR a.z > b.z) AS dominates,
 ((a.x >= b.x AND a.y >= b.y AND a.z >= b.z) AND (a.x > b.x OR a.y > b.y OR a.z > b.z)) OR (NOT ((b.x >= a.x AND b.y >= a.y AND b.z >= a.z) AND (b.x > a.x OR b.y > a.y OR b.z > a.z)) AND a.k < b.k) AS takes,
 greatest(a.x, b.x) + greatest(a.y, b.y) + greatest(a.z, b.z) AS merged FROM c a JOIN c b ON a.k % 2 = b.k % 2""")
def vclock_dominates(spark, sf):
    k = F.col("n_nationkey")
    clock = lambda n: F.create_map(F.lit("x"), k % 3, F.lit("y"), k % 4, F.lit("z"), k % 5).alias(n)
    n = table(spark, sf, "nation")
    a, b = n.select(k.alias("a"), (k % 2).alias("h"), clock("ca")), n.select(k.alias("b"), (k % 2).alias("h"), clock("cb"))
    j = a.join(b, "h")
    total = F.aggregate(F.map_values(mesh.clock_merge(F.col("ca"), F.col("cb"))), F.lit(0), lambda s, v: s + v)
    return j.select("a", "b", mesh.clock_dominates(F.col("ca"), F.col("cb")).alias("dominates"), mesh.takes_policy(F.col("ca"), F.col("cb"), F.col("a"), F.col("b")).alias("takes"), total.alias("merged"))


_TRIM = "u AS (SELECT label, vec_id, unnest(range(1, 65)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings)"


@query(f"""WITH {_TRIM}, r AS (SELECT *, row_number() OVER (PARTITION BY label, i ORDER BY v) AS r, count(*) OVER (PARTITION BY label, i) AS n FROM u), m AS (SELECT label, i, avg(v) AS v FROM r WHERE r > floor(n * 0.2) AND r <= n - floor(n * 0.2) GROUP BY 1, 2)
 SELECT label, round(sum(v), 6) AS total, round(max(CASE i WHEN 1 THEN v END), 6) AS first FROM m GROUP BY label""")
def trimmed_mean(spark, sf):
    out = mesh.trimmed_mean(table(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v")), "label", "v")
    return out.select("label", F.round(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.round(F.col("vector")[0], 6).alias("first"))


_KRUM = """e AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT label, count(*) AS n FROM e GROUP BY 1), d AS (SELECT a.label, a.vec_id, list_distance(a.v, b.v) ** 2 AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE list_distance(a.v, b.v) END) AS r FROM e a JOIN e b ON a.label = b.label),
 s AS (SELECT d.label, vec_id, sum(d) AS score FROM d JOIN n ON n.label = d.label WHERE r BETWEEN 2 AND n - 2 GROUP BY 1, 2), k AS (SELECT label, arg_min(vec_id, score) AS id, min(score) AS score FROM s GROUP BY label)"""


@query(f"WITH {_KRUM} SELECT label, id, round(score, 5) AS score FROM k")
def krum(spark, sf):
    out = mesh.krum(table(spark, sf, "embeddings"), "label", "vec_id", "embedding")
    return out.select("label", "id", F.round("score", 5).alias("score"))


_PAIRS = "g AS (SELECT vec_id // 3 AS g, vec_id, CAST(embedding AS DOUBLE[]) AS v, count(*) OVER (PARTITION BY vec_id // 3) AS n FROM embeddings)"


@query(f"WITH {_PAIRS} SELECT g, false AS picked, round(avg(v[1]), 6) AS first, round(avg(v[64]), 6) AS last FROM g WHERE n <= 3 GROUP BY g")
def robust_small(spark, sf):
    """Groups of three vectors at most, which are too small for a nearest one: their trimmed means."""
    e = table(spark, sf, "embeddings").withColumn("g", F.floor(F.col("vec_id") / 3))
    return mesh.robust(e, "g", "vec_id", "embedding").select("g", F.col("id").isNotNull().alias("picked"), F.round(F.col("vector")[0], 6).alias("first"), F.round(F.col("vector")[63], 6).alias("last"))


@query(f"""WITH {_KRUM}, a AS (SELECT label, vec_id, list_transform(v, lambda x: abs(x)) AS v FROM e), d3 AS (SELECT x.label, x.vec_id, list_distance(x.v, y.v) ** 2 AS d, row_number() OVER (PARTITION BY x.vec_id ORDER BY list_distance(x.v, y.v)) AS r FROM a x JOIN a y ON x.label = y.label),
 k3 AS (SELECT label, arg_min(vec_id, score) AS id FROM (SELECT d3.label, vec_id, sum(d) AS score FROM d3 JOIN n ON n.label = d3.label WHERE r BETWEEN 2 AND n - 2 GROUP BY 1, 2) GROUP BY label),
 w AS (SELECT label, v FROM a UNION ALL SELECT a.label, v FROM a JOIN k3 ON k3.id = a.vec_id AND k3.label = a.label),
 u AS (SELECT label, unnest(range(1, 65)) AS i, unnest(v) AS v FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY label, i ORDER BY v) AS r, count(*) OVER (PARTITION BY label, i) AS n FROM u),
 m AS (SELECT label, i, avg(v) AS v FROM r WHERE r > floor(n * 0.2) AND r <= n - floor(n * 0.2) GROUP BY 1, 2)
 SELECT label, round(max(CASE i WHEN 1 THEN v END) / sum(v), 6) AS w1, round(max(CASE i WHEN 64 THEN v END) / sum(v), 6) AS w64, round(sum(i * v) / sum(v), 5) AS center FROM m GROUP BY label""")
def federated(spark, sf):
    """All 64 coordinates."""
    v = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    out = mesh.federated(table(spark, sf, "embeddings").select("label", "vec_id", v.alias("v")), "label", "vec_id", "v")
    center = F.aggregate(F.transform("weights", lambda w, i: w * (i + 1)), F.lit(0.0), lambda a, w: a + w)
    return out.select("label", F.round(F.col("weights")[0], 6).alias("w1"), F.round(F.col("weights")[63], 6).alias("w64"), F.round(center, 5).alias("center"))


@query(f"{WITH} SELECT proto, list_sort(list(len))[count(*) // 2 + 1] AS threshold FROM flows GROUP BY proto")
def upper_median(spark, sf):
    return mesh.upper_medians(flows(spark, sf), "proto", "len").withColumnRenamed("median", "threshold")


@query(f"""{WITH}, g AS (SELECT seq, uid, us / 1e3 AS ms, us / 1e3 - lag(us / 1e3) OVER (PARTITION BY uid ORDER BY us, seq) AS gap FROM flows), s AS (SELECT seq, gap, count(gap) OVER w AS n, avg(gap) OVER w AS m, stddev_pop(gap) OVER w AS s FROM g WINDOW w AS (PARTITION BY uid ORDER BY ms, seq ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)),
 y AS (SELECT seq, gap, (gap - CASE WHEN n = 0 THEN 750 ELSE m END) / CASE WHEN n = 0 THEN 375 ELSE greatest(coalesce(s, 0), 50) END AS y FROM s),
 p AS (SELECT seq, gap, CASE WHEN y > 20 THEN 1e-10 ELSE 1 / (1 + exp(y * (1.5976 + 0.070566 * y * y))) END AS p FROM y)
 SELECT seq, round(CASE WHEN gap IS NULL THEN 0 ELSE -log10(greatest(1e-10, least(1, p))) END, 5) + 0.0 AS phi FROM p""")
def phi_accrual(spark, sf):
    beats = flows(spark, sf).select("seq", "uid", (F.col("us") / 1e3).alias("ms"))
    return mesh.phi(beats, "uid", "ms", tie="seq").select("seq", (F.round("phi", 5) + 0.0).alias("phi"))


@query(f"""{WITH}, g AS (SELECT uid, us / 1e3 AS ms, us / 1e3 - lag(us / 1e3) OVER (PARTITION BY uid ORDER BY us) AS gap, row_number() OVER (PARTITION BY uid ORDER BY us DESC) AS r FROM flows),
 s AS (SELECT uid, max(ms) AS last, coalesce(avg(gap), 750) AS m, CASE WHEN count(gap) = 0 THEN 375 ELSE greatest(stddev_pop(gap), 50) END AS s FROM g WHERE r <= 200 GROUP BY uid),
 y AS (SELECT uid, ((SELECT max(us) / 1e3 FROM flows) - last - m) / s AS y FROM s), p AS (SELECT uid, CASE WHEN y > 20 THEN 1e-10 ELSE 1 / (1 + exp(y * (1.5976 + 0.070566 * y * y))) END AS p FROM y),
 l AS (SELECT uid, -log10(greatest(1e-10, least(1, p))) AS phi FROM p)
 SELECT uid, round(phi, 5) + 0.0 AS phi, CASE WHEN phi >= 2 THEN 'DEAD' WHEN phi >= 0.5 THEN 'SUSPECT' ELSE 'ALIVE' END AS state FROM l""")
def silent_members(spark, sf):
    """Who is overdue when the last beat of all comes in."""
    beats = flows(spark, sf).select("uid", (F.col("us") / 1e3).alias("ms"))
    now = beats.agg(F.max("ms")).first()[0] or 0.0
    return mesh.silent(beats, "uid", "ms", F.lit(now), suspect=0.5, dead=2.0).select("uid", (F.round("phi", 5) + 0.0).alias("phi"), "state")


# --- energy ----------------------------------------------------------------
_SAMPLES = "e AS (SELECT uid, us, sum(len) OVER w * 8000 AS bits, count(*) OVER w * 1.0 AS packets, sum(label) OVER w * 1.0 AS attacks, sum(port) OVER w * 100.0 AS cpu FROM flows WINDOW w AS (PARTITION BY uid ORDER BY us))"


def _samples(spark, sf):
    w = Window.partitionBy("uid").orderBy("us")
    return flows(spark, sf).select("uid", "us", (F.sum("len").over(w) * 8000).alias("bits"), (F.count("*").over(w) * 1.0).cast("double").alias("packets"), (F.sum("label").over(w) * 1.0).cast("double").alias("attacks"), (F.sum("port").over(w) * 100.0).cast("double").alias("cpu_joules"))


_DELTAS = f"""{_SAMPLES}, d AS (SELECT uid, coalesce(us - lag(us) OVER w, 0) / 1e6 AS dt, greatest(coalesce(bits - lag(bits) OVER w, 0), 0) AS b, greatest(coalesce(packets - lag(packets) OVER w, 0), 0) AS p, greatest(coalesce(attacks - lag(attacks) OVER w, 0), 0) AS a, greatest(coalesce(cpu - lag(cpu) OVER w, 0), 0) AS j FROM e WINDOW w AS (PARTITION BY uid ORDER BY us)),
 t AS (SELECT *, b * 0.5 / 1e9 + 0.8 * dt AS nic, CASE WHEN dt > 0 THEN j / dt END AS watts FROM d)"""


@query(f"""{WITH}, {_DELTAS} SELECT uid, round(sum(j + nic), 4) AS joules, round(sum(j + nic) * 1e6 / nullif(sum(p), 0), 2) AS uj_per_packet, round(sum(b) / sum(j + nic), 6) AS bits_per_joule, round(sum(j + nic) / 3.6e6 * 713, 6) AS co2_g, round(max(watts), 6) AS peak_watts, round(avg(watts) FILTER (a > 0), 6) AS attack_watts FROM t GROUP BY uid""")
def energy_efficiency(spark, sf):
    out = mesh.energy(_samples(spark, sf), "uid")
    return out.select("uid", F.round("joules", 4).alias("joules"), F.round("uj_per_packet", 2).alias("uj_per_packet"), *(F.round(c, 6).alias(c) for c in ("bits_per_joule", "co2_g", "peak_watts", "attack_watts")))


@query(f"{WITH}, {_DELTAS} SELECT round(sum(j + nic), 2) AS joules, sum(p) AS packets FROM t")
def cluster_energy(spark, sf):
    s = _samples(spark, sf)
    total = mesh.energy(s, "uid").agg(F.round(F.sum("joules"), 2).alias("joules"))
    packets = s.groupBy("uid").agg((F.max("packets") - F.min("packets")).alias("p")).agg(F.sum("p").alias("packets"))
    return total.join(packets)


@query(f"{WITH} SELECT seq, len > 120 AND (uid % 10) / 10.0 < 0.6 AS skipped FROM flows")
def energy_gate(spark, sf):
    return flows(spark, sf).select("seq", mesh.energy_gate(F.col("len"), (F.col("uid") % 10) / 10.0, 120.0).alias("skipped"))


@query("""WITH c AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k, (s_suppkey * 7919) % 1000 AS v FROM supplier), d AS (SELECT *, v - lag(v) OVER (PARTITION BY s_nationkey ORDER BY k) AS d FROM c)
 SELECT s_suppkey, coalesce(CASE WHEN d < 0 THEN d + 1000 ELSE d END, 0)::DOUBLE AS wrapped, coalesce(greatest(d, 0), 0)::DOUBLE AS floored FROM d""")
def energy_delta(spark, sf):
    from ..operators import windows

    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", ((F.col("s_suppkey") * 7919) % 1000).cast("double").alias("v"))
    return s.select("s_suppkey", windows.counter_delta("v", "s_nationkey", "s_suppkey", 1000.0).alias("wrapped"), windows.counter_delta("v", "s_nationkey", "s_suppkey").alias("floored"))




# --- nodes -----------------------------------------------------------------
@query(f"""{WITH}, {_MEMBERS}, p AS ({SQL["phi_accrual"]}), l AS (SELECT uid AS node, arg_max(phi, flows.seq) AS phi FROM flows JOIN p ON p.seq = flows.seq GROUP BY uid)
 SELECT g.node, CASE WHEN phi >= 12 THEN 'DEAD' WHEN phi >= 0.5 AND state = 'ALIVE' THEN 'SUSPECT' WHEN phi < 0.5 AND state = 'SUSPECT' THEN 'ALIVE' ELSE state END AS state FROM g LEFT JOIN l ON l.node = g.node""")
def member_states(spark, sf):
    """Suspicion of silent members; suspect from 0.5 on here, as few users are late by eight orders of magnitude."""
    beats = flows(spark, sf).select("seq", F.col("uid").alias("node"), (F.col("us") / 1e3).alias("ms"))
    levels = mesh.phi(beats, "node", "ms", tie="seq").groupBy("node").agg(F.round(F.max_by("phi", "seq"), 5).alias("phi"))
    return mesh.watched(_members(spark, sf), levels, suspect=0.5).select("node", "state")


@query(f"{DECIDED} SELECT seq, src, action, least(1.0, score) AS confidence, 'n0' AS origin, row_number() OVER (ORDER BY seq) + 5 AS lamport, 900 AS ttl FROM decided WHERE {_ENFORCED}")
def local_intel(spark, sf):
    return mesh.local_intel(decided(spark, sf), "n0", 5).select("seq", "src", "action", "confidence", "origin", "lamport", "ttl")


@query(f"""{DECIDED}, i AS (SELECT row_number() OVER (ORDER BY seq) AS lamport FROM decided WHERE {_ENFORCED}), b AS (SELECT (lamport - 1) // 64 AS batch, count(*) AS records FROM i GROUP BY 1),
 {_MEMBERS} SELECT node AS peer, batch, records FROM g, b WHERE state IN ('ALIVE', 'SUSPECT') AND node <> 3""")
def intel_flush(spark, sf):
    intel = mesh.local_intel(decided(spark, sf), "n3")
    return mesh.flushed(intel, _members(spark, sf), 3)


@query(f"""{WITH}, {_MEMBERS}, a AS (SELECT 'member' AS kind, CAST(node AS VARCHAR) AS item FROM g ORDER BY heartbeat DESC, node LIMIT 24), b AS (SELECT 'record' AS kind, CAST(seq AS VARCHAR) AS item FROM flows ORDER BY us DESC, seq DESC LIMIT 40)
 SELECT * FROM a UNION ALL SELECT * FROM b""")
def gossip_digest(spark, sf):
    members, records = mesh.gossip_digest(_members(spark, sf), flows(spark, sf))
    return members.select(F.lit("member").alias("kind"), F.col("node").cast("string").alias("item")).union(records.select(F.lit("record"), F.col("seq").cast("string")))


@query(f"{WITH} SELECT proto, sum(port) AS seen, sum(port // 7) AS lost, CASE WHEN sum(port) > 0 THEN round(100.0 * sum(port // 7) / sum(port), 4) ELSE 0.0 END AS loss_pct FROM flows GROUP BY proto")
def packet_loss(spark, sf):
    return mesh.packet_loss(flows(spark, sf).select("proto", F.col("port").alias("seen"), F.floor(F.col("port") / 7).alias("lost")), "proto")


@query("SELECT p_partkey, round(100.0 * p_size / 60, 1) AS mem_used_pct, round(p_partkey * 100000 / 1048576, 1) AS rss_mb FROM part")
def host_memory(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.lit(60).cast("long").alias("total"), (60 - F.col("p_size")).cast("long").alias("available"), (F.col("p_partkey") * 100000).alias("rss"))
    return mesh.host_memory(p).select("p_partkey", "mem_used_pct", "rss_mb")
