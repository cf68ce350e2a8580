"""Queries over sliding features, detectors and metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import flow as fx
from ..operators import folds, metrics, sliding, windows
from ..operators.ordered import percentiles
from .tables import DAY, FLOWS, flows, query, table

WITH = f"WITH {FLOWS}"
WIN = f"(PARTITION BY src ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)"
FIXED = "0.3"

RATES = """round(CASE WHEN tp+fp=0 THEN 0 ELSE tp::DOUBLE/(tp+fp) END,6) AS precision, round(CASE WHEN tp+fn=0 THEN 0 ELSE tp::DOUBLE/(tp+fn) END,6) AS recall,
 round(CASE WHEN tp=0 THEN 0 ELSE 2.0*tp/(2*tp+fp+fn) END,6) AS f1,
 round((tp::DOUBLE*tn-fp::DOUBLE*fn)/CASE WHEN (tp+fp)=0 OR (tp+fn)=0 OR (tn+fp)=0 OR (tn+fn)=0 THEN 1 ELSE sqrt((tp+fp)::DOUBLE*(tp+fn)*(tn+fp)*(tn+fn)) END,6) AS mcc"""
MORE_RATES = """round((tp+tn)::DOUBLE/(tp+fp+tn+fn),6) AS accuracy, round((tp::DOUBLE/(tp+fn)+tn::DOUBLE/(tn+fp))/2,6) AS balanced_accuracy,
 round(fp::DOUBLE/(fp+tn),6) AS fpr, round(tn::DOUBLE/(fp+tn),6) AS tnr, round(fn::DOUBLE/(fn+tp),6) AS fnr"""
AUC = """(SELECT sum(CASE WHEN b.score < a.score THEN 1.0 WHEN b.score = a.score THEN 0.5 ELSE 0 END) FROM x b WHERE b.label = 0)"""


@query(f"""{WITH}, x AS (SELECT score, label, family, score > 0.2 AS hit FROM flows), f AS (SELECT family, label, score, hit FROM x),
 b AS (SELECT count(*) FILTER (hit) AS fp, count(*) FILTER (NOT hit) AS tn, avg(score) AS ms FROM x WHERE label = 0),
 g AS (SELECT score, sum(1 - label) AS neg FROM x GROUP BY 1), h AS (SELECT score, sum(neg) OVER (ORDER BY score) - neg / 2.0 AS below FROM g),
 a AS (SELECT family, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fn, avg(x.score) AS ms, sum(below) AS wins FROM x JOIN h ON x.score = h.score WHERE label = 1 GROUP BY 1),
 j AS (SELECT a.family, a.tp, b.fp, b.tn, a.fn, a.ms, a.wins FROM a, b)
 SELECT family, tp, fp, tn, fn, round((tp+tn)::DOUBLE/(tp+fp+tn+fn),6) AS accuracy, {RATES}, round(wins/((tp+fn)::DOUBLE*(fp+tn)),6) AS auc, round(ms,6) AS mean_score FROM j
 UNION ALL BY NAME SELECT '(benign)' AS family, 0 AS tp, fp, tn, 0 AS fn, round(tn::DOUBLE/(tn+fp),6) AS accuracy, NULL::DOUBLE AS precision, NULL::DOUBLE AS recall, NULL::DOUBLE AS f1, NULL::DOUBLE AS mcc, NULL::DOUBLE AS auc, round(ms,6) AS mean_score FROM b""")
def flagship_family_metrics(spark, sf):
    return metrics.family_metrics(flows(spark, sf), F.col("score") > 0.2)


@query(f"{WITH} SELECT proto, count(*) FILTER (score > 0.2 AND label = 1) AS tp, count(*) FILTER (score > 0.2 AND label = 0) AS fp, count(*) FILTER (score <= 0.2 AND label = 0) AS tn, count(*) FILTER (score <= 0.2 AND label = 1) AS fn FROM flows GROUP BY proto")
def confusion(spark, sf):
    return metrics.confusion(flows(spark, sf), "proto", flagged=F.col("score") > 0.2, label=F.col("label"))


@query(f"""{WITH}, c AS (SELECT proto, count(*) FILTER (score > 0.2 AND label = 1) AS tp, count(*) FILTER (score > 0.2 AND label = 0) AS fp, count(*) FILTER (score <= 0.2 AND label = 0) AS tn, count(*) FILTER (score <= 0.2 AND label = 1) AS fn FROM flows GROUP BY proto)
 SELECT *, {RATES}, {MORE_RATES} FROM c""")
def prf_mcc(spark, sf):
    return metrics.rates(confusion(spark, sf))


DOCS = "x AS (SELECT l.doc_id AS seq, d.n_chars / 40000.0 AS score, l.quality AS label FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def scored_documents(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("doc_id").alias("seq"), (F.col("n_chars") / 40000.0).alias("score"), F.col("quality").cast("int").alias("label"))


@query(f"WITH {DOCS}, g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM x GROUP BY 1), h AS (SELECT pos, neg, sum(neg) OVER (ORDER BY score) - neg / 2.0 AS below FROM g) SELECT round(sum(pos * below) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM h")
def roc_auc(spark, sf):
    return metrics.roc_auc(scored_documents(spark, sf))


SWEEP = "s AS (SELECT *, sum(label) OVER (ORDER BY score DESC, seq DESC ROWS UNBOUNDED PRECEDING) AS tp, row_number() OVER (ORDER BY score DESC, seq DESC) AS seen, sum(label) OVER () AS p, sum(1 - label) OVER () AS q FROM x)"


@query(f"WITH {DOCS}, {SWEEP} SELECT round(avg(tp::DOUBLE / seen), 6) AS pr_auc FROM s WHERE label = 1")
def pr_auc(spark, sf):
    return metrics.average_precision(scored_documents(spark, sf))


@query(f"WITH {DOCS}, {SWEEP} SELECT round(max(2.0 * tp / (seen + p)), 6) AS best_f1 FROM s")
def best_f1(spark, sf):
    return metrics.best_f1(scored_documents(spark, sf))


@query(f"WITH {DOCS}, {SWEEP} SELECT round(arg_min((seen - tp)::DOUBLE / q, seen), 6) AS fpr FROM s WHERE tp >= 0.8 * p")
def fpr_at_recall(spark, sf):
    return metrics.fpr_at_recall(scored_documents(spark, sf))


@query(f"WITH {DOCS}, g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM x GROUP BY 1), h AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS q FROM g WINDOW w AS (ORDER BY score DESC)) SELECT score AS threshold, round(tp / p, 6) AS tpr, round(fp / q, 6) AS fpr, round(tp / (tp + fp), 6) AS precision FROM h")
def roc_points(spark, sf):
    return metrics.roc_points(scored_documents(spark, sf))


@query(f"{WITH} SELECT label, least(39, CAST(floor(score * 40) AS INT)) AS bin, count(*) AS n FROM flows GROUP BY 1, 2")
def score_hist(spark, sf):
    return flows(spark, sf).groupBy("label", F.least(F.lit(39), F.floor(F.col("score") * 40).cast("int")).alias("bin")).agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT proto, round(quantile_cont(len, 0.5), 6) AS p50, round(quantile_cont(len, 0.99), 6) AS p99 FROM flows GROUP BY proto")
def latency_pct(spark, sf):
    p = percentiles(flows(spark, sf), ["proto"], "len", [0.5, 0.99])
    return p.select("proto", F.round(F.col("percentiles")[0], 6).alias("p50"), F.round(F.col("percentiles")[1], 6).alias("p99"))


@query(f"{WITH} SELECT family, count(*) AS total, count(*) FILTER (score > 0.2) AS flagged, count(*) FILTER (port % 10 = 0) AS unknown FROM flows GROUP BY family")
def family_rates(spark, sf):
    return flows(spark, sf).groupBy("family").agg(F.count("*").alias("total"), F.count_if(F.col("score") > 0.2).alias("flagged"), F.count_if(F.col("port") % 10 == 0).alias("unknown"))


@query(f"{WITH} SELECT family, round(avg((score - label) * (score - label)), 6) AS loss, round(sum(CASE WHEN score > 0.2 THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) AS hit_ratio FROM flows GROUP BY family")
def expert_loss(spark, sf):
    loss = (F.col("score") - F.col("label")) * (F.col("score") - F.col("label"))
    return flows(spark, sf).groupBy("family").agg(F.round(F.avg(loss), 6).alias("loss"), F.round(F.count_if(F.col("score") > 0.2) / F.count("*"), 6).alias("hit_ratio"))


@query(f"{WITH} SELECT us // 1000000 // 86400 AS day, count(*) AS packets, round(count(*) / 86400.0, 8) AS pps, round(sum(len) * 8 / 86400, 6) AS bps FROM flows GROUP BY 1")
def rate_per_window(spark, sf):
    day = F.floor(F.col("us") / DAY).cast("long")
    return flows(spark, sf).groupBy(day.alias("day")).agg(F.count("*").alias("packets"), F.round(F.count("*") / 86400.0, 8).alias("pps"), F.round(F.sum("len") * 8 / 86400, 6).alias("bps"))


@query(f"{WITH} SELECT seq, round(coalesce((us - lag(us) OVER (PARTITION BY src ORDER BY us, seq)) / 1e6, 0), 6) AS iat FROM flows")
def feat_iat(spark, sf):
    return flows(spark, sf).select("seq", F.round(windows.inter_arrival(), 6).alias("iat"))


def _last_day(spark, sf):
    return sliding.statistics(flows(spark, sf).select("seq", "us", "src", "dst", "port", "len"), DAY)


@query(f"{WITH} SELECT seq, count(*) OVER w AS n, round(least(1.0, count(*) OVER w / 2.0 / 300), 6) AS pps FROM flows WINDOW w AS {WIN}")
def feat_pps(spark, sf):
    n = F.col("n")
    return _last_day(spark, sf).select("seq", "n", F.round(F.least(F.lit(1.0), n / 2.0 / 300), 6).alias("pps"))


@query(f"{WITH} SELECT seq, count(DISTINCT dst) OVER {WIN} AS fanout FROM flows")
def feat_fanout(spark, sf):
    return _last_day(spark, sf).select("seq", "fanout")


ENTROPY = f"""j AS (SELECT a.seq, b.port, count(*) AS c FROM flows a JOIN flows b ON a.src = b.src AND b.us BETWEEN a.us - {DAY} AND a.us GROUP BY 1, 2),
 t AS (SELECT seq, c::DOUBLE / sum(c) OVER (PARTITION BY seq) AS p, count(*) OVER (PARTITION BY seq) AS k FROM j),
 ent AS (SELECT seq, CASE WHEN max(k) > 1 THEN -sum(p * ln(p)) / ln(max(k)) ELSE 0 END AS entropy FROM t GROUP BY seq)"""


@query(f"{WITH}, {ENTROPY} SELECT seq, round(entropy, 6) AS entropy FROM ent")
def feat_entropy(spark, sf):
    return _last_day(spark, sf).select("seq", F.round("entropy", 6).alias("entropy"))


@query(f"{WITH} SELECT seq, round(sum(len) OVER w / (count(*) OVER w * 1500.0 + 1e-6), 6) AS bytes FROM flows WINDOW w AS {WIN}")
def feat_bytes(spark, sf):
    return _last_day(spark, sf).select("seq", F.round(F.col("bytes") / (F.col("n") * 1500.0 + 1e-6), 6).alias("bytes"))


@query(f"""{WITH}, {ENTROPY}, a AS (SELECT seq, round(len / 1500.0, 6) AS f_len, round(least(1.0, coalesce((us - lag(us) OVER (PARTITION BY src ORDER BY us, seq)) / 1e6, 0) / 86400), 6) AS f_iat,
  CASE WHEN (flags & 2) <> 0 AND (flags & 16) = 0 THEN 1.0 ELSE 0.0 END AS f_syn, round(least(1.0, count(DISTINCT dst) OVER {WIN} / 40.0), 6) AS f_fanout,
  round(least(1.0, sum(len) OVER {WIN} / (count(*) OVER {WIN} * 1500.0 + 1e-6)), 6) AS f_bytes, round(least(1.0, count(*) OVER {WIN} / 86400.0 / 0.001), 6) AS f_pps FROM flows)
 SELECT a.*, round(least(1.0, entropy), 6) AS f_entropy FROM a JOIN ent ON a.seq = ent.seq""")
def feat_all(spark, sf):
    out = windows.features(flows(spark, sf), DAY, 1 / 86400, 0.001)
    return out.select("seq", *(F.round(c, 6).alias(c) for c in out.columns if c.startswith("f_")))


@query(f"""{WITH}, x AS (SELECT seq, sign(len) * ln(1 + abs(len)) AS v, src, us FROM flows)
 SELECT seq, round(CASE WHEN count(*) OVER w < 30 THEN 0.5 ELSE 1 / (1 + exp(-greatest(-8, least(8, (v - avg(v) OVER w) / sqrt(greatest(var_pop(v) OVER w, 1e-9)))))) END, 4) AS scaled FROM x WINDOW w AS (PARTITION BY src ORDER BY us, seq ROWS UNBOUNDED PRECEDING)""")
def native_scale(spark, sf):
    df = flows(spark, sf)
    return df.select("seq", F.round(windows.native_scaled(df, "len", "src"), 4).alias("scaled"))


@query(f"""{WITH}, c AS (SELECT score, count(*) AS k FROM flows WHERE label = 0 GROUP BY 1), n AS (SELECT sum(k) AS n FROM c)
 SELECT f.seq, round((1 + coalesce((SELECT sum(k) FROM c WHERE c.score >= f.score), 0)) / ((SELECT n FROM n) + 1.0), 6) AS p FROM flows f""")
def conformal_p(spark, sf):
    """Calibrated on all benign events."""
    out = windows.conformal(flows(spark, sf), F.col("label") == 0)
    return out.select("seq", F.round("p", 6).alias("p"))


ECOD = """x AS (SELECT seq, score AS a, port / 100.0 AS b, (uid % 97) / 97.0 AS c FROM flows), n AS (SELECT count(*)::DOUBLE AS n FROM x),
 r AS (SELECT seq, count(*) OVER (ORDER BY a) / (n + 1) AS fa, count(*) OVER (ORDER BY b) / (n + 1) AS fb, count(*) OVER (ORDER BY c) / (n + 1) AS fc FROM x, n),
 s AS (SELECT seq, -ln(greatest(CASE WHEN fa > 0.5 THEN 1 - fa ELSE fa END, 1e-9)) AS sa, -ln(greatest(CASE WHEN fb > 0.5 THEN 1 - fb ELSE fb END, 1e-9)) AS sb, -ln(greatest(CASE WHEN fc > 0.5 THEN 1 - fc ELSE fc END, 1e-9)) AS sc FROM r)"""


def _ecod(spark, sf):
    x = flows(spark, sf).select("seq", F.col("score").alias("a"), (F.col("port") / 100.0).alias("b"), ((F.col("uid") % 97) / 97.0).alias("c"))
    return windows.ecod(x, ["a", "b", "c"])


@query(f"{WITH}, {ECOD} SELECT seq, round(1 - exp(-(sa + sb + sc) / 7.5), 6) AS ecod FROM s")
def ecod_score(spark, sf):
    return _ecod(spark, sf).select("seq", F.round("ecod", 6).alias("ecod"))


@query(f"""{WITH}, {ECOD}, u AS (SELECT seq, unnest([{{'f':'a','v':sa}},{{'f':'b','v':sb}},{{'f':'c','v':sc}}]) AS t FROM s), k AS (SELECT seq, t.f AS f, t.v AS v, row_number() OVER (PARTITION BY seq ORDER BY round(t.v, 9) DESC, t.f) AS k FROM u)
 SELECT seq, max(CASE k WHEN 1 THEN f END) AS first, max(CASE k WHEN 2 THEN f END) AS second, round(max(CASE k WHEN 1 THEN v END), 3) AS value FROM k GROUP BY seq""")
def ecod_top(spark, sf):
    items = F.array(*(F.struct((-F.round(f"surprise_{c}", 9)).alias("v"), F.lit(c).alias("f")) for c in "abc"))
    return _ecod(spark, sf).withColumn("t", F.array_sort(items)).select("seq", F.col("t")[0]["f"].alias("first"), F.col("t")[1]["f"].alias("second"), F.round(-F.col("t")[0]["v"], 3).alias("value"))


#: 15 trees of depth 8.
_draw = np.random.default_rng(3)
SPLITS = _draw.integers(0, 3, (15, 8)).tolist()
LEVELS = _draw.random((15, 8)).round(6).tolist()


def _leaf(splits: list[int], levels: list[float]) -> str:
    return " + ".join(f"(CASE WHEN {'abc'[c]} > {v} THEN {1 << k} ELSE 0 END)" for k, (c, v) in enumerate(zip(splits, levels, strict=True)))


_LEAVES = " UNION ALL ".join(f"SELECT seq, seq // 250 AS block, {i} AS tree, {_leaf(s, t)} AS leaf FROM x" for i, (s, t) in enumerate(zip(SPLITS, LEVELS, strict=True)))


@query(f"""{WITH}, x AS (SELECT seq, score * 2 AS a, port / 100.0 AS b, (uid % 97) / 97.0 AS c FROM flows), l AS ({_LEAVES}),
 m AS (SELECT tree, leaf, block + 1 AS block, count(*) AS mass FROM l GROUP BY ALL)
 SELECT l.seq, round(avg(1.0 / (1 + coalesce(mass, 0))), 6) AS hst FROM l LEFT JOIN m ON l.tree = m.tree AND l.leaf = m.leaf AND l.block = m.block GROUP BY l.seq""")
def hst_mass(spark, sf):
    x = flows(spark, sf).select("seq", (F.col("score") * 2).alias("a"), (F.col("port") / 100.0).alias("b"), ((F.col("uid") % 97) / 97.0).alias("c"))
    return windows.half_space_mass(x, ["a", "b", "c"], SPLITS, LEVELS).select("seq", F.round("hst", 6).alias("hst"))


@query(f"""{WITH}, x AS (SELECT seq, score AS a, port / 100.0 AS b, seq // 500 AS k FROM flows), s AS (SELECT k, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM x GROUP BY k),
 g AS (SELECT x.k, quantile_cont(sqrt((((a-ma)/(sa+1e-6))**2 + ((b-mb)/(sb+1e-6))**2) / 2), 0.97) AS gate FROM x JOIN s ON x.k = s.k GROUP BY x.k),
 d AS (SELECT x.seq, sqrt((((a-ma)/(sa+1e-6))**2 + ((b-mb)/(sb+1e-6))**2) / 2) AS d, gate FROM x LEFT JOIN s ON s.k = x.k - 1 LEFT JOIN g ON g.k = x.k - 1)
 SELECT seq, coalesce(d > gate * 1.15, false) AS unknown, round(CASE WHEN gate IS NOT NULL AND d > gate THEN greatest(0, least(1, d / (gate + 1e-6) - 1)) ELSE 0 END, 4) AS novelty FROM d""")
def openset_block(spark, sf):
    x = flows(spark, sf).select("seq", F.col("score").alias("a"), (F.col("port") / 100.0).alias("b"))
    return windows.open_set(x, ["a", "b"]).select("seq", "unknown", F.round("novelty", 4).alias("novelty"))


@query(f"{WITH} SELECT seq, round(avg(CASE WHEN score > 0.2 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY proto ORDER BY seq ROWS 1499 PRECEDING), 6) AS rate FROM flows")
def exceedance_rate(spark, sf):
    x = flows(spark, sf).select("seq", "proto", "score")
    return windows.recent_rate(x, "proto", "seq", F.col("score") > 0.2, 1500).select("seq", F.round("rate", 6).alias("rate"))


@query(f"{WITH} SELECT seq, round(0.5 * score + 0.3 * port / 100.0 + 0.2 * (uid % 7) / 7.0, 6) AS fused FROM flows")
def fusion_weighted(spark, sf):
    return flows(spark, sf).select("seq", F.round(0.5 * F.col("score") + 0.3 * F.col("port") / 100.0 + 0.2 * (F.col("uid") % 7) / 7.0, 6).alias("fused"))


@query(f"""{WITH}, r AS (SELECT seq, proto, score, label, coalesce(count(*) FILTER (label = 0) OVER (PARTITION BY proto ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM flows),
 c AS (SELECT proto, score, nb AS i FROM r WHERE label = 0), k AS (SELECT r.seq, count(*) AS k FROM r JOIN c ON c.proto = r.proto AND c.i < r.nb AND c.i >= r.nb - 2000 AND c.score >= r.score GROUP BY r.seq)
 SELECT r.seq, round(CASE WHEN nb < 50 THEN 1 / (1 + exp(3 * (score - 0.5))) ELSE (1 + coalesce(k, 0)) / (least(nb, 2000) + 1.0) END, 6) AS p FROM r LEFT JOIN k ON k.seq = r.seq""")
def conformal_recent(spark, sf):
    """Against the last 2,000 benign scores of the context, with a warm-up."""
    x = flows(spark, sf).withColumn("benign", F.col("label") == 0)
    return folds.recent_conformal(x, ["proto"], "score", "benign").select("seq", F.round("p", 6).alias("p"))


@query(f"""{WITH}, x AS (SELECT seq, proto, score AS a, port / 100.0 AS b, row_number() OVER (PARTITION BY proto ORDER BY us, seq) AS i FROM flows),
 k AS (SELECT x.seq, count(*) AS n, count(*) FILTER (y.a <= x.a) / (count(*) + 1.0) AS fa, count(*) FILTER (y.b <= x.b) / (count(*) + 1.0) AS fb FROM x JOIN x y ON y.proto = x.proto AND y.i < x.i AND y.i >= x.i - 1000 GROUP BY x.seq),
 s AS (SELECT seq, n, -ln(greatest(CASE WHEN fa > 0.5 THEN 1 - fa ELSE fa END, 1e-9)) - ln(greatest(CASE WHEN fb > 0.5 THEN 1 - fb ELSE fb END, 1e-9)) AS s FROM k)
 SELECT x.seq, round(CASE WHEN coalesce(n, 0) < 20 THEN 0.0 ELSE 1 - exp(-s / 5.0) END, 6) AS ecod FROM x LEFT JOIN s ON s.seq = x.seq""")
def ecod_recent(spark, sf):
    """Under the context's last 1,000 records."""
    x = flows(spark, sf).select("proto", "us", "seq", F.col("score").alias("a"), (F.col("port") / 100.0).alias("b"))
    return folds.recent_ecod(x, ["proto"], ["a", "b"]).select("seq", F.round("ecod", 6).alias("ecod"))


@query(f"""{WITH}, x AS (SELECT seq, src, score AS a, port / 100.0 AS b, row_number() OVER (PARTITION BY src ORDER BY us, seq) AS i FROM flows),
 k AS (SELECT x.seq, any_value(x.a) AS a, any_value(x.b) AS b, count(*) AS n, avg(y.a) AS ma, stddev_pop(y.a) AS sa, avg(y.b) AS mb, stddev_pop(y.b) AS sb FROM x JOIN x y ON y.src = x.src AND y.i < x.i AND y.i >= x.i - 500 GROUP BY x.seq),
 d AS (SELECT k.seq, quantile_cont(sqrt((((y.a-ma)/(sa+1e-6))**2 + ((y.b-mb)/(sb+1e-6))**2) / 2), 0.97) AS gate, any_value(sqrt((((k.a-ma)/(sa+1e-6))**2 + ((k.b-mb)/(sb+1e-6))**2) / 2)) AS d
  FROM k JOIN x ON x.seq = k.seq JOIN x y ON y.src = x.src AND y.i < x.i AND y.i >= x.i - 500 WHERE n >= 30 GROUP BY k.seq)
 SELECT x.seq, coalesce(d > gate * 1.15, false) AS unknown, round(CASE WHEN d > gate THEN greatest(0, least(1, d / (gate + 1e-6) - 1)) ELSE 0 END, 4) AS novelty FROM x LEFT JOIN d ON d.seq = x.seq""")
def openset_recent(spark, sf):
    """Against the source's last 500 records."""
    x = flows(spark, sf).select("src", "us", "seq", F.col("score").alias("a"), (F.col("port") / 100.0).alias("b"))
    return folds.recent_open_set(x, ["src"], ["a", "b"]).select("seq", "unknown", F.round("novelty", 4).alias("novelty"))
