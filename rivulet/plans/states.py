"""Queries over order-dependent states; the SQL side uses recursion, one step a row."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import flow as fx
from ..operators import folds
from ..streaming import control
from .projections import DECIDED, decided
from .tables import FLOWS, flows, query

WITH = f"WITH RECURSIVE {FLOWS}"


def stepped(source: str, key: str, start: dict[str, str], step: dict[str, str], out: str, head: str = WITH) -> str:
    """SQL that folds step over each key's rows of source, in order of time. In step, {name} is the state before and r a row."""
    first = ", ".join(f"{e.format(**start)} AS {n}" for n, e in step.items())
    after = {n: f"s.{n}" for n in step}
    later = ", ".join(f"{e.format(**(start | after))} AS {n}" for n, e in step.items())
    return f"""{head}, r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY us, seq) AS rn FROM {source}),
 s AS (SELECT r.{key}, r.seq, r.rn, {first} FROM r WHERE rn = 1 UNION ALL SELECT r.{key}, r.seq, r.rn, {later} FROM s JOIN r ON r.{key} = s.{key} AND r.rn = s.rn + 1) SELECT {out} FROM s"""


@query(f"""WITH {FLOWS}, r AS (SELECT src, label, row_number() OVER (PARTITION BY src ORDER BY us, seq) AS i, count(*) OVER (PARTITION BY src) AS n FROM flows),
 t AS (SELECT src, max(n) AS seen, power(0.98, max(n)) + sum(power(0.98, n - i) * (1 - label)) AS a, power(0.995, max(n)) + sum(power(0.995, n - i) * label) AS b FROM r GROUP BY src)
 SELECT src, seen, round(a, 6) AS a, round(b, 6) AS b, round(a / (a + b), 6) AS trust, round(least(1.0, b / (a + b) + 0.4 * sqrt(ln(seen + 2) / (a + b))), 6) AS suspicion FROM t""")
def trust_final(spark, sf):
    out = folds.trust_final(flows(spark, sf), "src", F.col("label"))
    return out.select("src", "seen", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("trust", 6).alias("trust"), F.round(fx.suspicion(F.col("a"), F.col("b"), F.col("seen")), 6).alias("suspicion"))


@query(stepped("flows", "src", {"a": "1.0::DOUBLE", "b": "1.0::DOUBLE"}, {"a": "{a} * 0.98 + (1 - r.label)", "b": "{b} * 0.995 + r.label"}, "seq, round(a, 6) AS a, round(b, 6) AS b"))
def trust_running(spark, sf):
    def step(s, row):
        s = folds.trust_step(s, row["label"])
        return s, {"seq": row["seq"], "a": s["a"], "b": s["b"]}

    out = folds.fold(flows(spark, sf).select("src", "us", "seq", "label"), ["src"], ["us", "seq"], folds.trust_start, step, "seq long, a double, b double")
    return out.select("seq", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query(stepped("(SELECT * FROM flows WHERE label = 0)", "proto", {"tau": "0.6::DOUBLE"}, {"tau": "least(0.999, greatest(0.05, {tau} + greatest(2.5 / (r.rn + 40.0), 0.01) * ((CASE WHEN r.score > {tau} THEN 1.0 ELSE 0.0 END) - 0.02)))"}, "seq, round(tau, 6) AS tau, round(greatest(0.05, tau - 0.08), 6) AS low"))
def tau_fold(spark, sf):
    def step(s, row):
        s = folds.threshold_step(s, row["score"])
        return s, {"seq": row["seq"], "tau": s["tau"]}

    benign = flows(spark, sf).filter("label = 0").select("proto", "us", "seq", "score")
    out = folds.fold(benign, ["proto"], ["us", "seq"], folds.threshold_start, step, "seq long, tau double")
    return out.select("seq", F.round("tau", 6).alias("tau"), F.round(F.greatest(F.lit(0.05), F.col("tau") - 0.08), 6).alias("low"))


_RATE = math.sqrt(8 * math.log(3) / 1000)
_U = [f"({{w{i}}} * exp(-{_RATE!r} * ({x} - r.label) ** 2))" for i, x in enumerate(("r.score", "r.port / 100.0", "(r.uid % 7) / 7.0"))]
_SUM = "(" + " + ".join(_U) + ")"


@query(stepped("flows", "src", {f"w{i}": "(1.0 / 3)::DOUBLE" for i in range(3)}, {f"w{i}": f"(0.98 * {_U[i]} / {_SUM} + 0.02 / 3)" for i in range(3)}, "seq, round(w0, 6) AS w0, round(w1, 6) AS w1, round(w2, 6) AS w2"))
def hedge_keyed(spark, sf):
    def step(s, row):
        s = folds.hedge_step(s, [row["score"], row["port"] / 100.0, (row["uid"] % 7) / 7.0], row["label"])
        return s, {"seq": row["seq"]} | {f"w{i}": w for i, w in enumerate(s["w"])}

    out = folds.fold(flows(spark, sf).select("src", "uid", "us", "seq", "score", "port", "label"), ["src"], ["us", "seq"], folds.hedge_start(3), step, "seq long, w0 double, w1 double, w2 double")
    return out.select("seq", *(F.round(f"w{i}", 6).alias(f"w{i}") for i in range(3)))


@query(stepped("flows", "src", {"b": "20.0::DOUBLE"}, {"b": "CASE WHEN {b} >= 1 THEN {b} - 1.0 ELSE least(20.0, {b} + 0.05) END", "allowed": "{b} >= 1"}, "seq, round(b, 6) AS b, allowed"))
def budget_fold(spark, sf):
    def step(s, row):
        s, ok = folds.budget_step(s)
        return s, {"seq": row["seq"], "b": s["b"], "allowed": ok}

    out = folds.fold(flows(spark, sf).select("src", "us", "seq"), ["src"], ["us", "seq"], folds.budget_start, step, "seq long, b double, allowed boolean")
    return out.select("seq", F.round("b", 6).alias("b"), "allowed")


_P = "greatest(1e-6, least(1.0, 1 - score))"


@query(f"""WITH {FLOWS}, a AS (SELECT seq, src, us, sum(ln(0.92) + (0.92 - 1) * ln({_P})) OVER (PARTITION BY src ORDER BY us, seq) AS total FROM flows)
 SELECT seq, round(total - least(0, min(total) OVER (PARTITION BY src ORDER BY us, seq)), 5) + 0.0 AS level FROM a""")
def drift_lindley(spark, sf):
    f = flows(spark, sf)
    w = Window.partitionBy("src").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    out = f.select("seq", "src", "us", folds.drift_level(1 - F.col("score"), "src").alias("total"))
    return out.select("seq", F.round(F.col("total") - F.least(F.lit(0.0), F.min("total").over(w)), 5).alias("level"))


@query(stepped("flows", "src", {"m": "0.0::DOUBLE"}, {"m": "CASE WHEN greatest(0, {m} + ln(0.92) - 0.08 * ln(greatest(1e-6, least(1.0, r.port / 99.0)))) > ln(1.5) THEN 0.0 ELSE greatest(0, {m} + ln(0.92) - 0.08 * ln(greatest(1e-6, least(1.0, r.port / 99.0)))) END", "alarm": "greatest(0, {m} + ln(0.92) - 0.08 * ln(greatest(1e-6, least(1.0, r.port / 99.0)))) > ln(1.5)"}, "seq, round(m, 6) + 0.0 AS m, alarm"))
def drift_fold(spark, sf):
    def step(s, row):
        s, _, alarm = folds.drift_step(s, row["port"] / 99.0, alarm=1.5)
        return s, {"seq": row["seq"], "m": s["m"], "alarm": alarm}

    out = folds.fold(flows(spark, sf).select("src", "us", "seq", "port"), ["src"], ["us", "seq"], folds.drift_start, step, "seq long, m double, alarm boolean")
    return out.select("seq", F.round("m", 6).alias("m"), "alarm")


_TOKENS = "least(5.0, {tokens} + greatest(0, r.us - coalesce({at}, r.us)) / 1e6 * 0.00002)"


@query(stepped("flows", "src", {"tokens": "5.0::DOUBLE", "at": "NULL::BIGINT"}, {"tokens": f"CASE WHEN {_TOKENS} >= 1 THEN {_TOKENS} - 1 ELSE {_TOKENS} END", "at": "r.us", "ok": f"{_TOKENS} >= 1"}, "seq, round(tokens, 6) AS tokens, ok"))
def token_bucket(spark, sf):
    def step(s, row):
        s, ok = folds.bucket_step(s, row["us"] / 1e6, 0.00002, 5.0)
        return s, {"seq": row["seq"], "tokens": s["tokens"], "ok": ok}

    out = folds.fold(flows(spark, sf).select("src", "us", "seq"), ["src"], ["us", "seq"], folds.bucket_start(5.0), step, "seq long, tokens double, ok boolean")
    return out.select("seq", F.round("tokens", 6).alias("tokens"), "ok")


@query(f"""{DECIDED}, q AS (SELECT seq, us, score, 1 AS ctx FROM decided WHERE action = 'QUARANTINE' OR action = 'DROP'), r AS (SELECT *, row_number() OVER (ORDER BY us, seq) AS rn FROM q),
 s AS (SELECT seq, rn, us, 1.0::DOUBLE AS tokens, true AS ok FROM r WHERE rn = 1 UNION ALL
  SELECT r.seq, r.rn, r.us, CASE WHEN least(2.0, s.tokens + (r.us - s.us) / 1e6 / 86400) >= 1 THEN least(2.0, s.tokens + (r.us - s.us) / 1e6 / 86400) - 1 ELSE least(2.0, s.tokens + (r.us - s.us) / 1e6 / 86400) END, least(2.0, s.tokens + (r.us - s.us) / 1e6 / 86400) >= 1 FROM s JOIN r ON r.rn = s.rn + 1)
 SELECT seq, round(tokens, 6) AS tokens, CASE WHEN ok THEN 'CONTAIN' ELSE 'RATE_LIMIT' END AS final FROM s""".replace("WITH flows", "WITH RECURSIVE flows", 1))
def containment_cap(spark, sf):
    """A global cap on containments: one state by nature, over the rare containment decisions only."""

    def step(s, row):
        s, ok = folds.bucket_step(s, row["us"] / 1e6, 1 / 86400, 2.0)
        return s, {"seq": row["seq"], "tokens": s["tokens"], "final": "CONTAIN" if ok else "RATE_LIMIT"}

    rows = decided(spark, sf).filter(F.col("action").isin(*fx.DROPPING)).select("seq", "us", F.lit(1).alias("ctx"))
    out = folds.fold(rows, ["ctx"], ["us", "seq"], folds.bucket_start(2.0), step, "seq long, tokens double, final string")
    return out.select("seq", F.round("tokens", 6).alias("tokens"), "final")


@query(f"{DECIDED}, m AS (SELECT max(us) AS now FROM decided) SELECT seq FROM decided, m WHERE action IN ('DROP','QUARANTINE','RATE_LIMIT') AND us + 600000000000 <= now")
def ttl_expired(spark, sf):
    d = decided(spark, sf)
    now = F.broadcast(d.agg(F.max("us").alias("now")))
    return d.join(now).filter(F.col("action").isin(*fx.DROPPING, "RATE_LIMIT") & (F.col("us") + 600_000_000_000 <= F.col("now"))).select("seq")


_SHOWN = "({last} IS NULL OR r.us - {last} >= 86400000000 OR r.action = 'QUARANTINE')"


@query(stepped("(SELECT *, src || action AS k FROM decided WHERE action <> 'PASS')", "k", {"last": "NULL::BIGINT"}, {"last": f"CASE WHEN {_SHOWN} THEN r.us ELSE {{last}} END", "shown": _SHOWN}, "seq, shown", DECIDED.replace("WITH flows", "WITH RECURSIVE flows", 1)))
def alert_dedup(spark, sf):
    def step(s, row):
        s, shown = folds.dedup_step(s, row["us"] / 1e6, 86400.0, row["action"] == "QUARANTINE")
        return s, {"seq": row["seq"], "shown": shown}

    rows = decided(spark, sf).filter("action <> 'PASS'").select("src", "action", "us", "seq")
    return folds.fold(rows, ["src", "action"], ["us", "seq"], folds.dedup_start, step, "seq long, shown boolean")


@query()
def canary(spark, sf):
    """The registry of each context after every row."""

    def step(s, row):
        s = folds.canary_step(s, row["port"] == 0, row["score"] > 0.2 and row["label"] == 1, row["score"] > 0.1 and row["label"] == 1)
        return s, {"seq": row["seq"], "proto": row["proto"], "version": s["version"], "promoted": s["promoted"], "rolled_back": s["rolled_back"]}

    return folds.fold(flows(spark, sf).select("proto", "us", "seq", "port", "score", "label"), ["proto"], ["us", "seq"], folds.canary_start, step, "seq long, proto string, version int, promoted int, rolled_back int")


@query()
def gaussian_novelty(spark, sf):
    def step(s, row):
        s, score = folds.gaussian_step(s, [row["score"], row["port"] / 100.0])
        return s, {"seq": row["seq"], "score": score}

    return folds.fold(flows(spark, sf).select("src", "us", "seq", "score", "port"), ["src"], ["us", "seq"], folds.gaussian_start(2), step, "seq long, score double")


_CHANGES = "changes AS (SELECT us, seq, (10 + port) / 1000.0 AS value FROM flows WHERE dst = 'signup' AND uid % 10 = 0)"


@query(f"""WITH {FLOWS}, {_CHANGES}, c AS (SELECT us, arg_max(value, seq) AS value FROM changes GROUP BY us) SELECT f.seq, round(coalesce(c.value, 0.02), 6) AS budget FROM flows f ASOF LEFT JOIN c ON f.us >= c.us""")
def settings_asof(spark, sf):
    """The budget in force at each flow; some sign-ups stand for changes of it."""
    f = flows(spark, sf)
    changes = f.filter("dst = 'signup' AND uid % 10 = 0").select("us", "seq", F.lit("budget").alias("name"), ((10 + F.col("port")) / 1000.0).alias("value"))
    return control.settings_at(f.select("seq", "us"), changes, {"budget": 0.02}).select("seq", F.round("budget", 6).alias("budget"))
